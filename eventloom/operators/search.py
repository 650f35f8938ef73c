"""Search over parameters: a table of trials, evaluated together round by round, of which poor ones are dropped early.

Each round is one job over all trials that are left, whatever their number; results are written, so that
a lost executor never repeats an earlier round. What the driver holds is the number of the round.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session


def _unit(seed: int, name: str) -> Column:
    """A number from 0 to 1 that depends on the seed, the trial and the parameter alone."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col("trial"), F.lit(name)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def trials(spark: SparkSession, n: int, space: dict[str, tuple | list], seed: int = 0) -> DataFrame:
    """(trial, a column per parameter): ``n`` random draws. A tuple (low, high) of whole numbers is drawn with
    both ends, of others without the upper; a list is drawn from."""
    out = spark.range(n).select(F.col("id").alias("trial"))
    for name, what in space.items():
        u = _unit(seed, name)
        if isinstance(what, list):
            one = F.element_at(F.array(*map(F.lit, what)), (F.floor(u * len(what)) + 1).cast("int"))
        elif all(isinstance(v, int) for v in what):
            one = (F.floor(u * (what[1] - what[0] + 1)) + what[0]).cast("int")
        else:
            one = u * float(what[1] - what[0]) + float(what[0])
        out = out.withColumn(name, one)
    return out


def search(table: DataFrame, steps: Sequence, evaluate: Callable[[DataFrame, object], DataFrame], warmup: int = 1, least: int = 4) -> DataFrame:
    """``table`` (trial, parameters) with ``rounds`` (evaluated), ``state`` (``complete``, ``pruned`` or ``failed``), ``value`` (the mean so far) and
    ``place`` (1 for the best complete trial, ties by number; null for others).

    ``evaluate(live trials, step)`` gives (trial, value), higher being better; a trial it gives no value, or a null one, has failed.
    After each step but the last, from ``warmup`` steps on and while ``least`` trials or more are left, trials go whose mean is below the median of those left.
    """
    spark = table.sparkSession
    live = session.stored(table.select("trial", F.lit(0.0).alias("total")), "search-start")
    ended = []
    columns = ["trial", "rounds", "state", "value"]
    for k, step in enumerate(steps, 1):
        params = table.join(live.select("trial"), "trial", "left_semi")
        got = evaluate(params, step).select("trial", F.col("value").cast("double").alias("value"))
        scored = session.stored(live.join(got, "trial", "left").select("trial", (F.col("total") + F.col("value")).alias("total")), f"search-{k}")
        ended.append(scored.where("total is null").select("trial", F.lit(k).alias("rounds"), F.lit("failed").alias("state"), F.lit(None).cast("double").alias("value")))
        live = scored.where("total is not null")
        if k < len(steps) and k >= warmup:
            middle = live.agg(F.expr("percentile(total, 0.5)").alias("middle"), F.count("*").alias("left"))
            judged = live.crossJoin(F.broadcast(middle)).withColumn("poor", (F.col("left") >= least) & (F.col("total") < F.col("middle")))
            ended.append(judged.where("poor").select("trial", F.lit(k).alias("rounds"), F.lit("pruned").alias("state"), (F.col("total") / k).alias("value")))
            live = judged.where("not poor").select("trial", "total")
    done = live.select("trial", F.lit(len(steps)).alias("rounds"), F.lit("complete").alias("state"), (F.col("total") / max(1, len(steps))).alias("value"))
    ended.append(done)
    out = spark.createDataFrame([], done.schema)
    for one in ended:
        out = out.unionByName(one.select(*columns))
    from . import ranks

    place = ranks.value_rank(done, -F.col("value"), ["trial"], "place").select("trial", (F.col("place") + 1).alias("place"))
    return table.join(out, "trial").join(place, "trial", "left")
