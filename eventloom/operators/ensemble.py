"""Choice of ensemble members, fusion and agreement of their score tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import session
from . import ranks


def select_members(available: DataFrame, axes: dict[str, list[str]], over: str, fixed: dict[str, str]) -> DataFrame:
    """Runs (run, and a column for each axis) of an ensemble over some axes.

    ``over`` = "all": the full product, an error if one is missing. Else axes
    whose name is part of ``over`` vary and the others are fixed; missing runs are skipped.
    """
    spark = available.sparkSession
    want = None
    for name, values in axes.items():
        one = spark.createDataFrame([(v,) for v in (values if over == "all" or name in over else [fixed[name]])], f"{name} string")
        want = one if want is None else want.crossJoin(one)
    got = want.join(available, list(axes))
    if over == "all" and (missing := want.join(available, list(axes), "left_anti").count()):
        raise LookupError(f"{missing} members of the full product are missing")
    return got


def crop_common(sim: DataFrame, step: int = 1) -> DataFrame:
    """All runs strided and cropped to the fewest rows and columns."""
    s = sim.where((F.col("q") % step == 0) & (F.col("r") % step == 0)).withColumn("q", F.floor(F.col("q") / step).cast("int")).withColumn("r", F.floor(F.col("r") / step).cast("int"))
    least = s.groupBy("run").agg(F.max("q").alias("a"), F.max("r").alias("b")).agg(F.min("a").alias("_q"), F.min("b").alias("_r"))
    return s.crossJoin(F.broadcast(least)).where((F.col("q") <= F.col("_q")) & (F.col("r") <= F.col("_r"))).drop("_q", "_r")


def fuse(sim: DataFrame, *keys: str) -> DataFrame:
    """mean, max, median and sum over the runs, per (keys, q, r). The scores of a cell, one for each run, are
    gathered once; null scores don't count."""
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    cells = sim.where("s is not null").groupBy(*keys, "q", "r").agg(F.array_sort(F.collect_list(F.col("s").cast("double"))).alias("_s"))
    n = F.size("_s")
    middle = (F.get("_s", F.floor((n - 1) / 2).cast("int")) + F.get("_s", F.floor(n / 2).cast("int"))) / 2
    return cells.select(*keys, "q", "r", (add(F.col("_s")) / n).alias("mean"), F.array_max("_s").alias("max"), middle.alias("median"), add(F.col("_s")).alias("sum"))


def sum_patches(sim: DataFrame) -> DataFrame:
    return sim.groupBy("run", "q", "r").agg(F.sum("s").alias("s"))


def disagreement(sim: DataFrame) -> DataFrame:
    """One row: mean over pairs of runs of |A - B| / |A + B| (Frobenius); 0 if a
    sum is 0 or there are fewer than two runs. Runs meet cell by cell, and sums are combined before they shuffle."""
    a, b = (sim.select("q", "r", F.col("run").alias(f"run_{x}"), F.col("s").alias(f"s_{x}")) for x in "ab")
    pairs = a.join(b, ["q", "r"]).where("run_a < run_b").select("run_a", "run_b", (F.col("s_a") - F.col("s_b")).alias("d"), (F.col("s_a") + F.col("s_b")).alias("p"))
    n = pairs.groupBy("run_a", "run_b").agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("d"), F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("p"))
    return n.agg(F.coalesce(F.avg(F.when(F.col("p") > 0, F.col("d") / F.col("p")).otherwise(0.0)), F.lit(0.0)).alias("avg_disagreement"))


def correlation(sim: DataFrame, kind: str = "pearson") -> DataFrame:
    """(a, b, corr) of the runs a < b. Each run keeps its finite scores in the order of (q, r),
    and pairs are cut to the shorter, as positions decide what meets.

    Positions are counted within a query and begin after those of the queries before. Ranks are those of the different values: how many
    scores are below, from counts by value and by range of values. No task holds a whole run.
    """
    finite = sim.where(F.col("s").isNotNull() & ~F.isnan("s") & (F.abs("s") < float("inf"))).withColumn("s", F.col("s").cast("double") + 0.0)
    in_row = F.row_number().over(W.partitionBy("run", "q").orderBy("r"))
    sizes = finite.groupBy("run", "q").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("run").orderBy("q").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = finite.withColumn("k", in_row).join(sizes.select("run", "q", before.alias("_before")), ["run", "q"]).select("run", (F.col("k") + F.col("_before")).alias("k"), "s")
    n = finite.groupBy("run").agg(F.count("*").alias("n"))
    names = n.alias("x").join(n.alias("y"), F.col("x.run") < F.col("y.run")).select(F.col("x.run").alias("a"), F.col("y.run").alias("b"), F.least("x.n", "y.n").alias("n"))
    if kind == "spearman":
        at, names = (session.stored(df, "positions") for df in (at, names))
        # a run is ranked once for each length that it is cut to
        cuts = names.select(F.explode(F.array("a", "b")).alias("run"), "n").distinct()
        cut = at.join(F.broadcast(cuts), "run").where("k <= n")
        values = session.stored(cut.groupBy("run", "n", "s").agg(F.count("*").alias("_c")), "values")
        ranged = ranks.spread(values, F.col("s"), 192)
        lower = F.sum("_all").over(W.partitionBy("run", "n").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
        base = ranged.groupBy("run", "n", "_bucket").agg(F.sum("_c").alias("_all")).select("run", "n", "_bucket", F.coalesce(lower, F.lit(0)).alias("_base"))
        own = F.coalesce(F.sum("_c").over(W.partitionBy("run", "n", "_bucket").orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        rank = ranged.withColumn("_own", own).join(F.broadcast(base), ["run", "n", "_bucket"])
        rank = rank.select("run", "n", "s", (F.col("_base") + F.col("_own") + (F.col("_c") + 1) / 2).alias("_rank"))
        at = cut.join(rank, ["run", "n", "s"]).select("run", "n", "k", F.col("_rank").alias("s"))
        u = F.broadcast(names).join(at.withColumnRenamed("run", "a").withColumnRenamed("s", "u"), ["a", "n"])
        p = u.join(at.withColumnRenamed("run", "b").withColumnRenamed("s", "v"), ["b", "n", "k"])
    else:
        p = names.join(at.select(F.col("run").alias("a"), "k", F.col("s").alias("u")), "a").where("k <= n").join(at.select(F.col("run").alias("b"), "k", F.col("s").alias("v")), ["b", "k"])
    return p.groupBy("a", "b").agg(F.corr("u", "v").alias("corr"))


def nan_mean(tables: DataFrame, *keys: str, value: str = "corr") -> DataFrame:
    return tables.groupBy(*keys).agg(F.avg(F.when(~F.isnan(value), F.col(value))).alias(value))


def upper_triangle(m: DataFrame, i: str, j: str) -> DataFrame:
    return m.where(F.col(i) < F.col(j))
