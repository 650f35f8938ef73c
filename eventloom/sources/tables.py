"""Operator inputs from the TPC-H-like test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WIDTH, HEIGHT = 16, 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, event_id, t, x, y, p) from ``events``."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("seq"),
        "event_id",
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"),
        (F.col("user_id") % WIDTH).cast("int").alias("x"),
        (F.col("event_id") % HEIGHT).cast("int").alias("y"),
        F.when(F.col("event_type").isin("click", "purchase"), 1).otherwise(0).alias("p"),
    )


def bounds(ev: DataFrame) -> DataFrame:
    return ev.groupBy("seq").agg(F.min("t").alias("t_first"), F.max("t").alias("t_last"))


def pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, idx, t, e, n): a walk per group of users from running sums."""
    e = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), (F.col("user_id") % 8).cast("string")).alias("seq"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"),
        "event_id",
        F.col("value").alias("v"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )
    w = W.partitionBy("seq").orderBy("t", "event_id")
    s = e.select("seq", "t", (F.row_number().over(w) - 1).alias("idx"), F.sum(F.round(F.col("v") * 100) - 5000).over(w).alias("se"), F.sum(F.round("k") - 50).over(w).alias("sn"))
    return s.select("seq", "idx", "t", (F.col("se") / 1000).alias("e"), (F.col("sn") / 10).alias("n"))


def descriptors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries, references): (idx, vec, label) with dense numbers."""
    from ..operators import ranks

    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label")
    number = lambda df: ranks.value_rank(df, F.col("vec_id"), ["vec_id"], "idx").select(F.col("idx").cast("int").alias("idx"), "vec", "label")
    return number(e.where("vec_id % 5 = 0")), number(e.where("vec_id % 5 <> 0"))


def positives(q: DataFrame, r: DataFrame) -> DataFrame:
    """(q, r) of equal labels."""
    return q.select(F.col("idx").alias("q"), "label").join(r.select(F.col("idx").alias("r"), "label"), "label").select("q", "r")


def scores(spark: SparkSession, sf_dir: str, metrics: tuple[str, ...] = ("l2", "cosine", "sad")) -> DataFrame:
    """(run, q, r, s): scores of all queries and references in the metrics."""
    from ..operators import similarity

    out = similarity.score_runs(*descriptors(spark, sf_dir), metrics)
    return out.select(F.col("metric").alias("run"), "q", "r", F.round("s", 6).alias("s"))


def kept_descriptors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The same as ``descriptors``, numbered once and written: several passes read them."""
    from .. import session

    q, r = descriptors(spark, sf_dir)
    return session.stored(q, "queries"), session.stored(r, "references")


def scored(spark: SparkSession, sf_dir: str, metrics: tuple[str, ...] = ("l2", "cosine", "sad"), kept: tuple[DataFrame, DataFrame] | None = None):
    """The scores of ``scores``, computed where they are read."""
    from ..operators import scored as S

    return S.scored(*(kept or kept_descriptors(spark, sf_dir)), tuple(S.Run(m, m) for m in metrics))
