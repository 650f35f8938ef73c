"""Global order without a global sort in one task.

A window over a whole sequence puts it into one task. Here rows are first counted
in coarse time buckets; a running sum over that small table gives each bucket's offset,
and the window only ranks rows within their bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_bucket(df: DataFrame, t: str, width: float) -> DataFrame:
    return df.withColumn("_bucket", F.floor(F.col(t) / F.lit(width)).cast("long"))


def global_rank(df: DataFrame, by: str, order: list[str], width: float, name: str = "rank") -> DataFrame:
    """0-based rank of each row within ``by`` in the order of ``order``, whose
    first column is a time; ``width`` is the width of a bucket in its unit."""
    rows = with_bucket(df, order[0], width)
    sizes = rows.groupBy(by, "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    offset = sizes.select(by, "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    inner = F.row_number().over(W.partitionBy(by, "_bucket").orderBy(*order))
    return rows.withColumn("_in", inner).join(offset, [by, "_bucket"]).withColumn(name, F.col("_before") + F.col("_in") - 1).drop("_bucket", "_in", "_before")


def last_known(df: DataFrame, by: str, order: list[str], value: Column, width: float, name: str) -> DataFrame:
    """The last non-null ``value`` up to and including each row, carried over
    bucket borders by a small table, so that no task holds a whole sequence."""
    rows = with_bucket(df, order[0], width).withColumn("_v", value)
    ends = rows.groupBy(by, "_bucket").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_end"))
    carry = F.last("_end", ignorenulls=True).over(W.partitionBy(by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    carried = ends.select(by, "_bucket", carry.alias("_carry"))
    inner = F.last("_v", ignorenulls=True).over(W.partitionBy(by, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_in", inner).join(carried, [by, "_bucket"]).withColumn(name, F.coalesce("_in", "_carry")).drop("_bucket", "_v", "_in", "_carry")


def spread(df: DataFrame, value: Column, buckets: int = 64) -> DataFrame:
    """Adds ``_bucket``, ascending with a numeric ``value``: about equal parts by approximate
    quantiles, of which one row goes to all tasks."""
    edges = df.agg(F.percentile_approx(value, [k / buckets for k in range(1, buckets)], 10_000).alias("_edges"))
    below = F.size(F.filter(F.coalesce("_edges", F.array().cast("array<double>")), lambda e: e < value))
    return df.crossJoin(F.broadcast(edges.select(F.col("_edges").cast("array<double>").alias("_edges")))).withColumn("_bucket", below).drop("_edges")


def value_rank(df: DataFrame, value: Column, then: list[str], name: str = "rank", running: dict[str, str] | None = None) -> DataFrame:
    """0-based rank of each row of the whole table by ``value``, ties by ``then``. ``running``: columns whose
    sums up to and including each row are added under other names. Only one row
    for each bucket meets in one task."""
    sums = running or {}
    rows = spread(df.withColumn("_v", value.cast("double")), F.col("_v"))
    sizes = rows.groupBy("_bucket").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in sums])
    w = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select("_bucket", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_before{c}") for c in ["_n", *[f"_s_{c}" for c in sums]]])
    inner = W.partitionBy("_bucket").orderBy("_v", *then)
    out = rows.withColumn(name, F.row_number().over(inner) - 1)
    for c, to in sums.items():
        out = out.withColumn(to, F.sum(c).over(inner.rowsBetween(W.unboundedPreceding, 0)))
    out = out.join(F.broadcast(before), "_bucket").withColumn(name, F.col(name) + F.col("_before_n"))
    for c, to in sums.items():
        out = out.withColumn(to, F.col(to) + F.col(f"_before_s_{c}"))
    return out.select(*df.columns, name, *sums.values())


def count_above(values: DataFrame, value: str, marks: DataFrame, mark: str) -> DataFrame:
    """(mark, n): for each distinct ``mark`` that isn't null, how many of ``values`` are higher. Both are put in one order and
    counted up to each mark, equal ones as one row, so that no mark meets every value."""
    each = values.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_x")).agg(F.count("*").alias("_c")).withColumn("_mark", F.lit(0))
    asked = marks.where(F.col(mark).isNotNull()).select(F.col(mark).cast("double").alias("_x")).distinct().select("_x", F.lit(0).cast("long").alias("_c"), F.lit(1).alias("_mark"))
    upto = value_rank(each.unionByName(asked), F.col("_x"), ["_x", "_mark"], "_k", {"_c": "_upto"}).where("_mark = 1")
    total = each.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("_total"))
    return upto.crossJoin(F.broadcast(total)).select(F.col("_x").alias(mark), (F.col("_total") - F.col("_upto")).alias("n"))
