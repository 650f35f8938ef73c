"""Tables laid out by time, and searches that read little of them.

Rows are range-sorted by (key, time) into Parquet files of small row groups. A manifest beside them has, for each file and
key, the first and last time, the number of rows and the number of the key's rows in files before it. Rows of one key
and time are in one file.

A search for the place of a time (as ``searchsorted`` on the key's whole column would give it) needs the manifest and the one file
that spans the time; a range of times needs the files that meet it, and in those the row groups whose statistics do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def write(df: DataFrame, path: str, key: str, on: str, files: int, row_group_bytes: int = 1 << 20) -> None:
    """Write ``df`` as about ``files`` files in the order of ``key`` and ``on``, with a manifest. Rows with a null time are not
    kept: they have no place in time. A null key is a key of its own."""
    rows = df.where(F.col(on).isNotNull()).repartitionByRange(files, key, on).sortWithinPartitions(key, on)
    rows.write.option("parquet.block.size", row_group_bytes).mode("overwrite").parquet(f"{path}/rows")
    back = df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")
    sizes = back.groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col(key).alias("key")).agg(F.min(on).alias("first"), F.max(on).alias("last"), F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(W.partitionBy("key").orderBy("first").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes.withColumn("before", before).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def _files(spark: SparkSession, path: str, names: DataFrame, schema) -> DataFrame:
    """The rows of the files in ``names`` (file); none if there are none."""
    some = sorted(r["file"] for r in names.select("file").distinct().collect())
    if not some:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/rows/{f}" for f in some])


def read_range(spark: SparkSession, path: str, key: str, on: str, value, a: float, z: float) -> DataFrame:
    """The rows of one key from time ``a`` to ``z``, both included."""
    schema = spark.read.parquet(f"{path}/rows").schema
    met = spark.read.parquet(f"{path}/manifest").where(F.col("key").eqNullSafe(F.lit(value)) & (F.col("last") >= a) & (F.col("first") <= z))
    same = F.col(key).isNull() if value is None else F.col(key) == F.lit(value)
    return _files(spark, path, met, schema).where(same & F.col(on).between(a, z))


def searchsorted(spark: SparkSession, path: str, key: str, on: str, targets: DataFrame, side: str = "left") -> DataFrame:
    """``targets`` (key, time, as in the table, no more columns) with ``place``: how many rows of the key come before (``left``), or before or at (``right``),
    that time. 0 for a key without rows."""
    if side not in ("left", "right"):
        raise ValueError("side must be left or right")
    manifest = spark.read.parquet(f"{path}/manifest")
    schema = spark.read.parquet(f"{path}/rows").select(key, on).schema
    asked = targets.select(F.col(key).alias("key"), F.col(on).cast(schema[on].dataType).alias("time")).distinct()
    # files and times in one order: a file's place is its last time; of equal times, a file that ends there has what is sought on the left
    ends = manifest.select("key", F.col("last").alias("time"), F.struct("file", "before", "first", "rows").alias("in"), F.lit(1 if side == "left" else 0).alias("rank"))
    both = ends.unionByName(asked.select("key", "time", F.lit(None).cast(ends.schema["in"].dataType).alias("in"), F.lit(0 if side == "left" else 1).alias("rank")))
    order = W.partitionBy("key").orderBy("time", "rank")
    after = F.first("in", ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing))
    ahead = F.last("in", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    found = both.withColumn("after", after).withColumn("ahead", ahead).where("in is null")
    all_before = F.coalesce(F.col("ahead.before") + F.col("ahead.rows"), F.lit(0))
    found = found.select("key", "time", F.when(F.col("after").isNull(), all_before).otherwise(F.col("after.before")).alias("before"), F.when(F.col("after.first") <= F.col("time"), F.col("after.file")).alias("file"))
    within = found.where("file is not null")
    rows = _files(spark, path, within, schema).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col(key).alias("key"), F.col(on).alias("time"))
    # rows and times of a file in one order, rows counted as they come
    merged = rows.select("file", "key", "time", F.lit(1).alias("one"), F.lit(1 if side == "left" else 0).alias("rank")).unionByName(within.select("file", "key", "time", F.lit(0).alias("one"), F.lit(0 if side == "left" else 1).alias("rank")))
    count = F.sum("one").over(W.partitionBy("file", "key").orderBy("time", "rank").rowsBetween(W.unboundedPreceding, W.currentRow))
    inside = merged.withColumn("inside", count).where("one = 0").select("key", "time", "inside")
    same = F.col("f.key").eqNullSafe(F.col("i.key")) & (F.col("f.time") == F.col("i.time"))
    out = found.alias("f").join(inside.alias("i"), same, "left")
    return out.select(F.col("f.key").alias(key), F.col("f.time").alias(on), (F.col("before") + F.coalesce("inside", F.lit(0))).alias("place"))
