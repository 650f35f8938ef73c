"""Files moved by a manifest."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import session
from . import storage


def move(manifest: DataFrame, root: str, parts: int = 8) -> DataFrame:
    """Move files below ``root`` as the ``manifest`` (old, new; relative paths) says, and return it with ``state``, once
    all is done: ``moved``; ``kept``, if there was a file at the new place, which is never replaced; ``missing``, if there was none at the old one;
    ``clash`` for all but the first (by old path) of several files that are to go to one place, and for names that climb out of ``root``.

    A move is one rename by one task. Whether a target existed is settled before anything moves, so that a task that
    runs again finds its own earlier moves and counts them as moved. The manifest and its states are written; nothing is collected.
    """
    spark = manifest.sparkSession

    def there(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = storage.at(root)
        file = lambda p: system.get_file_info(f"{base}/{p}").type == fs.FileType.File
        for b in batches:
            old, new = b.column("old").to_pylist(), b.column("new").to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([file(p) for p in old]), pa.array([file(p) for p in new])], [*b.schema.names, "has_old", "has_new"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = storage.at(root)
        for b in batches:
            for old, new, state in zip(*(b.column(c).to_pylist() for c in ("old", "new", "state"))):
                # a task that runs again finds its file moved already
                if state == "moved" and system.get_file_info(f"{base}/{old}").type == fs.FileType.File:
                    system.create_dir(f"{base}/{new}".rpartition("/")[0], recursive=True)
                    system.move(f"{base}/{old}", f"{base}/{new}")
            yield b

    rows = manifest.select("old", "new").where("old is not null and new is not null").distinct().repartition(parts, "old")
    out = F.col("old").rlike(r"(^|/)\.\.(/|$)|^/") | F.col("new").rlike(r"(^|/)\.\.(/|$)|^/")
    seen = rows.mapInArrow(there, "old string, new string, has_old boolean, has_new boolean")
    state = F.when(out, "clash").when(~F.col("has_old"), "missing").when(F.col("has_new"), "kept").when(F.col("n") > 1, "clash").otherwise("moved")
    # only files that exist compete for a place
    plan = seen.withColumn("n", F.when(F.col("has_old"), F.row_number().over(W.partitionBy("new", "has_old").orderBy("old")))).select("old", "new", state.alias("state"))
    path = session.fresh_dir(spark, "moves")
    plan.write.parquet(path)
    done = session.fresh_dir(spark, "moved")
    plan = spark.read.schema(plan.schema).parquet(path)
    plan.repartition(parts, "old").mapInArrow(run, "old string, new string, state string").write.parquet(done)
    return spark.read.schema(plan.schema).parquet(done)
