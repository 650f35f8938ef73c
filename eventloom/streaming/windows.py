"""Streaming forms of the windowed operators: new here, as batch forms were all
there was. Each takes a streaming (or batch) DataFrame of events with a timestamp ``ts``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """Event files as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumbling_counts(events: DataFrame, length: str, late: str = "10 minutes") -> DataFrame:
    """Count image per window and pixel: trunc((tanh(count) + 1) / 2 * 255)."""
    c = events.withWatermark("ts", late).groupBy(F.window("ts", length), "y", "x").agg(F.count("*").alias("n"))
    return c.select(F.col("window.start").alias("start"), "y", "x", "n", F.floor((F.tanh(F.col("n").cast("double")) + 1) / 2 * 255).cast("int").alias("v"))


def sliding_counts(events: DataFrame, length: str, slide: str, late: str = "10 minutes") -> DataFrame:
    c = events.withWatermark("ts", late).groupBy(F.window("ts", length, slide), "p").agg(F.count("*").alias("n"))
    return c.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "p", "n")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Segments broken by gaps, those of one event dropped."""
    c = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "seq").agg(F.count("*").alias("n"))
    return c.where("n >= 2").select("seq", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def min_gap_sample(events: DataFrame, gap: float, late: str = "10 minutes") -> DataFrame:
    """Keep an event if it is ``gap`` seconds after the last kept of its sequence.
    State: one time per sequence. Within a batch events are put in order; across
    batches the order of arrival decides, as it must without waiting."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["t", "event_id"])
        kept = []
        for t, i in zip(rows["t"], rows["event_id"]):
            if last is None or t - last >= gap:
                kept.append((key[0], int(i), float(t)))
                last = float(t)
        state.update((last,))
        yield pd.DataFrame(kept, columns=["seq", "event_id", "t"])

    return events.withWatermark("ts", late).groupBy("seq").applyInPandasWithState(run, "seq string, event_id long, t double", "last double", "append", "NoTimeout")


def run_to_table(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Drive a stream over all that is there now into a table in a folder beside the checkpoint; a complete
    result replaces the one before."""
    folder = f"{checkpoint}-{name}"
    w = stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "complete":
        q = w.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(folder)).start()
    else:
        q = w.format("parquet").option("path", folder).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder)
