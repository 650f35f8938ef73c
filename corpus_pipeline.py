"""A corpus pipeline of five operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs. All but the last return the columns of
documents.

* language: documents without a recognised language, or with a posterior under
  one half, go.
* exact: of equal texts the one with the largest id stays.
* near: of each group of near-duplicates (five-word shingles, 0.8 or more) the first
  row stays.
* decontaminate: documents that hold ten words in a row of a benchmark item go.
* pack: the rest is packed into sequences of 1024 tokens.

What a stage decides of a row holds for that row alone: rows are told apart by their place
in the stage's input and not by id, so null and repeated ids are judged by their own texts.
Of rows that tie (equal texts with one id, or near copies) one stays. A null text has no
letters and goes at the first stage; very long texts are worked on whole; columns that
documents doesn't have pass through, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import common, decontaminate, exact_dedup, language, near_dedup, packing


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    seen = language.identify(docs)
    return seen.where((F.col("lang_pred") != "und") & (F.col("score") >= 0.5)).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, row = common.numbered(docs)
    # the largest id stays, and of equal ids the last row
    keyed = rows.select(F.struct("doc_id", F.col(row).alias("row")).alias("doc_id"), "text")
    gone = exact_dedup.exact_dedup(keyed).where("not kept").select(F.col("doc_id.row").alias("row"))
    return common.without_ids(rows, gone, row).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, row = common.numbered(docs)
    gone = near_dedup.near_dedup(rows, width=5, percent=80, id_col=row).where("not kept").select("doc_id")
    return common.without_ids(rows, gone, row).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, row = common.numbered(docs)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = decontaminate.contamination(rows, bench, id_col=row).where(F.size("spans") > 0).select("doc_id")
    return common.without_ids(rows, hit, row).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(docs)


STAGES = [
    ("language", keep_language),
    ("exact", drop_copies),
    ("near", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("pack", pack),
]

ORACLE_SQL = None  # language scores, tokens and packing can't be said in SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), f"stage-{name}")
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
