"""The stages of the pipeline, each against a plain version."""

import pytest

import corpus_pipeline as P
from eventloom.llm import common

from ..conftest import SF
from .test_operators import DOC, brute_components, brute_hits, check_packing, fixture_rows, fold


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), DOC)


def ids(df):
    return sorted(r["doc_id"] for r in df.collect() if r["doc_id"] is not None)


def test_stages_keep_the_columns(spark, docs):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.dtypes == d.dtypes


def test_language_drops_what_has_no_letters(spark, docs):
    assert set(ids(docs)) - set(ids(P.keep_language(spark, docs, SF))) == {3, 4, 5, 11}


def test_exact_keeps_the_largest(spark, docs):
    rows = [r for r in fixture_rows() if r[0] is not None]
    last = {}
    for r in rows:
        last[fold(r[1])] = max(r[0], last.get(fold(r[1]), -1))
    assert ids(P.drop_copies(spark, docs, SF)) == sorted(last.values())


def test_near_keeps_one_of_each_group(spark, docs):
    rows = [r for r in fixture_rows() if r[0] is not None]
    group = {i: c for i, (_, c) in brute_components(rows, 5, 80).items()}
    left = ids(P.drop_near_copies(spark, docs, SF))
    assert sorted(group[i] for i in left) == sorted(set(group.values()))


def test_contaminated_go(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    want = sorted(i for i, (_, n, _) in brute_hits(rows, bench, 10).items() if not n)
    assert ids(P.drop_contaminated(spark, d, SF)) == want


def test_decisions_hold_for_single_rows(spark):
    """Ids that repeat or are null, and columns with the names of helpers."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null").orderBy("item_id").head()["text"]
    base = " ".join(f"wort{k}" for k in range(60))
    texts = [(1, "a b c d"), (1, "w x y z"), (2, "A b c d"), (None, "a b c d"), (None, "a b c d"), (None, item), (1, item + " more"), (7, base), (7, base + " ende"), (None, base + " schluss")]
    names = ["_at", "_page", "_map", "_maybe", "_hot", "_row", "_part", "maybe", "_hit0", "at", "rep"]
    d = spark.createDataFrame([(*r, "en", "s", 1, *names) for r in texts], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    key = lambda df: sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in df.collect()))
    want = lambda rows: sorted((i is None, i or 0, t) for i, t in rows)
    assert key(P.drop_copies(spark, d, SF)) == want([r for k, r in enumerate(texts) if k not in (0, 3, 4)])
    assert key(P.drop_contaminated(spark, d, SF)) == want([r for r in texts if item not in r[1]])
    near = P.drop_near_copies(spark, d, SF)
    assert near.columns == d.columns
    left = sorted(fold(r["text"]) for r in near.collect())
    assert left[0] == "a b c d" and sum(t.startswith("wort") for t in left) == 1 and sum(item.lower() in t for t in left) == 1 and len(left) == 4


def test_run(spark):
    got = P.run(spark, SF).collect()
    assert got and check_packing(got, 1024)
    left = {r["doc_id"] for r in got}
    d = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        d = common.saved(stage(spark, d, SF), "test")
    assert left == set(ids(d))


def test_empty(spark, docs):
    out = docs.limit(0).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in P.STAGES:
        out = common.saved(stage(spark, out, SF), "empty")
    assert out.count() == 0
