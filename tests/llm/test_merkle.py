"""The Merkle manifest against a plain tree."""

import zlib
from hashlib import sha256

from pyspark.sql import functions as F

from eventloom.llm import merkle, queries

from .test_operators import DOC, fixture_rows, fold

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves, fanout):
    """(root, the proof of each leaf as a list of (left, right))."""
    proofs, groups = [[] for _ in leaves], [[k] for k in range(len(leaves))]
    level = list(leaves)
    while len(level) > 1:
        runs = [range(k, min(k + fanout, len(level))) for k in range(0, len(level), fanout)]
        for run in runs:
            for k in run:
                for x in groups[k]:
                    proofs[x].append(("".join(level[j] for j in run if j < k), "".join(level[j] for j in run if j > k)))
        groups = [[x for k in run for x in groups[k]] for run in runs]
        level = [H(*(level[k] for k in run)) for run in runs]
    return (level[0] if level else None), proofs


def brute(rows, fanout=16):
    """rows: (doc_id, source, lang, n_chars, text, text found now)."""
    by = {}
    for r in rows:
        by.setdefault(b"" if r[1] is None else b"=" + r[1].encode(), []).append(r)
    subs, out = [], []
    for src in sorted(by):
        own = sorted(by[src], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r[:5])))
        sub, proofs = tree([leaf(r[:5]) for r in own], fanout)
        subs.append(sub)
        out.append((own, proofs))
    root, tops = tree(subs, fanout)
    res = []
    for (own, proofs), sub, top in zip(out, subs, tops):
        for r, p in zip(own, proofs):
            way, d = p + top, leaf((*r[:4], r[5]))
            for left, right in way:
                d = H(left, d, right)
            res.append((r[0], leaf(r[:5]), sub, root, H(*(a + b for a, b in way)), d, d == root))
    return sorted(res, key=repr)


def got(df):
    cols = ["leaf", "subroot", "root", merkle.proof_digest(F.col("way")).alias("p"), "folded_root", (F.col("folded_root") == F.col("root")).alias("v")]
    return sorted(map(tuple, df.select("doc_id", *cols).collect()), key=repr)


def plain(rows):
    return [(r[0], r[3], r[2], r[4], r[1]) for r in rows]


def test_trees_and_proofs(spark):
    """Nulls in every column, repeated rows, empty and long texts, a source of 40 rows, a lone one."""
    rows = fixture_rows() + [(6, "word", "en", None, 4, "k", "c"), (6, "other", "en", None, 4, "k", "c"), (0, fixture_rows()[0][1], "en", "a", 1, "k", "c")]
    docs = spark.createDataFrame(rows, DOC).repartition(3)
    now = F.when(F.col("doc_id") % 2 == 0, F.upper("text")).otherwise(F.col("text"))
    want = [(*r, r[4].upper() if r[4] is not None and r[0] is not None and r[0] % 2 == 0 else r[4]) for r in plain(rows)]
    for fanout in (16, 2):
        assert got(merkle.manifest(docs, FIELDS, altered={"text": now}, fanout=fanout)) == brute(want, fanout)


def test_many_sources(spark):
    rows = [(k, f"s{k % 40}" if k % 3 else ["é", "Z", "a", ""][k % 4], "en", k, f"text {k}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({c: F.lit("x") for c in ("tree", "at", "size", "digest", "node", "way", "id", "present")})
    assert got(merkle.manifest(docs, FIELDS)) == brute([(*r, r[4]) for r in rows])


def test_one_row_and_none(spark):
    docs = spark.createDataFrame([(1, "s", "en", 1, None)], "doc_id long, source string, lang string, n_chars long, text string")
    only = merkle.manifest(docs, FIELDS).head()
    assert only["root"] == only["leaf"] == only["folded_root"] and only["way"] == []
    assert merkle.manifest(docs.limit(0), FIELDS).count() == 0


def test_offsets_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(merkle, "MOST_OFFSETS", 0)
    rows = [(k, f"s{k % 3}", "en", k, "t") for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert got(merkle.manifest(docs, FIELDS)) == brute([(*r, r[4]) for r in rows])


def test_query_finds_all_tampering(spark, tmp_path):
    rows = [(k, f"s{k % 7}", "en", k, f"{'Text' if k % 2 else 'text'} {k}") for k in range(200)] + [(None, "s1", None, 1, "A"), (900, None, "en", 0, None)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op12_merkle_manifest(spark, str(tmp_path)).collect()
    bad = {r["doc_id"] for r in out if not r["verified"]}
    assert len(out) == len(rows)
    assert bad == {r[0] for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] and fold(r[4]) != r[4]}
