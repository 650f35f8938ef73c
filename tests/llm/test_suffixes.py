"""Removal of repeated byte strings against a dictionary of all windows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventloom.llm import queries, strings, suffixes

from .test_operators import DOC, fixture_rows


def brute(rows, window=100):
    """{(place in order, id): (n_bytes, spans, kept)}; rows in order of age."""
    seen, out = set(), []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - window + 1):
            x = raw[s : s + window]
            if x in seen:
                gone[s : s + window] = b"\1" * window
            seen.add(x)
        spans = [(m.start(), m.end()) for m in __import__("re").finditer(b"\1+", bytes(gone))]
        out.append((i, len(raw), spans, bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def texts():
    r = random.Random(5)
    word = lambda n, a="abcdefgh ": "".join(r.choice(a) for _ in range(n))
    long, passage, line = word(3000), word(160), word(70)
    out = [long, long, long[:1500] + "X" + long[1500:], word(500) + passage + word(500), word(90) + passage + word(90), passage, passage[:100], passage[30:129], passage[:99]]
    out += ["a" * 1000, "b" + "a" * 300 + "c", "ab" * 200, None, "", "x", word(99), word(100)]
    out += ["é" * 120, "xé" * 80, "日本語" * 60, "日本語" * 60 + "。", "\0" * 150, "\0" * 260 + "a" + "\0" * 130]
    out += [word(60) + line + word(60) for _ in range(40)] + [(line + "\n") * 6, word(40) + (line + "\n") * 3]
    out += [passage] * 30 + [word(r.randrange(80, 900)) for _ in range(30)]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = [(k, t, "en", "s", 1, "k", "c") for k, t in enumerate(texts())]
    random.Random(2).shuffle(rows)
    path = str(tmp_path_factory.mktemp("suffixes") / "documents.parquet")
    df = spark.createDataFrame(rows, DOC).withColumns({c: F.lit("x") for c in ("row", "id", "range", "runs", "first", "_row")})
    df.repartition(5).write.parquet(path)
    return path


def got(df):
    return sorted((r["doc_id"], r["n_bytes"], [(s["start"], s["stop"]) for s in r["spans"]], bytes(r["kept"])) for r in df.collect())


def test_all_kinds_of_repeats(spark, folder):
    assert got(suffixes.remove_repeats(spark.read.parquet(folder))) == brute(list(enumerate(texts())))


@pytest.mark.parametrize("window", [48, 51, 64])
def test_other_windows(spark, folder, window):
    assert got(suffixes.remove_repeats(spark.read.parquet(folder), window=window)) == brute(list(enumerate(texts())), window)


def test_many_ranges_and_leads_that_span_several(spark, folder, monkeypatch):
    monkeypatch.setattr(suffixes, "RANGE_BYTES", 1500)
    monkeypatch.setattr(suffixes, "WINDOWS", 50)
    monkeypatch.setattr(suffixes, "UNIT", 40)
    monkeypatch.setattr(suffixes, "sampled_splitters", _several)
    assert got(suffixes.remove_repeats(spark.read.parquet(folder))) == brute(list(enumerate(texts())))


def _several(rows, total, window, n_ranges):
    """Every lead of a common line three times, so that it spans ranges."""
    s = [x for x in suffixes.suffixes(pa.array([t for t in texts() if t and len(t) == 190]), np.arange(99), np.arange(99), window)]
    return np.sort(np.repeat(np.unique(np.concatenate([x.lead() for x in s])), 3))


def test_sampled_splitters(spark, folder, monkeypatch):
    monkeypatch.setattr(suffixes, "RANGE_BYTES", 4000)
    assert got(suffixes.remove_repeats(spark.read.parquet(folder))) == brute(list(enumerate(texts())))


def test_long_texts_in_parts(monkeypatch):
    """The windows of the parts are those of the whole, each once."""
    monkeypatch.setattr(suffixes, "PART", 700)
    r = random.Random(1)
    some = ["".join(r.choice("abc ") for _ in range(n)) for n in (5000, 80, 100, 1399, 1500, 10_000, 699)]
    found = {}
    for s in suffixes.suffixes(pa.array(some), np.arange(7), np.arange(7), 100):
        for k in range(len(s)):
            text = bytes(s.bytes[k, 104 + 80 - s.left[k] :]) + bytes(s.bytes[k, : s.right[k]])
            for j in range(s.last[k] - s.at[k] + 1):
                key = (int(s.row[k]), int(s.at[k]) + j)
                assert key not in found
                found[key] = text[j : j + 100]
    assert found == {(i, p): t.encode()[p : p + 100] for i, t in enumerate(some) for p in range(len(t) - 99)}


def test_ids_that_repeat_or_are_null(spark, tmp_path):
    a, b = "".join(map(chr, range(33, 126))) * 3, "zyx" * 50
    rows = [(None, a), (None, a), (3, b), (3, b), (-5, a + b)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = sorted(((r["doc_id"], r["n_bytes"], [(s["start"], s["stop"]) for s in r["spans"]], bytes(r["kept"])) for r in suffixes.remove_repeats(spark.read.parquet(f"{tmp_path}/d")).collect()), key=repr)
    assert out == sorted(brute(order), key=repr)


def test_fixture_and_query(spark, tmp_path):
    rows = [r for r in fixture_rows() if r[0] is not None]
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = [(i, n, sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for i, n, s, k in brute(sorted((r[0], r[1]) for r in rows if r[1] is not None) + [(r[0], None) for r in rows if r[1] is None])]
    out = queries.op11_suffix_dedup(spark, str(tmp_path)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, out.collect())) == sorted(want)
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op11_suffix_dedup(spark, f"{tmp_path}/none").count() == 0


def test_multikey_sort():
    r = np.random.default_rng(0)
    a = r.integers(97, 99, (500, 24)).astype(np.uint8)
    chars = a.view(">u8").astype(np.uint64)
    order, first = strings.multikey_sort(500, [lambda i, k=k: chars[i, k] for k in range(3)])
    rows = [bytes(x) for x in a]
    assert order.tolist() == sorted(range(500), key=lambda k: (rows[k], k))
    assert first.tolist() == [j == 0 or rows[order[j]] != rows[order[j - 1]] for j in range(500)]
