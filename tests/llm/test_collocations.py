"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventloom.llm import collocations as K
from eventloom.llm import queries

from .test_operators import DOC, fixture_rows, fold


def brute(rows, longest=5, least=100, percent=100, top=2000):
    """rows: (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", fold(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    often = {p: a for p, a in f.items() if a >= least}
    around = Counter()
    for (lang, p), a in often.items():
        for i in range(len(p)):
            for j in range(i + 1, len(p) + 1):
                if j - i < len(p):
                    around[lang, p[i:j]] = max(around[lang, p[i:j]], a)
    out = {}
    for (lang, p), a in often.items():
        if len(p) > 1 and not ((lang, p) in around and 100 * around[lang, p] >= percent * a):
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.setdefault(lang, []).append((score, a, " ".join(p), f[lang, p[:k]], f[lang, p[k:]]))
    res = []
    for lang, found in out.items():
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        res += [(lang, r, p, a, left, right, n[lang], s) for r, (s, a, p, left, right) in enumerate(found[:top], 1)]
    return sorted(res)


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def rows():
    r = random.Random(3)
    some = ["new", "york", "New", "city", "of", "the", "Été", "naïve", "x\x01y", "a", "b", "日本", "San Marco", "-", "it's"]
    out = []
    for k in range(300):
        words = []
        for _ in range(r.randrange(0, 60)):
            words += r.choice([["New", "York"], ["new", "york", "city"], ["of", "the"], ["a"] * 4, [r.choice(some)], [r.choice(some)], ["one", "two", "three", "four", "five", "six"]])
        sep = r.choice([" ", "  ", "\t", " \t"])
        text = "".join(w + r.choice([sep, sep, sep, sep, ". ", ",", "\n", "; ", "!?", "\x0b"]) for w in words)
        out.append((r.choice(["en", "fr", None, "und", ""]), text))
    return out + [("en", None), (None, None), ("en", ""), ("en", " .,;\t\n"), ("fr", "lone"), ("en", "a " * 500), ("en", "no end " * 200)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), "lang string, text string").withColumns({c: F.lit("x") for c in ("h", "word", "n", "range", "node", "depth", "phrase", "rank")})
    return df.repartition(4)


@pytest.mark.parametrize("least, longest, percent, top", [(20, 5, 100, 2000), (3, 5, 90, 50), (60, 2, 100, 2000), (10, 3, 50, 7)])
def test_against_counting(spark, docs, least, longest, percent, top):
    want = brute(rows(), longest, least, percent, top)
    assert want and got(K.collocations(docs, longest=longest, least=least, percent=percent, top=top)) == want


def test_many_ranges_and_a_full_filter(spark, docs, monkeypatch):
    monkeypatch.setattr(K, "RANGE_NODES", 50)
    monkeypatch.setattr(K, "FILTER_BITS", 1)  # one page
    assert got(K.collocations(docs, least=5)) == brute(rows(), least=5)


def test_exact_beyond_64_bits(spark, monkeypatch):
    """Counts of nodes as they would be over very many texts."""
    big = 3 * 10**12
    node = "node long, lang string, phrase string, depth int, n long, lefts array<long>, rights array<long>, inside long"
    found = spark.createDataFrame([(1, "en", "a b", 2, big + 1, [big + 5], [big + 7], None), (2, "en", "a b c", 3, big, [big + 5, big + 1], [big + 2, big + 3], None)], node)
    total = spark.createDataFrame([("en", 10**13)], "lang string, words long")
    monkeypatch.setattr(K, "phrases", lambda *a: (found, total))
    two = 1000 * (big + 1) * 10**13 // ((big + 5) * (big + 7))
    cuts = [1000 * big * 10**13 // ((big + 5) * (big + 2)), 1000 * big * 10**13 // ((big + 1) * (big + 3))]
    out = {r["phrase"]: r for r in K.collocations(None).collect()}
    assert out["a b"]["score"] == two and out["a b c"]["score"] == min(cuts)


def test_parts_of_long_texts(monkeypatch):
    monkeypatch.setattr(K, "PART", 50)
    text = "one two. three four five\n" * 40
    langs = pa.array(["en", "en"])
    h = [x[0] for x in K._words(pa.RecordBatch.from_arrays([langs, pa.array([text, "one"])], ["lang", "text"]))]
    pieces = sum(len(np.unique(x[1])) for x in K._words(pa.RecordBatch.from_arrays([langs, pa.array([text, "one"])], ["lang", "text"])))
    assert len(h) > 10 and len(np.concatenate(h)) == 201 and len(np.unique(np.concatenate(h))) == 5 and pieces == 81


def test_empty_and_fixture(spark, tmp_path):
    assert K.collocations(spark.createDataFrame([], DOC)).count() == 0
    df = spark.createDataFrame(fixture_rows(), DOC).repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert got(queries.op13_collocations(spark, str(tmp_path))) == brute([(r[2], r[1]) for r in fixture_rows()])
