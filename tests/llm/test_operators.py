"""The training-data operators against brute force, round trips and held-out labels."""

import hashlib
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventloom.llm import archives, common, dac, decontaminate, encoder, exact_dedup, language, licenses, lm_score, near_dedup, packing, quality, queries

from ..conftest import SF, rows_of

DOC = "doc_id long, text string, lang string, source string, n_chars long, key string, component string"
RNG = np.random.default_rng(11)
WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "Été", "naïve", "x1", "42"]


def text(n, seed):
    r = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i]}{'.' if j % 7 == 6 else ''}" for j, i in enumerate(r.integers(0, len(WORDS), n))) if n else ""


def fixture_rows():
    """Nulls in each column, empty and very long texts, ties, repeated rows."""
    base = text(60, 1)
    rows = [
        (0, base, "en", "a", 1, "k", "c"),
        (1, base.upper(), "en", "a", 1, None, None),
        (2, base + " one more", "fr", "a", 1, "k", "c"),
        (3, None, None, None, None, None, None),
        (4, "", "en", "b", 0, "k", "c"),
        (5, "   \n\t ", "en", "b", 0, "k", "c"),
        (6, "word", "en", None, 4, "k", "c"),
        (7, "Word", None, "b", 4, "k", "c"),
        (8, text(30_000, 2), "de", "b", 1, "k", "c"),
        (9, text(80, 3), "de", "c", 1, "k", "c"),
        (10, "  two  spaces  <|endoftext|>\n\n x ", "de", "c", 1, "k", "c"),
        (11, "12 34 -- !!", "de", "c", 1, "k", "c"),
        (None, text(20, 4), "de", "c", 1, "k", "c"),
    ]
    return rows + [(100 + i, base, "en", "a", 1, "k", "c") for i in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), DOC).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def fold(t):
    return (t or "").translate(str.maketrans(common.UPPER, common.LOWER))


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# ------------------------------------------------------------ SQL on the test tables
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(name, spark, duck):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    if "refers_to" in got:
        got["refers_to"], want["refers_to"] = got["refers_to"].astype("Int64"), want["refers_to"].astype("Int64")
    assert rows_of(got) == rows_of(want)


# ------------------------------------------------------------ 1
def brute_scores(rows, alpha=0.4):
    """Leave-one-out stupid backoff of order 2, counted directly."""
    from collections import Counter
    from math import log

    words = [fold(r[1]).encode().split() for r in rows]
    own = [(Counter(w), Counter(zip(w, w[1:]))) for w in words]
    uni, bi = sum((o[0] for o in own), Counter()), sum((o[1] for o in own), Counter())
    out = []
    for w, (u, b) in zip(words, own):
        rest, s = max(1, sum(uni.values()) - len(w)), 0.0
        for k, x in enumerate(w):
            p = w[k - 1] if k else None
            if k and bi[p, x] - b[p, x] > 0:
                s += log((bi[p, x] - b[p, x]) / max(1, uni[p] - u[p]))
            else:
                s += log(max(1, uni[x] - u[x]) / rest) + (log(alpha) if k else 0)
        out.append((len(w), s))
    return out


def test_lm_scores(spark, docs):
    rows = fixture_rows()
    want = {r[0]: s for r, s in zip(rows, brute_scores(rows))}
    got = by_id(lm_score.score(docs, order=2))
    assert got.keys() == want.keys()
    for k, (n, s) in want.items():
        assert got[k]["n_words"] == n
        assert got[k]["log_score"] == pytest.approx(s, rel=1e-9, abs=1e-9)


def test_lm_score_of_order_three_backs_off(spark):
    d = spark.createDataFrame([(0, "a b c"), (1, "a b c d"), (2, "x b c")], "doc_id long, text string")
    got = by_id(lm_score.score(d, order=3))
    # "a": 1/7, "b" after a: 1/1, "c" after a b: 1/1
    assert got[0]["log_score"] == pytest.approx(np.log(1 / 7), abs=1e-12)


def test_lm_scores_of_the_test_table_use_trigrams(spark):
    from collections import Counter
    from math import log

    docs = [(r["doc_id"], fold(r["text"]).encode().split()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    grams = lambda w: Counter(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    own = {i: grams(w) for i, w in docs}
    every, n_words = sum(own.values(), Counter()), sum(len(w) for _, w in docs)
    got = by_id(queries.QUERIES["op1_lm_score"](spark, SF))
    assert len(got) == len(docs)
    for i, w in docs:
        rest, s = max(1, n_words - len(w)), 0.0
        others = lambda g: every[g] - own[i][g]  # noqa: B023, E731
        for k in range(len(w)):
            for up, m in enumerate(range(min(k, 2), -1, -1)):
                g = tuple(w[k - m : k + 1])
                if m == 0 or others(g) > 0:
                    s += log(max(1, others(g)) / (max(1, others(g[:-1])) if m else rest)) + up * log(0.4)
                    break
        assert got[i]["n_words"] == len(w) and got[i]["log_score"] == pytest.approx(s, rel=1e-7, abs=1e-4)


def test_packed_hashes():
    import zstandard

    z, d = zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()
    for keys in ([0], [0, 1, 2**64 - 1], sorted(RNG.integers(0, 2**64, 1000, np.uint64, endpoint=False).tolist())):
        keys = np.array(keys, np.uint64)
        assert (lm_score.unpack_keys(lm_score.pack_keys(keys, z), d) == keys).all()


# ------------------------------------------------------------ 2
@pytest.mark.parametrize("version", [1, 2, None])
def test_arc_to_warc(spark, version):
    big = "<p>" + "é" * 600
    rows = [(1, "http://a/x y", big), (2, None, big), (3, "http://b", "small"), (4, "http://b", "small"), (5, "u", None), (6, "u", ""), (None, "u", big), (9, "http://a", big)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in archives.arc_to_warc(p, version).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        data = (h or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        dup = h == big and i != 9
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("revisit", 9) if dup else ("response", None))
    assert got[1]["warc_date"] == "2008-04-30T20:48:25Z" and got[1]["url"] == "http://a/x%20y"
    assert len({r["record_id"] for r in got.values()}) == len(rows)


def test_archives_are_converted_in_many_tasks(spark):
    """Long pages, rows that repeat, ties of the largest id, and columns with the names of helpers."""
    long = "é<p>" * 300_000
    rows = [(k, f"http://x/{k}", f"page {k} " * 200, "a", "b", "c") for k in range(40)] + [(99, "u", long, "a", "b", "c"), (99, "u", long, "a", "b", "c"), (98, "v", long, "a", "b", "c")]
    p = spark.createDataFrame(rows, "page_id long, url string, html string, path string, digest string, nth string").repartition(6)
    arcs = archives.write_arc(p, 2, file_bytes=20_000)
    warcs = archives.convert(arcs)
    assert warcs.select(F.input_file_name().alias("f")).distinct().count() > 1
    got = archives.read_warc(warcs).collect()
    assert len(got) == len(rows)
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["page_id"] > 90) == [(98, "revisit", 99), (99, "response", None), (99, "response", None)]


def test_arc_parser_reads_declared_lengths():
    body = b"HTTP/1.0 200 OK\r\n\r\nhttp://fake 1.1.1.1 20000101000000 text/html 3\nabc"
    desc = b"1 0 x\n" + archives.ARC_FIELDS[1].encode() + b"\n\n"
    raw = archives.arc_header(1, "filedesc://f", "0.0.0.0", "2000", "text/plain", len(desc)) + desc + b"\n" + archives.arc_header(1, "http://u", "1.2.3.4", "2000", "text/html", len(body)) + body + b"\n"
    (r,) = archives.parse_arc(io.BytesIO(raw))
    assert r["content"] == body and archives.warc_date(r["date"]) == "2000-01-01T00:00:00Z"
    with pytest.raises(ValueError):
        list(archives.parse_arc(io.BytesIO(raw[:-20])))
    with pytest.raises(ValueError):
        list(archives.parse_arc(io.BytesIO(b"no archive\n")))


def test_no_pages(spark):
    p = spark.createDataFrame([], "page_id long, url string, html string")
    assert archives.arc_to_warc(p).count() == 0


# ------------------------------------------------------------ 3
def test_language_held_out(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op3_language(spark, SF).join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    n, ok = got.count(), got.where("lang_pred = lang").count()
    assert n and ok >= 0.97 * n


def test_language_edges(spark, docs, none):
    got = by_id(language.identify(docs))
    for i in (3, 4, 5, 11):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.identify(none).count() == 0
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify(bare).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    pieces = {"▁": 2, "▁a": 3, "b": 4, "ab": 5, "▁ab": 6}
    p = np.zeros((7, 1))
    p[1:, 0] = [0.01, 0.1, 0.2, 0.3, 0.15, 0.24]
    # "▁ab": one piece; ▁a + b; ▁ + ab; ▁ + a (unknown letter) + b
    want = 0.24 + 0.2 * 0.3 + 0.1 * 0.15 + 0.1 * 0.01 * 0.3
    assert np.exp(language.Lattice(pieces).log_likelihood(["ab"], p))[0, 0] == pytest.approx(want)


# ------------------------------------------------------------ 4 and 10
def reference_ids(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encoder.default_tokenizer())
    return [np.asarray([*t.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4") for r in rows]


def test_long_words_are_summed_over_all_segmentations():
    """Around the border of the two forms, against sums in logarithms, whole and in blocks."""
    rng = random.Random(2)
    pieces = {"▁": 2, "a": 3, "b": 4, "ab": 5, "▁ab": 6, "aba": 7, "bbab": 8, "ba": 9, "▁b": 10}
    p = np.random.default_rng(1).dirichlet(np.ones(12), 2).T.copy()
    lat = language.Lattice(pieces)

    def brute(word):
        w, out = "▁" + word, []
        for lang in range(2):
            a = [0.0] + [-np.inf] * len(w)
            for e in range(1, len(w) + 1):
                for s in range(max(0, e - lat.longest), e):
                    i = pieces.get(w[s:e], 1 if e == s + 1 else None)
                    if i is not None:
                        a[e] = np.logaddexp(a[e], a[s] + np.log(p[i, lang]))
            out.append(a[-1])
        return out

    words = ["".join(rng.choice("abc") for _ in range(n)) for n in (1, 2, 31, 32, 33, 34, 64, 65, 200, 3000)]
    for w in words:
        assert lat.long_log_likelihood(w, p) == pytest.approx(brute(w))
        assert lat.long_log_likelihood(w, p, block=7) == pytest.approx(brute(w))
    assert lat.log_likelihood(words[:4], p).tolist() == [pytest.approx(brute(w)) for w in words[:4]]
    model = language.Scorer(["x", "y"], p, None, pieces=pieces)
    for w in words:
        want = np.array(brute(w)) + brute("ab")
        got = model.score([f"{w} 12 AB"])[0]
        assert got[0] == "xy"[int(want.argmax())] and got[1] == pytest.approx(1 / np.exp(want - want.max()).sum())


def test_codes_round_trip(spark, docs, none):
    rows = sorted(fixture_rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    at, want = 0, {}
    for r, ids in zip(rows, reference_ids(rows)):
        want[r[0]] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in dac.read_archive(dac.write_archive(docs, file_tokens=5000)).collect()}
    assert got == want
    assert dac.read_archive(dac.write_archive(none)).count() == 0


def test_encoder_keeps_the_ids_of_whole_texts():
    """Against the library on odd mixtures, with a table that overflows."""
    from tokenizers import Tokenizer

    rng = random.Random(4)
    bits = ["a", "’", "–", "×", "\u2003", "B", "é", "Ɏ", "ß", " ", "  ", "\n", "\n\n", "\t", "'", "'s", "don't", "<|endoftext|>", "1", "22", ".", ",", "...", "(", "ɐ", "ʼ", "日本", "\u00a0", "İ", "_", "-", "😀", "\u0301", "xxxxx", "\r\n", "ª", "²", "Ⅷ", "'ll", "\x0b", "\x1c", "\x85"]
    texts = ["", *(rng.choice(["", " "]).join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(20_000))]
    path = encoder.default_tokenizer()
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    got = []
    for ids, n in encoder.Encoder(path, 3000).encode(pa.array([*texts, None]), together=20_000):
        got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [*want, []]


def test_words_of_columns():
    """Equal words have equal hashes, different ones different hashes, and none crosses the end of a text."""
    rng = random.Random(8)
    bits = ["a", "B", "b", "é", " ", "  ", "\n", "\t", "\x0c", "abcdefgh", "abcdefghi", "x" * 40, "x" * 41, "\x00", "日"]
    texts = [None, "", "a", "b ", " c", *("".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(3000))]
    seen = {}
    got = [h.tolist() for some in common.word_hashes(pa.array(texts)) for h in some]
    assert len(got) == len(texts)
    for t, hs in zip(texts, got):
        ws = fold(t).encode().split()
        assert len(ws) == len(hs)
        for w, h in zip(ws, hs):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_random_access():
    ids = np.concatenate([RNG.integers(0, 1 << k, 700) for k in (4, 8, 9, 16, 17, 24, 31)]).astype(np.uint32)
    RNG.shuffle(ids)
    out = io.BytesIO()
    dac.write(out, [7, None], np.array([4000, len(ids) - 4000]), ids)
    r = dac.Reader(out.getvalue())
    assert [r.token(i) for i in range(0, len(ids), 13)] == ids[::13].tolist()
    for a, b in ((0, 1), (511, 513), (100, 4500), (0, len(ids)), (5, 5)):
        assert np.array_equal(r.tokens(a, b), ids[a:b])
    assert r.doc_ids == [7, None] and np.array_equal(r.document(1), ids[4000:])
    with pytest.raises(IndexError):
        r.token(len(ids))


def check_packing(pieces, max_len):
    seqs = {}
    for p in pieces:
        seqs.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for s in seqs.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= max_len
    return len(seqs)


def test_packing(spark, docs, none):
    rows = fixture_rows()
    ids = dict(zip((r[0] for r in rows), reference_ids(rows)))
    got = packing.best_fit_pack(docs).collect()
    n = check_packing(got, 1024)
    total = sum(map(len, ids.values()))
    assert n <= 1.02 * -(-total // 1024) + 1
    covered = {}
    for p in got:
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert len(part) == p["length"] and zlib.crc32(part.tobytes()) == p["ids_crc32"]
        covered.setdefault(p["doc_id"], []).append((p["piece"], p["start"], p["length"]))
    for i, ps in covered.items():
        ps.sort()
        assert [p[0] for p in ps] == list(range(len(ps))) and sum(p[2] for p in ps) == len(ids[i])
        assert all(p[2] == 1024 for p in ps[1:]) and (len(ps) == 1) == (len(ids[i]) <= 1024)
    assert packing.best_fit_pack(none).count() == 0


def best_fit_decreasing(lengths, size):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(size - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_sweep_is_best_fit(seed):
    r = np.random.default_rng(seed)
    lengths = r.integers(1, 65, 300).tolist() if seed % 2 else r.choice([7, 30, 33, 64], 200).tolist()
    counts = {n: lengths.count(n) for n in set(lengths)}
    segs = packing.sweep(counts, 64)
    ranks, bins = sorted(lengths, reverse=True), {}
    for k, n in enumerate(ranks):
        first, seq, deep, off = max(s for s in segs if s[0] <= k)
        bins.setdefault(seq + (k - first) // deep, []).append((off + (k - first) % deep * n, n))
    for b in bins.values():
        at = 0
        for off, n in sorted(b):
            assert off == at
            at += n
        assert at <= 64
    assert len(bins) == best_fit_decreasing(lengths, 64)


# ------------------------------------------------------------ 5
def brute_components(rows, width, percent):
    sets = {}
    for r in rows:
        w = fold(r[1]).encode().split()
        sets[r[0]] = frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_near_dedup(spark, docs, width):
    rows = [r for r in fixture_rows() if r[0] is not None]
    # a chain of edits, each near the next and far from the ends, and a borderline crowd
    w = text(200, 9).split()
    chain = [(500 + k, " ".join(w[: 200 - 12 * k] + text(12 * k, 50 + k).split()), "en", "z", 1, None, None) for k in range(8)]
    crowd = []
    for k in range(30):
        v = list(w)
        for j in np.random.default_rng(k).integers(0, 200, 8):
            v[j] = f"edit{k}-{j}"
        crowd.append((600 + k, " ".join(v), "en", "z", 1, None, None))
    want = brute_components(rows + chain + crowd, width, 80)
    d = docs.unionByName(spark.createDataFrame(chain + crowd, DOC))
    got = {r["doc_id"]: r for r in near_dedup.near_dedup(d, width=width).collect()}
    assert got.pop(None)["kept"]
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_near_dedup_of_repeated_ids(spark):
    """Rows of one id are judged by their own texts."""
    a, b, c = text(50, 21), text(50, 22), text(50, 23)
    d = spark.createDataFrame([(1, a), (1, b), (2, a + " end"), (3, b), (4, c), (4, c), (5, c + " end")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in near_dedup.near_dedup(d).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 4)]


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_near_dedup_of_a_crowd(spark, rounds):
    """Copies of one text whose links are not found by one leader, beside a crowd that never links; in small blocks."""
    w = text(150, 31).split()
    rows = []
    for k in range(60):
        v, r = list(w), np.random.default_rng(100 + k)
        for j in r.integers(0, 150, 3 if k % 2 else 14):
            v[j] = f"edit{k}-{j}"
        rows.append((k, " ".join(v)))
    want = brute_components(rows, 2, 80)
    assert 1 < len({c for _, c in want.values()}) < 40
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_dedup(d, width=2, rounds=rounds, block=8).collect()}
    assert got == want


def test_near_dedup_of_nothing(none):
    assert near_dedup.near_dedup(none).count() == 0


def test_sketches_merge_and_estimate():
    sk = near_dedup.SetSketch(400)
    a, b = (common.mix64(np.arange(s, s + 900, dtype=np.uint64)) for s in (1, 101))
    ra, rb = sk.registers(a), sk.registers(b)
    assert np.array_equal(near_dedup.merge(ra, rb), sk.registers(np.union1d(a, b)))
    est = near_dedup.estimate(ra[None], rb[None], np.array([900.0]), np.array([900.0]))[0]
    assert est == pytest.approx(0.8, abs=0.08)


# ------------------------------------------------------------ 6
def test_exact_dedup(spark, docs, none):
    rows = fixture_rows()
    groups = {}
    for r in rows:
        groups.setdefault(fold(r[1]), []).append(r[0])
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows)
    sha = {r[0]: fold(r[1]) for r in rows}
    for r in got:
        ids = groups[sha[r["doc_id"]]]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(ids), r["doc_id"] == keep)
        assert r["text_sha256"] == hashlib.sha256(sha[r["doc_id"]].encode()).hexdigest()
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_dedup_with_a_full_filter(docs):
    assert rows_of(exact_dedup.exact_dedup(docs, max_bits=1, broadcast_bits=0).toPandas()) == rows_of(exact_dedup.exact_dedup(docs).toPandas())


def test_exact_dedup_plan_has_no_python(docs):
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ------------------------------------------------------------ 7
def test_licences(spark, none):
    rows = [
        (0, "Some prose here.\nLicensed under the Apache License, Version 2.0.\nMore prose."),
        (1, "nothing to see, the version of this work is new"),
        (2, "Released under the MIT License."),
        (3, "This work is licensed under the GNU General Public License, version 3."),
        (4, "Licensed under CC BY-NC 4.0."),
        (5, None),
        (6, ""),
        (7, text(400, 5) + " Released under the MIT License. " + text(400, 6)),
    ]
    d = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, family string")
    got = by_id(licenses.license_scan(d))
    assert {i: r["family"] for i, r in got.items()} == {0: "Apache-2.0", 1: None, 2: "MIT", 3: "GPL", 4: "CC-BY-NC", 5: None, 6: None, 7: "MIT"}
    assert all((r["n_notices"] > 0) == (r["family"] is not None) for r in got.values())
    assert licenses.license_scan(none).count() == 0


BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
GPL = " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation"
LGPL = "# under the terms of the\n# GNU Lesser General Public License as published by\n# the Free Software Foundation"


@pytest.fixture(scope="module")
def licence_model():
    return licenses.Model([text(40, i).encode() for i in range(200)])


@pytest.mark.parametrize("notice, family", [(BSD, "BSD"), (GPL, "GPL"), (LGPL, "LGPL")])
def test_wrapped_licences(licence_model, notice, family):
    t = text(60, 1) + "\n\n" + notice + "\n\n" + text(60, 2)
    assert [(n, f) for n, f, _, _ in licenses.scan_text(t.encode(), licence_model, 0.5, 0.6)] == [(2, family)]


def test_all_licences_of_a_line(licence_model):
    found = lambda t: [f for _, f, _, _ in licenses.scan_text(t.encode(), licence_model, 0.5, 0.6)]
    two = "Licensed under the Apache License, Version 2.0. Released under the MIT License."
    assert found(two) == ["Apache-2.0", "MIT"]
    assert found(text(50, 3) + " " + two + " " + text(50, 4) + " Released under the MIT License.") == ["Apache-2.0", "MIT", "MIT"]
    assert found("All rights reserved. Licensed under CC BY 4.0. Licensed under CC BY-SA 4.0.") == ["Proprietary", "CC-BY", "CC-BY-SA"]
    for family, notices in licenses.TEMPLATES.items():
        for n in notices:
            assert set(found(text(30, 5) + " " + n + " " + text(30, 6))) == {family}, n


def test_licences_of_the_test_table(spark):
    """Every line that names a licence of the templates is found, no other document is."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = licenses.license_scan(d).join(d.select("doc_id", "text"), "doc_id").collect()
    for r in got:
        named = any(f in (r["text"] or "") for f in ("Apache License", "MIT License", "General Public License", "CC BY", "rights reserved"))
        assert (r["family"] is not None) == named


# ------------------------------------------------------------ 8
def brute_hits(rows, items, width):
    import re

    pat = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = {}
    for i, t in items:
        w = pat.findall(fold(t))
        for s in range(max(1, len(w) - width + 1) if w else 0):
            wins.setdefault(tuple(w[s : s + width]), set()).add(str(i))
    out = {}
    for r in rows:
        w, hit, found = pat.findall(fold(r[1])), set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if ids := wins.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    found |= ids
        out[r[0]] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("slice_bytes", [64 << 20, 200])
def test_decontamination(spark, docs, none, slice_bytes):
    rows = fixture_rows()
    items = [(1, " ".join(rows[0][1].split()[5:30])), (2, "word"), (3, rows[9][1].upper()), (4, None), (5, "--"), (6, "never seen anywhere in these texts"), (10, " ".join(rows[0][1].split()[20:40])), (11, "alpha beta")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    want = brute_hits(rows, [(i, t) for i, t in items if t], 10)
    got = decontaminate.contamination(docs, bench, slice_bytes=slice_bytes).collect()
    assert len(got) == len(rows)
    for r in got:
        spans = r["spans"]
        assert all(a["stop"] < b["start"] for a, b in zip(spans, spans[1:]))
        assert (r["n_words"], sum(s["stop"] - s["start"] for s in spans), sorted(r["items"])) == want[r["doc_id"]]
    assert decontaminate.contamination(none, bench).count() == 0
    assert all(not r["spans"] for r in decontaminate.contamination(docs, bench.limit(0)).collect())


@pytest.mark.parametrize("slice_bytes", [64 << 20, 300])
def test_decontamination_of_very_common_words(spark, slice_bytes):
    """Windows that many items share and that occur everywhere; one item id with two texts."""
    items = [(k % 40, " ".join(["the"] * (12 + k % 3))) for k in range(60)] + [(100, "the end"), (101, "end")]
    rows = [(k, " ".join(["the"] * n + ["end"] * (k % 2))) for k, n in enumerate((0, 1, 9, 10, 11, 400, 3000))]
    want = brute_hits(rows, items, 10)
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], sum(s["stop"] - s["start"] for s in r["spans"]), sorted(r["items"])) for r in decontaminate.contamination(d, b, slice_bytes=slice_bytes).collect()}
    assert got == want


ROWWISE = {
    "lm": lambda d, b, y: lm_score.score(d, order=3),
    "codes": lambda d, b, y: dac.read_archive(dac.write_archive(d)).drop("start"),
    "pieces": lambda d, b, y: packing.best_fit_pack(d).drop("sequence_id", "offset"),
    "language": lambda d, b, y: language.identify(d, F.col("lang").isNotNull() & F.col("lang").isin("en", "de"), keep=["doc_id"]),
    "licences": lambda d, b, y: license_scan(d),
    "spans": lambda d, b, y: decontaminate.contamination(d, b),
    "spans in slices": lambda d, b, y: decontaminate.contamination(d, b, slice_bytes=40),
    "quality": lambda d, b, y: quality.quality(d, y, F.col("source"), F.col("lang")).drop("host", "path"),
}


def license_scan(d):
    return licenses.license_scan(d, negatives=10_000)


@pytest.mark.parametrize("name", ROWWISE)
def test_ids_that_repeat_or_are_null(spark, name):
    """What a row gets depends on its text: one id for all rows, or none, changes no result but the id."""
    rows = [r for r in fixture_rows()[:30] if r[0] is not None] + [(90, "Released under the MIT License.\n" + text(30, 5), "en", "a", 1, "k", "c"), (91, text(70, 6) + " " + "z" * 5000, "en", "a", 1, "k", "c")]
    bench = spark.createDataFrame([(1, " ".join(rows[0][1].split()[5:30])), (2, "word"), (3, "alpha beta")], "item_id long, text string")
    extra = ["_at", "_page", "_map", "_maybe", "_hot", "_id", "_y", "row", "block", "bucket", "site", "p", "llr", "n", "rep", "from", "held_out"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, component string, " + ", ".join(f"`{c}` string" for c in extra)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = []
    for ids in (lambda i: i, lambda i: i // 40, lambda i: None):
        d = spark.createDataFrame([(ids(r[0]), *r[1:], *extra) for r in rows], schema)
        got = ROWWISE[name](d, bench, labels)
        assert got.count() >= len(rows)
        out.append(sorted(map(str, (tuple(r) for r in got.drop("doc_id").collect()))))
    if name in ("language", "licences"):  # what is learned from is drawn by id
        out = [[o.split(",")[0] for o in x] for x in out]
    assert out[0] == out[1] == out[2]


@pytest.mark.parametrize("seed", range(4))
def test_fm_index(seed):
    r = np.random.default_rng(seed)
    s = r.integers(1, 4, 300)
    s[[50, 51, 120, 299]] = 0
    index = decontaminate.FMIndex(s)
    words = r.integers(1, 5, 80)
    start, size = r.integers(0, 75, 60), r.integers(1, 6, 60)
    lo, hi = index.search(words, start, size)
    for k, n, a, b in zip(start, size, lo, hi):
        p = words[k : k + n]
        want = [i for i in range(len(s) - len(p) + 1) if np.array_equal(s[i : i + len(p)], p)]
        assert sorted(index.locate(np.arange(a, max(a, b)))) == want


# ------------------------------------------------------------ 9
def test_quality(spark, docs, none):
    d, lab = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    q = quality.quality(d, lab, F.col("source"), F.concat_ws("/", "source", "lang"))
    j = q.join(lab, "doc_id")
    n, ok = j.count(), j.where("kept = (quality = 1)").count()
    assert ok >= 0.97 * n and q.count() == d.count()
    e = quality.quality(docs, lab.limit(0), F.col("source"), F.col("lang")).collect()
    assert len(e) == len(fixture_rows()) and all(r["evidence"] == 0 for r in e)
    assert quality.quality(none, lab, F.col("source"), F.col("lang")).count() == 0


def test_quality_of_labels_not_learned_from(spark):
    d, lab = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    q = quality.quality(d, lab.where(part > 0), F.col("source"), F.concat("source", F.lit("/"), "lang")).join(lab.where(part == 0), "doc_id")
    assert q.where("kept = (quality = 1)").count() >= 0.95 * q.count() > 0


def test_quality_of_two_labels_for_one_id(spark):
    """The largest holds, in whatever order they come."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    lab = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    twice = lab.unionByName(lab.select("doc_id", F.lit(0).alias("quality")))
    one, two = ({r["doc_id"]: r["score"] for r in quality.quality(d, y, F.col("source"), F.col("lang")).collect()} for y in (lab, twice.orderBy(F.rand(3))))
    assert one == pytest.approx(two)


def test_log_odds_against_counts():
    """Against rates counted by hand; a bucket in no text says nothing."""
    rows = [{"bucket": -1, "y": 1.0, "n": 6}, {"bucket": -1, "y": 0.0, "n": 2}, {"bucket": 5, "y": 1.0, "n": 3}, {"bucket": 9, "y": 0.0, "n": 2}]
    odds = quality.log_odds(rows)
    rate = lambda n, of, every: (n + 4 * (every + 0.5) / 9) / (of + 4)
    assert odds[5] == pytest.approx(np.log(rate(3, 6, 3) / rate(0, 2, 3))) and odds[9] == pytest.approx(np.log(rate(0, 6, 2) / rate(2, 2, 2)))
    assert odds[100] == pytest.approx(np.log(rate(0, 6, 0) / rate(0, 2, 0)))


def test_sparse_sites_shrink_to_their_host(spark):
    good, bad = text(60, 1), "!!! $$$ " * 30
    rows = [(i, good if i % 10 else bad, "h1", "h1/big") for i in range(200)] + [(300 + i, bad if i % 10 else good, "h2", "h2/big") for i in range(200)] + [(900, good, "h1", "h1/one"), (901, good, "h2", "h2/one")]
    d = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    lab = spark.createDataFrame([(r[0], int(r[1] == good)) for r in rows[:400]], "doc_id long, quality int")
    got = by_id(quality.quality(d, lab, F.col("host"), F.col("path")))
    assert got[900]["prior"] > 0.6 > 0.4 > got[901]["prior"]


# ------------------------------------------------------------ shared parts
def test_join_groups_is_a_join(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("c"), F.max("id").alias("m"))
    got = common.join_groups(rows, groups, "k", "c", 100)
    assert rows_of(got.toPandas()) == rows_of(rows.join(groups, "k").toPandas())


def test_without_ids(spark, docs):
    gone = spark.createDataFrame([(0,), (9,), (12345,)], "doc_id long")
    got = common.without_ids(docs, gone)
    assert rows_of(got.toPandas()) == rows_of(docs.where("doc_id is null or doc_id not in (0, 9)").toPandas())
    assert got.schema.names == docs.schema.names


def test_code_of_workers_is_not_needed_by_the_engine():
    import pathlib
    import re

    root = pathlib.Path(common.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b", p.read_text())


def test_schemas_are_those_of_the_contract(spark):
    kinds = {"op2_arc_to_warc": dict(page_id="bigint", payload_bytes="bigint", payload_digest="string", record_type="string", refers_to="bigint"), "op10_best_fit_pack": dict(doc_id="bigint", piece="int", start="bigint", length="bigint", ids_crc32="bigint", sequence_id="bigint", offset="bigint")}
    for name, want in kinds.items():
        assert dict(queries.QUERIES[name](spark, SF).dtypes) == want


def test_lm_counts_beyond_32_bits():
    """As over a corpus in which words occur thousands of millions of times."""
    block = lm_score.Block(pa.array(["a b a", "b"]), 2)
    keys, counts = block.counts()
    assert counts[0] == 4  # the empty n-gram
    total = counts + np.int64(3_000_000_000)
    total[0] = 10**13
    a, b = (np.searchsorted(keys, block.grams(1)[k]) for k in (0, 1))
    n = block.others(1, keys, total)
    assert n.tolist() == [total[a] - 2, total[b] - 1, total[a] - 2, total[b] - 1]
    want = np.log((total[b] - 1) / (10**13 - 1))
    assert block.scores(keys, total, 0.4)[1] == pytest.approx(want)


def test_lm_scans_that_differ_are_noticed():
    one, two = (lm_score.Block(pa.array([t]), 2).counts()[0] for t in ("a b c", "a b d"))
    assert len(one) == len(two) and lm_score.digest(one) != lm_score.digest(two)
