"""Quality by hierarchical empirical Bayes.

A logistic regression on features of the text gives each document's evidence as
a log-likelihood ratio (the log-odds less those of the training rows). Its features are statistics of
characters and lines, and the mean log-odds of the text's words and of its pairs of words as hashed
n-grams. For fitting, each half of the training rows takes the log-odds of the other half. Sites
add to it: grouped aggregation gives each host and each path below it the number of
documents and the sum of their classifier posteriors, and each level's rate is
shrunk toward the level above with a strength fitted by the method of moments,

    rate = (sum + k * rate above) / (n + k),   n without the document itself,

so a sparse path follows its host, a sparse host the global prior. The document's
posterior combines evidence and its path's shrunk rate.

Aggregations are pre-combined on each task. Rates come back to documents by a
join that broadcasts only hosts and paths with more than a fixed share of all
documents, of which there can only be a fixed number; others shuffle with slim
rows (id, evidence, site), never with texts.

The classifier is fitted on at most about ``sample_rows`` labelled rows (a
documented bound, drawn by hash of the id). Of several labels for one id the largest holds.

Defined results: null or wordless texts have the evidence of an empty text; a
null host or path is a site of its own; with labels of one kind or none the
evidence is 0 everywhere; rows that repeat count and are scored one by one; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

N_FEATURES = 11
N_BUCKETS = 1 << 16  # of hashed n-grams: the lower half for words, the upper for pairs
_LETTERS = bytes(c for c in range(256) if c >= 128 or chr(c).isalpha())
_DIGITS, _SPACE, _UPPER = b"0123456789", b" \t\n\r\x0b\x0c", bytes(range(65, 91))


def grams(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of the words and of the pairs of words of a text."""
    half = N_BUCKETS // 2
    one, two = (np.unique((x >> np.uint64(40)).astype(np.int64) % half) for x in (h, C.gram_hashes(h, 2)))
    return one, two + half


def features(text: bytes | None, h: np.ndarray, odds: np.ndarray) -> list[float]:
    """Of the whole text: variety, symbols, digits, capitals, lengths, lines, n-grams."""
    one, two = grams(h)
    t = text or b""
    w = t.split()
    lines = [x for x in t.split(b"\n") if x.strip()]
    n, k = max(1, len(t)), max(1, len(w))
    distinct = len(set(w))
    letters = n - len(t.translate(None, _LETTERS)) if t else 0
    solid = max(1, len(t.translate(None, _SPACE)))
    return [
        np.log1p(len(w)),
        distinct / k,
        np.log(max(1, distinct)) / np.log(k + 1),
        (solid - letters) / solid,
        (len(t) - len(t.translate(None, _DIGITS))) / n,
        (len(t) - len(t.translate(None, _UPPER))) / n,
        min(40.0, solid / k),
        len(set(lines)) / max(1, len(lines)),
        np.log1p(len(lines)) - np.log1p(len(w)) / 2,
        odds[one].sum() / (len(one) + 20),
        odds[two].sum() / (len(two) + 20),
    ]


def table(b: pa.RecordBatch, *odds: np.ndarray) -> np.ndarray:
    """The features of each text of a batch, by the log-odds of its half if there are two."""
    hashes = (h for some in C.word_hashes(b.column("text")) for h in some)
    half = b.column("half").to_pylist() if len(odds) > 1 else [0] * b.num_rows
    return np.array([features(t, h, odds[k]) for t, h, k in zip(C.utf8(b, "text"), hashes, half)]).reshape(-1, N_FEATURES)


def log_odds(counts: list, smooth: float = 4.0) -> np.ndarray:
    """Of each bucket, from rows (bucket, y, n); bucket -1 counts the texts. Both kinds' rates are
    shrunk toward that of all texts, so that rare n-grams say little."""
    n = np.zeros((2, N_BUCKETS + 1))
    for r in counts:
        n[int(r["y"] > 0), r["bucket"]] += r["n"]
    every = (n[:, :-1].sum(axis=0) + 0.5) / (n[:, -1].sum() + 1)
    rate = (n[:, :-1] + smooth * every) / (n[:, -1:] + smooth)
    return np.log(rate[1] / rate[0])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(mean, scale, weights with intercept, training log-odds), by Newton steps
    on features and their squares. The weights of the n-grams have a prior of their own, which
    holds them back while there are few rows."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - mean) / scale
    z = np.hstack([z, z * z, np.ones((len(z), 1))])
    w = np.zeros(z.shape[1])
    hold = np.full(len(w), ridge)
    hold[[k + n for k in (N_FEATURES - 2, N_FEATURES - 1) for n in (0, N_FEATURES)]] += 10 / len(y)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) / len(y) + hold * w
        h = (z * (p * (1 - p))[:, None]).T @ z / len(y) + np.diag(hold + 1e-9)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    rate = y.mean()
    return mean, scale, w, float(np.log(rate / (1 - rate)))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int, id_col: str, text_col: str, label_col: str):
    y = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y")).where("_id is not null and _y is not null").groupBy("_id").agg(F.max("_y").alias("_y"))
    n = y.count()
    if not n:
        return None
    draw = F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1 << 30)) < int(min(1.0, sample_rows / n) * (1 << 30))
    half = F.pmod(F.xxhash64("_id", F.lit("half")), F.lit(2))
    rows = C.saved(docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(y.where(draw), "_id").select("text", "_y", half.alias("half")), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: dict[tuple, np.ndarray] = {}
            hashes = (h for some in C.word_hashes(b.column("text")) for h in some)
            for h, *key in zip(hashes, b.column("half").to_pylist(), b.column("_y").to_pylist()):
                mine = n.setdefault(tuple(key), np.zeros(N_BUCKETS + 1, np.int64))
                for at in grams(h):
                    mine[at] += 1
                mine[-1] += 1
            for (part, y), mine in n.items():
                at = np.flatnonzero(mine)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part)), pa.array(np.where(at < N_BUCKETS, at, -1)), pa.array(np.full(len(at), y)), pa.array(mine[at])], ["half", "bucket", "y", "n"])

    # at most so many rows for each half and label as there are buckets
    counts = rows.mapInArrow(count, "half long, bucket long, y double, n long").groupBy("half", "bucket", "y").agg(F.sum("n").alias("n")).collect()
    halves = [log_odds([r for r in counts if r["half"] != k]) for k in (0, 1)]
    odds = log_odds(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [np.array(r).tobytes() for r in table(b, *halves)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), b.column("_y")], ["x", "y"])

    got = rows.mapInArrow(run, "x binary, y double").toArrow()
    C.discard(rows)
    y = (got.column("y").to_numpy() > 0).astype(float)
    if len(set(y.tolist())) < 2:
        return None
    x = np.frombuffer(b"".join(got.column("x").to_pylist())).reshape(-1, N_FEATURES)
    order = np.lexsort([*x.T, y])  # as the rows may come in any order
    return *fit(x[order], y[order]), odds


def evidence(docs: DataFrame, model, id_col: str, text_col: str, host: Column, path: Column) -> DataFrame:
    """(doc_id, llr, host, path) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if sent.value is None or not b.num_rows:
                llr = np.zeros(b.num_rows)
            else:
                mean, scale, w, prior, odds = sent.value
                z = np.clip((table(b, odds) - mean) / scale, -8, 8)
                llr = np.hstack([z, z * z, np.ones((len(z), 1))]) @ w - prior
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.clip(llr, -12, 12)), b.column("host"), b.column("path")], ["doc_id", "llr", "host", "path"])

    C.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(host.cast("string"), F.lit("\u0000")).alias("host"), F.coalesce(path.cast("string"), F.lit("\u0000")).alias("path"))
    return rows.mapInArrow(run, "doc_id long, llr double, host string, path string")


def strength(groups: DataFrame, rate: float) -> float:
    """Prior strength from the spread of the groups' rates (method of moments)."""
    r = groups.agg(F.count("*").alias("g"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * (F.col("s") / F.col("n") - rate) ** 2).alias("ss")).head()
    if not r["g"] or r["g"] < 2:
        return 10.0
    noise = rate * (1 - rate)
    spread = (r["ss"] - (r["g"] - 1) * noise) / max(1e-9, r["n"] - r["nn"] / r["n"])
    return float(min(1e4, max(2.0, noise / max(spread, 1e-9) - 1)))


def quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = 0.5, sample_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per input row: doc_id, host, path, evidence, prior, score, kept."""
    model = train(docs, labels, sample_rows, id_col, text_col, label_col)
    rows = C.saved(evidence(docs, model, id_col, text_col, host, path), "evidence")
    base = 0.0 if model is None else model[3]
    rows = rows.withColumn("p", 1 / (1 + F.exp(-(F.col("llr") + base))))
    paths = C.saved(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths")
    hosts = C.saved(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "hosts")
    g = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("s")).head()
    total, mass = g["n"], g["s"]
    rate = (mass + 1) / (total + 2)
    kh, kp = strength(hosts, rate), strength(paths, rate)
    # a host may have many paths: the same bounded join
    heavy = C.heavy_bound(max(1, total))
    many = hosts.join(paths.groupBy("host").agg(F.count("*").alias("m")), "host").select("host", F.col("n").alias("hn"), F.col("s").alias("hs"), "m")
    site = C.saved(C.join_groups(paths, many, "host", "m", heavy).select(F.concat_ws("\u0001", "host", "path").alias("site"), "n", "s", "hn", "hs"), "sites")
    keyed = rows.withColumn("site", F.concat_ws("\u0001", "host", "path"))
    r = C.join_groups(keyed, site, "site", "n", heavy)
    mine = F.col("p")
    above = (F.col("hs") - mine + kh * rate) / (F.col("hn") - 1 + kh)
    prior = (F.col("s") - mine + kp * above) / (F.col("n") - 1 + kp)
    prior = F.least(F.greatest(prior, F.lit(0.01)), F.lit(0.99))
    clean = lambda c: F.when(F.col(c) != "\u0000", F.col(c)).alias(c)
    out = r.withColumn("prior", prior).withColumn("score", 1 / (1 + F.exp(-(F.col("llr") + F.log(F.col("prior") / (1 - F.col("prior")))))))
    return out.select("doc_id", clean("host"), clean("path"), F.col("llr").alias("evidence"), "prior", "score", (F.col("score") >= threshold).alias("kept"))
