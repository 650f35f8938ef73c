"""Collocations: frequent phrases scored by how much more often they occur than their parts would together.

Per language, f(phrase) counts all contiguous occurrences within pieces of texts and n all words. A candidate is a phrase of
2 to ``longest`` words with a = f(phrase) >= ``least``. Cut after its first k words it scores floor(1000 * a * n / (l * r)),
l and r being f of the two parts; its lowest cut counts, of equal ones that of the smallest k. Candidates within a longer one
with at least ``percent`` per cent of their occurrences are dropped, and the ``top`` best of each language returned.

*Tries.* Each shard (a batch of texts) builds a count trie level by level: a node of depth d is its parent and a
word. Tries of a shard know words by 64-bit hashes of language and word, in whose order nodes are sorted and written as columns.

*Merge.* Splitters of a sample's paths cut the order of paths (by the first bits of their words) into ranges of prefixes; every shard sends each
range its slice of the sorted nodes, and a range merges its slices and keeps what occurs ``least`` times. However
common a path is, a shard has one node for it, and the subtree of a common prefix is split among ranges at deeper words.

*Levels.* A frequent phrase has frequent parts. So shards count words first, then pairs of words that are
frequent, then longer paths whose pairs are all frequent. Which are, shards see in a Bloom filter of at most ``FILTER_BITS``;
what it lets through by mistake, or because there are very many, is counted in full and falls at the merge.

*Parts.* Merged nodes hold links to their parent and to their suffix (the path without its first word). Depth by
depth, a node takes the counts of its left parts over its parent, as a walk down the trie meets them, and those of
its right parts over its suffix link. Scores are exact: products are decimals of 38 digits.

Hashes of 64 bits tell words apart, and frequent phrases when they are linked: two of m meet with a chance of about m^2 / 2^65.

A null language is ``und``, a null text empty. Texts of any length are read whole, in parts that end with
pieces. Rows that repeat count each; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C
from . import words
from .strings import multikey_sort

#: Pieces end at these bytes, words in them at spaces and tabs.
BREAKS = b".,;:!?\n\v\f\r"
FOLD = np.frombuffer(bytes(10 if c in BREAKS else 32 if c in b" \t" else C.FOLD[c] for c in range(256)), np.uint8)
#: Bits of a broadcast filter, at most (8 MB).
FILTER_BITS = 1 << 26
#: Bytes of text from which splitters are taken, and paths of them that reach the driver.
SAMPLE_BYTES, SAMPLE_PATHS = 16 << 20, 1 << 16
#: Nodes that a range receives, of this order.
RANGE_NODES = 1 << 21
PART = 4 << 20
#: Parts in which a language's candidates are ranked first.
PARTS = 64
#: Bits of a path's first, second, ... word in the number by which paths are dealt to ranges.
PREFIX = (12, 13, 13, 13, 13)
LINK = np.uint64(0x9E3779B97F4A7C15)


# ------------------------------------------------------------ words of texts
def _parts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, ends of texts, number of the first), each text ending a piece; long texts in several parts."""
    done, end = 0, pa.scalar(b"\n", pa.large_binary())
    for data, ends in words.blocks(pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_binary()), b""), end, pa.scalar(b"", pa.large_binary())), PART):
        folded, at = FOLD[data], 0
        folded[-8:] = 0
        while len(folded) - at > 2 * PART:  # one text: cut it behind a piece
            cut = np.flatnonzero(folded[at + PART : -8] == 10)
            to = at + PART + int(cut[0]) + 1
            yield np.concatenate([folded[at:to], np.zeros(8, np.uint8)]), np.array([to - at]), done
            at = to
        yield folded[at:], ends - at, done
        done += len(ends)


def _salts(langs: pa.Array) -> np.ndarray:
    code = langs.dictionary_encode()
    own = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in code.dictionary.to_pylist()]
    return np.array(own, np.uint64)[code.indices.to_numpy(zero_copy_only=False)] if len(langs) else np.zeros(0, np.uint64)


def _words(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash of language and word, piece, number of the text, bytes, place, size) of the words."""
    salts = _salts(batch.column("lang"))
    for folded, ends, done in _parts(batch.column("text")):
        body = folded[:-8]
        inside = np.zeros(len(body) + 2, bool)
        np.logical_and(body != 32, body != 10, out=inside[1:-1])
        edge = inside[1:] != inside[:-1]
        start, stop = np.flatnonzero(edge & inside[1:]), np.flatnonzero(edge & inside[:-1])
        piece = np.cumsum(body == 10, dtype=np.int32)[start]
        text = np.searchsorted(ends, start, "right") + done
        yield words.mix64(words.hashes(folded, start, stop - start) ^ salts[text]), piece, text, folded, start, stop - start


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words.take_over("collocations")
    for batch in batches:
        langs = batch.column("lang")
        for h, _, text, folded, start, size in _words(batch):
            known, at, n = np.unique(h, return_index=True, return_counts=True)
            raw = [folded[s:e].tobytes() for s, e in zip(start[at].tolist(), (start + size)[at].tolist())]
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(text[at])), pa.array(raw, pa.binary()).cast(pa.string()), pa.array(known.view(np.int64)), pa.array(n)], ["lang", "word", "h", "n"])


# ------------------------------------------------------------ filters
def bloom(spark: SparkSession, keys: DataFrame, n: int) -> np.ndarray:
    """A filter of the hashes in the one column of ``keys``, one bit a hash, of a bounded size."""
    bits = C.PAGE
    while bits < min(FILTER_BITS, 16 * n):
        bits *= 2
    out = np.zeros(bits // 8, np.uint8)
    for page, bitmap in C.bitmap_pages(keys.select(F.col(keys.columns[0]).bitwiseAND(F.lit(bits - 1)).alias("at"))).collect():
        out[page * C.PAGE // 8 : (page + 1) * C.PAGE // 8] = np.frombuffer(bitmap, np.uint8)
    return out


def _within(filt: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(8 * len(filt) - 1)
    return (filt[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


# ------------------------------------------------------------ tries
def link(path: list[np.ndarray]) -> np.ndarray:
    """The number of a node, from the hashes of the words on its path."""
    out = path[0]
    for w in path[1:]:
        out = words.mix64(out * LINK + w)
    return out


def trie(h: np.ndarray, piece: np.ndarray, kept: np.ndarray, pairs: np.ndarray | None, depths: range) -> dict[int, tuple[list[np.ndarray], np.ndarray]]:
    """Sorted nodes of the depths: {depth: (hashes of the words on the paths, one array each; counts)}. ``kept``: words, and
    ``pairs``: pairs of a word and the next, that a path may hold."""
    known, inverse = np.unique(h[kept], return_inverse=True)
    word = np.full(len(h), -1, np.int64)
    word[kept] = inverse
    at = np.flatnonzero(kept)
    node, path, out = word[at], [np.arange(len(known))], {}
    for depth in range(2, depths[-1] + 1):
        to = at + depth - 1
        ok = to < len(h)
        at, to, node = at[ok], to[ok], node[ok]
        ok = (piece[to] == piece[at]) & (word[to] >= 0)
        if pairs is not None:
            ok &= pairs[to - 1]
        at, to, node = at[ok], to[ok], node[ok]
        key, node, n = np.unique(node * max(1, len(known)) + word[to], return_inverse=True, return_counts=True)
        parent, edge = np.divmod(key, max(1, len(known)))
        path = [p[parent] for p in path] + [edge]
        if depth in depths:
            out[depth] = [known[p] for p in path], n.astype(np.int64)
    return out


def _dealt(path: list[np.ndarray]) -> np.ndarray:
    """A path's place in the order by which ranges are cut: the first bits of its words, the first word's first."""
    out, left = np.zeros(len(path[0]), np.uint64), 64
    for w, bits in zip(path, PREFIX):
        left -= bits
        out |= (w >> np.uint64(64 - bits)) << np.uint64(left)
    return out


def _shards(batches: Iterator[pa.RecordBatch], word_filter: np.ndarray, pair_filter: np.ndarray | None, depths: range) -> Iterator[dict]:
    for batch in batches:
        for h, piece, *_ in _words(batch):
            pairs = _within(pair_filter, link([h[:-1], h[1:]])) if pair_filter is not None else None
            yield trie(h, piece, _within(word_filter, h), pairs, depths)


def frequent_nodes(rows: DataFrame, total: int, word_filter: np.ndarray, pair_filter: np.ndarray | None, depths: range, least: int) -> DataFrame:
    """(node, parent, suffix, word, depth, n) of the paths of these depths that occur ``least`` times or more, written."""
    spark = rows.sparkSession
    filters = spark.sparkContext.broadcast((word_filter, pair_filter))
    share = min(1.0, SAMPLE_BYTES / max(1, total))
    stride = max(1, int(share * total * len(depths) / 6 / SAMPLE_PATHS))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words.take_over("collocations")
        for shard in _shards(batches, *filters.value, depths):
            some = np.concatenate([_dealt(path)[::stride] for path, _ in shard.values()])
            yield pa.RecordBatch.from_arrays([pa.array(some.view(np.int64))], ["at"])

    got = np.sort(np.array([r["at"] for r in rows.sample(share, seed=1).mapInArrow(sampled, "at long").collect()], np.int64).view(np.uint64))
    n_ranges = max(1, -(-int(len(got) * stride / share) // RANGE_NODES))
    splitters = got[(np.arange(1, n_ranges) * len(got)) // n_ranges]
    schema = pa.schema([("range", pa.int32()), ("size", pa.int64()), ("cell", pa.binary())])

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words.take_over("collocations")
        for shard in _shards(batches, *filters.value, depths):
            cuts, cells = {}, []
            for d, (path, n) in shard.items():
                to = np.searchsorted(splitters, _dealt(path), "right")
                by = np.argsort(to, kind="stable")
                shard[d] = [w[by] for w in path], n[by]
                cuts[d] = np.searchsorted(to[by], np.arange(n_ranges + 1))
            for k in range(n_ranges):
                raw = b"".join(np.int64(c[k + 1] - c[k]).tobytes() for c in cuts.values())
                raw += b"".join(x[cuts[d][k] : cuts[d][k + 1]].tobytes() for d, (path, n) in shard.items() for x in (*path, n))
                if len(raw) > 8 * len(depths):
                    cells.append((k, len(raw), pa.compress(raw, "zstd", asbytes=True)))
            if cells:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*cells), schema)], schema=schema)

    def merge(table: pa.Table) -> pa.Table:
        words.take_over("collocations")
        found: dict[int, list[list[np.ndarray]]] = {d: [] for d in depths}
        for size, cell in zip(table.column("size").to_pylist(), table.column("cell").to_pylist()):
            raw = pa.decompress(cell, size, "zstd", asbytes=True)
            at = 8 * len(depths)
            for d, n in zip(depths, np.frombuffer(raw, np.int64, len(depths)).tolist()):
                found[d].append([np.frombuffer(raw, np.uint64, n, at + 8 * n * k) for k in range(d + 1)])
                at += 8 * n * (d + 1)
        out = []
        for d, slices in found.items():
            *path, n = (np.concatenate(c) for c in zip(*slices))
            order, first = multikey_sort(len(n), [lambda i, w=w: w[i] for w in path])
            head = np.flatnonzero(first)
            n = np.add.reduceat(n[order].view(np.int64), head) if len(head) else n.view(np.int64)
            often = n >= least
            path, n = [w[order[head[often]]] for w in path], n[often]
            node, parent, suffix = link(path), link(path[:-1]), link(path[1:])
            out.append(pa.table([pa.array(x.view(np.int64)) for x in (node, parent, suffix, path[-1])] + [pa.array(np.full(len(n), d, np.int32)), pa.array(n)], names=["node", "parent", "suffix", "word", "depth", "n"]))
        return pa.concat_tables(out)

    cells = rows.mapInArrow(slices, "range int, size long, cell binary")
    out = C.saved(cells.groupBy("range").applyInArrow(merge, "node long, parent long, suffix long, word long, depth int, n long"), "nodes")
    filters.unpersist()
    return out


# ------------------------------------------------------------ the operator
def phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 5, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """All frequent phrases of 1 to ``longest`` words, (node, lang, phrase, depth, n, lefts, rights, inside), and (lang, words). ``lefts[k]``
    and ``rights[k]`` count the parts of the cut behind word k + 1; ``inside`` is the largest count of a frequent phrase of one word more around it."""
    if not 2 <= longest <= len(PREFIX):
        raise ValueError(f"longest must lie between 2 and {len(PREFIX)}")
    spark = docs.sparkSession
    C.small_batches(spark)
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    counts = C.saved(rows.mapInArrow(_counted_words, "lang string, word string, h long, n long").groupBy("lang", "word", "h").agg(F.sum("n").alias("n")), "words")
    total, often = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0, counts.where(F.col("n") >= least)
    words_of = C.saved(counts.groupBy("lang").agg(F.sum("n").alias("words")), "totals")
    often = C.saved(often.select(F.col("h").alias("node"), "lang", "word", "n"), "frequent")
    C.discard(counts)
    word_filter = bloom(spark, often.select("node"), often.count())
    nodes = pairs = frequent_nodes(rows, total, word_filter, None, range(2, 3), least)
    if longest > 2:
        pair_filter = bloom(spark, pairs.select("node"), pairs.count())
        nodes = nodes.unionByName(frequent_nodes(rows, total, word_filter, pair_filter, range(3, longest + 1), least))
    none = F.array().cast("array<long>")
    level = often.select("node", "lang", F.col("word").alias("phrase"), F.lit(1).alias("depth"), "n", none.alias("lefts"), none.alias("rights"))
    levels = [level]
    edge = often.select(F.col("node").alias("word"), F.col("word").alias("last"))
    for depth in range(2, longest + 1):
        up = level.select(F.col("node").alias("parent"), "lang", "phrase", F.concat("lefts", F.array("n")).alias("lefts"))
        side = level.select(F.col("node").alias("suffix"), F.concat(F.array("n"), "rights").alias("rights"))
        own = nodes.where(F.col("depth") == depth).join(up, "parent").join(side, "suffix").join(edge, "word")
        level = C.saved(own.select("node", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "depth", "n", "lefts", "rights", "parent", "suffix"), f"phrases-{depth}")
        levels.append(level)
    around = None
    for level in levels[1:]:
        for side in ("parent", "suffix"):
            one = level.select(F.col(side).alias("node"), F.col("n").alias("inside"))
            around = one if around is None else around.unionByName(one)
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level.drop("parent", "suffix"))
    return found.join(around.groupBy("node").agg(F.max("inside").alias("inside")), "node", "left"), words_of


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 5, least: int = 100, percent: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the ``top`` best collocations of each language."""
    found, words_of = phrases(docs, lang_col, text_col, longest, least)
    inside = F.col("inside").isNotNull() & (100 * F.col("inside") >= percent * F.col("n"))
    left = found.where((F.col("depth") > 1) & ~inside).withColumnRenamed("n", "a").join(words_of.withColumnRenamed("words", "n"), "lang")
    score = "(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(x.lefts as decimal(19,0)) * cast(x.rights as decimal(19,0)))"
    cut = F.expr(f"array_min(transform(arrays_zip(lefts, rights), (x, k) -> named_struct('score', {score}, 'k', k, 'l', x.lefts, 'r', x.rights)))")
    best = left.withColumn("cut", cut).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = (F.desc("score"), F.desc("a"), "phrase")
    # a language is first cut down in parts, each to its own best, so that no task ranks all of its candidates
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    some = best.withColumn("rank", F.row_number().over(W.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= top)
    rank = F.row_number().over(W.partitionBy("lang").orderBy(*order))
    return some.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

