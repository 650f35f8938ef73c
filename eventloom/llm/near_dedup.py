"""Near-duplicate groups by SetSketch registers.

A document's set of word shingles is summarised by ``m`` registers
``K = floor(1 - log_b(min x))`` over exponentially distributed ``x``, truncated
to 0..65535 (Ertl, "SetSketch", 2021). Registers merge by maximum and are
locality-sensitive: two sets agree in a register with about their Jaccard
similarity.

1. *Classes.* Documents with the same set form a class, found by an aggregation
   with map-side combining; thousands of copies are one row from there on. A
   class is known by a 64-bit digest of its set, so ids may repeat.
2. *Bands.* ``bands`` x ``band_rows`` registers give each class its buckets. A pair
   at the threshold of 0.8 shares none with a chance of (1 - 0.8^6)^48, about 5e-7.
   Buckets of at most 8 classes give their pairs at once.
3. *Rounds.* In larger buckets all members face one leader, picked anew in each round from the
   bucket's largest group, so a bucket of n gives n - 1 pairs and not n^2. Pairs are
   estimated jointly by likelihood from their registers; each class verifies its best
   candidate outside its own group on full sets; a link moves the group of its class into
   the leader's. Groups are connected, if not yet whole components; pairs within one need no test.
4. *Rest.* In buckets that still hold several groups, the classes outside the largest
   one are compared with all others, block by block with matrix products over their
   sets, so no link is lost to the choice of leaders. The largest group is not compared
   with itself. Components of all links then give the result.

Estimates only discard pairs five standard errors below the threshold. Sizes
discard exactly: sets whose sizes differ by more than the threshold can't link.

Defined results: null text, or text without words, is an empty set and linked
with nothing; its row has n_shingles 0 and is kept. A text of fewer words than
a shingle is one shingle. A null id is kept as null and groups nothing. Rows
that repeat, or share an id, are each judged by their own text; component_id is the smallest id of
any row of the component. Other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import graphs, words

BASE = 1.001  # of the exponential spacing
TOP = 65_535  # registers are 16 bits


class SetSketch:
    def __init__(self, m: int = 200, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.m = m
        self.a, self.b = ((rng.integers(0, 1 << 32, m, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None] for _ in range(2))

    def registers(self, items: np.ndarray) -> np.ndarray:
        """The registers of a set of 64-bit hashes."""
        low = np.full(self.m, (1 << 32) - 1, np.uint32)
        lo, hi = items.astype(np.uint32)[None], (items >> np.uint64(32)).astype(np.uint32)[None]
        for k in range(0, len(items), 2048):
            v = lo[:, k : k + 2048] * self.a
            v += hi[:, k : k + 2048] * self.b
            np.minimum(low, v.min(axis=1), out=low)
        # the smallest uniform gives the smallest exponential; 8192 keeps registers positive
        x = -np.log1p(-(low + 0.5) / 2.0**32)
        return np.clip(np.floor(1 - np.log(x) / np.log(BASE)) + 8192, 0, TOP).astype("<u2")


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def estimate(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, grid: int = 128) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of rows of registers.

    With u, v the shares of the two sizes, P(Kx > Ky) = p(u - vJ) and P(Kx < Ky)
    = p(v - uJ), where p(z) = -log_b(1 - z (b - 1) / b).
    """
    up, down = (x > y).sum(axis=1)[:, None], (x < y).sum(axis=1)[:, None]
    same = x.shape[1] - up - down
    u = (nx / (nx + ny))[:, None]
    v = 1 - u
    top = np.minimum(u / v, v / u)
    j = top * np.linspace(0, 1, grid)[None]
    p = lambda z: -np.log1p(-np.clip(z, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    a, b = p(u - v * j), p(v - u * j)
    like = up * np.log(np.maximum(a, 1e-12)) + down * np.log(np.maximum(b, 1e-12)) + same * np.log(np.maximum(1 - a - b, 1e-12))
    return np.take_along_axis(j, like.argmax(axis=1)[:, None], 1)[:, 0]


def _class(s: np.ndarray) -> int:
    """A digest of a set of hashes, as a signed 64-bit number."""
    both = np.array([s.sum(dtype=np.uint64) + np.uint64(len(s)), C.mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)])
    return int(C.gram_hashes(both, 2).view(np.int64)[0])


def sketches(docs: DataFrame, width: int, m: int) -> DataFrame:
    """(doc_id, n, rep, regs) of every row; rep: the digest of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words.take_over("near")
        sk = SetSketch(m)
        for b in batches:
            ns, reps, regs = [], [], []
            for h in (h for some in C.word_hashes(b.column("text")) for h in some):
                s = C.shingle_set(h, width)
                ns.append(len(s))
                reps.append(_class(s) if len(s) else None)
                regs.append(sk.registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ns, pa.int64()), pa.array(reps, pa.int64()), pa.array(regs, pa.binary())], ["doc_id", "n", "rep", "regs"])

    return docs.mapInArrow(run, "doc_id long, n long, rep long, regs binary")


def band_keys(classes: DataFrame, bands: int, rows: int, m: int) -> DataFrame:
    """(key, rep, n): one row per class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            r = np.frombuffer(b"".join(b.column("regs").to_pylist()), "<u2").reshape(-1, m).astype(np.uint64)
            key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(r), 1))
            for k in range(rows):
                key = C.mix64(key * np.uint64(0x9E3779B97F4A7C15) + r[:, k : bands * rows : rows])
            rep, n = (np.repeat(b.column(c).to_numpy(), bands) for c in ("rep", "n"))
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(rep), pa.array(n)], ["key", "rep", "n"])

    return classes.select("rep", "n", "regs").mapInArrow(run, "key long, rep long, n long")


class _Linker:
    """Estimates and verifies candidate pairs of classes."""

    def __init__(self, docs: DataFrame, classes: DataFrame, width: int, percent: int, m: int, heavy: int):
        self.docs, self.classes, self.width, self.percent, self.m, self.heavy = docs, classes, width, percent, m, heavy
        self.items: DataFrame | None = None
        t = percent / 100
        self.least = t - 5 * (t * (1 - t) / m) ** 0.5

    def close(self, nx: str, ny: str):
        return (F.col(nx) * 100 >= F.col(ny) * self.percent) & (F.col(ny) * 100 >= F.col(nx) * self.percent)

    def estimated(self, pairs: DataFrame) -> DataFrame:
        """(x, y, est) of those of the stored pairs that may reach the threshold."""
        m, least = self.m, self.least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words.take_over("near")
            for b in batches:
                if not b.num_rows:
                    continue
                rx, ry = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(-1, m) for c in ("rx", "ry"))
                est = estimate(rx, ry, b.column("nx").to_numpy().astype(float), b.column("ny").to_numpy().astype(float))
                at = np.flatnonzero(est >= least)
                yield pa.RecordBatch.from_arrays([b.column("x").take(pa.array(at)), b.column("y").take(pa.array(at)), pa.array(est[at])], ["x", "y", "est"])

        of = lambda a: self.classes.select(F.col("rep").alias(a), F.col("n").alias(f"n{a}"), F.col("regs").alias(f"r{a}"))
        pairs = pairs.select("x", "y")
        # a class is x in few pairs, one for each bucket at most, but a leader is y in many
        full = C.join_spread(pairs.join(of("x"), "x"), of("y"), "y", "x", self.heavy, pairs)
        return C.saved(full.mapInArrow(run, "x long, y long, est double"), "estimated")

    def read_sets(self, wanted: DataFrame) -> None:
        """The sets of the classes in ``wanted`` (rep, doc_id), in one pass over the texts: a filter
        picks rows by id, and only sets move on."""
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = {}
                for h in (h for some in C.word_hashes(b.column("text")) for h in some):
                    if len(s := C.shingle_set(h, width)):
                        out.setdefault(_class(s), s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())], ["rep", "items"])

        picked = C.maybe_in(self.docs, wanted.select("doc_id"), "doc_id").where("_maybe").select("text")
        self.items = C.saved(picked.mapInArrow(run, "rep long, items binary"), "sets")

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(rep, items) of the classes in ``wanted`` (one column), and perhaps a few others."""
        return C.maybe_in(self.items, wanted, "rep").where("_maybe").drop("_maybe")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Links (a, b): the pairs (x, y) whose full sets reach the threshold."""
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                a, c = [], []
                for x, y, p, q in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), b.column("ix").to_pylist(), b.column("iy").to_pylist()):
                    s, t = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                    both = len(s) + len(t) - len(np.union1d(s, t))
                    if 100 * both >= percent * (len(s) + len(t) - both):
                        a.append(x)
                        c.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

        pairs = C.saved(pairs.select("x", "y"), "pairs")
        items = self.sets(pairs.select(F.explode(F.array("x", "y")).alias("rep")))
        of = lambda a: items.select(F.col("rep").alias(a), F.col("items").alias(f"i{a}"))
        # a class is x in few pairs, one for each bucket at most, but a leader is y in many
        full = C.join_spread(pairs.join(of("x"), "x"), of("y"), "y", "x", self.heavy, pairs)
        links = C.saved(full.mapInArrow(run, "a long, b long").distinct(), "links")
        C.discard(pairs)
        return links

    def rest_in_buckets(self, members: DataFrame, block: int) -> DataFrame:
        """Links (a, b) between components within each bucket, one for each two components and task.

        The members of a bucket's largest component and the others are dealt to blocks of about ``block``;
        each block of others meets each block of the largest component and each of the others, so that no task
        holds a whole bucket. Within a group all intersections are counted at once, as
        products of 0-1 matrices; pairs never become rows.
        """
        percent = self.percent

        def run(table: pa.Table) -> pa.Table:
            words.take_over("near")
            comp = table.column("comp").to_numpy()
            rep = table.column("rep").to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()]
            size = np.array([len(x) for x in sets])
            row = np.repeat(np.arange(len(sets)), size)
            _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            common = n > 1  # what one set alone has is in no intersection
            at, row = (np.cumsum(common) - 1)[at[common[at]]], row[common[at]]
            both = np.zeros((len(sets), len(sets)), np.float32)
            order = np.argsort(at, kind="stable")
            at, row = at[order], row[order]
            for s in range(0, int(common.sum()), 4096):
                lo, hi = np.searchsorted(at, (s, s + 4096))
                m = np.zeros((len(sets), 4096), np.float32)
                m[row[lo:hi], at[lo:hi] - s] = 1
                both += m @ m.T
            both = np.rint(both).astype(np.int64)
            a, b = np.nonzero((100 * both >= percent * (size[:, None] + size[None] - both)) & (comp[:, None] < comp[None]))
            _, first = np.unique(np.stack([comp[a], comp[b]]), axis=1, return_index=True)
            return pa.table([pa.array(rep[a[first]]), pa.array(rep[b[first]])], names=["a", "b"])

        shape = _shape(members)
        dealt = C.join_groups(members, shape, "key", "c", self.heavy)
        blocks = lambda n: F.ceil(n / block).cast("int")
        dealt = dealt.withColumns({"nd": blocks(F.col("most")), "no": blocks(F.col("c") - F.col("most"))})
        side = F.col("comp") == F.col("top")
        dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("rep"), F.when(side, F.col("nd")).otherwise(F.col("no"))).cast("int"))
        # a group is a pair (i, j): block i of the largest component, or beyond those block i - nd of the others; block j of the others
        up = lambda n: F.sequence(F.lit(0), n - 1)
        pair = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
        largest = F.transform(up(F.col("no")), lambda o: pair(F.col("mine"), o))
        across = F.transform(up(F.col("nd")), lambda o: pair(o, F.col("mine")))
        among = F.transform(up(F.col("no")), lambda o: pair(F.col("nd") + F.least(o, "mine"), F.greatest(o, F.col("mine"))))
        # a single block of others is whole in each of its groups
        groups = F.when(side, largest).when(F.col("no") == 1, across).otherwise(F.concat(across, among))
        dealt = C.saved(dealt.select("key", "rep", "comp", F.explode(groups).alias("g")).select("key", "g.i", "g.j", "rep", "comp"), "dealt")
        full = C.join_spread(dealt, self.sets(members.select("rep")), "rep", "key", self.heavy)
        return C.saved(full.groupBy("key", "i", "j").applyInArrow(run, "a long, b long").distinct(), "links")


def _shape(members: DataFrame) -> DataFrame:
    """(key, c, top, most) of each bucket: its members, its largest component and that one's members."""
    comps = members.groupBy("key", "comp").agg(F.count("*").alias("c"))
    top = F.max(F.struct("c", F.col("comp").alias("top"))).alias("t")
    return C.saved(comps.groupBy("key").agg(F.sum("c").alias("c"), top).select("key", "c", "t.top", F.col("t.c").alias("most")), "shape")


SMALL = 8  # a bucket of so many gives its pairs at once, at most 28 of them


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 48, band_rows: int = 6, rounds: int = 3, block: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    spark, m = docs.sparkSession, bands * band_rows
    C.small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = C.saved(sketches(docs, width, m), "sketches")
    total = rows.count()
    heavy = C.heavy_bound(total)
    full = rows.where("n > 0 and doc_id is not null")
    classes = C.saved(full.groupBy("rep").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")), "classes")
    reps = C.saved(full.select("rep", "n", "regs").dropDuplicates(["rep"]), "registers")
    linker = _Linker(docs, reps, width, percent, m, heavy)

    keyed = C.saved(band_keys(reps, bands, band_rows, m), "keys")
    counts = C.saved(keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "key-counts")
    near = C.maybe_in(keyed, counts.select("key"), "key").where("_maybe").drop("_maybe")
    shared = C.saved(C.join_groups(near, counts, "key", "c", heavy), "shared")
    C.discard(keyed, counts)
    linker.read_sets(shared.select("rep").distinct().join(classes.select("rep", "doc_id"), "rep"))
    a, b = shared.where(F.col("c") <= SMALL).alias("a"), shared.where(F.col("c") <= SMALL).alias("b")
    few = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.rep") < F.col("b.rep")) & linker.close("a.n", "b.n"))
    listed = linker.estimated(C.saved(few.select(F.col("a.rep").alias("x"), F.col("b.rep").alias("y")).distinct(), "few"))
    members = C.saved(shared.where(F.col("c") > SMALL).select("key", "rep", "n"), "members")
    C.discard(shared)
    # the group of each class, kept apart from its many bucket rows
    labels = C.saved(members.select("rep").distinct().withColumn("comp", F.col("rep")), "labels")

    found: list[DataFrame] = []
    for k in range(rounds):
        placed = C.saved(members.join(labels, "rep"), "placed")
        # the leader comes from the largest group
        mine = F.min(F.struct(F.xxhash64("rep", F.lit(k)).alias("h"), "rep", "n", "comp")).alias("l")
        comps = placed.groupBy("key", "comp").agg(F.count("*").alias("c"), mine)
        lead = C.saved(comps.groupBy("key").agg(F.sum("c").alias("c"), F.max_by("l", F.struct("c", "l.h")).alias("l")), "leaders")
        pairs = C.join_groups(placed, lead, "key", "c", heavy).where("comp <> l.comp").select(F.col("rep").alias("x"), F.col("l.rep").alias("y"), "comp", F.col("l.comp").alias("to"), "n", F.col("l.n").alias("ny"))
        pairs = C.saved(pairs.where(linker.close("n", "ny")).select("x", "y", "comp", "to").distinct(), "faced")
        est = linker.estimated(pairs)
        links = linker.verified(est.groupBy("x").agg(F.max_by("y", F.struct("est", "y")).alias("y")))
        found.append(links)
        # a group moves into one of those its classes link with
        moved = pairs.join(links, (F.col("x") == F.col("a")) & (F.col("y") == F.col("b"))).groupBy("comp").agg(F.min("to").alias("to"))
        moved = C.saved(moved.join(labels.groupBy("comp").agg(F.count("*").alias("size")), "comp"), "moved")
        new = C.join_groups(labels, moved, "comp", "size", heavy, "left").select("rep", F.coalesce("to", "comp").alias("comp"))
        old, labels = labels, C.saved(new, "labels")
        C.discard(old, pairs, est, lead, placed, moved)
    members = C.saved(members.join(labels, "rep"), "placed")
    found += [linker.verified(listed), linker.rest_in_buckets(members, block)]

    comp = graphs.components(_joined(found)).withColumnsRenamed({"node": "rep"})
    mine = classes.join(comp, "rep", "left").select("rep", "doc_id", "copies", F.coalesce("component", "rep").alias("component"))
    mine = C.saved(mine, "placed")
    least = C.saved(mine.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("classes")), "least")
    named = C.saved(C.join_groups(mine, least, "component", "classes", heavy).select("rep", "copies", "component_id"), "named")
    # a class of thousands of copies must not gather its rows in one task
    of = C.join_groups(full.select("doc_id", "n", "rep"), named, "rep", "copies", heavy)
    alone = rows.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out = of.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _joined(found: list[DataFrame]) -> DataFrame:
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every
