"""Language identification by segmentation-marginalised unigrams.

Each language has a unigram distribution over the pieces of a fixed public
vocabulary. The probability of a word is the sum over all its segmentations
into pieces, by a forward algorithm; a text's is the product over its words. The piece
probabilities are fitted by expectation maximisation with forward-backward
counts, on at most about ``sample_rows`` labelled texts a language (a documented
bound: rows are drawn by a hash of their id, whole texts each).

Words are maximal runs of letters, lower-cased, of any length. Scores of words are remembered
by each worker, in a cache of bounded size. A letter outside the vocabulary is a
piece of its own. Words over ``LONG`` letters are summed over all their segmentations with scaling, one
by one; only in training do they count as parts of ``LONG`` letters.

Defined results: a text that is null or has no letters, or any text if nothing
could be learned, is ``und`` with score 0; the score is else the posterior of the
predicted language under equal priors; ties go to the language first in order;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import words

LETTERS = re.compile(r"[^\W\d_]+")
LONG = 32
MARK = "▁"  # begins a word in the vocabulary


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> dict[str, int]:
    """Pieces made of letters, perhaps after the mark of a word; ids from 2.
    Id 0 is no piece, id 1 an unknown letter."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out: dict[str, int] = {MARK: 2}
    for i in range(sp.vocab_size()):
        p = sp.id_to_piece(i).lower()
        if LETTERS.fullmatch(p.lstrip(MARK) or "0"):
            out.setdefault(MARK * p.startswith(MARK) + p.lstrip(MARK), len(out) + 2)
    return out


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def parts_of(word: str) -> list[str]:
    return [word] if len(word) <= LONG else [word[k : k + LONG] for k in range(0, len(word), LONG)]


class Lattice:
    """Pieces at each (start, end) of words, for words of one length together.

    A substring's hash comes from those of two prefixes, so that all of a length are looked
    up at once, in a table of the pieces' hashes sorted into slots.
    """

    BASE, SLOTS = np.uint64(0x9E3779B97F4A7C15), 18

    def __init__(self, pieces: dict[str, int]):
        self.longest = max(map(len, pieces))
        hashes = np.zeros(len(pieces), np.uint64)
        base, mask = int(self.BASE), (1 << 64) - 1
        for k, p in enumerate(pieces):
            h = 0
            for c in p:
                h = (h * base + ord(c) + 1) & mask
            hashes[k] = h
        hashes = C.mix64(hashes)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.fromiter(pieces.values(), np.int32, len(pieces))[order]
        slot = (self.hashes >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        self.start = np.searchsorted(slot, np.arange(1 << self.SLOTS))
        self.deep = int(np.bincount(slot).max())
        self.power = np.array([pow(base, k, 1 << 64) for k in range(self.longest + 1)], np.uint64)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of substring hashes, 0 for none."""
        h = C.mix64(h)
        at = self.start[(h >> np.uint64(64 - self.SLOTS)).astype(np.int64)]
        out = np.zeros(len(h), np.int32)
        for k in range(self.deep):
            here = np.minimum(at + k, len(self.hashes) - 1)
            out = np.where(self.hashes[here] == h, self.ids[here], out)
        return out

    def of(self, words: list[str]) -> Iterator[tuple[np.ndarray, dict[tuple[int, int], np.ndarray], int]]:
        """(indices of the words, {(start, end): piece ids}, length)."""
        by = defaultdict(list)
        for k, w in enumerate(words):
            by[len(w) + 1].append(k)
        for n, which in by.items():
            codes = np.frombuffer("".join(MARK + words[k] for k in which).encode("utf-32-le"), "<u4").reshape(-1, n).T.astype(np.uint64) + np.uint64(1)
            prefix = [np.zeros(len(which), np.uint64)]
            for c in codes:
                prefix.append(prefix[-1] * self.BASE + c)
            arcs = {}
            for s in range(n):
                for e in range(s + 1, min(n, s + self.longest) + 1):
                    ids = self.lookup(prefix[e] - prefix[s] * self.power[e - s])
                    if e == s + 1:
                        ids[ids == 0] = 1
                    if ids.any():
                        arcs[s, e] = ids
            yield np.asarray(which), arcs, n

    def forward(self, arcs: dict, n: int, p: np.ndarray, size: int) -> list[np.ndarray]:
        a = [np.ones((size, p.shape[1]))] + [np.zeros((size, p.shape[1])) for _ in range(n)]
        for s, e in sorted(arcs):
            a[e] = a[e] + a[s] * p[arcs[s, e]]
        return a

    def log_likelihood(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """log of the sum over all segmentations, words x languages."""
        out = np.zeros((len(words), p.shape[1]))
        for which, arcs, n in self.of(words):
            out[which] = np.log(self.forward(arcs, n, p, len(which))[n])
        return out


    def long_log_likelihood(self, word: str, p: np.ndarray, block: int = 1 << 16) -> np.ndarray:
        """The same of one word of any length, for each language: only the last sums are kept, and
        scaled at each letter. Pieces are looked up for ``block`` places at once."""
        code = np.frombuffer((MARK + word).encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
        n, wide = len(code), self.longest
        last, log = np.zeros((wide, p.shape[1])), np.zeros(p.shape[1])
        last[-1] = 1  # sums before each of the last places
        for at in range(0, n, block):
            low = max(0, at - wide + 1)
            some = code[low : at + block]
            own = np.zeros(len(some), np.uint64)  # hash of the k letters that end at each place
            found = np.zeros((wide, len(some)), np.int32)
            for k in range(min(wide, len(some))):
                # one more letter in front: its weight is the base to the power of those behind it
                own[k:] += some[: len(some) - k] * self.power[k]
                found[k, k:] = self.lookup(own[k:])
            found[0][found[0] == 0] = 1
            for e in range(at, min(n, at + block)):
                ids = found[:, e - low]
                k = np.flatnonzero(ids)
                new = (last[wide - 1 - k] * p[ids[k]]).sum(axis=0)
                log += np.log(new)
                last[:-1] = last[1:] / new
                last[-1] = 1
        return log


def fit(counts: dict[str, Counter], pieces: dict[str, int], rounds: int = 3, smooth: float = 0.02) -> np.ndarray:
    """Piece probabilities, ids x languages, by expectation maximisation."""
    lat, size = Lattice(pieces), len(pieces) + 2
    out = np.zeros((size, len(counts)))
    for col, lang in enumerate(sorted(counts)):
        words = list(counts[lang])
        weight = np.fromiter((counts[lang][w] for w in words), float, len(words))
        blocks = list(lat.of(words))
        p = np.full((size, 1), 1.0 / size)
        for _ in range(rounds):
            got = np.full(size, smooth)
            for which, arcs, n in blocks:
                a = lat.forward(arcs, n, p, len(which))
                z = weight[which] / a[n][:, 0]
                b = [np.zeros(len(which)) for _ in range(n)] + [z]
                ids, exp = [], []
                for s, e in sorted(arcs, reverse=True, key=lambda x: (x[1], x[0])):
                    q = p[arcs[s, e], 0]
                    b[s] = b[s] + q * b[e]
                    ids.append(arcs[s, e])
                    exp.append(a[s][:, 0] * q * b[e])
                got += np.bincount(np.concatenate(ids), np.concatenate(exp), size)
            got[0] = 0
            p = (got / got.sum())[:, None]
        out[:, col] = p[:, 0]
    return out


def train(docs: DataFrame, trainable: Column, vocabulary: str, sample_rows: int, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray]:
    """The languages, in order, and their piece probabilities."""
    rows = docs.where(trainable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = {r["l"]: r["n"] for r in rows.groupBy(F.col(lang_col).cast("string").alias("l")).agg(F.count("*").alias("n")).collect()}
    if not n:
        return [], np.zeros((0, 0))
    share = F.create_map(*[F.lit(x) for k, v in n.items() for x in (k, min(1.0, sample_rows / v))])
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 30)) / (1 << 30)
    sample = rows.where(draw < F.element_at(share, F.col(lang_col).cast("string"))).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = Counter((lang, part) for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()) for w in words_of(t) for part in parts_of(w))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in c], pa.string()), pa.array([k[1] for k in c], pa.string()), pa.array(list(c.values()), pa.int64())], ["lang", "word", "n"])

    counts: dict[str, Counter] = {k: Counter() for k in n}
    got = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    for lang, w, k in zip(got.column("lang").to_pylist(), got.column("word").to_pylist(), got.column("n").to_pylist()):
        counts[lang][w] += k
    counts = {k: c for k, c in counts.items() if c}
    return sorted(counts), fit(counts, load_pieces(vocabulary))


class Scorer:
    """Texts to (language, posterior)."""

    def __init__(self, langs: list[str], p: np.ndarray, vocabulary: str | None, limit: int = 200_000, pieces: dict[str, int] | None = None):
        self.langs, self.p, self.lattice, self.limit = langs, p, Lattice(pieces or load_pieces(vocabulary)), limit
        self.at: dict[str, int] = {}
        self.rows = np.zeros((0, len(langs)))

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        if len(self.at) > self.limit:
            self.at, self.rows = {}, self.rows[:0]
        words = [words_of(t) if t else [] for t in texts]
        new = list({w for ws in words for w in ws if w not in self.at})
        long = {w: self.lattice.long_log_likelihood(w, self.p) for w in new if len(w) > LONG}
        new = [w for w in new if w not in long] if long else new
        self.at.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
        self.rows = np.concatenate([self.rows, *(self.lattice.log_likelihood(new[k : k + 20_000], self.p) for k in range(0, len(new), 20_000))])
        out = []
        for ws in words:
            if not ws:
                out.append(("und", 0.0))
                continue
            known = [w for w in ws if w not in long] if long else ws
            ll = self.rows[np.fromiter(map(self.at.__getitem__, known), np.int64, len(known))].sum(axis=0)
            if len(known) < len(ws):
                ll = ll + sum(long[w] for w in ws if w in long)
            best = int(ll.argmax())
            out.append((self.langs[best], float(1 / np.exp(ll - ll[best]).sum())))
        return out


_LAST: dict[str, Scorer] = {}
words.KEPT["language"] = _LAST.clear


def _scorer(key: str, model, vocabulary: str) -> Scorer:
    """One scorer for each Python worker and model, so that words stay known from task to task."""
    words.take_over("language")
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = Scorer(*model.value, vocabulary)
    return _LAST[key]


def identify(docs: DataFrame, trainable: Column | None = None, vocabulary: str | None = None, sample_rows: int = 300, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """``docs``, or its columns ``keep``, with lang_pred and score added. ``trainable``: which rows' labels
    may be learned from; labels are never an input of a prediction."""
    C.small_batches(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()
    langs, p = train(docs, F.lit(True) if trainable is None else trainable, vocabulary, sample_rows, id_col, text_col, lang_col)
    model = docs.sparkSession.sparkContext.broadcast((langs, p))  # languages x vocabulary
    keep = keep or [c for c in docs.columns if c not in ("lang_pred", "score")]
    names = keep if text_col in keep else [*keep, text_col]
    at, sent = names.index(text_col), docs.select(*names)
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(key, model, vocabulary)
        for b in batches:
            got = scorer.score(b.column(at).cast(pa.string()).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*keep, "lang_pred", "score"])

    from pyspark.sql import types as T

    return sent.mapInArrow(run, T.StructType([*sent.schema.fields[: len(keep)], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
