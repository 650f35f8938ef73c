"""Token ids of whole columns by the ``tokenizers`` library, remembering what repeats.

Byte-level BPE splits a text by a pattern before it merges: into contractions, runs of letters, of
digits, of other signs, each perhaps with a space before it, and white space. The pieces
can be encoded alone and their ids kept. Here the pattern's pieces are found for whole columns
at once, from the classes of bytes, in texts of ASCII, Latin letters and customary punctuation
marks; any other text is cut at lone spaces, and what lies between goes to the library. Stretches with an
apostrophe or the beginning of a special token also go to the library whole.

Pieces are known by 64-bit hashes of their bytes: that two of them meet by chance is less than
likely over 10^12 different pieces (a million are kept, so 10^18 pairs of 2^64). It is only a
cache: it is emptied at ``limit`` pieces, so memory is bounded, and the ids are those of the whole text.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import words

LETTER, DIGIT, SPACE, SIGN, OTHER = range(5)


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    for c in range(128):
        out[c] = LETTER if chr(c).isalpha() else DIGIT if chr(c).isdigit() else SPACE if c in (9, 10, 11, 12, 13, 32) else SIGN
    out[0x80:0xC0] = LETTER  # behind a first byte, which decides
    out[0xC3:0xC9] = LETTER  # U+00C0 to U+023F, all letters but two
    return out


CLASS = _classes()
SPLIT = re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    def __init__(self, path: str, limit: int = 1 << 20):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok, self.limit = Tokenizer.from_file(path), limit
        self.tok.model._resize_cache(0)  # this one replaces the library's
        # in a byte-level vocabulary each character of a token stands for a byte
        vocab = self.tok.get_vocab()
        self.n_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.n_bytes[i] = len(token)
        self.clear()

    def clear(self) -> None:
        self.table = words.Table(max(8, self.limit.bit_length() + 1))
        self.ids, self.start, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.used = 0

    # -------------------------------------------------- the library
    def _alone(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, raw: list[bytes], together: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, ids one after the other, how many of each) of pieces, each encoded alone."""
        # those that begin with a space and hold no more white space are encoded as texts of many and cut at their ends
        plain, other = [], []
        for k, w in enumerate(raw):
            (plain if w[0] == 32 and len(w.split()) == 1 and w[1] > 32 and b"<|" not in w else other).append(k)
        joined = [plain[k : k + together] for k in range(0, len(plain), together)]
        order, ids, size = [], [], []
        for some, got in zip(joined, self._alone([b"".join([raw[k] for k in g]).decode() for g in joined])):
            ends = np.cumsum(self.n_bytes[got])
            want = np.cumsum(np.fromiter((len(raw[k]) for k in some), np.int64, len(some)))
            cut = np.searchsorted(ends, want)
            if cut[-1] == len(got) - 1 and np.array_equal(ends[cut], want):
                order.append(some)
                ids.append(got)
                size.append(np.diff(cut, prepend=-1))
            else:
                other += some
        alone = self._alone([raw[k].decode() for k in other])
        order.append(other)
        ids += alone
        size.append(np.fromiter(map(len, alone), np.int64, len(alone)))
        return np.concatenate([np.asarray(o, np.int64) for o in order]), np.concatenate([*ids, np.zeros(0, np.uint32)]), np.concatenate(size)

    # -------------------------------------------------- pieces
    @staticmethod
    def _marks(data: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Where pieces begin, by class of byte."""
        n = len(kind)
        first = np.zeros(n + 1, bool)
        first[0] = True
        first[ends] = True  # also beyond the last text
        mark = first[:n].copy()
        mark[1:] |= kind[1:] != kind[:-1]
        edges = np.append(np.flatnonzero(mark), n)
        start, stop = edges[:-1], edges[1:]
        white = kind[start] == SPACE
        start, stop = start[white], stop[white]
        inner = ~first[stop]  # something follows in the same text
        start, stop = start[inner], stop[inner]
        blank = data[stop - 1] == 32
        mark[stop - 1] = True  # the last one stands alone, or with what follows if it is a space
        mark[stop[blank]] = False
        # stretches between lone spaces that hold what the pattern treats apart
        odd = np.flatnonzero((data[:n] == 39) | ((data[:n] == 60) & (data[1 : n + 1] == 124)))
        if len(odd):
            lone = stop[blank & (stop - start == 1) & ~first[start]] - 1
            cuts = np.concatenate([np.flatnonzero(first), lone])
            cuts.sort()
            which = np.unique(np.searchsorted(cuts, odd, "right"))
            delta = np.zeros(n + 1, np.int32)
            np.add.at(delta, cuts[which - 1] + 1, 1)
            np.add.at(delta, cuts[which], -1)
            mark &= np.cumsum(delta[:n]) == 0
        return mark

    def _some(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data) - 8
        kind = CLASS[data[:n]]
        marks = np.flatnonzero(data[:n] == 0xE2)
        marks = marks[(data[marks + 1] == 0x80) & (data[marks + 2] >= 0x90) & (data[marks + 2] <= 0xA7)]  # dashes, quotes, dots
        for k in range(3):
            kind[marks + k] = SIGN
        times = np.flatnonzero(data[:n] == 0xC3)
        times = times[(data[times + 1] == 0x97) | (data[times + 1] == 0xB7)]
        kind[times] = OTHER
        careful = np.unique(np.searchsorted(ends, np.flatnonzero(kind == OTHER), "right"))
        if n:
            piece = np.flatnonzero(self._marks(data, ends, kind))
            of_text = np.searchsorted(ends, piece, "right")
            size = np.diff(np.append(piece, n))
            if len(careful):
                keep = ~np.isin(of_text, careful)
                piece, size, of_text = piece[keep], size[keep], of_text[keep]
        else:
            piece = size = of_text = np.zeros(0, np.int64)
        at = self._known(data, piece, size)
        k = self.size[at].astype(np.int64)
        place = np.repeat(self.start[at] - (np.cumsum(k) - k), k)
        place += np.arange(len(place))
        ids, lengths = self.ids[place], np.bincount(of_text, k, len(ends)).astype(np.int64)
        if len(careful):
            cut = np.concatenate([[0], np.cumsum(lengths)])
            parts, last = [], 0
            for t in careful.tolist():
                got = self._careful(data[(ends[t - 1] if t else 0) : ends[t]].tobytes().decode())
                parts += [ids[last : cut[t]], got]
                last, lengths[t] = cut[t], len(got)
            ids = np.concatenate([*parts, ids[last:]])
        return ids, lengths

    def _known(self, data: np.ndarray, piece: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each piece, after learning those that are new."""
        if self.table.n > self.limit:
            self.clear()
        h = words.hashes(data, piece, size)
        at = self.table.find(h)
        new = np.flatnonzero(at < 0)
        if len(new):
            _, which = np.unique(h[new], return_index=True)
            self._learn(h[new[which]], [data[s:e].tobytes() for s, e in zip(piece[new[which]].tolist(), (piece + size)[new[which]].tolist())])
            at[new] = self.table.find(h[new])
        return at

    def _learn(self, h: np.ndarray, raw: list[bytes]) -> None:
        order, ids, size = self._pieces(raw)
        h, n = h[order], self.table.n
        if (need := n + len(h)) > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * need), np.resize(self.size, 2 * need)
        if (need := self.used + len(ids)) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * need)
        self.start[n : n + len(h)] = self.used + np.cumsum(size) - size
        self.size[n : n + len(h)] = size
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        if n + len(h) > len(self.table.keys) // 2:
            old = self.table
            self.table = words.Table(len(old.keys).bit_length())
            known = np.flatnonzero(old.keys)
            self.table.add(old.keys[known[np.argsort(old.at[known])]])
        self.table.add(h)

    def _careful(self, text: str) -> np.ndarray:
        """A text that is not of customary characters, by what lies between lone spaces."""
        parts = SPLIT.split(text)
        if any(not p or p[0].isspace() or p[-1].isspace() for p in parts):
            return self._alone([text])[0]  # white space at an end
        raw = [(" " * (k > 0) + p).encode() for k, p in enumerate(parts)]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        at = self._known(np.frombuffer(b"".join(raw) + bytes(8), np.uint8), np.cumsum(size) - size, size)
        return np.concatenate([self.ids[self.start[a] : self.start[a] + self.size[a]] for a in at.tolist()])

    def encode(self, texts: pa.Array, together: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of texts one after the other, number of ids of each text), some whole texts at a time."""
        for data, ends in words.blocks(texts, together):
            yield self._some(data, ends)


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    words.take_over("encoder")
    return Encoder(path)


words.KEPT["encoder"] = encoder.cache_clear


def with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` behind each text."""
    lengths = lengths + 1
    out = np.empty(len(ids) + len(lengths), np.uint32)
    ends = np.zeros(len(out), bool)
    ends[np.cumsum(lengths) - 1] = True
    out[ends] = end_id
    out[~ends] = ids
    return out, lengths


def crcs(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[int]:
    """CRC-32 of each run of ids as little-endian unsigned 32-bit integers."""
    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    return [zlib.crc32(raw[s:e]) for s, e in zip((4 * starts).tolist(), (4 * (starts + lengths)).tolist())]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
