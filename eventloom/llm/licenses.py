"""Licence scan: a trained paragraph classifier with template confirmation.

Paragraphs (runs of lines with words, so that wrapped notices stay whole) are searched for
stretches of at most ``WINDOW`` words that resemble a template (share of the
template's 2-grams of words), and every stretch is
classified by multinomial logistic regression on sparse word n-grams (1 to 3).
The classes are the licence families and *unknown*. The model is trained here: on
notices of each family in many altered forms, and on stretches of the corpus itself
as unknown (of a bounded sample of rows, ``negatives``, drawn by hash: one stretch of each, and one more
that names licences or rights without resembling a template); its temperature, and with it the
probability of unknown, is calibrated on altered notices and lines that training
did not see. A stretch counts only if the prediction is the family it resembles. Overlapping
stretches of one family are one notice; of stretches of two families that share more than half of their words
the one with the higher resemblance counts; there is no limit to the notices or families of a line.

Features exist for n-grams of the templates only.

Defined results: null or wordless texts, and texts without a licence, have null
family, 0 notices and 0 scores; of several families the one with the most
confirmed notices is given, ties by name, and ``families`` lists all; rows
that repeat are scanned one by one; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 48

#: Customary notices of each family.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "This project is released under the Apache License, Version 2.0."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "Licensed under the GNU GPL, version 2 or later."],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 2.1.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3."],
    "BSD": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": ["Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "Proprietary": ["All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."],
}


def words(text: bytes) -> list[bytes]:
    return text.translate(C.FOLD_ALNUM).split()


class Features:
    """n-grams of the templates, as numbers."""

    def __init__(self) -> None:
        self.at: dict[tuple, int] = {}
        self.vocab: set[bytes] = set()
        self.templates: list[tuple[str, set]] = []
        self.pairs: set[tuple] = set()
        for family, notices in TEMPLATES.items():
            for n in notices:
                w = words(n.encode())
                self.vocab.update(w)
                self.templates.append((family, set(zip(w, w[1:]))))
                self.pairs |= self.templates[-1][1]
                for g in self.grams(w):
                    self.at.setdefault(g, len(self.at))

    @staticmethod
    def grams(w: list[bytes]) -> set[tuple]:
        return {tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)}

    def of(self, w: list[bytes]) -> list[int]:
        return sorted(self.at[g] for g in self.grams(w) if g in self.at)

    def resemblance(self, w: list[bytes], family: str) -> float:
        have = set(zip(w, w[1:]))
        return max((len(have & t) / len(t) for f, t in self.templates if f == family and t), default=0.0)


def windows(line: list[bytes]) -> Iterator[list[bytes]]:
    for s in range(0, max(1, len(line) - WINDOW // 2), WINDOW // 2):
        yield line[s : s + WINDOW]


class Model:
    def __init__(self, negatives: list[bytes], seed: int = 5, altered: int = 40, rounds: int = 300):
        self.f, self.classes = Features(), ["unknown", *TEMPLATES]
        rng = np.random.default_rng(seed)
        lines = [w for n in negatives for w in windows(words(n)) if w]
        pool = [x for w in lines for x in w] or [b"word"]
        rows, ys, held = [], [], []
        for k, (family, notices) in enumerate(TEMPLATES.items(), 1):
            for n in notices:
                w = words(n.encode())
                for a in range(altered):
                    v = [x for x in w if a == 0 or rng.random() > 0.08]
                    pad = [pool[i] for i in rng.integers(0, len(pool), int(rng.integers(0, 30)) * (a > 3))]
                    cut = int(rng.integers(0, len(pad) + 1))
                    rows.append(self.f.of(pad[:cut] + v + pad[cut:]))
                    ys.append(k)
                    held.append(a % 5 == 4)
        for a, w in enumerate(lines):
            rows.append(self.f.of(w))
            ys.append(0)
            held.append(a % 5 == 4)
        rows.append([])
        ys.append(0)
        held.append(False)
        y, held = np.array(ys), np.array(held)
        x = np.zeros((len(rows), len(self.f.at)), np.float32)
        for i, r in enumerate(rows):
            x[i, r] = 1
        weight = (1 / np.bincount(y, minlength=len(self.classes)).clip(1))[y]
        self.w, self.b, self.t = np.zeros((x.shape[1], len(self.classes))), np.zeros(len(self.classes)), 1.0
        tx, ty, tw = x[~held], y[~held], weight[~held] / weight[~held].sum()
        gw, gb = np.zeros_like(self.w), np.zeros_like(self.b)
        for _ in range(rounds):  # AdaGrad on the whole of it
            d = self._softmax(tx @ self.w + self.b)
            d[np.arange(len(ty)), ty] -= 1
            d *= tw[:, None]
            g, h = tx.T @ d + 1e-5 * self.w, d.sum(axis=0)
            gw, gb = gw + g * g, gb + h * h
            self.w -= 0.5 * g / np.sqrt(gw + 1e-12)
            self.b -= 0.5 * h / np.sqrt(gb + 1e-12)
        z, hy, hw = x[held] @ self.w + self.b, y[held], weight[held]
        loss = lambda t: -(hw * np.log(self._softmax(z / t)[np.arange(len(hy)), hy] + 1e-12)).sum()
        self.t = min(np.geomspace(0.25, 4, 33), key=loss) if len(hy) else 1.0

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def classify(self, w: list[bytes]) -> tuple[str, float, float]:
        """(family or unknown, probability, resemblance)."""
        at = self.f.of(w)
        p = self._softmax((self.w[at].sum(axis=0) + self.b)[None] / self.t)[0]
        k = int(p.argmax())
        return self.classes[k], float(p[k]), self.f.resemblance(w, self.classes[k]) if k else 0.0


def paragraphs(text: bytes | None) -> Iterator[tuple[list[bytes], list[int]]]:
    """(words, the line of each) of each run of lines that hold words."""
    w, at = [], []
    for nth, raw in enumerate(text.split(b"\n") if text else []):
        line = words(raw)
        if line:
            w += line
            at += [nth] * len(line)
        elif w:
            yield w, at
            w, at = [], []
    if w:
        yield w, at


NAMING = {b"license", b"licence", b"licensed", b"licenses", b"copyright", b"copyrighted", b"rights", b"permission", b"permitted"}


def negative_stretches(text: bytes | None, f: Features, alike: float) -> list[list[bytes]]:
    """Two stretches at most that resemble no template: one drawn by a hash of the text among those
    that name no licence, and one among those that do."""
    plain, hard = [], []
    for w, _ in paragraphs(text):
        for s in windows(w):
            naming = NAMING.intersection(s)
            if not naming or all(f.resemblance(s, family) < alike for family in TEMPLATES):
                (hard if naming else plain).append(s)
    at = zlib.crc32(text or b"")
    return [x[at % len(x)] for x in (plain, hard) if x]


def spans(hits: list[tuple[int, tuple]], template: set, alike: float) -> list[tuple[int, int, float]]:
    """(first word, one after the last, resemblance) of stretches of at most ``WINDOW`` words that
    resemble a template: the best first, then whatever does not overlap it."""
    least, found = alike * len(template), []
    for i, (start, _) in enumerate(hits):
        seen, end = set(), start
        for pos, g in hits[i:]:
            if pos + 2 - start > WINDOW:
                break
            if g not in seen:
                seen.add(g)
                end = pos + 2
        if seen and len(seen) >= least:
            found.append((-len(seen), end - start, start, end))
    out = []
    for n, _, s, e in sorted(found):
        if all(e <= a or b <= s for a, b, _ in out):
            out.append((s, e, -n / len(template)))
    return out


def scan_text(text: bytes | None, model: Model, least: float, alike: float) -> list[tuple[int, str, float, float]]:
    """(line, family, probability, resemblance) of confirmed notices; the line is the one a notice begins on."""
    out = []
    f = model.f
    for w, lines in paragraphs(text):
        if len(f.vocab.intersection(w)) < 2:  # no confirmed notice has fewer
            continue
        hits = [(i, g) for i, g in enumerate(zip(w, w[1:])) if g in f.pairs]
        seen = {g for _, g in hits}
        confirmed = []
        for family, t in f.templates:
            if not t or len(seen & t) < alike * len(t):
                continue
            for s, e, r in spans([h for h in hits if h[1] in t], t, alike):
                got, p, _ = model.classify(w[s:e])
                if got == "unknown" or p < least:  # let the words around decide
                    pad = max(0, WINDOW - (e - s)) // 2
                    got, p, _ = model.classify(w[max(0, s - pad) : e + pad])
                if got == family and p >= least:
                    confirmed.append((r, e - s, p, s, e, family))
        # the same words are a notice of the family they resemble most
        mine: dict[str, list] = {}
        for r, n, p, s, e, family in sorted(confirmed, reverse=True):
            if all(2 * (min(e, b) - max(s, a)) <= min(n, b - a) for other, kept in mine.items() if other != family for a, b, _, _ in kept):
                mine.setdefault(family, []).append((s, e, p, r))
        notices = []
        for family, found in mine.items():
            found.sort()
            s, e, p, r = found[0]
            for a, b, q, x in found[1:]:
                if a < e:
                    e, p, r = max(e, b), max(p, q), max(r, x)
                else:
                    notices.append((s, family, p, r))
                    s, e, p, r = a, b, q, x
            notices.append((s, family, p, r))
        out += [(lines[s], family, p, r) for s, family, p, r in sorted(notices)]
    return out


OUT = "doc_id long, family string, n_notices long, probability double, resemblance double, families array<string>"


def license_scan(docs: DataFrame, negatives: int = 2000, least: float = 0.5, alike: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the licence family of its notices, if any."""
    C.small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = docs.count()
    share = min(1.0, negatives / max(1, total))
    some = docs.where(F.pmod(F.xxhash64("doc_id", "text", F.lit("negatives")), F.lit(1 << 30)) < int(share * (1 << 30)))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features()
        for b in batches:
            out = [" ".join(w.decode("utf-8", "replace") for w in s) for t in C.utf8(b, "text") for s in negative_stretches(t, f, alike)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["l"])

    lines = some.mapInArrow(draw, "l string").toArrow().column("l").to_pylist()
    model = docs.sparkSession.sparkContext.broadcast(Model([x.encode() for x in sorted(lines)]))  # families x n-grams of templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in C.utf8(b, "text"):
                found = scan_text(t, model.value, least, alike)
                if not found:
                    rows.append((None, 0, 0.0, 0.0, []))
                    continue
                top = min(Counter(f[1] for f in found).items(), key=lambda x: (-x[1], x[0]))[0]
                mine = [f for f in found if f[1] == top]
                rows.append((top, len(found), max(f[2] for f in mine), max(f[3] for f in mine), sorted({f[1] for f in found})))
            kinds = (pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.string()))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(cols, kinds))], ["doc_id", "family", "n_notices", "probability", "resemblance", "families"])

    return docs.mapInArrow(run, OUT)
