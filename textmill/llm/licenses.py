"""License scans: text units against licence templates by the Dice coefficient of word bigrams.

A unit is a line or a sentence of one. Units and templates are normalised alike: lower case,
runs of letters and digits as words. With A and B the sets of their word bigrams (a
one-word text has its word), the coefficient is 2 |A and B| / (|A| + |B|). A template can
only reach the threshold t for units with t / (2 - t) * |B| <= |A| <= (2 - t) / t * |B|, and so
for a range of words: units outside every range are dropped before any bigram is made,
and only templates whose range fits are compared. A unit must also share so many bigrams
with a template that it has one of a few of them; texts without any of these are left first.

A passage is a run of consecutive units: whole licence texts and file headers (the files in
``licence_texts``) are compared with passages of any length, and so are the short notices with
those of two units or more, which finds notices wrapped over lines. Of passages that overlap the
best for the template counts, and it is left out where that is a single unit that a notice has
already. Texts that do not hold as many bigrams of a template as a match must share are left
first. A passage's row has the number of its first unit.

Everything is done in the row of the document, passages in Python; the short templates are literals
(a fixed list). Nulls: a null text has no units. A unit that fits several templates yields a row for
each; repeated units and rows yield rows of their own. Other columns are ignored.
"""

import re
from functools import cache
from math import ceil
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbuf

THRESHOLD = 0.8
#: Usual short notices of public licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is free software under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
]


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a template, in order."""
    words = re.findall("[a-z0-9]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))) or words[:1]


def size_range(size: int, t: float = THRESHOLD) -> tuple[int, int]:
    """Numbers of bigrams that a unit may have to reach ``t`` with a template of ``size``."""
    return ceil(t * size / (2 - t) - 1e-9), int((2 - t) * size / t + 1e-9)


def least_shared(size: int, t: float = THRESHOLD) -> int:
    """Bigrams that a unit must share with a template of ``size`` to reach ``t``."""
    low, high = size_range(size, t)
    return min(ceil(t * (n + size) / 2 - 1e-9) for n in range(max(low, 1), high + 1))


def must_share(grams: list[str], t: float = THRESHOLD) -> list[str]:
    """Bigrams of which a unit that reaches ``t`` has one at least: all but the number it must
    share, less one. The longest are taken, as the least likely to stand elsewhere."""
    return sorted(grams, key=len, reverse=True)[: len(grams) - least_shared(len(grams), t) + 1]


@cache
def full_texts() -> list[tuple[str, str]]:
    """(license, text) of whole licence texts and file headers, in order of their file names."""
    return [(p.name.removesuffix(".header"), p.read_text("utf-8")) for p in sorted((Path(__file__).parent / "licence_texts").iterdir()) if p.is_file()]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = True


def _hashed(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, unit and hash of the bigram that starts there, for every word (the last of a text has none: 0)."""
    data, off = textbuf.buffer(column)
    data = _LOWER[data]
    start, end, doc = textbuf.words(data, off, _IS_WORD)
    word = textbuf.RangeHash(data, 7)(start, end)
    gram = np.zeros(len(word), np.uint64)
    if len(word):
        gram[:-1] = np.where(doc[1:] == doc[:-1], textbuf.mix(word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:]) | np.uint64(1), 0)
    ends = data == 0x0A
    ends[:-1] |= np.isin(data[:-1], [0x2E, 0x21, 0x3F]) & np.isin(data[1:], [0x20, 0x09])
    before = np.concatenate([[0], np.cumsum(ends)])
    return doc, before[start] - before[off[doc]], gram


def best_passages(unit: np.ndarray, gram: np.ndarray, template: np.ndarray, t: float) -> list[tuple[int, int, float]]:
    """(first unit, last unit, coefficient) of the passages of one text that reach ``t``: of
    those that overlap the best, then the shortest."""
    n, high = len(gram), size_range(len(template), t)[1]
    shared = np.isin(gram, template)
    order = np.argsort(gram, kind="stable")
    same = gram[order[1:]] == gram[order[:-1]]
    previous, following = np.full(n, -1), np.full(n, n)
    previous[order[1:][same]], following[order[:-1][same]] = order[:-1][same], order[1:][same]
    found = []
    for s in np.unique(unit[shared]):
        first, stop = np.searchsorted(unit, [s, s + 1])
        here = np.arange(first, stop)[shared[first:stop]]
        # beyond, the next unit has all that this one shares, and starts no worse a passage
        limit = min(n - 1, int(following[here].max()))
        length = 2 * high + 64
        while True:
            last = min(first + length, limit + 1, n)
            fresh = (previous[first:last] < first) & (gram[first:last] > 0)
            size = np.cumsum(fresh)
            if last == min(limit + 1, n) or size[-1] > high:
                break
            length *= 2
        both = np.cumsum(fresh & shared[first:last])
        # a passage ends before a word of another unit; the bigram across is not in it
        final = np.flatnonzero(np.append(unit[first + 1 : last] != unit[first : last - 1], last == n or unit[last] != unit[last - 1]))
        final = final[final > 0]
        if len(final):
            dice = 2.0 * both[final - 1] / (size[final - 1] + len(template))
            k = int(np.argmax(dice))
            if dice[k] >= t - 1e-9:
                found.append((int(s), int(unit[first + final[k]]), float(dice[k])))
    kept = []
    for s, e, d in sorted(found, key=lambda x: (-x[2], x[1] - x[0], x[0])):
        if all(e < a or s > b for a, b, _ in kept):
            kept.append((s, e, d))
    return sorted(kept)


def _passages(grams: list[list[str]], n_short: int, t: float):
    """Rows of passages; the first ``n_short`` templates have their single units elsewhere."""
    hashes = [np.unique(_hashed(pa.array([f"{g}" for g in b], pa.large_string()))[2]) for b in grams]
    hashes = [h[h > 0] for h in hashes]
    least = np.array([least_shared(len(h), t) for h in hashes])
    keys = np.unique(np.concatenate(hashes))
    holder = np.zeros((len(keys), len(hashes)), bool)
    for i, h in enumerate(hashes):
        holder[np.searchsorted(keys, h), i] = True

    def run(batches):
        for whole in batches:
            for batch in textbuf.slices(whole, "text"):
                doc, unit, gram = _hashed(batch.column("text"))
                place = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
                at = np.flatnonzero(keys[place] == gram)
                pairs = np.unique(doc[at] * len(keys) + place[at])
                of, key = pairs // len(keys), pairs % len(keys)
                edges = np.searchsorted(doc, np.arange(batch.num_rows + 1))
                ends = np.searchsorted(of, np.arange(batch.num_rows + 1))
                rows = []
                for i in np.flatnonzero(np.diff(ends) >= least.min()):
                    for k in np.flatnonzero(holder[key[ends[i] : ends[i + 1]]].sum(axis=0) >= least):
                        here = slice(edges[i], edges[i + 1])
                        rows += [(i, s, k, d) for s, e, d in best_passages(unit[here], gram[here], hashes[k], t) if k >= n_short or e > s]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64())), *[pa.array([r[j] for r in rows], pa.int64()) for j in (1, 2)], pa.array([round(r[3], 6) for r in rows], pa.float64())],
                    ["doc_id", "unit", "template", "dice"])

    return run


def _normal(text: Column) -> Column:
    """Units on lines of their own: lines and their sentences, in words apart by one space."""
    ends = F.regexp_replace(F.lower(text), "([.!?])[ \t]+", "$1\n")
    return F.regexp_replace(ends, "[^a-z0-9\n]+", " ")


def find_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, texts=None) -> DataFrame:
    """(doc_id, unit, template, license, dice): units number the text's units from 0; the numbers
    of the whole ``texts`` follow those of the ``templates``."""
    every = [*templates, *(full_texts() if texts is None else texts)]
    run = _passages([bigrams(text) for _, text in every], len(templates), threshold)
    long = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, unit long, template long, dice double")
    long = long.select("doc_id", "unit", "template", F.get(F.array(*[F.lit(name) for name, _ in every]), F.col("template").cast("int")).alias("license"), "dice")
    return _notices(docs, templates, threshold).unionAll(long)


def _notices(docs: DataFrame, templates, threshold: float) -> DataFrame:
    """Rows of single units that fit short templates."""
    known = [(i, name, bigrams(text)) for i, (name, text) in enumerate(templates)]
    ranges = [(*size_range(len(b), threshold), i) for i, _, b in known]
    fewest, most = min(r[0] for r in ranges), max(r[1] for r in ranges)
    hints = sorted({g for _, _, b in known for g in must_share(b, threshold)})
    hint = f"(?:^|[ \n])(?:{'|'.join(hints)})(?![a-z0-9])"
    normal = _normal(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", "text").where(normal.rlike(hint))
    rows = rows.select("doc_id", F.posexplode(F.split(normal, "\n")).alias("unit", "said"))
    rows = rows.where(F.col("said").rlike(hint)).withColumn("said", F.trim("said"))
    words = F.length("said") - F.length(F.replace("said", F.lit(" "), F.lit(""))) + 1
    # distinct bigrams are at most the words less one; repeats leave fewer, so only the lower bound prunes here
    rows = rows.where((F.col("said") != "") & (words > fewest - 1 + F.when(words > 1, 1).otherwise(0)))
    first = F.array(*[F.lit(b) for b in sorted({b for _, _, g in known for b in g})])
    rows = rows.withColumn("words", F.split("said", " "))
    pairs = F.expr("CASE WHEN size(words) = 1 THEN words ELSE array_distinct(transform(sequence(1, size(words) - 1), i -> concat(words[i - 1], ' ', words[i]))) END")
    rows = rows.withColumn("bigrams", pairs).where(F.size("bigrams").between(fewest, most)).withColumn("known", F.array_intersect("bigrams", first)).where(F.size("known") > 0)
    hits = []
    for (low, high, i), (_, name, grams) in zip(ranges, known, strict=True):
        both = F.size(F.array_intersect("known", F.array(*[F.lit(g) for g in grams])))
        dice = 2.0 * both / (F.size("bigrams") + len(grams))
        hits.append(F.when(F.size("bigrams").between(low, high) & (dice >= threshold - 1e-9), F.struct(F.lit(i).alias("template"), F.lit(name).alias("license"), F.round(dice, 6).alias("dice"))))
    hit = F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("hit")
    return rows.select("doc_id", F.col("unit").cast("long").alias("unit"), hit).select("doc_id", "unit", F.col("hit.template").cast("long").alias("template"), "hit.license", "hit.dice")
