"""Benchmark decontamination: a BM25 index of the test items, searched with block-max WAND.

The index holds, for each term and item, the BM25 impact divided by the item's score
with its own text, so one threshold (``score``, a share of that self score) serves all items.
Items are dealt into blocks in order of their ids and texts; for each term the index keeps its
highest impact in each block that holds it, and from each such block on.

Every document is read whole, as passages of two neighbouring tiles. A tile is as long as the longest
item that an index may hold: items of up to TILE words have one index, those of up to 8 * TILE
another, and so on, so one long item makes no passage of others longer. Each item that a document
holds lies in one passage. Each passage is a query of distinct terms, and all passages of a slice are
searched at once, each with its own pointers into the lists of blocks: lists are ordered by
the block that they stand at, the pivot is the first block at which the sum of the lists' highest impacts
from there on reaches the threshold, lists before it skip to it, and its items are scored only if
the sum of the blocks' own highest impacts reaches the threshold too; a passage ends where there is no pivot.

All retrieved pairs are then verified on words: an item's text is split into a question (its first
half) and an answer (its second), and both must overlap: at least ``overlap`` of the five-word
shingles of each half lie in the passage, or of those of the whole item (across its middle too) with
at least ``floor`` of each half's, so that an altered word in a short half does not hide an item.

An index is broadcast in parts of about MAX_INDEX_ITEMS items or MAX_INDEX_BYTES of text at most, with
one pass over the documents for each part, so its size is bounded for any benchmark. Document
frequencies and the mean length are those of all items, so scores do not depend on the parts.

Terms are runs of letters and digits, with case folded in the same way for search and verification
(``str.casefold``, any alphabet; 64-bit hashes in the search).
Nulls: null documents or items hold no words and match nothing; items of fewer than
five words are verified as one shingle per half. A null item_id is carried as it is. Repeated
documents and items give a row each; items with the same id and text give one. Other columns of the
documents are ignored, and kept by ``without_contaminated``. Without items nothing is found.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf
from .common import materialise, set_apart

SCORE, OVERLAP, FLOOR, SHINGLE = 0.5, 0.8, 0.3, 5
BLOCK_ITEMS, TILE, MAX_INDEX_ITEMS, MAX_INDEX_BYTES = 8, 64, 20_000, 32 << 20
K1, B = 1.2, 0.75
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_WORD = regex.compile(r"[a-z0-9\u0080-\U0010FFFF]+")


def _terms(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number, start and end of each word, and the folded bytes that these point into."""
    data, off = textbuf.buffer(pa.array([(t or "").casefold() for t in column.to_pylist()], pa.large_string()))
    start, end, doc = textbuf.words(data, off, _IS_WORD)
    return textbuf.RangeHash(data, 3)(start, end), doc, start, end, data


def plain_words(text: str) -> list[str]:
    return _WORD.findall(text.casefold())


def _shingles(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


@dataclass
class Statistics:
    """Of all items: their number and mean length, and the document frequency of each of some sorted terms."""

    n: int
    mean: float
    terms: np.ndarray
    df: np.ndarray


@dataclass
class Index:
    """Impacts by term (rows are sorted term hashes) in compressed rows over items and over blocks of items."""

    terms: np.ndarray
    items: np.ndarray
    impacts: np.ndarray
    block_starts: np.ndarray  # of each term, in the entries of blocks that hold it
    blocks: np.ndarray
    block_max: np.ndarray
    block_at: np.ndarray  # of each entry, and at the end: where its items start
    rest_max: np.ndarray  # the term's highest impact from each entry on
    entry_row: np.ndarray  # each entry's term
    n_items: int
    tile: int
    halves: list[tuple[set, set, set]]  # the question's shingles, the answer's and the whole item's
    ids: list


def statistics(texts: list[str]) -> Statistics:
    term, item, _, _, _ = _terms(pa.array(texts, pa.large_string()))
    pairs = np.unique(np.stack([term, item.astype(np.uint64)]), axis=1)
    terms, df = np.unique(pairs[0], return_counts=True)
    return Statistics(len(texts), max(1.0, len(term) / max(1, len(texts))), terms, df)


def build(texts: list[str], ids: list, every: Statistics, tile: int) -> Index:
    """The index of some items' texts, none of them of more than ``tile`` words."""
    term, item, _, _, _ = _terms(pa.array(texts, pa.large_string()))
    lengths = np.bincount(item, minlength=len(texts))
    pairs, tf = np.unique(np.stack([term, item.astype(np.uint64)]), axis=1, return_counts=True)
    terms, row = np.unique(pairs[0], return_inverse=True)
    item = pairs[1].astype(np.int64)
    df = every.df[np.searchsorted(every.terms, terms)] if len(terms) else np.zeros(0)
    idf = np.log(1 + (every.n - df + 0.5) / (df + 0.5))
    weight = idf[row] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / every.mean))
    impact = weight / np.bincount(item, weight, minlength=len(texts))[item]
    block = item // BLOCK_ITEMS
    new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (block[1:] != block[:-1]))) if len(row) else np.zeros(0, np.int64)
    block_max = np.maximum.reduceat(impact, new) if len(new) else np.zeros(0)
    block_starts = np.searchsorted(row[new], np.arange(len(terms) + 1))
    # terms are far apart on an axis on which the maximum runs from the end, so none reaches into another
    entry_row = row[new]
    rest_max = np.maximum.accumulate((block_max - 2.0 * entry_row)[::-1])[::-1] + 2.0 * entry_row
    halves = []
    for t in texts:
        w = plain_words(t)
        halves.append((_shingles(w[: -(-len(w) // 2)]), _shingles(w[-(-len(w) // 2) :]), _shingles(w)))
    return Index(terms, item, impact, block_starts, block[new], block_max, np.append(new, len(row)), rest_max, entry_row, len(texts), tile, halves, ids)


def indexes(rows: list[tuple], every: Statistics) -> list[Index]:
    """Indexes of (item_id, text) rows, one for each class of lengths."""
    classes: dict[int, list[tuple]] = {}
    for i, text in rows:
        tile, n = TILE, len(plain_words(text))
        while tile < n:
            tile *= 8
        classes.setdefault(tile, []).append((i, text))
    return [build([t for _, t in part], [i for i, _ in part], every, tile) for tile, part in sorted(classes.items())]


def passages(doc: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end word of each passage, and each word's tile; passage i begins with tile i. A tile that
    ends a text begins a passage only if the text has no other: it lies in the one before."""
    count = np.bincount(doc)
    first = np.cumsum(count) - count
    starts = (np.arange(len(doc)) - first[doc]) % tile == 0
    begin = np.flatnonzero(starts)
    ends = np.append(begin[1:], len(doc))
    owner = doc[begin]
    follows = np.append(owner[1:] == owner[:-1], False)
    end = ends.copy()
    end[follows] = ends[np.flatnonzero(follows) + 1]
    end[np.append(False, owner[1:] == owner[:-1]) & ~follows] = 0
    return begin, end, np.cumsum(starts) - 1


def search(index: Index, term: np.ndarray, doc: np.ndarray, least: float) -> list[tuple[int, int, int, float]]:
    """(first word, end word, item, score) for all pairs of a passage and an item at or above
    ``least``; term: each word's hash, doc: the text it is in."""
    n_terms = len(index.terms)
    if not len(term) or not n_terms:
        return []
    begin, end, tile = passages(doc, index.tile)
    row = np.minimum(np.searchsorted(index.terms, term), n_terms - 1)
    known = np.flatnonzero(index.terms[row] == term)
    # a word is in the passage of its tile and in that of the tile before
    at = tile[known]
    before = known[(at > 0) & (doc[begin[at - 1]] == doc[known])]
    keys = np.sort(np.concatenate([at * n_terms + row[known], (tile[before] - 1) * n_terms + row[before]]))
    keys = keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]
    owner, row = np.divmod(keys, n_terms)
    live = end[owner] > 0
    owner, row = owner[live], row[live]
    pointer, last = index.block_starts[row], index.block_starts[row + 1]
    n_blocks = -(-index.n_items // BLOCK_ITEMS)
    place = index.entry_row * n_blocks + index.blocks
    bits = np.int64(max(1, len(row)).bit_length())
    alive = np.arange(len(row))
    floor, found = least - 1e-6, []
    pivot = np.empty(len(begin), np.int64)
    while len(alive):
        # the lists of each passage in the order of the blocks that they stand at
        block = index.blocks[pointer[alive]]
        key = np.sort(((owner[alive] * n_blocks + block) << bits) | alive)
        alive = key & ((np.int64(1) << bits) - 1)
        key >>= bits
        of = owner[alive]
        most = index.rest_max[pointer[alive]]
        total = np.cumsum(most)
        new = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        total -= np.repeat(total[new] - most[new], np.diff(np.append(new, len(of))))
        # the pivot of each passage; passages without one are through
        reached = np.flatnonzero(total >= floor)
        first = reached[np.append(True, of[reached[1:]] != of[reached[:-1]])[: len(reached)]]
        pivot.fill(-1)
        pivot[of[first]] = key[first] - of[first] * n_blocks
        target = pivot[of]
        live = target >= 0
        alive, of, target, key = alive[live], of[live], target[live], key[live]
        at = pointer[alive]
        behind = np.flatnonzero(key < of * n_blocks + target)
        at[behind] = np.searchsorted(place, row[alive[behind]] * n_blocks + target[behind])
        there = np.flatnonzero(at < last[alive])
        there = there[index.blocks[at[there]] == target[there]]
        bound = np.bincount(of[there], index.block_max[at[there]], len(begin))
        opened = there[bound[of[there]] >= floor]
        if len(opened):
            entry = at[opened]
            length = index.block_at[entry + 1] - index.block_at[entry]
            entries = np.repeat(index.block_at[entry] - np.cumsum(length) + length, length) + np.arange(length.sum())
            pair, which = np.unique(np.repeat(of[opened], length) * index.n_items + index.items[entries], return_inverse=True)
            score = np.bincount(which, index.impacts[entries])
            for k in np.flatnonzero(score >= least - 1e-9):
                passage, item = divmod(int(pair[k]), index.n_items)
                found.append((int(begin[passage]), int(end[passage]), item, float(score[k])))
        at[there] += 1
        pointer[alive] = at
        alive = alive[at < last[alive]]
    return found


def verified(halves: tuple[set, set, set], words: list[str], overlap: float, floor: float) -> tuple[float, float] | None:
    """The shares of question and answer that the words hold, if the item is held."""
    have = _shingles(words)
    # a half of under five words is sought as a run of words
    joined = " " + " ".join(words) + " "
    share = [len(h & have) / len(h) if h and len(next(iter(h))) == SHINGLE else float(bool(h) and " " + " ".join(next(iter(h))) + " " in joined) for h in halves[:2]]
    if not halves[1]:
        share[1] = share[0]
    every = halves[2]
    if min(share) >= overlap - 1e-9 or (min(share) >= floor - 1e-9 and len(every & have) >= overlap * len(every) - 1e-9):
        return share[0], share[1]
    return None


def _held(every: list[Index], column, least: float, overlap: float, floor: float) -> list[tuple]:
    """(text number, item_id, score, question's share, answer's share), the best for each item of a text."""
    term, doc, start, end, data = _terms(column)
    out = []
    for index in every:
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for a, b, item, score in search(index, term, doc, least):
            words = _WORD.findall(data[start[a] : end[b - 1]].tobytes().decode("utf-8", "ignore"))
            if (share := verified(index.halves[item], words, overlap, floor)) is not None:
                at = (int(doc[a]), item)
                best[at] = max(best.get(at, (0.0, 0.0, 0.0)), (score, *share))
        out += [(i, index.ids[item], *found) for (i, item), found in sorted(best.items())]
    return out


def _matches(every, *limits: float):
    def run(batches):
        for whole in batches:
            for batch in textbuf.slices(whole, "text"):
                rows = _held(every.value, batch.column("text"), *limits)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int64()), *[pa.array([round(r[j], 6) for r in rows], pa.float64()) for j in (2, 3, 4)]],
                    ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return run


def _clean(every, *limits: float):
    def run(batches):
        for whole in batches:
            for batch in textbuf.slices(whole, "text"):
                keep = np.ones(batch.num_rows, bool)
                keep[[r[0] for r in _held(every.value, batch.column("text"), *limits)]] = False
                yield batch.filter(pa.array(keep))

    return run


def _df_of(batches):
    """A row for each item's number of words and for each of its distinct terms."""
    for batch in batches:
        term, item, _, _, _ = _terms(batch.column("text"))
        pairs = np.unique(np.stack([term, item.astype(np.uint64)]), axis=1)
        at = pa.array(pairs[1].astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("part").take(at), pa.array(pairs[0].view(np.int64))], ["part", "term"])


def _parts(items: DataFrame):
    """Broadcasts of lists of indexes that hold all items between them; the driver holds one at a time."""
    spark = items.sparkSession
    texts = items.select("item_id", "text").where("text is not null").distinct()
    n, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    count = max(1, -(-n // MAX_INDEX_ITEMS), -(-size // MAX_INDEX_BYTES))
    in_order = lambda rows: sorted(((r["item_id"], r["text"]) for r in rows), key=lambda r: (r[0] is None, r[0], r[1]))
    if count == 1:
        rows = in_order(texts.collect())
        yield spark.sparkContext.broadcast(indexes(rows, statistics([t for _, t in rows])))
        return
    texts = materialise(texts.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)).cast("int")))
    terms = materialise(texts.select("part", "text").mapInArrow(_df_of, "part int, term long"))
    df = materialise(terms.groupBy("term").agg(F.count("*").alias("df")))
    words = texts.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([len(_terms(b.column("text"))[0])])], ["n"]) for b in batches), "n long").agg(F.sum("n")).first()[0] or 0
    for part in range(count):
        rows = in_order(texts.where(F.col("part") == part).collect())
        own = terms.where(F.col("part") == part).select("term").distinct().join(df, "term").toPandas()
        term = own["term"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(term)
        yield spark.sparkContext.broadcast(indexes(rows, Statistics(n, max(1.0, words / n), term[order], own["df"].to_numpy(np.int64)[order])))


def contaminated(docs: DataFrame, items: DataFrame, score: float = SCORE, overlap: float = OVERLAP, floor: float = FLOOR) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) for each document that holds an item."""
    out = None
    for part in _parts(items):
        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_matches(part, score, overlap, floor), "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
        out = found if out is None else out.unionAll(found)
    return out


def without_contaminated(docs: DataFrame, items: DataFrame, score: float = SCORE, overlap: float = OVERLAP, floor: float = FLOOR) -> DataFrame:
    """The rows of ``docs`` that hold no item. Rows stay where they are: each part of the index filters them."""
    docs, restored = set_apart(docs, "text")
    for part in _parts(items):
        docs = docs.mapInArrow(_clean(part, score, overlap, floor), docs.schema)
    return restored(docs)
