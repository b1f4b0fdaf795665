"""Removal of repeated byte strings by difference-cover sampling.

A byte goes if it is covered by a string of LENGTH bytes that also starts anywhere else,
in the same document or another; strings never cross documents. Suffixes only need
to be told apart up to LENGTH bytes, so the sort is bounded to that depth:

1. Sample. A difference cover D modulo PERIOD has, for any two positions i and j, a
   shift d < PERIOD with i + d and j + d both in the cover. So if two strings of LENGTH
   bytes are equal, then so are the strings of LENGTH - PERIOD + 1 bytes at two sampled
   positions inside them. Sampled prefixes (12 of 133 positions) are named by hashes, dealt
   to buckets by name, sorted there, and names with equal neighbours are repeated. Equal
   whole texts are found in the same way.
2. Merge the remaining suffixes. Only positions with a repeated sampled prefix within
   PERIOD can start a repeated string; they get the name of their whole LENGTH bytes (56
   bits and the bucket of an independent hash), are dealt, sorted and compared likewise.
   Of equal texts one block sends the names, as repeated; all of them lose all bytes.
3. Each block of documents removes what its repeated names cover.

Names move as packed arrays, one row per block and bucket, each name at most once per
block however often it occurs, so a passage that all documents share costs a block
a few bytes. Replies are one bit per name: a block sorts its names in the same way again.
Texts are dealt once, to blocks of about BLOCK_BYTES by a hash of id and text; the plan
reuses that exchange in all three steps.

The recursion of the classic algorithm on triples is not needed at this depth: two
rounds of names tell LENGTH bytes apart; README gives the figures that rule it out.

Names are made segment by segment, so a worker's memory beyond the block itself grows with its
repeated positions alone. A text is never cut, so one longer than BLOCK_BYTES makes its block larger.

Nulls: a null text is an empty one. Texts shorter than LENGTH lose nothing. Repeated rows
repeat each other's strings, so all their bytes go. Other columns pass through, but for those named
like a result, which the result replaces. Blocks and tables without long texts, or without repeats, are whole.
"""

import hashlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf
from .common import set_apart, shuffle_partitions

LENGTH, PERIOD = 200, 133
#: A perfect difference set modulo 133.
COVER = (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)
BLOCK_BYTES, BUCKET_BYTES, SEGMENT = 2 << 20, 8 << 20, 1 << 20
RESULTS = ("n_bytes", "n_removed", "n_spans", "kept")


def is_cover(cover: tuple[int, ...], period: int) -> bool:
    """Whether each residue is a difference of two members."""
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


class Block:
    """Texts of one block as bytes, with the steps' arrays."""

    def __init__(self, column, length: int = LENGTH):
        self.data, self.off = textbuf.buffer(column)
        self.length = length
        self.period = PERIOD if length > PERIOD else 1
        self.sizes = np.diff(self.off)

    def _open(self, width: int) -> np.ndarray:
        """Positions from which ``width`` bytes of the same text follow."""
        inside = np.zeros(len(self.data) + 1, np.int32)
        has = self.sizes >= width
        np.add.at(inside, self.off[:-1][has], 1)
        np.add.at(inside, self.off[1:][has] - width + 1, -1)
        return np.cumsum(inside[:-1], dtype=np.int32) > 0

    def _named(self, at: np.ndarray, width: int, seed: int = 7) -> np.ndarray:
        """Hashes of the ``width`` bytes from each position; ``at`` is sorted."""
        out = np.empty(len(at), np.uint64)
        edges = np.searchsorted(at, np.arange(0, len(self.data) + SEGMENT, SEGMENT))
        for i, (a, b) in enumerate(pairwise(edges)):
            if a < b:
                start = at[a:b] - i * SEGMENT
                out[a:b] = textbuf.RangeHash(self.data[i * SEGMENT : (i + 1) * SEGMENT + width], seed)(start, start + width)
        return out

    def sampled(self) -> tuple[np.ndarray, np.ndarray]:
        """Sampled positions and the names of their prefixes."""
        width = self.length - self.period + 1
        if self.period == 1:
            at = np.flatnonzero(self._open(width))
        else:
            wanted = np.zeros(self.period, bool)
            wanted[list(COVER)] = True
            kind = np.int32 if len(self.data) < 1 << 31 else np.int64
            rel = np.arange(len(self.data), dtype=kind)
            rel -= np.repeat(self.off[:-1].astype(kind), self.sizes)
            rel %= self.period
            at = np.flatnonzero(wanted[rel] & self._open(width))
        return at, self._named(at, width)

    def candidates(self, hit: np.ndarray) -> np.ndarray:
        """Positions whose LENGTH bytes may be repeated, given the sampled ones that are."""
        flag = np.zeros(len(self.data) + self.period + 1, np.int32)
        flag[hit + 1] = 1
        total = np.cumsum(flag, dtype=np.int32)
        n = len(self.data)
        return np.flatnonzero((total[self.period : n + self.period] > total[:n]) & self._open(self.length))

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and 128-bit names of the texts that are long enough to lose bytes."""
        at = np.flatnonzero(self.sizes >= self.length)
        digests = [hashlib.blake2b(self.data[a:b], digest_size=16).digest() for a, b in zip(self.off[:-1][at], self.off[1:][at], strict=True)]
        return at, np.frombuffer(b"".join(digests), np.uint64).reshape(len(at), 2)

    def removed(self, at: np.ndarray) -> np.ndarray:
        """The bytes covered by strings that start at ``at``."""
        edge = np.zeros(len(self.data) + 1, np.int32)
        edge[at] += 1
        edge[at + self.length] -= 1
        return np.cumsum(edge[:-1], dtype=np.int32) > 0


def whole_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """``gone`` with all bytes of the UTF-8 characters that have one gone."""
    character = np.cumsum((data & 0xC0) != 0x80) - 1
    return (np.bincount(character, gone) > 0)[character] if len(data) else gone


class Names:
    """Distinct names of a block in their buckets, in an order that depends on them alone."""

    def __init__(self, name: np.ndarray, bucket: np.ndarray, width: int):
        """name: n x 1 or n x 2 values of ``width`` bytes each; bucket: n numbers."""
        self.width = width
        order = np.argsort(name[:, 0]) if name.shape[1] == 1 else np.lexsort(name.T[::-1])
        near = bucket[order]
        if near.max(initial=0) < 1 << 16:
            near = near.astype(np.uint16)  # stable sorts of so short numbers are by radix
        order = order[np.argsort(near, kind="stable")]
        del near
        name, bucket = name[order], bucket[order]
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]).any(axis=1) | (bucket[1:] != bucket[:-1])
        self.index = np.empty(len(name), np.int64)  # the distinct name of each given one
        self.index[order] = np.cumsum(new) - 1
        start = np.flatnonzero(new)
        self.times = np.diff(np.append(start, len(name)))
        self.name, self.bucket = name[start], bucket[start]
        self.used, first = np.unique(self.bucket, return_index=True)
        self.parts = dict(zip(self.used.tolist(), map(slice, first, np.append(first[1:], len(start))), strict=True))

    def rows(self, block: int, kind: int, many: np.ndarray) -> list[tuple]:
        little = np.ascontiguousarray(self.name.astype("<u8")).view(np.uint8).reshape(*self.name.shape, 8)[:, :, : self.width]
        return [(b, block, kind, 0, little[p].tobytes(), np.packbits(many[p]).tobytes()) for b, p in self.parts.items()]

    def flags(self, replies: dict[int, bytes], nth: int = 0) -> np.ndarray:
        """A bit for each distinct name: the ``nth`` list of bits of its bucket's reply."""
        out = np.zeros(len(self.name), bool)
        for b, p in self.parts.items():
            if b in replies:
                n, size = p.stop - p.start, -(-(p.stop - p.start) // 8)
                out[p] = np.unpackbits(np.frombuffer(replies[b][nth * size : (nth + 1) * size], np.uint8), count=n).astype(bool)
        return out


PACKED, FOUND = "bucket int, block int, kind int, source int, names binary, many binary", "block int, level int, bucket int, kind int, found binary"
SAMPLED, WHOLE, MERGED = range(3)
_WIDTHS = {SAMPLED: (5, 1), WHOLE: (8, 2), MERGED: (7, 1)}  # bytes of a part of a name, parts


def _rows(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({n: pa.array([r[i] for r in rows], kinds[k]) for i, (n, k) in enumerate(fields)})


def _first_names(block: Block, buckets: int) -> tuple[np.ndarray, Names, np.ndarray, Names]:
    at, name = block.sampled()
    texts, whole = block.whole()
    low = name & np.uint64(0xFFFFFF)
    return at, Names((name >> np.uint64(24))[:, None], (low % np.uint64(buckets)).astype(np.int64), 5), texts, Names(whole, (whole[:, 0] % np.uint64(buckets)).astype(np.int64), 8)


def _second_names(block: Block, replies: dict[int, dict[int, bytes]], few: int, many: int) -> tuple[np.ndarray, Names, np.ndarray, np.ndarray]:
    """Positions to name, their names, which distinct names are known to be repeated, and
    which texts are copies."""
    at, sampled, texts, whole = _first_names(block, few)
    found, answers = replies.get(SAMPLED, {}), replies.get(WHOLE, {})
    twice = (whole.times > 1) | whole.flags(answers)
    sends = whole.flags(answers, 1) | (twice & ~whole.flags(answers))
    copy = np.zeros(len(block.sizes), bool)
    copy[texts] = twice[whole.index]
    speaks = np.zeros(len(block.sizes), bool)  # one text of each kind of copies
    first = np.full(len(whole.name), -1)
    first[whole.index[::-1]] = texts[::-1]
    speaks[first[twice & sends]] = True
    marks = np.zeros(len(block.data), bool)
    marks[block.candidates(at[sampled.flags(found)[sampled.index]])] = True
    marks &= ~np.repeat(copy, block.sizes)
    marks |= np.repeat(speaks, block.sizes) & block._open(block.length)
    at = np.flatnonzero(marks)
    name = block._named(at, block.length)
    names = Names((name >> np.uint64(8))[:, None], (block._named(at, block.length, 11) % np.uint64(many)).astype(np.int64), 7)
    known = names.times > 1
    known[names.index[np.repeat(speaks, block.sizes)[at]]] = True
    return at, names, known, copy


def _replies(table: pa.Table, level: int) -> dict[int, dict[int, bytes]]:
    out: dict[int, dict[int, bytes]] = {}
    for r in table.to_pylist():
        if r["level"] == level:
            out.setdefault(r["kind"], {})[r["bucket"]] = r["found"]
    return out


def _repeated(level: int):
    """For each block of a bucket the bits of its names: whether they are repeated and, for whole
    texts, whether the block is the first of those that have it."""

    def run(table: pa.Table) -> pa.Table:
        bucket, block, kind, source = (table.column(c).to_numpy() for c in ("bucket", "block", "kind", "source"))
        if bucket[0] < 0:  # a block's own answers of the first step
            return _rows([(int(b), 1, int(s), int(k), f) for b, s, k, f in zip(block, source, kind, table.column("names").to_pylist(), strict=True)], FOUND)
        out = []
        for k in np.unique(kind).tolist():
            width, parts = _WIDTHS[k]
            rows = np.flatnonzero(kind == k)
            rows = rows[np.argsort(block[rows], kind="stable")]
            raw = [np.frombuffer(table.column("names")[int(i)].as_buffer(), np.uint8).reshape(-1, width) for i in rows]
            sizes = [len(r) // parts for r in raw]
            wide = np.zeros((sum(map(len, raw)), 8), np.uint8)
            wide[:, :width] = np.concatenate(raw)
            name = wide.view("<u8").reshape(-1, parts)
            many = np.concatenate([np.unpackbits(np.frombuffer(table.column("many")[int(i)].as_buffer(), np.uint8), count=n) for i, n in zip(rows, sizes, strict=True)]).astype(bool)
            order = np.lexsort(name.T[::-1]) if parts > 1 else np.argsort(name[:, 0])
            same = (name[order[1:]] == name[order[:-1]]).all(axis=1)
            twice, leads = np.zeros(len(name), bool), np.ones(len(name), bool)
            twice[order[1:]] |= same
            twice[order[:-1]] |= same
            leads[order[1:]] = ~same  # of whole texts: their sort is stable and the rows are in the order of blocks
            twice |= many & (k != WHOLE)
            at = 0
            for i, n in zip(rows, sizes, strict=True):
                part = slice(at, at + n)
                at += n
                if twice[part].any():
                    found = np.packbits(twice[part]).tobytes() + (np.packbits(twice[part] & leads[part]).tobytes() if k == WHOLE else b"")
                    out.append((int(block[i]), level, int(bucket[i]), k, found))
        return _rows(out, FOUND)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, as_text: bool = False) -> DataFrame:
    """The columns of ``docs`` but ``text``, with n_bytes, n_removed, n_spans and ``kept``: the
    remaining bytes, or with ``as_text`` the characters none of whose bytes went (null for null;
    n_removed and n_spans are then of whole characters)."""
    spark = docs.sparkSession
    docs = docs.drop(*RESULTS)
    own = [c for c in ("doc_id", "text") if c in docs.columns]
    docs, restored = set_apart(docs, *own)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(shuffle_partitions(spark), -(-total // BLOCK_BYTES))
    # 12 of 133 positions have a name of 8 bytes; candidates may be as many as the bytes
    few = max(shuffle_partitions(spark), -(-total * 8 // 11 // BUCKET_BYTES))
    many = max(shuffle_partitions(spark), -(-total * 2 // BUCKET_BYTES))
    dealt = docs.withColumn("block", F.pmod(F.xxhash64(*own), F.lit(blocks)).cast("int"))
    texts = dealt.groupBy("block")

    def sampled(table: pa.Table) -> pa.Table:
        number, block = table.column("block")[0].as_py(), Block(table.column("text"), length)
        _, names, _, whole = _first_names(block, few)
        return _rows(names.rows(number, SAMPLED, names.times > 1) + whole.rows(number, WHOLE, whole.times > 1), PACKED)

    def merged(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows([], PACKED)
        number, block = table.column("block")[0].as_py(), Block(table.column("text"), length)
        _, names, known, _ = _second_names(block, _replies(replies, 1), few, many)
        own = [(-1 - number, number, r["kind"], r["bucket"], r["found"], b"") for r in replies.to_pylist()]
        return _rows(names.rows(number, MERGED, known) + own, PACKED)

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        block = Block(table.column("text"), length)
        at, names, known, copy = _second_names(block, _replies(replies, 1), few, many)
        repeated = known | names.flags(_replies(replies, 2).get(MERGED, {}))
        gone = block.removed(at[repeated[names.index]]) | np.repeat(copy, block.sizes)
        counts, spans, kept = [], [], []
        for a, b in zip(block.off[:-1], block.off[1:], strict=True):
            part = gone[a:b]
            if as_text and part.any():
                part = whole_characters(block.data[a:b], part)
            counts.append(int(part.sum()))
            spans.append(int(np.count_nonzero(part[1:] & ~part[:-1]) + (len(part) > 0 and part[0])))
            kept.append((block.data[a:b][~part] if counts[-1] else block.data[a:b]).tobytes())
        if as_text:
            kept = [k.decode("utf-8", "replace") if t.is_valid else None for k, t in zip(kept, table.column("text"), strict=True)]
        out = table.drop_columns(["block", "text"])
        for name, value, kind in (("n_bytes", block.sizes, pa.int64()), ("n_removed", counts, pa.int64()), ("n_spans", spans, pa.int64()), ("kept", kept, pa.string() if as_text else pa.binary())):
            out = out.append_column(name, pa.array(value, kind))
        textbuf.release()
        return out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    first = texts.applyInArrow(sampled, PACKED).groupBy("bucket").applyInArrow(_repeated(1), FOUND)
    second = texts.cogroup(first.groupBy("block")).applyInArrow(merged, PACKED).groupBy("bucket").applyInArrow(_repeated(2), FOUND)
    out = texts.cogroup(second.groupBy("block")).applyInArrow(finish, f"{fields}, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}".removeprefix(", "))
    return restored(out, *RESULTS)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the remaining text and its length; a character goes if any of its bytes
    does. Rows that had text and have none left go."""
    docs, restored = set_apart(docs, "doc_id", "text", "n_chars")
    out = remove_repeats(docs, length, as_text=True).withColumnRenamed("kept", "text")
    out = out.where((F.col("n_removed") == 0) | (F.length("text") > 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return restored(out)
