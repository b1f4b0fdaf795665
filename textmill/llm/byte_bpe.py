"""Byte-level BPE by corpus-level merge replay.

A task reads its share of the corpus in batches. The distinct pieces of a batch that the worker
has not met yet (pieces are the matches of the tokenizer's pattern) form the word list of
a merge replay: an inverted index leads from each adjacent token pair to the positions
where it stands, over all words at once. Merges are applied in rank order, each to all
its positions, and only the pairs of touched neighbours are entered anew. Every piece
is so encoded once for the worker, and texts are read off the encoded pieces.

Pieces and their ids are kept for later batches, up to CACHE_BYTES, after which three quarters
stay, those met first, but for very long ones; results do not depend on it. Very long texts are split by a scanner
that never holds all matches. Decoding goes from the ids back to bytes: in ``decode`` for all ids, in
``encode_digests`` once for each distinct piece, which must come back as it was, so that a text's
decoded bytes are those of its pieces in order.

Nulls: a null text counts as empty and has no ids. Repeated rows are encoded alike. Other
columns are ignored.
"""

import base64
import hashlib
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import textbuf

#: A worker's cache holds so many bytes; a piece costs its own characters, those of its ids and PIECE_BYTES for the objects.
CACHE_BYTES, PIECE_BYTES, LONG_TEXT, SCAN = 256 << 20, 200, 1 << 20, 1 << 16
#: Fixed value: the characters of Unicode's White_Space property. The regex package's own
#: class also has the separators 0x1C to 0x1F, which tiktoken's has not.
WHITE_SPACE = "\t-\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def compiled(pattern: str) -> regex.Pattern:
    """``pattern`` with tiktoken's meaning of white space."""
    pattern = pattern.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\S", f"[^{WHITE_SPACE}]").replace(r"\s", f"[{WHITE_SPACE}]")
    return regex.compile(pattern)


class Pairs:
    """Which pairs of adjacent tokens a rank file merges. A token's number is its rank plus one; bytes that the
    file lacks have numbers beyond these, and ``END`` stands after each word."""

    END = 0

    def __init__(self, ranks: dict[bytes, int]):
        beyond = max(ranks.values(), default=0) + 1
        self.bytes = np.array([ranks.get(bytes([b]), beyond + b) + 1 for b in range(256)], np.int32)
        number = {bytes([b]): int(n) for b, n in enumerate(self.bytes)} | {token: rank + 1 for token, rank in ranks.items()}
        self.width = beyond + 258
        self.numbers = list(range(self.width))  # one object for each number, however often it stands
        self.merged: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                if (left := number.get(token[:cut])) is not None and (right := number.get(token[cut:])) is not None:
                    self.merged[left * self.width + right] = rank + 1
        self.of_bytes = np.zeros(1 << 16, np.int32)
        for left, one in enumerate(self.bytes.tolist()):
            for right, two in enumerate(self.bytes.tolist()):
                self.of_bytes[left << 8 | right] = self.merged.get(one * self.width + two, 0)


def replay(words: list[bytes], pairs: Pairs) -> list[list[int]]:
    """Ids of each word, by replaying all merges over all words together.

    Tokens of all words lie in one array with links to their neighbours; ``merges`` has the token that a
    position's pair makes (0: none), and ``places`` is the inverted index from that token to the positions."""
    if not words:
        return []
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    begins = np.cumsum(sizes + 1) - sizes - 1
    data = np.frombuffer(b"".join(words), np.uint8)
    at_byte = np.arange(len(data)) + np.repeat(np.arange(len(words)), sizes)
    numbers = np.full(len(data) + len(words), Pairs.END, np.int32)
    numbers[at_byte] = pairs.bytes[data]
    made = np.zeros(len(numbers), np.int32)
    inside = np.flatnonzero(np.diff(at_byte) == 1)
    made[at_byte[inside]] = pairs.of_bytes[data[inside].astype(np.uint16) << 8 | data[inside + 1]]
    filled = np.flatnonzero(made)
    filled = filled[np.argsort(made[filled], kind="stable")]
    heap, starts = map(np.ndarray.tolist, np.unique(made[filled], return_index=True))  # sorted, so a heap
    spots = filled.tolist()
    places = {token: spots[a:b] for token, a, b in zip(heap, starts, [*starts, len(spots)][1:], strict=True)}
    tokens, merges = (list(map(pairs.numbers.__getitem__, memoryview(x))) for x in (numbers, made))
    del data, at_byte, numbers, made, inside, filled, spots
    right, left = list(range(1, len(tokens) + 1)), list(range(-1, len(tokens) - 1))
    width, merged = pairs.width, pairs.merged.get

    while heap:
        token = heappop(heap)
        for at in sorted(places.pop(token)):  # leftmost first
            if merges[at] != token:
                continue  # an earlier merge touched it
            after = right[at]
            beyond = right[at] = right[after]
            tokens[at], merges[after], left[beyond] = token, 0, at
            merges[at] = found = merged(token * width + tokens[beyond], 0)
            if found:
                if found in places:
                    places[found].append(at)
                else:
                    places[found] = [at]
                    heappush(heap, found)
            before = left[at]
            if before >= 0 and tokens[before]:
                merges[before] = found = merged(tokens[before] * width + token, 0)
                if found:
                    if found in places:
                        places[found].append(before)
                    else:
                        places[found] = [before]
                        heappush(heap, found)
    out = []
    for at in begins.tolist():
        ids = []
        while token := tokens[at]:
            ids.append(token - 1)
            at = right[at]
        out.append(ids)
    return out


class Encoder:
    """Pieces of texts and their encodings."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, compiled(pattern)
        self.token = {rank: token for token, rank in ranks.items()}
        self.pairs = Pairs(ranks)
        self.known: dict[str, str] = {}
        self.held = 0  # what the known pieces cost

    def pieces(self, text: str):
        """The text's pieces, in lists; a long text in several."""
        if len(text) <= LONG_TEXT:
            yield self.pattern.findall(text)
            return
        found = self.pattern.finditer(text)
        while part := [m[0] for m in islice(found, SCAN)]:
            yield part

    def forget(self, pieces: set[str]) -> None:
        """Keep what was met first, which is mostly the frequent pieces, up to three quarters of CACHE_BYTES, and
        ``pieces``. Other pieces that would take much of the cache by themselves go: if they stayed, it could stay over its bound
        and be emptied for each batch."""
        kept, held = {}, 0
        for p, said in self.known.items():
            cost = PIECE_BYTES + len(p) + len(said)
            if p in pieces or cost * 1000 <= CACHE_BYTES and (held + cost) * 4 <= CACHE_BYTES * 3:
                kept[p] = said
                held += cost
        self.known, self.held = kept, held

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces that are not known yet, as their ids in text. Ids are decoded here, once for
        each piece, and must give the piece back."""
        if self.held > CACHE_BYTES:
            self.forget(pieces)
        ranks, known = self.ranks, self.known
        new = [p for p in pieces if p not in known]
        raw = [p.encode() for p in new]
        rest = [i for i, b in enumerate(raw) if b not in ranks]
        ids = [[ranks[b]] if b in ranks else None for b in raw]
        for i, found in zip(rest, replay([raw[i] for i in rest], self.pairs), strict=True):
            ids[i] = found
        for p, b, found in zip(new, raw, ids, strict=True):
            if b"".join(map(self.token.__getitem__, found)) != b:
                raise ValueError("the ranks do not decode to what they encode")
            said = known[p] = ",".join(map(str, found))
            self.held += PIECE_BYTES + len(p) + len(said)

    def encode(self, text: str):
        """(ids as text, decoded text) of the text's pieces, in lists, in order."""
        for part in self.pieces(text):
            self.learn(set(part))
            yield list(map(self.known.__getitem__, part)), "".join(part)


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder_of(ranks_path: str, pattern: str) -> Encoder:
    """The encoder that a worker keeps from task to task."""
    if (ranks_path, pattern) not in _encoders:
        _encoders[ranks_path, pattern] = Encoder(load_ranks(ranks_path), pattern)
    return _encoders[ranks_path, pattern]


def _digests(ranks_path: str, pattern: str, text_column: str):
    def run(batches):
        encoder = encoder_of(ranks_path, pattern)
        for whole in batches:
            for batch in textbuf.slices(whole, text_column):
                # a long text may start the cache anew, so each is encoded after the short ones
                texts = [t or "" for t in batch.column(text_column).to_pylist()]
                short = [encoder.pattern.findall(t) if len(t) <= LONG_TEXT else None for t in texts]
                encoder.learn(set().union(*(p for p in short if p is not None)))
                known = encoder.known
                counts, ids_sums, text_sums = [0] * len(texts), [""] * len(texts), [""] * len(texts)
                for long in (False, True):
                    for i, (text, pieces) in enumerate(zip(texts, short, strict=True)):
                        if (pieces is None) != long:
                            continue
                        n, ids, raw, comma = 0, hashlib.sha256(), hashlib.sha256(), ""
                        for said, data in encoder.encode(text) if long else [([known[p] for p in pieces], "".join(pieces))] if pieces else ():
                            joined = ",".join(said)
                            n += joined.count(",") + 1
                            ids.update((comma + joined).encode())
                            raw.update(data.encode())
                            comma = ","
                        counts[i], ids_sums[i], text_sums[i] = n, ids.hexdigest(), raw.hexdigest()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sums), pa.array(text_sums)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(ranks_path: str, pattern: str):
    def run(batches):
        encoder = encoder_of(ranks_path, pattern)
        for whole in batches:
            for batch in textbuf.slices(whole, "text"):
                ids = []
                for text in batch.column("text").to_pylist():
                    ids.append([int(i) for said, _ in encoder.encode(text or "") for x in said for i in x.split(",")])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def _texts(ranks_path: str):
    def run(batches):
        token = {rank: t for t, rank in load_ranks(ranks_path).items()}
        for batch in batches:
            texts = [b"".join(token[i] for i in ids or []).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) for every row of ``docs``."""
    return docs.select("doc_id", "text").mapInArrow(_ids(ranks_path, pattern), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    return encoded.select("doc_id", "ids").mapInArrow(_texts(ranks_path), "doc_id long, text string")


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) without moving ids."""
    return docs.select("doc_id", "text").mapInArrow(_digests(ranks_path, pattern, "text"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
