"""Near-duplicate classes by ProbMinHash, banding and exact verification.

Every text becomes a multiset of five-word shingles (words are runs without white
space; a text of fewer words is one shingle, one without words has none). Shingle
counts are the weights. The similarity is the probability Jaccard index

    J(x, y) = sum over shared i of 1 / sum over j of max(x_j / x_i, y_j / y_i),

which is the plain Jaccard index where no shingle repeats. Signatures come from
Poisson arrivals: shingle i with weight w sends points at the times of a process
of rate w, each to a random register; a register keeps the shingle whose point came
first; a shingle stops once its next point comes after every register of its text
was reached. Equal registers estimate J. Registers are banded; texts that share a
band are verified on all their shingles; classes are the components of the links.

Steps and what they move:

* equal texts are one node, so copies cost one row each. A node is named by a 64-bit hash of its text;
  where a second hash shows that texts share a name, they get names from both;
* in each bucket every member is compared to one pivot, which merges most of a
  group of any size with a linear number of pairs;
* the rest is exact: in buckets whose members then still belong to different components, the
  members outside the bucket's largest component are compared with all that are in another component
  than theirs. Pairs whose registers put them more than ``slack`` (four and a half) standard deviations
  below the threshold are left out, about 3 of a million at the threshold itself; with ``slack=None`` none are. Small buckets
  (PAIRED members at most) list these pairs; larger ones are cut into chunks of CHUNK members or CHUNK_BYTES
  of shingles, and each chunk of outsiders meets each chunk of members as packed arrays in a task of its own, which
  returns only links that join components. No pair of a large group becomes a row;
* components are contracted in rounds of joins; nothing is collected but the names that texts share.

Buckets, pivots and nodes with more than a thousandth of all rows are joined by broadcast, others by shuffle.

Nulls: a null text counts as an empty one, and texts without words are only alike
if they are equal. A class is named by its smallest ``doc_id`` (null if it has none).
Repeated rows get one result row each. Other columns are ignored. Ids may be of any type that can be ordered.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbuf
from .common import join_hot, materialise, scratch, set_apart

BANDS, ROWS, SHINGLE, THRESHOLD = 24, 5, 5, 0.8
PAIRED, CHUNK, CHUNK_BYTES, SLACK = 16, 512, 16 << 20, 4.5


def shingles(data: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of each distinct shingle, sorted by text and hash."""
    start, end, doc = textbuf.words(data, off)
    word = textbuf.RangeHash(data)(start, end)
    if not len(word):
        return np.zeros(0, np.int64), word, np.zeros(0, np.int64)
    count = np.bincount(doc, minlength=len(off) - 1)
    first = np.cumsum(count) - count
    index = np.arange(len(word)) - first[doc]
    is_start = index + k <= count[doc]
    mult = textbuf.powers(0xD6E8FEB86659FD93, k + 1)
    at = np.flatnonzero(is_start)
    value = np.zeros(len(at), np.uint64)
    for j in range(k):
        value += word[at + j] * mult[j + 1]
    short = np.flatnonzero((count > 0) & (count < k))
    tail = np.array([np.bitwise_xor.reduce(textbuf.mix(word[first[d] : first[d] + count[d]] * mult[1 : count[d] + 1])) for d in short], np.uint64)
    owner = np.concatenate([doc[at], short])
    value = textbuf.mix(np.concatenate([value, tail]))
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], value[at], np.diff(np.append(at, len(value)))


def signatures(owner: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """n x m registers, each the hash of the shingle that reached it first (0: none)."""
    best = np.full(n * m, np.inf)
    found = np.zeros(n * m, np.uint64)
    time = np.zeros(len(owner))
    alive = np.arange(len(owner))
    step = np.uint64(0x9E3779B97F4A7C15)
    seed = value.copy()
    while len(alive):
        seed[alive] += step
        draw = textbuf.mix(seed[alive])
        # 52 bits give the waiting time, another draw the register
        time[alive] -= np.log(((draw >> np.uint64(12)) + 0.5) / 2.0**52) / weight[alive]
        register = (textbuf.mix(draw ^ step) % np.uint64(m)).astype(np.int64)
        slot = owner[alive] * m + register
        now = time[alive]
        early = now < best[slot]
        s, t, v = slot[early], now[early], value[alive[early]]
        np.minimum.at(best, s, t)
        won = t == best[s]
        found[s[won]] = v[won]
        alive = alive[now < best.reshape(n, m).max(axis=1)[owner[alive]]]
    return found.reshape(n, m)


def _signed(bands: int, rows: int, k: int):
    m = bands * rows
    number = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)

    def run(batches):
        for whole in batches:
            for batch in textbuf.slices(whole, "text"):
                data, off = textbuf.buffer(batch.column("text"))
                n = batch.num_rows
                owner, value, count = shingles(data, off, k)
                has = np.bincount(owner, minlength=n) > 0
                registers = signatures(owner, value, count.astype(float), n, m)
                mult = textbuf.powers(0xC2B2AE3D27D4EB4F, rows + 1)
                parts = registers.reshape(n, bands, rows)
                key = np.zeros((n, bands), np.uint64)
                for j in range(rows):
                    key += parts[:, :, j] * mult[j + 1]
                key = textbuf.mix(key + number).view(np.int64)
                small = (registers >> np.uint64(56)).astype(np.uint8)
                lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(has * bands)]), key[has].ravel())
                size = pa.array(np.bincount(owner, minlength=n), pa.int64())
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "name", "other")], lists.cast(pa.list_(pa.int64())), textbuf.binary(list(small)), size], ["doc_id", "name", "other", "bands", "registers", "size"])

    return run


def _shingle_lists(k: int):
    def run(batches):
        for whole in batches:
            for batch in textbuf.slices(whole, "text"):
                owner, value, count = shingles(*textbuf.buffer(batch.column("text")), k)
                ends = np.searchsorted(owner, np.arange(batch.num_rows + 1))
                parts = [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                counts = [b"" if (c := count[p]).max(initial=1) == 1 else c.astype(np.int64).tobytes() for p in parts]
                yield pa.RecordBatch.from_arrays([batch.column("node"), textbuf.binary([value[p] for p in parts]), pa.array(counts, pa.binary())], ["node", "hashes", "counts"])

    return run


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Exact J of two weighted sets, given as sorted hashes and weights."""
    if not len(a) or not len(b):
        return 0.0
    if x.max() == 1 and y.max() == 1:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both / (len(a) + len(b) - both)
    every = np.union1d(a, b)
    p, q = np.zeros(len(every)), np.zeros(len(every))
    p[np.searchsorted(every, a)], q[np.searchsorted(every, b)] = x, y
    with np.errstate(divide="ignore"):
        ratio = p / q
    order = np.argsort(ratio, kind="stable")
    ratio, p, q = ratio[order], p[order], q[order]
    below, above = np.concatenate([[0.0], np.cumsum(q)]), np.concatenate([np.cumsum(p[::-1])[::-1], [0.0]])
    shared = np.flatnonzero((p > 0) & (q > 0))
    cut = np.searchsorted(ratio, ratio[shared], "left")
    return float(np.sum(1.0 / (above[cut] / p[shared] + below[cut] / q[shared])))


def _verify(threshold: float):
    def weights(raw, n):
        return np.frombuffer(raw, np.int64).astype(float) if raw else np.ones(n)

    def run(batches):
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in ("hashes_a", "hashes_b"))
                x, y = (weights(batch.column(c)[i].as_py(), len(h)) for c, h in (("counts_a", a), ("counts_b", b)))
                if probability_jaccard(a, x, b, y) >= threshold - 1e-12:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], ["a", "b"])

    return run


def _likely(least: float, m: int):
    """Pairs whose registers do not rule out the threshold."""

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, m) for c in ("registers_a", "registers_b"))
            keep = pa.array((a == b).mean(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    return run


def _chunk_pair(threshold: float, least: float, m: int):
    """Links that join components, between a chunk of outsiders (side 0) and one of members (side 1).
    Rows come in any order. Two outsiders meet twice and are compared where the smaller is on side 0."""

    def run(table: pa.Table) -> pa.Table:
        node, root, side = (table.column(c).to_numpy() for c in ("node", "root", "side"))
        outside = table.column("outside").to_numpy(zero_copy_only=False)
        registers = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint8).reshape(-1, m)
        hashes = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("hashes")]
        counts = [np.frombuffer(c, np.int64).astype(float) if c else np.ones(len(h)) for c, h in zip(table.column("counts").to_pylist(), hashes, strict=True)]
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        parent = {r: r for r in root.tolist()}

        def top(r: int) -> int:
            while parent[r] != r:
                parent[r] = r = parent[parent[r]]
            return r

        out = []
        for i in one:
            others = two[(root[two] != root[i]) & (~outside[two] | (node[two] > node[i]))]
            likely = others[(registers[others] == registers[i]).mean(axis=1) >= least]
            for j in likely:
                a, b = top(int(root[i])), top(int(root[j]))
                if a != b and probability_jaccard(hashes[i], counts[i], hashes[j], counts[j]) >= threshold - 1e-12:
                    parent[a] = b
                    out.append((int(node[i]), int(node[j])))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected ``links`` (a, b); the root is the
    smallest node of its component. Rounds of hooking to the smallest neighbour, two
    pointer jumps and contraction; each round at least halves the roots that have links."""
    edges = materialise(links.select("a", "b").where("a <> b").distinct(), links.count())
    roots, most = None, 0
    while n := edges.count():
        both = edges.union(edges.select("b", "a"))
        step = both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")).withColumnRenamed("a", "node")
        step = materialise(step, 2 * n)
        for _ in range(2):
            on = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
            step = step.join(on, "to").select("node", F.col("next").alias("to"))
        step = materialise(step, 2 * n)
        if roots is None:
            roots, most = step.select("node", F.col("to").alias("root")), 2 * n
        else:
            on = step.select(F.col("node").alias("root"), "to")
            roots = materialise(roots.join(on, "root", "left").select("node", F.coalesce("to", "root").alias("root")), most)
        for end in ("a", "b"):
            edges = edges.join(step.select(F.col("node").alias(end), "to"), end).drop(end).withColumnRenamed("to", end)
        edges = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), n)
    return links.sparkSession.createDataFrame([], "node long, root long") if roots is None else roots


def _named(text: Column) -> tuple[Column, Column]:
    """Two independent hashes of a text."""
    return F.xxhash64(text), F.xxhash64(F.lit(7), text)


def _classes(docs: DataFrame, *options) -> DataFrame:
    """(doc_id, name, other, node, class_id) for every row of ``docs``; name and other hash its text."""
    with scratch(docs.sparkSession) as keep:
        return _found_classes(keep, docs, *options)


def _found_classes(keep: Callable[[DataFrame], DataFrame], docs: DataFrame, threshold: float, shingle: int, bands: int, rows: int, slack: float | None) -> DataFrame:
    m = bands * rows
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(F.col("text"), F.lit(""))
    name, other = _named(text)
    base = docs.select("doc_id", text.alias("text"), name.alias("name"), other.alias("other"))
    signed = keep(materialise(base.mapInArrow(_signed(bands, rows, shingle), f"doc_id {kind}, name long, other long, bands array<long>, registers binary, size long")))
    n_docs = signed.count()
    # names that several texts share: about the square of the number of texts over 2 ** 65
    shared_names = [r[0] for r in signed.groupBy("name").agg(F.min("other").alias("low"), F.max("other").alias("high")).where("low < high").select("name").collect()]
    node = F.when(F.col("name").isin(shared_names), F.xxhash64("name", "other")).otherwise(F.col("name")) if shared_names else F.col("name")
    # one row for each text; copies are folded before any shuffle
    nodes = materialise(signed.groupBy(node.alias("node")).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("bands").alias("bands"), F.first("registers").alias("registers"), F.first("size").alias("size")), n_docs, 8 * bands + m + 64)

    pair = "a long, b long"
    held = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = materialise(held.groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("last"), F.count("*").alias("n")).where("pivot < last").select("bucket", "pivot", "n"), n_docs * bands // 2, 24)
    member = materialise(join_hot(held, shared, shared, n_docs * bands, "bucket").drop("n"), n_docs * bands, 24)
    n_member = member.count()
    least = -1.0 if slack is None else threshold - slack * (threshold * (1 - threshold) / m) ** 0.5
    near = member.select("node").distinct()
    registers = materialise(nodes.select("node", "registers", "size").join(near, "node", "left_semi"), min(n_docs, n_member), m + 16)
    # shingles of the texts that share a bucket: one row of each text
    reps = near.join(nodes.select("node", "rep"), "node").select(F.col("node").alias("near"), "rep")
    own = base.withColumn("node", node).select("doc_id", "node", "text")
    own = own.join(reps, (F.col("node") == F.col("near")) & F.col("doc_id").eqNullSafe(F.col("rep"))).dropDuplicates(["node", "doc_id"])
    lists = materialise(own.select("node", "text").mapInArrow(_shingle_lists(shingle), "node long, hashes binary, counts binary"))

    def with_ends(pairs: DataFrame, table: DataFrame, n_pairs: int) -> DataFrame:
        """``pairs`` with the columns of ``table`` (node, ...) for both ends; an end ``a`` may have many pairs."""
        side = lambda end: table.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in table.columns if c != "node"])
        often = pairs.groupBy("a").agg(F.count("*").alias("n"))
        return join_hot(pairs, side("a"), often, n_pairs, "a").join(side("b"), "b")

    def links(pairs: DataFrame, most: int) -> DataFrame:
        pairs = materialise(pairs, most)
        if not (n := pairs.count()):
            return pairs
        pairs = with_ends(pairs, registers.drop("size"), n).select("a", "b", "registers_a", "registers_b")
        pairs = materialise(pairs.mapInArrow(_likely(least, m), pair), n, heavy=True)
        if not (n := pairs.count()):
            return pairs
        return materialise(with_ends(pairs, lists, n).mapInArrow(_verify(threshold), pair), n, heavy=True)

    first = links(member.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), n_member)
    roots = components(first)
    # the rest: members of one bucket that are in different components, but for pairs with the pivot
    place = materialise(member.join(roots, "node", "left").select("bucket", "node", "pivot", F.coalesce("root", "node").alias("root")), n_member, 32)
    mixed = materialise(place.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low < high").select("bucket", "n"), n_member // 2)
    place = materialise(join_hot(place, mixed, mixed, n_member, "bucket").where("node <> pivot").select("bucket", "node", "root").join(registers.select("node", "size"), "node"), n_member, 32)
    per_root = place.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    sums = per_root.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "root", "size")).alias("most"))
    sums = materialise(sums.select("bucket", "n", "size", F.col("most.root").alias("main"), (F.col("n") - F.col("most.n")).alias("n_out"), (F.col("size") - F.col("most.size")).alias("size_out")).where("n_out > 0"), n_member // 2, 48)
    small = place.join(sums.where(F.col("n") <= PAIRED).select("bucket"), "bucket")
    facing = small.select("bucket", F.col("node").alias("b"), F.col("root").alias("root_b"))
    rest = small.withColumnRenamed("node", "a").join(facing, "bucket").where("a < b and root <> root_b").select("a", "b").distinct()
    more = links(rest, PAIRED * n_member)
    large = sums.where(F.col("n") > PAIRED)
    if not large.isEmpty():
        chunks = lambda n, size: F.greatest(F.ceil(F.col(n) / CHUNK), F.ceil(F.col(size) * 8 / CHUNK_BYTES))
        large = large.select("bucket", "n", "main", chunks("n", "size").alias("all"), chunks("n_out", "size_out").alias("few"))
        dealt = join_hot(place.drop("size"), large, large, n_member, "bucket").withColumn("outside", F.col("root") != F.col("main"))
        full = dealt.join(registers.drop("size"), "node").join(lists, "node")
        columns = ["bucket", "node", "root", "outside", "registers", "hashes", "counts"]
        spread = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        one = full.where("outside").select(*columns, spread("few", 1).alias("i"), every("all").alias("j"), F.lit(0).alias("side"))
        two = full.select(*columns, every("few").alias("i"), spread("all", 2).alias("j"), F.lit(1).alias("side"))
        more = more.union(materialise(one.union(two).groupBy("bucket", "i", "j").applyInArrow(_chunk_pair(threshold, least, m), pair), n_member, heavy=True))
    if not more.isEmpty():
        roots = components(first.union(more))

    ranked = nodes.select("node", "rep", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = ranked.groupBy("root").agg(F.min("rep").alias("class_id"))
    classes = keep(materialise(ranked.join(named, "root").select("node", "class_id", "n"), n_docs, 24))
    return join_hot(signed.select("doc_id", "name", "other", node.alias("node")), classes, classes, n_docs, "node").select("doc_id", "name", "other", "node", "class_id")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, slack: float | None = SLACK) -> DataFrame:
    """(doc_id, node, class_id) for every row of ``docs`` (doc_id, text, ...)."""
    return _classes(docs, threshold, shingle, bands, rows, slack).select("doc_id", "node", "class_id")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, slack: float | None = SLACK) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the one with the smallest doc_id."""
    docs, restored = set_apart(docs, "doc_id", "text")
    classes = materialise(_classes(docs, threshold, shingle, bands, rows, slack))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "name", "other")
    keep = classes.groupBy(F.col("class_id").isNull().alias("unnamed"), "class_id", F.when(F.col("class_id").isNull(), F.col("node")).alias("of")).agg(F.min(order).alias("kept"))
    keep = keep.select(F.col("kept.doc_id").alias("kept_id"), F.col("kept.name").alias("kept_name"), F.col("kept.other").alias("kept_other"))
    name, other = _named(F.coalesce(F.col("text"), F.lit("")))
    kept = docs.join(keep, (name == F.col("kept_name")) & (other == F.col("kept_other")) & F.col("doc_id").eqNullSafe(F.col("kept_id")))
    repeated = classes.groupBy("doc_id", "name", "other").count().where("count > 1")
    if not repeated.isEmpty():
        kept = kept.dropDuplicates(["kept_id", "kept_name", "kept_other"])
    return restored(kept)
