"""Placement on shards by a hierarchical weighted hash tree. DataFrame operations only.

A tree has regions, racks and shards; an inner node weighs as much as its shards
together. A key descends from the root: at each level every child draws
``log(u) / weight``, where u in (0, 1) is a hash of the key and the child's name, and the
highest draw wins. A child's draw depends on nothing but key, name and weight, so a changed
weight moves keys only into or out of the subtrees whose weights changed.

A new shard is added as a region of its own (``grow``): no other weight changes, so
every key either stays or goes to the new shard. That is the law ``key``.

Slots number the rows of a shard without gaps, with no task holding a whole shard: rows
are numbered in blocks of a shard, whose starts are the running sums of the block sizes. A block is a hash
of the key, the ties and the number of the row's partition, so rows of one key, or equal rows, spread
over blocks too; rows are written with their shards and blocks, once. The table of sizes has at most shards x blocks rows; it is joined to the
blocks where they are, as both are dealt by shard and block, and broadcast only if Spark finds it small.

A null key is a key of its own; repeated rows share the shard and get slots of their own,
in any order among equal rows. A null text has no bytes. Other columns are ignored.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

BLOCKS = 1024


@dataclass(frozen=True)
class Tree:
    """Shard weights by region and rack: ``weights[region][rack]`` maps shard to weight."""

    weights: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @staticmethod
    def regular(regions: int, racks: int, shards: int) -> "Tree":
        number = iter(range(regions * racks * shards))
        return Tree(tuple(tuple(tuple((next(number), 1.0) for _ in range(shards)) for _ in range(racks)) for _ in range(regions)))

    def grow(self, weight: float = 1.0) -> "Tree":
        last = max(s for region in self.weights for rack in region for s, _ in rack)
        return Tree((*self.weights, (((last + 1, weight),),)))


def _weight(node) -> float:
    return node[1] if isinstance(node[0], int) else sum(map(_weight, node))


def _child(key: str, prefix: str, children: str) -> Column:
    """The number of the child that wins; children: SQL of an array of (c, w)."""
    name = f"concat(coalesce(cast(`{key}` as string), ''), '/', {prefix} x.c)"
    draw = f"ln((cast(conv(substring(md5(cast({name} as binary)), 1, 13), 16, 10) as bigint) + 0.5D) / 4503599627370496D) / x.w"
    return F.expr(f"-array_max(transform({children}, x -> struct({draw} AS draw, -x.c AS child))).child")


def _array(children) -> str:
    return "array(" + ", ".join(f"named_struct('c', {c}, 'w', {float(w)}D)" for c, w in children) + ")"


def place(df: DataFrame, key: str, tree: Tree, out: str) -> DataFrame:
    """``df`` with the shard of each key; every level costs one draw per child."""
    regions = _array((r, _weight(x)) for r, x in enumerate(tree.weights))
    racks = "array(" + ", ".join(_array((j, _weight(x)) for j, x in enumerate(r)) for r in tree.weights) + ")"
    shards = "array(" + ", ".join("array(" + ", ".join(_array(x) for x in r) + ")" for r in tree.weights) + ")"
    df = df.withColumn("_region", _child(key, "", regions))
    df = df.withColumn("_rack", _child(key, "_region, '/',", f"{racks}[_region]"))
    return df.withColumn(out, _child(key, "_region, '/', _rack, '/',", f"{shards}[_region][_rack]").cast("int")).drop("_region", "_rack")


def numbered(df: DataFrame, key: str, shard: str, out: str, ties: list[str], blocks: int = BLOCKS) -> DataFrame:
    """``df`` with gapless slots from 0 in each shard, ordered by block, key and ties."""
    # written once: the blocks' sizes and their rows must agree on every row's block
    df = materialise(df.withColumn("_block", F.pmod(F.xxhash64(key, *ties, F.spark_partition_id()), F.lit(blocks)).cast("int")))
    sizes = df.groupBy(shard, "_block").count()
    before = Window.partitionBy(shard).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(shard).alias("_shard"), F.col("_block").alias("_at"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(shard, "_block").orderBy(F.col(key).asc_nulls_first(), *ties)
    rows = df.withColumn("_row", F.row_number().over(within)).join(starts, (F.col(shard) == F.col("_shard")) & (F.col("_block") == F.col("_at")))
    return rows.withColumn(out, (F.col("_start") + F.col("_row") - 1).cast("long")).drop("_block", "_shard", "_at", "_start", "_row")


def assign_shards(docs: DataFrame, tree: Tree, grown: Tree) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``."""
    raw = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    df = place(place(df, "doc_id", tree, "shard"), "doc_id", grown, "grown_shard")
    return numbered(df, "doc_id", "shard", "slot", ["size", "text_crc32"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, tree: Tree, path: str) -> None:
    """Write ids and texts as one folder per shard."""
    shards = place(docs.select("doc_id", "text"), "doc_id", tree, "shard")
    shards.write.partitionBy("shard").parquet(path)
