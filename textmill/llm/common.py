"""Helpers shared by the operators: reading tables and cutting lineage durably."""

import atexit
import re
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One table of a data folder, cut to the columns that are needed."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set a session on one machine gets a local
    one; elsewhere that is an error, as executors could not read each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="textmill-checkpoint-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: A small result is written by as many tasks as FILE_BYTES of it need, and LEAST_FILES at least.
FILE_BYTES, LEAST_FILES = 8 << 20, 4


def materialise(df: DataFrame, rows: int | None = None, width: int = 16, heavy: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that its lineage ends
    there and a lost executor costs a reread, not a recomputation.

    With ``rows``, a bound of its number of rows of about ``width`` bytes, a small result is not written as
    a file for each of many partitions. The last stage then has as few tasks, or, if it is ``heavy``, hands
    its rows to others that write them. A large result keeps its partitions."""
    spark = df.sparkSession
    if rows is not None and (files := max(LEAST_FILES, -(-rows * width // FILE_BYTES))) < shuffle_partitions(spark):
        df = df.repartition(files) if heavy else df.coalesce(files)
    path = f"{shared_dir(spark)}/textmill-{uuid.uuid4().hex}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _path_of[out] = path
    return out


_written: list[str] = []
_path_of: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that no result depends on any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables that were materialised inside it when it ends, but for those that the yielded
    function was given."""
    began, kept = len(_written), []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(_path_of[df])
        return df

    try:
        yield keep
    finally:
        mine = _written[began:]
        held = [p for p in mine if p in kept]
        del _written[began:]
        _written.extend(held)
        remove(spark, [p for p in mine if p not in held])


def drop(df: DataFrame) -> None:
    """Delete the table of a frame that ``materialise`` returned, if it is one."""
    if (path := _path_of.pop(df, None)) in _written:
        _written.remove(path)
        remove(df.sparkSession, [path])


def clear(spark: SparkSession) -> None:
    """Delete all tables that this process has materialised; frames that read them are of no use then."""
    remove(spark, _written)
    _written.clear()




#: Keys with more than a share of 1 / HOT of all rows are joined by broadcast.
HOT = 1000


def join_hot(rows: DataFrame, keyed: DataFrame, counts: DataFrame, total: int, key: str, *more: str) -> DataFrame:
    """``rows`` joined to ``keyed`` on ``key`` (and ``more``); counts: (key, n), the number of rows of a key, for
    all keys that may be common; total: of all rows. Keys with more than a share of 1 / HOT of all rows, fewer
    than HOT by their definition, are broadcast, so their rows stay where they are; the others are shuffled."""
    hot = [r[0] for r in counts.where(F.col("n") * HOT > total).select(key).distinct().collect()]
    if not hot:
        return rows.join(keyed, [key, *more])
    is_hot = F.col(key).isin(hot)
    return rows.where(is_hot).join(F.broadcast(keyed.where(is_hot)), [key, *more]).unionByName(rows.where(~is_hot).join(keyed.where(~is_hot), [key, *more]))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def set_apart(docs: DataFrame, *own: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs`` with all columns but ``own`` under names that clash with none of an operator's, and the
    function that gives the original columns back: those still there, and then the ``more`` that it is told."""
    other = {c: f"__extra_{i}" for i, c in enumerate(docs.columns) if c not in own}
    quoted = {c: F.col("`" + c.replace("`", "``") + "`") for c in docs.columns}
    apart = docs.select(*[quoted[c].alias(other.get(c, c)) for c in docs.columns])

    def restored(df: DataFrame, *more: str) -> DataFrame:
        return df.select(*[F.col(other.get(c, c)).alias(c) for c in docs.columns if other.get(c, c) in df.columns], *more)

    return apart, restored
