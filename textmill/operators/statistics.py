"""Bootstrap intervals and tests, loss analytics."""

import math
import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRIME = 2**31 - 1
#: Up to so many rows indices are drawn modulo PRIME, of which they are a small part.
SMALL = 1_000_000


def draw(b: Column, j: Column, n: int, seed: int = 42) -> Column:
    """Row index of draw j in resample b, in integer arithmetic that any engine can repeat: a resample has
    a key of its own, which enters between two squarings modulo PRIME, so no resample is a shift of
    another. For more than SMALL rows a 63-bit hash, whose range far exceeds any number of rows."""
    if n > SMALL:
        return F.xxhash64(b, j, F.lit(seed)).bitwiseAND(F.lit(2**63 - 1)) % n
    key = (b * 1_103_515_245 + seed * 15_485_863 + 12_345) % PRIME
    key = (key * key + b * 69_621) % PRIME
    key = key * key % PRIME
    x = (key + j * 48_271) % PRIME
    x = (x * x + key) % PRIME
    return (x * x + j * 16_807) % PRIME % n


def numbered(df: DataFrame, key: str, width: int = 1000) -> DataFrame:
    """``df`` with ``i`` from 0 without gaps in the order of an integer ``key``. Rows are numbered in ranges of
    ``width`` keys; only the ranges' sizes meet in one task."""
    df = df.withColumn("_range", F.floor(F.col(key) / width))
    sizes = df.groupBy("_range").count()
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_range").orderBy(key)
    return df.withColumn("_row", F.row_number().over(within)).join(starts, "_range").withColumn("i", (F.col("_start") + F.col("_row") - 1).cast("bigint")).drop("_range", "_row", "_start")


def bootstrap_means(values: DataFrame, columns: list[str], resamples: int, seed: int = 42) -> DataFrame:
    """(b, means): resamples spread over partitions; ``values`` has ``i`` from 0 without gaps.
    Only indices are made, never copies of rows; values are joined by index."""
    n = values.count()
    draws = values.sparkSession.range(resamples * n).select(F.expr(f"id div {max(n, 1)}").alias("b"), (F.col("id") % max(n, 1)).alias("j"))
    draws = draws.select("b", draw(F.col("b"), F.col("j"), max(n, 1), seed).alias("i"))
    return draws.join(values, "i").groupBy("b").agg(*[F.avg(c).alias(c) for c in columns])


def bounds(resamples: int, alpha: float = 0.05) -> tuple[int, int]:
    """Places of the lower and the upper bound in the sorted means."""
    return math.floor(alpha / 2 * resamples), math.ceil((1 - alpha / 2) * resamples) - 1


def _at(ranked: Column, place: float) -> Column:
    """The value at a place of a sorted array, between two values by their distance."""
    low, high = F.get(ranked, F.lit(math.floor(place))), F.get(ranked, F.lit(math.ceil(place)))
    return low + (high - low) * (place - math.floor(place))


def confidence_interval(values: DataFrame, column: str, resamples: int = 10_000, alpha: float = 0.05, seed: int = 42, interpolated: bool = False) -> DataFrame:
    """(mean, std, lower, upper, n_bootstrap): order statistics of the resampled means or, ``interpolated``,
    their percentiles. All zeros for no values."""
    kind = "_interpolated" if interpolated else ""
    return intervals(values, [column], resamples, alpha, seed).select("mean", "std", F.col(f"lower{kind}").alias("lower"), F.col(f"upper{kind}").alias("upper"), "n_bootstrap")


def intervals(values: DataFrame, columns: list[str], resamples: int = 10_000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """(metric, mean, std, lower, upper, lower_interpolated, upper_interpolated, n, n_bootstrap) of each
    column, the bounds by order statistics and by percentiles; all columns share their draws."""
    means = bootstrap_means(values.select("i", *columns), columns, resamples, seed)
    low, high = bounds(resamples, alpha)
    places = {"lower": low, "upper": high, "lower_interpolated": alpha / 2 * (resamples - 1), "upper_interpolated": (1 - alpha / 2) * (resamples - 1)}
    ranked = means.agg(*[F.sort_array(F.collect_list(c)).alias(c) for c in columns])  # as many values as resamples
    stack = lambda kinds: F.expr(f"stack({len(columns)}, " + ", ".join(f"'{c}', " + ", ".join(f"`{c}_{k}`" for k in kinds) for c in columns) + f") AS (metric, {', '.join(kinds)})")
    found = ranked.select(*[_at(F.col(c), place).alias(f"{c}_{k}") for c in columns for k, place in places.items()]).select(stack(places))
    seen = [x.alias(f"{c}_{k}") for c in columns for k, x in (("mean", F.avg(c)), ("std", F.stddev_samp(c)), ("n", F.count(c)))]
    both = values.agg(*seen).select(stack(("mean", "std", "n"))).join(found, "metric")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return both.select("metric", *map(zero, ("mean", "std", *places)), "n", F.when(F.col("n") > 0, resamples).otherwise(0).alias("n_bootstrap"))


def paired_test(values: DataFrame, a: str, b: str, resamples: int = 10_000, seed: int = 42, centered: bool = False) -> DataFrame:
    """(diff, p_value): share of resampled differences at least as large as the observed one."""
    means = bootstrap_means(values.select("i", a, b), [a, b], resamples, seed)
    seen = values.agg((F.avg(a) - F.avg(b)).alias("diff"))
    diff = F.col(a) - F.col(b) - (F.col("diff") if centered else F.lit(0.0))
    return means.join(F.broadcast(seen)).groupBy("diff").agg(F.avg((F.abs(diff) >= F.abs("diff") - 1e-12).cast("double")).alias("p_value"))


def exact_interval(values: DataFrame, key: str, column: str, resamples: int = 10_000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Intervals per key with the standard library's generator, one group of scores each."""
    low, high = bounds(resamples, alpha)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        v, rng = pdf[column].tolist(), random.Random(seed)
        n = len(v)
        means = sorted(sum(v[rng.randint(0, n - 1)] for _ in range(n)) / n for _ in range(resamples))
        mean = sum(v) / n
        std = (sum((x - mean) ** 2 for x in v) / max(n - 1, 1)) ** 0.5
        return pd.DataFrame({key: [pdf[key].iloc[0]], "mean": [mean], "std": [std], "lower": [means[low]], "upper": [means[high]], "n_bootstrap": [resamples]})

    return values.groupBy(key).applyInPandas(one, f"{key} {values.schema[key].dataType.simpleString()}, mean double, std double, lower double, upper double, n_bootstrap int")


def report(scores: DataFrame, names: list[str], key: str = "id", resamples: int = 10_000, alpha: float = 0.05, interpolated: bool = True) -> DataFrame:
    """(metric, mean, lower, upper, n): the mean of each score over all rows, with its interval."""
    kind = "_interpolated" if interpolated else ""
    found = intervals(numbered(scores.select(key, *names), key), names, resamples, alpha)
    return found.select("metric", "mean", F.col(f"lower{kind}").alias("lower"), F.col(f"upper{kind}").alias("upper"), "n")


def early_stop(losses: DataFrame, run: str = "run", patience: int = 2) -> DataFrame:
    """``losses`` (run, epoch, val_loss) with best, misses and stop after each evaluation."""
    w = Window.partitionBy(run).orderBy("epoch")
    best = F.min("val_loss").over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = (best.isNull() | (F.col("val_loss") < best)).cast("int")
    df = losses.withColumn("improved", better).withColumn("_island", F.sum("improved").over(w))
    within = Window.partitionBy(run, "_island").orderBy("epoch")
    return df.withColumn("misses", F.row_number().over(within) - 1).withColumn("stop", F.col("misses") >= patience).drop("_island")


def loss_gaps(losses: DataFrame) -> DataFrame:
    return losses.withColumn("gap", F.col("val_loss") - F.col("train_loss"))
