"""Self-consistency votes and judges' scores."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import judge_messages
from ..profiles import JUDGE_KEYS


def majority(samples: DataFrame, keys: list[str], value: str = "completion", order: str = "sample_no") -> DataFrame:
    """(keys, value, votes): the most frequent value, of several the one produced first."""
    counted = samples.groupBy(*keys, value).agg(F.count("*").alias("votes"), F.min(order).alias("first"))
    best = F.max_by(F.struct(value, "votes"), F.struct("votes", (-F.col("first")).alias("o")))
    return counted.groupBy(*keys).agg(best.alias("b")).select(*keys, f"b.{value}", "b.votes")


def judge(examples: DataFrame, ask: Callable[[Column, Column], Column], samples: int = 3, digits: int = 4) -> DataFrame:
    """(id, scores) for examples (id, text, table, generated): ``samples`` replies each, by a column function
    of messages and sample number, averaged over those that are valid."""
    drawn = examples.select("id", judge_messages(F.col("text"), F.col("table"), F.col("generated")).alias("messages"), F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("sample_no"))
    return judge_scores(drawn.select("id", ask(F.col("messages"), F.col("sample_no")).alias("reply")), examples, digits)


def judge_scores(replies: DataFrame, ids: DataFrame, digits: int = 4) -> DataFrame:
    """(id, scores): means over replies that are valid JSON; zeros without any."""
    parsed = replies.withColumn("j", F.from_json("reply", ", ".join(f"{k} double" for k in JUDGE_KEYS)))
    means = parsed.groupBy("id").agg(*[F.round(F.avg(f"j.{k}"), digits).alias(k) for k in JUDGE_KEYS])
    return ids.select("id").distinct().join(means, "id", "left").na.fill(0.0, JUDGE_KEYS)
