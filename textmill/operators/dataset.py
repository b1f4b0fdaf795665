"""Training instances: regime filter, chat messages, label masks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import profiles as P
from ..functions.tables import is_table
from ..sources.files import read_instances, write_lines


def of_regime(instances: DataFrame, regime: str) -> DataFrame:
    return instances.where(F.coalesce("regime", F.lit(regime)) == regime)


def messages(text: Column, table: Column, regime: str = "dynamic") -> Column:
    said = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    before, after = P.USER_PROMPT.split("{text}")
    return F.array(said("system", F.lit(P.SYSTEM_PROMPTS[regime])), said("user", F.concat(F.lit(before), text, F.lit(after))), said("assistant", table))


def masked(ids: Column, prompt_length: Column, most: int = 4500) -> Column:
    """Labels: the prompt's ids become -100; both are cut to ``most``."""
    return F.slice(F.transform(ids, lambda x, i: F.when(i < prompt_length, F.lit(-100)).otherwise(x)), 1, most)


def attention(ids: Column, most: int = 4500) -> Column:
    """Attention mask of the ids that ``masked`` keeps."""
    return F.slice(F.transform(ids, lambda x: F.lit(1)), 1, most)


def annotate(docs: DataFrame, tables: DataFrame, regime: str, path: str | None = None) -> DataFrame:
    """Instances (text, table, regime, source) from documents and their generated tables (doc_id, markdown).
    Documents without a table, or with one that is not valid, are left out; with ``path`` they are written as JSON lines too."""
    made = docs.select("doc_id", "text").join(tables, "doc_id").where(is_table(F.col("markdown")))
    made = made.select("text", F.col("markdown").alias("table"), F.lit(regime).alias("regime"), F.lit("t3_auto").alias("source"))
    if path is not None:
        write_lines(made, path)
        made = read_instances(docs.sparkSession, path)
    return made
