"""The registered queries of the operators, over whole tables."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, decontaminate, licenses, near_dedup, quality, repeats, sharding, toxicity, url_filter
from .common import table

RANKS, HELD_OUT = "byte_bpe_multi_50k.tiktoken", 2
TREE = sharding.Tree.regular(4, 2, 5)
SAID = "</s>[INST] ok [/INST]"


def near_dedup_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "class_id")


def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages", "page_id", "url"))


def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def _remainder():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(_remainder() != HELD_OUT)
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", F.coalesce(_remainder() == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def chat_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").withColumn("text", F.coalesce("text", F.lit("")))
    more = spark.sql(f"SELECT -7L AS conv_id, turn, role, '{SAID}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return _digests(chat_format.format_chats(rows.unionByName(more), "conv_id"))


def _digests(formatted: DataFrame) -> DataFrame:
    read = chat_format.read_back(formatted)
    turns = F.expr("array_join(transform(turns, t -> concat(t.role, '\\n', t.text, '\\n')), '')")
    return read.select(
        F.col("key").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def laid_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations in all layouts at once: by conv_id as rows of turns, lists of messages or of values, and
    those of a user and an assistant alone as prompts or instructions."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    whole = rows.groupBy("conv_id").agg(F.expr("sort_array(collect_list(struct(turn, role, text)))").alias("t"))
    pair = F.expr("transform(t, x -> x.role) = array('user', 'assistant')")
    whole = whole.withColumn("as", F.when(pair, F.expr("element_at(array('prompt', 'instruction'), cast(conv_id % 2 + 1 as int))")).otherwise(F.expr("element_at(array('turn', 'messages', 'conversations'), cast(conv_id % 3 + 1 as int))")))
    value = lambda layout, sql: F.when(F.col("as") == layout, F.expr(sql))
    whole = whole.select(
        "conv_id", value("messages", "transform(t, x -> struct(x.role AS role, x.text AS content, 'a' AS name))").alias("messages"),
        value("conversations", "transform(t, x -> struct(CASE x.role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE x.role END AS `from`, x.text AS value))").alias("conversations"),
        value("prompt", "t[0].text").alias("prompt"), value("prompt", "t[1].text").alias("response"), value("instruction", "t[0].text").alias("instruction"), value("instruction", "t[1].text").alias("output"),
        F.explode(F.when(F.col("as") == "turn", F.col("t")).otherwise(F.array(F.lit(None).cast("struct<turn:bigint,role:string,text:string>")))).alias("row"))
    return whole.select("*", "row.*").drop("row")


def chat_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(chat_format.format_chats(laid_out(spark, sf_dir), "conv_id"))


def shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents", "doc_id", "text"), TREE, TREE.grow())


def quality_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents", "doc_id", "text"))
    return judged.select("doc_id", *quality.FEATURES, "base_failed", "kept", "quality")


def license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents", "doc_id", "text"))


def bpe_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return byte_bpe.encode_digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_near_dedup": near_dedup_classes,
    "op2_url_filter": url_verdicts,
    "op3_decontamination": benchmark_leaks,
    "op4_toxicity": toxicity_scores,
    "op5_chat_format": chat_digests,
    "op6_sharding": shard_placement,
    "op7_quality": quality_verdicts,
    "op8_licenses": license_notices,
    "op9_byte_bpe": bpe_digests,
    "op10_repeats": repeat_removal,
    "chat_layouts": chat_layouts,
}
