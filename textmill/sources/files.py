"""Readers and writers of the formats in use."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import correction_table


def read_instances(spark: SparkSession, path: str, regime: str | None = None) -> DataFrame:
    """Instances from JSON lines or a JSON array."""
    df = spark.read.schema("text string, table string, regime string, source string").json(path, multiLine=True)
    lines = spark.read.schema(df.schema).json(path)
    first = spark.read.text(path).where("trim(value) <> ''").first()
    df = df if first and first[0].lstrip().startswith("[") else lines
    return df if regime is None else df.where(F.coalesce("regime", F.lit(regime)) == regime)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of each file of a folder, whole; an empty file has no row."""
    return spark.read.text(path, wholetext=True).select(F.xxhash64(F.input_file_name()).alias("doc_id"), F.col("value").alias("text"))


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """(wrong, right) from lines with exactly two tab-separated fields; the last line wins, in the order of
    Spark's partitions where there are several files."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("f"), F.monotonically_increasing_id().alias("no")).where("size(f) = 2")
    return rows.groupBy(F.expr("trim(f[0])").alias("wrong")).agg(F.max_by(F.expr("trim(f[1])"), "no").alias("right"))


def corrections(words: DataFrame, most: int = 100_000) -> Column:
    """The corrections as one table that travels with the plan, if they are few enough for that."""
    rows = words.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} corrections: join them instead")
    return correction_table({r["wrong"]: r["right"] for r in rows})


def correct_by_join(docs: DataFrame, words: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, text) with each token corrected, for dictionaries of any size."""
    tokens = docs.select(key, F.posexplode(F.split(text, r"(?U)\s+")).alias("pos", "wrong"))
    fixed = tokens.join(words, "wrong", "left").select(key, "pos", F.coalesce("right", "wrong").alias("w"))
    return fixed.groupBy(key).agg(F.expr("array_join(transform(sort_array(collect_list(struct(pos, w))), x -> x.w), ' ')").alias("text"))


def append_by_day(articles: DataFrame, path: str) -> None:
    articles.write.mode("append").partitionBy("date").json(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def results_table(report: DataFrame) -> DataFrame:
    """Fixed-width lines of a report (metric, mean, lower, upper), after a heading and in order of the metric."""
    line = F.format_string("%-22s %8.4f  [%.4f, %.4f]", "metric", "mean", "lower", "upper")
    rows = report.select(F.row_number().over(Window.orderBy("metric")).alias("no"), line.alias("line"))  # a row for each metric
    head = report.sparkSession.createDataFrame([(0, f"{'Metric':<22} {'Mean':>8} {'95% CI':>20}")], "no int, line string")
    return head.union(rows)


def write_results(report: DataFrame, path: str) -> None:
    """One JSON object of metrics, each with its mean and bounds."""
    one = report.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", F.struct("mean", "lower", "upper").alias("v")))))).alias("value"))
    one.coalesce(1).write.mode("overwrite").text(path)
