"""Semantic chunks of neighbouring sentences, and their vectors."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, mean_of


def adjacent_similarity(rows: DataFrame, key: str = "doc_id", order: str = "sent_idx", vector: str = "embedding") -> DataFrame:
    """``rows`` with ``similarity`` to the next row of the key (null for the last)."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("similarity", dot(F.col(vector), F.lead(vector).over(w)))


def chunks(rows: DataFrame, theta: float = 0.72, least: int = 3, most: int = 15, key: str = "doc_id", order: str = "sent_idx", require_anchor: bool = False, vector: str = "embedding") -> DataFrame:
    """(key, chunk_idx, start_idx, end_idx, has_anchor, sentences, and mean where rows have vectors): rows
    between similarities below ``theta``; short chunks go, long ones are halved once. One shuffle on the key.
    Needs columns sentence, is_anchor and either similarity or the vector, which is read once."""
    has_vector = vector in rows.columns
    if "similarity" not in rows.columns:
        rows = adjacent_similarity(rows, key, order, vector)
    w = Window.partitionBy(key).orderBy(order)
    cut = F.coalesce(F.lag(F.col("similarity") < theta).over(w), F.lit(False)).cast("int")
    rows = rows.withColumn("_cut", cut).withColumn("_no", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    row = F.struct(F.col(order).alias("at"), F.col("sentence").alias("said"), *[F.col(vector).alias("vector")] * has_vector)
    grouped = rows.groupBy(key, "_no").agg(F.sort_array(F.collect_list(row)).alias("rows"), F.bool_or("is_anchor").alias("has_anchor"))
    n = F.size("rows")
    half = F.floor(n / 2).cast("int")
    parts = F.when(n > most, F.array(F.slice("rows", 1, half), F.slice("rows", half + 1, n - half))).otherwise(F.array("rows"))
    out = grouped.where(n >= least).select(key, "has_anchor", F.explode(parts).alias("rows"))
    if require_anchor:
        out = out.where("has_anchor")
    mean = [mean_of(F.expr("transform(rows, r -> r.vector)")).alias("mean")] * has_vector
    out = out.select(key, F.expr("rows[0].at").alias("start_idx"), F.expr("rows[size(rows) - 1].at").alias("end_idx"), "has_anchor", F.expr("transform(rows, r -> r.said)").alias("sentences"), *mean)
    return out.withColumn("chunk_idx", F.row_number().over(Window.partitionBy(key).orderBy("start_idx")) - 1)


def mean_vectors(rows: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """Component-wise means of the vectors of each group, as an array of doubles."""
    return rows.groupBy(*keys).agg(mean_of(F.collect_list(vector)).alias("mean"))
