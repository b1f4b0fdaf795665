"""Streams of documents through the batch plan."""

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.text_to_table import Options, text_to_table


def distinct_articles(articles: DataFrame, within: str = "7 days", time: str = "ts") -> DataFrame:
    """A stream without repeated urls; state is dropped once the watermark passes."""
    return articles.withWatermark(time, within).dropDuplicatesWithinWatermark(["url"])


def tables_from(docs: DataFrame, path: str, checkpoint: str, options: Options | None = None, available_now: bool = True) -> StreamingQuery:
    """Write the tables of each micro-batch to ``path``; a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        text_to_table(batch, options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
