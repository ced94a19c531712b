"""Streams of fetched pages and crawl logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scrivora.sources.articles import append_new, complete, create_if_missing
from scrivora.sources.pages import parse_pages

PAGES = "id long, url string, html string"


def page_stream(spark: SparkSession, path: str, files_per_trigger: int = 10) -> DataFrame:
    """Pages that arrive as Parquet files; the number of files a trigger takes is the back-pressure."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest_pages(pages: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Parse arriving pages and append those whose url is new to the article table at ``target``. The anti-join against the
    stored table makes a repeated micro-batch harmless."""
    create_if_missing(pages.sparkSession, target)
    found = complete(parse_pages(pages))

    def store(batch: DataFrame, _: int) -> None:
        append_new(batch.sparkSession, target, batch.select("id", "title", "url", "text"), "url")

    return found.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def outcome_counts(log: DataFrame, window: str = "1 hour", lateness: str = "30 days") -> DataFrame:
    """Attempts per outcome and window of fetch time from a stream of log rows; a repeated row counts once, rows later than
    ``lateness`` are dropped."""
    fresh = log.withWatermark("fetched_at", lateness).dropDuplicatesWithinWatermark(["fetch_id"])
    return fresh.groupBy(F.window("fetched_at", window).alias("w"), "outcome").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("from_time"), "outcome", "n")
