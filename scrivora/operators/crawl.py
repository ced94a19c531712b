"""Progress of a crawl from its log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivora.functions.text import clock


def outcomes(log: DataFrame) -> DataFrame:
    """(outcome, n) over distinct attempts."""
    return log.dropDuplicates(["fetch_id"]).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def progress(log: DataFrame, target: int) -> DataFrame:
    """One row: attempts, saved, percent of the target, seconds, rate a second, and the time left as HH:MM:SS. Attempts logged
    twice count once; without time or attempts the rate is 0 and the time left 00:00:00."""
    one = log.dropDuplicates(["fetch_id"]).agg(
        F.count(F.lit(1)).alias("completed"),
        F.coalesce(F.sum((F.col("outcome") == "saved").cast("long")), F.lit(0)).alias("saved"),
        F.coalesce(F.max(F.unix_micros(F.col("fetched_at").cast("timestamp"))) - F.min(F.unix_micros(F.col("fetched_at").cast("timestamp"))), F.lit(0)).alias("micros"),
    )
    seconds = F.col("micros") / 1e6
    rate = F.when(seconds > 0, F.col("completed") / seconds).otherwise(F.lit(0.0))
    left = F.when(rate > 0, F.greatest(F.lit(target) - F.col("completed"), F.lit(0)) / rate).otherwise(F.lit(0.0))
    return one.select(
        "completed", "saved", F.round(F.col("completed") * 100.0 / F.lit(target), 1).alias("percent"), F.round(seconds, 1).alias("seconds"), F.round(rate, 6).alias("rate"), clock(F.floor(left)).alias("time_left")
    )
