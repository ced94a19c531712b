"""Joins on a key that a third of all rows may share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows from which on a key is hot, and the bound of the number of hot keys: a key needs 1 / MOST_HOT of all rows as well.
HOT_ROWS, MOST_HOT = 1_000_000, 10_000


def hot_keys(counts: DataFrame, key: str, count: str = "n", hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """(key, _salts) of the hot keys from exact counts per key, or None if there are none. ``_salts`` is the number of
    pieces of about ``hot_rows`` rows that a key's rows are dealt out to. There are at most :data:`MOST_HOT`."""
    total = counts.agg(F.sum(count)).head()[0] or 0
    least = max(hot_rows, total // MOST_HOT + 1)
    rows = counts.where(F.col(count) >= least).select(key, count).collect() if total >= least else []
    if not rows:
        return None
    kind = counts.schema[key].dataType.simpleString()
    return counts.sparkSession.createDataFrame([(r[0], -(-int(r[1]) // least)) for r in rows], f"`{key}` {kind}, _salts int")


def join_salted(rows: DataFrame, other: DataFrame, key: str, hot: DataFrame | None, by: str = "id") -> DataFrame:
    """Inner join on ``key``. Rows of a hot key are dealt out by a hash of ``by`` to as many pieces as the key has salts, and the
    few rows of ``other`` with that key are repeated for each piece."""
    if hot is None:
        return rows.join(other, key)
    hot = F.broadcast(hot)
    salts = F.coalesce("_salts", F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(by), salts).cast("int")).drop("_salts")
    repeated = other.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return dealt.join(repeated, [key, "_salt"]).drop("_salt")
