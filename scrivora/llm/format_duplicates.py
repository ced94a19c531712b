"""Copies hidden by white space, letter case, punctuation and field order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivora.session import materialize

#: A key is hot if it holds more than one part in so many of the rows of a task of the shuffle (or 1 / MAX_HOT of all rows, if
#: that is more). So at most MAX_HOT keys are hot and their table (48 bytes a key) may be sent to all executors.
TASK_SHARE = 32
MAX_HOT = 10_000
SALTS = 64


def reduced(text: Column) -> Column:
    """Letters and digits (of any alphabet) of a text in lower case; null gives ''."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def canonical_rows(df: DataFrame, id_col: str, fields: list[str], content: str) -> DataFrame:
    """(id, key) of the rows whose ``content`` field keeps a letter or digit. The key is the SHA-256 of the reduced
    fields in sorted order, joined by a sign that no reduced field can hold."""
    columns = {f"f{i}": reduced(F.col(f)) for i, f in enumerate(fields)}
    slim = df.select(F.col(id_col).cast("long").alias("id"), *[c.alias(k) for k, c in columns.items()])
    slim = slim.where(F.col("id").isNotNull() & (F.col(f"f{fields.index(content)}") != ""))
    joined = F.array_join(F.array_sort(F.array(*columns)), "\n")
    return slim.select("id", F.unhex(F.sha2(joined, 256)).alias("key"))


class FormatDuplicates:
    """Groups of rows that are equal but for formatting and the order of their fields.

    Keys are counted exactly (partial counts before the shuffle). Keys of at least ``hot_rows`` rows (by default a thirty-second of a task's) are hot; their
    groups are built in two levels, (key, salt) and then key, and their members are found by a broadcast of the at
    most ``MAX_HOT`` hot keys, with no shuffle of the members. All other groups take one shuffle by key.

    Defined cases: a null field counts as empty; rows whose content field keeps nothing, and rows with a null
    identifier, take no part; the representative is the smallest identifier; a row that comes twice counts
    twice in ``copies`` but is no copy of itself in :meth:`pairs`; an empty table gives no rows; other columns are ignored.
    """

    def __init__(self, df: DataFrame, id_col: str = "id", fields: tuple[str, ...] = ("title", "text"), content: str = "text", hot_rows: int | None = None):
        self.rows = materialize(canonical_rows(df, id_col, list(fields), content), "canonical")
        n, tasks = self.rows.count(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        least = max(n // (tasks * TASK_SHARE) if hot_rows is None else hot_rows, n // MAX_HOT + 1, 2)
        counts = self.rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        self.hot = materialize(counts.where(F.col("n") >= least).select("key"), "hot-keys")
        self.any_hot = bool(self.hot.head(1))

    def groups(self) -> DataFrame:
        """(first_id, copies): one row per distinct record, with the number of its rows."""
        least = [F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies")]
        if not self.any_hot:
            return self.rows.groupBy("key").agg(*least).drop("key")
        rest = self.rows.join(F.broadcast(self.hot), "key", "left_anti").groupBy("key").agg(*least)
        return rest.unionByName(self._hot_groups()).drop("key")

    def _hot_groups(self) -> DataFrame:
        members = self.rows.join(F.broadcast(self.hot), "key").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
        level = members.groupBy("key", "salt").agg(F.min("id").alias("m"), F.count(F.lit(1)).alias("c"))
        return level.groupBy("key").agg(F.min("m").alias("first_id"), F.sum("c").alias("copies"))

    def pairs(self) -> DataFrame:
        """(first_id, copy_id): the smallest identifier of each group with each other one."""
        rest = self.rows.join(F.broadcast(self.hot), "key", "left_anti") if self.any_hot else self.rows
        # A group that is not hot has fewer rows than a hot one, by which its set of identifiers is bounded.
        sets = rest.groupBy("key").agg(F.sort_array(F.collect_set("id")).alias("ids")).where(F.size("ids") > 1)
        found = sets.select(F.col("ids")[0].alias("first_id"), F.explode(F.slice("ids", 2, F.size("ids"))).alias("copy_id"))
        if self.any_hot:
            heads = materialize(self._hot_groups().select("key", "first_id"), "hot-heads")
            members = self.rows.join(F.broadcast(heads), "key").select("first_id", F.col("id").alias("copy_id"))
            found = found.unionByName(members.where(F.col("first_id") != F.col("copy_id")).distinct())
        return found
