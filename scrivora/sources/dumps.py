"""Marked-up dump files, word lists and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivora.functions.text import number_or_zero

#: A document of a dump file. Bodies that hold '<' don't match.
DOC = r'<doc id="(\d+)" url="(https?://[^"]+)" title="([^"]+)">([^<]+)</doc>'
REQUEST = "query string, limit int, method int, k int"


def parse_dump(files: DataFrame, text_col: str = "value") -> DataFrame:
    """(id, title, url, text) of all documents in whole-file texts. An id that is no 32-bit number becomes 0; null and
    empty files give no rows."""
    hit = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(DOC), F.lit(0))).alias("doc")
    part = [F.regexp_extract("doc", DOC, i) for i in range(1, 5)]
    return files.select(hit).select(number_or_zero(part[0]).cast("long").alias("id"), part[2].alias("title"), part[1].alias("url"), part[3].alias("text"))


def read_dumps(spark: SparkSession, paths: list[str], ignore_missing: bool = True) -> DataFrame:
    """Documents of all dump files under glob patterns. A file that can't be read ends the job with its name; a file that is no
    UTF-8 gives no documents and is named by :func:`dump_files`."""
    return parse_dump(_dump_texts(spark, paths, ignore_missing))


def _dump_texts(spark: SparkSession, paths: list[str], ignore_missing: bool = True) -> DataFrame:
    files = spark.read.option("ignoreMissingFiles", str(ignore_missing).lower()).option("wholetext", "true").format("text").load(paths)
    return files.select(F.col("_metadata.file_path").alias("path"), F.try_validate_utf8("value").alias("value"))


def dump_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(folder, file, readable, documents) of every dump file: what was read from where, and what was not."""
    files = _dump_texts(spark, paths)
    n = F.coalesce(F.size(F.regexp_extract_all("value", F.lit(DOC), F.lit(0))), F.lit(0)).cast("long")
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("file"), F.col("value").isNotNull().alias("readable"), F.when(F.col("value").isNull(), 0).otherwise(n).cast("long").alias("documents"))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    return word_list(spark.read.text(path), "value")


def word_list(lines: DataFrame, column: str = "word") -> DataFrame:
    """The distinct trimmed lines that are not empty. Letter case stays."""
    return lines.select(F.trim(column).alias("word")).where(F.col("word") != "").distinct()


def parse_requests(lines: DataFrame, column: str = "value") -> DataFrame:
    """Search requests from JSON bodies; fields may be missing. A body that is no JSON gives nulls only."""
    return lines.select(F.from_json(F.col(column), REQUEST).alias("r")).select("r.query", "r.limit", "r.method", "r.k")


def parse_extracts(lines: DataFrame, column: str = "value") -> DataFrame:
    """(title, content) from the JSON answers of a page-extract interface; pages without an extract are dropped."""
    schema = "query struct<pages:map<string,struct<title:string,extract:string>>>"
    pages = lines.select(F.explode(F.map_values(F.from_json(F.col(column), schema)["query"]["pages"])).alias("p"))
    return pages.select("p.title", F.col("p.extract").alias("content")).where(F.col("content") != "")


def parse_titles(lines: DataFrame, column: str = "value", limit: int | None = None) -> DataFrame:
    """Titles from the JSON answers of a page-list interface."""
    schema = "query struct<allpages:array<struct<pageid:bigint,title:string>>>"
    titles = lines.select(F.explode(F.from_json(F.col(column), schema)["query"]["allpages"]["title"]).alias("title"))
    return titles if limit is None else titles.limit(limit)


def resume(stored: int, target: int, slack: int = 10_000) -> int:
    """How many titles to take up so that ``target`` articles are stored; 0 at the target."""
    return 0 if stored >= target else target - stored + slack


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def json_column(*columns: Column) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
