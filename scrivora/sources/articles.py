"""Article tables: schemas, scans and idempotent appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrivora.session import spread

ARTICLES = T.StructType([T.StructField("id", T.LongType()), T.StructField("title", T.StringType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])
TERMS = T.StructType([T.StructField("term", T.StringType()), T.StructField("df", T.LongType()), T.StructField("idf", T.DoubleType())])
POSTINGS = T.StructType([T.StructField("id", T.LongType()), T.StructField("term", T.StringType()), T.StructField("tf", T.DoubleType()), T.StructField("weight", T.DoubleType())])


def scan_articles(spark: SparkSession, path: str) -> DataFrame:
    """The four article columns of a Parquet table; only these are read."""
    return spread(spark.read.parquet(path).select("id", "title", "url", "text"))


def scan_database(spark: SparkSession, url: str, table: str = "articles", driver: str = "org.sqlite.JDBC", bounds: tuple[int, int, int] | None = None) -> DataFrame:
    """The article columns of a database table; needs the driver's jar. ``bounds`` (least id, largest id, parts) reads in parallel."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, driver=driver)
    if bounds:
        reader = reader.options(partitionColumn="id", lowerBound=bounds[0], upperBound=bounds[1], numPartitions=bounds[2])
    return reader.load().select("id", "title", "url", "text")


def first_per_key(df: DataFrame, key: str, order: str = "id") -> DataFrame:
    """One row per non-null key, that of the least ``order``; rows with a null key all stay, as under a unique constraint.

    The row number has a limit that is applied before the shuffle, so a key shared by very many rows is not gathered in one task.
    """
    first = Window.partitionBy(key).orderBy(F.asc_nulls_last(order))
    known = df.where(F.col(key).isNotNull()).withColumn("_place", F.row_number().over(first)).where(F.col("_place") == 1).drop("_place")
    return known.unionByName(df.where(F.col(key).isNull()))


def new_rows(stored: DataFrame, arriving: DataFrame, key: str, order: str = "id") -> DataFrame:
    """The rows an insert would add that ignores keys which are stored or came before."""
    arriving = first_per_key(arriving, key, order)
    known = stored.select(F.col(key).alias("_key")).where(F.col("_key").isNotNull()).distinct()
    return arriving.join(known, arriving[key] == known["_key"], "left_anti")


def append_new(spark: SparkSession, path: str, arriving: DataFrame, key: str, schema: T.StructType = ARTICLES) -> int:
    """Append the new rows to the table at ``path``, which is made if missing; the number of rows added."""
    create_if_missing(spark, path, schema)
    rows = new_rows(spark.read.schema(schema).parquet(path), arriving, key).select(*schema.names)
    seen = F.count(F.lit(1)).alias("n")
    from pyspark.sql import Observation

    counted = Observation()
    rows.observe(counted, seen).write.mode("append").parquet(path)
    return int(counted.get["n"])


def create_if_missing(spark: SparkSession, path: str, schema: T.StructType = ARTICLES) -> bool:
    """Make an empty table at ``path`` if there is none; whether one was made."""
    if exists(spark, path):
        return False
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return True


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def long_enough(df: DataFrame, least: int = 150) -> DataFrame:
    return df.where(F.length("text") >= least)


def complete(df: DataFrame) -> DataFrame:
    """Rows with a title and a text that is not empty."""
    return df.where(F.col("title").isNotNull() & (F.col("text") != ""))


def with_content(df: DataFrame, column: str = "content") -> DataFrame:
    return df.where(F.col(column) != "")
