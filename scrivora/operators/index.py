"""The text index in long form: terms, postings and weights."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivora.functions.ascii_terms import slices, term_counts
from scrivora.functions.stem import stem_words
from scrivora.functions.text import RANKS, index_folder, snippet, title_and_text, titled, tokenize, tokenize_blanks
from scrivora.operators.numbering import number_rows
from scrivora.operators.skew import hot_keys, join_salted
from scrivora.session import materialize, release
from scrivora.sources.articles import exists


def tokens(df: DataFrame, text: Column | None = None, id_col: str = "id", cut=tokenize) -> DataFrame:
    """(id, token), one row per token."""
    return df.select(F.col(id_col).alias("id"), F.explode(cut(F.col("text") if text is None else text)).alias("token"))


def token_counts(df: DataFrame) -> DataFrame:
    """(id, token, n): the tokens of each row's text with their numbers, as :func:`tokens` cuts them, but whole Arrow columns at once
    and without a shuffle; an identifier that is repeated has rows for each of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                terms, rows, places, counts = term_counts(part.column("text"))
                yield pa.record_batch([part.column("id").take(pa.array(rows)), terms.take(pa.array(places)), pa.array(counts, pa.int64())], names=["id", "token", "n"])

    return df.select("id", "text").mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, token string, n long")


def without_stop_words(df: DataFrame, stop_words: DataFrame | None, column: str = "token") -> DataFrame:
    """Rows whose token is no stop word. The list is a fixed file; Spark's own size check decides whether it is broadcast."""
    return df if stop_words is None else df.join(stop_words.select(F.col("word").alias(column)).distinct(), column, "left_anti")


def stemmed_vocabulary(cut: DataFrame, stop_words: DataFrame | None = None) -> DataFrame:
    """(word, stem) of the distinct tokens in ``cut`` that are no stop words, written once so that stemming is done once per word."""
    words = without_stop_words(cut.select("token").distinct(), stop_words)
    # Few bytes but much work per word: kept apart from the rule that joins small partitions.
    n = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(stem_words(words.repartition(n, "token"), "token"), "stems")


def term_frequencies(df: DataFrame, stop_words: DataFrame | None = None, vocabulary: DataFrame | None = None) -> DataFrame:
    """(id, term, tf): how often each stemmed term occurs in each document. Tokens are counted per document before
    they meet their stems, so a frequent word costs one row per document; the counts are written, so texts are read once."""
    counts = materialize(token_counts(df), "counts")
    vocabulary = stemmed_vocabulary(counts, stop_words) if vocabulary is None else vocabulary
    return counts.join(vocabulary, counts["token"] == vocabulary["word"]).groupBy("id", F.col("stem").alias("term")).agg(F.sum("n").cast("double").alias("tf"))


def relative_frequencies(df: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """(id, term, tf) with tf relative to the document's tokens that are in the vocabulary; title and text, cut at white space."""
    all_tokens = tokens(df, title_and_text(F.col("title"), F.col("text")), cut=tokenize_blanks)
    counts = all_tokens.groupBy("id", F.col("token").alias("term")).agg(F.count(F.lit(1)).alias("n"))
    if vocabulary is not None:
        counts = counts.join(vocabulary.select("term").distinct(), "term", "left_semi")
    return counts.select("id", "term", (F.col("n") / F.sum("n").over(Window.partitionBy("id"))).alias("tf"))


def document_frequencies(frequencies: DataFrame) -> DataFrame:
    """(term, df) from one row per document and term."""
    return frequencies.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def inverse_frequencies(df: DataFrame, documents: int) -> DataFrame:
    """(term, df, idf) with idf = ln(documents / df), 0 for df = 0. All documents count, those without terms too."""
    return df.withColumn("idf", F.when(F.col("df") > 0, F.log(F.lit(float(documents)) / F.col("df"))).otherwise(F.lit(0.0)))


def weighted(frequencies: DataFrame, idf: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """(id, term, tf, weight) with weight = tf * idf; terms of all documents keep their weight 0. ``hot`` are the terms of so many documents that
    their rows are split (:func:`~scrivora.operators.skew.hot_keys`)."""
    return join_salted(frequencies, idf.select("term", "idf"), "term", hot).select("id", "term", "tf", (F.col("tf") * F.col("idf")).alias("weight"))


def norms(weights: DataFrame) -> DataFrame:
    return weights.groupBy("id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))


def normalized(weights: DataFrame) -> DataFrame:
    """Weights divided by the norm of their document; documents of norm 0 are left out."""
    size = norms(weights).where(F.col("norm") > 0)
    return weights.join(size, "id").withColumn("weight", F.col("weight") / F.col("norm")).drop("norm")


def summed_entries(entries: DataFrame) -> DataFrame:
    """A sparse matrix from triplets (i, j, value): entries of one place are added."""
    return entries.groupBy("i", "j").agg(F.sum("value").alias("value"))


def vocabulary(df: DataFrame, stop_words: DataFrame | None = None) -> DataFrame:
    """(term_id, term), numbered by first appearance in document and token order."""
    placed = df.select("id", F.posexplode(tokenize(F.col("text"))).alias("place", "token"))
    first = materialize(placed.groupBy("token").agg(F.min(F.struct("id", "place")).alias("first")), "first-seen")
    stems = stemmed_vocabulary(first, stop_words)
    terms = first.join(stems, first["token"] == stems["word"]).groupBy(F.col("stem").alias("term")).agg(F.min("first").alias("first"))
    numbered = number_rows(terms.select("term", F.col("first.id").alias("_id"), F.col("first.place").alias("_place")), ["_id", "_place", "term"], "term_id")
    return numbered.select("term_id", "term")


@dataclass
class TextIndex:
    """Documents, terms and normalised weights. ``weighting`` is ``tfidf`` or ``tf`` (raw counts, not normalised)."""

    documents: DataFrame
    terms: DataFrame
    postings: DataFrame
    ranks: tuple[int, ...] = ()

    @staticmethod
    def build(documents: DataFrame, stop_words: DataFrame | None = None, weighting: str = "tfidf", relative: bool = False) -> TextIndex:
        """Null texts count as empty; documents need distinct identifiers; extra columns are ignored."""
        documents = documents.select("id", "title", "url", "text")
        found = relative_frequencies(documents) if relative else term_frequencies(documents, stop_words)
        frequencies = materialize(found, "frequencies")
        terms = inverse_frequencies(document_frequencies(frequencies), documents.count())
        if weighting == "tf":
            return TextIndex(documents, terms, frequencies.withColumn("weight", F.col("tf")))
        if weighting != "tfidf":
            raise ValueError(f"unknown weighting {weighting}")
        terms = materialize(terms, "terms")
        weights = materialize(weighted(frequencies, terms, hot_keys(terms, "term", "df")), "weights")
        release(frequencies)
        return TextIndex(documents, terms, normalized(weights))

    @staticmethod
    def of(documents: DataFrame, frequencies: DataFrame, count: int | None = None) -> TextIndex:
        """An index over given (id, term, tf), for example of a stated vocabulary."""
        terms = materialize(inverse_frequencies(document_frequencies(frequencies), documents.count() if count is None else count), "terms")
        return TextIndex(documents, terms, normalized(materialize(weighted(frequencies, terms, hot_keys(terms, "term", "df")), "weights")))

    def hot(self) -> DataFrame | None:
        """The terms of so many documents that joins on the term split their postings."""
        return hot_keys(self.terms, "term", "df")

    def save(self, path: str) -> None:
        """Write the index as Parquet, postings split by range of terms and sorted, so that a search reads few row groups."""
        self.documents.write.mode("overwrite").parquet(f"{path}/documents")
        self.terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        self.postings.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TextIndex:
        read = {name: spark.read.parquet(f"{path}/{name}") for name in ("documents", "terms", "postings")}
        return TextIndex(**read, ranks=tuple(k for k in RANKS if exists(spark, f"{path}/{index_folder(k)}/sigma")))

    @staticmethod
    def load_or_build(spark: SparkSession, path: str, documents: DataFrame, stop_words: DataFrame | None = None) -> TextIndex:
        if not exists(spark, f"{path}/postings"):
            TextIndex.build(documents, stop_words).save(path)
        return TextIndex.load(spark, path)

    def stats(self) -> DataFrame:
        """(document_count, vocabulary_size, available_k_values)"""
        counts = self.documents.agg(F.count(F.lit(1)).alias("document_count")).crossJoin(self.terms.agg(F.count(F.lit(1)).alias("vocabulary_size")))
        ranks = F.array(*map(F.lit, self.ranks)) if self.ranks else F.expr("cast(array() as array<int>)")
        return counts.withColumn("available_k_values", ranks)

    def document(self, id: int) -> DataFrame:
        """The document with an identifier, with a score of 0; no row if there is none."""
        return self.documents.where(F.col("id") == id).select(F.lit(0.0).alias("score"), "title", "url", "id", "text").limit(1)


def cards(results: DataFrame) -> DataFrame:
    """Results as shown: title, score to four decimals, the begin of the text."""
    return results.select("id", titled(F.col("title")).alias("title"), F.format_string("%.4f", "score").alias("score"), snippet(F.col("text")).alias("snippet"))
