"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivora.llm.contamination import LeakSearch
from scrivora.llm.distinctiveness import term_distinctiveness
from scrivora.llm.format_duplicates import FormatDuplicates
from scrivora.llm.language import LanguageIdentification
from scrivora.llm.mixing import SourceMix, vocabulary_token_count
from scrivora.llm.residue import template_residue
from scrivora.llm.similar_vectors import VectorIndex
from scrivora.llm.splitting import split_long
from scrivora.llm.term_frequency import mark_terms, term_frequencies
from scrivora.session import read_table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FormatDuplicates(read_table(spark, sf_dir, "articles")).pairs()


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FormatDuplicates(read_table(spark, sf_dir, "articles")).groups()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = read_table(spark, sf_dir, "articles")
    best = term_distinctiveness(articles, k1=float("inf"), b=0.0, smooth_idf=False, min_df=2, top_k=3)
    return best.select("id", "term").distinct()


def p2_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_distinctiveness(read_table(spark, sf_dir, "articles"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = VectorIndex(read_table(spark, sf_dir, "doc_vectors"))
    near = index.expand(index.neighbours(least=0.9, recall=1.0))
    return near.select(F.least("pos", "other").alias("doc_a"), F.greatest("pos", "other").alias("doc_b")).distinct()


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar of every position, however far they are."""
    index = VectorIndex(read_table(spark, sf_dir, "doc_vectors"))
    return index.expand(index.neighbours())


def p3_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "doc_vectors")
    return VectorIndex(vectors).search(vectors.where(F.col("doc_pos") % 100 == 0).select(F.col("doc_pos").alias("pos")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_frequencies(spark, sf_dir).where(F.col("mark").isNotNull()).select("term", "mark")


def p4_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = read_table(spark, sf_dir, "articles")
    return mark_terms(term_frequencies(articles), articles.count()).select("term", "occurrences", "records", "mark")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = split_long(read_table(spark, sf_dir, "articles"), with_text=False)
    forced = F.max((F.col("cut") == "forced").cast("int"))
    return pieces.groupBy("id").agg(F.when(forced == 1, "forced").otherwise("natural").alias("cut"))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_long(read_table(spark, sf_dir, "articles"))


def p5_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every text, the characters and the digest of its pieces put together again, and whether all keep to the limit and the overlap."""
    pieces = p5_pieces(spark, sf_dir)
    fresh = F.substr("piece", F.col("repeated") + 1)
    parts = F.sort_array(F.collect_list(F.struct("piece_no", fresh.alias("part"))))
    whole = pieces.groupBy("id").agg(F.array_join(F.transform(parts, lambda x: x["part"]), "").alias("text"), (F.max(F.length("piece")) <= 2000).alias("short"), F.max(F.col("repeated")).between(0, 200).alias("overlapping"))
    return whole.select("id", F.length("text").cast("long").alias("characters"), F.md5("text").alias("digest"), "short", "overlapping")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir).mislabelled()


def _languages(spark: SparkSession, sf_dir: str) -> LanguageIdentification:
    return LanguageIdentification(read_table(spark, sf_dir, "articles"), read_table(spark, sf_dir, "article_langs"))


def p6_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir).texts()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LeakSearch(read_table(spark, sf_dir, "eval_items")).search(read_table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).report().select("source", "fate")


def _mix(spark: SparkSession, sf_dir: str, **options) -> SourceMix:
    return SourceMix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"), **options)


def p8_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).selection()


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).report()


def p8_shares_bpe(spark: SparkSession, sf_dir: str, path: str = "/opt/tokenizers/byte_bpe_50k.tiktoken") -> DataFrame:
    from public_tokenizers import PATTERN

    return _mix(spark, sf_dir, size=vocabulary_token_count(path, PATTERN)).report()


def p8_seats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal-token blocks of every source by Sainte-Laguë."""
    return _mix(spark, sf_dir)._plan_frame().select("source", "seats")


def p8_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every target, whether the selection reaches the need or uses the source up, passes the need by no more than a document of each shard
    (and not at all if it is used up), and repeats a document no more than it must and may."""
    mix = _mix(spark, sf_dir)
    longest = mix.sized.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("tokens").alias("longest"))
    r = mix.report().join(longest, "source", "left").fillna(0, ["longest"])
    most = F.col("have") * F.col("max_repeats")
    reached = (F.col("selected") >= F.col("need")) | (F.col("selected") == most)
    close = F.col("selected") <= F.least(F.ceil("need") + F.lit(mix.shards) * F.col("longest"), most)
    seldom = F.col("most_copies") <= F.least("max_repeats", F.greatest(F.lit(1), F.ceil(F.col("need") / F.greatest("have", F.lit(1)))))
    return r.select("source", reached.alias("reached"), close.alias("close"), seldom.alias("seldom"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_residue(spark, sf_dir).select("doc_id").distinct()


def p9_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_residue(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found,
        "p1_groups": p1_groups,
        "p2_found": p2_found,
        "p2_scores": p2_scores,
        "p3_found": p3_found,
        "p3_neighbours": p3_neighbours,
        "p3_search": p3_search,
        "p4_found": p4_found,
        "p4_frequencies": p4_frequencies,
        "p5_found": p5_found,
        "p5_pieces": p5_pieces,
        "p5_whole": p5_whole,
        "p6_found": p6_found,
        "p6_languages": p6_languages,
        "p7_found": p7_found,
        "p7_leaks": p7_leaks,
        "p8_found": p8_found,
        "p8_selection": p8_selection,
        "p8_shares": p8_shares,
        "p8_seats": p8_seats,
        "p8_bounds": p8_bounds,
        "p8_shares_bpe": p8_shares_bpe,
        "p9_found": p9_found,
        "p9_residue": p9_residue,
    }
