"""Ranked retrieval over a text index."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivora.functions.stem import stem_words
from scrivora.functions.text import DEFAULT_LIMIT, DEFAULT_METHOD, METHODS, tokenize
from scrivora.operators.index import TextIndex
from scrivora.operators.skew import HOT_ROWS, hot_keys, join_salted
from scrivora.session import materialize

DECIMALS = 6
#: Result rows that are gathered on the driver by a single-query search, at most.
DRIVER_LIMIT = 1000


def query_terms(queries: DataFrame, mode: str = "raw", query_col: str = "query") -> DataFrame:
    """(query_id, term, n) from (query_id, query). ``raw`` keeps the tokens as they are, so an inflected query word misses its
    stemmed term; ``stemmed`` treats queries like documents. Null and blank queries have no terms."""
    words = queries.select("query_id", F.explode(tokenize(F.col(query_col))).alias("term"))
    if mode == "stemmed":
        stems = stem_words(words.select("term").distinct(), "term")
        words = words.join(stems, words["term"] == stems["word"]).select("query_id", F.col("stem").alias("term"))
    elif mode != "raw":
        raise ValueError(f"unknown mode {mode}")
    return words.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("n"))


def query_vectors(queries: DataFrame, terms: DataFrame, mode: str = "raw") -> DataFrame:
    """(query_id, term, weight): counts times idf, divided by the norm if that is more than 0. Unknown words are dropped."""
    known = query_terms(queries, mode).join(terms.select("term", "idf"), "term").withColumn("weight", F.col("n") * F.col("idf"))
    size = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("query_id")))
    return known.withColumn("_norm", size).select("query_id", "term", F.when(F.col("_norm") > 0, F.col("weight") / F.col("_norm")).otherwise(F.lit(0.0)).alias("weight"))


def one_query(index: TextIndex, text: str) -> DataFrame:
    return index.documents.sparkSession.createDataFrame([(0, text)], "query_id long, query string")


def raw_query_vectors(queries: DataFrame, mode: str = "raw") -> DataFrame:
    """(query_id, term, weight) with plain counts, for an index without idf."""
    return query_terms(queries, mode).select("query_id", "term", F.col("n").cast("double").alias("weight"))


def scores(vectors: DataFrame, postings: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score): inner products of queries and documents that share a term. Terms of weight 0 are not looked up; the postings of
    ``hot`` terms are split."""
    asked = vectors.where(F.col("weight") != 0).select("query_id", "term", F.col("weight").alias("asked"))
    return join_salted(postings, asked, "term", hot).groupBy("query_id", "id").agg(F.round(F.sum(F.col("asked") * F.col("weight")), DECIMALS).alias("score"))


def top_documents(index: TextIndex, text: str, limit: int = DEFAULT_LIMIT, mode: str = "raw", raw: bool = False) -> DataFrame:
    """(score, title, url, id, text) of the best documents for one query; documents without a query word have score 0 and fill up
    the list, ties by identifier.

    The words of the query are looked up as literals, so that a stored index reads only row groups that hold them. At most
    ``limit`` (identifier, score) pairs reach the driver; only these rows meet the documents' columns. A limit of more than
    :data:`DRIVER_LIMIT` is answered by joins alone.
    """
    if limit > DRIVER_LIMIT:
        return _top_by_joins(index, text, limit, mode, raw)
    asked = _asked(index, text, mode, raw)
    best: dict[int, float] = {}
    if asked and limit > 0:
        weight = F.coalesce(*[F.when(F.col("term") == t, F.lit(w)) for t, w in asked.items()])
        found = index.postings.where(F.col("term").isin(list(asked))).groupBy("id").agg(F.round(F.sum(weight * F.col("weight")), DECIMALS).alias("score"))
        best = {r["id"]: r["score"] for r in found.where(F.col("score") > 0).orderBy(F.desc("score"), "id").limit(limit).collect()}
    if len(best) < limit:
        # Fewer than wanted have a score, so these are all of them.
        rest = index.documents.select("id").where(~F.col("id").isin(list(best))).orderBy("id").limit(limit - len(best))
        best |= {r["id"]: 0.0 for r in rest.collect()}
    score = F.coalesce(*[F.when(F.col("id") == i, F.lit(s)) for i, s in best.items()], F.lit(0.0))
    return index.documents.where(F.col("id").isin(list(best))).select(score.alias("score"), "title", "url", "id", "text").orderBy(F.desc("score"), "id")


def _asked(index: TextIndex, text: str, mode: str, raw: bool) -> dict[str, float]:
    """The query's terms with their weights that are not 0."""
    spark = index.documents.sparkSession
    if mode == "raw":
        # A literal over a local row: cut by the optimizer, without a job.
        counts = dict(Counter(spark.sql("VALUES (1)").select(tokenize(F.lit(text))).head()[0]))
    else:
        counts = {r["term"]: r["n"] for r in query_terms(one_query(index, text), mode).collect()}
    if raw:
        return {t: float(n) for t, n in counts.items()}
    idf = {r["term"]: r["idf"] for r in index.terms.where(F.col("term").isin(list(counts))).select("term", "idf").collect()} if counts else {}
    weights = {t: counts[t] * i for t, i in idf.items()}
    size = sum(w * w for w in weights.values()) ** 0.5
    return {t: w / size for t, w in weights.items() if w}


def _top_by_joins(index: TextIndex, text: str, limit: int, mode: str, raw: bool) -> DataFrame:
    queries = one_query(index, text)
    vectors = raw_query_vectors(queries, mode) if raw else query_vectors(queries, index.terms, mode)
    found = scores(vectors, index.postings).select("id", "score")
    full = index.documents.select("id").join(found, "id", "left").fillna(0.0, ["score"])
    return with_documents(full.orderBy(F.desc("score"), "id").limit(limit), index.documents, limit)


def with_documents(best: DataFrame, documents: DataFrame, limit: int) -> DataFrame:
    """The best rows with their documents' columns, best first. Up to :data:`DRIVER_LIMIT` rows are broadcast; more are joined by shuffle."""
    best = F.broadcast(best) if limit <= DRIVER_LIMIT else best
    return documents.join(best, "id").select("score", "title", "url", "id", "text").orderBy(F.desc("score"), "id")


def top_documents_batch(index: TextIndex, queries: DataFrame, mode: str = "raw", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(query_id, rank, id, score) for many queries, each with its own ``row_limit`` (null: the default). Only documents that share a
    term with a query are ranked for it.

    Queries of the same words in any order, case and spacing are scored once, for the largest of their limits; the result is handed to
    each of them. A query that very many ask for gets its result by broadcast: such queries are counted exactly, and each has at
    least ``hot_rows`` requests and a ten-thousandth of all. The rank is limited before the shuffle.
    """
    words = F.array_join(F.array_sort(tokenize(F.col("query"))), " ")
    asked = materialize(queries.select("query_id", words.alias("query"), F.coalesce("row_limit", F.lit(DEFAULT_LIMIT)).alias("row_limit")).where(F.col("query") != ""), "requests")
    kinds = asked.groupBy("query").agg(F.max("row_limit").alias("most"), F.count(F.lit(1)).alias("n"))
    kinds = materialize(kinds.withColumn("query_id", F.col("query")), "queries")
    found = scores(query_vectors(kinds, index.terms, mode), index.postings, index.hot()).where(F.col("score") > 0)
    most = kinds.agg(F.max("most")).head()[0] or 0
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= int(most))
    lists = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("rows"))
    full = join_salted(asked, lists.withColumnRenamed("query_id", "query"), "query", hot_keys(kinds, "query", "n", hot_rows), "query_id")
    out = full.select("query_id", "row_limit", F.explode("rows").alias("r"))
    return out.where(F.col("r.rank") <= F.col("row_limit")).select("query_id", "r.rank", "r.id", "r.score")


def mean_normalized(results: DataFrame, by: str = "query_id", score: str = "score") -> DataFrame:
    """``results`` with each score divided by the mean of its query's scores; null where that mean is 0."""
    mean = F.avg(score).over(Window.partitionBy(by))
    return results.withColumn("relative_score", F.round(F.when(mean != 0, F.col(score) / mean), DECIMALS))


def defaulted(log: DataFrame) -> DataFrame:
    """Requests with defaults for a null limit and method; blank queries are dropped as they are never sent."""
    asked = log.where(F.trim("query") != "")
    return asked.withColumn("row_limit", F.coalesce("row_limit", F.lit(DEFAULT_LIMIT))).withColumn("method_code", F.coalesce("method_code", F.lit(DEFAULT_METHOD)))


def known_method(code: Column) -> Column:
    return code.isin(*METHODS)


def search(index: TextIndex, text: str, limit: int = DEFAULT_LIMIT, method: int = DEFAULT_METHOD, k: int = 25, factors=None, mode: str = "raw") -> DataFrame:
    """Search by method code: 2 TF-IDF, 3 latent vectors, 4 latent vectors cut to rank ``k``. A blank query or an
    unknown method is an error; methods 3 and 4 need ``factors``."""
    if not text or not text.strip():
        raise ValueError("the query is blank")
    if method == 2:
        return top_documents(index, text, limit, mode)
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    if factors is None:
        raise ValueError("this method needs factors")
    return factors.search(index, text, limit, None if method == 3 else k, mode)
