"""Registered queries of the engine's own operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivora.functions.stem import stem_words
from scrivora.functions.text import clock, fixed, index_name, method_name, rank_bucket, titled, tokenize, tokenize_blanks
from scrivora.functions.vectors import dot
from scrivora.operators import index as ix
from scrivora.operators.crawl import outcomes, progress
from scrivora.operators.factors import Factors, column_products, gram_matrix, latent_neighbours, matvec, power_factors, residuals, rmatvec, vector_norms
from scrivora.operators.numbering import number_rows
from scrivora.operators.search import DECIMALS, defaulted, known_method, mean_normalized, one_query, query_vectors, search, top_documents, top_documents_batch
from scrivora.session import materialize, read_table, scratch_path
from scrivora.sources import articles as art
from scrivora.sources.dumps import as_json, dump_files, json_column, parse_dump, parse_extracts, parse_requests, parse_titles, read_dumps, resume, word_list
from scrivora.sources.pages import paragraphs, parse_pages
from scrivora.streaming.ingest import ingest_pages, outcome_counts, page_stream

Query = Callable[[SparkSession, str], DataFrame]

#: Texts of the single-query searches: raw words that are their own stems, inflected words, and words found nowhere.
PLAIN, INFLECTED, UNKNOWN = "church tower old river", "ancient villages measured castles", "zzzunknown qqqabsent"

#: The vocabulary of the small factorisation, whose exact result SQL can state.
WORDS = ("church", "tower", "old", "river", "villag", "vallei", "castl", "bridg")


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return art.scan_articles(spark, f"{sf_dir}/articles.parquet")


def _stop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_list(read_table(spark, sf_dir, "stop_words"))


def _index(spark: SparkSession, sf_dir: str, **options) -> ix.TextIndex:
    return ix.TextIndex.build(_articles(spark, sf_dir), _stop_words(spark, sf_dir), **options)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, DECIMALS) for c in columns})


# Sources, sinks and filters


def scan_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _articles(spark, sf_dir)


def parse_dump_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = [F.regexp_replace(c, r'[<"]', "") for c in ("url", "title", "text")]
    line = F.format_string('<doc id="%d" url="%s" title="%s">%s</doc>', "id", *bare)
    files = _articles(spark, sf_dir).where(F.col("url").isNotNull() & F.col("title").isNotNull() & F.col("text").isNotNull()).select(line.alias("value"))
    return parse_dump(files)


def dump_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles as dump files in three folders, read back."""
    path = _dumped(spark, sf_dir)
    return read_dumps(spark, [f"{path}/folder={name}/*" for name in ("AA", "AB", "AC")])


def dump_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = dump_files(spark, [f"{_dumped(spark, sf_dir)}/*/*"])
    return files.groupBy("folder").agg(F.min("readable").alias("readable"), F.sum("documents").alias("documents"))


def _dumped(spark: SparkSession, sf_dir: str) -> str:
    bare = [F.regexp_replace(c, r'[<"]', "") for c in ("url", "title", "text")]
    line = F.format_string('<doc id="%d" url="%s" title="%s">%s</doc>', "id", *bare)
    folder = F.element_at(F.array(*map(F.lit, ("AA", "AB", "AC"))), (F.col("id") % 3 + 1).cast("int"))
    path = scratch_path(spark, "dumps")
    kept = _articles(spark, sf_dir).where(F.col("url").isNotNull() & F.col("title").isNotNull() & F.col("text").isNotNull())
    kept.select(folder.alias("folder"), line.alias("value")).write.partitionBy("folder").text(path)
    return path


def _html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, url, html): the articles as pages."""

    def escaped(c):
        return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    body = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda p: F.concat(F.lit("<p>"), escaped(p), F.lit("</p>"))), "")
    heading = F.coalesce(F.concat(F.lit('<h1 id="firstHeading"><span>'), escaped(F.col("title")), F.lit("</span></h1>")), F.lit(""))
    html = F.concat(F.lit("<html><head><script>var p = '</p>';</script></head><body>"), heading, F.lit('<div class="mw-parser-output x">'), body, F.lit("<div><p>nested</p></div></div></body></html>"))
    return _articles(spark, sf_dir).select("id", "url", html.alias("html"))


def extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_pages(_html(spark, sf_dir))


def stream_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, n) of what a stream of the pages stores, the same files arriving a second time. Which of the pages of one url is stored depends on
    the order of arrival, so they are counted."""
    pages, target = scratch_path(spark, "arriving"), scratch_path(spark, "stored")
    _html(spark, sf_dir).where(F.col("url").isNotNull()).repartition(4, "id").write.parquet(pages)
    for turn in range(2):
        ingest_pages(page_stream(spark, pages, 2), target, scratch_path(spark, "marks")).awaitTermination()
    return spark.read.parquet(target).groupBy("url").agg(F.count(F.lit(1)).alias("n"))


def stream_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts per outcome and hour from the crawl log as a stream that comes in one piece; the hours of its last day are still open and not given."""
    log = read_table(spark, sf_dir, "crawl_log").select("fetch_id", "outcome", F.col("fetched_at").cast("timestamp").alias("fetched_at"))
    arriving, target = scratch_path(spark, "log"), scratch_path(spark, "outcomes")
    log.coalesce(1).write.parquet(arriving)
    counts = outcome_counts(spark.readStream.schema(log.schema).parquet(arriving), lateness="1 day")
    counts.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", scratch_path(spark, "marks")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(target)


def append_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after three appends that ignore known urls: even ids, all, and all again."""
    path, rows = scratch_path(spark, "table"), _articles(spark, sf_dir).where(F.col("url").isNotNull())
    added = [art.append_new(spark, path, part, "url") for part in (rows.where("id % 2 = 0"), rows, rows)]
    return spark.read.parquet(path).select("id", "url").withColumn("added_last", F.lit(added[-1]))


def numbered_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of the articles in the order of their identifiers."""
    return number_rows(_articles(spark, sf_dir).select("id"), ["id"], "doc_pos").select("id", F.col("doc_pos").cast("long").alias("doc_pos"))


def parse_api_extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.create_map(F.col("id").cast("string"), F.struct("title", F.col("text").alias("extract")))
    return parse_extracts(_articles(spark, sf_dir).select(json_column(F.struct(page.alias("pages")).alias("query")).alias("value")))


def parse_api_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles from answers of up to a hundred pages each."""
    pages = F.collect_list(F.struct(F.col("id").alias("pageid"), "title")).alias("allpages")
    answers = _articles(spark, sf_dir).groupBy(F.expr("id div 100")).agg(pages)
    return parse_titles(answers.select(json_column(F.struct("allpages").alias("query")).alias("value")))


def insert_or_ignore_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return art.first_per_key(_articles(spark, sf_dir), "url").select("id", "url")


def insert_new_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is added when all rows with an even id are stored and the others arrive."""
    rows = _articles(spark, sf_dir).select("id", "title", "text")
    return art.new_rows(rows.where("id % 2 = 0"), art.with_content(rows.where("id % 2 = 1"), "text"), "title").select("id", "title")


def drop_short_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return art.long_enough(_articles(spark, sf_dir)).select("id", F.length("text").alias("size"))


def complete_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return art.complete(_articles(spark, sf_dir)).select("id", "title")


def nonblank_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _articles(spark, sf_dir).where(F.col("text").isNotNull()).select("id", paragraphs().alias("text"))


def stop_word_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stop_words(spark, sf_dir)


def results_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_json(_articles(spark, sf_dir).select("id", "title", "url"))


def requests_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read_table(spark, sf_dir, "search_log")
    lines = log.select("search_id", json_column(F.col("query"), F.col("row_limit").alias("limit"), F.col("method_code").alias("method")).alias("value"))
    return parse_requests(lines).groupBy("limit", "method").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("query").alias("queries"))


# Analysis


def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = tokenize(F.col("text"))
    return _articles(spark, sf_dir).select("id", F.size(cut).cast("long").alias("tokens"), F.size(F.array_distinct(cut)).cast("long").alias("words"))


def tokenize_blank_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = tokenize_blanks(F.concat_ws(" ", "title", "text"))
    return _articles(spark, sf_dir).select("id", F.size(cut).cast("long").alias("tokens"), F.size(F.array_distinct(cut)).cast("long").alias("words"))


def stopword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ix.without_stop_words(ix.tokens(_articles(spark, sf_dir)), _stop_words(spark, sf_dir))
    return kept.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def porter_stem_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stem_words(ix.tokens(_articles(spark, sf_dir)).select("token").distinct(), "token")


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.vocabulary(_articles(spark, sf_dir), _stop_words(spark, sf_dir))


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).stats().withColumn("available_k_values", F.array_join("available_k_values", ","))


# Weights


def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.term_frequencies(_articles(spark, sf_dir), _stop_words(spark, sf_dir))


def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.document_frequencies(term_frequency(spark, sf_dir))


def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_index(spark, sf_dir).terms, "idf")


def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_weighted(spark, sf_dir), "weight")


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _index(spark, sf_dir, weighting="tf")
    return ix.weighted(raw.postings, raw.terms)


def doc_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ix.norms(_weighted(spark, sf_dir)), "norm")


def tfidf_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_index(spark, sf_dir).postings.select("id", "term", "weight"), "weight")


def tf_relative_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_index(spark, sf_dir, relative=True).postings.select("id", "term", "weight"), "weight")


def summed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetches per article and outcome as triplets with repeated places."""
    log = read_table(spark, sf_dir, "crawl_log").where(F.col("article_id").isNotNull())
    return ix.summed_entries(log.select(F.col("article_id").alias("i"), F.col("outcome").alias("j"), F.lit(1.0).alias("value")))


# Search


def query_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    return _rounded(query_vectors(one_query(index, f"{PLAIN} river"), index.terms).select("term", "weight"), "weight")


def search_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_documents(_index(spark, sf_dir), PLAIN)


def search_tfidf_raw_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_documents(_index(spark, sf_dir), INFLECTED)


def search_tfidf_stemmed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_documents(_index(spark, sf_dir), INFLECTED, mode="stemmed")


def search_no_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_documents(_index(spark, sf_dir), UNKNOWN, limit=5)


def search_raw_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_documents(_index(spark, sf_dir, weighting="tf"), PLAIN, raw=True)


def search_tf_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_documents(_index(spark, sf_dir, relative=True), INFLECTED)


def _logged_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with an identifier divisible by 100, once each, with defaults."""
    log = read_table(spark, sf_dir, "search_log").where(F.col("search_id") % 100 == 0).dropDuplicates(["search_id"])
    return defaulted(log).select(F.col("search_id").alias("query_id"), "query", "row_limit")


def search_batch_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_documents_batch(_index(spark, sf_dir), _logged_queries(spark, sf_dir), "stemmed")


def score_mean_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = search_batch_ranked(spark, sf_dir).where(F.col("rank") <= 5)
    return mean_normalized(top).select("query_id", "rank", "id", "relative_score")


def result_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.cards(_articles(spark, sf_dir).withColumn("score", F.length("text") / F.lit(10000.0)).fillna(0.0, ["score"]))


def document_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ix.TextIndex(_articles(spark, sf_dir), None, None)
    return index.document(16).select("id", titled(F.col("title")).alias("title"), fixed(F.col("score")).alias("score"), F.coalesce(F.nullif("text", F.lit("")), F.lit("No content available")).alias("text"))


def leading_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest stored singular values."""
    return read_table(spark, sf_dir, "sigma").orderBy(F.desc("sigma"), "i").limit(5)


def document_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ix.TextIndex(_articles(spark, sf_dir), None, None)
    return index.document(103)


def request_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = defaulted(read_table(spark, sf_dir, "search_log"))
    named = asked.select("row_limit", method_name(F.col("method_code")).alias("method"), known_method(F.col("method_code")).alias("known"))
    return named.groupBy("row_limit", "method", "known").agg(F.count(F.lit(1)).alias("n"))


def k_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("i") + 1).cast("int")
    return read_table(spark, sf_dir, "sigma").select(k.alias("k"), rank_bucket(k).alias("bucket"), index_name(rank_bucket(k)).alias("name"))


def crawl_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(read_table(spark, sf_dir, "crawl_log"))


def crawl_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress(read_table(spark, sf_dir, "crawl_log"), 300_000)


def crawl_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many articles are stored, and how many titles to take up for 50,000."""
    stored = read_table(spark, sf_dir, "crawl_log").where("outcome = 'saved'").agg(F.countDistinct("article_id")).head()[0]
    return spark.createDataFrame([(stored, resume(stored, 50_000))], "stored long, needed int")


def fetch_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read_table(spark, sf_dir, "crawl_log").dropDuplicates(["fetch_id"])
    seconds = F.floor((F.unix_micros(F.col("logged_at").cast("timestamp")) - F.unix_micros(F.col("fetched_at").cast("timestamp"))) / 1e6).cast("long")
    return log.select("fetch_id", F.when(seconds >= 0, clock(seconds)).alias("delay"))


def search_stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search over an index that is built, saved and loaded."""
    path = scratch_path(spark, "index")
    ix.TextIndex.load_or_build(spark, path, _articles(spark, sf_dir), _stop_words(spark, sf_dir))
    return top_documents(ix.TextIndex.load_or_build(spark, path, _articles(spark, sf_dir).limit(0)), PLAIN)


# Linear algebra


def _positions(postings: DataFrame) -> DataFrame:
    return postings.select("id").distinct().select("id", (F.lit(1.0) / (F.lit(1.0) + F.col("id"))).alias("value"))


def sparse_matvec(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings = _index(spark, sf_dir).postings
    return _rounded(matvec(postings, _positions(postings)), "value")


def sparse_rmatvec(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings = _index(spark, sf_dir).postings
    lengths = postings.select("term").distinct().select("term", (F.lit(1.0) / F.length("term")).alias("value"))
    return _rounded(rmatvec(postings, lengths), "value")


def power_iteration_sigma1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of Aᵀ u after two steps from the vector of ones."""
    postings = _index(spark, sf_dir).postings
    ones = postings.select("id").distinct().select("id", F.lit(1.0).alias("value"))
    sigma = power_factors(postings, 1, iterations=2, tolerance=0.0, start=ones)[0][0]
    return spark.createDataFrame([(round(sigma, DECIMALS),)], "sigma double")


def _factors(spark: SparkSession, sf_dir: str) -> tuple[ix.TextIndex, Factors]:
    index = _index(spark, sf_dir)
    # The factorisation and what follows read the postings several times.
    index.postings = materialize(index.postings, "postings")
    return index, Factors.fit(index.postings, k=25)


def svd_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_factors(spark, sf_dir)[1].sigma_table(spark), "sigma")


def svd_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each of 25 triplets, whether |A v - sigma u| and |Aᵀ u - sigma v| are at most 1e-6 sigma, reckoned from the postings, and
    whether sigma is no larger than the one before."""
    index, factors = _factors(spark, sf_dir)
    found = residuals(factors, index.postings)
    falling = [True, *(bool(a >= b) for a, b in zip(factors.sigma, factors.sigma[1:]))]
    return spark.createDataFrame([(i, left <= 1e-6, right <= 1e-6, falling[i]) for i, left, right in found], "i int, left boolean, right boolean, falling boolean")


def _products(vectors: DataFrame, column: str, scale: list[float]) -> DataFrame:
    """(i, j, product): inner products of the columns of all vectors, each divided by its scale."""
    k, found = len(scale), column_products(vectors, column, scale)
    # Adding 0 turns a negative 0 into 0.
    return found.select(F.expr(f"at div {k}").cast("int").alias("i"), (F.col("at") % k).cast("int").alias("j"), (F.round("product", DECIMALS) + F.lit(0.0)).alias("product"))


def term_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner products of the 25 term vectors' columns, over all terms."""
    factors = _factors(spark, sf_dir)[1]
    return _products(factors.terms, "u", [1.0] * factors.rank)


def doc_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner products of the 25 document vectors' columns without their singular values, over all documents."""
    factors = _factors(spark, sf_dir)[1]
    return _products(factors.documents, "v", [float(s) for s in factors.sigma])


def search_lsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, factors = _factors(spark, sf_dir)
    return factors.search(index, PLAIN)


def search_low_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, factors = _factors(spark, sf_dir)
    return factors.search(index, PLAIN, k=10)


def _stated(index: ix.TextIndex) -> DataFrame:
    return index.documents.where(F.col("id") % 100 == 0).select("id")


def low_rank_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, factors = _factors(spark, sf_dir)
    return factors.strongest_terms(_stated(index))


def gram_matrix_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner products of the articles whose identifier is divisible by 100."""
    index = _index(spark, sf_dir)
    return _rounded(gram_matrix(index.postings, _stated(index)), "value")


def _words_index(spark: SparkSession, sf_dir: str) -> ix.TextIndex:
    """All articles over a stated vocabulary of eight terms."""
    articles = _articles(spark, sf_dir)
    return ix.TextIndex.of(articles, materialize(ix.term_frequencies(articles, _stop_words(spark, sf_dir)).where(F.col("term").isin(*WORDS)), "frequencies"))


def _word_factors(spark: SparkSession, sf_dir: str, k: int = 8) -> tuple[ix.TextIndex, Factors]:
    """The factors of that index, saved and loaded."""
    index = _words_index(spark, sf_dir)
    path = scratch_path(spark, "factors")
    Factors.load_or_build(index.postings, path, k, (k,))
    return index, Factors.load_or_build(index.postings.limit(0), path, k, (k,))


def svd_words_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_word_factors(spark, sf_dir)[1].sigma_table(spark), "sigma")


def svd_words_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, other, value): the projection on the three leading term vectors, which does not depend on their signs."""
    u = _word_factors(spark, sf_dir, 3)[1].terms
    other = u.select(F.col("term").alias("other"), F.col("u").alias("w"))
    # Eight terms by eight.
    return u.crossJoin(F.broadcast(other)).select("term", "other", (F.round(dot(F.col("u"), F.col("w")), DECIMALS) + F.lit(0.0)).alias("value"))


def stored_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of a stored index and the ranks of the factors that were built beside it."""
    path, index = scratch_path(spark, "index"), _words_index(spark, sf_dir)
    index.save(path)
    Factors.save_ranks(index.postings, path)
    return ix.TextIndex.load(spark, path).stats().withColumn("available_k_values", F.array_join("available_k_values", ","))


def power_words_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two leading singular values by power iteration with deflation, to three decimals."""
    found = power_factors(_words_index(spark, sf_dir).postings, 2, iterations=40, tolerance=1e-9)
    return spark.createDataFrame([(i, round(f[0], 3)) for i, f in enumerate(found)], "i int, sigma double")


def search_lsi_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, factors = _word_factors(spark, sf_dir, 3)
    return factors.search(index, PLAIN, limit=20)


def search_low_rank_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Method 4: eight triplets are stored, three are used."""
    index, factors = _word_factors(spark, sf_dir)
    return factors.search(index, PLAIN, limit=20, k=3)


def search_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of each method, called by its code."""
    index, factors = _word_factors(spark, sf_dir)
    found = [search(index, PLAIN, 5, method, 3, factors).select(F.lit(method).alias("method"), "score", "id", "title") for method in (2, 3, 4)]
    return found[0].unionByName(found[1]).unionByName(found[2])


def search_low_rank_no_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, factors = _word_factors(spark, sf_dir)
    return search(index, UNKNOWN, method=4, factors=factors)


def low_rank_matrix_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole matrix of rank three over the stated vocabulary, all articles; entries of amount below a millionth are left out."""
    index, factors = _word_factors(spark, sf_dir)
    return factors.low_rank_matrix(index.documents.select("id"), k=3).where(F.abs("weight") > 1e-6)


def stored_vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = read_table(spark, sf_dir, "doc_vectors").where(F.col("docs_ser").isNotNull() & ~F.exists("docs_ser", F.isnan))
    return vector_norms(clean).distinct()


def stored_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the older build by cosine with its singular values, cut to rank 25."""
    sigma = [r["sigma"] for r in read_table(spark, sf_dir, "sigma").orderBy("i").collect()]
    return latent_neighbours(read_table(spark, sf_dir, "doc_vectors"), sigma, 25, 50)


NAMES = (
    scan_articles, parse_dump_docs, dump_folders, dump_report, extract_pages, stream_pages, stream_outcomes, append_articles, numbered_articles, parse_api_extracts, parse_api_titles, insert_or_ignore_url, insert_new_articles, drop_short_articles, complete_articles, nonblank_paragraphs, stop_word_list, results_json, requests_json,
    tokenize_counts, tokenize_blank_counts, stopword_filter, porter_stem_vocab, vocabulary, corpus_stats,
    term_frequency, document_frequency, idf, tfidf, doc_norms, tfidf_normalized, tf_relative_tfidf, summed_entries,
    query_vector, search_tfidf, search_tfidf_raw_words, search_tfidf_stemmed_query, search_no_match, search_raw_tf, search_tf_relative, search_batch_ranked, score_mean_normalized, search_stored_index,
    result_cards, document_card, document_by_id, leading_sigma, request_defaults, k_bucket, crawl_outcomes, crawl_progress, crawl_resume, fetch_delays,
    sparse_matvec, sparse_rmatvec, power_iteration_sigma1, svd_sigma, svd_residuals, term_vectors, doc_vectors, search_lsi, search_low_rank, low_rank_terms, gram_matrix_small,
    svd_words_sigma, svd_words_projection, stored_ranks, power_words_sigma, search_lsi_words, search_low_rank_words, search_methods, search_low_rank_no_match, low_rank_matrix_words, stored_vector_norms, stored_vector_search,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in NAMES}
