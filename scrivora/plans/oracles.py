"""SQL counterparts of the registered queries, for DuckDB."""

from __future__ import annotations

from scrivora.functions.stem import stem_sql
from scrivora.plans.queries import INFLECTED, PLAIN, UNKNOWN, WORDS

_TOKENS = "list_transform(list_filter(regexp_split_to_array(coalesce({}, ''), '[^a-zA-Z0-9]+'), lambda t: length(t) > 2), lambda t: lower(t))"
_TEXT_TOKENS = _TOKENS.format("text")
_BOTH = "concat_ws(' ', title, text)"
_BLANK_TOKENS = (
    r"list_filter(list_transform(regexp_split_to_array(lower(" + _BOTH + r"), '[\s\x0b\x{85}\p{Z}]+'), "
    r"lambda t: regexp_replace(t, '^[^\p{L}]+|[^\p{L}]+$', '', 'g')), lambda t: t <> '')"
)
_ALL = f"tok AS MATERIALIZED (SELECT id, unnest({_TEXT_TOKENS}) AS token FROM articles)"
_STOP = "stop AS (SELECT DISTINCT trim(word) AS word FROM stop_words WHERE trim(word) <> '')"
_STEMS = f"{_ALL}, {_STOP}, kept AS MATERIALIZED (SELECT id, token FROM tok WHERE token NOT IN (SELECT word FROM stop)), stems AS MATERIALIZED ({stem_sql('SELECT DISTINCT token AS word FROM kept')})"
_SIZE = "size AS (SELECT count(*)::DOUBLE AS n FROM articles)"
_REST = f"""df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), {_SIZE}, idf AS (SELECT term, df, ln(n / df) AS idf FROM df, size),
w AS (SELECT id, term, tf, tf * idf AS weight FROM tf JOIN idf USING (term)), norms AS (SELECT id, sqrt(sum(weight * weight)) AS norm FROM w GROUP BY id),
nw AS MATERIALIZED (SELECT id, term, weight / norm AS weight FROM w JOIN norms USING (id) WHERE norm > 0)"""
_TF = f"WITH {_STEMS}, tf AS MATERIALIZED (SELECT id, stem AS term, count(*)::DOUBLE AS tf FROM kept JOIN stems ON token = word GROUP BY id, stem)"
_INDEX = f"{_TF}, {_REST}"
_RELATIVE = f"""WITH tok AS (SELECT id, unnest({_BLANK_TOKENS}) AS term FROM articles), n AS (SELECT id, term, count(*)::DOUBLE AS c FROM tok GROUP BY id, term),
tf AS (SELECT id, term, c / sum(c) OVER (PARTITION BY id) AS tf FROM n), {_REST}"""


def _asked(text: str, stemmed: bool) -> str:
    words = f"SELECT unnest({_TOKENS.format(repr(text))}) AS word"
    if stemmed:
        words = f"SELECT stem AS word FROM (SELECT word AS w0 FROM ({words})) JOIN ({stem_sql(f'SELECT DISTINCT word FROM ({words})')}) ON word = w0"
    return f"SELECT word AS term, count(*)::DOUBLE AS c FROM ({words}) GROUP BY word"


def _vector(text: str, stemmed: bool = False) -> str:
    return f"""raw AS (SELECT term, c * idf AS weight FROM ({_asked(text, stemmed)}) JOIN idf USING (term)),
    q AS (SELECT term, CASE WHEN s > 0 THEN weight / s ELSE 0 END AS asked FROM raw, (SELECT sqrt(sum(weight * weight)) AS s FROM raw))"""


def _search(index: str, text: str, limit: int = 10, stemmed: bool = False, postings: str = "nw", vector: str | None = None) -> str:
    return f"""{index}, {vector or _vector(text, stemmed)}, scored AS (SELECT id, round(sum(asked * weight), 6) AS score FROM {postings} JOIN q USING (term) WHERE asked <> 0 GROUP BY id),
    best AS (SELECT a.id, coalesce(score, 0.0) AS score FROM articles a LEFT JOIN scored s ON s.id = a.id ORDER BY coalesce(score, 0.0) DESC, a.id LIMIT {limit})
    SELECT score, title, url, id, text FROM best JOIN articles USING (id)"""


_LOGGED = "SELECT DISTINCT search_id AS query_id, query, coalesce(row_limit, 10) AS row_limit FROM search_log WHERE search_id % 100 = 0 AND trim(query) <> ''"
_BATCH = f"""{_INDEX}, asked AS MATERIALIZED ({_LOGGED}), qtok AS MATERIALIZED (SELECT query_id, unnest({_TOKENS.format('query')}) AS token FROM asked),
qstem AS ({stem_sql('SELECT DISTINCT token AS word FROM qtok')}), qraw AS (SELECT query_id, term, c * idf AS weight FROM (SELECT query_id, stem AS term, count(*)::DOUBLE AS c FROM qtok JOIN qstem ON token = word GROUP BY query_id, stem) JOIN idf USING (term)),
q AS (SELECT query_id, term, weight / nullif(sqrt(sum(weight * weight) OVER (PARTITION BY query_id)), 0) AS asked FROM qraw),
scored AS (SELECT query_id, id, round(sum(asked * weight), 6) AS score FROM nw JOIN q USING (term) WHERE asked <> 0 GROUP BY query_id, id),
ranked AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM scored WHERE score > 0),
batch AS (SELECT query_id, rank, id, score FROM ranked JOIN asked USING (query_id) WHERE rank <= row_limit)"""
_BARE = """SELECT id, t AS title, u AS url, b AS text FROM (SELECT id, regexp_replace(url, '[<"]', '', 'g') AS u, regexp_replace(title, '[<"]', '', 'g') AS t,
            regexp_replace(text, '[<"]', '', 'g') AS b FROM articles) WHERE regexp_matches(u, '^https?://.') AND t <> '' AND b <> ''"""
_PAGES = r"""SELECT id, url, title, p AS text FROM (SELECT id, url, title, array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)),
            lambda p: regexp_replace(p, '[\s\x0b\x{85}\p{Z}]+', '', 'g') <> ''), chr(10)) AS p FROM articles) WHERE title IS NOT NULL AND p <> ''"""


def _words_index() -> str:
    words = ", ".join(map(repr, WORDS))
    return f"{_TF.replace('GROUP BY id, stem)', f'WHERE stem IN ({words}) GROUP BY id, stem)')}, {_REST}"


def _triplets(k: int) -> str:
    """The ``k`` leading eigenpairs of the 8 x 8 matrix of the stated words: the matrix is squared until it is the projection on its
    leading vector, whose part is taken away for the next. ``p1`` and so on hold the projections, ``sigma`` the singular values."""
    words = f"[{', '.join(map(repr, sorted(WORDS)))}]"
    steps = [f"""{_words_index()},
    place AS (SELECT unnest({words}) AS term, unnest(range(1, 9)) AS spot), cells AS MATERIALIZED (SELECT id, spot, weight FROM nw JOIN place USING (term)),
    grams AS (SELECT p.spot AS i, q.spot AS j, coalesce(g, 0.0) AS g FROM place p CROSS JOIN place q LEFT JOIN (SELECT a.spot AS i, b.spot AS j, sum(a.weight * b.weight) AS g FROM cells a JOIN cells b USING (id) GROUP BY a.spot, b.spot) s ON s.i = p.spot AND s.j = q.spot),
    m1 AS MATERIALIZED (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(g ORDER BY j) AS r FROM grams GROUP BY i))"""]
    product = "list_transform({0}, lambda r: list_transform({0}, lambda c: list_dot_product(r, c)))"
    trace = "list_sum(list_transform(range(1, 9), lambda i: {0}[i][i]))"
    for n in range(1, k + 1):
        squared = product.format("m")
        steps.append(f"""s{n} AS (SELECT * FROM (WITH RECURSIVE q(step, m) AS (SELECT 0, list_transform(m, lambda r: list_transform(r, lambda x: x / t)) FROM (SELECT m, {trace.format('m')} AS t FROM m{n})
            UNION ALL SELECT step + 1, list_transform(w, lambda r: list_transform(r, lambda x: x / t)) FROM (SELECT step, w, {trace.format('w')} AS t FROM (SELECT step, {squared} AS w FROM q WHERE step < 40))) SELECT m AS p FROM q WHERE step = 40)),
    p{n} AS MATERIALIZED (SELECT p, list_sum(list_transform(range(1, 9), lambda i: list_dot_product(p[i], m[i]))) AS ev FROM s{n}, m{n}),
    m{n + 1} AS MATERIALIZED (SELECT list_transform(range(1, 9), lambda i: list_transform(range(1, 9), lambda j: m[i][j] - ev * p[i][j])) AS m FROM m{n}, p{n})""")
    steps.append("sigma AS (" + " UNION ALL ".join(f"SELECT {n - 1} AS i, sqrt(ev) AS sigma FROM p{n}" for n in range(1, k + 1)) + ")")
    total = " + ".join(f"p{n}.p[i][j]" for n in range(1, k + 1))
    steps.append(f"projection AS MATERIALIZED (SELECT list_transform(range(1, 9), lambda i: list_transform(range(1, 9), lambda j: {total})) AS p FROM {', '.join(f'p{n}' for n in range(1, k + 1))})")
    steps.append("""columns AS (SELECT id, list_transform(range(1, 9), lambda i: coalesce(list_extract(map_extract(m, i), 1), 0.0)) AS a FROM (SELECT id, map_from_entries(list((spot, weight))) AS m FROM cells GROUP BY id)),
    projected AS MATERIALIZED (SELECT id, list_transform(range(1, 9), lambda i: list_dot_product(p[i], a)) AS a FROM columns, projection)""")
    return ", ".join(steps)


def _latent(k: int, limit: int) -> str:
    return f"""{_triplets(k)}, {_vector(PLAIN)}, asked AS (SELECT list_transform(range(1, 9), lambda i: coalesce(list_extract(map_extract(m, i), 1), 0.0)) AS q FROM (SELECT map_from_entries(list((spot, asked))) AS m FROM q JOIN place USING (term))),
    folded AS (SELECT list_transform(range(1, 9), lambda i: list_dot_product(p[i], q)) AS q FROM asked, projection),
    scored AS (SELECT id, round(list_dot_product(q, a) / sqrt(list_dot_product(q, q)) / sqrt(list_dot_product(a, a)), 6) AS score FROM projected, folded WHERE list_dot_product(a, a) > 1e-20),
    best AS (SELECT a.id, coalesce(score, 0.0) AS score FROM articles a LEFT JOIN scored s ON s.id = a.id ORDER BY coalesce(score, 0.0) DESC, a.id LIMIT {limit})
    SELECT score, title, url, id, text FROM best JOIN articles USING (id)"""


_UNIT = "SELECT i::INTEGER AS i, j::INTEGER AS j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS product FROM range(25) a(i), range(25) b(j)"
_CLOCK = "printf('%02d:%02d:%02d', {0} // 3600, {0} % 3600 // 60, {0} % 60)"


def oracle_sql() -> dict[str, str]:
    return {
        "scan_articles": "SELECT id, title, url, text FROM articles",
        "parse_dump_docs": _BARE,
        "dump_folders": _BARE,
        "dump_report": f"SELECT 'folder=' || ['AA', 'AB', 'AC'][id % 3 + 1] AS folder, true AS readable, count(*) AS documents FROM ({_BARE}) GROUP BY 1",
        "extract_pages": _PAGES,
        "stream_pages": f"SELECT url, 1::BIGINT AS n FROM ({_PAGES}) WHERE url IS NOT NULL GROUP BY url",
        "stream_outcomes": """WITH l AS (SELECT DISTINCT ON (fetch_id) fetch_id, outcome, date_trunc('hour', fetched_at) AS from_time FROM crawl_log)
            SELECT from_time, outcome, count(*) AS n FROM l WHERE from_time + INTERVAL 1 HOUR <= (SELECT max(fetched_at) - INTERVAL 1 DAY FROM crawl_log) GROUP BY from_time, outcome""",
        "append_articles": "SELECT coalesce(min(id) FILTER (id % 2 = 0), min(id)) AS id, url, 0 AS added_last FROM articles WHERE url IS NOT NULL GROUP BY url",
        "numbered_articles": "SELECT id, row_number() OVER (ORDER BY id) - 1 AS doc_pos FROM articles",
        "parse_api_titles": "SELECT title FROM articles",
        "parse_api_extracts": "SELECT title, text AS content FROM articles WHERE text <> ''",
        "insert_or_ignore_url": "SELECT min(id) AS id, url FROM articles WHERE url IS NOT NULL GROUP BY url UNION ALL SELECT id, url FROM articles WHERE url IS NULL",
        "insert_new_articles": """WITH new AS (SELECT id, title FROM articles WHERE id % 2 = 1 AND text <> '' AND NOT EXISTS (SELECT 1 FROM articles o WHERE o.id % 2 = 0 AND o.title = articles.title))
            SELECT min(id) AS id, title FROM new WHERE title IS NOT NULL GROUP BY title UNION ALL SELECT id, title FROM new WHERE title IS NULL""",
        "drop_short_articles": "SELECT id, length(text)::INTEGER AS size FROM articles WHERE length(text) >= 150",
        "complete_articles": "SELECT id, title FROM articles WHERE title IS NOT NULL AND text <> ''",
        "nonblank_paragraphs": "SELECT id, array_to_string(list_filter(string_split(text, chr(10)), lambda p: trim(p) <> ''), chr(10)) AS text FROM articles WHERE text IS NOT NULL",
        "stop_word_list": "SELECT DISTINCT trim(word) AS word FROM stop_words WHERE trim(word) <> ''",
        "results_json": "SELECT CAST(to_json({'id': id, 'title': title, 'url': url}) AS VARCHAR) AS json FROM articles",
        "requests_json": 'SELECT row_limit AS "limit", method_code AS method, count(*) AS n, count(DISTINCT query) AS queries FROM search_log GROUP BY row_limit, method_code',
        "tokenize_counts": f"SELECT id, len({_TEXT_TOKENS}) AS tokens, len(list_distinct({_TEXT_TOKENS})) AS words FROM articles",
        "tokenize_blank_counts": f"SELECT id, len({_BLANK_TOKENS}) AS tokens, len(list_distinct({_BLANK_TOKENS})) AS words FROM articles",
        "stopword_filter": f"WITH {_ALL}, {_STOP} SELECT token, count(*) AS n FROM tok WHERE token NOT IN (SELECT word FROM stop) GROUP BY token",
        "porter_stem_vocab": f"WITH {_ALL} {stem_sql('SELECT DISTINCT token AS word FROM tok')}",
        "vocabulary": f"""WITH {_STEMS}, placed AS (SELECT id, unnest(t) AS token, unnest(range(len(t))) AS place FROM (SELECT id, {_TEXT_TOKENS} AS t FROM articles)),
            first AS (SELECT stem AS term, min(row(id, place)) AS f FROM placed JOIN stems ON token = word GROUP BY stem)
            SELECT row_number() OVER (ORDER BY f, term) - 1 AS term_id, term FROM first""",
        "corpus_stats": f"{_INDEX} SELECT (SELECT count(*) FROM articles) AS document_count, (SELECT count(*) FROM idf) AS vocabulary_size, '' AS available_k_values",
        "stored_ranks": "SELECT count(*) AS document_count, 8::BIGINT AS vocabulary_size, '10,25,50' AS available_k_values FROM articles",
        "term_frequency": f"{_TF} SELECT id, term, tf FROM tf",
        "document_frequency": f"{_INDEX} SELECT term, df FROM df",
        "idf": f"{_INDEX} SELECT term, df, round(idf, 6) AS idf FROM idf",
        "tfidf": f"{_INDEX} SELECT id, term, tf, round(weight, 6) AS weight FROM w",
        "doc_norms": f"{_INDEX} SELECT id, round(norm, 6) AS norm FROM norms",
        "tfidf_normalized": f"{_INDEX} SELECT id, term, round(weight, 6) AS weight FROM nw",
        "tf_relative_tfidf": f"{_RELATIVE} SELECT id, term, round(weight, 6) AS weight FROM nw",
        "summed_entries": "SELECT article_id AS i, outcome AS j, count(*)::DOUBLE AS value FROM crawl_log WHERE article_id IS NOT NULL GROUP BY article_id, outcome",
        "query_vector": f"{_INDEX}, {_vector(PLAIN + ' river')} SELECT term, round(asked, 6) AS weight FROM q",
        "search_tfidf": _search(_INDEX, PLAIN),
        "search_stored_index": _search(_INDEX, PLAIN),
        "search_tfidf_raw_words": _search(_INDEX, INFLECTED),
        "search_tfidf_stemmed_query": _search(_INDEX, INFLECTED, stemmed=True),
        "search_no_match": _search(_INDEX, UNKNOWN, 5),
        "search_raw_tf": _search(_TF, PLAIN, postings="(SELECT id, term, tf AS weight FROM tf)", vector=f"q AS (SELECT term, c AS asked FROM ({_asked(PLAIN, False)}))"),
        "search_tf_relative": _search(_RELATIVE, INFLECTED),
        "search_batch_ranked": f"{_BATCH} SELECT query_id, rank, id, score FROM batch",
        "score_mean_normalized": f"{_BATCH} SELECT query_id, rank, id, round(score / avg(score) OVER (PARTITION BY query_id), 6) AS relative_score FROM batch WHERE rank <= 5",
        "result_cards": """SELECT id, coalesce(nullif(title, ''), 'Untitled Document') AS title, printf('%.4f', coalesce(length(text) / 10000.0, 0)) AS score,
            CASE WHEN coalesce(text, '') = '' THEN 'No content available' ELSE left(text, 150) || CASE WHEN length(text) > 150 THEN '...' ELSE '' END END AS snippet FROM articles""",
        "document_card": "SELECT id, coalesce(nullif(title, ''), 'Untitled Document') AS title, '0.0000' AS score, coalesce(nullif(text, ''), 'No content available') AS text FROM articles WHERE id = 16",
        "leading_sigma": "SELECT i, sigma FROM sigma ORDER BY sigma DESC, i LIMIT 5",
        "document_by_id": "SELECT 0.0::DOUBLE AS score, title, url, id, text FROM articles WHERE id = 103",
        "request_defaults": """SELECT coalesce(row_limit, 10) AS row_limit, CASE coalesce(method_code, 2) WHEN 2 THEN 'TF-IDF' WHEN 3 THEN 'SVD' WHEN 4 THEN 'Low-Rank SVD' ELSE 'Unknown' END AS method,
            coalesce(method_code, 2) IN (2, 3, 4) AS known, count(*) AS n FROM search_log WHERE trim(query) <> '' GROUP BY 1, 2, 3""",
        "k_bucket": "SELECT (i + 1)::INTEGER AS k, CASE WHEN i < 10 THEN 10 WHEN i < 25 THEN 25 ELSE 50 END AS bucket, 'svd_k=' || CASE WHEN i < 10 THEN 10 WHEN i < 25 THEN 25 ELSE 50 END AS name FROM sigma",
        "crawl_outcomes": "SELECT outcome, count(DISTINCT fetch_id) AS n FROM crawl_log GROUP BY outcome",
        "crawl_resume": "SELECT stored, CASE WHEN stored >= 50000 THEN 0 ELSE 60000 - stored END AS needed FROM (SELECT count(DISTINCT article_id) AS stored FROM crawl_log WHERE outcome = 'saved')",
        "crawl_progress": f"""WITH l AS (SELECT DISTINCT ON (fetch_id) * FROM crawl_log), a AS (SELECT count(*) AS completed, count(*) FILTER (outcome = 'saved') AS saved,
            (epoch_us(max(fetched_at)) - epoch_us(min(fetched_at))) / 1e6 AS s FROM l), r AS (SELECT *, completed / s AS rate, floor(greatest(300000 - completed, 0) / (completed / s))::BIGINT AS left_s FROM a)
            SELECT completed, saved, round(completed * 100.0 / 300000, 1)::DOUBLE AS percent, round(s, 1) AS seconds, round(rate, 6) AS rate, {_CLOCK.format('left_s')} AS time_left FROM r""",
        "fetch_delays": f"""SELECT fetch_id, CASE WHEN s >= 0 THEN {_CLOCK.format('s')} END AS delay
            FROM (SELECT DISTINCT fetch_id, floor((epoch_us(logged_at) - epoch_us(fetched_at)) / 1e6)::BIGINT AS s FROM crawl_log)""",
        "sparse_matvec": f"{_INDEX} SELECT term, round(sum(weight / (1.0::DOUBLE + id)), 6) AS value FROM nw GROUP BY term",
        "sparse_rmatvec": f"{_INDEX} SELECT id, round(sum(weight / length(term)::DOUBLE), 6) AS value FROM nw GROUP BY id",
        "power_iteration_sigma1": f"""{_INDEX}, u1 AS MATERIALIZED (SELECT term, sum(weight) AS x FROM nw GROUP BY term), v1 AS MATERIALIZED (SELECT id, sum(weight * x) AS x FROM nw JOIN u1 USING (term) GROUP BY id),
            u2 AS MATERIALIZED (SELECT term, sum(weight * x) AS x FROM nw JOIN v1 USING (id) GROUP BY term), v2 AS (SELECT id, sum(weight * x) AS x FROM nw JOIN u2 USING (term) GROUP BY id)
            SELECT round(sqrt((SELECT sum(x * x) FROM v2) / (SELECT sum(x * x) FROM u2)), 6) AS sigma""",
        "svd_residuals": "SELECT i::INTEGER AS i, true AS \"left\", true AS \"right\", true AS falling FROM range(25) r(i)",
        "term_vectors": _UNIT,
        "doc_vectors": _UNIT,
        "gram_matrix_small": f"{_INDEX} SELECT a.id AS i, b.id AS j, round(sum(a.weight * b.weight), 6) AS value FROM nw a JOIN nw b USING (term) WHERE a.id % 100 = 0 AND b.id % 100 = 0 GROUP BY a.id, b.id",
        "svd_words_sigma": f"{_triplets(8)} SELECT i::INTEGER AS i, round(sigma, 6) AS sigma FROM sigma",
        "power_words_sigma": f"{_triplets(2)} SELECT i::INTEGER AS i, round(sigma, 3) AS sigma FROM sigma",
        "svd_words_projection": f"{_triplets(3)} SELECT a.term, b.term AS other, round(p[a.spot][b.spot], 6) + 0.0::DOUBLE AS value FROM place a, place b, projection",
        "search_lsi_words": _latent(3, 20),
        "search_low_rank_words": _latent(3, 20),
        "search_methods": " UNION ALL ".join(f"SELECT {m} AS method, score, id, title FROM ({sql})" for m, sql in ((2, _search(_words_index(), PLAIN, 5)), (3, _latent(8, 5)), (4, _latent(3, 5)))),
        "search_low_rank_no_match": "SELECT 0.0::DOUBLE AS score, title, url, id, text FROM articles WHERE false",
        "low_rank_matrix_words": f"""{_triplets(3)}, entries AS (SELECT id, unnest(a) AS x, unnest(range(1, 9)) AS spot, sqrt(list_dot_product(a, a)) AS size FROM projected)
            SELECT id, term, round(x / size, 6) AS weight FROM entries JOIN place USING (spot) WHERE size > 1e-12 AND abs(round(x / size, 6)) > 1e-6""",
        "stored_vector_norms": """SELECT DISTINCT doc_pos AS id, round(sqrt(list_sum(list_transform(docs_ser, lambda x: x * x))), 6) AS norm FROM doc_vectors
            WHERE docs_ser IS NOT NULL AND len(list_filter(docs_ser, lambda x: isnan(x))) = 0""",
        "stored_vector_search": """WITH s AS (SELECT list(sigma ORDER BY i)[1:25] AS q FROM sigma), v AS (SELECT DISTINCT doc_pos AS id, docs_ser[1:25] AS v FROM doc_vectors
            WHERE docs_ser IS NOT NULL AND len(docs_ser) >= 25 AND len(list_filter(docs_ser[1:25], lambda x: isnan(x))) = 0)
            SELECT id, CASE WHEN list_dot_product(v, v) > 1e-20 THEN round(list_dot_product(v, q) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(q, q)), 6) ELSE 0.0 END AS score FROM v, s ORDER BY score DESC, id LIMIT 50""",
    }
