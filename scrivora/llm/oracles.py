"""SQL counterparts of the registered training-data queries, for DuckDB."""

_TERMS = r"list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]{3,}'), lambda t: lower(t))"
_REDUCED = r"regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+', '', 'g')"
_CANONICAL = f"""
WITH reduced AS (SELECT id, {_REDUCED.format('title')} AS a, {_REDUCED.format('text')} AS b FROM articles),
keyed AS (SELECT id, least(a, b) AS x, greatest(a, b) AS y FROM reduced WHERE b <> '' AND id IS NOT NULL),
grouped AS (SELECT x, y, min(id) AS first_id, count(*) AS copies FROM keyed GROUP BY x, y)
"""
_COUNTED = f"""
WITH tokens AS (SELECT id, unnest({_TERMS}) AS term FROM articles),
tf AS (SELECT id, term, count(*) AS tf FROM tokens GROUP BY id, term),
df AS (SELECT term, count(*) AS df, sum(tf) AS occurrences FROM tf GROUP BY term),
size AS (SELECT count(*) AS n FROM articles)
"""
_WORDS = r"string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')"


def _passages(key: str, table: str) -> str:
    words = f"SELECT {key} AS id, {_WORDS} AS w FROM {table}"
    return f"SELECT DISTINCT id, array_to_string(w[i : i + 11], ' ') AS passage FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS i FROM ({words}))"


_TOKENS = r"length(regexp_replace(regexp_replace(coalesce(text, ''), '[\p{L}\p{N}]+', 'a', 'g'), '[\s\x0b\x85\p{Z}]+', '', 'g'))"
_MARKED = _COUNTED + "SELECT term, occurrences::BIGINT AS occurrences, df AS records, CASE WHEN df <= 2 THEN 'rare' WHEN df > 0.1 * n THEN 'common' END AS mark FROM df, size"
_LEAKS = f"""
WITH d AS MATERIALIZED ({_passages('doc_id', 'documents')}), i AS MATERIALIZED ({_passages('item_id', 'eval_items')}),
whole AS (SELECT id, count(*) AS n FROM i GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS passages, round(count(*) / any_value(n), 6) AS containment
FROM d JOIN i USING (passage) JOIN whole ON whole.id = i.id GROUP BY d.id, i.id
"""

_RANKED = """
WITH good AS (SELECT DISTINCT doc_pos AS p, docs_ser AS v FROM doc_vectors
              WHERE doc_pos IS NOT NULL AND len(docs_ser) = 50 AND len(list_filter(docs_ser, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(docs_ser, lambda x: x <> 0)) > 0),
unit AS MATERIALIZED (SELECT p, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM good),
ranked AS (SELECT a.p AS pos, b.p AS other, round(list_dot_product(a.u, b.u), 9) AS cosine FROM unit a, unit b WHERE a.p <> b.p {0}
           QUALIFY row_number() OVER (PARTITION BY a.p ORDER BY round(list_dot_product(a.u, b.u), 9) DESC, b.p) <= 5)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _CANONICAL + "SELECT DISTINCT first_id, id AS copy_id FROM keyed JOIN grouped USING (x, y) WHERE id <> first_id",
        "p1_groups": _CANONICAL + "SELECT first_id, copies FROM grouped",
        "p2_found": _COUNTED
        + """, scored AS (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY round(tf * ln(n / df), 6) DESC, term) AS place
            FROM tf JOIN df USING (term), size WHERE df >= 2)
            SELECT id, term FROM scored WHERE place <= 3""",
        "p2_scores": _COUNTED
        + """, len AS (SELECT id, sum(tf) AS length FROM tf GROUP BY id), mean AS (SELECT sum(tf) / (SELECT n FROM size) AS average FROM tf)
            SELECT id, term, tf, length::BIGINT AS length, df,
                   round(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average)) * ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS score
            FROM tf JOIN df USING (term) JOIN len USING (id), mean, size""",
        "p3_found": _RANKED.format("") + "SELECT DISTINCT least(pos, other) AS doc_a, greatest(pos, other) AS doc_b FROM ranked WHERE cosine >= 0.9",
        "p3_search": _RANKED.format("AND a.p % 100 = 0") + "SELECT pos, other, cosine FROM ranked",
        "p4_found": f"SELECT term, mark FROM ({_MARKED}) WHERE mark IS NOT NULL",
        "p4_frequencies": _MARKED,
        "p5_found": r"""SELECT id, CASE WHEN regexp_matches(text, '[^ \t\n\r]{1000}[^ \t\n\r]{1000}[^ \t\n\r]') THEN 'forced' ELSE 'natural' END AS cut
            FROM articles WHERE length(text) > 2000""",
        "p5_whole": "SELECT id, length(text)::BIGINT AS characters, md5(text) AS digest, true AS short, true AS overlapping FROM articles WHERE length(text) > 2000",
        "p7_found": f"SELECT doc_id, item_id FROM ({_LEAKS})",
        "p7_leaks": _LEAKS,
        "p8_found": f"""
            WITH sized AS (SELECT source, {_TOKENS} AS tokens FROM documents),
            have AS (SELECT source, sum(tokens) AS have FROM sized GROUP BY source),
            need AS (SELECT m.source, m.max_repeats, m.target_share * (SELECT sum(tokens) FROM sized)::DOUBLE AS need, coalesce(have, 0)::DOUBLE AS have
                     FROM mix_targets m LEFT JOIN have h ON h.source = m.source)
            SELECT source, CASE WHEN need <= have THEN 'enough' WHEN need <= have * max_repeats THEN 'repeat' ELSE 'short' END AS fate FROM need""",
        "p8_seats": f"""
            WITH total AS (SELECT sum({_TOKENS}) AS tokens FROM documents),
            seats AS (SELECT round_even(tokens::DOUBLE * (SELECT sum(target_share) FROM mix_targets) / 256, 0)::BIGINT AS n FROM total),
            quotients AS (SELECT source, target_share / (2 * unnest(range((SELECT n FROM seats) + 1)) + 1) AS q FROM mix_targets WHERE target_share > 0),
            granted AS (SELECT source, count(*) AS seats FROM (SELECT source, row_number() OVER (ORDER BY q DESC, source) AS place FROM quotients) WHERE place <= (SELECT n FROM seats) GROUP BY source)
            SELECT m.source, coalesce(g.seats, 0) AS seats FROM mix_targets m LEFT JOIN granted g ON g.source = m.source""",
        "p8_bounds": "SELECT source, true AS reached, true AS close, true AS seldom FROM mix_targets",
    }
