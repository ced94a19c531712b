"""How characteristic a term is of its record: probabilistic relevance weights over the whole collection."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivora.functions.ascii_terms import slices, term_counts
from scrivora.llm.term_frequency import term_frequencies
from scrivora.operators.skew import HOT_ROWS, hot_keys, join_salted
from scrivora.session import materialize

#: Terms whose record counts are sent to all executors: at most so many, of at most so many bytes (16 MB + counts).
MAX_SHARED_TERMS = 1 << 18
MAX_SHARED_LENGTH = 64

_SCHEMA = "id long, term string, tf long, length long, df long, score double"


def _weights(tf, length, df, n, average, k1, b, smooth):
    """Relevance weight on numpy arrays. ``k1`` = inf turns saturation off, ``b`` = 0 the length normalisation."""
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5)) if smooth else np.log(n / df)
    if math.isinf(k1):
        gain = tf / (1 - b + b * length / average)
    else:
        gain = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))
    return np.round(gain * idf, 6)


def _weight_column(n, average, k1, b, smooth):
    tf, length, df = (F.col(c).cast("double") for c in ("tf", "length", "df"))
    idf = F.log(1 + (F.lit(float(n)) - df + 0.5) / (df + 0.5)) if smooth else F.log(F.lit(float(n)) / df)
    norm = F.lit(1.0 - b) + F.lit(float(b)) * length / F.lit(float(average)) if b else F.lit(1.0)
    gain = tf / norm if math.isinf(k1) else tf * F.lit(k1 + 1.0) / (tf + F.lit(float(k1)) * norm)
    return F.round(gain * idf, 6)


def _scorer(shared, n, average, k1, b, smooth, min_df, top_k, emit_unknown):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_terms, known_df = shared.value
        known_terms = pa.array(known_terms, pa.string())
        for batch in batches:
            for part in slices(batch, "text"):
                dictionary, rows, place, tf = term_counts(part.column(1))
                if not len(rows):
                    continue
                at = pc.fill_null(pc.index_in(dictionary, value_set=known_terms), -1).to_numpy(zero_copy_only=False)
                df_of = np.where(at >= 0, known_df[at] if len(known_df) else 0, 0)
                length = np.bincount(rows, weights=tf, minlength=len(part)).astype(np.int64)[rows]
                df = df_of[place]
                known = df > 0
                score = np.zeros(len(rows))
                score[known] = _weights(tf[known], length[known], df[known], n, average, k1, b, smooth)
                keep = df >= min_df
                if top_k is not None:
                    rank_of = np.empty(len(dictionary), np.int64)
                    rank_of[pc.sort_indices(dictionary).to_numpy(zero_copy_only=False)] = np.arange(len(dictionary))
                    best = np.flatnonzero(keep)
                    best = best[np.lexsort((rank_of[place[best]], -score[best], rows[best]))]
                    ordered = rows[best]
                    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
                    ordinal = np.arange(len(best)) - np.repeat(first, np.diff(np.r_[first, len(best)]))
                    keep = np.zeros(len(rows), bool)
                    keep[best[ordinal < top_k]] = True
                if emit_unknown:
                    keep |= ~known
                i = np.flatnonzero(keep)
                if not len(i):
                    continue
                ids = part.column(0).take(pa.array(rows[i]))
                unknown = ~known[i]
                yield pa.record_batch(
                    [ids, dictionary.take(pa.array(place[i])), pa.array(tf[i], pa.int64()), pa.array(length[i], pa.int64()), pa.array(df[i], pa.int64(), mask=unknown), pa.array(score[i], mask=unknown)],
                    names=["id", "term", "tf", "length", "df", "score"],
                )

    return run


def term_distinctiveness(
    df: DataFrame,
    id_col: str = "id",
    text_col: str = "text",
    k1: float = 1.2,
    b: float = 0.75,
    smooth_idf: bool = True,
    min_df: int = 1,
    top_k: int | None = None,
    max_shared_terms: int = MAX_SHARED_TERMS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(id, term, tf, length, df, score) for every term of every record, or the ``top_k`` best of each.

    score = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average length)), rounded to 6 decimals, with
    idf = ln(1 + (N - df + 0.5) / (df + 0.5)) if ``smooth_idf``, else ln(N / df). As ``k1`` grows the saturation
    fades, and ``k1`` = inf is its limit, tf itself. N counts all rows. Only terms of at least ``min_df`` records
    take part. Ties go to the smaller term.

    Plan: record counts come from :func:`term_frequencies`. The most frequent terms, at most ``max_shared_terms`` of
    at most 64 bytes (16 MB), go to all executors, so their pairs are scored, and cut to ``top_k``, where the record
    lies and are never shuffled. Pairs of all other terms are joined with the counts by a shuffle on the term: these are the
    rare ones, and longer ones, of which those of very many records are split.

    Defined cases: null, empty and contentless texts give no rows but count in N; a row that comes twice counts as
    two records, and under ``top_k`` the rows of one identifier share one list; a null identifier is kept as
    such; an empty table gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    n = df.count()
    counts = materialize(term_frequencies(df, id_col, text_col).select("term", "occurrences", "records"), "term-counts")
    # Terms per power of two of their record count: at most 64 rows reach the driver.
    short = F.octet_length("term") <= MAX_SHARED_LENGTH
    levels = (
        counts.groupBy(F.floor(F.log2("records")).cast("int").alias("level"))
        .agg(F.sum(F.when(short, 1).otherwise(0)).alias("short"), F.sum(F.when(short, 0).otherwise(1)).alias("long"), F.sum("occurrences").alias("occurrences"))
        .collect()
    )
    average = max(1.0, sum(r["occurrences"] for r in levels) / max(1, n))
    least, total = 62, 0
    for r in sorted(levels, key=lambda r: -r["level"]):
        if total + r["short"] > max_shared_terms:
            break
        least, total = r["level"], total + r["short"]
    least = 0 if not levels else least
    floor_df = max(min_df, 2**least)
    chosen = counts.where((F.col("records") >= floor_df) & short).select("term", "records").toArrow() if total else None
    names = chosen.column("term").combine_chunks() if chosen is not None else pa.array([], pa.string())
    shared = spark.sparkContext.broadcast((names.to_pylist() if len(names) else [], chosen.column("records").to_numpy() if chosen is not None else np.zeros(0, np.int64)))
    whole = 2**least <= min_df and not any(r["long"] for r in levels)
    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    scored = slim.mapInArrow(_scorer(shared, n, average, k1, b, smooth_idf, min_df, top_k, not whole), _SCHEMA)
    if not whole:
        weight = _weight_column(n, average, k1, b, smooth_idf)
        rest = counts.where((F.col("records") >= min_df) & ((F.col("records") < floor_df) | ~short)).select("term", F.col("records").alias("df"))
        late = scored.where(F.col("df").isNull()).drop("df", "score")
        late = join_salted(late, rest, "term", hot_keys(rest, "term", "df", hot_rows)).withColumn("score", weight)
        scored = scored.where(F.col("df").isNotNull()).unionByName(late.select(scored.columns))
    if top_k is not None:
        best = Window.partitionBy("id").orderBy(F.desc("score"), F.asc("term"))
        scored = scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top_k).drop("place")
    return scored
