"""Occurrences and records of every term of a collection, by last-seen counters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivora.functions.ascii_terms import cut_terms, slices


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            terms, rows = cut_terms(part.column(1))
            if not len(terms):
                continue
            ids = part.column(0).to_numpy(zero_copy_only=False)
            coded = terms.dictionary_encode()
            place = coded.indices.to_numpy(zero_copy_only=False)
            # Stable: within a term the tokens stay in the order of the records.
            order = np.argsort(place, kind="stable")
            place, rows = place[order], rows[order]
            new_term = np.r_[True, place[1:] != place[:-1]]
            # The last-seen test: a token counts a record if the term's counter last saw another one.
            new_record = new_term | np.r_[True, rows[1:] != rows[:-1]]
            first = np.flatnonzero(new_term)
            last = np.r_[first[1:], len(place)] - 1
            yield pa.record_batch(
                [
                    coded.dictionary,
                    pa.array(last - first + 1, pa.int64()),
                    pa.array(np.add.reduceat(new_record.astype(np.int64), first)),
                    pa.array(ids[rows[last]], pa.int64(), from_pandas=True),
                ],
                names=["term", "occurrences", "records", "last_id"],
            )


def term_frequencies(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(term, occurrences, records, last_id) of every distinct term of ``text_col``.

    A term is a run of at least three ASCII letters or digits, in lower case. Each record's tokens pass through one
    counter per term that holds occurrences, records and the record seen last; a record is counted when it differs
    from the one last seen, so no set of records is kept. The counters run where the records lie (a record is one
    row, so it is whole there); what is shuffled, hashed by term, is one partial counter per term and run of rows,
    summed before and after the shuffle. So tokens themselves are not partitioned by hash and ordered by record: as records lie whole
    in one run, the counters of two runs never saw the same record, and adding them is all that merging takes. A term found in a third of all rows thus costs a row per run, not per record.

    Defined cases: null, empty and contentless texts give no term but remain rows of the collection; a row that
    comes twice is two records; a null identifier is a record like any other and gives a null ``last_id`` only if all of the
    term's records have none; an empty table gives no rows; other columns are ignored.
    """
    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    return (
        slim.mapInArrow(_partials, "term string, occurrences long, records long, last_id long")
        .groupBy("term")
        .agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"), F.max("last_id").alias("last_id"))
    )


def mark_terms(frequencies: DataFrame, n_records: int, rare_up_to: int = 2, common_over: float = 0.1) -> DataFrame:
    """``frequencies`` with ``mark``: ``rare`` (at most ``rare_up_to`` records), ``common`` (more than the share
    ``common_over`` of all records), else null. In a collection so small that both hold, ``rare`` is given."""
    return frequencies.withColumn(
        "mark",
        F.when(F.col("records") <= rare_up_to, F.lit("rare")).when(F.col("records") > F.lit(common_over) * F.lit(n_records), F.lit("common")),
    )
