"""Passages of test items inside a corpus."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivora.functions.ascii_terms import slices
from scrivora.operators.skew import HOT_ROWS, hot_keys, join_salted
from scrivora.session import materialize

SHINGLE = 5
#: Values of a signature at most. An item of no more shingles is held whole, and then nothing is lost.
SIGNATURE = 64
#: Chance that a longer item is missed whose containment is just the threshold.
MISS = 1e-6
#: Bits per shingle of the items and probes of the filter that goes to all executors, and its size at most (64 MB). Beyond, nothing is
#: filtered and all shingles of the corpus go through the shuffle.
FILTER_BITS, PROBES, MOST_BITS = 10, 3, 1 << 29


def plain_words(text: Column) -> Column:
    """The words of a text, runs of letters or digits of any alphabet in lower case, divided by single blanks."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """For texts of blank-divided words: the words of all texts in order, the text of each word, and at every place the hash of the five
    words that begin there, whether or not they lie within one text."""
    lists = pc.split_pattern(words, " ")
    flat = lists.flatten()
    rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = flat.dictionary_encode()
    of_word = pd.util.hash_array(np.asarray(coded.dictionary.to_pylist(), object), categorize=False) if len(coded.dictionary) else np.zeros(0, np.uint64)
    h = of_word[coded.indices.to_numpy(zero_copy_only=False)]
    out = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)]
        return flat, rows, _mix(out)


def _probes(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    step = (h >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(PROBES):
            yield (h + np.uint64(j) * step) & np.uint64(bits - 1)


def _all_of(flags: np.ndarray, span: int) -> np.ndarray:
    """Whether ``span`` flags from each place on are all set."""
    have, out = 1, flags
    while have < span:
        step = min(have, span - have)
        out = out[: len(out) - step] & out[step:]
        have += step
    return out


def least_matches(size: int, share: float) -> int:
    """How many values of the signature of an item of ``size`` shingles a text must hold that may hold ``share`` of all. A whole signature is
    counted exactly; of a longer item the lower bound is not met with a chance of :data:`MISS`."""
    wanted = max(1, math.ceil(share * size - 1e-9))
    if size <= SIGNATURE:
        return wanted
    below, m = 0.0, 0
    for m in range(SIGNATURE + 1):
        if m > wanted or SIGNATURE - m > size - wanted:
            continue
        below += math.exp(sum(math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1) for a, b in ((wanted, m), (size - wanted, SIGNATURE - m))) - (math.lgamma(size + 1) - math.lgamma(SIGNATURE + 1) - math.lgamma(size - SIGNATURE + 1)))
        if below > MISS:
            break
    return max(1, m)


class LeakSearch:
    """Test items and the search for them in a corpus, by size-partitioned MinHash containment.

    A short item inside a long document has a tiny similarity to the whole of it, so what is estimated is containment, the share of an
    item's five-word shingles that a text holds. Sought is either a passage of ``span`` words, whole and in order (``least`` is
    None), or at least the share ``least`` of an item's shingles, wherever they stand, so that changed words between them do no harm.

    1. Items are partitioned by size (powers of two of their number of shingles). The signature of an item are its least hash values, at
       most 64. In each partition the containment threshold is turned into a number of values that a text
       must hold: the shingles of the shortest sought passage, or the share ``least``, less the sampling error where the signature is no longer the whole
       item. For passages, long items are cut into overlapping pieces of at most 64 shingles, so that signatures are whole and every
       passage lies in one piece.
    2. Of a signature of k values that must be met m times, the k - m + 1 rarest among the items are indexed: a text that
       meets m of them meets one of these. What many items share, an instruction for example, is thus no key.
    3. Documents are read where they lie. A Bloom filter of the items' shingles, sized by their number, passes over nearly all of a
       document; for passages only stretches count in which every shingle passes. What is left meets the index by a join on the hash, whose hot
       keys are split. At the items' number from which the filter would be too large, all shingles take part in that join.
    4. Candidates are verified by exact containment: the texts of the shingles (of ``span`` words for passages, else of five)
       that item and document have in common are counted.

    Defined cases: texts of fewer than ``span`` words (five, with ``least``), null and empty texts and null identifiers give no rows; rows that
    come twice count once; empty tables give no rows; other columns, of whatever name, are ignored.
    """

    def __init__(self, items: DataFrame, id_col: str = "item_id", text_col: str = "text", span: int = 12, least: float | None = None, hot_rows: int = HOT_ROWS, most_bits: int = MOST_BITS):
        if span < SHINGLE:
            raise ValueError(f"span must be at least {SHINGLE}")
        if least is not None and not 0 < least <= 1:
            raise ValueError("least must be above 0 and at most 1")
        self.spark, self.least, self.hot_rows = items.sparkSession, least, hot_rows
        self.span = span if least is None else SHINGLE
        cut = materialize(self._cut(items, id_col, text_col, None), "item-shingles")
        self.units = materialize(cut.where("unit is not null").select(F.col("id").alias("item_id"), "unit").distinct(), "item-units")
        self.signatures = materialize(self._signatures(cut.where("unit is null").select("id", "piece", "h", "need").distinct()), "signatures")
        hashes = cut.where("unit is null").select("h").distinct()
        n = hashes.count()
        bits = 1 << max(10, math.ceil(math.log2(max(1, n) * FILTER_BITS)))
        self.filter = self.spark.sparkContext.broadcast((bits, self._filter(hashes, bits))) if bits <= most_bits else None
        self.index = materialize(self._index(), "leak-index")

    def _cut(self, df: DataFrame, id_col: str, text_col: str, shared) -> DataFrame:
        """(id, piece, h, need, unit): hashes of shingles, and texts of units that can be verified."""
        slim = df.select(F.col(id_col).cast("long").alias("id"), plain_words(F.col(text_col).cast("string")).alias("words"))
        slim = slim.where(F.col("id").isNotNull() & F.col("words").isNotNull() & (F.col("words") != ""))
        span, items, inner = self.span, shared is None, self.span - SHINGLE + 1
        pieces = SIGNATURE if self.least is None else 0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits, table = shared.value if shared else (0, None)
            for batch in batches:
                for part in slices(batch, "words"):
                    flat, rows, h = shingle_hashes(part.column(1))
                    n = len(flat) - span + 1
                    if n <= 0:
                        continue
                    passed = np.ones(len(h), bool)
                    if table is not None:
                        for slot in _probes(h, bits):
                            left = np.flatnonzero(passed)
                            at = slot[left]
                            passed[left] = (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    begins = np.flatnonzero(_all_of(passed, inner)[:n] & (rows[:n] == rows[span - 1 :]))
                    if not len(begins):
                        continue
                    ids, place = part.column(0), rows[begins]
                    # Each shingle of a passed stretch, once.
                    within = np.zeros(len(h), bool)
                    for k in range(inner):
                        within[begins + k] = True
                    at = np.flatnonzero(within)
                    piece = need = np.zeros(len(at), np.int32)
                    if items and pieces:
                        at, piece, need = _pieces(rows, h, begins, inner, pieces)
                    none = pa.nulls(len(at), pa.string())
                    yield pa.record_batch([ids.take(pa.array(rows[at])), pa.array(piece, pa.int32()), pa.array(h[at].view(np.int64)), pa.array(need, pa.int32()), none], names=["id", "piece", "h", "need", "unit"])
                    units = pa.array([" ".join(flat[b : b + span].to_pylist()) for b in begins.tolist()], pa.string())
                    zero = np.zeros(len(begins), np.int32)
                    yield pa.record_batch([ids.take(pa.array(place)), pa.array(zero), pa.array(zero.astype(np.int64)), pa.array(zero), units], names=["id", "piece", "h", "need", "unit"])

        return slim.mapInArrow(run, "id long, piece int, h long, need int, unit string")

    def _signatures(self, shingles: DataFrame) -> DataFrame:
        """(item_id, piece, h, size, part, need): the signature values, the size class and how many must be met."""
        sizes = shingles.groupBy("id", "piece").agg(F.count(F.lit(1)).alias("size"), F.min("need").alias("need"))
        if self.least is not None:
            share, limit = self.least, SIGNATURE

            @F.pandas_udf("int")
            def matches(size: pd.Series) -> pd.Series:
                return size.map({n: least_matches(int(n), share) for n in size.unique()}).astype("int32")

            sizes = sizes.withColumn("need", matches("size"))
            # Hashes are uniform, so the least values are a sample of the shingles; unsigned order does not matter for that.
            first = F.row_number().over(Window.partitionBy("id", "piece").orderBy("h"))
            shingles = shingles.withColumn("_n", first).where(F.col("_n") <= limit).drop("_n")
        part = F.floor(F.log2("size")).cast("int").alias("part")
        return shingles.drop("need").join(sizes, ["id", "piece"]).select(F.col("id").alias("item_id"), "piece", "h", "size", part, "need")

    def _index(self) -> DataFrame:
        """(h, item_id, part): the rarest values of each signature, as many as must be looked at."""
        often = self.signatures.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
        counted = join_salted(self.signatures, often, "h", hot_keys(often, "h", "n", self.hot_rows), "item_id")
        of = Window.partitionBy("item_id", "piece")
        ranked = counted.withColumn("_place", F.row_number().over(of.orderBy("n", "h"))).withColumn("_k", F.count(F.lit(1)).over(of))
        return ranked.where(F.col("_place") <= F.col("_k") - F.col("need") + 1).select("h", "item_id", "part").distinct()

    @staticmethod
    def _filter(hashes: DataFrame, bits: int) -> np.ndarray:
        """The Bloom filter. Every task joins its hashes' bits by bytes, the bytes are joined by a shuffle, and what reaches the driver is at
        most one row per byte of the table."""

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                slot = np.unique(np.concatenate(list(_probes(batch.column(0).to_numpy().view(np.uint64), bits)))) if len(batch) else np.zeros(0, np.uint64)
                byte = (slot >> np.uint64(3)).astype(np.int64)
                first = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]]) if len(byte) else np.zeros(0, np.int64)
                if len(first):
                    value = np.bitwise_or.reduceat((1 << (slot & np.uint64(7)).astype(np.int64)).astype(np.uint8), first)
                    yield pa.record_batch([pa.array(byte[first]), pa.array(value.astype(np.int16))], names=["byte", "value"])

        packed = hashes.mapInArrow(pack, "byte long, value smallint").groupBy("byte").agg(F.bit_or("value").alias("value")).toArrow()
        table = np.zeros(bits // 8, np.uint8)
        table[packed.column("byte").to_numpy()] = packed.column("value").to_numpy().astype(np.uint8)
        return table

    def partitions(self) -> DataFrame:
        """(part, items, least_size, largest_size, least_share): the size partitions and the containment thresholds they work with."""
        one = self.signatures.groupBy("item_id", "piece").agg(F.first("part").alias("part"), F.first("size").alias("size"), (F.first("need") / F.count(F.lit(1))).alias("share"))
        return one.groupBy("part").agg(F.countDistinct("item_id").alias("items"), F.min("size").alias("least_size"), F.max("size").alias("largest_size"), F.round(F.min("share"), 6).alias("least_share"))

    def candidates(self, hits: DataFrame) -> DataFrame:
        """(doc_id, item_id) of the pairs of which a document holds an indexed value."""
        keys = hits.where("unit is null").select(F.col("id").alias("doc_id"), "h").distinct()
        often = keys.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
        return join_salted(keys, self.index, "h", hot_keys(often, "h", "n", self.hot_rows), "doc_id").select("doc_id", "item_id").distinct()

    def search(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, item_id, passages, containment): pairs that share at least one passage (or the share ``least``), the number of distinct
        passages of the item found in the document, and their share of all its passages. Passages have ``span`` words, or five with ``least``."""
        hits = materialize(self._cut(docs, id_col, text_col, self.filter or _NoFilter()), "leak-hits")
        pairs = materialize(self.candidates(hits), "leak-candidates")
        mine = hits.where("unit is not null").select(F.col("id").alias("doc_id"), "unit").distinct()
        often = pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
        wanted = join_salted(pairs, self.units, "item_id", hot_keys(often, "item_id", "n", self.hot_rows), "doc_id")
        met = wanted.join(mine, ["doc_id", "unit"]).groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("passages"))
        whole = self.units.groupBy("item_id").agg(F.count(F.lit(1)).alias("all_passages"))
        share = F.col("passages") / F.col("all_passages")
        found = join_salted(met, whole, "item_id", hot_keys(often, "item_id", "n", self.hot_rows), "doc_id").where(share >= F.lit(self.least or 0.0) - 1e-9)
        return found.select("doc_id", "item_id", "passages", F.round(share, 6).alias("containment"))


class _NoFilter:
    """Stands for a filter that passes everything."""

    value = (0, None)


def _pieces(rows: np.ndarray, h: np.ndarray, begins: np.ndarray, inner: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, pieces, needs) of the shingles of items: pieces of ``size`` shingles, each of which holds the last inner - 1 of the one
    before. ``need`` is the least number of distinct shingles of a passage in the piece."""
    stretch = h[begins[:, None] + np.arange(inner)]
    stretch.sort(axis=1)
    distinct = 1 + (stretch[:, 1:] != stretch[:, :-1]).sum(axis=1)
    row = rows[begins]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    place = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
    piece = place // max(1, size - inner + 1)
    key = np.r_[True, (row[1:] != row[:-1]) | (piece[1:] != piece[:-1])]
    start = np.flatnonzero(key)
    needs = np.minimum.reduceat(distinct, start)
    ends = np.r_[start[1:], len(row)]
    count = ends - start + inner - 1
    at = np.repeat(begins[start], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return at, np.repeat(piece[start], count).astype(np.int32), np.repeat(needs, count).astype(np.int32)
