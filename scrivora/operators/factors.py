"""Truncated singular value decomposition of a long-form sparse matrix, and search in its latent space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivora.functions.text import RANKS, index_folder
from scrivora.functions.vectors import cosine, norm, truncated
from scrivora.operators.blocks import BUCKET_CELLS, BlockedMatrix, dealt, dealt_numbers, leading_triplets, sparse_sums
from scrivora.operators.index import TextIndex
from scrivora.operators.search import DECIMALS, one_query, query_vectors, with_documents
from scrivora.operators.skew import join_salted
from scrivora.session import materialize, release
from scrivora.sources.articles import exists

#: Singular values up to this are dropped; entries of a low-rank matrix up to the other count as 0.
LEAST_SIGMA, LEAST_ENTRY = 1e-6, 1e-10
#: Documents of a block and terms of a part in :meth:`Factors.low_rank_matrix`, about; a task holds their product (32 MB).
BLOCK = 2048
#: The same in :meth:`Factors.strongest_terms`, where a task makes :data:`ENTRIES` entries at once.
STRONGEST_BLOCK, STRONGEST_PART, ENTRIES = 1024, 8192, 1 << 17
#: Terms of a part, about, when :func:`residuals` adds the sums of its buckets.
RESIDUAL_PART = 65_536


def matvec(postings: DataFrame, x: DataFrame) -> DataFrame:
    """(term, value) = A x for x as (id, value)."""
    return postings.join(x, "id").groupBy("term").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def rmatvec(postings: DataFrame, y: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """(id, value) = Aᵀ y for y as (term, value); ``hot`` are the terms whose postings are split (:meth:`TextIndex.hot`)."""
    return join_salted(postings, y, "term", hot).groupBy("id").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def _signed(postings: DataFrame, key: str, width: int, seed: int) -> DataFrame:
    """A random block by hashes of the keys, the same however the rows are partitioned."""
    chance = [(F.xxhash64(F.col(key), F.lit(seed), F.lit(i)) / F.lit(2.0**63)).alias(f"c{i}") for i in range(width)]
    return postings.select(key).distinct().select(key, F.array(*chance).alias("y"))


def power_step(postings: DataFrame, v: DataFrame, known: list[tuple[float, DataFrame, DataFrame]] = ()) -> tuple[DataFrame, DataFrame, float]:
    """One step of power iteration from documents' side: (u, v, sigma) with u = A v / |A v| and v = Aᵀ u / |Aᵀ u|. Factors already
    known are deflated implicitly: A v - Σ sigma u (v_known · v); the dense update is never formed."""
    u = _unit_vector(_deflated(matvec(postings, v), known, v, "term", 0), "term")
    w = _deflated(rmatvec(postings, u[0]), known, u[0], "id", 1)
    out = _unit_vector(w, "id")
    return u[0], out[0], out[1]


def _deflated(raw: DataFrame, known, source: DataFrame, key: str, side: int) -> DataFrame:
    for sigma, u, v in known:
        have, target = (v, u) if side == 0 else (u, v)
        other = "id" if side == 0 else "term"
        share = source.join(have.withColumnRenamed("value", "h"), other).agg(F.sum(F.col("value") * F.col("h"))).head()[0] or 0.0
        moved = target.select(key, (F.col("value") * F.lit(-sigma * share)).alias("value"))
        raw = raw.unionByName(moved).groupBy(key).agg(F.sum("value").alias("value"))
    return raw


def _unit_vector(x: DataFrame, key: str) -> tuple[DataFrame, float]:
    x = materialize(x, "vector")
    size = float(x.agg(F.sqrt(F.sum(F.col("value") * F.col("value")))).head()[0] or 0.0)
    return x.select(key, (F.col("value") / F.lit(size or 1.0)).alias("value")), size


def power_factors(postings: DataFrame, k: int, iterations: int = 30, tolerance: float = 1e-6, start: DataFrame | None = None) -> list[tuple[float, DataFrame, DataFrame]]:
    """The first ``k`` (sigma, u, v) by power iteration with implicit deflation; stops where sigma vanishes. ``start`` gives the
    first vector over documents, by default hashes."""
    known: list[tuple[float, DataFrame, DataFrame]] = []
    for i in range(k):
        v = start if start is not None else _signed(postings, "id", 1, i).select("id", F.col("y")[0].alias("value"))
        sigma = 0.0
        for _ in range(iterations):
            u, v, now = power_step(postings, v, known)
            done = abs(now - sigma) <= tolerance * max(now, 1.0)
            sigma = now
            if done:
                break
        if sigma <= LEAST_SIGMA:
            break
        known.append((sigma, u, v))
    return known


@dataclass
class Factors:
    """A ≈ U Σ Vᵀ: sigma (falling), term vectors (term, u) and document vectors (id, v), those scaled by sigma."""

    sigma: np.ndarray
    terms: DataFrame
    documents: DataFrame

    @staticmethod
    def fit(postings: DataFrame, k: int = 25, oversampling: int = 50, tolerance: float = 1e-8, seed: int = 42, most_products: int = 200) -> Factors:
        """The ``k`` leading triplets by a restarted block Krylov method (:func:`~scrivora.operators.blocks.leading_triplets`), to a residual
        |A v - sigma u| of at most ``tolerance`` · sigma, by which sigma itself is right to about its square.

        Postings without weight are left out; none at all is an error, as is a residual above ``tolerance`` after ``most_products`` products.
        """
        matrix = BlockedMatrix(postings, seed)
        sigma, state, residual = leading_triplets(matrix, k, oversampling, tolerance, seed, most_products)
        if residual > tolerance:
            raise ValueError(f"no convergence: the residual is {residual}")
        sigma = sigma[sigma > max(LEAST_SIGMA, sigma.max(initial=0.0) * 1e-7)]
        if not len(sigma):
            raise ValueError("no singular value is large enough")
        rank = len(sigma)
        whole, state = state, matrix.turned(state, np.eye(min(k, matrix.n_documents, matrix.n_terms))[:, :rank])
        release(whole)
        terms, documents = matrix.terms(state, rank), matrix.documents(state, rank)
        fitted = Factors(sigma, materialize(terms.withColumnRenamed("y", "u"), "term-vectors"), materialize(documents.withColumnRenamed("y", "v"), "document-vectors"))
        release(state)
        matrix.close()
        return fitted

    @property
    def rank(self) -> int:
        return len(self.sigma)

    def sigma_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, float(s)) for i, s in enumerate(self.sigma)], "i int, sigma double")

    def save(self, path: str) -> None:
        spark = self.terms.sparkSession
        self.sigma_table(spark).write.mode("overwrite").parquet(f"{path}/sigma")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.documents.write.mode("overwrite").parquet(f"{path}/documents")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Factors:
        sigma = np.array([r["sigma"] for r in spark.read.parquet(f"{path}/sigma").orderBy("i").collect()])
        return Factors(sigma, spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/documents"))

    def fold(self, vectors: DataFrame, k: int) -> list[float]:
        """Uᵀ q cut to ``k`` numbers, for one query as (term, weight)."""
        sums = [F.coalesce(F.sum(F.col("weight") * F.col("u")[i]), F.lit(0.0)) for i in range(k)]
        return [float(x) for x in self.terms.join(F.broadcast(vectors), "term").agg(*sums).head()]

    def truncated(self, k: int) -> Factors:
        """The first ``k`` triplets."""
        return Factors(self.sigma[:k], self.terms.select("term", truncated(F.col("u"), k).alias("u")), self.documents.select("id", truncated(F.col("v"), k).alias("v")))

    @staticmethod
    def save_ranks(postings: DataFrame, path: str, ranks: tuple[int, ...] = RANKS) -> None:
        """One folder ``svd_k=…`` per rank under ``path``, all cut from one factorisation."""
        fitted = Factors.fit(postings, max(ranks))
        for k in ranks:
            fitted.truncated(k).save(f"{path}/{index_folder(k)}")
        release(fitted.terms, fitted.documents)

    @staticmethod
    def load_or_build(postings: DataFrame, path: str, k: int = 25, ranks: tuple[int, ...] = RANKS) -> Factors:
        """The stored factors of the least rank that holds ``k``; all ranks are built if that one is missing."""
        rank = min((r for r in ranks if r >= k), default=max(ranks))
        folder = f"{path}/{index_folder(rank)}"
        if not exists(postings.sparkSession, f"{folder}/sigma"):
            Factors.save_ranks(postings, path, ranks)
        return Factors.load(postings.sparkSession, folder)

    def search(self, index: TextIndex, text: str, limit: int = 10, k: int | None = None, mode: str = "raw") -> DataFrame:
        """(score, title, url, id, text), best first, by cosine in the latent space. With ``k`` only the first k numbers count (at most the
        rank), and a query without known words gives no rows; without ``k`` it gives documents of score 0."""
        cut = self.rank if k is None else max(1, min(k, self.rank))
        asked = self.fold(query_vectors(one_query(index, text), index.terms, mode).select("term", "weight"), cut)
        query = F.array(*map(F.lit, asked))
        score = F.round(cosine(truncated(F.col("v"), cut), query, 1e-12 if k is None else 1e-10), DECIMALS)
        if k is not None and float(np.linalg.norm(asked)) <= 1e-10:
            return with_documents(index.documents.select("id", F.lit(0.0).alias("score")).limit(0), index.documents, 0)
        found = self.documents.select("id", score.alias("score"))
        full = index.documents.select("id").join(found, "id", "left").fillna(0.0, ["score"])
        return with_documents(full.orderBy(F.desc("score"), "id").limit(limit), index.documents, limit)

    def _dealt(self, documents: DataFrame, k: int | None, block: int, part: int):
        """(left, right, cut): the stated documents, dealt out to blocks of about ``block``, and all terms, to parts of about ``part``, both grouped
        by pairs of block and part, with the first ``cut`` numbers of their vectors."""
        cut = self.rank if k is None else max(1, min(k, self.rank))
        asked = materialize(self.documents.join(documents.select("id").distinct(), "id", "left_semi").select("id", truncated(F.col("v"), cut).alias("x")), "asked")
        number = {"block": max(1, -(-asked.count() // block)), "part": max(1, -(-self.terms.count() // part))}

        def placed(df: DataFrame, own: str, other: str, key: str):
            place = F.pmod(F.xxhash64(key), F.lit(number[own])).cast("int").alias(own)
            return df.select(place, F.explode(F.sequence(F.lit(0), F.lit(number[other] - 1))).alias(other), key, "x").groupBy("block", "part")

        return placed(asked, "block", "part", "id"), placed(self.terms.select("term", truncated(F.col("u"), cut).alias("x")), "part", "block", "term"), cut

    def low_rank_matrix(self, documents: DataFrame, k: int | None = None) -> DataFrame:
        """(id, term, weight): the stated documents' columns of the low-rank matrix U_k Σ_k V_kᵀ, each normalised to length 1. What a
        triplet adds to an entry counts only above 1e-10; entries to which nothing is added are left out.

        Documents are dealt out to blocks and terms to parts, and every pair of block and part is one task's work, so neither
        side is gathered. The result has up to one row per stated document and term; state as many as are wanted.
        """
        left, right, cut = self._dealt(documents, k, BLOCK, BLOCK)

        def entries(key: tuple, docs: pa.Table, terms: pa.Table) -> pa.Table:
            v, u = (np.asarray(t.column("x").combine_chunks().flatten()).reshape(-1, cut) for t in (docs, terms))
            total, held = _entries(v, u)
            i, j = np.nonzero(held)
            return pa.table({"id": docs.column("id").combine_chunks().take(pa.array(i)), "term": terms.column("term").combine_chunks().take(pa.array(j)), "weight": pa.array(total[i, j])})

        found = materialize(left.cogroup(right).applyInArrow(entries, "id long, term string, weight double"), "low-rank")
        size = found.groupBy("id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("size")).where(F.col("size") > 0)
        return found.join(size, "id").select("id", "term", F.round(F.col("weight") / F.col("size"), DECIMALS).alias("weight"))

    def strongest_terms(self, documents: DataFrame, k: int | None = None, limit: int = 20) -> DataFrame:
        """(id, term, weight): of the stated documents the ``limit`` entries of :meth:`low_rank_matrix` that are largest by amount.

        The matrix is not written: a pair of block and part hands on the sum of squares of each document and those entries only that may be
        among the largest once they are divided by the document's length and rounded. Ties go to the smaller term.
        """
        left, right, cut = self._dealt(documents, k, STRONGEST_BLOCK, STRONGEST_PART)

        def strongest(key: tuple, docs: pa.Table, terms: pa.Table) -> pa.Table:
            v, u = (np.asarray(t.column("x").combine_chunks().flatten()).reshape(-1, cut) for t in (docs, terms))
            rows, columns, weights, squares = [], [], [], np.zeros(len(v))
            step, ordered = max(1, ENTRIES // max(1, len(u))), _ordered(u)
            for begin in range(0, len(v) if len(u) else 0, step):
                total, held = _entries(v[begin : begin + step], u, ordered)
                squares[begin : begin + step] = (total * total).sum(axis=1)
                # Entries that are as large as the last one of the list after rounding: a column is no longer than v, but for what counted as 0.
                size = np.abs(np.where(held, total, 0.0))
                slack = 10.0**-DECIMALS * (1.01 * np.sqrt((v[begin : begin + step] ** 2).sum(axis=1)) + cut * LEAST_ENTRY * spread)
                least = np.partition(size, -limit, axis=1)[:, -limit] - slack if 0 < limit <= len(u) else np.zeros(len(size))
                i, j = np.nonzero(held & (size >= least[:, None]))
                rows.append(i + begin)
                columns.append(j)
                weights.append(total[i, j])
            none = [np.zeros(0, np.int64)]
            i, j, w = np.concatenate(rows or none), np.concatenate(columns or none), np.concatenate(weights or none).astype(np.float64)
            ids, n = docs.column("id").combine_chunks(), len(v)
            # The sums of squares are rows without a term.
            return pa.table({"id": pa.concat_arrays([ids, ids.take(pa.array(i))]), "term": pa.concat_arrays([pa.nulls(n, pa.string()), terms.column("term").combine_chunks().cast(pa.string()).take(pa.array(j))]), "weight": pa.array(np.concatenate([squares, w]))})

        spread = self.terms.count() ** 0.5
        found = materialize(left.cogroup(right).applyInArrow(strongest, "id long, term string, weight double"), "strongest")
        size = found.where(F.col("term").isNull()).groupBy("id").agg(F.sqrt(F.sum("weight")).alias("size")).where(F.col("size") > 0)
        entries = found.where(F.col("term").isNotNull()).join(size, "id").select("id", "term", F.round(F.col("weight") / F.col("size"), DECIMALS).alias("weight"))
        best = Window.partitionBy("id").orderBy(F.desc(F.abs("weight")), "term")
        return entries.withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit).select("id", "term", "weight")


def _ordered(u: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per column of ``u`` the rows in the order of their amount, their amounts and their numbers."""
    orders = [np.argsort(np.abs(column), kind="stable") for column in u.T]
    return [(order, np.abs(column[order]), column[order]) for order, column in zip(orders, u.T)]


def _entries(v: np.ndarray, u: np.ndarray, ordered: list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(total, held): the sums over i of v[:, i] · u[:, i] above :data:`LEAST_ENTRY`, and where there is any. All are added at once, then what is
    too small is taken out, which is the begin of the order of u[:, i]."""
    total, out = v @ u.T, np.zeros((len(v), len(u)), np.int32)
    for i, (order, amounts, numbers) in enumerate(_ordered(u) if ordered is None else ordered):
        with np.errstate(divide="ignore"):
            ends = np.searchsorted(amounts, LEAST_ENTRY / np.abs(v[:, i]) * (1 + 1e-12), "right")
        for d in np.flatnonzero(ends).tolist():
            at, part = order[: ends[d]], v[d, i] * numbers[: ends[d]]
            small = np.abs(part) <= LEAST_ENTRY
            total[d, at] -= part * small
            out[d, at] += small
    held = out < v.shape[1]
    total[~held] = 0.0
    return total, held


def gram_matrix(postings: DataFrame, documents: DataFrame) -> DataFrame:
    """(i, j, value): inner products of the stated documents' columns, those without a common term left out."""
    mine = postings.join(documents.select("id").distinct(), "id", "left_semi")
    mine = materialize(mine.select("id", "term", "weight"), "stated")
    other = mine.select(F.col("id").alias("j"), "term", F.col("weight").alias("w"))
    return mine.join(other, "term").groupBy(F.col("id").alias("i"), "j").agg(F.sum(F.col("weight") * F.col("w")).alias("value"))


def residuals(factors: Factors, postings: DataFrame) -> list[tuple[int, float, float]]:
    """(i, |A v - sigma u| / sigma, |Aᵀ u - sigma v| / sigma) of every triplet, from the postings themselves.

    Documents are dealt out to buckets of about :data:`BUCKET_CELLS` postings. A bucket is sent the vectors of its documents and of the terms that
    occur in it, and hands on one sum per term; those are added by parts of the terms. No posting is met by a vector in a join.
    """
    k, spark = factors.rank, postings.sparkSession
    cores, size, seed = spark.sparkContext.defaultParallelism, factors.terms.agg(F.count(F.lit(1))).head()[0], 0
    while factors.terms.select(F.xxhash64("term", F.lit(seed))).distinct().count() < size:
        seed += 1
    buckets = dealt_numbers(spark, -(-max(1, postings.count()) // (BUCKET_CELLS * cores)) * cores)
    parts = dealt_numbers(spark, max(cores, -(-size // RESIDUAL_PART)))
    bucket, term, nothing = dealt(buckets, F.xxhash64("id")).alias("bucket"), F.xxhash64("term", F.lit(seed)).alias("term"), F.lit(None).cast("long")
    terms = factors.terms.select(term, F.col("u").alias("x"))
    cells = postings.select(bucket, "id", term, F.col("weight").cast("double").alias("weight"))
    wanted = cells.select("bucket", "term").distinct().join(terms, "term", "left")
    have = factors.documents.select(bucket, "id", nothing.alias("term"), F.col("v").alias("x")).unionByName(wanted.select("bucket", nothing.alias("id"), "term", "x"))

    def by_bucket(key: tuple, cells: pa.Table, have: pa.Table) -> pa.Table:
        is_term = have.column("term").is_valid()
        terms, docs = have.filter(is_term).sort_by("term"), have.filter(pc.invert(is_term))
        names, ids, v_ids = terms.column("term").to_numpy(), cells.column("id").to_numpy(), docs.column("id").to_numpy()
        all_ids = np.union1d(v_ids, ids)
        u, v = _rows(terms.column("x"), k), np.zeros((len(all_ids), k))
        v[np.searchsorted(all_ids, v_ids)] = _rows(docs.column("x"), k)
        column, row, weight = np.searchsorted(names, cells.column("term").to_numpy()), np.searchsorted(all_ids, ids), cells.column("weight").to_numpy()
        gap = _cell_sums(row, column, weight, u, len(all_ids)) - v
        sums = np.vstack([_cell_sums(column, row, weight, v, len(names)), (gap * gap).sum(axis=0)])
        # The last row, without a term, has the squares of the documents' side.
        return pa.table({"term": pa.concat_arrays([pa.array(names, pa.int64()), pa.nulls(1, pa.int64())]), "x": _lists(sums)})

    found = materialize(cells.groupBy("bucket").cogroup(have.groupBy("bucket")).applyInArrow(by_bucket, "term long, x array<double>"), "residuals")
    right = _added(found.where(F.col("term").isNull()), k)
    squared = factors.sigma.astype(np.float64) ** 2

    def by_part(key: tuple, sums: pa.Table, terms: pa.Table) -> pa.Table:
        # The document vectors hold sigma v, so A (sigma v) is compared with sigma² u.
        names, place = np.unique(np.concatenate([sums.column("term").to_numpy(), terms.column("term").to_numpy()]), return_inverse=True)
        gap, n = np.zeros((len(names), k)), len(sums)
        order = np.argsort(place[:n], kind="stable")
        starts = np.flatnonzero(np.diff(place[order], prepend=-1))
        if n:
            gap[place[order[starts]]] = np.add.reduceat(_rows(sums.column("x"), k)[order], starts, axis=0)
        gap[place[n:]] -= _rows(terms.column("x"), k) * squared
        return pa.table({"x": _lists((gap * gap).sum(axis=0, keepdims=True))})

    def parted(df: DataFrame):
        return df.select(dealt(parts, F.col("term")).alias("part"), "term", "x").groupBy("part")

    left = _added(parted(found.where(F.col("term").isNotNull())).cogroup(parted(terms)).applyInArrow(by_part, "x array<double>"), k)
    release(found)
    return [(i, float(np.sqrt(left[i])) / float(x) ** 2, float(np.sqrt(right[i])) / float(x)) for i, x in enumerate(factors.sigma)]


def _rows(column: pa.ChunkedArray, k: int) -> np.ndarray:
    """The lists of ``k`` numbers as rows; a missing list is a row of zeros."""
    out = np.zeros((len(column), k))
    there = np.flatnonzero(column.is_valid().to_numpy())
    out[there] = np.asarray(column.drop_null().combine_chunks().flatten()).reshape(-1, k)
    return out


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))


def _cell_sums(to: np.ndarray, at: np.ndarray, weight: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Row i: the sum of weight · x[at] over the cells with ``to`` = i."""
    order = np.argsort(to, kind="stable")
    starts = np.searchsorted(to[order], np.arange(n + 1))
    return sparse_sums(starts, at[order], weight[order], x)


def _added(df: DataFrame, k: int) -> list[float]:
    return [float(x or 0.0) for x in df.agg(*[F.sum(F.col("x")[i]) for i in range(k)]).head()]


def column_products(vectors: DataFrame, column: str, scale: list[float]) -> DataFrame:
    """(at, product): inner products of the columns of all vectors, each divided by its scale, at i · k + j. A task multiplies its rows as
    matrices and hands on k² sums."""
    k, by = len(scale), np.asarray(scale, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            x = _rows(pa.chunked_array([batch.column(0)]), k) / by
            total += x.T @ x
        yield pa.record_batch([pa.array(np.arange(k * k, dtype=np.int32)), pa.array(total.ravel())], names=["at", "product"])

    return vectors.select(column).mapInArrow(run, "at int, product double").groupBy("at").agg(F.sum("product").alias("product"))


def latent_neighbours(vectors: DataFrame, query: list[float], k: int, limit: int, id_col: str = "doc_pos", vector_col: str = "docs_ser") -> DataFrame:
    """(id, score): stored vectors by cosine with ``query`` after a cut to ``k`` numbers. Null vectors, vectors that are shorter
    than the cut and vectors with NaN take no part."""
    cut = truncated(F.col(vector_col), k)
    good = (F.size(cut) == k) & ~F.exists(cut, lambda x: F.isnan(x) | x.isNull())
    score = F.round(cosine(F.col("v"), F.array(*map(F.lit, query[:k])), 1e-10), DECIMALS)
    found = vectors.where(F.col(vector_col).isNotNull() & good).select(F.col(id_col).alias("id"), cut.alias("v")).select("id", score.alias("score")).distinct()
    return found.orderBy(F.desc("score"), "id").limit(limit)


def vector_norms(vectors: DataFrame, id_col: str = "doc_pos", vector_col: str = "docs_ser") -> DataFrame:
    return vectors.select(F.col(id_col).alias("id"), F.round(norm(F.col(vector_col)), DECIMALS).alias("norm"))
