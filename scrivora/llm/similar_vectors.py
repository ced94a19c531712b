"""The k most similar vectors by randomly rotated one-bit codes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivora.session import materialize

#: Vectors the cell centres are fitted on, per cell and at most; every vector is indexed. Bounds the driver at 105 MB for 50 numbers.
SAMPLE_PER_CELL, LEAST_SAMPLE, SAMPLE = 32, 8_192, 262_144
#: Vectors a cell should hold, and the most cells there are; bounds the centres sent to executors (13 MB for 50 numbers).
CELL, MAX_CELLS = 512, 65_536
#: Cells whose vectors are dealt with in one group: a query is sent once to a group of neighbouring cells, not to each of its cells.
GROUP_CELLS = 64
#: Vectors and queries of one task at most, about: a fuller group is dealt out to a grid of tasks, each with a part of either.
GROUP_VECTORS, GROUP_QUERIES = 200_000, 200_000
#: Query vectors that are sent to all executors at most (26 MB for 50 numbers); more are dealt out to a grid of tasks.
QUERY_BLOCK = 65_536
#: Vectors of one task of that grid, about.
GRID_VECTORS = 262_144
#: Vectors whose neighbours are sought among all vectors, to learn in which cells neighbours lie.
PROBE_SAMPLE = 1_024
#: Names of the hashes that stand for a vector.
KEY = ("key_a", "key_b")
#: Standard deviations that an estimate may be below the truth before a neighbour is lost.
EPSILON = 3.0
_TILE = 1 << 17


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` numbers, none of them null, NaN or infinite, and not all of them zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dim) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(rows: np.ndarray) -> np.ndarray:
    # Scaled by the largest number first, so that squares can't overflow or vanish.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _rotation(dim: int, seed: int) -> np.ndarray:
    """Orthonormal columns: the first ``dim`` of a random rotation in twice as many dimensions, in whole 64-bit words."""
    bits = -(-2 * dim // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return np.ascontiguousarray((q * np.sign(np.diag(r)))[:, :dim].astype(np.float32))


@dataclass
class Codes:
    """One-bit codes of unit vectors about a centre, with the scalars that correct the estimates."""

    words: np.ndarray  # uint64, one row of words per vector
    along: np.ndarray  # <vector, centre>
    radius: np.ndarray  # length of vector - centre
    fit: np.ndarray  # <code, rotated direction>

    @staticmethod
    def of(vectors: np.ndarray, centre: np.ndarray, rotation: np.ndarray) -> Codes:
        rest = (vectors - centre).astype(np.float32)
        radius = np.sqrt((rest * rest).sum(axis=1))
        turned = (rest / np.maximum(radius, 1e-12)[:, None]) @ rotation.T
        words = np.packbits(turned > 0, axis=1, bitorder="little").view(np.uint64)
        return Codes(words, vectors @ centre, radius, np.maximum(np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1]), 1e-3))


def _estimate(codes: Codes, queries: np.ndarray, centre: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products, queries by vectors, and how far the true ones may be above or below."""
    bits = rotation.shape[0]
    rest = (queries - centre).astype(np.float32)
    radius = np.sqrt((rest * rest).sum(axis=1))
    turned = (rest / np.maximum(radius, 1e-12)[:, None]) @ rotation.T
    # Four bits a number of the query: a product with a code is four masked bit counts.
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / 15, 1e-9)
    level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    summed = np.zeros((len(queries), len(codes.words)), np.float32)
    for j in range(4):
        plane = np.packbits((level >> j) & 1, axis=1, bitorder="little").view(np.uint64)
        for w in range(plane.shape[1]):
            summed += np.bitwise_count(codes.words[None, :, w] & plane[:, w, None]).astype(np.float32) * (1 << j)
    ones = np.bitwise_count(codes.words).sum(axis=1).astype(np.float32)
    offset = bits * low + step * level.sum(axis=1)
    product = (2 * low[:, None] * ones[None, :] + 2 * step[:, None] * summed - offset[:, None]) / np.sqrt(bits)
    scale = radius[:, None] * codes.radius[None, :]
    estimate = (queries @ centre - centre @ centre)[:, None] + codes.along[None, :] + scale * product / codes.fit[None, :]
    spread = np.sqrt(np.maximum(1 - codes.fit**2, 0) / (bits - 1)) / codes.fit
    return estimate, scale * (EPSILON * spread[None, :] + step[:, None] / codes.fit[None, :]) + 1e-5


def nearest(
    queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, least: float | np.ndarray, centre: np.ndarray, rotation: np.ndarray, itself: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, cosine to 9 decimals): of each query the ``k`` most similar vectors with a cosine of at least
    ``least`` (one number, or one per query), ties to the smaller id; with the same id only if ``itself``.

    The 4 k best estimates are compared exactly; their k-th cosine, or ``least`` if that is more, is the bar. Then all
    vectors are compared whose estimate plus error bound reaches the bar. So codes choose, and what is returned is exact.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    centre32 = centre.astype(np.float32)
    codes = Codes.of(vectors, centre32, rotation)
    least = np.broadcast_to(np.asarray(least, np.float64), len(queries))
    tile = max(1, _TILE // max(1, len(ids)))
    first = 4 * k
    for begin in range(0, len(queries), tile):
        q, q_ids, bar = queries[begin : begin + tile], query_ids[begin : begin + tile], least[begin : begin + tile].copy()
        estimate, error = _estimate(codes, q.astype(np.float32), centre32, rotation)
        if not itself:
            estimate[q_ids[:, None] == ids[None, :]] = -9
        upper = estimate + error
        busy = np.flatnonzero((upper >= bar[:, None]).sum(axis=1) > first)
        if len(busy):
            top = np.argpartition(estimate[busy], len(ids) - first, axis=1)[:, len(ids) - first :]
            exact = np.einsum("ij,ikj->ik", q[busy], vectors[top])
            bar[busy] = np.maximum(bar[busy], np.partition(exact, first - k, axis=1)[:, first - k])
        a, b = np.nonzero(upper >= (bar - 1e-8)[:, None].astype(np.float32))
        for part in range(0, len(a), 100_000):
            i, j = a[part : part + 100_000], b[part : part + 100_000]
            exact = np.round(np.einsum("ij,ij->i", q[i], vectors[j]), 9)
            good = exact >= np.maximum(least[begin : begin + tile][i], np.round(bar[i], 9) - 2e-9)
            out.append((q_ids[i[good]], ids[j[good]], exact[good]))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    return best_of(*(np.concatenate(x) for x in zip(*out)), k)


def best_of(query: np.ndarray, other: np.ndarray, cosine: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((other, -cosine, query))
    query, other, cosine = query[order], other[order], cosine[order]
    first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, np.int64)
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
    keep = place < k
    return query[keep], other[keep], cosine[keep]


def _fit_cells(sample: np.ndarray, cells: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means. Starting from random rows puts centres where vectors are many, so a dense third of the collection
    gets a third of the cells."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        home = np.concatenate([(part @ centres.T).argmax(axis=1) for part in np.array_split(sample, max(1, len(sample) // 4096))])
        order = np.argsort(home, kind="stable")
        first = np.flatnonzero(np.r_[True, home[order][1:] != home[order][:-1]])
        mean = np.add.reduceat(sample[order], first, axis=0)
        size = np.sqrt((mean * mean).sum(axis=1, keepdims=True))
        centres[home[order][first]] = np.where(size > 1e-9, mean / np.maximum(size, 1e-9), centres[home[order][first]])
    return centres


def _fit_areas(sample: np.ndarray, cells: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(centres, area of each): areas of about :data:`GROUP_CELLS` cells are fitted first, then the cells of each area on its part of
    the sample, so that the work grows with the cells and not with their square, and the cells of an area lie together."""
    areas = _fit_cells(sample, max(1, cells // GROUP_CELLS), seed)
    home = np.concatenate([(part @ areas.T).argmax(axis=1) for part in np.array_split(sample, max(1, len(sample) // 4096))])
    centres, area_of = [], []
    for a in range(len(areas)):
        mine = sample[home == a]
        if len(mine):
            own = _fit_cells(mine, max(1, round(cells * len(mine) / len(sample))), seed + 1 + a)
            centres.append(own)
            area_of += [a] * len(own)
    return np.concatenate(centres), np.array(area_of, np.int32)


class VectorIndex:
    """Similarity search over unit directions of vectors.

    Equal vectors are collapsed first: each distinct vector has the smallest position as representative and knows the k + 1 smallest
    positions of its group. Only representatives are searched; groups are expanded from the heads, so a group that holds a
    third of all rows costs k pairs a row.

    * :meth:`neighbours` finds the k nearest of every vector. Representatives are assigned to the nearest cell centre (fitted on a
      bounded sample, by default one cell per 512 vectors) and sought in all cells whose centre is nearly as similar as the nearest one.
      How nearly is measured: the true neighbours of a bounded sample are found among all vectors, and the
      margin is the least by which the wanted share of them is reached. So recall does not fall as cells become many. In a cell, one-bit
      codes of the rotated rest estimate all inner products; only vectors whose upper bound reaches the k-th lower bound
      (and the wanted least cosine) are compared exactly. Neighbouring cells form a group, to which a query is sent once.
    * :meth:`search` answers a stated set of queries against all vectors through the same codes; with all vectors as queries it is the way
      without cells, each pair of blocks one task's work.

    Defined cases: vectors that are null, of another length, all zero, or hold null, NaN or infinite numbers, and null positions, take no part; a
    row that comes twice counts once; ties go to the smaller position; fewer than k others give fewer rows; an empty
    table gives no rows; other columns are ignored.
    """

    def __init__(self, df: DataFrame, id_col: str = "doc_pos", vector_col: str = "docs_ser", dim: int = 50, k: int = 5, seed: int = 42):
        self.spark, self.dim, self.k, self.seed = df.sparkSession, dim, k, seed
        rows = df.select(F.col(id_col).cast("long").alias("pos"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("pos").isNotNull() & usable(F.col("v"), dim))
        # Adding 0 makes one of the two zeros. Two hashes of 64 bits stand for a vector.
        same = F.transform("v", lambda x: x + F.lit(0.0))
        rows = rows.withColumns({name: F.xxhash64(F.lit(name), same) for name in KEY})
        self.rows = materialize(rows.select("pos", *KEY, "v"), "vectors")
        place = F.dense_rank().over(Window.partitionBy(*KEY).orderBy("pos"))
        heads = self.rows.select(*KEY, "pos").withColumn("place", place).where(F.col("place") <= k + 1)
        heads = heads.groupBy(*KEY).agg(F.sort_array(F.collect_set("pos")).alias("heads"))
        self.groups = materialize(heads.withColumn("rep", F.col("heads")[0]), "vector-groups")
        reps = self.rows.join(self.groups.select(*KEY, F.col("rep").alias("pos")), [*KEY, "pos"], "left_semi")
        self.reps = materialize(reps.dropDuplicates([*KEY, "pos"]).select(F.col("pos").alias("rep"), "v"), "vector-reps")

    def _centres(self) -> tuple[np.ndarray, np.ndarray]:
        n = self.reps.count()
        cells = max(1, min(MAX_CELLS, n // CELL))
        wanted = min(SAMPLE, max(LEAST_SAMPLE, SAMPLE_PER_CELL * cells))
        share = min(1.0, wanted / max(1, n))
        chosen = self.reps.where(F.pmod(F.xxhash64("rep", F.lit(self.seed)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
        sample = chosen.select("rep", "v").limit(wanted + wanted // 8).toArrow()
        if not len(sample):
            return np.zeros((0, self.dim), np.float32), np.zeros(0, np.int32)
        vectors = np.asarray(sample.column("v").combine_chunks().flatten()).reshape(-1, self.dim)[np.argsort(sample.column("rep").to_numpy())]
        return _fit_areas(_unit(vectors).astype(np.float32), cells, self.seed)

    def margin(self, centres: np.ndarray, least: float, recall: float) -> float:
        """By how much a cell's centre may be less similar to a query than the nearest centre, so that the share ``recall`` of the sample's
        true neighbours with a cosine of at least ``least`` lies in the cells within it. 2, which is all cells, if the sample has none."""
        sample = self.reps.select(F.col("rep").alias("pos"), "v").orderBy(F.xxhash64("rep", F.lit(self.seed + 1)), "rep").limit(PROBE_SAMPLE).toArrow()
        if not len(sample):
            return 2.0
        near = self._scan(sample, least).where(F.col("pos") != F.col("other"))
        place = F.row_number().over(Window.partitionBy("pos").orderBy(F.desc("cosine"), "other"))
        near = near.withColumn("place", place).where(F.col("place") <= self.k).select("pos", F.col("other").alias("rep"))
        # At most PROBE_SAMPLE * k vectors.
        found = self.reps.join(F.broadcast(near), "rep").select("pos", "v").toArrow()
        if not len(found):
            return 2.0
        queries, homes = (_unit(np.asarray(t.column("v").combine_chunks().flatten()).reshape(-1, self.dim)).astype(np.float32) @ centres.T for t in (sample, found))
        order = np.argsort(sample.column("pos").to_numpy())
        asked = queries[order[np.searchsorted(sample.column("pos").to_numpy()[order], found.column("pos").to_numpy())]]
        gap = np.sort(asked.max(axis=1) - asked[np.arange(len(asked)), homes.argmax(axis=1)])
        return float(gap[min(len(gap) - 1, int(np.ceil(recall * len(gap))) - 1)]) + 1e-6

    def neighbours(self, least: float = -1.0, recall: float = 0.95) -> DataFrame:
        """(rep, other, cosine) among representatives: of each the k nearest with a cosine of at least ``least``. ``recall`` is the share of
        these that the cells looked at hold, as measured on a sample; 1 takes the widest margin seen."""
        centres, area_of = self._centres()
        margin = self.margin(centres, least, recall) if len(centres) else 2.0
        shared = self.spark.sparkContext.broadcast((centres, area_of))
        dim, k, seed = self.dim, self.k, self.seed

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, area_of = shared.value
            for batch in batches:
                for begin in range(0, len(batch), 1024):
                    part = batch.slice(begin, 1024)
                    unit = _unit(np.asarray(part.column(1).flatten()).reshape(-1, dim))
                    near = unit.astype(np.float32) @ centres.T
                    home = near.argmax(axis=1)
                    row, cell = np.nonzero(near >= near[np.arange(len(near)), home][:, None] - np.float32(margin))
                    raw, size = unit.tobytes(), dim * 8
                    vectors = pa.array([raw[i : i + size] for i in range(0, len(raw), size)], pa.binary())
                    cells = pa.ListArray.from_arrays(np.searchsorted(row, np.arange(len(near) + 1)).astype(np.int32), pa.array(cell.astype(np.int32)))
                    met = np.unique(np.c_[row, area_of[cell]], axis=0)
                    met = pa.ListArray.from_arrays(np.searchsorted(met[:, 0], np.arange(len(near) + 1)).astype(np.int32), pa.array(met[:, 1].astype(np.int32)))
                    yield pa.record_batch([part.column(0), pa.array(home.astype(np.int32)), pa.array(area_of[home]), cells, met, vectors], names=["rep", "home", "area", "cells", "areas", "unit"])

        placed = materialize(self.reps.mapInArrow(assign, "rep long, home int, area int, cells array<int>, areas array<int>, unit binary"), "vector-cells")
        # One row per area, of which there are at most MAX_CELLS / GROUP_CELLS: into how many parts its vectors and its queries are dealt out.
        at = placed.select(F.explode("areas").alias("at"), "area")
        sizes = at.groupBy("at").agg(F.ceil(F.sum((F.col("at") == F.col("area")).cast("long")) / GROUP_VECTORS).alias("rows"), F.ceil(F.count(F.lit(1)) / GROUP_QUERIES).alias("columns"))
        sizes = F.broadcast(materialize(sizes.select("at", F.greatest("rows", F.lit(1)).cast("int").alias("rows"), F.col("columns").cast("int").alias("columns")), "vector-parts"))
        row, column = (F.pmod(F.xxhash64("rep", F.lit(i)), F.col(n)).cast("int") for i, n in enumerate(("rows", "columns")))
        sent = placed.select(F.explode("areas").alias("at"), "area", "home", "cells", "rep", "unit").join(sizes, "at").withColumns({"row": row, "column": column})
        # A vector goes to all tasks of its own row in its home area, where it is sought as well, and to all tasks of its column in
        # every area in which it is sought.
        own = F.col("at") == F.col("area")
        cross = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda r: F.struct(r.alias("r"), F.col("column").alias("c"), (own & (r == F.col("row"))).alias("held"), F.lit(True).alias("asks")))
        along = F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda c: F.struct(F.col("row").alias("r"), c.alias("c"), F.lit(True).alias("held"), F.lit(False).alias("asks")))
        goes = F.when(own, F.concat(cross, F.filter(along, lambda x: x["c"] != F.col("column")))).otherwise(cross)
        sent = sent.select("at", "home", "cells", "rep", "unit", F.explode(goes).alias("to"))
        sent = sent.select("at", F.col("to.r").alias("r"), F.col("to.c").alias("c"), F.when(F.col("to.held"), F.col("home")).otherwise(F.lit(-1)).alias("home"), F.when(F.col("to.asks"), F.col("cells")).alias("cells"), "rep", "unit")

        def within(key: tuple, table: pa.Table) -> pa.Table:
            centres, area_of = shared.value
            table = table.combine_chunks()
            home, ids = table.column("home").to_numpy(), table.column("rep").to_numpy()
            unit = np.frombuffer(b"".join(table.column("unit").to_pylist()), np.float64).reshape(-1, dim)
            cells = table.column("cells").chunk(0) if table.column("cells").num_chunks else pa.array([], pa.list_(pa.int32()))
            asked, asker = np.asarray(cells.flatten()), np.asarray(pc.list_parent_indices(cells)).astype(np.int64)
            here = area_of[asked] == key[0].as_py()
            asked, asker = asked[here], asker[here]
            order, member = np.argsort(asked, kind="stable"), np.argsort(home, kind="stable")
            rotation = _rotation(dim, seed)
            out = []
            for cell in np.unique(home[home >= 0]).tolist():
                mine = member[np.searchsorted(home[member], cell) : np.searchsorted(home[member], cell, "right")]
                theirs = asker[order[np.searchsorted(asked[order], cell) : np.searchsorted(asked[order], cell, "right")]]
                if len(theirs):
                    out.append(nearest(unit[theirs], ids[theirs], unit[mine], ids[mine], k, least, centres[cell].astype(np.float64), rotation))
            if not out:
                return pa.table({"rep": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
            query, other, cosine = best_of(*(np.concatenate(x) for x in zip(*out)), k)
            return pa.table({"rep": query, "other": other, "cosine": cosine})

        found = sent.groupBy("at", "r", "c").applyInArrow(within, "rep long, other long, cosine double")
        best = Window.partitionBy("rep").orderBy(F.desc("cosine"), "other")
        return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("rep", "other", "cosine")

    def expand(self, near: DataFrame) -> DataFrame:
        """(pos, other, cosine) for all positions, copies included, from the nearest representatives of representatives."""
        groups, k = self.groups, self.k
        heads = groups.select("rep", F.explode("heads").alias("pos"))
        others = near.join(groups.select(F.col("rep").alias("other"), "heads"), "other").select("rep", F.explode("heads").alias("other"), "cosine")
        copies = groups.where(F.size("heads") > 1).select("rep", F.explode("heads").alias("other"), F.lit(1.0).alias("cosine"))
        # Members outside the heads have k copies with smaller positions, and any of them is as near as can be.
        best = Window.partitionBy("pos").orderBy(F.desc("cosine"), "other")
        mine = heads.join(others.unionByName(copies), "rep").where(F.col("pos") != F.col("other"))
        mine = mine.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("pos", "other", "cosine")
        full = groups.where(F.size("heads") > k).select(*KEY, "heads")
        late = self.rows.select("pos", *KEY).join(full, [*KEY]).where(~F.array_contains("heads", F.col("pos"))).select("pos", F.explode(F.slice("heads", 1, k)).alias("other"), F.lit(1.0).alias("cosine")).distinct()
        return mine.unionByName(late)

    def search(self, queries: DataFrame) -> DataFrame:
        """(pos, other, cosine): the k nearest of each query among all vectors. ``queries`` holds positions (``pos``) of this index. Up to
        :data:`QUERY_BLOCK` of them are sent to the executors, which keep k candidates a query and task; more are dealt out to blocks, and each
        block meets each part of the vectors in a task of its own."""
        asked = self.rows.join(queries.select("pos").distinct(), "pos", "left_semi").dropDuplicates(["pos"])
        asked = materialize(asked.select("pos", "v"), "vector-queries")
        n = asked.count()
        found = self._scan(asked.toArrow()) if n <= QUERY_BLOCK else self._grid(asked, n)
        # A query's copies stand in its own group; of other groups up to k + 1 smallest positions are known.
        groups = self.groups.select(F.col("rep").alias("other"), "heads")
        wide = found.join(groups, "other").select("pos", F.explode("heads").alias("other"), "cosine")
        best = Window.partitionBy("pos").orderBy(F.desc("cosine"), "other")
        wide = wide.where(F.col("pos") != F.col("other"))
        return wide.withColumn("place", F.row_number().over(best)).where(F.col("place") <= self.k).select("pos", "other", "cosine")

    def _grid(self, asked: DataFrame, n: int) -> DataFrame:
        blocks, parts = -(-n // QUERY_BLOCK), -(-self.reps.count() // GRID_VECTORS)
        dim, k, seed = self.dim, self.k, self.seed

        def dealt(df: DataFrame, key: str, own: str, count: int, other: str, others: int) -> DataFrame:
            place = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(count)).cast("int").alias(own)
            return df.select(place, F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other), key, "v").groupBy("block", "part")

        def meet(key: tuple, queries: pa.Table, vectors: pa.Table) -> pa.Table:
            q, v = (_unit(np.asarray(t.column("v").combine_chunks().flatten()).reshape(-1, dim)) if len(t) else np.zeros((0, dim)) for t in (queries, vectors))
            found = nearest(q, queries.column(2).to_numpy(), v, vectors.column(2).to_numpy(), k + 1, -1.0, np.zeros(dim), _rotation(dim, seed), itself=True) if len(q) and len(v) else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
            return pa.table({"pos": found[0], "other": found[1], "cosine": found[2]})

        near = dealt(asked, "pos", "block", blocks, "part", parts).cogroup(dealt(self.reps, "rep", "part", parts, "block", blocks)).applyInArrow(meet, "pos long, other long, cosine double")
        best = Window.partitionBy("pos").orderBy(F.desc("cosine"), "other")
        return near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).drop("place")

    def _scan(self, block: pa.Table, least: float = -1.0) -> DataFrame:
        dim, k, seed = self.dim, self.k, self.seed
        vectors = _unit(np.asarray(block.column("v").combine_chunks().flatten()).reshape(-1, dim)) if len(block) else np.zeros((0, dim))
        shared = self.spark.sparkContext.broadcast((vectors, block.column("pos").to_numpy()))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries, query_ids = shared.value
            rotation = _rotation(dim, seed)
            kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            order = np.argsort(query_ids)
            bar = np.full(len(queries), least)
            for batch in batches:
                for begin in range(0, len(batch), 8192):
                    part = batch.slice(begin, 8192)
                    unit = _unit(np.asarray(part.column(1).flatten()).reshape(-1, dim))
                    # The query's own vector is wanted as well, for its copies.
                    found = nearest(queries, query_ids, unit, part.column(0).to_numpy(), k + 1, bar, np.zeros(dim), rotation, itself=True)
                    kept = best_of(*(np.concatenate(x) for x in zip(kept, found)), k + 1)
                    # The k + 1st cosine so far is a bar for all that follows.
                    last = np.flatnonzero(np.r_[kept[0][1:] != kept[0][:-1], True])
                    full = np.diff(np.r_[-1, last]) == k + 1
                    bar[order[np.searchsorted(query_ids[order], kept[0][last[full]])]] = kept[2][last[full]]
            if len(kept[0]):
                yield pa.record_batch([pa.array(kept[0]), pa.array(kept[1]), pa.array(kept[2])], names=["pos", "other", "cosine"])

        near = self.reps.mapInArrow(scan, "pos long, other long, cosine double")
        best = Window.partitionBy("pos").orderBy(F.desc("cosine"), "other")
        return near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).drop("place")
