"""A sparse matrix packed into blocks, and its leading singular triplets by a restarted block Krylov method.

The rows of the dense side are the terms. They are dealt out to parts by a hash; the columns (documents) to buckets. A
bucket holds its piece of the matrix in compressed form and is sent only the rows of the terms that occur in it, so a term found in
every document costs one row a bucket and product. One product with A Aᵀ of the newest columns of the dense side is one
cogroup with the buckets and one sum per part; what reaches the driver are projected matrices whose size
depends on the number of wanted triplets only.
"""

from __future__ import annotations

import gc
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivora.session import materialize, release

#: Postings of a bucket, about; numbers a task multiplies at once, which stay in its core's cache.
BUCKET_CELLS, STEP_NUMBERS = 2_000_000, 1 << 18
#: Rows of so few cells are multiplied together, the others one by one.
FEW_CELLS = 8
#: Rows of a part at most, about, and rows that one part sends in one product, to all buckets together.
PART_ROWS, SENT_ROWS = 16_384, 4_000_000
#: Blocks by which a basis grows before it is cut back.
GROWTH = 4
#: Parts whose sums reach the driver as they are; those of more are added in tasks first. And tasks whose sums reach it.
DRIVER_PARTS, DRIVER_SUMS = 64, 16
#: Where what is outside of the basis has less than this share of a product's square, the difference of squares is too coarse.
COARSE = 1e-6
#: What is below this share of the largest eigenvalue is a rounding error.
NOISE = 1e-13

_STATE = "part int, n int, basis binary, image binary"


def dealt_numbers(spark: SparkSession, n: int) -> list[int]:
    """``n`` different numbers, of which a shuffle by their hash gives every partition as many as any other, or one less."""
    partitions, found, begin = int(spark.conf.get("spark.sql.shuffle.partitions")), defaultdict(list), 0
    each = -(-n // partitions)
    while sum(len(x) >= each for x in found.values()) < min(partitions, n):
        numbers = spark.range(begin, begin + 8 * (n + partitions), numPartitions=1).select(F.col("id").cast("int").alias("number"))
        for number, place in numbers.select("number", F.pmod(F.hash("number"), F.lit(partitions))).collect():
            found[place].append(number)
        begin += 8 * (n + partitions)
    return [found[place][turn] for turn in range(each) for place in sorted(found) if turn < len(found[place])][:n]


def dealt(numbers: list[int], key: Column) -> Column:
    """The number that a hashed key is dealt to."""
    return F.element_at(F.array(*map(F.lit, numbers)), (F.pmod(key, F.lit(len(numbers))) + 1).cast("int"))


def _matrix(blob: bytes | None, n: int) -> np.ndarray:
    return np.frombuffer(blob or b"", np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def sparse_sums(starts: np.ndarray, places: np.ndarray, weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row i: the sum of weights · x[places] over starts[i] up to starts[i + 1]."""
    out = np.zeros((len(starts) - 1, x.shape[1]))
    size = np.diff(starts)
    most = max(1, STEP_NUMBERS // max(1, x.shape[1]))
    for n in range(1, FEW_CELLS + 1):
        rows = np.flatnonzero(size == n)
        for begin in range(0, len(rows), max(1, most // n)):
            some = rows[begin : begin + max(1, most // n)]
            at = starts[some, None] + np.arange(n)
            out[some] = np.matmul(weights[at][:, None, :], x[places[at]])[:, 0]
    for i in np.flatnonzero(size > FEW_CELLS).tolist():
        for begin in range(int(starts[i]), int(starts[i + 1]), most):
            end = min(int(starts[i + 1]), begin + most)
            out[i] += weights[begin:end] @ x.take(places[begin:end], axis=0)
    return out


def _table(columns: dict[str, tuple[list, pa.DataType]]) -> pa.Table:
    return pa.table({name: pa.array(values, kind) for name, (values, kind) in columns.items()})


class BlockedMatrix:
    """The packed form of postings (id, term, weight); weights of 0 are left out, entries of one place are added."""

    def __init__(self, postings: DataFrame, seed: int = 42):
        self.spark = postings.sparkSession
        cells = postings.where(F.col("weight") != 0).select("id", "term", "weight")
        size = cells.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("term", 0.02).alias("t")).head()
        if not size["n"]:
            raise ValueError("the matrix is empty")
        cores = self.spark.sparkContext.defaultParallelism
        self.buckets = max(cores, -(-size["n"] // BUCKET_CELLS))
        self.buckets = -(-self.buckets // cores) * cores
        self.parts = max(cores, -(-size["t"] // max(64, min(PART_ROWS, SENT_ROWS // self.buckets))))
        self.bucket_numbers, self.part_numbers = dealt_numbers(self.spark, self.buckets), dealt_numbers(self.spark, self.parts)
        while not self._pack(cells, seed):
            seed += 1

    def _pack(self, cells: DataFrame, seed: int) -> bool:
        """Make the tables; whether no two terms share a key, a hash under ``seed``."""
        parts, numbered = self.parts, np.array(self.part_numbers)
        keyed = cells.withColumn("key", F.xxhash64("term", F.lit(seed)))

        def names(key: tuple, t: pa.Table) -> pa.Table:
            t = t.combine_chunks().sort_by("key")
            keys = t.column("key").to_numpy()
            return _table({"part": ([key[0].as_py()], pa.int32()), "n": ([len(keys)], pa.int32()), "keys": ([keys.tobytes()], pa.binary()), "terms": ([t.column("term").to_pylist()], pa.list_(pa.string())), "clashes": ([int((keys[1:] == keys[:-1]).sum())], pa.int64())})

        distinct = keyed.select("term", "key").distinct().withColumn("part", dealt(self.part_numbers, F.col("key")))
        self.names = materialize(distinct.groupBy("part").applyInArrow(names, "part int, n int, keys binary, terms array<string>, clashes long"), "matrix-terms")
        found = self.names.agg(F.sum("n").alias("n"), F.sum("clashes").alias("clashes")).head()
        if found["clashes"]:
            release(self.names)
            return False
        self.n_terms = int(found["n"])

        def pack(key: tuple, t: pa.Table) -> pa.Table:
            ids, row = np.unique(t.column("id").to_numpy(), return_inverse=True)
            keys, column = np.unique(t.column("key").to_numpy(), return_inverse=True)
            # Columns in the order of their parts, as pieces arrive.
            part = numbered[np.mod(keys, parts)]
            order = np.argsort(part, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            keys, part, column = keys[order], part[order], place[column]
            weight = t.column("weight").to_numpy().astype(np.float64)
            by_row = np.lexsort((column, row))
            row, column, weight = row[by_row], column[by_row], weight[by_row]
            turn = np.argsort(column, kind="stable")
            numbers, first = np.unique(part, return_index=True)
            pieces = [keys[a:b].tobytes() for a, b in zip(first, [*first[1:], len(keys)])]
            starts = [np.searchsorted(x, np.arange(n + 1)).astype(np.int64).tobytes() for x, n in ((row, len(ids)), (column[turn], len(keys)))]
            return _table({
                "bucket": ([key[0].as_py()], pa.int32()), "ids": ([ids.tolist()], pa.list_(pa.int64())), "row_starts": ([starts[0]], pa.binary()), "columns": ([column.astype(np.int32).tobytes()], pa.binary()),
                "weights": ([weight.tobytes()], pa.binary()), "column_starts": ([starts[1]], pa.binary()), "turn": ([turn.astype(np.int32).tobytes()], pa.binary()), "rows": ([row[turn].astype(np.int32).tobytes()], pa.binary()),
                "routes": ([[{"part": int(p), "keys": k} for p, k in zip(numbers, pieces)]], pa.list_(pa.struct([("part", pa.int32()), ("keys", pa.binary())]))),
            })

        schema = "bucket int, ids array<long>, row_starts binary, columns binary, weights binary, column_starts binary, turn binary, rows binary, routes array<struct<part:int,keys:binary>>"
        cut = keyed.select(dealt(self.bucket_numbers, F.xxhash64("id", F.lit(seed))).alias("bucket"), F.col("id").cast("long").alias("id"), "key", F.col("weight").cast("double").alias("weight"))
        packed = materialize(cut.groupBy("bucket").applyInArrow(pack, schema), "matrix")
        # Kept where it is multiplied, so that a product shuffles no postings; what an executor loses is read from the table again.
        self.whole, self.packed = packed, packed.drop("routes").repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "bucket").persist(StorageLevel.DISK_ONLY)
        self.n_documents = int(packed.agg(F.sum(F.size("ids"))).head()[0])

        def place(key: tuple, wanted: pa.Table, have: pa.Table) -> pa.Table:
            keys = np.frombuffer(have.column("keys")[0].as_py(), np.int64)
            places = [np.searchsorted(keys, np.frombuffer(w, np.int64)).astype(np.int32).tobytes() for w in wanted.column("keys").to_pylist()]
            return pa.table({"part": wanted.column("part"), "bucket": wanted.column("bucket"), "places": pa.array(places, pa.binary())})

        routes = packed.select("bucket", F.explode("routes").alias("r")).select("r.part", "bucket", "r.keys")
        self.routes = materialize(routes.groupBy("part").cogroup(self.names.select("part", "keys").groupBy("part")).applyInArrow(place, "part int, bucket int, places binary"), "matrix-routes")
        return True

    def close(self) -> None:
        self.packed.unpersist()
        release(self.names, self.whole, self.routes)

    # Dense sides: one row per part with its rows of a basis and, after a product, of an image.

    def start(self, width: int, seed: int) -> DataFrame:
        """A random basis by the terms' keys, the same however the terms are dealt out."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, n, blob in zip(*(c.to_pylist() for c in batch.columns)):
                    keys = np.frombuffer(blob, np.uint64)
                    with np.errstate(over="ignore"):
                        h = (keys[:, None] ^ np.uint64(seed)) + np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                    basis = (h ^ (h >> np.uint64(31))).astype(np.float64) / 2.0**63 - 1
                    yield pa.record_batch([pa.array([part], pa.int32()), pa.array([n], pa.int32()), pa.array([basis.tobytes()], pa.binary()), pa.array([b""], pa.binary())], names=["part", "n", "basis", "image"])

        return materialize(self.names.select("part", "n", "keys").mapInArrow(run, _STATE), "basis")

    def _sent(self, state: DataFrame) -> DataFrame:
        """(bucket, part, places, piece): for every bucket the rows of the basis it needs."""

        def send(key: tuple, have: pa.Table, routes: pa.Table) -> pa.Table:
            if not len(have):
                return pa.table({"bucket": pa.array([], pa.int32()), "part": pa.array([], pa.int32()), "places": pa.array([], pa.binary()), "piece": pa.array([], pa.binary())})
            x = _matrix(have.column("basis")[0].as_py(), have.column("n")[0].as_py())
            pieces = [np.ascontiguousarray(x[np.frombuffer(p, np.int32)]).tobytes() for p in routes.column("places").to_pylist()]
            return pa.table({"bucket": routes.column("bucket"), "part": routes.column("part"), "places": routes.column("places"), "piece": pa.array(pieces, pa.binary())})

        slim = state.select("part", "n", "basis")
        return slim.groupBy("part").cogroup(self.routes.groupBy("part")).applyInArrow(send, "bucket int, part int, places binary, piece binary")

    @staticmethod
    def _documents_side(pieces: pa.Table, packed: pa.Table, width: int) -> tuple[dict, pa.Table, np.ndarray]:
        row = {name: packed.column(name)[0] for name in packed.column_names}
        pieces = pieces.sort_by("part")
        x = np.frombuffer(b"".join(pieces.column("piece").to_pylist()), np.float64).reshape(-1, width)
        cells = {name: np.frombuffer(row[name].as_py(), kind) for name, kind in (("row_starts", np.int64), ("columns", np.int32), ("weights", np.float64), ("column_starts", np.int64), ("turn", np.int32), ("rows", np.int32))}
        cells["ids"] = row["ids"].values
        return cells, pieces, sparse_sums(cells["row_starts"], cells["columns"], cells["weights"], x)

    def multiply(self, state: DataFrame, width: int, change: tuple[np.ndarray | None, np.ndarray | None, np.ndarray | None] = (None, None, None)) -> DataFrame:
        """A state whose image is A Aᵀ times the last ``width`` columns of its basis, with the sums that :meth:`projected` adds. With ``change`` =
        (p, c, d) the basis is first multiplied by ``p`` (None: kept), and basis · ``c`` + image · ``d`` is put after it."""
        side, (p, c, d) = self._documents_side, change

        def changed(newest: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for number, n, basis, image in zip(*(column.to_pylist() for column in batch.columns)):
                        s = _matrix(basis, n)
                        new = None if c is None else s @ c + _matrix(image, n) @ d
                        if newest and new is not None:
                            s = new
                        else:
                            s = s if p is None else s @ p
                            s = s[:, -width:] if newest else s if new is None else np.hstack([s, new])
                        yield pa.record_batch([pa.array([number], pa.int32()), pa.array([n], pa.int32()), pa.array([np.ascontiguousarray(s).tobytes()], pa.binary())], names=["part", "n", "basis"])

            return state.select("part", "n", "basis", "image").mapInArrow(run, "part int, n int, basis binary")

        def work(key: tuple, pieces: pa.Table, packed: pa.Table) -> pa.Table:
            cells, pieces, y = side(pieces, packed, width)
            z = sparse_sums(cells["column_starts"], cells["rows"], cells["weights"][cells["turn"]], y)
            ends = np.cumsum([len(p) // 4 for p in pieces.column("places").to_pylist()])
            out = [np.ascontiguousarray(part).tobytes() for part in np.split(z, ends[:-1])]
            return pa.table({"part": pieces.column("part"), "places": pieces.column("places"), "piece": pa.array(out, pa.binary())})

        def gather(key: tuple, pieces: pa.Table, have: pa.Table) -> pa.Table:
            n = have.column("n")[0].as_py()
            image = np.zeros((n, width))
            # The pieces in a stated order, so that sums are the same at every run.
            for places, piece in sorted(zip(pieces.column("places").to_pylist(), pieces.column("piece").to_pylist())):
                image[np.frombuffer(places, np.int32)] += np.frombuffer(piece, np.float64).reshape(-1, width)
            basis = _matrix(have.column("basis")[0].as_py(), n)
            sums = np.hstack([basis, image]).T @ np.hstack([basis[:, -width:], image])
            return pa.table({"part": have.column("part"), "n": have.column("n"), "basis": have.column("basis"), "image": pa.array([image.tobytes()], pa.binary()), "sums": pa.array([sums.tobytes()], pa.binary())})

        back = self._sent(changed(True)).groupBy("bucket").cogroup(self.packed.groupBy("bucket")).applyInArrow(work, "part int, places binary, piece binary")
        return materialize(back.groupBy("part").cogroup(changed(False).groupBy("part")).applyInArrow(gather, f"{_STATE}, sums binary"), "image")

    def projected(self, state: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(basisᵀ newest, basisᵀ image, imageᵀ image) of a product, ``newest`` being the last ``width`` columns of the basis."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for blob in batch.column("sums").to_pylist():
                    total = np.frombuffer(blob) if total is None else total + np.frombuffer(blob)
            if total is not None:
                yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        sums = state.select("sums")
        if self.parts > DRIVER_PARTS:
            sums = sums.repartition(DRIVER_SUMS).mapInArrow(add, "sums binary")
        found = sum(np.frombuffer(b) for b in sorted(sums.toArrow().column("sums").to_pylist())).reshape(-1, 2 * width)
        return found[:-width, :width], found[:-width, width:], found[-width:, width:]

    def documents(self, state: DataFrame, width: int) -> DataFrame:
        """(id, y): Aᵀ times the basis."""
        side = self._documents_side

        def work(key: tuple, pieces: pa.Table, packed: pa.Table) -> pa.Table:
            cells, _, y = side(pieces, packed, width)
            return pa.table({"id": cells["ids"], "y": pa.ListArray.from_arrays(np.arange(0, y.size + 1, width, dtype=np.int32), pa.array(y.ravel()))})

        return self._sent(state).groupBy("bucket").cogroup(self.packed.groupBy("bucket")).applyInArrow(work, "id long, y array<double>")

    def terms(self, state: DataFrame, width: int) -> DataFrame:
        """(term, y): the rows of the basis."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n, basis, terms in zip(*(c.to_pylist() for c in batch.columns)):
                    y = _matrix(basis, n)
                    yield pa.record_batch([pa.array(terms, pa.string()), pa.ListArray.from_arrays(np.arange(0, y.size + 1, width, dtype=np.int32), pa.array(y.ravel()))], names=["term", "y"])

        return state.join(self.names.select("part", "terms"), "part").select("n", "basis", "terms").mapInArrow(run, "term string, y array<double>")

    @staticmethod
    def gram(state: DataFrame, fix: np.ndarray | None = None) -> np.ndarray:
        """[basis image]ᵀ [basis image], the image less basis · ``fix``. Tasks sum their rows, and the sums are added by rows of the
        result, in one job."""

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for n, basis, image in zip(*(c.to_pylist() for c in batch.columns)):
                    both = _both(n, basis, image, fix)
                    total = both.T @ both if total is None else total + both.T @ both
            if total is not None:
                rows = pa.ListArray.from_arrays(np.arange(0, total.size + 1, len(total), dtype=np.int32), pa.array(total.ravel()))
                yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32)), rows], names=["i", "g"])

        def add(key: tuple, t: pa.Table) -> pa.Table:
            rows = np.asarray(t.column("g").combine_chunks().flatten()).reshape(len(t), -1).sum(axis=0)
            return _table({"i": ([key[0].as_py()], pa.int32()), "g": ([rows.tolist()], pa.list_(pa.float64()))})

        parts = state.select("n", "basis", "image").mapInArrow(part, "i int, g array<double>")
        if state._jdf.rdd().getNumPartitions() > DRIVER_SUMS:
            parts = parts.groupBy("i").applyInArrow(add, "i int, g array<double>")
        found = parts.toArrow().sort_by("i").combine_chunks()
        width = len(found.column("g")[0])
        rows = np.asarray(found.column("g").combine_chunks().flatten()).reshape(-1, width)
        return rows.reshape(width, -1, width).sum(axis=1)

    @staticmethod
    def turned(state: DataFrame, p: np.ndarray) -> DataFrame:
        """The basis · ``p``, without an image."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, n, basis in zip(*(c.to_pylist() for c in batch.columns)):
                    out = np.ascontiguousarray(_matrix(basis, n) @ p).tobytes()
                    yield pa.record_batch([pa.array([number], pa.int32()), pa.array([n], pa.int32()), pa.array([out], pa.binary()), pa.array([b""], pa.binary())], names=["part", "n", "basis", "image"])

        return materialize(state.select("part", "n", "basis").mapInArrow(run, _STATE), "basis")


def _both(n: int, basis: bytes, image: bytes, fix: np.ndarray | None) -> np.ndarray:
    s = _matrix(basis, n)
    if not image:
        return s
    w = _matrix(image, n)
    return np.hstack([s, w if fix is None else w - s @ fix])


def _whitening(gram: np.ndarray, least: float = 0.0) -> np.ndarray:
    """What makes columns with this Gram matrix orthonormal, the longest direction first; columns of a length up to ``least`` and directions of
    rounding errors are dropped."""
    size = np.sqrt(np.maximum(np.diag(gram), 0))
    keep = np.flatnonzero(size > least)
    if not len(keep):
        return np.zeros((len(gram), 0))
    scaled = gram[np.ix_(keep, keep)] / np.outer(size[keep], size[keep])
    values, vectors = np.linalg.eigh((scaled + scaled.T) / 2)
    good = values > NOISE * values.max(initial=0.0)
    out = np.zeros((len(gram), int(good.sum())))
    out[keep] = (vectors[:, good] / np.sqrt(values[good]))[:, ::-1] / size[keep][:, None]
    return out


def _ritz(mass: np.ndarray, projected: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors), falling, of projected · y = value · mass · y; ``mass`` is near the unit matrix."""
    low = np.linalg.cholesky((mass + mass.T) / 2)
    inner = np.linalg.solve(low, np.linalg.solve(low, (projected + projected.T) / 2).T)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    return values[::-1], np.linalg.solve(low.T, vectors[:, ::-1])


def leading_triplets(matrix: BlockedMatrix, k: int, oversampling: int, tolerance: float, seed: int, most_products: int) -> tuple[np.ndarray, DataFrame, float]:
    """(sigma, state whose basis are the left vectors, the largest residual): the ``k`` leading singular triplets.

    A block of k columns, so that a value may occur k times, is multiplied by A Aᵀ; what that has outside of the basis is made orthonormal and
    put after it as the next block. When the basis has grown by :data:`GROWTH` blocks it is cut back to its k + ``oversampling`` leading
    eigenvectors. This ends when all of |A v - sigma u| are at most ``tolerance`` · sigma (or a rounding error of the largest), which is
    checked by a product of the vectors themselves, or after ``most_products`` products.
    """
    k = width = min(k, matrix.n_documents, matrix.n_terms)
    keep = k + oversampling
    state = matrix.start(width, seed)
    turn = _whitening(matrix.gram(state))
    change, width, products, checks = (turn, None, None), turn.shape[1], 0, False
    mass = projected = np.zeros((0, 0))
    while True:
        state = _after(state, matrix.multiply(state, width, change))
        products += 1
        # Files of past shuffles go when the driver's JVM finds that nothing refers to them.
        gc.collect()
        matrix.spark.sparkContext._jvm.System.gc()
        own, image, square = matrix.projected(state, width)
        mass, projected = _grown(mass, own), _grown(projected, image)
        values, vectors = _ritz(mass, projected)
        # What the image has outside of the basis.
        inside = np.linalg.solve(mass, image)
        outside = square - inside.T @ image
        if np.linalg.eigvalsh((outside + outside.T) / 2)[0] < COARSE * np.diag(square).max():
            outside = matrix.gram(state, inside)[-width:, -width:]
        wanted = min(k, len(values))
        last = vectors[-width:, :wanted]
        length = np.sqrt(np.maximum(np.einsum("ij,ij->j", last, outside @ last), 0))
        short = np.maximum(length - NOISE * values[0], 0)
        residual = float((short / np.maximum(values[:wanted], NOISE * values[0])).max(initial=0.0))
        turn = _whitening(outside, NOISE * values[0])[:, : matrix.n_terms - len(values)]
        if residual <= tolerance and (len(values) >= k or not turn.shape[1]) or products >= most_products or not turn.shape[1]:
            if checks or products >= most_products:
                return np.sqrt(np.maximum(values[:wanted], 0)), _after(state, matrix.turned(state, vectors[:, :wanted])), residual
            # The vectors themselves are multiplied; unless they pass, they are the next start.
            change, width, checks = (vectors[:, :wanted], None, None), wanted, True
            mass = projected = np.zeros((0, 0))
            continue
        checks, cut = False, None
        if len(values) > keep and len(values) + turn.shape[1] > keep + GROWTH * k:
            cut = vectors[:, :keep]
            mass, projected = cut.T @ mass @ cut, cut.T @ projected @ cut
        change, width = (cut, -inside @ turn, turn), turn.shape[1]


def _grown(square: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """A symmetric matrix with more columns, and rows, at its end."""
    n, width = columns.shape
    out = np.empty((n, n))
    out[: n - width, : n - width] = square
    out[:, n - width :] = columns
    out[n - width :, : n - width] = columns[: n - width].T
    return out


def _after(old: DataFrame, new: DataFrame) -> DataFrame:
    release(old)
    return new
