"""Centroid clustering of integer vectors that keeps every vector's dot products with all centroids."""

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgelog.session import folder_system, scratch_path

#: components of larger size have no squared distance that is sure to fit in a long
LARGEST = 1 << 27
_LONG = (1 << 63) - 1
_LOW = (1 << 32) - 1
#: positions of the sums that are not those of components: rows, and the lower and upper halves of the distances
_ROWS, _LOWER, _UPPER = -1, -2, -3
_STATE = "vec_id long, x binary, norm long, dots array<long>, cluster int, distance long"


def integer_vectors(vectors: DataFrame, vec_id: str, embedding: str, dim: int, scale: int) -> DataFrame:
    """``(vec_id, x)``: the vectors with ``dim`` finite components as integers ``floor(scale * x)``."""
    given = F.col(embedding).cast("array<double>")
    whole = F.transform(given, lambda c: F.floor(F.lit(float(scale)) * c).cast("long"))
    finite = F.forall(given, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(given.isNotNull() & (F.size(given) == dim) & finite).select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("x"))
    return rows.where(F.forall("x", lambda c: c.between(-LARGEST, LARGEST))).withColumn("x", F.col("x").cast("array<int>"))


def _matrix(column: pa.Array, wide: int) -> np.ndarray:
    """The rows of a column of lists, or of binaries of 32-bit integers (little endian), as a matrix."""
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), "<i4").astype(np.int64).reshape(-1, wide)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, wide)


def _packed(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix of 32-bit integers as binaries of one length, which Spark copies as they are."""
    data = matrix.astype("<i4").tobytes()
    ends = pa.py_buffer(np.arange(0, len(data) + 1, 4 * matrix.shape[1], dtype=np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, ends, pa.py_buffer(data)])


def _rows(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as lists."""
    ends = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(matrix.ravel(), kind))


def assigned(state: DataFrame, before: np.ndarray, after: np.ndarray) -> DataFrame:
    """The state after the centroids moved from ``before`` to ``after``: dot products updated, the nearest centroid found anew.

    Only the components in which a centroid changed are multiplied. Distances are taken from ``|x|² - 2 x·c + |c|²``, all in
    exact integers; of equally near centroids the one with the smaller number is taken.
    """
    wide, change = before.shape[1], after - before
    moves = [(c, np.flatnonzero(change[c])) for c in range(len(after)) if change[c].any()]
    norms = (after * after).sum(axis=1)
    fresh = "dots" not in state.columns

    def step(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), wide)
            if fresh:
                dots, norm = np.zeros((len(x), len(after)), np.int64), (x * x).sum(axis=1)
            else:
                dots, norm = _matrix(batch.column("dots"), len(after)), batch.column("norm").to_numpy()
            for c, at in moves:
                dots[:, c] += x[:, at] @ change[c, at]
            score = norms - 2 * dots
            near = score.argmin(axis=1)
            distance = norm + score[np.arange(len(x)), near]
            columns = [batch.column("vec_id"), _packed(x), pa.array(norm), _rows(dots, pa.int64()), pa.array(near.astype(np.int32)), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "x", "norm", "dots", "cluster", "distance"])

    return state.mapInArrow(step, _STATE)


def totals(state: DataFrame, clusters: int, dim: int) -> tuple[list[int], list[int], list[list[int]]]:
    """Rows, summed distance and componentwise sum of every cluster, as exact integers.

    Every Arrow batch is summed where it is read, so that only ``clusters * (dim + 3)`` numbers a batch are shuffled
    and as many reach the driver.
    """

    def summed(batches):
        at = np.concatenate([[_ROWS, _LOWER, _UPPER], np.arange(dim)]).astype(np.int32)
        for batch in batches:
            near, distance, x = batch.column("cluster").to_numpy(), batch.column("distance").to_numpy(), _matrix(batch.column("x"), dim)
            for c in np.unique(near):
                own = near == c
                halves = [own.sum(), (distance[own] & _LOW).sum(), (distance[own] >> 32).sum()]
                sums = np.concatenate([np.array(halves, np.int64), x[own].sum(axis=0)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c, np.int32)), pa.array(at), pa.array(sums)], ["cluster", "at", "total"])

    parts = state.select("cluster", "distance", "x").mapInArrow(summed, "cluster int, at int, total long")
    rows, inertia, sums = [0] * clusters, [0] * clusters, [[0] * dim for _ in range(clusters)]
    for c, at, total in parts.groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(38,0)"))).collect():
        total = int(total)
        if at >= 0:
            sums[c][at] = total
        elif at == _ROWS:
            rows[c] = total
        else:
            inertia[c] += total if at == _LOWER else total << 32
    return rows, inertia, sums


def _stored(frame: DataFrame, older: str | None) -> tuple[DataFrame, str]:
    """``frame`` written to the shared folder and read again; the version before it is removed then."""
    spark = frame.sparkSession
    path = scratch_path(spark, "centroid-state")
    frame.write.parquet(path)
    if older:
        system, root = folder_system(spark, older)
        system.delete(root, True)
    return spark.read.schema(frame.schema).parquet(path), path


@dataclass(frozen=True)
class Clustering:
    """The assigned vectors and, by number, the final centroids with the rows and summed distance of their clusters."""

    state: DataFrame
    centroids: list[list[int]]
    rows: list[int]
    inertia: list[int]


def cluster_vectors(vectors: DataFrame, clusters: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, salt: str = "3:", vec_id: str = "vec_id", embedding: str = "embedding") -> Clustering:
    """Lloyd's rounds over exact integer vectors.

    The centroids start as the ``clusters`` kept vectors with the smallest SHA-256 of ``salt`` and vec_id; vectors with equal
    ids follow in the order of their components, those without an id come last. Every round writes the state of all vectors to
    the shared folder (components as 32-bit integers in one binary, dot products with every centroid, nearest centroid), so a lost executor costs its own tasks
    only; two versions exist at a time. Centroids move to the exact floor of the mean. When no centroid moves, the rounds left
    would change nothing and are not run.
    """
    rows = integer_vectors(vectors, vec_id, embedding, dim, scale)
    mark = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    first = rows.select(mark.alias("mark"), "x").orderBy(F.col("mark").asc_nulls_last(), "x").limit(clusters).collect()
    after = np.array([r["x"] for r in first], np.int64).reshape(len(first), dim)
    if not len(after):
        return Clustering(vectors.sparkSession.createDataFrame([], _STATE), [], [], [])
    state, path, before = rows, None, np.zeros_like(after)
    for left in range(rounds, -1, -1):
        state, path = _stored(assigned(state, before, after), path)
        counts, inertia, sums = totals(state, len(after), dim)
        before = after
        if left:
            after = np.array([[s // n for s in total] if n else list(c) for c, n, total in zip(before.tolist(), counts, sums)], np.int64)
        if (after == before).all():
            break
    return Clustering(state, before.tolist(), counts, inertia)


def clustered(vectors: DataFrame, **options) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` for every kept vector, see ``cluster_vectors``.

    Not kept are vectors that are null, have another number of components, or have a null, NaN or infinite one; nor those with a
    component beyond 2^27 after scaling, whose squared distance may not fit in a long. Repeated rows and repeated or null ids
    stay, each row as a vector of its own. With fewer kept vectors than clusters every one of them starts a cluster; an empty
    table gives no rows. Sums of distances that don't fit in a long are null. Other columns are not read.
    """
    found = cluster_vectors(vectors, **options)
    fits = lambda n: n if n <= _LONG else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    facts = [(c, fits(found.inertia[c]), digest[c]) for c in range(len(digest))]
    # as many rows as there are clusters
    table = F.broadcast(vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, centroid_sha256 string"))
    whole = F.lit(fits(sum(found.inertia))).cast("long").alias("inertia")
    return found.state.select("vec_id", "cluster", "distance").join(table, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", whole, "centroid_sha256")
