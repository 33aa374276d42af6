"""Centroid clustering in exact integers: distances by blocked matrix products, sums by a tree of aggregates."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import discard, materialise, scratch_dir

#: Below this all whole numbers, and so all partial sums, are exact in float64.
EXACT = 1 << 53
LONG = 1 << 63
#: Rows of a stored block, and of the distance matrix that is held at a time.
BLOCK = 4096
#: Stored types, narrowest first.  Whole numbers beyond int64 are stored as the doubles that they are.
_KINDS = ("<i2", "<i4", "<i8", "<f8")


def _magnitude(x: np.ndarray) -> int:
    """Largest magnitude in x, as a whole number."""
    if not x.size:
        return 0
    if x.dtype == object:
        return max(abs(int(v)) for v in x.flat)
    return max(abs(int(x.max())), abs(int(x.min())))


def _whole(x: np.ndarray) -> np.ndarray:
    """x, whole numbers of any type, as int64 where they fit, else as Python's integers."""
    if x.dtype.kind == "i":
        return x.astype(np.int64)
    if x.dtype != object and _magnitude(x) < LONG:
        return x.astype(np.int64)
    return np.array([int(v) for v in x.flat], object).reshape(x.shape)


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to centroids, both of whole numbers.

    |x|^2 - 2 x.c + |c|^2 in float64 by a matrix product where no term or partial sum can reach 2^53,
    which the largest magnitudes bound; differences in int64 where those can't reach 2^63; Python's
    integers (an object array) beyond.
    """
    m, n = _magnitude(x), _magnitude(centroids)
    most = x.shape[1] * (m + n) ** 2
    if most < EXACT:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2.0 * (a @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    kind = np.int64 if most < LONG else object
    a, c = _whole(x).astype(kind), _whole(centroids).astype(kind)
    out = np.empty((len(a), len(c)), kind)
    for k in range(len(c)):
        apart = a - c[k]
        out[:, k] = (apart * apart).sum(axis=1)
    return out


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller of equally near ones) and squared distance of each row.

    Rows whose size keeps the product exact are told from the others first, so a few huge rows don't slow
    a block.
    """
    bound = int((EXACT // x.shape[1]) ** 0.5) - _magnitude(centroids) - 1
    size = np.abs(x).max(axis=1) if len(x) else np.zeros(0)
    usual = np.asarray(size <= bound, bool)
    number, distance = np.zeros(len(x), np.int32), np.zeros(len(x), object if not usual.all() else np.int64)
    for rows in (np.flatnonzero(usual), np.flatnonzero(~usual)):
        if len(rows):
            found = squared_distances(x[rows], centroids)
            number[rows] = found.argmin(axis=1)
            distance[rows] = found[np.arange(len(rows)), number[rows]]
    return number, distance


def _pack(x: np.ndarray) -> tuple[str, bytes]:
    """x, doubles that are whole numbers, in the narrowest type that holds them all."""
    m = _magnitude(x)
    kind = next(k for k, most in zip(_KINDS, (1 << 15, 1 << 31, LONG, None)) if most is None or m < most)
    return kind, x.astype(kind).tobytes()


def _unpack(kind: str, data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(-1, dim)


def kept_vectors(table: DataFrame, dim: int, scale: int) -> DataFrame:
    """vec_id and e (doubles, the whole numbers floor(scale * component)) of the vectors with exactly dim
    components, none of them null or, before or after scaling, not finite."""
    scaled = F.transform("embedding", lambda x: F.lit(float(scale)) * x.cast("double"))
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = table.where(F.size("embedding") == dim).select("vec_id", scaled.alias("e")).where(F.coalesce(fine, F.lit(False)))
    # Column functions have floor to long only, which huge numbers overflow; what is beyond 2^52 is whole already.
    whole = F.transform("e", lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x))
    return kept.select("vec_id", whole.alias("e"))


def _blocks(vectors: DataFrame, dim: int, folder: str) -> DataFrame:
    """Vectors as rows of up to BLOCK of them: vec_ids, kind and the bytes of the components."""

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                part = batch.slice(low, BLOCK)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                kind, data = _pack(x)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([ids, pa.array([kind]), pa.array([data], pa.binary())], ["vec_ids", "kind", "data"])

    schema = T.StructType([T.StructField("vec_ids", T.ArrayType(vectors.schema["vec_id"].dataType)), T.StructField("kind", T.StringType()), T.StructField("data", T.BinaryType())])
    return materialise(vectors.mapInArrow(run, schema), "vector-blocks", folder)


def _add(a: list | None, b: list | None) -> list | None:
    """Two lists of numbers, or of lists of numbers, added; None is nothing."""
    if a is None or b is None:
        return b if a is None else a
    return [_add(x, y) if isinstance(x, list) else x + y for x, y in zip(a, b)]


def _totals(blocks: DataFrame, centroids: np.ndarray, with_sums: bool) -> tuple[list, list, list] | None:
    """Per centroid the number of its vectors, their summed squared distance and, if wanted, their sums, all in
    Python's integers; centroids x dim numbers a task, added in a tree of tasks."""
    dim = centroids.shape[1]
    shared = blocks.sparkSession.sparkContext.broadcast(centroids)

    def within(total, row):
        x, c = _unpack(row["kind"], row["data"], dim), shared.value
        number, distance = nearest(x, c)
        n = np.bincount(number, minlength=len(c))
        cuts = np.concatenate(([0], np.cumsum(n)))
        order = np.argsort(number, kind="stable")
        # A block's sums can't leave int64 if BLOCK numbers of the largest magnitude don't.
        ints, far = _whole(x[order]), distance[order]
        if ints.dtype != object and _magnitude(ints) * BLOCK >= LONG:
            ints = ints.astype(object)
        if far.dtype != object and _magnitude(far) * BLOCK >= LONG:
            far = far.astype(object)
        spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
        found = [n.tolist(), [int(far[a:b].sum()) if b > a else 0 for a, b in spans]]
        if with_sums:
            found.append([[int(v) for v in ints[a:b].sum(axis=0)] if b > a else [0] * dim for a, b in spans])
        return _add(total, found)

    rdd = blocks.select("kind", "data").rdd
    return rdd.treeAggregate(None, within, _add, depth=2)


def cluster_vectors(table: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid (its
    cluster's components as decimal numbers joined by commas).

    Kept are vectors of exactly dim components without nulls or values that aren't finite, as whole numbers
    floor(scale * component).  Centroids start as the k kept vectors with the smallest sha256 of
    `seed:vec_id` (equal ids by their components, null ids last; all of them if there are fewer), and each
    round moves every centroid that has vectors to their exact floored mean.  All is exact: see
    squared_distances.  Distances and inertias beyond a long are null; empty tables stay empty; rows that
    repeat count as often as they are there; other columns are not read.

    Vectors are written once as packed blocks; a round reads these, broadcasts k x dim numbers and brings as
    many sums back, added up in a tree of tasks, so nothing but the centroids passes through the driver.
    """
    spark, folder = table.sparkSession, scratch_dir(table.sparkSession, "kmeans")
    vectors = kept_vectors(table, dim, scale)
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(name.asc_nulls_last(), F.col("vec_id").asc_nulls_last(), "e").limit(k).select("e").collect()
    blocks = _blocks(vectors, dim, folder)
    centroids = _whole(np.array([r["e"] for r in first], np.float64).reshape(-1, dim))
    for _ in range(rounds if len(centroids) else 0):
        counts, _, sums = _totals(blocks, centroids, True)
        moved = [[v // n for v in s] if n else [int(v) for v in old] for n, s, old in zip(counts, sums, centroids)]
        centroids = np.array(moved, object)
        centroids = centroids.astype(np.int64) if _magnitude(centroids) < LONG else centroids
    _, inertias, *_ = _totals(blocks, centroids, False) if len(centroids) else ([], [], [])
    texts = [",".join(str(int(v)) for v in c) for c in centroids]
    shared = spark.sparkContext.broadcast((centroids, [x if x < LONG else None for x in inertias], sum(inertias), texts))

    def run(batches):
        known, own, total, names = shared.value
        for batch in batches:
            for ids, kind, data in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                number, distance = nearest(_unpack(kind, data, dim), known)
                far = [d if d < LONG else None for d in distance.tolist()]
                at = number.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.values,
                        pa.array(number),
                        pa.array(far, pa.int64()),
                        pa.array([own[c] for c in at], pa.int64()),
                        pa.array([total if total < LONG else None] * len(at), pa.int64()),
                        pa.array([names[c] for c in at], pa.string()),
                    ],
                    [f.name for f in schema],
                )

    schema = T.StructType([vectors.schema["vec_id"]])
    for column, kind in (("cluster", T.IntegerType()), ("distance", T.LongType()), ("cluster_inertia", T.LongType()), ("inertia", T.LongType()), ("centroid", T.StringType())):
        schema = schema.add(column, kind)
    found = materialise(blocks.mapInArrow(run, schema), "clustered")
    discard(spark, folder)
    return found


def op11_centroid_gemm(spark, sf_dir: str) -> DataFrame:
    """All vectors of embeddings in 40 clusters after five rounds."""
    found = cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256"))
