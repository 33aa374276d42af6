import math
import random
from hashlib import sha256

import numpy as np
import pytest

from strandlake.llm.kmeans import _pack, _unpack, cluster_vectors, nearest, op11_centroid_gemm, squared_distances
from strandlake.llm.oracles import ORACLES

SCHEMA = "vec_id long, embedding array<float>, cluster string, label int"


def brute(rows, k=40, rounds=5, dim=64, seed=2):
    """Clusters of (vec_id, embedding) in Python's integers."""
    kept = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[0] or 0, r[1]))
    cents = [e for _, e in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(e, c)), j) for j, c in enumerate(cents)) for _, e in kept]

    for _ in range(rounds):
        own = [j for _, j in assign()]
        for j in range(len(cents)):
            mine = [e for (_, e), o in zip(kept, own) if o == j]
            if mine:
                cents[j] = [sum(col) // len(mine) for col in zip(*mine)]
    found = assign()
    inertia = [sum(d for d, j in found if j == c) for c in range(len(cents))]
    fit = lambda v: v if v < 2**63 else None
    return [(i, j, fit(d), fit(inertia[j]), fit(sum(inertia)), ",".join(map(str, cents[j]))) for (i, _), (d, j) in zip(kept, found)]


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def same(df, rows, **how):
    got = [tuple(r) for r in cluster_vectors(df, **how).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, **how), key=key)


def vectors(n, dim=64, seed=5, wide=1.0):
    random.seed(seed)
    f32 = lambda x: float(np.float32(x))
    return [(k, [f32(random.gauss(k % 7 - 3, 0.5) * wide) for _ in range(dim)]) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, e, "clash", None) for i, e in rows], SCHEMA).repartition(3)


def odd(rows):
    """rows with repeated ones, equal vectors, null ids, and vectors that are to be left out."""
    good = rows[0][1]
    return [*rows, rows[0], rows[0], (900, good), (None, good), (901, None), (902, []), (903, good[:-1]), (904, [*good, 1.0]),
            (905, [None, *good[1:]]), (906, [float("nan"), *good[1:]]), (907, [float("inf"), *good[1:]])]


def test_query_equals_brute_force(spark, tmp_path):
    rows = odd(vectors(150))
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [tuple(r) for r in op11_centroid_gemm(spark, str(tmp_path)).collect()]
    want = [(*r[:5], sha256(r[5].encode()).hexdigest()) for r in brute(rows)]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_sql(spark, tmp_path):
    import duckdb

    rows = odd(vectors(120))
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    known = duckdb.connect()
    known.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    columns = "vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256"
    got = known.sql(f"SELECT {columns} FROM ({ORACLES['op11_centroid_gemm']})").fetchall()
    want = [(*r[:5], sha256(r[5].encode()).hexdigest()) for r in brute(rows)]
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("wide", [1e4, 1e7, 1e15, 1e30])
def test_large_components_stay_exact(spark, wide):
    """Past the product's bound, past int64 and past 2^63 altogether."""
    rows = vectors(30, 3, wide=wide) + vectors(30, 3, seed=6)
    rows = [(k, e) for k, (_, e) in enumerate(rows)]
    same(frame(spark, rows), rows, k=5, rounds=3, dim=3)


def test_few_vectors_ties_and_none(spark):
    rows = [(1, [0.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 0.0])]
    same(frame(spark, rows), rows, k=2, rounds=0, dim=2)
    same(frame(spark, rows), rows, k=40, rounds=2, dim=2)
    assert cluster_vectors(frame(spark, [(1, [1.0])]), dim=2).count() == 0
    assert cluster_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_the_three_ways_agree_at_their_bounds():
    for m in (1, 1 << 20, (1 << 23) - 1, 1 << 24, 1 << 29, 1 << 31, 1 << 40):
        x = np.array([[m, -m], [m - 1, 3], [0, 1]], np.int64)
        c = np.array([[-m, m], [m, m - 1]], np.int64)
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, s)) for s in c] for r in x]
        assert squared_distances(x, c).tolist() == want
        assert nearest(x, c)[1].tolist() == [min(w) for w in want]


def test_pack():
    for m in (5, 1 << 15, 1 << 31, 1 << 62, 1 << 80):
        x = np.array([[m, -3.0]])
        kind, data = _pack(x)
        assert _unpack(kind, data, 2).astype(float).tolist() == x.tolist()
    assert _pack(np.array([[5.0]]))[0] == "<i2" and _pack(np.array([[2.0**80]]))[0] == "<f8"
