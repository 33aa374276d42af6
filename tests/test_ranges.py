"""Numbers, neighbours, windows and coverage by ranges, against plain Python on one long key."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import alignments, ranges, windows
from strandlake.operators.order import pairwise, unique_adjacent
from strandlake.operators.pairs import group_adjacent


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    return [(k * 7 - 300, rng.choice(["a", "a", "b", None]), rng.choice(["big"] * 9 + ["small", None])) for k in range(900)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "ord long, v string, k string").repartition(6)


def test_index_rows(spark, table, rows):
    got = ranges.index_rows(table).select("ord", "n").collect()
    assert sorted(map(tuple, got)) == [(o, n) for n, (o, _, _) in enumerate(rows)]
    tight = ranges.index_rows(table, parts=3).select("ord", "n").collect()
    assert sorted(map(tuple, tight)) == sorted(map(tuple, got))
    keyed = table.withColumn("ord", F.struct(F.coalesce("v", F.lit("")).alias("s"), "ord"))
    got = ranges.index_rows(keyed, parts=9).select(F.col("ord.s"), F.col("ord.ord"), "n").collect()
    want = sorted((v or "", o) for o, v, _ in rows)
    assert sorted(map(tuple, got)) == [(s, o, n) for n, (s, o) in enumerate(want)]
    assert ranges.index_rows(table.limit(0)).count() == 0


def test_a_range_holds_a_part_of_the_rows(table, rows):
    sizes = [r["count"] for r in table.groupBy(ranges.range_of(table, "ord", 20)).count().collect()]
    assert len(sizes) > 15 and max(sizes) < len(rows) / 5


def test_neighbours_and_runs(table, rows):
    last, follow, unique, run, number, seen = {}, {}, [], {}, {}, set()
    for o, v, k in rows:
        if k in last:
            follow[last[k][0]] = v
        if k not in last or v is None or last[k][1] is None or last[k][1] != v:
            number[k] = number.get(k, 0) + 1
        if k not in last or v != last[k][1] or last[k][1] is None:
            unique.append(o)
        run[o], last[k] = number[k], (o, v)
    got = group_adjacent(table, "v", ["k"]).select("ord", "group_no").collect()
    assert dict(map(tuple, got)) == run
    got = pairwise(table, "v", ["k"]).select("ord", "following").collect()
    assert dict(map(tuple, got)) == {o: follow.get(o) for o, _, _ in rows}
    assert sorted(r.ord for r in unique_adjacent(table, "v", ["k"]).collect()) == unique
    assert seen == set()


@pytest.fixture(scope="module")
def sites(spark):
    rng = random.Random(5)
    made = [(k, "one", rng.randrange(2000)) for k in range(400)] + [(500, "two", 3), (501, "two", 90)]
    return spark.createDataFrame(made, "ord long, chrom string, pos long").repartition(5), made


def test_windows_over_block_ends(sites):
    df, made = sites
    near = {o: sum(c == d and abs(p - q) <= 30 for _, d, q in made) - 1 for o, c, p in made}
    for width in (1, 64, 1 << 16):
        assert dict(map(tuple, windows.count_near(df, 30, width=width).select("ord", "near").collect())) == near
    want = []
    for c in ("one", "two"):
        mine = sorted((p, o) for o, d, p in made if d == c)
        want += [(o, o2) for k, (_, o) in enumerate(mine) for _, o2 in mine[k + 1 : k + 8]]
    for block in (1, 10, 4096):
        assert sorted(map(tuple, windows.index_pairs(df, 7, block=block).select("ord", "ord_2").collect())) == sorted(want)


def test_rank_in(sites):
    df, made = sites
    mine = sorted((p, o) for o, d, p in made if d == "one")
    for width in (7, 1 << 16):
        got = ranges.rank_in(df, "chrom", "n", width=width).where("chrom = 'one'").select("ord", "n").collect()
        assert sorted(map(tuple, got)) == sorted((o, n) for n, (_, o) in enumerate(mine))


def test_coverage_by_runs(spark):
    rng = random.Random(6)
    reads = [(0, "r", rng.randrange(500), rng.randrange(60), rng.choice(["30M", "5S20M3D10M", "4M100N4M", "2I6M"])) for _ in range(60)]
    reads += [(0, "r", 5000, 50, "10M"), (0, "s", 0, 10, "700M"), (4, None, None, 0, None)]
    df = spark.createDataFrame(reads, "flag int, ref string, pos long, mapq int, cigar string").repartition(3)
    depth = {}
    for flag, ref, pos, mapq, cigar in reads:
        at, n = pos, ""
        for c in cigar or "":
            if c.isdigit():
                n += c
                continue
            if c == "M":
                for p in range(at, at + int(n)):
                    for q in (-1, *alignments.MAPQS):
                        depth.setdefault((ref, p), {})[q] = depth.get((ref, p), {}).get(q, 0) + (mapq > q)
            at, n = at + (int(n) if c in "MDN" else 0), ""
    for width in (10, 64, 1 << 16):
        runs = alignments.depth_runs(df, width).collect()
        got = {(r.ref, p): {-1: r.depth, 0: r.over0, 20: r.over20, 30: r.over30, 40: r.over40} for r in runs for p in range(r.start, r.end)}
        assert got == depth
        assert sum(r.end - r.start for r in runs) == len(depth)
