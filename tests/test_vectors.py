"""Batches of reads in numpy against loops over their letters."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlake.functions import vectors as V

TEXTS = ["", None, "ACGT", "acGTTac", "AAaaAA", "é+Aé", "aaa", "GG", "ACGTACGTACGT"]


def test_code_points_of_a_slice():
    codes, ends = V.code_points(pa.array(["xx", *TEXTS]).slice(1))
    assert ends.tolist() == [0, 0, 0, 4, 11, 17, 21, 24, 26, 38]
    assert "".join(map(chr, codes)) == "".join(t or "" for t in TEXTS)


@pytest.mark.parametrize("k", [1, 3, 9])
@pytest.mark.parametrize("texts", [TEXTS, [t for t in TEXTS if t != "é+Aé"], [], [None]])
def test_kmers_and_places(k, texts):
    words, times = V.count_kmers(pa.array(texts, pa.string()), k)
    assert dict(zip(words, times.tolist())) == Counter((t or "")[i : i + k] for t in texts for i in range(len(t or "") - k + 1))
    got = zip(*(x.tolist() for x in V.count_places(pa.array(texts, pa.string()), 33)))
    assert {(p, v): n for p, v, n in got} == Counter((p, ord(c) - 33) for t in texts for p, c in enumerate(t or ""))


def slow_stretch(q, window, threshold, left, right):
    sums = [sum(q[i : i + window]) for i in range(len(q) - window + 1)]
    if not sums or max(sums) < threshold * window:
        return None
    best = sums.index(max(sums))
    low = [i for i, s in enumerate(sums) if s < threshold * window]
    start = max([i + 1 for i in low if i < best], default=0) if left else 0
    return start, min([i + window - 2 for i in low if i > best], default=len(q) - 1) if right else len(q) - 1


def test_columns_over_reads(spark):
    rng = random.Random(5)
    quals = ["".join(chr(33 + rng.randint(0, 9)) for _ in range(rng.randint(0, 25))) for _ in range(60)] + [None, "", "!"]
    rows = [(k, q, "".join(rng.choice("aACn") for _ in q or "")) for k, q in enumerate(quals)]
    df = spark.createDataFrame(rows, "ord int, qual string, seq string").repartition(3)
    for left, right in ((True, True), (True, False), (False, True)):
        got = df.select("ord", V.best_stretch(F.col("qual"), 4, 4.5, left, right, 33).alias("x")).collect()
        for r in got:
            assert (tuple(r.x) if r.x else None) == slow_stretch([ord(c) - 33 for c in quals[r.ord] or ""], 4, 4.5, left, right)
    for r in df.select("qual", "seq", V.mean_code(F.col("qual"), 33).alias("m"), V.longest_upper(F.col("seq")).alias("u")).collect():
        assert r.m == (sum(ord(c) - 33 for c in r.qual) / len(r.qual) if r.qual else None)
        runs = [(j - i, -i) for i in range(len(r.seq)) for j in range(i + 1, len(r.seq) + 1) if r.seq[i:j].isupper() and r.seq[i:j].isalpha() and "a" not in r.seq[i:j] and "n" not in r.seq[i:j]]
        n, i = max(runs, default=(0, 0))
        assert (tuple(r.u) if r.u else None) == ((-i, -i + n - 1) if n else None)
