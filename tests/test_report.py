"""The report on reads from one pass, its texts, and the memory of batches."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from strandlake.functions import vectors as V
from strandlake.operators import stats


def test_report_of_a_few_reads(spark):
    rows = [("ACGTNa", "IIII!!"), ("acg", "555"), ("", ""), (None, None), ("A" * 80, "#" * 80)]
    df = spark.createDataFrame(rows, "seq string, qual string").repartition(3)
    counters = stats.sequence_counters(df)
    got = {(r.section, r.metric, r.pos, r.text): r.value for r in stats.sequence_report(counters).collect()}
    assert got["length", "count", None, None] == 5 and got["length", "sum", None, None] == 89 and got["length", "n50", None, None] == 80
    quals = [40] * 4 + [0] * 2 + [20] * 3 + [2] * 80
    assert abs(got["quality", "q20", None, None] - 700 / 89) < 1e-9 and abs(got["quality", "average", None, None] - np.mean(quals)) < 1e-9
    assert got["quality_box", "median", 0, None] == 20 and got["quality_box", "q1", 0, None] is None
    assert got["base", "n", 0, "A"] == 3 and got["base", "n", 4, "N"] == 1
    kmers = Counter(s[i : i + 3] for s, _ in rows for i in range(len(s or "") - 2))
    assert {k[3]: v for k, v in got.items() if k[0] == "kmer_top"} == dict(kmers)
    assert got["dust", "above", None, None] == 100 / 3
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    plan = stats.sequence_report(counters)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.adaptive.enabled")
    # One pass over the reads: all parts but one take the first one's shuffle.
    assert plan.count("MapInArrow") == 1 and plan.count("ReusedExchange") > 5
    empty = stats.sequence_report(stats.sequence_counters(df.limit(0))).collect()
    assert {r.section for r in empty} <= {"length", "quality", "kmer", "dust"} and all(r.value is None for r in empty)


def test_texts():
    boxes = [("1", 0, 10.0, 20.0, 30.0, 40), ("12", 5, None, 7.0, None, 9), ("13", None, None, None, None, None)]
    assert stats.ascii_boxes(boxes, 41).splitlines() == ["axis from 0 to 40", " 1: " + "-" * 10 + "=" * 10 + "|" + "=" * 10 + "-" * 10, "12: " + " " * 5 + "--|--", "13: "]
    assert stats.ascii_shares({0: {"A": 3, "T": 1}, 10: {"N": 2}, 2: {}}, width=8).splitlines() == [" 0: AAAAAATT", " 2: ", "10: NNNNNNNN"]


def test_a_large_batch_needs_little_memory():
    """64 MB of reads at a time, as Spark may hand them over."""
    rng = np.random.default_rng(1)
    reads = 16_000
    texts = pa.array([row.tobytes().decode() for row in rng.choice(np.frombuffer(b"ACGTacgt5?I", np.uint8), (reads, 2000))] * 2)
    assert sum(b.size for b in texts.buffers() if b) > 60 << 20
    for work in (lambda: V.count_kmers(texts, 4), lambda: V.count_places(texts, 33), lambda: [len(x) for x in V.sliced(texts)]):
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 300 << 20
    sizes = [sum(b.size for b in x.buffers() if b) and len(x) for x in V.sliced(texts)]
    assert sum(sizes) == 2 * reads and max(sizes) <= V.CHUNK // 2000 + 1


def test_slices_join_to_the_whole(spark, monkeypatch):
    texts = ["", None, "ACGT", "acGTTac", "AAaaAA", "é+Aé", "aaa" * 50, "GG", "ACGTACGTACGT"]
    whole = V.count_kmers(pa.array(texts), 2), V.count_places(pa.array(texts), 33)
    monkeypatch.setattr(V, "CHUNK", 10)
    parts = V.count_kmers(pa.array(texts), 2), V.count_places(pa.array(texts), 33)
    assert dict(zip(*whole[0])) == dict(zip(*parts[0])) and all((a == b).all() for a, b in zip(whole[1], parts[1]))
    assert [len(x) for x in V.sliced(pa.array([], pa.string()))] == [0]
