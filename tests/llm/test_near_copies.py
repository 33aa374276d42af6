"""The pipeline's near copies: five-word shingles, Jaccard of 0.8 or more."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandlake.llm import near_copies, shared, simhash

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_near_copies_go_and_others_stay(spark):
    base = [f"w{k}" for k in range(100)]
    near = lambda at: " ".join("changed" if k == at else w for k, w in enumerate(base))  # noqa: E731  91 of 101 shingles
    rows = [(1, " ".join(base)), *[(k, near(11 * k)) for k in range(2, 9)], (20, "a b c d e f g h"), (21, "a b c d e f g x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, SF).collect()) == [1, 20, 21]


def slow_roots(rows):
    """Components over all pairs, from the words themselves."""
    sets = []
    for _, text in rows:
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append(frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset())
    distinct = sorted(set(sets), key=sorted)
    parent = {s: s for s in distinct}

    def find(x):
        while parent[x] is not x:
            x = parent[x]
        return x

    for k, a in enumerate(distinct):
        for b in distinct[:k]:
            if 5 * len(a & b) >= 4 * len(a | b):
                parent[find(a)] = find(b)
    return [find(s) for s in sets]


def loose_group(seed, n):
    """Texts that differ from each other in more and more words, so that many pairs lie near the bound."""
    rng = random.Random(seed)
    base = [rng.choice("abcdefghijkl") * rng.randint(1, 4) for _ in range(120)]
    return [" ".join(w if rng.random() > k % 5 / 60 else rng.choice("xyz") * rng.randint(1, 5) for w in base) for k in range(n)]


@pytest.mark.parametrize("tile", [3, 2048])
def test_components_equal_brute_force(spark, docs, tile):
    more = [(1000 + k, t) for k, t in enumerate(loose_group(1, 40) + loose_group(2, 25) + ["a b c d", "a b c d e", "A B c d", "a b c"])]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = near_copies.near_copies(table, tile=tile).collect()
    rows = [(r.doc_id, r.text, r.h) for r in table.withColumn("h", F.xxhash64("text")).collect()]
    assert len(got) == len(rows)
    root = {(r.doc_id, r.h): r.root for r in got}
    pairs = {(want, root[i, h]) for want, (i, _, h) in zip(slow_roots([r[:2] for r in rows]), rows)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert len({b for _, b in pairs}) < len({t for _, t, _ in rows}) - 10


def test_empty_table_and_null_text(spark, empty):
    assert near_copies.near_copies(empty).count() == 0
    rows = near_copies.near_copies(spark.createDataFrame([(1, None), (2, ""), (None, " \t"), (3, "a")], "doc_id long, text string")).collect()
    assert len({r.root for r in rows if r.doc_id != 3}) == 1 and len({r.root for r in rows}) == 2


def test_salted_join_equals_join(spark):
    pairs = [(k, 7 if k % 3 else k % 5) for k in range(90)] + [(3, None), (4, 99)]
    rows = spark.createDataFrame(pairs, "u long, v long")
    table = spark.createDataFrame([(k, f"t{k}") for k in range(8)], "v long, text string")
    want = sorted((v, u, f"t{v}") for u, v in pairs if v is not None and v < 8)
    for most, share in ((4096, 256), (4, 1), (4096, 1)):
        assert sorted(tuple(r) for r in shared.join_salted(rows, table, "v", "u", most, share).select("v", "u", "text").collect()) == want
    assert shared.join_salted(rows.where("u < 0"), table, "v", "u").count() == 0


def test_parities_never_differ_more_than_sets():
    texts = loose_group(3, 12)
    ((_, row, value, n),) = near_copies.shingle_sets(texts)
    bits = near_copies.parities(row, value, n).view("<u8")
    for a in range(n):
        for b in range(a):
            apart = len(set(value[row == a].tolist()) ^ set(value[row == b].tolist()))
            assert int(np.bitwise_count(bits[a] ^ bits[b]).sum()) <= apart


def test_stage_links_simhash_fingerprints(spark):
    """Repeats tip the same bits, though the sets of shingles are half as similar as the bound."""
    rows = [(1, "of " * 60), (2, "of " * 45 + "end"), (3, "quite another text of some words"), (4, "of " * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len({r.root for r in near_copies.near_copies(docs).collect()}) == 3
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, SF).collect()) == [1, 3]


@pytest.mark.parametrize("tile", [3, 2048])
def test_simhash_links_equal_op6(spark, docs, tile):
    """Components over both kinds of links: each of either kind lies within one, and no other joins."""
    both, bits, sets = near_copies.near_copies(docs, tile, radius=3), simhash.near_duplicates(docs), near_copies.near_copies(docs)
    root = {(r.doc_id, r.h): r.root for r in both.collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for kind, found in (("bits", bits), ("sets", sets)):
        for r in found.collect():
            parent[find((r.doc_id, r.h))] = find((kind, r.root))
    pairs = {(find(k), r) for k, r in root.items()}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_units_give_links_and_no_pairs():
    """However many pairs of a group may be alike, its units give fewer rows than it has sets."""
    texts = loose_group(4, 60)
    ((_, row, value, n),) = near_copies.shingle_sets(texts)
    sig, unit = np.arange(n), np.zeros(n, np.int64)
    size = np.bincount(row, minlength=n)
    bits = near_copies.parities(row, value, n)
    u, v = near_copies._candidates_in_units([unit, unit, sig, sig, size, unit, *bits.T.copy()])
    assert n / 3 < len(u) < n and (u != v).all()
    u, v = near_copies._links_in_units([unit, unit, sig, sig, np.array(texts, object)])
    want = slow_roots(list(enumerate(texts)))
    joined = list(range(n))
    for a, b in zip(u.tolist(), v.tolist()):
        joined = [joined[b] if x == joined[a] else x for x in joined]
    assert len(u) == n - len(set(want)) and len(set(zip(joined, want))) == len(set(joined)) == len(set(want))
