import random
import re

import numpy as np
import pytest

from strandlake.llm import minhash, near_copies
from strandlake.llm.minhash import CHUNK, CHUNKS, RADIUS, chunk_keys, minhash_components, op13_minhash_multi_index
from strandlake.llm.oracles import ORACLES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[k : k + 2]) for k in range(max(1, len(words) - 1))) if words else frozenset()


def brute(rows):
    """(doc_id, set size, component, kept) of each row (doc_id, text), over all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, a in enumerate(sets):
        for j in range(k):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(k)] = find(j)
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(find(k), []).append(i)
    least = {r: min((i for i in x if i is not None), default=None) for r, x in ids.items()}
    return [(i, len(sets[k]), least[find(k)], i == least[find(k)]) for k, (i, _) in enumerate(rows)]


def loose(seed, n, base=60):
    """Texts of a group that differ in more and more words, so that many pairs lie near the bound."""
    rng = random.Random(seed)
    words = [rng.choice("abcdefghijkl") * rng.randint(1, 9) for _ in range(base)]
    return [" ".join(w if rng.random() > k % 8 / 60 else rng.choice("xyz") * rng.randint(1, 9) for w in words) for k in range(n)]


def table(spark, docs):
    texts = loose(1, 60) + loose(2, 40, 20) + loose(3, 30, 8) + ["one", "One", "one two", "a b c d e", "a b c d e f", "w " * 5000, "w\tw"]
    more = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    return docs.select("doc_id", "text").unionByName(more)


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def test_query_equals_brute_force(spark, docs, tmp_path):
    made = table(spark, docs)
    made.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in op13_minhash_multi_index(spark, str(tmp_path)).collect()]
    want = brute([tuple(r) for r in made.collect()])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert any(c != i and n > 10 for i, n, c, _ in got)
    import duckdb

    known = duckdb.connect()
    known.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = known.sql(f"SELECT doc_id, n_shingles, component_id, kept FROM ({ORACLES['op13_minhash_multi_index']})").fetchall()
    assert sorted(sql, key=key) == sorted(want, key=key)


def test_small_tiles_give_the_same(spark, docs):
    made = table(spark, docs)
    got = minhash_components(made, tile=3).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=key) == sorted((r[:3] for r in brute([tuple(r) for r in made.collect()])), key=key)


def test_tiles_alone_find_links_that_no_leader_has(spark):
    """Chains: neighbours are links, the ends of a chain aren't."""
    words = [f"w{k}" for k in range(80)]
    rows = [(k, " ".join(words[k : k + 40])) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = minhash_components(docs, tile=2).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(r[:3] for r in brute(rows))


def test_pigeonhole_is_sure_up_to_the_radius():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (400, CHUNKS * CHUNK)).astype(np.uint8)
    b = a.copy()
    for k in range(len(b)):
        at = rng.permutation(CHUNKS * CHUNK)[:RADIUS]
        if k % 2:  # errors as evenly dealt as they can be
            at = np.array([c * CHUNK + e for c in range(CHUNKS) for e in rng.permutation(CHUNK)[:2]])[:-1]
        b[k, at] ^= 1
    assert (chunk_keys(a) == chunk_keys(b)).any(axis=1).all()


def test_a_unit_hashes_its_chunks_once(monkeypatch):
    texts = [" ".join(f"w{x}" for x in range(k, k + 60)) for k in range(20)]
    _, row, value, n = next(near_copies.shingle_sets(texts, minhash.SHINGLE))
    signature = minhash.signatures(row, value, n)
    marks = np.concatenate((signature, minhash.parities(row, value, n)), axis=1)
    keys, ids, size, calls = chunk_keys(signature), np.arange(n), np.bincount(row), []
    monkeypatch.setattr(minhash, "chunk_keys", lambda x: calls.append(len(x)) or chunk_keys(x))
    got = set()
    for at in range(keys.shape[1]):  # one unit for each value of a key
        unit = np.sort(keys[:, at].view(np.int64))
        order = np.argsort(keys[:, at].view(np.int64), kind="stable")
        held = [x[order] for x in (ids, ids, size, np.full(n, at), np.array([m.tobytes() for m in marks], object))]
        before = len(calls)
        u, v = minhash._apart_in_units([unit, np.zeros(n, np.int64), *held])
        assert len(calls) - before <= 1
        new = set(zip(u.tolist(), v.tolist()))
        assert not new & got
        got |= new
    links = {(i, j) for i in range(n) for j in range(i) if 100 * len(shingles(texts[i]) & shingles(texts[j])) >= 80 * len(shingles(texts[i]) | shingles(texts[j]))}
    assert links and links <= got and calls


def test_none(spark, empty):
    assert minhash_components(empty).count() == 0
    rows = [(1, None), (2, ""), (3, " \n"), (None, None)]
    got = minhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (None, 0, None)]
