from hashlib import sha256
from zlib import crc32

import pytest

from strandlake.llm.merkle import FIELDS, folded, leaf_digest, merkle_proofs, op12_merkle_manifest, proof_digest
from strandlake.llm.oracles import ORACLES
from pyspark.sql import functions as F


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    out = []
    for name in FIELDS:
        v = row[name]
        v = v + more if name == "n_chars" and v is not None else v
        out.append("-" if v is None else f"{len(str(v).encode())}:{v}")
    return H("".join(out))


def brute(rows):
    """(doc_id, leaf, subroot, root, siblings) of each row, and its folded root after tampering."""
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append(r)
    paths, roots = {}, []

    def climb(nodes, owners):
        while len(nodes) > 1:
            up = []
            for k in range(0, len(nodes), 2):
                pair = nodes[k : k + 2]
                for i, own in enumerate(owners[k : k + 2]):
                    for o in own:
                        paths[o].append(("-", "") if len(pair) == 1 else ("RL"[i], pair[1 - i]))
                up.append(H(*pair))
            owners = [sum(owners[k : k + 2], []) for k in range(0, len(owners), 2)]
            nodes = up
        return nodes[0]

    subroot, langs = {}, sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        mine = sorted(trees[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        for r in mine:
            paths[id(r)] = []
        roots.append(climb([leaf(r) for r in mine], [[id(r)] for r in mine]))
        subroot |= {id(r): roots[-1] for r in mine}
    root = climb(roots, [[id(r) for r in trees[lang]] for lang in langs]) if roots else None
    out = []
    for r in rows:
        hit = r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 7 == 0
        node = leaf(r, 1) if hit else leaf(r)
        for side, other in paths[id(r)]:
            node = H(other, node) if side == "L" else H(node, other)
        out.append((r["doc_id"], leaf(r), subroot[id(r)], root, H(*[d for _, d in paths[id(r)]]), node, node == root))
    return out


def key(row):
    return tuple("" if x is None else str(x) for x in row)


@pytest.fixture(scope="module")
def table(spark, docs, tmp_path_factory):
    folder = tmp_path_factory.mktemp("merkle")
    made = docs.withColumn("n_chars", F.when(F.col("doc_id") % 5 > 0, F.length("text").cast("long")))
    made.write.parquet(f"{folder}/documents.parquet")
    return str(folder), [r.asDict() for r in made.collect()]


def test_query_equals_brute_force(spark, table):
    folder, rows = table
    got = [tuple(r) for r in op12_merkle_manifest(spark, folder).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("bits, top", [(1, 1), (2, 3), (3, 40), (12, 1)])
def test_small_blocks_and_tops_give_the_same(spark, table, bits, top):
    """Several levels of blocks, and more groups than the top tree takes."""
    folder, rows = table
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(*FIELDS)
    leaves = docs.select("doc_id", "lang", leaf_digest(*map(F.col, FIELDS)).alias("leaf"), F.lit(1).alias("proof"))
    found = merkle_proofs(leaves, "lang", "doc_id", bits, top)
    assert found.columns == ["doc_id", "lang", "leaf", "pos", "subroot", "root", "proof"]
    got = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")), folded(F.col("leaf"), F.col("proof")).alias("f"))
    got = [tuple(r) for r in got.collect()]
    assert sorted((r[:5] for r in got), key=key) == sorted((r[:5] for r in brute(rows)), key=key)
    assert all(r[5] == r[3] for r in got)


def test_many_groups_go_on_as_one(spark):
    rows = [dict(doc_id=k, source=None, lang=None if k == 7 else f"l{k % 23:02}é", n_chars=k, text="t" * (k % 3)) for k in range(60)]
    df = spark.createDataFrame([tuple(r[f] for f in FIELDS) for r in rows], "doc_id long, source string, lang string, n_chars long, text string")
    found = merkle_proofs(df.select("doc_id", "lang", leaf_digest(*map(F.col, FIELDS)).alias("leaf")), "lang", "doc_id", 1, 4)
    got = [tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof"))).collect()]
    assert sorted(got) == sorted(r[:5] for r in brute(rows))


def test_one_leaf_and_none(spark):
    df = spark.createDataFrame([(1, "a", "00")], "doc_id long, lang string, leaf string")
    assert [(r.subroot, r.root, r.proof) for r in merkle_proofs(df, "lang", "doc_id").collect()] == [("00", "00", [])]
    assert merkle_proofs(df.limit(0), "lang", "doc_id").count() == 0


def test_sql(spark, table):
    import duckdb

    folder, rows = table
    known = duckdb.connect()
    known.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    found = known.sql(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({ORACLES['op12_merkle_manifest']})").fetchall()
    assert sorted(found, key=key) == sorted(brute(rows), key=key)
