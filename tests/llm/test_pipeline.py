"""The pipeline's stages against their operators' results on a small table."""

import corpus_pipeline
from strandlake.llm import simhash
from strandlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n.split()[0] for n, _ in corpus_pipeline.STAGES] == ["quality", "SimHash", "benchmark", "mixing", "token-ID"]
    seen = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        docs = kept.cache()
        seen.append(docs.count())
    assert sorted(seen, reverse=True) == seen and len(set(seen)) >= 4 and seen[-1] > seen[0] / 3
    assert simhash.near_duplicates(docs).groupBy("component_id").count().where("count > 1").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == seen[-1]
    assert last.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_clashing_columns_come_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    extra = ["score", "h", "items", "n_words", "spans", "topic", "probability", "sampled", "n_tokens", "root"]
    docs = docs.selectExpr("*", *[f"concat('{c}', doc_id) AS {c}" for c in extra]).cache()
    again = docs.unionByName(docs.limit(5))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, again, SF)
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in extra)
    assert len(corpus_pipeline.STAGES[1][1](spark, again, SF).collect()) <= 60


def test_one_document_of_each_group(spark):
    rows = [(1, "a b c d e f", "en", "s"), (2, "a b c d e f", "en", "s"), (None, "a b c d e f", "en", "s"), (3, "q r s t", "en", "s"), (3, "q r s t", "en", "s"), (3, "other words here", "en", "s"), (None, "only null", "en", "s"), (None, "other null text", None, None), (9, None, "en", "s"), (8, "", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = sorted(map(str, [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup_stage(spark, docs, SF).collect()]))
    assert kept == sorted(map(str, [(1, "a b c d e f"), (3, "q r s t"), (3, "other words here"), (None, "only null"), (None, "other null text"), (8, "")]))


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
