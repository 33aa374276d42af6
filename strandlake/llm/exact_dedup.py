"""Exact deduplication by a log-structured merge index of text digests."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise

#: Positions that one bitmap of Spark's bitmap functions holds.
BITMAP = 32768


def sha256_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


#: Bits of the largest filter that is broadcast (16 MB).
MOST_BITS = 27


def flush_runs(rows: DataFrame) -> DataFrame:
    """Memtables to runs: each task writes its rows as one run sorted by digest."""
    return materialise(rows.sortWithinPartitions("digest"), "digest-runs")


def compact(runs: DataFrame, keep: str = "smallest") -> DataFrame:
    """Merge runs: per digest the row that stays and the number of rows (combined before the shuffle)."""
    row = F.struct("doc_id", "address")
    best = F.max(row) if keep == "largest" else F.min(row)
    return runs.groupBy("digest").agg(best.alias("best"), F.count("*").alias("n"))


def filter_bits(n: int, most: int = MOST_BITS) -> int:
    """Size of a filter over n digests: 16 bits each, up to a fixed size."""
    return min(most, max(min(15, most), ceil(log2(max(1, 16 * n)))))


def _bitmaps(at: DataFrame) -> DataFrame:
    return at.groupBy(F.expr(f"at div {BITMAP}").alias("word")).agg(F.expr(f"bitmap_construct_agg(at % {BITMAP})").alias("map"))


def merge_filter(runs: DataFrame, bits: int) -> DataFrame:
    """Filter of all runs together: the bits on which more than one row's digest falls.  A digest whose
    bit is not set is in one row of one run only; a crowded filter only lets more rows through."""
    at = runs.groupBy(F.expr(f"pmod(xxhash64(digest), {1 << bits}L)").alias("at")).agg(F.count("*").alias("n"))
    return _bitmaps(at.where("n > 1"))


def hit_filter(hits: DataFrame, bits: int) -> DataFrame:
    """Bit set over the hits' digests."""
    return _bitmaps(hits.select(F.expr(f"pmod(xxhash64(digest), {1 << bits}L)").alias("at")))


def probe(rows: DataFrame, bitmap: DataFrame, bits: int) -> DataFrame:
    """rows with may_hit: false only where the digest is not in the filter."""
    rows = rows.withColumn("at", F.expr(f"pmod(xxhash64(digest), {1 << bits}L)"))
    rows = rows.withColumns({"word": F.expr(f"at div {BITMAP}"), "at": F.expr(f"cast(at % {BITMAP} as int)")})
    byte = "cast(conv(hex(substring(map, cast(at div 8 as int) + 1, 1)), 16, 10) as int)"
    found = F.coalesce(F.expr(f"getbit({byte}, at % 8) = 1"), F.lit(False))
    return rows.join(F.broadcast(bitmap), "word", "left").withColumn("may_hit", found).drop("word", "at", "map")


def exact_duplicates(docs: DataFrame, keep: str = "smallest", digest=sha256_digest, most_bits: int = MOST_BITS) -> DataFrame:
    """One row per document: doc_id, digest, keep_id, group_size, kept.

    1. Each task is a memtable: it flushes (digest, doc_id) as a run sorted by digest.
    2. The runs' filter is probed with every row: digests that it shows to be alone are done.  Compaction
       merges the other rows of all runs into an index of the smallest (or largest) id and the count.
    3. Digests with more rows than one are hits.  A filter of them picks the documents to verify, whose
       bytes are then compared by grouping on the text itself.
    4. Digests that stand for several texts are grouped anew by text; all others follow the index.

    Filters have 16 bits a digest and at most 2^most_bits bits; beyond that they fill up, and more rows
    than needed take part in steps 2 and 3, with the same result.

    Null text counts as empty.  A null doc_id is smaller than all others.  Of rows equal in doc_id and
    text exactly one is kept.  Other columns are not read.  An empty table gives an empty table.
    """
    rows = docs.select("doc_id", digest(F.col("text")).alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    addressed = rows.withColumn("address", F.monotonically_increasing_id())
    runs = flush_runs(addressed.drop("text"))
    bits = filter_bits(runs.count(), most_bits)
    probed = materialise(probe(runs, merge_filter(runs, bits), bits), "digest-probed")
    shared = probed.where("may_hit").drop("may_hit")
    hits = materialise(compact(shared, keep).where("n > 1"), "digest-index")

    bits = filter_bits(hits.count(), most_bits)
    suspects = probe(rows, hit_filter(hits, bits), bits).where("may_hit")
    texts = suspects.groupBy("digest", "text").agg(F.count("*").alias("n"))
    mixed = materialise(texts.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1"), "digest-mixed")
    verdict = shared.join(hits, "digest", "left")
    if not mixed.isEmpty():
        again = materialise(addressed.join(mixed, "digest", "left_semi"), "digest-again")
        row = F.struct("doc_id", "address")
        by_text = again.groupBy("digest", "text").agg(
            (F.max(row) if keep == "largest" else F.min(row)).alias("best"), F.count("*").alias("n")
        )
        anew = again.join(by_text, ["digest", "text"]).drop("text")
        verdict = verdict.join(mixed, "digest", "left_anti").unionByName(anew, allowMissingColumns=True)
    verdict = verdict.unionByName(probed.where("NOT may_hit").drop("may_hit"), allowMissingColumns=True)
    alone = F.col("n").isNull()
    return verdict.select(
        "doc_id",
        "digest",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("best.address") == F.col("address"))).alias("kept"),
    )


def op5_lsm_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the row with the largest doc_id stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = exact_duplicates(docs, keep="largest")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))
