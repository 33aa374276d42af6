"""Distributions over sites and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .variants import allele_stats, call_stats, genotype_type, inbreeding

DEPTHS = (1, 5, 10, 20, 35, 50, 70)


def distribution(df: DataFrame, value: Column) -> DataFrame:
    return df.groupBy(value.alias("value")).agg(F.count("*").alias("n"))


def per_cent(x: Column) -> Column:
    """x 100, rounded half away from zero."""
    return F.round(F.round(x, 9) * 100).cast("int")


def het_distribution(calls: DataFrame, min_calls: int) -> DataFrame:
    return distribution(call_stats(calls, min_calls), per_cent(F.col("obs_het")))


def inbreeding_distribution(calls: DataFrame, min_calls: int) -> DataFrame:
    return distribution(inbreeding(calls, min_calls), per_cent(F.col("f")))


def maf_distribution(calls: DataFrame, min_calls: int) -> DataFrame:
    return distribution(allele_stats(calls, min_calls), per_cent(F.col("maf")))


def samples_by_depth(calls: DataFrame) -> DataFrame:
    """(depth, samples, n): sites by how many samples have at least the depth."""
    counts = calls.groupBy("ord").agg(*[F.count_if(F.col("dp") >= d).alias(str(d)) for d in DEPTHS])
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.col(str(d)).alias("samples")) for d in DEPTHS]))
    return counts.select(pairs.alias("x")).groupBy("x.depth", "x.samples").agg(F.count("*").alias("n"))


def sample_table(calls: DataFrame) -> DataFrame:
    """Genotype classes by sample with a TOTAL row: one rollup."""
    t = F.col("t")
    got = calls.withColumn("t", genotype_type()).rollup("sample").agg(
        F.count_if(t == 0).alias("hom_ref"), F.count_if(t == 2).alias("hom_alt"), F.count_if(t == 1).alias("het"), F.count_if(t.isNull()).alias("missing"),
    )
    return got.withColumn("sample", F.coalesce("sample", F.lit("TOTAL")))


def genotypes_by_quality(calls: DataFrame, min_gq: int) -> DataFrame:
    return calls.where(F.col("gq") >= min_gq).groupBy("sample", genotype_type().alias("gt_type")).agg(F.count("*").alias("n"))


def allele_counts_2d(calls: DataFrame) -> DataFrame:
    """Calls and mean quality by reference count, alternative count and genotype class."""
    return calls.where("called").groupBy("rd", "ad", genotype_type().alias("gt_type")).agg(F.count("*").alias("n"), F.avg("gq").alias("mean_gq"))


def missing_by_depth(calls: DataFrame) -> DataFrame:
    """(depth, samples, n): sites by how many samples are called at that depth threshold."""
    counts = calls.groupBy("ord").agg(*[F.count_if(F.col("called") & (F.col("dp") >= d)).alias(str(d)) for d in DEPTHS])
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.col(str(d)).alias("samples")) for d in DEPTHS]))
    return counts.select(pairs.alias("x")).groupBy("x.samples").pivot("x.depth", list(DEPTHS)).agg(F.count(F.lit(1)))


def compare_samples(one: DataFrame, two: DataFrame) -> DataFrame:
    """Every sample of one with every sample of two at common sites: equal, different, uncalled.

    Calls are matched by chromosome and position; of duplicate sites of two the last one counts.
    """
    gt = lambda: F.when(F.col("called"), F.concat_ws("/", F.array_sort(F.array("a1", "a2")).cast("array<string>")))
    last = two.groupBy("chrom", "pos").agg(F.max("ord").alias("ord"))
    right = two.join(last, ["chrom", "pos", "ord"]).select("chrom", "pos", F.col("sample").alias("sample_2"), gt().alias("gt_2"))
    left = one.select("chrom", "pos", "sample", gt().alias("gt"))
    both = left.join(right, ["chrom", "pos"])
    known = F.col("gt").isNotNull() & F.col("gt_2").isNotNull()
    return both.groupBy("sample", "sample_2").agg(
        F.count_if(known & (F.col("gt") == F.col("gt_2"))).alias("equal"), F.count_if(known & (F.col("gt") != F.col("gt_2"))).alias("different"),
        F.count_if(~known).alias("uncalled"),
    )


def chromosome_density(sites: DataFrame, refs: DataFrame) -> DataFrame:
    """Sites per chromosome and per cent of its bases, two decimals."""
    counts = sites.groupBy(F.col("chrom").alias("ref")).agg(F.count("*").alias("n"))
    return refs.join(counts, "ref").select("ref", "length", "n", F.round(F.col("n") * 100 / F.col("length"), 2).alias("density"))


def maf_by_depth(calls: DataFrame) -> DataFrame:
    """(depth, maf, n): depths of sites and the rounded per cent of their deeper allele."""
    from .variants import depth_stats

    got = depth_stats(calls)
    return got.groupBy(F.col("depth"), per_cent(F.col("maf_depth")).alias("maf")).agg(F.count("*").alias("n"))


def call_kind() -> Column:
    return F.when(genotype_type() == 1, "HET").when(genotype_type().isNotNull(), "HOM")


def sample_counters(calls: DataFrame, min_gq: int) -> DataFrame:
    """(sample, kind, depth, n) of HOM and HET calls with at least the quality."""
    calls = calls.where(F.col("gq") >= min_gq).withColumn("kind", call_kind()).where("kind IS NOT NULL")
    return calls.groupBy("sample", "kind", F.col("dp").alias("depth")).agg(F.count("*").alias("n"))


def quality_boxes(calls: DataFrame, max_depth: int = 100, by_kind: bool = False) -> DataFrame:
    """Quartiles of genotype qualities by depth, of all called genotypes below the depth, or of HOM and
    HET calls apart."""
    from .stats import counter, quartiles

    by = ["kind", "dp"] if by_kind else ["dp"]
    calls = calls.where(F.col("called") & (F.col("dp") < max_depth)).withColumn("kind", call_kind())
    return quartiles(counter(calls.where("kind IS NOT NULL") if by_kind else calls, F.col("gq"), *by), *by)
