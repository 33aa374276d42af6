"""Per-site aggregates of genotype calls, site and genotype filters.

calls: ord, chrom, pos, sample, called, a1, a2 (allele numbers, null where missing), dp, gq, rd, ad.
sites: ord, chrom, pos, ref, alts, qual.  ord joins them; (chrom, pos) may repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_CALLS = 10


def is_het() -> Column:
    return F.col("called") & (F.col("a1") != F.col("a2"))


def called_alleles(most: int | None = None) -> Column:
    """Alleles of a call in order, those above most left out; empty without a call."""
    both = F.filter(F.array("a1", "a2"), lambda a: a.isNotNull() & (F.lit(most is None) | (a <= (most or 0))))
    return F.when(F.col("called"), both).otherwise(F.array().cast("array<int>"))


def genotype_type() -> Column:
    """0 homozygous reference, 1 heterozygous, 2 homozygous alternative; null without two alleles."""
    return F.when(F.col("called"), F.when(F.col("a1") != F.col("a2"), 1).when(F.col("a1") == 0, 0).when(F.col("a2").isNotNull(), 2))


def alleles(calls: DataFrame) -> DataFrame:
    """A row per called allele; missing alleles are passed over."""
    return calls.where("called").select("ord", F.explode(F.array("a1", "a2")).alias("allele")).where("allele IS NOT NULL")


def call_stats(calls: DataFrame, min_calls: int = MIN_CALLS) -> DataFrame:
    """Per site: samples, num_called, call_rate, obs_het (null below min_calls)."""
    n = F.count_if("called")
    return calls.groupBy("ord").agg(
        F.count("*").alias("samples"), n.alias("num_called"), (n / F.count("*")).alias("call_rate"),
        F.when(n >= min_calls, F.count_if(F.coalesce(is_het(), F.lit(False))) / n).alias("obs_het"),
    )


def allele_counts(calls: DataFrame) -> DataFrame:
    return alleles(calls).groupBy("ord", "allele").agg(F.count("*").alias("n"))


def allele_stats(calls: DataFrame, min_calls: int = MIN_CALLS) -> DataFrame:
    """Per site: maf (frequency of the major allele), mac (chromosomes without it), exp_het."""
    counts = allele_counts(calls).groupBy("ord").agg(
        F.sum("n").alias("chroms"), F.max("n").alias("major"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.count("*").alias("n_alleles")
    )
    enough = calls.groupBy("ord").agg((F.count_if("called") >= min_calls).alias("enough"))
    share = F.col("major") / F.col("chroms")
    return counts.join(enough, "ord").select(
        "ord",
        F.when(F.col("enough"), share).alias("maf"),
        (F.col("chroms") - F.col("major")).alias("mac"),
        F.when(F.col("enough"), 1 - F.col("squares") / (F.col("chroms") * F.col("chroms"))).alias("exp_het"),
        "n_alleles",
    )


def genotype_counts(calls: DataFrame) -> DataFrame:
    """Genotypes as sorted allele texts, a missing allele as a dot and last: ord, genotype, n."""
    text = F.array_join(F.array_sort(F.array("a1", "a2")).cast("array<string>"), "/", ".")
    return calls.where("called").groupBy("ord", text.alias("genotype")).agg(F.count("*").alias("n"))


def major_alleles(calls: DataFrame) -> DataFrame:
    """The most frequent allele of each site; of equally frequent ones the smallest number."""
    return allele_counts(calls).groupBy("ord").agg(F.max_by("allele", F.struct("n", -F.col("allele"))).alias("major"))


def biallelic_counts(calls: DataFrame) -> DataFrame:
    """AA, Aa and aa per site (hom_major, het, hom_minor): A is the major allele, all others count as a;
    half calls are left out."""
    both = calls.where("called AND a1 IS NOT NULL AND a2 IS NOT NULL").join(major_alleles(calls), "ord")
    k = (F.col("a1") == F.col("major")).cast("int") + (F.col("a2") == F.col("major")).cast("int")
    return both.groupBy("ord").agg(*[F.count_if(k == n).alias(name) for n, name in ((2, "hom_major"), (1, "het"), (0, "hom_minor"))])


def inbreeding(calls: DataFrame, min_calls: int = MIN_CALLS) -> DataFrame:
    """1 - observed / expected heterozygosity; null where the expected one is 0."""
    both = call_stats(calls, min_calls).join(allele_stats(calls, min_calls), "ord")
    return both.select("ord", (1 - F.col("obs_het") / F.when(F.col("exp_het") != 0, F.col("exp_het"))).alias("f"))


def depths_of(calls: DataFrame) -> Column:
    """Reads of each allele of a call; calls without depths have those of the reference and of one alternative."""
    return F.col("depths") if "depths" in calls.columns else F.array("rd", "ad")


def allele_depths(calls: DataFrame, *by: str) -> DataFrame:
    """ord, allele, reads: the reads of each allele over all samples (or by more columns, such as sample)."""
    each = calls.select("ord", *by, F.posexplode(depths_of(calls)).alias("allele", "reads"))
    return each.groupBy("ord", *by, "allele").agg(F.sum("reads").alias("reads"))


def depth_stats(calls: DataFrame) -> DataFrame:
    """Per site: depth, reference depth, and the share of the deepest allele among the reads of all alleles."""
    got = calls.groupBy("ord").agg(F.sum("dp").alias("depth"), F.sum("rd").alias("rd"))
    deepest = allele_depths(calls).groupBy("ord").agg(F.max("reads").alias("top"), F.sum("reads").alias("all"))
    share = F.col("top") / F.when(F.col("all") > 0, F.col("all"))
    return got.join(deepest, "ord", "left").select("ord", "depth", "rd", share.alias("maf_depth"))


def is_polymorphic(calls: DataFrame, threshold: float = 1.0, min_calls: int = MIN_CALLS) -> DataFrame:
    """Three-valued: null below min_calls."""
    return allele_stats(calls, min_calls).select("ord", (F.col("maf") < threshold).alias("polymorphic"))


def kind_of(ref: Column, alts: Column) -> Column:
    """snp where all alleles have one base, indel where lengths differ, else unknown."""
    one = (F.length(ref) == 1) & F.forall(alts, lambda a: (F.length(a) == 1) & a.isin("A", "C", "G", "T", "N"))
    return F.when(one, "snp").when(F.exists(alts, lambda a: F.length(a) != F.length(ref)), "indel").otherwise("unknown")


def snp_name(ids: Column, prefix: str, chrom: Column, pos: Column) -> Column:
    """The first given id, or prefix, chromosome and 1-based position."""
    return F.coalesce(F.get(F.split(ids, ";"), 0), F.concat(F.lit(prefix), chrom, F.lit("_"), (pos + 1).cast("string")))


def subset_samples(sites: DataFrame, calls: DataFrame, samples: list[str], reverse: bool = False) -> tuple[DataFrame, DataFrame]:
    """Restrict calls to samples (or to all others) and prune the alternatives that none of them has."""
    inside = F.col("sample").isin(samples)
    kept = calls.where(~inside if reverse else inside)
    seen = alleles(kept).groupBy("ord").agg(F.collect_set("allele").alias("__seen"))
    pruned = sites.join(seen, "ord", "left").withColumn("alts", F.filter("alts", lambda a, i: F.coalesce(F.array_contains("__seen", (i + 1).cast("int")), F.lit(False)))).drop("__seen")
    return pruned, kept


def allele_number(alts: Column) -> Column:
    """Alleles that a site counts as having: the reference and at least one alternative."""
    return 1 + F.greatest(F.lit(1), F.size(alts))


def filter_log(df: DataFrame, flags: list[str]) -> DataFrame:
    """Rows that pass after each filter of a chain: step, filter, n."""
    rows, passed = [], F.lit(True)
    for i, f in enumerate(flags):
        passed = passed & F.coalesce(F.col(f), F.lit(False))
        rows.append(F.struct(F.lit(i + 1).alias("step"), F.lit(f).alias("filter"), passed.alias("ok")))
    steps = df.select(F.explode(F.array(*rows)).alias("x"))
    return steps.groupBy("x.step", "x.filter").agg(F.count_if("x.ok").alias("n"))


# Genotype filters ----------------------------------------------------------------------------------


def _uncall(calls: DataFrame, gone: Column) -> DataFrame:
    gone = F.coalesce(gone, F.lit(False))
    return calls.withColumns({"a1": F.when(~gone, F.col("a1")), "a2": F.when(~gone, F.col("a2")), "called": F.col("called") & ~gone})


def low_quality_to_missing(calls: DataFrame, min_gq: float) -> DataFrame:
    """A null quality counts as low."""
    return _uncall(calls, F.coalesce(F.col("gq") < min_gq, F.lit(True)))


def hets_to_missing(calls: DataFrame) -> DataFrame:
    return _uncall(calls, is_het())


def low_evidence_alleles(calls: DataFrame, threshold: float = 0.9999, method: str = "hw", generations: int = 7, min_calls: int = MIN_CALLS) -> DataFrame:
    """Homozygous calls whose reads do not show two equal alleles with enough probability lose the second.

    hw: p / (p + 0.5^(n-1) (1-p)), p the allele's frequency, n the reads of this allele alone; sites below min_calls lose all
    calls.  ril_self: paa / (paa + 0.5^n (1 - 2 paa)), paa = (2^g - 1) / 2^(g+1).  Adds outcome.
    """
    reads = F.get(depths_of(calls), F.col("a1"))
    if method == "hw":
        counts = allele_counts(calls).withColumn("total", F.sum("n").over(Window.partitionBy("ord")))
        enough = calls.groupBy("ord").agg((F.count_if("called") >= min_calls).alias("enough"))
        freqs = counts.select("ord", F.col("allele").alias("a1"), (F.col("n") / F.col("total")).alias("p"))
        calls = calls.join(freqs, ["ord", "a1"], "left").join(enough, "ord")
        p = F.col("p")
        prob = p / (p + F.pow(F.lit(0.5), reads - 1) * (1 - p))
    else:
        paa = (2**generations - 1) / 2 ** (generations + 1)
        calls = calls.withColumns({"p": F.lit(None).cast("double"), "enough": F.lit(True)})
        prob = paa / (paa + F.pow(F.lit(0.5), reads) * (1 - 2 * paa))
    hom = F.col("a1") == F.col("a2")
    outcome = (
        F.when(~F.col("enough"), "not_enough_individuals").when(~F.col("called"), "was_not_called")
        .when(~F.coalesce(hom, F.lit(False)), "was_het").when(prob >= threshold, "enough_evidence").otherwise("not_enough_evidence")
    )
    calls = calls.withColumn("outcome", outcome).drop("p", "enough")
    none, half = F.col("outcome") == "not_enough_individuals", F.col("outcome") == "not_enough_evidence"
    return calls.withColumns({"a1": F.when(~none, F.col("a1")), "a2": F.when(~none & ~half, F.col("a2")), "called": F.col("called") & ~none})
