"""Variant annotators: each adds or removes its id in filters, which is null where nothing was filtered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .variants import allele_depths, alleles, depth_stats, is_het, kind_of
from .windows import count_near, range_join

#: Recognition sites (IUPAC) of the common restriction enzymes.
ENZYMES = {
    "EcoRI": "GAATTC", "SmaI": "CCCGGG", "BamHI": "GGATCC", "AluI": "AGCT", "BglII": "AGATCT", "SalI": "GTCGAC", "BglI": "GCCNNNNNGGC",
    "ClaI": "ATCGAT", "TaqI": "TCGA", "PstI": "CTGCAG", "PvuII": "CAGCTG", "HindIII": "AAGCTT", "EcoRV": "GATATC",
    "HaeIII": "GGCC", "KpnI": "GGTACC", "ScaI": "AGTACT", "HinfI": "GANTC", "DraI": "TTTAAA", "ApaI": "GGGCCC", "BstEII": "GGTNACC",
    "ZraI": "GACGTC", "BanI": "GGYRCC", "Asp718I": "GGTACC",
}
IUPAC = {"N": "[ACGT]", "Y": "[CT]", "R": "[AG]"}


def site_pattern(site: str) -> str:
    return "".join(IUPAC.get(c, c) for c in site)


def set_filter(df: DataFrame, name: str, flagged: Column) -> DataFrame:
    """Idempotent: the id is in filters exactly where the site is flagged."""
    had = F.coalesce("filters", F.array().cast("array<string>")) if "filters" in df.columns else F.array().cast("array<string>")
    bare = F.array_remove(had, name)
    return df.withColumn("filters", F.when(F.coalesce(flagged, F.lit(False)), F.array_append(bare, F.lit(name))).otherwise(bare))


def close_to_snv(sites: DataFrame, distance: int = 60) -> DataFrame:
    return set_filter(count_near(sites, distance), f"cs{distance}", F.col("near") > 0).drop("near")


def close_to_snp(sites: DataFrame, distance: int, kind: str) -> DataFrame:
    """Only neighbours of a kind count."""
    others = sites.where(kind_of(F.col("ref"), F.col("alts")) == kind).select("ord", "chrom", "pos")
    near = range_join(sites.select("ord", "chrom", "pos"), others, "chrom", distance).where("ord <> ord_2").select("ord").distinct()
    return set_filter(sites.join(near.withColumn("__near", F.lit(True)), "ord", "left"), f"cs{distance}", F.col("__near")).drop("__near")


def close_to_varied(sites: DataFrame, calls: DataFrame, distance: int, max_maf_depth: float, kind: str | None = None) -> DataFrame:
    """Only neighbours (of a kind) whose deepest allele has at most that share of the reads count."""
    others = sites if kind is None else sites.where(kind_of(F.col("ref"), F.col("alts")) == kind)
    low = depth_stats(calls).where((F.col("maf_depth") > 0) & (F.col("maf_depth") <= max_maf_depth)).select("ord")
    others = others.join(low, "ord", "left_semi").select("ord", "chrom", "pos")
    near = range_join(sites.select("ord", "chrom", "pos"), others, "chrom", distance).where("pos <> pos_2").select("ord").distinct()
    name = f"cs{kind[0] if kind else ''}{distance}_{max_maf_depth:.2f}"
    return set_filter(sites.join(near.withColumn("__near", F.lit(True)), "ord", "left"), name, F.col("__near")).drop("__near")


def high_variable_region(sites: DataFrame, max_variability: float, window: int) -> DataFrame:
    """More sites than that share of the bases of the window around the site."""
    near = count_near(sites, window // 2)
    return set_filter(near, f"hv{max_variability}", (F.col("near") + 1) / F.lit(float(window)) > max_variability).drop("near")


def high_variable_sequence(sites: DataFrame, refs: DataFrame, max_variability: float) -> DataFrame:
    """More sites on the whole reference than that share of its bases; sites on unknown references aren't flagged."""
    counts = sites.groupBy("chrom").agg(F.count("*").alias("__n")).join(refs.select(F.col("ref").alias("chrom"), F.col("length").alias("__length")), "chrom")
    rows = sites.join(counts, "chrom", "left")
    return set_filter(rows, f"hv{max_variability}", F.col("__n") / F.col("__length") > max_variability).drop("__n", "__length")


def close_to_limit(sites: DataFrame, refs: DataFrame, distance: int) -> DataFrame:
    placed = sites.join(refs.select(F.col("ref").alias("chrom"), F.col("length").alias("__length")), "chrom", "left")
    flagged = (F.col("pos") < distance) | (F.col("__length") - F.col("pos") < distance)
    return set_filter(placed, f"cl{distance}", flagged).drop("__length")


def maf_depth_limit(sites: DataFrame, calls: DataFrame, max_maf: float) -> DataFrame:
    got = sites.join(depth_stats(calls).select("ord", "maf_depth"), "ord", "left")
    return set_filter(got, f"maf{max_maf}", F.col("maf_depth") > max_maf).drop("maf_depth")


def kind_annotator(sites: DataFrame, kind: str = "snp") -> DataFrame:
    return set_filter(sites, f"vk{kind}", kind_of(F.col("ref"), F.col("alts")) != kind)


def is_variable(sites: DataFrame, calls: DataFrame, samples: list[str], name: str = "vs") -> DataFrame:
    """Flags sites at which the samples have one allele; adds variable (null without a call)."""
    seen = alleles(calls.where(F.col("sample").isin(samples))).groupBy("ord").agg(F.countDistinct("allele").alias("__n"))
    got = sites.join(seen, "ord", "left").withColumn("variable", F.when(F.col("__n").isNotNull(), F.col("__n") > 1))
    return set_filter(got, name, ~F.coalesce("variable", F.lit(False))).drop("__n")


def is_variable_by_depth(
    sites: DataFrame, calls: DataFrame, samples: list[str], min_reads: int = 6, min_allele_reads: int = 3, max_maf: float = 1.0, name: str = "vd",
    in_union: bool = True, in_all: bool = True, reference_free: bool = True,
) -> DataFrame:
    """Adds variable, from the reads of the samples together or (in_union false) of each sample by itself,
    of which all (or any) must vary.

    Variable are at least two alleles with enough reads each, and none with more than max_maf of all;
    unless reference_free a single allele that is not the reference will do.  It is null where a group
    has too few reads, or no allele with enough of them.
    """
    by = [] if in_union else ["sample"]
    enough = F.col("reads") >= min_allele_reads
    groups = allele_depths(calls.where(F.col("sample").isin(samples)), *by).groupBy("ord", *by)
    groups = groups.agg(F.sum("reads").alias("n"), F.max("reads").alias("top"), F.count_if(enough).alias("many"), F.bool_or(enough & (F.col("allele") == 0)).alias("ref"))
    alone = (F.col("many") == 1) & (F.lit(reference_free) | F.col("ref"))
    varies = F.when((F.col("n") >= min_reads) & (F.col("many") > 0), ~alone & (F.col("top") / F.when(F.col("n") > 0, F.col("n")) <= max_maf))
    seen = groups.groupBy("ord").agg(F.count(varies).alias("__known"), (F.bool_and if in_all else F.bool_or)(varies).alias("__varies"))
    wanted = 1 if in_union else len(set(samples))
    got = sites.join(seen, "ord", "left").withColumn("variable", F.when(F.col("__known") == wanted, F.col("__varies")))
    return set_filter(got, name, ~F.coalesce("variable", F.lit(False))).drop("__known", "__varies")


def het_in_samples(sites: DataFrame, calls: DataFrame, min_percent: int, name: str = "his") -> DataFrame:
    """At least that whole per cent of the called samples is heterozygous."""
    share = calls.where("called").groupBy("ord").agg(F.floor(F.count_if(F.coalesce(is_het(), F.lit(False))) * 100 / F.count("*")).alias("__p"))
    return set_filter(sites.join(share, "ord", "left"), name, F.col("__p") >= min_percent).drop("__p")


def cutting_enzymes(context: Column) -> Column:
    """Names of the enzymes whose site occurs in the context (all sites are palindromes)."""
    return F.array_compact(F.array(*[F.when(context.rlike(site_pattern(site)), F.lit(name)) for name, site in ENZYMES.items()]))


def cap_enzymes(reference: Column, alternative: Column) -> Column:
    """Enzymes that cut one allele's context and not the other's."""
    one, two = cutting_enzymes(F.upper(reference)), cutting_enzymes(F.upper(alternative))
    return F.array_sort(F.array_union(F.array_except(one, two), F.array_except(two, one)))
