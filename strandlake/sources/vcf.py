"""VCF text to sites and calls, and back."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIXED = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), "value")


def header(lines: DataFrame) -> list[str]:
    """The header's lines; a few hundred at most, so they go to the driver."""
    return [r["value"] for r in lines.where(F.col("value").startswith("#")).orderBy("ord").collect()]


def caller_of(head: list[str]) -> str:
    text = "\n".join(head).lower()
    for mark, name in (("varscan", "varscan"), ("freebayes", "freebayes"), ("unifiedgenotyper", "gatk")):
        if mark in text:
            return name
    return "generic"


def samples_of(head: list[str]) -> list[str]:
    return head[-1].split("\t")[len(FIXED) :] if head else []


def definitions_of(head: list[str], kind: str) -> dict[str, dict[str, str]]:
    """The header's definitions of a kind (INFO, FILTER, FORMAT), by id: their other fields by name."""
    out = {}
    for line in head:
        if line.startswith(f"##{kind}=<"):
            fields = {k: a or b for k, a, b in re.findall(r'(\w+)=(?:"((?:[^"\\]|\\.)*)"|([^,>]*))', line.split("<", 1)[1])}
            out[fields.pop("ID", "")] = fields
    return out


def _dot(c: Column) -> Column:
    return F.when(c != ".", c)


def sites_of(lines: DataFrame) -> DataFrame:
    """ord, chrom, pos (0-based), ids, ref, alts, qual, filters (null: not filtered, empty: passed), info
    (of a key that comes again the first value)."""
    f = F.split("value", "\t")
    pairs = F.transform(F.split(f[7], ";"), lambda x: F.struct(F.split(x, "=", 2)[0].alias("k"), F.coalesce(F.get(F.split(x, "=", 2), 1), F.lit("true")).alias("v")))
    return lines.where(~F.col("value").startswith("#") & (F.col("value") != "")).select(
        "ord", f[0].alias("chrom"), (f[1].cast("long") - 1).alias("pos"), F.split(_dot(f[2]), ";").alias("ids"), f[3].alias("ref"),
        F.coalesce(F.split(_dot(f[4]), ","), F.array().cast("array<string>")).alias("alts"), _dot(f[5]).cast("double").alias("qual"),
        F.when(f[6] == "PASS", F.array().cast("array<string>")).otherwise(F.split(_dot(f[6]), ";")).alias("filters"),
        F.map_from_entries(F.filter(pairs, lambda p, i: (f[7] != ".") & (F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == i + 1))).alias("info"),
        F.get(f, 8).alias("format"),
    )


def calls_of(lines: DataFrame, head: list[str]) -> DataFrame:
    """ord, chrom, pos, sample, called, a1, a2, dp, gq, rd, ad, depths, as the caller writes them: reads of
    the reference, of all other alleles, and of each allele by its number."""
    caller = caller_of(head)
    names = F.array(*[F.lit(s) for s in samples_of(head)])
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#") & (F.col("value") != "")).select(
        "ord", f[0].alias("chrom"), (f[1].cast("long") - 1).alias("pos"), F.split(f[8], ":").alias("keys"),
        F.posexplode(F.slice(f, len(FIXED) + 1, F.greatest(F.size(f) - len(FIXED), F.lit(0)))).alias("i", "text"),
    )
    values = F.split("text", ":")
    n = F.least(F.size("keys"), F.size(values))
    rows = rows.withColumn("m", F.map_from_arrays(F.slice("keys", F.lit(1), n), F.slice(values, F.lit(1), n)))
    get = lambda k: _dot(F.try_element_at("m", F.lit(k)))
    gt = F.split(F.regexp_replace(F.coalesce(F.try_element_at("m", F.lit("GT")), F.lit("./.")), r"\|", "/"), "/")
    allele = lambda i: _dot(F.get(gt, i)).cast("int")
    numbers = lambda k: F.transform(F.split(get(k), ","), lambda x: x.try_cast("int"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    if caller == "gatk":
        depths = numbers("AD")
    elif caller == "varscan":
        depths = F.array(get("RD").try_cast("int"), get("AD").try_cast("int"))
    elif caller == "freebayes":
        depths = F.concat(F.array(get("RO").try_cast("int")), numbers("AO"))
    else:
        depths = F.lit(None).cast("array<int>")
    rd, ad = F.get(depths, 0), total(F.slice(depths, F.lit(2), F.greatest(F.size(depths), F.lit(1))))
    return rows.select(
        "ord", "chrom", "pos", F.get(names, F.col("i")).alias("sample"), (allele(0).isNotNull() | allele(1).isNotNull()).alias("called"),
        allele(0).alias("a1"), allele(1).alias("a2"),
        (rd + ad if caller == "freebayes" else get("DP").try_cast("int")).alias("dp"), get("GQ").try_cast("double").alias("gq"), rd.alias("rd"), ad.alias("ad"), depths.alias("depths"),
    )


def format_sites(sites: DataFrame, calls: DataFrame | None = None, samples: list[str] | None = None) -> DataFrame:
    """VCF body lines (ord, value) with genotypes only."""
    text = lambda c, empty: F.coalesce(c.cast("string"), F.lit(empty))
    filters = F.when(F.col("filters").isNull(), ".").when(F.size("filters") == 0, "PASS").otherwise(F.array_join("filters", ";"))
    fixed = ["chrom", (F.col("pos") + 1).cast("string"), text(F.array_join("ids", ";"), "."), "ref", F.when(F.size("alts") > 0, F.array_join("alts", ",")).otherwise("."), text(F.col("qual"), "."), filters, F.lit("."), F.lit("GT")]
    rows = sites.select("ord", F.concat_ws("\t", *fixed).alias("value"))
    if calls is None:
        return rows
    gt = F.concat(text(F.col("a1"), "."), F.lit("/"), text(F.col("a2"), "."))
    wide = calls.groupBy("ord").agg(F.map_from_entries(F.collect_list(F.struct("sample", gt.alias("gt")))).alias("m"))
    columns = [F.coalesce(F.try_element_at("m", F.lit(s)), F.lit("./.")) for s in samples]
    return rows.join(wide, "ord", "left").select("ord", F.concat_ws("\t", "value", *columns).alias("value"))


def write_vcf(head: list[str], body: DataFrame, path: str) -> None:
    """Header and body as text, the header first."""
    spark = body.sparkSession
    top = spark.createDataFrame([(-len(head) + i, h) for i, h in enumerate(head)], "ord long, value string")
    top.unionByName(body.select("ord", "value")).orderBy("ord").select("value").write.text(path)
