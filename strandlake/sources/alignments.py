"""SAM text, tabular similarity hits and cigar-like alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABULAR = ["query", "subject", "identity", "alignment_length", "mismatches", "gap_open", "query_start", "query_end", "subject_start", "subject_end", "expect", "score"]


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """ord, qname, flag, ref, pos (0-based), mapq, cigar, seq, qual, rg."""
    lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())
    return parse_sam(lines).select("ord", "qname", "flag", "ref", "pos", "mapq", "cigar", "seq", "qual", "rg")


def parse_sam(lines: DataFrame) -> DataFrame:
    """The columns of SAM lines (value), besides those that the lines have; header lines are left out."""
    f = F.split("value", "\t")
    star = lambda c: F.when(c != "*", c)
    return lines.where(~F.col("value").startswith("@")).select(
        *[c for c in lines.columns if c != "value"], f[0].alias("qname"), f[1].cast("int").alias("flag"), star(f[2]).alias("ref"), F.when(f[3] != "0", f[3].cast("long") - 1).alias("pos"),
        f[4].cast("int").alias("mapq"), star(f[5]).alias("cigar"), f[9].alias("seq"), star(f[10]).alias("qual"),
        F.nullif(F.regexp_extract("value", r"\tRG:Z:([^\t]+)", 1), F.lit("")).alias("rg"),
    )


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """id and sample of each read group in the header."""
    rows = spark.read.text(path).where(F.col("value").startswith("@RG"))
    return rows.select(F.regexp_extract("value", r"\tID:([^\t]+)", 1).alias("id"), F.regexp_extract("value", r"\tSM:([^\t]+)", 1).alias("sample"))


def _hits(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.col(c) - 1 for c in ("q_start", "q_end", "s_start", "s_end")})


def read_tabular(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Tabular hits with 0-based, inclusive coordinates; part_no counts the parts of a match in file order."""
    from pyspark.sql import Window

    names = columns or TABULAR
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    checked = F.when(F.size(f) == len(names), f).otherwise(F.raise_error(F.concat(F.lit("wrong number of columns: "), "value")))
    rows = rows.withColumn("f", checked)
    at = {c: F.col("f")[i] for i, c in enumerate(names)}
    number = lambda c: at[c].cast("int")
    got = rows.select(
        "ord", at["query"].alias("query"), at["subject"].alias("subject"), number("query_start").alias("q_start"), number("query_end").alias("q_end"),
        number("subject_start").alias("s_start"), number("subject_end").alias("s_end"), at["expect"].cast("double").alias("expect"),
        at["identity"].cast("double").alias("identity"), at["score"].cast("double").alias("score"),
    )
    return _hits(got).withColumn("part_no", F.row_number().over(Window.partitionBy("query", "subject").orderBy("ord")))


def read_cigar_like(spark: SparkSession, path: str) -> DataFrame:
    """Lines cigar_like: query, length, start, end, strand, subject, the same four, score and more; ends become inclusive."""
    rows = spark.read.text(path).where(F.col("value").startswith("cigar_like:"))
    f = F.split(F.trim(F.substr("value", F.lit(12))), r"\s+")
    return rows.select(
        f[0].alias("query"), f[1].cast("int").alias("q_len"), f[2].cast("int").alias("q_start"), (f[3].cast("int") - 1).alias("q_end"), f[4].alias("q_strand"),
        f[5].alias("subject"), f[6].cast("int").alias("s_len"), f[7].cast("int").alias("s_start"), (f[8].cast("int") - 1).alias("s_end"), f[9].alias("s_strand"),
        f[10].cast("double").alias("score"),
    )
