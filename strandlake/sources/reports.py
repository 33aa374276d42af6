"""Similarity reports in plain text and XML, and GenBank and EMBL entries: Spark's text and XML readers cut
the files into records (a query, an entry), column functions take the fields out of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: An iteration of the XML report; hits and parts are arrays, also where there is only one.
ITERATION = (
    "`Iteration_query-def` string, `Iteration_query-len` int, Iteration_hits struct<Hit: array<struct<"
    "Hit_id: string, Hit_def: string, Hit_accession: string, Hit_len: int, Hit_hsps: struct<Hsp: array<struct<"
    "`Hsp_bit-score`: double, Hsp_evalue: double, `Hsp_query-from`: int, `Hsp_query-to`: int, `Hsp_hit-from`: int, `Hsp_hit-to`: int,"
    "Hsp_identity: int, Hsp_positive: int, `Hsp_align-len`: int>>>>>>"
)
HIT_COLUMNS = [
    "query", "q_len", "subject", "s_len", "part_no", "q_start", "q_end", "q_strand", "s_start", "s_end", "s_strand", "expect", "identity", "similarity", "score",
]


def _records(spark: SparkSession, path: str, separator: str) -> DataFrame:
    rows = spark.read.option("lineSep", separator).text(path)
    return rows.select(F.regexp_replace("value", "\r", "").alias("value"), F.monotonically_increasing_id().alias("ord"))


def _after(text: Column, pattern: str) -> Column:
    """What follows each match of the pattern, up to the next one."""
    parts = F.split(text, pattern)
    return F.slice(parts, 2, F.size(parts))


def _found(text: Column | str, pattern: str, kind: str = "string") -> Column:
    """The first group as a value, null where the pattern is absent."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast(kind)


def _strands(df: DataFrame) -> DataFrame:
    """0-based, inclusive coordinates from 1-based ones, the smaller first, with the strands 1 and -1."""
    new = {}
    for side in "qs":
        a, b = F.col(f"{side}_from"), F.col(f"{side}_to")
        new |= {f"{side}_start": F.least(a, b) - 1, f"{side}_end": F.greatest(a, b) - 1, f"{side}_strand": F.when(a > b, -1).otherwise(1)}
    return df.withColumns(new).select(*HIT_COLUMNS)


def read_blast_text(spark: SparkSession, path: str) -> DataFrame:
    """Match parts of a plain-text report, a row each; part_no counts the parts of a match from 1.

    Files are cut at "Query=", so large reports are read by many tasks.  Coordinates are 0-based and
    inclusive.  Identity and similarity are the printed percentages, similarity the identity where no
    positives are printed.  Queries without hits give no row.
    """
    found = _records(spark, path, "Query=").select(
        _found("value", r"^\s*(\S+)").alias("query"), _found("value", r"\nLength=\s*(\d+)", "int").alias("q_len"),
        F.explode(_after(F.col("value"), r"\n(?:>|Subject=)\s*")).alias("match"),
    )
    found = found.select(
        "query", "q_len", _found("match", r"^(\S+)").alias("subject"), _found("match", r"\n\s*Length=\s*(\d+)", "int").alias("s_len"),
        F.posexplode(_after(F.col("match"), r"\n\s*Score =")).alias("at", "part"),
    )
    numbers = lambda row, k: F.regexp_extract_all("part", F.lit(rf"\n{row}:?\s+(\d+)\s+\D+?\s+(\d+)"), k).cast("array<int>")
    expect = _found("part", r"Expect(?:\(\d+\))?\s*=\s*([-+.\deE]+)")
    identity = _found("part", r"Identities = \d+/\d+ \((\d+)%\)", "double")
    return _strands(
        found.select(
            "query", "q_len", "subject", "s_len", (F.col("at") + 1).alias("part_no"),
            F.get(numbers("Query", 1), F.lit(0)).alias("q_from"), F.element_at(numbers("Query", 2), -1).alias("q_to"),
            F.get(numbers("Sbjct", 1), F.lit(0)).alias("s_from"), F.element_at(numbers("Sbjct", 2), -1).alias("s_to"),
            F.when(expect.startswith("e"), F.concat(F.lit("1"), expect)).otherwise(expect).cast("double").alias("expect"),
            identity.alias("identity"), F.coalesce(_found("part", r"Positives = \d+/\d+ \((\d+)%\)", "double"), identity).alias("similarity"),
            _found("part", r"^\s*([-+.\deE]+) bits", "double").alias("score"),
        )
    )


def read_blast_xml(spark: SparkSession, path: str, subject_from_def: bool = True) -> DataFrame:
    """Match parts of an XML report, columns as in read_blast_text.

    The query's name is the first word of its definition.  The subject's name is that of its definition
    too, as reports of the current programs have it, or the accession (subject_from_def=False).
    Identity and similarity are percentages of the alignment's length.
    """
    rows = spark.read.schema(ITERATION).option("rowTag", "Iteration").format("xml").load(path)
    word = lambda c: F.split(F.trim(c), r"\s+")[0]
    rows = rows.select(word(F.col("`Iteration_query-def`")).alias("query"), F.col("`Iteration_query-len`").alias("q_len"), F.explode("Iteration_hits.Hit").alias("hit"))
    subject = word(F.col("hit.Hit_def")) if subject_from_def else F.col("hit.Hit_accession")
    rows = rows.select("query", "q_len", subject.alias("subject"), F.col("hit.Hit_len").alias("s_len"), F.posexplode("hit.Hit_hsps.Hsp").alias("at", "p"))
    share = lambda c: F.col(c) * 100.0 / F.col("p.`Hsp_align-len`")
    return _strands(
        rows.select(
            "query", "q_len", "subject", "s_len", (F.col("at") + 1).alias("part_no"),
            F.col("p.`Hsp_query-from`").alias("q_from"), F.col("p.`Hsp_query-to`").alias("q_to"),
            F.col("p.`Hsp_hit-from`").alias("s_from"), F.col("p.`Hsp_hit-to`").alias("s_to"), F.col("p.Hsp_evalue").alias("expect"),
            share("p.Hsp_identity").alias("identity"), share("p.Hsp_positive").alias("similarity"), F.col("p.`Hsp_bit-score`").alias("score"),
        )
    )


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Sequences of GenBank (LOCUS) and EMBL (ID) entries: ord, name, descr, seq (upper case), qual (null), fmt.

    The name is the accession with its version (GenBank without VERSION: the locus); the description is
    joined to one line, without a final full stop.  What is neither kind of entry is left out.
    """
    rows = _records(spark, path, "\n//")
    value, genbank = F.ltrim(F.regexp_replace("value", r"^[^\n]*\n\s*(?=LOCUS|ID )", "")), F.col("fmt") == "genbank"
    rows = rows.withColumn("value", value).withColumn("fmt", F.when(F.col("value").startswith("LOCUS"), "genbank").when(F.col("value").startswith("ID "), "embl"))
    locus = F.coalesce(_found("value", r"\nVERSION\s+(\S+)"), _found("value", r"^LOCUS\s+(\S+)"))
    version = F.concat_ws(".", _found("value", r"^ID\s+([^;\s]+)"), _found("value", r"^ID\s+[^;\s]+;\s*SV (\d+)"))
    descr = F.when(genbank, F.regexp_replace(F.regexp_extract("value", r"(?s)\nDEFINITION\s+(.*?)\n(?=\S)", 1), r"\n\s+", " "))
    descr = descr.otherwise(F.array_join(F.regexp_extract_all("value", F.lit(r"\nDE\s+([^\n]*)"), 1), " "))
    bases = F.get(F.split("value", r"\n(?:ORIGIN|SQ )[^\n]*\n", 2), F.lit(1))
    return rows.where("fmt is not null").select(
        "ord", F.when(genbank, locus).otherwise(version).alias("name"), F.regexp_replace(F.trim(descr), r"\.$", "").alias("descr"),
        F.upper(F.regexp_replace(F.coalesce(bases, F.lit("")), "[^A-Za-z]", "")).alias("seq"), F.lit(None).cast("string").alias("qual"), "fmt",
    )
