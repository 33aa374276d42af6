"""Domain views over the given tables, so that every operator has reads, calls, alignments or hits to run on.

Each view is one SQL text for both engines but for a few spelled-out differences of dialect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The base and the quality character that a letter of a text stands for.
BASES = "ACGTACGTACGTACGTACGTACGTAN"
QUALITIES = "!%)-159=AEIJH#+?:GFDCB<>@;"

TABLES = {
    "reads": ["documents"],
    "calls": ["lineitem"],
    "sites": ["lineitem"],
    "alignments": ["events"],
    "hits": ["lineitem"],
    "refs": ["region"],
}


def view_sql(name: str, duck: bool) -> str:
    """SQL of a view; duck: for DuckDB, else for Spark."""
    letters = "regexp_replace(coalesce(text, ''), '[^A-Za-z]', ''" + (", 'g')" if duck else ")")
    epoch = "CAST(floor(epoch(ts)) AS BIGINT)" if duck else "unix_timestamp(ts)"
    cents = "CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT)"
    array = "[{}]" if duck else "array({})"
    if name == "reads":
        return f"""
SELECT ord, name, descr, pair, direction, seq, qual, CAST(length(seq) AS BIGINT) AS len FROM (
  SELECT doc_id AS ord, concat('read', CAST(doc_id AS VARCHAR(20))) AS name, lang AS descr,
         CAST(floor(doc_id / 2.0) AS BIGINT) AS pair, CASE WHEN doc_id % 2 = 0 THEN 'fwd' ELSE 'rev' END AS direction,
         translate(l, '{ALPHABET.lower()}{ALPHABET}', '{BASES}{BASES.lower()}') AS seq,
         translate(upper(l), '{ALPHABET}', '{QUALITIES}') AS qual
  FROM (SELECT doc_id, lang, {letters} AS l FROM documents) AS t) AS r"""
    if name == "calls":
        return f"""
SELECT ord, chrom, pos, sample, called, CASE WHEN called THEN x END AS a1,
       CASE WHEN called AND y % 13 <> 0 THEN CASE WHEN y % 11 = 0 THEN 2 ELSE y % 2 END END AS a2,
       dp, gq, dp - e AS rd, e AS ad, {array.format("dp - e, e - CAST(floor(e / 3.0) AS INT), CAST(floor(e / 3.0) AS INT)")} AS depths
FROM (SELECT *, CAST(floor(dp * (x + y % 2) / 3.0) AS INT) AS e FROM (SELECT l_orderkey AS ord, concat('chr', CAST(l_orderkey % 5 + 1 AS VARCHAR(9))) AS chrom, l_orderkey * 37 AS pos,
             concat('S', CAST(l_linenumber AS VARCHAR(9))) AS sample,
             CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) % 9 AS INT) <> 0 AS called,
             CAST(sum(CAST(l_quantity AS BIGINT)) % 2 AS INT) AS x, CAST({cents} % 143 AS INT) AS y,
             CAST(sum(CAST(l_quantity AS BIGINT)) AS INT) AS dp,
             CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) * 13 % 60 AS INT) AS gq
      FROM lineitem GROUP BY l_orderkey, l_linenumber) AS t) AS u"""
    if name == "sites":
        return f"""
SELECT ord, concat('chr', CAST(ord % 5 + 1 AS VARCHAR(9))) AS chrom, ord * 37 AS pos,
       CASE WHEN ord % 10 = 0 THEN 'AT' ELSE substr('ACGT', CAST(ord % 4 AS INT) + 1, 1) END AS ref,
       CASE WHEN ord % 7 = 0 THEN {array.format("substr('CGTA', CAST(ord % 4 AS INT) + 1, 1), substr('GTAC', CAST(ord % 4 AS INT) + 1, 1)")}
            ELSE {array.format("substr('CGTA', CAST(ord % 4 AS INT) + 1, 1)")} END AS alts,
       CASE WHEN ord % 23 = 0 THEN NULL ELSE CAST(ord * 7 % 100 AS DOUBLE) END AS qual
FROM (SELECT DISTINCT l_orderkey AS ord FROM lineitem) AS t"""
    if name == "alignments":
        return f"""
SELECT ord, qname, flag, CASE WHEN flag % 8 >= 4 THEN NULL ELSE ref END AS ref, CASE WHEN flag % 8 >= 4 THEN NULL ELSE pos END AS pos,
       mapq, cigar, rg FROM (
  SELECT event_id AS ord, concat('q', CAST(CAST(floor(event_id / 2.0) AS BIGINT) AS VARCHAR(20))) AS qname,
         concat('ref', CAST(user_id % 5 AS VARCHAR(9))) AS ref, {epoch} % 50000 AS pos,
         CAST(CAST(floor(value) AS BIGINT) % 60 AS INT) AS mapq,
         CAST(1 + CASE WHEN event_id % 2 = 0 THEN 64 ELSE 128 END + CASE WHEN user_id % 3 = 0 THEN 16 ELSE 0 END
              + CASE WHEN user_id % 4 = 0 THEN 32 ELSE 0 END + CASE WHEN event_id % 11 = 0 THEN 4 ELSE 0 END AS INT) AS flag,
         CASE WHEN event_id % 5 = 0 THEN '10S40M' WHEN event_id % 5 = 1 THEN '20M2D30M' WHEN event_id % 5 = 2 THEN '25M1I24M' ELSE '50M' END AS cigar,
         event_type AS rg
  FROM events) AS t"""
    if name == "hits":
        return """
SELECT query, subject, part_no, q_start, q_end, s_start, s_end, q_len, s_len, expect, identity, score FROM (
  SELECT concat('p', CAST(l_partkey AS VARCHAR(20))) AS query, concat('s', CAST(l_suppkey AS VARCHAR(20))) AS subject,
         CAST(row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS INT) AS part_no,
         CAST(l_orderkey % 100 AS INT) AS q_start, CAST(l_orderkey % 100 + CAST(l_quantity AS BIGINT) AS INT) AS q_end,
         CAST(l_orderkey % 90 + CASE WHEN l_linenumber = 2 THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS INT) AS s_start,
         CAST(l_orderkey % 90 + CASE WHEN l_linenumber = 2 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS INT) AS s_end,
         160 AS q_len, 150 AS s_len, l_discount * l_tax AS expect, CAST(80 + l_linenumber * 2 AS DOUBLE) AS identity, l_quantity AS score
  FROM lineitem) AS t"""
    return """
SELECT concat('ref', CAST(r_regionkey AS VARCHAR(9))) AS ref, CAST(60000 + 1000 * r_regionkey AS BIGINT) AS length FROM region
UNION ALL SELECT concat('chr', CAST(r_regionkey + 1 AS VARCHAR(9))) AS ref, CAST(600000 * (r_regionkey + 1) AS BIGINT) AS length FROM region"""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain view as a DataFrame over the tables in sf_dir."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES[name]}
    sql = view_sql(name, duck=False)
    for t in tables:
        sql = sql.replace(f"FROM {t}", "FROM {" + t + "}")
    return spark.sql(sql, **tables)


def with_views(body: str, *names: str) -> str:
    """DuckDB SQL: the body with the named views before it.  The body may begin with more of WITH."""
    views = ",\n".join(f"{n} AS ({view_sql(n, duck=True)})" for n in names)
    body = body.strip()
    return f"WITH {views}" + (",\n" + body[5:] if body.upper().startswith("WITH ") else "\n" + body)
