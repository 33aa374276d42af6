"""Registered queries on alignments and hits, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.reads import flag_names
from ..operators import alignments as B
from ..operators import hits as H
from ..operators import pairs, stats
from ..operators.ranges import rank_in
from .views import view, with_views

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None, *names: str):
    """Register a function of the named views; sql uses the same ones."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[view(spark, sf_dir, n) for n in names])
        if sql:
            ORACLES[f.__name__] = with_views(sql, *names)
        return f

    return register


@query("SELECT ord, qname FROM alignments WHERE mapq >= 20 AND (flag & 64) = 64 AND (flag & 4) = 0 AND ((ref = 'ref1' AND pos BETWEEN 1000 AND 19999) OR (ref = 'ref3' AND pos BETWEEN 0 AND 29999))", "alignments")
def bam_filter(a):
    return B.filter_alignments(a, 20, 64, 4, [("ref1", 1000, 20000), ("ref3", 0, 30000)]).select("ord", "qname")


@query("SELECT ord, row_number() OVER (PARTITION BY ref ORDER BY pos, ord) AS n FROM alignments WHERE ref IS NOT NULL", "alignments")
def bam_sort(a):
    return rank_in(a.where("ref IS NOT NULL").select("ref", "pos", "ord"), "ref", "n").select("ord", (F.col("n") + 1).alias("n"))


@query("SELECT count(*) AS n FROM alignments WHERE ref = 'ref2' AND pos BETWEEN 500 AND 39999", "alignments")
def bam_count_region(a):
    return B.filter_alignments(a, regions=[("ref2", 500, 40000)]).agg(F.count("*").alias("n"))


_COUNTS = "SELECT r.ref, r.length, CAST(count(a.ord) AS BIGINT) AS reads FROM refs r LEFT JOIN alignments a ON a.ref = r.ref GROUP BY r.ref, r.length"


@query(_COUNTS, "alignments", "refs")
def bam_reference_counts(a, refs):
    return B.reference_counts(a, refs)


@query(f"SELECT ref, length, reads, round(reads / (length / 1000.0) / ((SELECT count(*) FROM alignments) / 1e6), 6) AS rpkm FROM ({_COUNTS})", "alignments", "refs")
def bam_rpkm(a, refs):
    return B.rpkm(a, refs).withColumn("rpkm", F.round("rpkm", 6))


@query(f"SELECT ref, reads / (length / 1000.0) / ((SELECT count(*) FROM alignments) / 1e6) >= 5000 AS passed FROM ({_COUNTS})", "alignments", "refs")
def flt_rpkm(a, refs):
    return B.rpkm(a, refs).select("ref", (F.col("rpkm") >= 5000).alias("passed"))


_BITS = {"is_paired": 1, "is_in_proper_pair": 2, "is_unmapped": 4, "mate_is_unmapped": 8, "strand": 16, "mate_strand": 32, "is_first_in_pair": 64, "is_second_in_pair": 128, "is_not_primary": 256, "failed_quality": 512, "is_duplicate": 1024}


@query(" UNION ALL ".join(f"SELECT '{k}' AS bit, count(*) AS n FROM alignments WHERE (flag & {v}) > 0 HAVING count(*) > 0" for k, v in _BITS.items()), "alignments")
def bam_flag_counts(a):
    return B.flag_counts(a)


@query("SELECT ord, concat_ws(',', " + ", ".join(f"CASE WHEN (flag & {v}) > 0 THEN '{k}' END" for k, v in _BITS.items()) + ") AS tags FROM alignments", "alignments")
def prj_flag_names(a):
    return a.select("ord", F.array_join(flag_names(F.col("flag")), ",").alias("tags"))


@query("SELECT mapq AS value, count(*) AS n FROM alignments WHERE ref IS NOT NULL GROUP BY ALL", "alignments")
def bam_mapq(a):
    return stats.counter(a.where(B.mapped()), F.col("mapq"))


_BL = """b AS (SELECT ord, ref, mapq, pos AS rs, pos + 39 AS re, 10 AS qs FROM alignments WHERE ref IS NOT NULL AND cigar = '10S40M'
 UNION ALL SELECT ord, ref, mapq, pos, pos + 19, 0 FROM alignments WHERE ref IS NOT NULL AND cigar = '20M2D30M' UNION ALL SELECT ord, ref, mapq, pos + 22, pos + 51, 20 FROM alignments WHERE ref IS NOT NULL AND cigar = '20M2D30M'
 UNION ALL SELECT ord, ref, mapq, pos, pos + 24, 0 FROM alignments WHERE ref IS NOT NULL AND cigar = '25M1I24M' UNION ALL SELECT ord, ref, mapq, pos + 25, pos + 48, 26 FROM alignments WHERE ref IS NOT NULL AND cigar = '25M1I24M'
 UNION ALL SELECT ord, ref, mapq, pos, pos + 49, 0 FROM alignments WHERE ref IS NOT NULL AND cigar = '50M'),
p AS (SELECT ref, pos, count(*) AS depth, count_if(mapq > 0) AS o0, count_if(mapq > 20) AS o20, count_if(mapq > 30) AS o30, count_if(mapq > 40) AS o40 FROM (SELECT ref, mapq, unnest(range(rs, re + 1)) AS pos FROM b) GROUP BY ref, pos)"""


@query(f"WITH {_BL} SELECT ord, rs AS ref_start, re AS ref_end, CAST(qs AS BIGINT) AS read_start, CAST(qs + re - rs AS BIGINT) AS read_end FROM b", "alignments")
def bam_blocks(a):
    found = a.where(B.mapped()).select("ord", F.explode(B.blocks(F.col("pos"), F.col("cigar"))).alias("b"))
    return found.select("ord", "b.*")


@query(f"WITH {_BL} SELECT a.ord, CAST(max(CASE WHEN a.pos + 30 BETWEEN rs AND re THEN qs + a.pos + 30 - rs END) AS BIGINT) AS place, CAST(50 - 1 - max(CASE WHEN a.pos + 30 BETWEEN rs AND re THEN qs + a.pos + 30 - rs END) AS BIGINT) AS from_end FROM alignments a JOIN b ON a.ord = b.ord GROUP BY a.ord", "alignments")
def jon_read_positions(a):
    rows = a.where(B.mapped())
    place = B.read_position(B.blocks(F.col("pos"), F.col("cigar")), F.col("pos") + 30)
    return rows.select("ord", place.alias("place"), (B.read_length(F.col("cigar")) - 1 - place).alias("from_end"))


@query(f"WITH {_BL} SELECT depth, count(*) AS n FROM p GROUP BY depth", "alignments")
def bam_coverage(a):
    return B.coverage_distribution(a)


@query(f"WITH {_BL} SELECT mapq, depth, count(*) AS n FROM (SELECT 0 AS mapq, CAST(o0 AS BIGINT) AS depth FROM p UNION ALL SELECT 20, CAST(o20 AS BIGINT) FROM p UNION ALL SELECT 30, CAST(o30 AS BIGINT) FROM p UNION ALL SELECT 40, CAST(o40 AS BIGINT) FROM p) GROUP BY ALL", "alignments")
def bam_coverage_by_mapq(a):
    return B.coverage_by_mapq(a)


@query(f"WITH {_BL} SELECT depth, count(*) AS n FROM p GROUP BY depth UNION ALL SELECT 0, CAST((SELECT sum(length) FROM refs) - (SELECT count(*) FROM p) AS BIGINT)", "alignments", "refs")
def bam_genome_coverage(a, refs):
    return B.genome_coverage(a, refs)


@query("SELECT v AS mapq, CAST(count(a.ord) AS BIGINT) AS n FROM (SELECT CAST(unnest(range(lo, hi + 1)) AS INT) AS v FROM (SELECT min(mapq) AS lo, max(mapq) AS hi FROM alignments)) LEFT JOIN alignments a ON a.mapq = v GROUP BY v", "alignments")
def bam_dense_mapq(a):
    return B.dense_counts(a.groupBy("mapq").agg(F.count("*").alias("n")), "mapq")


@query("SELECT coalesce(rg, 'unknown') AS rg, CAST(count_if(ref IS NOT NULL) AS BIGINT) AS mapped, CAST(count_if(ref IS NULL) AS BIGINT) AS unmapped, CAST(count_if(mapq >= 30) AS BIGINT) AS \"over\" FROM alignments GROUP BY 1", "alignments")
def bam_by_read_group(a):
    return B.by_read_group(a, 30)


_MATES = """m AS (SELECT *, pos + CASE cigar WHEN '10S40M' THEN 40 WHEN '20M2D30M' THEN 52 WHEN '25M1I24M' THEN 49 ELSE 50 END - 1 AS e, (flag & 16) > 0 AS rev FROM alignments WHERE ref IS NOT NULL),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qname ORDER BY ord) AS k FROM m WHERE (flag & 64) > 0) WHERE k = 1),
q AS (SELECT f.qname, f.ref = s.ref AS same, greatest(f.e, s.e) - least(f.pos, s.pos) + 1 AS distance, CASE WHEN f.pos <= s.pos THEN f.rev ELSE s.rev END AS l, CASE WHEN f.pos <= s.pos THEN s.rev ELSE f.rev END AS r FROM f JOIN m s ON f.qname = s.qname AND (s.flag & 128) > 0),
k AS (SELECT qname, same, distance, CASE WHEN NOT l AND r THEN 'innie' WHEN l AND NOT r THEN 'outie' ELSE 'other' END AS kind FROM q)"""


@query(f"WITH {_MATES} SELECT kind, distance, count(*) AS n FROM k WHERE same GROUP BY ALL", "alignments")
def bam_pair_distances(a):
    return B.pair_distances(a)


@query(f"WITH {_MATES}, c AS (SELECT qname, bool_or(same AND kind = 'outie' AND distance BETWEEN 2000 AND 30000) AS o, bool_or(same AND kind = 'innie' AND distance < 20000) AS i FROM k GROUP BY qname) SELECT x.qname, CASE WHEN o THEN 'non_chimeric' WHEN i THEN 'chimera' ELSE 'unknown' END AS kind FROM (SELECT DISTINCT qname FROM alignments) x LEFT JOIN c USING (qname)", "alignments")
def bam_classify_mates(a):
    return B.classify_mates(a, (2000, 30000), 20000)


@query("SELECT r.name FROM reads r WHERE EXISTS (SELECT 1 FROM alignments a WHERE a.ref IS NOT NULL AND mapq > 20 AND r.name = 'read' || substr(a.qname, 2))", "reads", "alignments")
def flt_mapped(reads, a):
    names = a.where(B.mapped() & (F.col("mapq") > 20)).select(F.concat(F.lit("read"), F.substring("qname", 2, 20)).alias("name")).distinct()
    return reads.join(names, "name", "left_semi").select("name")


@query("SELECT name, bool_and(n = 0) OVER (PARTITION BY pair) AS passed FROM (SELECT r.name, r.pair, (SELECT count(*) FROM alignments a WHERE a.ref IS NOT NULL AND 'read' || substr(a.qname, 2) = r.name) AS n FROM reads r)", "reads", "alignments")
def flt_not_mapped(reads, a):
    names = a.where(B.mapped()).select(F.concat(F.lit("read"), F.substring("qname", 2, 20)).alias("name")).distinct()
    marked = reads.join(names.withColumn("hit", F.lit(True)), "name", "left")
    return pairs.flag_reads(marked, F.col("hit").isNull(), ["pair"]).select("name", "passed")


# Hits ----------------------------------------------------------------------------------------------

_SPAN = "min(least(q_start, q_end)) AS q_start, max(greatest(q_start, q_end)) AS q_end, min(least(s_start, s_end)) AS s_start, max(greatest(s_start, s_end)) AS s_end"


@query(f"SELECT query, subject, {_SPAN}, arg_min(expect, part_no) AS expect, arg_min(identity, part_no) AS identity, arg_min(score, part_no) AS score, count(*) AS parts FROM hits GROUP BY query, subject", "hits")
def aln_matches(hits):
    return H.matches(hits)


@query("SELECT query, subject, part_no FROM hits WHERE expect <= 0.002", "hits")
def aln_score_threshold(hits):
    return H.score_threshold(hits, "expect", max_score=0.002).select("query", "subject", "part_no")


@query("SELECT query, subject, part_no FROM (SELECT *, min(expect) OVER (PARTITION BY query) AS best FROM hits) WHERE expect = 0.0 OR (expect < 0.005 AND abs(log10(nullif(expect, 0)) - CASE WHEN best = 0 THEN 0 ELSE log10(nullif(best, 0)) END) < 0.5)", "hits")
def aln_best_scores(hits):
    return H.best_scores(hits, "expect", 0.5, max_score=0.005).select("query", "subject", "part_no")


_COV = """g AS (SELECT query, subject, least(q_start, q_end) AS s, greatest(q_start, q_end) AS e FROM hits), h AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY query, subject ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS n FROM g),
m AS (SELECT query, subject, min(s) AS s, max(e) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY query, subject ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM h) GROUP BY query, subject, i)"""


@query(f"WITH {_COV} SELECT query, subject, s, e FROM m", "hits")
def seg_covered_by_hits(hits):
    rows = H.covered(hits).select("query", "subject", F.explode("segments").alias("x"))
    return rows.select("query", "subject", F.col("x.start").alias("s"), F.col("x.end").alias("e"))


_BEST = "SELECT * FROM (SELECT *, min(expect) OVER (PARTITION BY query) AS best FROM hits) WHERE expect = 0.0 OR (expect < 0.005 AND abs(log10(nullif(expect, 0)) - CASE WHEN best = 0 THEN 0 ELSE log10(nullif(best, 0)) END) < 0.5)"
_CHAIN = [{"kind": "best_scores", "key": "expect", "log_tolerance": 0.5, "max_score": 0.005}, {"kind": "min_length", "percent": 20}]


@query(f"WITH b AS ({_BEST}), {_COV.replace('FROM hits', 'FROM b')}, l AS (SELECT query, subject FROM m GROUP BY query, subject HAVING sum(e - s + 1) * 100.0 / 160 >= 20) SELECT query, subject, {_SPAN}, count(*) AS parts FROM b JOIN l USING (query, subject) GROUP BY query, subject", "hits")
def aln_filter_chain(hits):
    return H.matches(H.filter_hits(hits, _CHAIN)).drop("expect", "identity", "score")


@query(
    f"""WITH b AS ({_BEST}), g AS (SELECT query, least(s_start, s_end) AS s, greatest(s_start, s_end) AS e FROM b), h AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY query ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS n FROM g)
SELECT query, min(s) AS s, max(e) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY query ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM h) GROUP BY query, i""",
    "hits",
)
def seg_covered_on_subjects(hits):
    rows = H.subject_segments(hits, _CHAIN[:1]).select("query", F.explode("segments").alias("x"))
    return rows.select("query", F.col("x.start").alias("s"), F.col("x.end").alias("e"))


@query(f"WITH {_COV}, l AS (SELECT query, subject FROM m GROUP BY query, subject HAVING sum(e - s + 1) * 100.0 / 160 >= 20) SELECT query, subject, part_no FROM hits JOIN l USING (query, subject)", "hits")
def aln_min_length(hits):
    return H.min_length(hits, percent=20).select("query", "subject", "part_no")


@query("SELECT query, subject, part_no FROM hits WHERE abs(q_end - q_start) >= 25", "hits")
def aln_min_part_length(hits):
    return H.min_part_length(hits, 25).select("query", "subject", "part_no")


@query(
    """WITH t AS (SELECT *, least(least(s_start, s_end), least(q_start, q_end)) AS l, least(s_len - greatest(s_start, s_end) - 1, q_len - greatest(q_start, q_end) - 1) AS r FROM hits)
SELECT query, subject, part_no, CASE WHEN q_start > q_end THEN q_start + r ELSE q_start - l END AS q_start, CASE WHEN q_start > q_end THEN q_end - l ELSE q_end + r END AS q_end,
 CASE WHEN s_start > s_end THEN s_start + r ELSE s_start - l END AS s_start, CASE WHEN s_start > s_end THEN s_end - l ELSE s_end + r END AS s_end, l + r AS elongated FROM t""",
    "hits",
)
def aln_elongate(hits):
    return H.elongate(hits).select("query", "subject", "part_no", "q_start", "q_end", "s_start", "s_end", "elongated")


@query("SELECT query, subject, score AS value FROM hits WHERE query <> subject", "hits")
def agg_scores(hits):
    return H.scores(hits, "score")


@query("WITH e AS (SELECT min(score) AS lo, max(score) AS hi FROM hits) SELECT CAST(least(floor((score - lo) / ((hi - lo) / 80)), 79) AS INT) AS bin, count(*) AS n FROM hits, e GROUP BY ALL", "hits")
def agg_array_stats(hits):
    return stats.array_stats(hits, "score")


@query("SELECT name FROM reads WHERE name NOT IN (SELECT 'read' || substr(query, 2) FROM hits WHERE identity >= 87 AND expect <= 0.001)", "reads", "hits")
def flt_no_hits(reads, hits):
    good = hits.where("identity >= 87 AND expect <= 0.001").withColumn("query", F.concat(F.lit("read"), F.substring("query", 2, 20)))
    return H.reads_with_hits(reads, good, present=False).select("name")
