"""Registered queries on exports, recombination, transcripts and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignments as B
from ..operators import export as E
from ..operators import frames as FR
from ..operators import hits as H
from ..operators import linkage as L
from ..operators import merge as ME
from ..operators import recombination as R
from ..operators import stats, trim
from ..operators import tiles as TI
from ..operators import transcripts as T
from ..operators import variant_stats as S
from ..operators.annotate import ENZYMES, site_pattern
from ..sources.fastx import join_qualities
from ..sources.scratch import scratch_uri
from .alignment_queries import _BL
from .read_queries import DUST_SQL
from .variant_queries import _GT, _HAP
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


@query("SELECT ord, sample, CASE WHEN NOT called OR a2 IS NULL THEN '-' WHEN a1 <> a2 THEN 'H' WHEN a1 = 0 THEN 'A' ELSE 'B' END AS letter FROM calls", "calls")
def prj_genotype_letter(calls):
    return calls.select("ord", "sample", E.genotype_letter().alias("letter"))


@query(
    """WITH g AS (SELECT ord, pos, sample, CASE WHEN called AND a2 IS NOT NULL THEN CAST(least(a1, a2) AS VARCHAR) || '/' || CAST(greatest(a1, a2) AS VARCHAR) END AS g FROM calls),
k AS (SELECT ord, g, row_number() OVER (PARTITION BY ord ORDER BY min(sample)) AS k FROM g WHERE g IS NOT NULL GROUP BY ord, g)
SELECT g.ord, string_agg(CASE WHEN k IS NULL THEN '-' ELSE substr('ABCDEFGHIJ', CAST(k AS INT), 1) END, ',' ORDER BY sample) AS letters, printf('%.6e', pos / 1e6) AS position FROM g LEFT JOIN k ON g.ord = k.ord AND g.g = k.g GROUP BY g.ord, pos""",
    "calls",
)
def ld_rqtl_export(calls):
    return E.rqtl_genotypes(calls).select("ord", "letters", "position")


_RATE = "(c2 + c3) / m"


@query(f"WITH {_HAP} SELECT z.ord, z.ord_2 AS other, pos_2 - pos AS distance, round({_RATE}, 6) AS rate FROM z JOIN pr ON z.ord = pr.ord AND z.ord_2 = pr.ord_2 UNION ALL SELECT z.ord_2, z.ord, pos - pos_2, round({_RATE}, 6) FROM z JOIN pr ON z.ord = pr.ord AND z.ord_2 = pr.ord_2", "sites", "calls")
def ld_rates_to_neighbours(sites, calls):
    return R.rates_to_neighbours(sites, calls, 10).select("ord", "other", "distance", F.round("rate", 6).alias("rate"))


@query(f"WITH {_HAP} SELECT ord, ord_2, round(CASE WHEN {_RATE} < 0.5 THEN 0.25 * ln((1 + 2 * {_RATE}) / (1 - 2 * {_RATE})) END, 6) AS morgan FROM z", "sites", "calls")
def ld_kosambi(sites, calls):
    from ..operators.windows import index_pairs

    rate = L.recombination(*map(F.col, L.COUNTS), "test_cross")
    return L.haplotype_counts(index_pairs(sites, 10), calls).select("ord", "ord_2", F.round(L.kosambi(rate), 6).alias("morgan"))


@query(f"WITH {_HAP.replace('o.i BETWEEN s.i + 1 AND s.i + 10', 'o.pos - s.pos BETWEEN 400 AND 2000')} SELECT z.ord, z.ord_2, pos_2 - pos AS distance, round({_RATE}, 6) AS rate FROM z JOIN pr ON z.ord = pr.ord AND z.ord_2 = pr.ord_2", "sites", "calls")
def ld_rates_by_distance(sites, calls):
    return R.rates_by_distance(sites, calls, 400, 2000).withColumn("rate", F.round("rate", 6))


@query(None, "sites", "calls")
def vfl_weird_recombination(sites, calls):
    got = R.weird_recombination(R.rates_to_neighbours(sites, calls, 25))
    return got.select("ord", F.round("rate_at_zero", 4).alias("rate_at_zero"), "passed")


@query(None, "sites", "calls")
def vfl_weird_segregation(sites, calls):
    return R.weird_segregation(sites, calls, 500, 4000).select("ord", F.round("failed", 6).alias("failed"), "passed")


@query(
    """WITH s AS (SELECT ord, CASE WHEN sample IN ('S1', 'S2') THEN 'A' ELSE 'B' END AS g, a FROM (SELECT ord, sample, a1 AS a FROM calls WHERE called UNION ALL SELECT ord, sample, a2 FROM calls WHERE called) WHERE a IS NOT NULL AND sample IN ('S1', 'S2', 'S3', 'S4')),
u AS (SELECT ord, g, min(a) AS a FROM s GROUP BY ord, g HAVING count(DISTINCT a) = 1), k AS (SELECT x.ord, x.a AS a_, y.a AS b_ FROM u x JOIN u y ON x.ord = y.ord AND x.g = 'A' AND y.g = 'B' AND x.a <> y.a),
r AS (SELECT ord, chrom, row_number() OVER (PARTITION BY chrom ORDER BY pos, ord) AS i FROM sites),
hom AS (SELECT ord, sample, a1 AS x FROM calls WHERE called AND a1 = a2 AND sample IN ('S5', 'S6', 'S7')),
d AS (SELECT one.ord, two.ord AS o2 FROM r one, (SELECT unnest(range(-10, 11)) AS away) w JOIN r two ON two.chrom = one.chrom AND two.i = one.i + away WHERE away <> 0),
t AS (SELECT d.ord, o2, h.x, count_if(g.x = a_) AS na, count_if(g.x = b_) AS nb FROM d JOIN k ON k.ord = o2 JOIN hom h ON h.ord = d.ord JOIN hom g ON g.ord = o2 AND g.sample = h.sample WHERE g.x = a_ OR g.x = b_ GROUP BY d.ord, o2, h.x),
b AS (SELECT *, first_value(x) OVER (PARTITION BY ord, o2 ORDER BY na - nb DESC, x) AS a, first_value(x) OVER (PARTITION BY ord, o2 ORDER BY nb - na DESC, x) AS b FROM t),
v AS (SELECT ord, o2, a, b, greatest(2 * (0.5 - sum(CASE WHEN x = a THEN nb WHEN x = b THEN na ELSE 0 END) / CAST(sum(na + nb) AS DOUBLE)), 0.0) AS w FROM b WHERE a <> b GROUP BY ALL),
g AS (SELECT ord, a, b, sum(w) AS w FROM v GROUP BY ALL),
o AS (SELECT ord, sum(w) AS total, count(*) AS codings, max(w) AS most, arg_max(a, w) AS a, arg_max(b, w) AS b FROM g GROUP BY ord),
e AS (SELECT sites.ord, a, b, CASE WHEN total IS NULL OR total = 0 THEN 'no_info' WHEN codings > 2 THEN 'more_than_2_codings' WHEN most / total < 0.9 THEN 'not_enough_support' ELSE 'enough_support' END AS outcome FROM sites LEFT JOIN o ON sites.ord = o.ord)
SELECT ord, outcome, CASE WHEN outcome = 'enough_support' THEN a END AS "A", CASE WHEN outcome = 'enough_support' THEN b END AS "B" FROM e""",
    "sites", "calls",
)
def ld_vote_codes(sites, calls):
    coding = L.parent_alleles(calls, ["S1", "S2"], ["S3", "S4"])
    return R.vote_codes(sites, calls, coding, ["S5", "S6", "S7"])


@query(
    """WITH s AS (SELECT ord, CASE WHEN sample IN ('S1', 'S2') THEN 'A' ELSE 'B' END AS g, a FROM (SELECT ord, sample, a1 AS a FROM calls WHERE called UNION ALL SELECT ord, sample, a2 FROM calls WHERE called) WHERE a IS NOT NULL AND sample IN ('S1', 'S2', 'S3', 'S4')),
u AS (SELECT ord, g, min(a) AS a FROM s GROUP BY ord, g HAVING count(DISTINCT a) = 1), k AS (SELECT x.ord, x.a AS a_, y.a AS b_ FROM u x JOIN u y ON x.ord = y.ord AND x.g = 'A' AND y.g = 'B' AND x.a <> y.a),
c AS (SELECT k.ord, sample, CASE WHEN a1 = a_ THEN 'A' WHEN a1 = b_ THEN 'B' ELSE '-' END AS code FROM calls c JOIN k ON c.ord = k.ord WHERE called AND a1 = a2),
f AS (SELECT sample, o.ord FROM (SELECT DISTINCT sample FROM c), (SELECT DISTINCT ord FROM c) o)
SELECT f.sample, string_agg(coalesce(code, '-'), '' ORDER BY f.ord) AS codes FROM f LEFT JOIN c ON f.sample = c.sample AND f.ord = c.ord GROUP BY f.sample""",
    "calls",
)
def ld_marker_matrix(calls):
    return E.marker_matrix(L.parental_codes(calls, L.parent_alleles(calls, ["S1", "S2"], ["S3", "S4"])))


@query("SELECT depth, CAST(round(round(maf, 9) * 100) AS INT) AS maf, count(*) AS n FROM (SELECT ord, depth, m AS maf FROM (SELECT ord, CAST(sum(dp) AS BIGINT) AS depth FROM calls GROUP BY ord) JOIN (SELECT ord, max(d) / nullif(CAST(sum(d) AS DOUBLE), 0) AS m FROM (SELECT ord, i, sum(d) AS d FROM (SELECT ord, unnest(depths) AS d, unnest(range(0, len(depths))) AS i FROM calls) GROUP BY ord, i) GROUP BY ord) USING (ord)) GROUP BY ALL", "calls")
def vst_maf_by_depth(calls):
    return S.maf_by_depth(calls)


@query(f"SELECT sample, CASE WHEN t = 1 THEN 'HET' ELSE 'HOM' END AS kind, dp AS depth, count(*) AS n FROM (SELECT *, {_GT} AS t FROM calls WHERE gq >= 20) WHERE t IS NOT NULL GROUP BY ALL", "calls")
def vst_sample_counters(calls):
    return S.sample_counters(calls, 20)


@query(
    """WITH s AS (SELECT dp, list_sort(list(gq)) AS v, count(*) AS n FROM calls WHERE called AND dp < 100 GROUP BY dp)
SELECT dp, n AS count, CASE WHEN n < 4 THEN NULL WHEN (n + 1) % 4 = 0 THEN CAST(v[(n + 1) // 4] AS DOUBLE) ELSE (v[(n + 1) // 4] + v[(n + 1) // 4 + 1]) / 2.0 END AS q1,
 CASE WHEN n % 2 = 1 THEN CAST(v[n // 2 + 1] AS DOUBLE) ELSE (v[n // 2] + v[n // 2 + 1]) / 2.0 END AS median,
 CASE WHEN n < 4 THEN NULL WHEN (n + 1) * 3 % 4 = 0 THEN CAST(v[(n + 1) * 3 // 4] AS DOUBLE) ELSE (v[(n + 1) * 3 // 4] + v[(n + 1) * 3 // 4 + 1]) / 2.0 END AS q3 FROM s""",
    "calls",
)
def vst_quality_boxes(calls):
    return S.quality_boxes(calls)


@query(
    f"""WITH s AS (SELECT kind, dp, list_sort(list(gq)) AS v, count(*) AS n FROM (SELECT *, CASE {_GT} WHEN 1 THEN 'HET' WHEN 0 THEN 'HOM' WHEN 2 THEN 'HOM' END AS kind FROM calls) WHERE called AND dp < 100 AND kind IS NOT NULL GROUP BY kind, dp)
SELECT kind, dp, n AS count, CASE WHEN n < 4 THEN NULL WHEN (n + 1) % 4 = 0 THEN CAST(v[(n + 1) // 4] AS DOUBLE) ELSE (v[(n + 1) // 4] + v[(n + 1) // 4 + 1]) / 2.0 END AS q1,
 CASE WHEN n % 2 = 1 THEN CAST(v[n // 2 + 1] AS DOUBLE) ELSE (v[n // 2] + v[n // 2 + 1]) / 2.0 END AS median,
 CASE WHEN n < 4 THEN NULL WHEN (n + 1) * 3 % 4 = 0 THEN CAST(v[(n + 1) * 3 // 4] AS DOUBLE) ELSE (v[(n + 1) * 3 // 4] + v[(n + 1) * 3 // 4 + 1]) / 2.0 END AS q3 FROM s""",
    "calls",
)
def vst_quality_boxes_by_kind(calls):
    return S.quality_boxes(calls, by_kind=True)


@query(
    f"""WITH {_BL}
SELECT s.ord, a.qname, CAST(CASE WHEN (a.flag & 16) > 0 THEN 49 - (qs + t - rs) ELSE qs + t - rs END AS BIGINT) AS from5, CAST(49 - CASE WHEN (a.flag & 16) > 0 THEN 49 - (qs + t - rs) ELSE qs + t - rs END AS BIGINT) AS from3
FROM (SELECT ord, pos % 50000 AS t, 'ref' || CAST(ord % 5 AS VARCHAR) AS r FROM sites) s JOIN b ON b.ref = r AND t BETWEEN rs AND re JOIN alignments a ON a.ord = b.ord""",
    "alignments", "sites",
)
def jon_site_read_positions(a, sites):
    placed = sites.select("ord", (F.col("pos") % 50000).alias("pos"), F.concat(F.lit("ref"), (F.col("ord") % 5).cast("string")).alias("chrom"))
    return B.site_read_positions(a, placed).select("ord", "qname", "from5", "from3")


@query(
    f"""WITH {_BL},
p5 AS (SELECT s.qual, a.rg, CASE WHEN (a.flag & 16) > 0 THEN 49 - (qs + t - rs) ELSE qs + t - rs END AS from5
FROM (SELECT ord, qual, pos % 50000 AS t, 'ref' || CAST(ord % 5 AS VARCHAR) AS r FROM sites) s JOIN b ON b.ref = r AND t BETWEEN rs AND re JOIN alignments a ON a.ord = b.ord),
e AS (SELECT rg, 5 AS side, from5 + 1 AS place, qual FROM p5 UNION ALL SELECT rg, 3, 50 - from5, qual FROM p5),
g AS (SELECT rg, side, place, count(*) AS reads, count(qual) AS n, list_sort(list(qual) FILTER (qual IS NOT NULL)) AS v FROM e WHERE place <= 40 GROUP BY ALL)
SELECT rg, side, CAST(place AS BIGINT) AS place, reads, n AS count,
 CASE WHEN n < 4 THEN NULL WHEN (n + 1) % 4 = 0 THEN v[(n + 1) // 4] ELSE (v[(n + 1) // 4] + v[(n + 1) // 4 + 1]) / 2.0 END AS q1,
 CASE WHEN n = 0 THEN NULL WHEN n % 2 = 1 THEN v[n // 2 + 1] ELSE (v[n // 2] + v[n // 2 + 1]) / 2.0 END AS median,
 CASE WHEN n < 4 THEN NULL WHEN (n + 1) * 3 % 4 = 0 THEN v[(n + 1) * 3 // 4] ELSE (v[(n + 1) * 3 // 4] + v[(n + 1) * 3 // 4 + 1]) / 2.0 END AS q3 FROM g""",
    "alignments", "sites",
)
def vst_site_position_stats(a, sites):
    placed = sites.select("ord", "qual", (F.col("pos") % 50000).alias("pos"), F.concat(F.lit("ref"), (F.col("ord") % 5).cast("string")).alias("chrom"))
    return B.site_position_stats(a, placed, 40)


@query("SELECT ord, CAST(coalesce(n / CAST(length AS DOUBLE) > 0.0015, false) AS INT) AS flagged FROM (SELECT *, count(*) OVER (PARTITION BY chrom) AS n FROM sites) s LEFT JOIN refs r ON r.ref = s.chrom", "sites", "refs")
def ann_high_variable_sequence(sites, refs):
    from ..operators.annotate import high_variable_sequence

    found = high_variable_sequence(sites, refs, 0.0015)
    return found.select("ord", (F.size("filters") > 0).cast("int").alias("flagged"))


@query("SELECT ord, sample, concat_ws('/', CASE WHEN called AND a1 <= 1 THEN a1 END, CASE WHEN called AND a2 <= 1 THEN a2 END) AS alleles FROM calls", "calls")
def vcf_called_alleles(calls):
    from ..operators.variants import called_alleles

    return calls.select("ord", "sample", F.array_join(called_alleles(1).cast("array<string>"), "/").alias("alleles"))


_MERGED = """h AS (SELECT ref, CASE WHEN ref < 'd' THEN 0 ELSE 1 END AS file, row_number() OVER (ORDER BY ref) AS k FROM refs),
d AS (SELECT ref, row_number() OVER (ORDER BY file, k) - 1 AS n FROM h)"""


@query(f"""WITH {_MERGED} SELECT CAST(ord % 2 AS INTEGER) AS file, ord, CASE WHEN ord % 2 = 1 AND rg LIKE 'c%' THEN rg || '.1' ELSE rg END AS rg, CAST(n AS INTEGER) AS ref_number,
row_number() OVER (ORDER BY n NULLS LAST, pos NULLS LAST, ord % 2, ord) - 1 AS place FROM alignments a LEFT JOIN d ON d.ref = a.ref""", "alignments", "refs")  # fmt: skip
def bam_merge(a, refs):
    """Two files: reads of even and odd ord.  Read groups whose names begin with c are of other samples in the second."""
    from ..operators.ranges import index_rows

    files = [a.where(F.col("ord") % 2 == k) for k in (0, 1)]
    numbered = index_rows(refs.withColumn("ord", F.col("ref")), "number", parts=4).drop("ord")
    headers = [numbered.where("ref < 'd'"), numbered]
    names = a.select(F.col("rg").alias("id")).where("id IS NOT NULL").distinct()
    groups = [names.withColumn("sample", F.lit("one")), names.withColumn("sample", F.when(F.col("id").startswith("c"), "two").otherwise("one"))]
    merged = ME.merge_alignments(files, headers, groups)
    key = F.struct(F.coalesce("ref_number", F.lit(1 << 30)).alias("r"), F.coalesce("pos", F.lit(1 << 60)).alias("p"), "file", "ord")
    placed = index_rows(merged.withColumn("key", key), "place", by="key")
    return placed.select("file", "ord", "rg", "ref_number", "place")


@query("SELECT len AS value, count(*) AS n FROM reads GROUP BY len", "reads")
def agg_merge_counters(reads):
    one, two = (stats.counter(reads.where(F.col("direction") == d), F.col("len")) for d in ("fwd", "rev"))
    return stats.merge_counters(one, two)


_Q = "SELECT ascii(substr(qual, i, 1)) - 33 AS q FROM (SELECT qual, unnest(range(1, length(qual) + 1)) AS i FROM reads)"
_NX = "(SELECT CAST(max(len) AS DOUBLE) FROM (SELECT len, sum(len) OVER (ORDER BY len DESC RANGE UNBOUNDED PRECEDING) AS upto, sum(len) OVER () AS total FROM reads) WHERE upto >= floor(total * {} / 100))"


@query(
    f"""WITH q AS ({_Q}) SELECT 'reads' AS metric, CAST(count(*) AS DOUBLE) AS value FROM reads UNION ALL SELECT 'bases', CAST(sum(len) AS DOUBLE) FROM reads UNION ALL SELECT 'mean_length', round(avg(len), 6) FROM reads
UNION ALL SELECT 'mean_quality', round(avg(q), 6) FROM q UNION ALL SELECT 'q20', round(avg(CASE WHEN q >= 20 THEN 1.0 ELSE 0.0 END), 6) FROM q UNION ALL SELECT 'q30', round(avg(CASE WHEN q >= 30 THEN 1.0 ELSE 0.0 END), 6) FROM q
UNION ALL SELECT 'n50', {_NX.format(50)} UNION ALL SELECT 'n95', {_NX.format(95)}""",
    "reads",
)
def agg_report(reads):
    return stats.report(reads).withColumn("value", F.round("value", 6))


def _moments_sql(section: str, rows: str) -> str:
    """Rows of a section with the moments of (value, n)."""
    names = {"min": "min(value)", "max": "max(value)", "count": "sum(n)", "sum": "sum(value * n)", "average": "sum(value * n) / sum(n)", "variance": "sum(CAST(value AS DOUBLE) * value * n) / sum(n) - pow(sum(value * n) / sum(n), 2)"}
    return " UNION ALL ".join(f"SELECT '{section}' AS section, '{k}' AS metric, CAST(NULL AS BIGINT) AS pos, CAST(NULL AS VARCHAR) AS text, CAST({v} AS DOUBLE) AS value FROM {rows}" for k, v in names.items())


def _one_sql(section: str, metric: str, value: str) -> str:
    return f"SELECT '{section}', '{metric}', NULL, NULL, CAST({value} AS DOUBLE)"


_REPORT = f"""WITH dust AS (SELECT CAST(floor(dust) AS BIGINT) AS value, count(*) AS n FROM ({{dust}}) WHERE dust IS NOT NULL GROUP BY 1),
len AS (SELECT len AS value, count(*) AS n FROM reads GROUP BY 1),
place AS (SELECT i - 1 AS pos, ascii(substr(qual, CAST(i AS INT), 1)) - 33 AS q, upper(substr(seq, CAST(i AS INT), 1)) AS b, CASE WHEN i + 2 <= len THEN substr(seq, CAST(i AS INT), 3) END AS k FROM (SELECT seq, qual, len, unnest(range(1, len + 1)) AS i FROM reads)),
qual AS (SELECT q AS value, count(*) AS n FROM place GROUP BY 1),
kmer AS (SELECT k AS text, count(*) AS n FROM place WHERE k IS NOT NULL GROUP BY 1), often AS (SELECT n AS value, count(*) AS n FROM kmer GROUP BY 1),
boxes AS (SELECT pos, list_sort(list(q)) AS v, count(*) AS n FROM place GROUP BY pos),
box AS (SELECT pos, n AS count, CASE WHEN n < 4 THEN NULL WHEN (n + 1) % 4 = 0 THEN CAST(v[(n + 1) // 4] AS DOUBLE) ELSE (v[(n + 1) // 4] + v[(n + 1) // 4 + 1]) / 2.0 END AS q1,
 CASE WHEN n % 2 = 1 THEN CAST(v[n // 2 + 1] AS DOUBLE) ELSE (v[n // 2] + v[n // 2 + 1]) / 2.0 END AS median,
 CASE WHEN n < 4 THEN NULL WHEN (n + 1) * 3 % 4 = 0 THEN CAST(v[(n + 1) * 3 // 4] AS DOUBLE) ELSE (v[(n + 1) * 3 // 4] + v[(n + 1) * 3 // 4 + 1]) / 2.0 END AS q3 FROM boxes)
SELECT section, metric, pos, text, round(value, 4) AS value FROM ({_moments_sql("length", "len")} UNION ALL {_moments_sql("quality", "qual")} UNION ALL {_moments_sql("kmer", "often")} UNION ALL {_moments_sql("dust", "dust")}
UNION ALL {_one_sql("length", "n50", _NX.format(50))} UNION ALL {_one_sql("length", "n95", _NX.format(95))}
UNION ALL {_one_sql("quality", "q20", "(SELECT 100.0 * sum(CASE WHEN value >= 20 THEN n ELSE 0 END) / sum(n) FROM qual)")} UNION ALL {_one_sql("quality", "q30", "(SELECT 100.0 * sum(CASE WHEN value >= 30 THEN n ELSE 0 END) / sum(n) FROM qual)")}
UNION ALL {_one_sql("dust", "above", "(SELECT 100.0 * sum(CASE WHEN value > 7 THEN n ELSE 0 END) / sum(n) FROM dust)")}
UNION ALL SELECT 'quality_box', m, pos, NULL, CASE m WHEN 'count' THEN count WHEN 'q1' THEN q1 WHEN 'median' THEN median ELSE q3 END FROM box, (SELECT unnest(['count', 'q1', 'median', 'q3']) AS m)
UNION ALL SELECT 'base', 'n', pos, CASE WHEN b IN ('A', 'C', 'G', 'T') THEN b ELSE 'N' END AS t, count(*) FROM place GROUP BY pos, t
UNION ALL SELECT 'kmer_top', 'n', NULL, text, n FROM (SELECT * FROM kmer ORDER BY n DESC, text LIMIT 20))"""


@query(_REPORT.format(dust=DUST_SQL), "reads")
def agg_sequence_report(reads):
    return stats.sequence_report(stats.sequence_counters(reads)).withColumn("value", F.round("value", 4))


@query("SELECT name, qual FROM reads", "reads")
def src_fasta_and_qual(reads):
    scores = F.array_join(F.transform(F.filter(F.split("qual", ""), lambda c: c != ""), lambda c: (F.ascii(c) - 33).cast("string")), " ")
    return join_qualities(reads, reads.where("qual <> ''").select("name", scores.alias("scores"))).select("name", "qual")


def _orfs(least: int) -> str:
    """SQL: the longest stretch without a stop codon of each read, as tables st, fr, cu, pa and orf."""
    return f"""st AS (SELECT name, 1 AS strand, upper(seq) AS t FROM reads UNION ALL SELECT name, -1, translate(reverse(upper(seq)), 'ACGT', 'TGCA') FROM reads),
fr AS (SELECT name, strand, f, length(t) AS n, regexp_extract_all(substr(t, f + 1), '...') AS c FROM st, (VALUES (0), (1), (2)) v(f)),
cu AS (SELECT name, strand, f, n, list_concat(list_concat([0], list_filter(range(1, len(c) + 1), lambda k: c[k] IN ('TAA', 'TAG', 'TGA'))), [len(c) + 1]) AS s FROM fr),
pa AS (SELECT name, strand, f, n, s[i] AS a, 3 * (s[i + 1] - s[i] - 1) AS size FROM (SELECT *, unnest(range(1, len(s))) AS i FROM cu)),
orf AS (SELECT name, CASE WHEN strand = 1 THEN f + 3 * a ELSE n - f - 3 * a - size END AS start, size, strand FROM pa WHERE size >= {least} QUALIFY row_number() OVER (PARTITION BY name ORDER BY size DESC, strand DESC, f, a) = 1)"""


@query(f'WITH {_orfs(90)} SELECT r.name, CAST(start AS INT) AS start, CAST(start + size - 1 AS INT) AS "end", CAST(strand AS INT) AS strand FROM reads r LEFT JOIN orf ON r.name = orf.name', "reads")
def ext_longest_orf(reads):
    return reads.select("name", T.orf_of(F.col("seq"), F.lit(90)).alias("o")).select("name", "o.*")


def _tails(x: str, text: str, base: str) -> str:
    """SQL: letters of each read's poly-base tail, from the start of text on, as table {x}tail; its steps as other tables."""
    return f"""{x}c AS (SELECT name, unnest(range(length(seq))) AS i, unnest(string_split({text}, '')) AS b FROM reads WHERE length(seq) > 0),
{x}k AS (SELECT name, i, b, CASE WHEN b NOT IN ('{base}', 'N') THEN 1 ELSE 0 END AS bad FROM {x}c),
{x}s AS (SELECT *, sum(bad) OVER (PARTITION BY name ORDER BY i) AS nb, max(CASE WHEN b = '{base}' THEN i END) OVER (PARTITION BY name ORDER BY i) AS la FROM {x}k),
{x}t AS (SELECT name, min(i) AS stop FROM (SELECT *, sum(bad) OVER (PARTITION BY name, la ORDER BY i) AS run FROM {x}s) WHERE run > 1 GROUP BY name),
{x}z AS (SELECT s.name, s.i, sum(CASE WHEN b = '{base}' THEN 1 ELSE 0 END) OVER (PARTITION BY s.name, nb ORDER BY s.i) AS poly FROM {x}s s LEFT JOIN {x}t t ON s.name = t.name WHERE stop IS NULL OR s.i < stop),
{x}tail AS (SELECT name, max(i) + 1 AS tail FROM {x}z WHERE poly >= 5 GROUP BY name)"""


@query(
    f"""WITH {_tails("a_", "reverse(upper(seq))", "A")}, {_tails("t_", "upper(seq)", "T")}, {_orfs(300)},
d AS (SELECT r.name, seq, coalesce(a.tail, 0) AS ta, coalesce(t.tail, 0) AS tt, strand FROM reads r LEFT JOIN a_tail a ON r.name = a.name LEFT JOIN t_tail t ON r.name = t.name LEFT JOIN orf ON r.name = orf.name),
e AS (SELECT *, CASE WHEN ta + tt > 0 THEN 'polyA' WHEN strand IS NOT NULL THEN 'ORF' END AS reason, coalesce(CASE WHEN ta + tt > 0 THEN ta < tt ELSE strand = -1 END, false) AS turned FROM d)
SELECT name, reason, turned, md5(CASE WHEN turned THEN translate(reverse(seq), 'ACGT', 'TGCA') ELSE seq END) AS seq_md5 FROM e""",
    "reads",
)
def ext_orientate(reads):
    got = T.orientate(reads)
    return got.select("name", "reason", "turned", F.md5(F.col("seq").cast("binary")).alias("seq_md5"))


OLIGOS = [("linker", "AGTAGTAATACGAT"), ("adapter", "TTACAGTAGTAAC")]


def _oligos(oligos: list[tuple[str, str]]) -> str:
    """SQL: hits of oligos on both strands as table oh: every start that shares eight letters in a row, then its identity."""
    given = ", ".join(f"('{name}', '{seq}')" for name, seq in oligos)
    return f"""oo AS (SELECT * FROM (VALUES {given}) v(subject, q)), ob AS (SELECT subject, q, 1 AS strand FROM oo UNION ALL SELECT subject, translate(reverse(q), 'ACGT', 'TGCA'), -1 FROM oo),
os AS (SELECT subject, q, strand, k, substr(q, CAST(k AS INT) + 1, 8) AS w FROM (SELECT *, unnest(range(0, length(q) - 7)) AS k FROM ob)),
ow AS (SELECT name, i, substr(t, CAST(i AS INT) + 1, 8) AS w FROM (SELECT name, upper(seq) AS t, unnest(range(0, length(seq) - 7)) AS i FROM reads)),
om AS (SELECT DISTINCT ow.name, subject, q, strand, i - k AS s FROM ow JOIN os ON ow.w = os.w),
ox AS (SELECT om.*, length(q) AS m, upper(substr(seq, CAST(greatest(0, s) AS INT) + 1, CAST(least(length(seq), s + length(q)) - greatest(0, s) AS INT))) AS t, greatest(0, s) AS lo, least(length(seq), s + length(q)) AS hi FROM om JOIN reads ON om.name = reads.name),
oi AS (SELECT *, 100 * len(list_filter(range(0, hi - lo), lambda p: substr(t, CAST(p AS INT) + 1, 1) = substr(q, CAST(lo - s + p AS INT) + 1, 1))) / (hi - lo) AS identity FROM ox WHERE hi - lo >= 12),
oh AS (SELECT name AS query, subject, CAST(lo AS INT) AS q_start, CAST(hi - 1 AS INT) AS q_end, CAST(CASE WHEN strand = 1 THEN lo - s ELSE m - 1 - (lo - s) END AS INT) AS s_start,
  CAST(CASE WHEN strand = 1 THEN hi - s - 1 ELSE m - (hi - s) END AS INT) AS s_end, identity, hi - lo < m AS partial FROM oi WHERE identity >= 85)"""


@query(f"WITH {_oligos(OLIGOS)} SELECT * FROM oh", "reads")
def ext_oligo_hits(reads):
    return T.oligo_hits(reads, OLIGOS, min_identity=85, min_length=12)


@query(
    f"""WITH {_oligos(OLIGOS[:1])}, h AS (SELECT DISTINCT query AS name, q_start, q_end, partial FROM oh),
n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY q_start, q_end, partial) AS i FROM h),
c AS (SELECT name, i, q_start - 1 AS stop, 1 + lag(q_end) OVER (PARTITION BY name ORDER BY i) AS start, partial FROM n),
p AS (SELECT r.name, coalesce(start, 0) AS start, coalesce(stop, length(seq) - 1) AS stop, coalesce(i, 1) AS i FROM reads r LEFT JOIN c ON r.name = c.name
  UNION ALL SELECT n.name, q_end + 1, length(seq) - 1, i + 1 FROM n JOIN reads r ON n.name = r.name QUALIFY row_number() OVER (PARTITION BY n.name ORDER BY i DESC) = 1),
k AS (SELECT *, count(*) OVER (PARTITION BY name) AS parts, row_number() OVER (PARTITION BY name ORDER BY i) AS k FROM p WHERE stop >= start),
f AS (SELECT name, bool_or(partial) AS partial FROM n GROUP BY name)
SELECT k.name || CASE WHEN parts = 1 THEN '' WHEN parts = 2 THEN CASE WHEN partial THEN '_pl' ELSE '' END || chr(92) || k ELSE '_mlc.part' || k END AS name, CAST(stop - start + 1 AS INT) AS len FROM k LEFT JOIN f ON k.name = f.name""",
    "reads",
)
def ext_split_mates(reads):
    found = T.oligo_hits(reads, OLIGOS[:1], min_identity=85, min_length=12)
    one = F.array_sort(F.collect_set(F.struct(F.col("q_start").alias("start"), F.col("q_end").alias("end"), "partial")))
    linkers = found.groupBy(F.col("query").alias("name")).agg(one.alias("segments"))
    return T.split_mates(reads.select("name", "seq"), linkers).select("name", F.length("seq").alias("len"))


@query(
    """WITH t AS (SELECT query, least(q_start, q_end) - least(least(s_start, s_end), least(q_start, q_end)) AS s, greatest(q_start, q_end) + least(s_len - greatest(s_start, s_end) - 1, q_len - greatest(q_start, q_end) - 1) AS e FROM hits WHERE identity >= 90)
SELECT query, s, e FROM t""",
    "hits",
)
def trm_oligo_segments(hits):
    got = H.oligo_segments(hits.where("identity >= 90")).select("query", F.explode("segments").alias("x"))
    return got.select("query", F.col("x.start").alias("s"), F.col("x.end").alias("e"))


@query("SELECT query, CAST(min(least(q_start, q_end) - least(least(s_start, s_end), least(q_start, q_end))) AS INT) AS s, CAST(159 AS INT) AS e FROM hits WHERE identity >= 90 GROUP BY query", "hits")
def trm_adapters(hits):
    got = H.adapter_segments(hits.where("identity >= 90")).select("query", F.explode("segments").alias("x"))
    return got.select("query", F.col("x.start").alias("s"), F.col("x.end").alias("e"))


@query("WITH g AS (SELECT name, pair, CAST(floor((row_number() OVER (ORDER BY ord) - 1) / 4.0) AS BIGINT) AS group_no FROM reads), c AS (SELECT group_no, count(*) AS n, min(pair // 3) AS a, max(pair // 3) AS b FROM g GROUP BY group_no) SELECT name, group_no, CASE WHEN n < 4 THEN 'fewer reads' WHEN a <> b THEN 'names differ' END AS problem FROM g JOIN c USING (group_no)", "reads")
def jon_group_pairs(reads):
    from ..operators.pairs import group_pairs

    rows = reads.select("name", "ord", F.floor(F.col("pair") / 3).alias("template"))
    return group_pairs(rows, 4).select("name", "group_no", "problem")


@query("SELECT qname, CAST(e + 1 AS INT) AS start, CAST(99 AS INT) AS \"end\" FROM (SELECT query AS qname, arg_max(q_end, q_end) AS e FROM hits WHERE q_start = 0 GROUP BY query) WHERE e < 99", "hits")
def trm_chimeras(hits):
    rows = hits.select(F.col("query").alias("qname"), "q_start", "q_end", F.lit(100).alias("length"), F.col("part_no").alias("ord"))
    return trim.trim_chimera_segments(rows).select("qname", F.col("segment.start").alias("start"), F.col("segment.end").alias("end"))


@query(
    """WITH s AS (SELECT ord, chrom, pos % 3900 AS p, ref, alts, CASE WHEN len(alts) = 1 AND length(ref) = 1 THEN CASE array_to_string(list_sort([ref, alts[1]]), '') WHEN 'AG' THEN 'R' WHEN 'CT' THEN 'Y' WHEN 'CG' THEN 'S' WHEN 'AT' THEN 'W' WHEN 'GT' THEN 'K' WHEN 'AC' THEN 'M' END
  WHEN len(alts) = 1 THEN '-' ELSE '*' END AS code FROM sites WHERE chrom IN (SELECT ref FROM refs)),
first AS (SELECT chrom, p, arg_min(code, ord) AS code FROM s GROUP BY chrom, p),
f AS (SELECT s.*, k, CASE WHEN k < 0 THEN p + k ELSE p + length(ref) + k END AS q FROM s, (SELECT unnest(range(-60, 60)) AS k)),
b AS (SELECT f.ord, k, coalesce(first.code, substr('ACGTTGCAAC', CAST(q % 10 AS INT) + 1, 1)) AS base FROM f LEFT JOIN first ON first.chrom = f.chrom AND first.p = q WHERE q >= 0 AND q < 4000),
t AS (SELECT ord, coalesce(string_agg(base, '' ORDER BY k) FILTER (k < 0), '') AS l, coalesce(string_agg(base, '' ORDER BY k) FILTER (k >= 0), '') AS r FROM b GROUP BY ord)
SELECT s.ord, CASE WHEN length(l) >= 30 AND length(r) >= 30 THEN l || '[' || s.ref || '/' || array_to_string(alts, '/') || ']' || r END AS text FROM s LEFT JOIN t ON s.ord = t.ord""",
    "sites", "refs",
)
def ld_flanked_alleles(sites, refs):
    """Sites on references of 4,000 bases made of one motif."""
    short = sites.withColumn("pos", F.col("pos") % 3900)
    references = refs.select(F.col("ref").alias("chrom"), F.repeat(F.lit("ACGTTGCAAC"), 400).alias("seq"))
    return E.flanked_alleles(short, references, 60, 30)


@query(
    """WITH f AS (SELECT query AS name, count(*) AS n FROM hits WHERE identity >= 90 GROUP BY query)
SELECT r.name, coalesce(n, 0) > 0 AS passed FROM (SELECT DISTINCT query AS name FROM hits) r LEFT JOIN f USING (name)""",
    "hits",
)
def flt_features(hits):
    """Reads with a feature of a type, the features being made from hits."""
    found = T.hit_features(hits.where("identity >= 90"))
    rows = hits.select(F.col("query").alias("name")).distinct().join(found, "name", "left")
    return rows.select("name", F.coalesce(F.exists("features", lambda f: f["type"].isin("match_part")), F.lit(False)).alias("passed"))


@query("SELECT r.name, row_number() OVER (ORDER BY a.ref NULLS LAST, a.pos NULLS FIRST, r.ord) AS n FROM reads r LEFT JOIN (SELECT 'read' || substr(qname, 2) AS name, min({'ref': ref, 'pos': pos}) AS p FROM alignments WHERE ref IS NOT NULL GROUP BY 1) b ON r.name = b.name LEFT JOIN LATERAL (SELECT b.p.ref AS ref, b.p.pos AS pos) a ON true", "reads", "alignments")
def ord_sort_by_coordinate(reads, a):
    from ..operators.ranges import index_rows

    places = a.where(B.mapped()).withColumn("qname", F.concat(F.lit("read"), F.substring("qname", 2, 20)))
    best = places.groupBy(F.col("qname").alias("name")).agg(F.min(F.struct("ref", "pos")).alias("p"))
    rows = reads.join(best, "name", "left").select("name", F.struct(F.col("p.ref").isNull().alias("z"), "p.ref", "p.pos", "ord").alias("ord"))
    return index_rows(rows).select("name", (F.col("n") + 1).alias("n"))


@query("SELECT chrom, count(*) AS n, CAST(sum(mid) AS BIGINT) AS mids FROM (SELECT chrom, start + 10000 AS mid FROM (SELECT ref AS chrom, unnest(range(0, length - 20000 + 1, 5000)) AS start FROM refs) w WHERE (SELECT count(*) FROM sites s WHERE s.chrom = w.chrom AND s.pos >= start AND s.pos < start + 20000) >= 2) GROUP BY chrom", "sites", "refs")
def win_by_chromosome(sites, refs):
    from ..operators.windows import site_windows

    rows = site_windows(sites, refs, 20000, 5000, min_sites=2)
    return rows.groupBy("chrom").agg(F.count("*").alias("n"), F.sum(((F.col("start") + F.col("end")) / 2).cast("long")).alias("mids"))


@query("SELECT qname, count(*) AS n FROM (SELECT f.qname FROM (SELECT qname, min(ord) AS o FROM alignments WHERE ref IS NOT NULL AND (flag & 64) > 0 GROUP BY qname) f JOIN alignments s ON f.qname = s.qname AND s.ref IS NOT NULL AND (s.flag & 128) > 0) GROUP BY qname", "alignments")
def jon_mate_pairs(a):
    return B.mate_pairs(a).groupBy("qname").agg(F.count("*").alias("n"))


@query("SELECT a.ord, list_sort(list_concat(list_filter(a.alts, lambda x: NOT list_contains(b.alts, x)), list_filter(b.alts, lambda x: NOT list_contains(a.alts, x))))[1] AS one FROM sites a JOIN sites b ON b.ord = a.ord + 1", "sites")
def ord_symmetric_difference(sites):
    from ..operators.order import symmetric_difference

    other = sites.select((F.col("ord") - 1).alias("ord"), F.col("alts").alias("b"))
    return sites.join(other, "ord").select("ord", F.get(F.array_sort(symmetric_difference(F.col("alts"), F.col("b"))), 0).alias("one"))


@query("SELECT ord, sample, abs(rd / CAST(nullif(dp, 0) AS DOUBLE) - 0.5) < 0.05 AS near FROM calls", "calls")
def prj_approx_equal(calls):
    return calls.select("ord", "sample", (F.abs(F.col("rd") / F.when(F.col("dp") != 0, F.col("dp")) - 0.5) < 0.05).alias("near"))


@query("SELECT descr, len % 50 AS category, count(*) AS n, min(len) AS low, max(len) AS high FROM reads GROUP BY ALL", "reads")
def agg_boxplot_counters(reads):
    return reads.groupBy("descr", (F.col("len") % 50).alias("category")).agg(F.count("*").alias("n"), F.min("len").alias("low"), F.max("len").alias("high"))


@query("SELECT count(*) AS n FROM reads", "reads")
def ord_length(reads):
    return reads.agg(F.count("*").alias("n"))


@query("SELECT name, CAST(floor((row_number() OVER (ORDER BY ord) - 1) / 25.0) AS BIGINT) AS packet FROM reads", "reads")
def ord_packets(reads):
    from ..operators.ranges import index_rows

    return index_rows(reads.select("name", "ord")).select("name", F.floor(F.col("n") / 25).alias("packet"))


# Frames: each long read is a reference; its frame lacks 33 of its bases and, of every other read, is reversed.  Reads
# in which the first bases of either part come again have none.

_FRAMES = """u AS (SELECT ord, name AS chrom, upper(seq) AS s FROM reads WHERE len >= 500 AND instr(substr(upper(seq), 32), substr(upper(seq), 31, 40)) = 0 AND instr(substr(upper(seq), 215), substr(upper(seq), 214, 40)) = 0),
f AS (SELECT ord, chrom, s, substr(s, 31, 150) || substr(s, 214, 150) AS laid FROM u)"""
_SITES = """x AS (SELECT ord * 1000 + p AS ord, chrom, p AS pos, substr(s, CAST(p AS INT) + 1, 1) AS ref,
       [CASE WHEN p % 2 = 0 THEN 'A' ELSE 'C' END, CASE WHEN p % 4 < 2 THEN 'G' ELSE 'TT'[1:1 + p % 8 // 7] END] AS alts FROM u, (SELECT unnest([5, 31, 52, 90, 125, 174, 179, 181, 205, 213, 216, 218, 251, 255, 300, 361, 362, 400]) AS p))"""
# The right segment begins as far left as the bases on both sides of the gap agree.
_PARTS = """g AS (SELECT *, (SELECT coalesce(min(k), 150) - 0 FROM (SELECT unnest(range(0, 150)) AS k) WHERE substr(s, 180 - CAST(k AS INT), 1) <> substr(s, 213 - CAST(k AS INT), 1)) AS k FROM f),
h AS (SELECT ord, chrom, s, laid, 30 AS rs, 179 - k AS re, 0 AS os, 149 - k AS oe, k FROM g UNION ALL SELECT ord, chrom, s, laid, 213 - k, 362, 150 - k, 299, k FROM g)"""
_CODONS = """y AS (SELECT x.ord, alts, ord_f % 2 = 1 AS turned, os + pos - rs AS l, rs, re, os, oe, s, laid FROM (SELECT ord AS ord_f, chrom, s, laid, rs, re, os, oe FROM h) AS h JOIN x ON x.chrom = h.chrom AND pos BETWEEN rs AND re
       WHERE length(x.ref) = 1 AND length(alts[1]) = 1 AND length(alts[2]) = 1),
z AS (SELECT *, CASE WHEN turned THEN 299 - l ELSE l END % 3 AS k, CASE WHEN turned THEN l - 2 + (299 - l) % 3 ELSE l - l % 3 END AS c FROM y),
w AS (SELECT ord, alts, turned, k, substr(laid, CAST(c AS INT) + 1, 3) AS a, substr(s, CAST(rs + c - os AS INT) + 1, 3) AS b FROM z WHERE c >= os AND c + 2 <= oe),
v AS (SELECT ord, k, CASE WHEN turned THEN reverse(translate(a, 'ACGT', 'TGCA')) ELSE a END AS a, CASE WHEN turned THEN reverse(translate(b, 'ACGT', 'TGCA')) ELSE b END AS b,
      list_transform(alts, lambda q: CASE WHEN turned THEN translate(q, 'ACGT', 'TGCA') ELSE q END) AS alts FROM w),
t AS (SELECT ord, a, b, unnest(alts) AS q, unnest([1, 2]) AS n, k FROM v),
r AS (SELECT ord, n, a, b, substr(a, 1, CAST(k AS INT)) || q || substr(a, CAST(k AS INT) + 2) AS c FROM t),
o AS (SELECT ord, n, {a} AS ra, {b} AS rb, {c} AS aa FROM r),
m AS (SELECT ord, any_value(ra) AS ra, list(aa ORDER BY n) AS aas FROM o WHERE ra = rb GROUP BY ord)""".format(
    **{k: f"CASE WHEN regexp_matches({k}, '^[TCAG]{{3}}$') THEN substr('{T.AMINO_ACIDS}', 16 * (instr('TCAG', substr({k}, 1, 1)) - 1) + 4 * (instr('TCAG', substr({k}, 2, 1)) - 1) + instr('TCAG', substr({k}, 3, 1)), 1) ELSE 'X' END" for k in "abc"}
)


def _frames(reads):
    """Frames with their references, and sites on these."""
    # Exploded, as Spark would derive a read's letters from its text again for each condition that names them.
    long = reads.select("ord", F.col("name").alias("chrom"), F.explode(F.array(F.upper("seq"))).alias("s"))
    once = [F.instr(F.substr("s", F.lit(k + 1)), F.substring("s", k, 40)) == 0 for k in (31, 214)]
    long = long.where((F.length("s") >= 500) & once[0] & once[1])
    laid = F.concat(F.substring("s", 31, 150), F.substring("s", 214, 150))
    turned = F.when(F.col("ord") % 2 == 1, F.reverse(F.translate(laid, "ACGT", "TGCA"))).otherwise(laid)
    places = [5, 31, 52, 90, 125, 174, 179, 181, 205, 213, 216, 218, 251, 255, 300, 361, 362, 400]
    sites = long.select("ord", "chrom", "s", F.explode(F.array(*[F.lit(p).cast("long") for p in places])).alias("pos"))
    p = F.col("pos")
    other = F.when(p % 4 < 2, "G").when(p % 8 == 7, "TT").otherwise("T")
    alts = F.array(F.when(p % 2 == 0, "A").otherwise("C"), other)
    sites = sites.select((F.col("ord") * 1000 + p).alias("ord"), "chrom", "pos", F.substr(F.col("s"), p.cast("int") + 1, F.lit(1)).alias("ref"), alts.alias("alts"))
    return long.select("chrom", turned.alias("orf"), F.col("s").alias("reference")), sites


def _written(df, label):
    """df as a table of its own: changes of amino acids read sites and segments twice."""
    uri = scratch_uri(df.sparkSession, label)
    df.write.parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def _sites_and_segments(reads):
    frames, sites = _frames(reads)
    return _written(sites, "sites"), _written(FR.frame_segments(frames), "segments")


@query(f"WITH {_FRAMES}, {_PARTS} SELECT chrom, ord % 2 = 1 AS reversed, rs AS ref_start, re AS ref_end, os AS orf_start, oe AS orf_end FROM h WHERE re >= rs", "reads")
def ext_frame_segments(reads):
    frames, _ = _frames(reads)
    return FR.frame_segments(frames).select("chrom", "reversed", "ref_start", "ref_end", "orf_start", "orf_end")


@query(f"WITH {_FRAMES}, {_SITES}, {_PARTS}, {_CODONS} SELECT x.ord, CASE WHEN length(alts[2]) > 1 THEN 'INDEL' WHEN len(list_filter(aas, lambda e: e <> ra)) > 0 THEN ra || '->' || array_to_string(aas, ',') END AS aac FROM x LEFT JOIN m ON m.ord = x.ord", "reads")
def ann_amino_change(reads):
    return FR.amino_change(*_sites_and_segments(reads)).select("ord", "aac")


@query(f"WITH {_FRAMES}, {_SITES}, {_PARTS}, {_CODONS} SELECT x.ord, length(alts[2]) > 1 OR coalesce(len(list_filter(aas, lambda e: e <> ra AND (ascii(e) * ascii(ra)) % 7 < 3)) > 0, false) AS severe FROM x LEFT JOIN m ON m.ord = x.ord", "reads")
def ann_amino_severity(reads):
    """With scores by a rule of the letters, in place of a published matrix."""
    letters = reads.sparkSession.createDataFrame([(c,) for c in sorted(set(T.AMINO_ACIDS + "X"))], "aa string")
    pairs = letters.select(F.col("aa").alias("aa1"), F.lit(1).alias("one")).join(letters.select(F.col("aa").alias("aa2"), F.lit(1).alias("one")), "one")
    scores = pairs.select("aa1", "aa2", F.when((F.ascii("aa1") * F.ascii("aa2")) % 7 < 3, -1).otherwise(1).alias("score"))
    found = FR.amino_severity(*_sites_and_segments(reads), scores)
    return found.select("ord", F.array_contains("filters", "cas").alias("severe"))


# Differences to references whose base at place p is told by p, and reads that have another one where 13 divides p + ord.

_PLACES = """q AS (SELECT ord, pos, CAST(substr(ref, 4) AS BIGINT) AS r, cigar, i, CASE cigar WHEN '10S40M' THEN pos + i - 10 WHEN '20M2D30M' THEN pos + i + CASE WHEN i < 20 THEN 0 ELSE 2 END
        WHEN '25M1I24M' THEN pos + i - CASE WHEN i < 25 THEN 0 ELSE 1 END ELSE pos + i END AS p FROM alignments, (SELECT unnest(range(0, 50)) AS i) WHERE ref IS NOT NULL),
b AS (SELECT *, substr('ACGT', CAST((p * p // 7 + p * 3 + r) % 4 AS INT) + 1, 1) AS base FROM q WHERE NOT (cigar = '10S40M' AND i < 10) AND NOT (cigar = '25M1I24M' AND i = 25)),
l AS (SELECT ord, i * 2 AS k, CASE WHEN (p + ord) % 13 <> 0 THEN '=' ELSE base END AS x FROM b
      UNION ALL SELECT DISTINCT ord, 39, '^' || lower(substr('ACGT', CAST(((pos + 20) * (pos + 20) // 7 + (pos + 20) * 3 + r) % 4 AS INT) + 1, 1) || substr('ACGT', CAST(((pos + 21) * (pos + 21) // 7 + (pos + 21) * 3 + r) % 4 AS INT) + 1, 1)) FROM q WHERE cigar = '20M2D30M'),
j AS (SELECT ord, string_agg(x, '' ORDER BY k) AS x FROM l GROUP BY ord),
t AS (SELECT ord, x, regexp_extract_all(x, '=+|\\^[a-z]+|[A-Z]') AS t FROM j)"""


@query(f"""WITH {_PLACES} SELECT t.ord, array_to_string(list_transform(t, lambda y, i: CASE WHEN y[1] = '=' THEN '' ELSE CAST(CASE WHEN i > 1 AND t[i - 1][1] = '=' THEN length(t[i - 1]) ELSE 0 END AS VARCHAR) || upper(y) END), '')
 || CASE WHEN t[-1][1] = '=' THEN CAST(length(t[-1]) AS VARCHAR) ELSE '0' END AS md, CAST(length(regexp_replace(x, '[=^]', '', 'g')) + CASE WHEN cigar = '25M1I24M' THEN 1 ELSE 0 END AS INTEGER) AS nm FROM t JOIN alignments a ON a.ord = t.ord""", "alignments", "refs")  # fmt: skip
def bam_difference_tags(a, refs):
    def base(p, r):
        return F.substr(F.lit("ACGT"), ((F.floor(p * p / 7) + p * 3 + r) % 4 + 1).cast("int"), F.lit(1))

    refs = refs.where(F.col("ref").startswith("ref"))
    bases = F.transform(F.sequence(F.lit(0).cast("long"), F.col("length") - 1), lambda p: base(p, F.substr("ref", F.lit(4)).cast("long")))
    references = refs.select("ref", F.array_join(bases, "").alias("seq"))
    r = F.substr("ref", F.lit(4)).cast("long")

    def letter(i):
        p = F.col("pos") + i
        c = F.col("cigar")
        p = F.when(c == "10S40M", p - 10).when((c == "20M2D30M") & (i >= 20), p + 2).when((c == "25M1I24M") & (i > 25), p - 1).otherwise(p)
        clipped, put_in = (c == "10S40M") & (i < 10), (c == "25M1I24M") & (i == 25)
        return F.when(clipped | put_in, "T").when((p + F.col("ord")) % 13 != 0, base(p, r)).otherwise(F.translate(base(p, r), "ACGT", "CGTA"))

    reads = a.withColumn("seq", F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long")), letter), ""))
    return TI.difference_tags(reads, references)


_CUTS = "[" + ", ".join(f"{{'n': '{n}', 'p': '{site_pattern(x)}'}}" for n, x in sorted(ENZYMES.items())) + "]"


@query(f"""WITH {_FRAMES}, {_SITES}, c AS (SELECT x.ord, ref, alts, substr(s, CAST(greatest(pos - 99, 0) AS INT) + 1, CAST(pos - greatest(pos - 99, 0) AS INT)) AS b, substr(s, CAST(pos AS INT) + length(ref) + 1, 100) AS e FROM x JOIN u ON u.chrom = x.chrom)
SELECT ord, array_to_string(list_transform(list_filter({_CUTS}, lambda z: CAST(regexp_matches(b || ref || e, z.p) AS INT) + CAST(regexp_matches(b || alts[1] || e, z.p) AS INT) + CAST(regexp_matches(b || alts[2] || e, z.p) AS INT) BETWEEN 1 AND 2), lambda z: z.n), ',') AS enzymes FROM c""", "reads")  # fmt: skip
def ann_cap_enzymes_of_references(reads):
    frames, sites = _frames(reads)
    found = TI.cap_enzymes_of(sites, frames.select(F.col("chrom").alias("ref"), F.col("reference").alias("seq")))
    return found.select("ord", F.array_join("enzymes", ",").alias("enzymes"))
