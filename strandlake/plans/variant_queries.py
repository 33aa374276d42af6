"""Registered queries on sites and calls, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotate as A
from ..operators import linkage as L
from ..operators import variant_stats as S
from ..operators import variants as V
from ..operators import windows as W
from ..sources.bgzf_vcf import fetch_range, index_bgzf_vcf, write_bgzf_vcf
from ..sources.scratch import scratch_uri
from ..sources.vcf import format_sites, sites_of
from .views import view, with_views

QUERIES: dict = {}
ORACLES: dict = {}
#: The tables have seven samples, so sites count from three calls on.
CALLS = 3


def query(sql: str | None, *names: str):
    """Register a function of the named views; sql uses the same ones."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[view(spark, sf_dir, n) for n in names])
        if sql:
            ORACLES[f.__name__] = with_views(sql, *names)
        return f

    return register


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(
    f"SELECT ord, count(*) AS samples, CAST(count_if(called) AS BIGINT) AS num_called, round(count_if(called) / CAST(count(*) AS DOUBLE), 6) AS call_rate, CASE WHEN count_if(called) >= {CALLS} THEN round(count_if(coalesce(called AND a1 <> a2, false)) / CAST(count_if(called) AS DOUBLE), 6) END AS obs_het FROM calls GROUP BY ord",
    "calls",
)
def vcf_call_stats(calls):
    return rounded(V.call_stats(calls, CALLS), "call_rate", "obs_het")


_AL = "al AS (SELECT ord, a, count(*) AS n FROM (SELECT ord, a1 AS a FROM calls WHERE called UNION ALL SELECT ord, a2 FROM calls WHERE called) WHERE a IS NOT NULL GROUP BY ord, a), en AS (SELECT ord, count_if(called) >= 3 AS e FROM calls GROUP BY ord)"
_ST = _AL + ", st AS (SELECT ord, CASE WHEN e THEN max(n) / CAST(sum(n) AS DOUBLE) END AS maf, CAST(sum(n) - max(n) AS BIGINT) AS mac, CASE WHEN e THEN 1 - sum(n * n) / CAST(sum(n) * sum(n) AS DOUBLE) END AS exp_het, count(*) AS n_alleles FROM al JOIN en USING (ord) GROUP BY ord, e)"
_HET = ", ht AS (SELECT ord, CASE WHEN count_if(called) >= 3 THEN count_if(coalesce(called AND a1 <> a2, false)) / CAST(count_if(called) AS DOUBLE) END AS obs_het FROM calls GROUP BY ord)"


@query(f"WITH {_ST} SELECT ord, round(maf, 6) AS maf, mac, round(exp_het, 6) AS exp_het, n_alleles FROM st", "calls")
def vcf_allele_stats(calls):
    return rounded(V.allele_stats(calls, CALLS), "maf", "exp_het")


@query(f"WITH {_AL} SELECT ord, a AS allele, n FROM al", "calls")
def vcf_allele_counts(calls):
    return V.allele_counts(calls)


@query("SELECT ord, CASE WHEN a2 IS NULL THEN CAST(a1 AS VARCHAR) || '/.' ELSE CAST(least(a1, a2) AS VARCHAR) || '/' || CAST(greatest(a1, a2) AS VARCHAR) END AS genotype, count(*) AS n FROM calls WHERE called GROUP BY ALL", "calls")
def vcf_genotype_counts(calls):
    return V.genotype_counts(calls)


_MAJ = _AL + ", mj AS (SELECT ord, a AS major FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY n DESC, a) AS k FROM al) WHERE k = 1)"


@query(f"WITH {_MAJ} SELECT ord, CAST(count_if(k = 2) AS BIGINT) AS hom_major, CAST(count_if(k = 1) AS BIGINT) AS het, CAST(count_if(k = 0) AS BIGINT) AS hom_minor FROM (SELECT ord, CAST(a1 = major AS INT) + CAST(a2 = major AS INT) AS k FROM calls JOIN mj USING (ord) WHERE called AND a2 IS NOT NULL) GROUP BY ord", "calls")
def vcf_biallelic_counts(calls):
    return V.biallelic_counts(calls).select("ord", "hom_major", "het", "hom_minor")


@query(f"WITH {_ST}{_HET} SELECT ord, round(1 - obs_het / nullif(exp_het, 0), 6) AS f FROM st JOIN ht USING (ord)", "calls")
def vcf_inbreeding(calls):
    return rounded(V.inbreeding(calls, CALLS), "f")


#: Reads of each allele at each site: ord, i, d.
_DEPTHS = "(SELECT ord, i, sum(d) AS d FROM (SELECT ord, unnest(depths) AS d, unnest(range(0, len(depths))) AS i FROM calls {}) GROUP BY ord, i)"


@query(f"SELECT ord, depth, rd, round(m, 6) AS maf_depth FROM (SELECT ord, CAST(sum(dp) AS BIGINT) AS depth, CAST(sum(rd) AS BIGINT) AS rd FROM calls GROUP BY ord) JOIN (SELECT ord, max(d) / nullif(CAST(sum(d) AS DOUBLE), 0) AS m FROM {_DEPTHS.format('')} GROUP BY ord) USING (ord)", "calls")
def vcf_depth_stats(calls):
    return rounded(V.depth_stats(calls), "maf_depth")


@query(f"WITH {_ST} SELECT ord, maf < 0.95 AS polymorphic FROM st", "calls")
def vcf_polymorphic(calls):
    return V.is_polymorphic(calls, 0.95, CALLS)


_KIND = "CASE WHEN length(ref) = 1 THEN 'snp' ELSE 'indel' END"


@query(f"SELECT ord, {_KIND} AS kind, chrom || '_' || CAST(pos + 1 AS VARCHAR) AS id, CAST(pos + length(ref) AS BIGINT) AS stop FROM sites", "sites")
def vcf_site_columns(sites):
    name = V.snp_name(F.lit(None).cast("string"), "", F.col("chrom"), F.col("pos"))
    return sites.select("ord", V.kind_of(F.col("ref"), F.col("alts")).alias("kind"), name.alias("id"), (F.col("pos") + F.length("ref")).alias("stop"))


@query(
    "SELECT s.ord, CAST(coalesce(n, 0) AS INT) AS n_alts, CAST(1 + greatest(1, coalesce(n, 0)) AS INT) AS n_alleles FROM sites s LEFT JOIN (SELECT x.ord, count(DISTINCT a) AS n FROM (SELECT ord, a1 AS a FROM calls WHERE called AND sample IN ('S1', 'S2', 'S3') UNION ALL SELECT ord, a2 FROM calls WHERE called AND sample IN ('S1', 'S2', 'S3')) x JOIN sites y ON x.ord = y.ord WHERE a BETWEEN 1 AND len(y.alts) GROUP BY x.ord) z ON s.ord = z.ord",
    "sites", "calls",
)
def vcf_subset_samples(sites, calls):
    pruned, _ = V.subset_samples(sites, calls, ["S1", "S2", "S3"])
    return pruned.select("ord", F.size("alts").alias("n_alts"), V.allele_number(F.col("alts")).alias("n_alleles"))


@query("SELECT ord, chrom, pos, ref FROM sites WHERE chrom = 'chr2' AND pos >= 2000 AND pos < 90000", "sites")
def src_fetch_range(sites):
    return sites.where("chrom = 'chr2' AND pos >= 2000 AND pos < 90000").select("ord", "chrom", "pos", "ref")


@query("SELECT chrom, pos, ref, len(alts) AS n_alts FROM sites WHERE chrom = 'chr2' AND pos < 90000 AND pos + length(ref) > 2000", "sites")
def src_fetch_indexed(sites):
    """All sites are written block-compressed and indexed; the range is fetched through the index."""
    spark = sites.sparkSession
    uri, index = scratch_uri(spark, "sites"), scratch_uri(spark, "sites-index")
    bare = sites.withColumns({"ids": F.lit(None).cast("array<string>"), "filters": F.lit(None).cast("array<string>")})
    lines = format_sites(bare.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos"))
    write_bgzf_vcf(lines, uri, ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"])
    index_bgzf_vcf(spark, uri, index)
    return sites_of(fetch_range(spark, uri, index, "chr2", 2000, 90000)).select("chrom", "pos", "ref", F.size("alts").cast("long").alias("n_alts"))


# Filters -------------------------------------------------------------------------------------------

_FLAGS = f"""WITH {_ST}{_HET}, fl AS (SELECT s.ord, coalesce(maf < 0.95, false) AS polymorphic, coalesce(c.n >= 3, false) AS called, len(alts) = 1 AS biallelic,
 length(ref) = 1 AS snp, coalesce(qual >= 30, false) AS quality, coalesce(obs_het BETWEEN 0.1 AND 0.9, false) AS het, coalesce(maf BETWEEN 0.3 AND 0.9, false) AS freq
 FROM sites s LEFT JOIN st USING (ord) LEFT JOIN ht USING (ord) LEFT JOIN (SELECT ord, count_if(called) AS n FROM calls GROUP BY ord) c USING (ord))"""


def _flags(sites, calls):
    got = sites.join(V.call_stats(calls, CALLS), "ord", "left").join(V.allele_stats(calls, CALLS), "ord", "left")
    one = {
        "polymorphic": F.col("maf") < 0.95, "called": F.col("num_called") >= 3, "biallelic": F.size("alts") == 1,
        "snp": V.kind_of(F.col("ref"), F.col("alts")) == "snp", "quality": F.col("qual") >= 30,
        "het": F.col("obs_het").between(0.1, 0.9), "freq": F.col("maf").between(0.3, 0.9),
    }
    return got.select("ord", *[F.coalesce(c, F.lit(False)).alias(k) for k, c in one.items()])


@query(_FLAGS + " SELECT ord, polymorphic, called, biallelic, snp, quality, het, freq FROM fl", "sites", "calls")
def vfl_site_filters(sites, calls):
    return _flags(sites, calls)


@query(
    _FLAGS
    + " SELECT CAST(1 AS INT) AS step, 'called' AS filter, CAST(count_if(called) AS BIGINT) AS n FROM fl UNION ALL SELECT 2, 'snp', CAST(count_if(called AND snp) AS BIGINT) FROM fl UNION ALL SELECT 3, 'quality', CAST(count_if(called AND snp AND quality) AS BIGINT) FROM fl UNION ALL SELECT 4, 'freq', CAST(count_if(called AND snp AND quality AND freq) AS BIGINT) FROM fl",
    "sites", "calls",
)
def vfl_filter_log(sites, calls):
    return V.filter_log(_flags(sites, calls), ["called", "snp", "quality", "freq"])


@query("SELECT ord, sample, CASE WHEN gq >= 20 THEN a1 END AS a1, CASE WHEN gq >= 20 THEN a2 END AS a2, called AND gq >= 20 AS called FROM calls", "calls")
def gtf_low_quality(calls):
    return V.low_quality_to_missing(calls, 20).select("ord", "sample", "a1", "a2", "called")


@query("SELECT ord, sample, CASE WHEN h THEN NULL ELSE a1 END AS a1, CASE WHEN h THEN NULL ELSE a2 END AS a2, called AND NOT h AS called FROM (SELECT *, coalesce(called AND a1 <> a2, false) AS h FROM calls)", "calls")
def gtf_het(calls):
    return V.hets_to_missing(calls).select("ord", "sample", "a1", "a2", "called")


_EV = "SELECT ord, sample, a1, a2, called, depths[a1 + 1] AS r FROM calls"


@query(
    f"""WITH {_AL}, f AS (SELECT ord, a AS a1, n / CAST(sum(n) OVER (PARTITION BY ord) AS DOUBLE) AS p FROM al), e AS ({_EV}),
o AS (SELECT e.ord, sample, CASE WHEN NOT en.e THEN 'not_enough_individuals' WHEN NOT called THEN 'was_not_called' WHEN NOT coalesce(e.a1 = a2, false) THEN 'was_het'
 WHEN p / (p + pow(0.5, r - 1) * (1 - p)) >= 0.9999 THEN 'enough_evidence' ELSE 'not_enough_evidence' END AS outcome FROM e LEFT JOIN f ON e.ord = f.ord AND e.a1 = f.a1 JOIN en ON e.ord = en.ord)
SELECT ord, sample, outcome FROM o""",
    "calls",
)
def gtf_low_evidence(calls):
    return V.low_evidence_alleles(calls, min_calls=CALLS).select("ord", "sample", "outcome")


@query(
    f"""SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN NOT called THEN 'was_not_called' WHEN NOT coalesce(a1 = a2, false) THEN 'was_het'
 WHEN 127 / 256.0 / (127 / 256.0 + pow(0.5, r) * (1 - 2 * 127 / 256.0)) >= 0.9999 THEN 'enough_evidence' ELSE 'not_enough_evidence' END AS outcome FROM ({_EV})) GROUP BY outcome""",
    "calls",
)
def gtf_low_evidence_ril(calls):
    return V.low_evidence_alleles(calls, method="ril_self").groupBy("outcome").agg(F.count("*").alias("n"))


# Annotators ----------------------------------------------------------------------------------------


def _annotated(df):
    return df.select("ord", F.size("filters").alias("flagged"))


def _near(d: int) -> str:
    return f"count(*) OVER (PARTITION BY chrom ORDER BY pos RANGE BETWEEN {d} PRECEDING AND {d} FOLLOWING)"


@query(f"SELECT ord, CAST({_near(185)} > 1 AS INT) AS flagged FROM sites", "sites")
def ann_close_to_snv(sites):
    return _annotated(A.close_to_snv(sites, 185))


@query("SELECT s.ord, CAST(count(o.ord) > 0 AS INT) AS flagged FROM sites s LEFT JOIN sites o ON s.chrom = o.chrom AND abs(s.pos - o.pos) <= 185 AND s.ord <> o.ord AND length(o.ref) = 1 GROUP BY s.ord", "sites")
def ann_close_to_snp(sites):
    return _annotated(A.close_to_snp(sites, 185, "snp"))


@query(f"SELECT ord, CAST({_near(500)} / 1000.0 > 0.005 AS INT) AS flagged FROM sites", "sites")
def ann_high_variable_region(sites):
    return _annotated(A.high_variable_region(sites, 0.005, 1000))


@query("SELECT ord, CAST(coalesce(pos < 50000 OR length - pos < 50000, false) AS INT) AS flagged FROM sites s LEFT JOIN refs r ON s.chrom = r.ref", "sites", "refs")
def ann_close_to_limit(sites, refs):
    return _annotated(A.close_to_limit(sites, refs, 50000))


@query(f"SELECT s.ord, CAST(coalesce(m > 0.7, false) AS INT) AS flagged FROM sites s LEFT JOIN (SELECT ord, max(d) / nullif(CAST(sum(d) AS DOUBLE), 0) AS m FROM {_DEPTHS.format('')} GROUP BY ord) c USING (ord)", "sites", "calls")
def ann_maf_depth(sites, calls):
    return _annotated(A.maf_depth_limit(sites, calls, 0.7))


@query(f"SELECT ord, CAST({_KIND} <> 'snp' AS INT) AS flagged FROM sites", "sites")
def ann_kind(sites):
    return _annotated(A.kind_annotator(sites))


@query("SELECT s.ord, n > 1 AS variable, CAST(NOT coalesce(n > 1, false) AS INT) AS flagged FROM sites s LEFT JOIN (SELECT ord, count(DISTINCT a) AS n FROM (SELECT ord, a1 AS a FROM calls WHERE called AND sample IN ('S1', 'S3', 'S5') UNION ALL SELECT ord, a2 FROM calls WHERE called AND sample IN ('S1', 'S3', 'S5')) WHERE a IS NOT NULL GROUP BY ord) USING (ord)", "sites", "calls")
def ann_is_variable(sites, calls):
    return A.is_variable(sites, calls, ["S1", "S3", "S5"]).select("ord", "variable", F.size("filters").alias("flagged"))


@query("SELECT s.ord, CASE WHEN n >= 6 AND k > 0 THEN k >= 2 AND top / CAST(n AS DOUBLE) <= 0.8 END AS variable FROM sites s LEFT JOIN (SELECT ord, sum(d) AS n, max(d) AS top, count_if(d >= 3) AS k FROM " + _DEPTHS.format("WHERE sample IN ('S1', 'S3', 'S5')") + " GROUP BY ord) USING (ord)", "sites", "calls")
def ann_is_variable_by_depth(sites, calls):
    return A.is_variable_by_depth(sites, calls, ["S1", "S3", "S5"], max_maf=0.8).select("ord", "variable")


@query(
    """WITH a AS (SELECT ord, sample, unnest(depths) AS d, unnest(range(0, len(depths))) AS i FROM calls WHERE sample IN ('S1', 'S2')),
e AS (SELECT ord, sample, sum(d) AS n, max(d) AS top, count_if(d >= 3) AS k, bool_or(i = 0 AND d >= 3) AS r FROM a GROUP BY ord, sample),
v AS (SELECT ord, CASE WHEN n >= 6 AND k > 0 THEN NOT (k = 1 AND r) AND top / CAST(n AS DOUBLE) <= 0.95 END AS x FROM e)
SELECT s.ord, CASE WHEN c = 2 THEN one END AS one, CASE WHEN c = 2 THEN each END AS each FROM sites s LEFT JOIN (SELECT ord, count(x) AS c, bool_or(x) AS one, bool_and(x) AS each FROM v GROUP BY ord) USING (ord)""",
    "sites", "calls",
)
def ann_is_variable_by_depth_of_samples(sites, calls):
    told = lambda in_all, name: A.is_variable_by_depth(sites, calls, ["S1", "S2"], max_maf=0.95, in_union=False, in_all=in_all, reference_free=False).select("ord", F.col("variable").alias(name))
    return told(False, "one").join(told(True, "each"), "ord")


@query(f"SELECT s.ord, CAST(count(o.ord) > 0 AS INT) AS flagged FROM sites s LEFT JOIN (SELECT x.ord, chrom, pos FROM sites x JOIN (SELECT ord, max(d) / nullif(CAST(sum(d) AS DOUBLE), 0) AS m FROM {_DEPTHS.format('')} GROUP BY ord) c ON x.ord = c.ord WHERE m <= 0.7) o ON s.chrom = o.chrom AND abs(s.pos - o.pos) <= 185 AND s.pos <> o.pos GROUP BY s.ord", "sites", "calls")
def ann_close_to_varied(sites, calls):
    return _annotated(A.close_to_varied(sites, calls, 185, 0.7))


@query("SELECT s.ord, CAST(coalesce(p >= 40, false) AS INT) AS flagged FROM sites s LEFT JOIN (SELECT ord, floor(count_if(coalesce(a1 <> a2, false)) * 100.0 / count(*)) AS p FROM calls WHERE called GROUP BY ord) USING (ord)", "sites", "calls")
def ann_het_in_samples(sites, calls):
    return _annotated(A.het_in_samples(sites, calls, 40))


_CUTS = [
    "[" + ", ".join(f"CASE WHEN regexp_matches({c}, '{A.site_pattern(s)}') THEN '{n}' END" for n, s in A.ENZYMES.items()) + "]"
    for c in ("'GAATT' || ref || 'GCGGTAC' || ref", "'GAATT' || alts[1] || 'GCGGTAC' || alts[1]")
]


@query(f"SELECT ord, array_to_string(list_sort(list_concat(list_filter(x, lambda e: e IS NOT NULL AND NOT list_contains(y, e)), list_filter(y, lambda e: e IS NOT NULL AND NOT list_contains(x, e)))), ',') AS enzymes FROM (SELECT ord, {_CUTS[0]} AS x, {_CUTS[1]} AS y FROM sites)", "sites")
def ann_cap_enzymes(sites):
    context = lambda c: F.concat(F.lit("GAATT"), c, F.lit("GCGGTAC"), c)
    return sites.select("ord", F.array_join(A.cap_enzymes(context(F.col("ref")), context(F.get("alts", 0))), ",").alias("enzymes"))


# Windows and statistics ----------------------------------------------------------------------------


@query("SELECT w.chrom, start, start + 20000 AS \"end\", CAST(count(s.ord) AS BIGINT) AS n FROM (SELECT ref AS chrom, unnest(range(0, length - 20000 + 1, 5000)) AS start FROM refs) w LEFT JOIN sites s ON s.chrom = w.chrom AND s.pos >= start AND s.pos < start + 20000 GROUP BY ALL", "sites", "refs")
def win_site_windows(sites, refs):
    return W.site_windows(sites, refs, 20000, 5000)


@query(f"SELECT ord, {_near(500)} - 1 AS near FROM sites", "sites")
def vst_density(sites):
    return W.count_near(sites, 500).select("ord", "near")


@query("SELECT s.ord, o.ord AS ord_2 FROM sites s JOIN sites o ON s.chrom = o.chrom AND abs(s.pos - o.pos) <= 400", "sites")
def jon_range(sites):
    rows = sites.select("ord", "chrom", "pos")
    return W.range_join(rows, rows, "chrom", 400).select("ord", "ord_2")


@query("SELECT coalesce(depth, 0) AS value, count(*) AS n FROM (SELECT ord, CAST(sum(dp) AS BIGINT) AS depth FROM calls GROUP BY ord) GROUP BY ALL", "calls")
def vst_depths(calls):
    return S.distribution(V.depth_stats(calls), F.coalesce("depth", F.lit(0)))


@query("SELECT qual AS value, count(*) AS n FROM sites GROUP BY ALL", "sites")
def vst_qualities(sites):
    return S.distribution(sites, F.col("qual"))


@query(f"WITH {_ST} SELECT CAST(round(round(maf, 9) * 100) AS INT) AS value, count(*) AS n FROM st GROUP BY ALL", "calls")
def vst_maf(calls):
    return S.maf_distribution(calls, CALLS)


@query(f"WITH {_ST}{_HET} SELECT CAST(round(round(obs_het, 9) * 100) AS INT) AS value, count(*) AS n FROM ht GROUP BY ALL", "calls")
def vst_het(calls):
    return S.het_distribution(calls, CALLS)


@query(f"WITH {_ST}{_HET} SELECT CAST(round(round(1 - obs_het / nullif(exp_het, 0), 9) * 100) AS INT) AS value, count(*) AS n FROM st JOIN ht USING (ord) GROUP BY ALL", "calls")
def vst_inbreeding(calls):
    return S.inbreeding_distribution(calls, CALLS)


@query("SELECT CAST(d AS INT) AS depth, k AS samples, count(*) AS n FROM (SELECT ord, d, CAST(count_if(dp >= d) AS BIGINT) AS k FROM calls, (SELECT unnest([1, 5, 10, 20, 35, 50, 70]) AS d) GROUP BY ord, d) GROUP BY ALL", "calls")
def vst_samples_by_depth(calls):
    return S.samples_by_depth(calls)


_GT = "CASE WHEN called THEN CASE WHEN a1 <> a2 THEN 1 WHEN a1 = 0 THEN 0 WHEN a2 IS NOT NULL THEN 2 END END"


@query(f"SELECT coalesce(sample, 'TOTAL') AS sample, CAST(count_if(t = 0) AS BIGINT) AS hom_ref, CAST(count_if(t = 2) AS BIGINT) AS hom_alt, CAST(count_if(t = 1) AS BIGINT) AS het, CAST(count_if(t IS NULL) AS BIGINT) AS missing FROM (SELECT sample, {_GT} AS t FROM calls) GROUP BY ROLLUP (sample)", "calls")
def vst_sample_table(calls):
    return S.sample_table(calls)


@query(f"SELECT sample, CAST({_GT} AS INT) AS gt_type, count(*) AS n FROM calls WHERE gq >= 20 GROUP BY ALL", "calls")
def vst_genotypes_by_quality(calls):
    return S.genotypes_by_quality(calls, 20)


@query(f"SELECT rd, ad, CAST({_GT} AS INT) AS gt_type, count(*) AS n, round(avg(gq), 6) AS mean_gq FROM calls WHERE called GROUP BY ALL", "calls")
def vst_allele_counts_2d(calls):
    return rounded(S.allele_counts_2d(calls), "mean_gq")


@query("SELECT value, count(*) AS n FROM (SELECT CAST(count_if(called) AS BIGINT) AS value FROM calls GROUP BY ord) GROUP BY ALL", "calls")
def vst_called(calls):
    return S.distribution(V.call_stats(calls, CALLS), F.col("num_called"))


@query("SELECT sample, round(count_if(coalesce(a1 <> a2, false)) / CAST(nullif(count_if(called), 0) AS DOUBLE), 6) AS het FROM calls WHERE called GROUP BY sample", "calls")
def vst_het_by_sample(calls):
    return calls.where("called").groupBy("sample").agg(F.round(F.count_if(F.coalesce(V.is_het(), F.lit(False))) / F.count("*"), 6).alias("het"))


@query("SELECT k AS samples, " + ", ".join(f"nullif(CAST(sum(CASE WHEN d = {d} THEN 1 ELSE 0 END) AS BIGINT), 0) AS \"{d}\"" for d in S.DEPTHS) + " FROM (SELECT ord, d, CAST(count_if(called AND dp >= d) AS BIGINT) AS k FROM calls, (SELECT unnest([1, 5, 10, 20, 35, 50, 70]) AS d) GROUP BY ord, d) GROUP BY k", "calls")
def vst_missing_by_depth(calls):
    return S.missing_by_depth(calls)


@query("SELECT r.ref, length, count(*) AS n, round(count(*) * 100 / CAST(length AS DOUBLE), 2) AS density FROM refs r JOIN sites s ON s.chrom = r.ref GROUP BY r.ref, length", "sites", "refs")
def vst_chromosome_density(sites, refs):
    return S.chromosome_density(sites, refs)


@query("SELECT sample, sample_2, CAST(count_if(g = h) AS BIGINT) AS equal, CAST(count_if(g <> h) AS BIGINT) AS different, CAST(count_if(g IS NULL OR h IS NULL) AS BIGINT) AS uncalled FROM (SELECT ord, sample, CASE WHEN called THEN concat_ws('/', least(a1, a2), CASE WHEN a2 IS NOT NULL THEN greatest(a1, a2) END) END AS g FROM calls) x JOIN (SELECT ord, sample AS sample_2, CASE WHEN called THEN concat_ws('/', least(a1, a2), CASE WHEN a2 IS NOT NULL THEN greatest(a1, a2) END) END AS h FROM calls) y USING (ord) GROUP BY ALL", "calls")
def jon_compare_samples(calls):
    return S.compare_samples(calls, calls)


# Linkage -------------------------------------------------------------------------------------------

_PAIRS = "pr AS (SELECT s.chrom, s.ord, s.pos, o.ord AS ord_2, o.pos AS pos_2 FROM (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY pos, ord) AS i FROM sites) s JOIN (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY pos, ord) AS i FROM sites) o ON s.chrom = o.chrom AND o.i BETWEEN s.i + 1 AND s.i + 10)"
_HAP = (
    _PAIRS
    + """, hm AS (SELECT ord, sample, a1 AS x FROM calls WHERE called AND a1 = a2),
h0 AS (SELECT p.ord, p.ord_2, m.x, n.x AS y, count(*) AS n FROM pr p JOIN hm m ON p.ord = m.ord JOIN hm n ON p.ord_2 = n.ord AND m.sample = n.sample GROUP BY ALL),
rx AS (SELECT ord, ord_2, x, row_number() OVER (PARTITION BY ord, ord_2 ORDER BY sum(n) DESC, x) AS k FROM h0 GROUP BY ord, ord_2, x),
ry AS (SELECT ord, ord_2, y, row_number() OVER (PARTITION BY ord, ord_2 ORDER BY sum(n) DESC, y) AS k FROM h0 GROUP BY ord, ord_2, y),
fx AS (SELECT h.ord, h.ord_2, CASE WHEN rx.k = 1 THEN h.x ELSE x2.x END AS x, CASE WHEN ry.k = 1 THEN h.y ELSE y2.y END AS y, n FROM h0 h JOIN rx ON h.ord = rx.ord AND h.ord_2 = rx.ord_2 AND h.x = rx.x JOIN ry ON h.ord = ry.ord AND h.ord_2 = ry.ord_2 AND h.y = ry.y
 LEFT JOIN rx x2 ON h.ord = x2.ord AND h.ord_2 = x2.ord_2 AND x2.k = 2 LEFT JOIN ry y2 ON h.ord = y2.ord AND h.ord_2 = y2.ord_2 AND y2.k = 2),
g AS (SELECT ord, ord_2, x, y, sum(n) AS n FROM fx GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY ord, ord_2 ORDER BY n DESC, x, y) AS k FROM g),
q AS (SELECT g.ord, g.ord_2, CAST(sum(CASE WHEN g.x = t.x AND g.y = t.y THEN g.n ELSE 0 END) AS BIGINT) AS c1, CAST(sum(CASE WHEN g.x = t.x AND g.y <> t.y THEN g.n ELSE 0 END) AS BIGINT) AS c2,
 CAST(sum(CASE WHEN g.x <> t.x AND g.y = t.y THEN g.n ELSE 0 END) AS BIGINT) AS c3, CAST(sum(CASE WHEN g.x <> t.x AND g.y <> t.y THEN g.n ELSE 0 END) AS BIGINT) AS c4
 FROM g JOIN t ON g.ord = t.ord AND g.ord_2 = t.ord_2 AND t.k = 1 GROUP BY g.ord, g.ord_2 HAVING count(DISTINCT g.x) = 2 AND count(DISTINCT g.y) = 2),
z AS (SELECT *, CAST(c1 + c2 + c3 + c4 AS DOUBLE) AS m FROM q)"""
)


def _haplos(sites, calls):
    return L.haplotype_counts(W.index_pairs(sites, 10), calls)


@query(f"WITH {_HAP} SELECT ord, ord_2, c1, c2, c3, c4, round(pow(c1 / m - (c1 + c2) / m * (c1 + c3) / m, 2) / nullif((c1 + c2) / m * (1 - (c1 + c2) / m) * (c1 + c3) / m * (1 - (c1 + c3) / m), 0), 6) AS r2 FROM z", "sites", "calls")
def ld_haplotypes(sites, calls):
    got = _haplos(sites, calls).withColumn("r2", F.round(L.r2(*map(F.col, L.COUNTS)), 6))
    return got.select("ord", "ord_2", *[F.col(c).alias(f"c{i + 1}") for i, c in enumerate(L.COUNTS)], "r2")


@query(f"WITH {_HAP} SELECT ord, ord_2, round((c2 + c3) * (m - (c2 + c3) - 1) / (2.0 * (m - (c2 + c3)) * (m - (c2 + c3))), 6) AS ril, round((c2 + c3) / m, 6) AS cross_ FROM z", "sites", "calls")
def ld_recombination(sites, calls):
    got = _haplos(sites, calls)
    rate = lambda p: F.round(L.recombination(*map(F.col, L.COUNTS), p), 6)
    return got.select("ord", "ord_2", rate("ril_self").alias("ril"), rate("test_cross").alias("cross_"))


@query(
    f"""WITH {_HAP}, lf AS (SELECT i, sum(CASE WHEN i = 0 THEN 0.0 ELSE ln(i) END) OVER (ORDER BY i) AS v FROM (SELECT unnest(range(0, 30)) AS i)),
tb AS (SELECT DISTINCT c1, c2, c3, c4 FROM z), xs AS (SELECT *, unnest(range(greatest(0, c1 - c4), least(c1 + c2, c1 + c3) + 1)) AS x FROM tb),
pr2 AS (SELECT c1, c2, c3, c4, x, (SELECT v FROM lf WHERE i = c1 + c2) + (SELECT v FROM lf WHERE i = c3 + c4) + (SELECT v FROM lf WHERE i = c1 + c3) + (SELECT v FROM lf WHERE i = c2 + c4) - (SELECT v FROM lf WHERE i = c1 + c2 + c3 + c4)
 - (SELECT v FROM lf WHERE i = x) - (SELECT v FROM lf WHERE i = c1 + c2 - x) - (SELECT v FROM lf WHERE i = c1 + c3 - x) - (SELECT v FROM lf WHERE i = c4 - c1 + x) AS lp FROM xs),
pv AS (SELECT c1, c2, c3, c4, sum(exp(lp)) AS p FROM (SELECT *, max(CASE WHEN x = c1 THEN lp END) OVER (PARTITION BY c1, c2, c3, c4) AS here FROM pr2) WHERE lp <= here + 1e-7 GROUP BY ALL)
SELECT ord, ord_2, round(least(p, 1.0), 6) AS p FROM z JOIN pv USING (c1, c2, c3, c4)""",
    "sites", "calls",
)
def ld_fisher(sites, calls):
    return L.with_ld(_haplos(sites, calls)).select("ord", "ord_2", F.round("p", 6).alias("p"))


@query(f"WITH {_HAP.replace('s.i + 10', 's.i + 20')}, r AS (SELECT z.ord, z.ord_2, pow(c1 / m - (c1 + c2) / m * (c1 + c3) / m, 2) / nullif((c1 + c2) / m * (1 - (c1 + c2) / m) * (c1 + c3) / m * (1 - (c1 + c3) / m), 0) AS r2 FROM z JOIN pr USING (ord, ord_2) WHERE pos_2 - pos >= 400) SELECT ord FROM r WHERE r2 >= 0.3 UNION SELECT ord_2 FROM r WHERE r2 >= 0.3", "sites", "calls")
def ld_filter(sites, calls):
    return L.ld_filter(sites, calls, min_r2=0.3, p=10.0, bonferroni=False, window=41, min_distance=400).select("ord")


@query("WITH s AS (SELECT ord, CASE WHEN sample IN ('S1', 'S2') THEN 'A' ELSE 'B' END AS g, a FROM (SELECT ord, sample, a1 AS a FROM calls WHERE called UNION ALL SELECT ord, sample, a2 FROM calls WHERE called) WHERE a IS NOT NULL AND sample IN ('S1', 'S2', 'S3', 'S4')), u AS (SELECT ord, g, min(a) AS a FROM s GROUP BY ord, g HAVING count(DISTINCT a) = 1), k AS (SELECT x.ord, x.a AS \"A\", y.a AS b_ FROM u x JOIN u y ON x.ord = y.ord AND x.g = 'A' AND y.g = 'B' AND x.a <> y.a) SELECT k.ord, sample, CASE WHEN a1 = k.\"A\" THEN 'A' WHEN a1 = b_ THEN 'B' END AS code FROM calls c JOIN k ON c.ord = k.ord WHERE called AND a1 = a2", "calls")
def ld_parental_codes(calls):
    coding = L.parent_alleles(calls, ["S1", "S2"], ["S3", "S4"])
    return L.parental_codes(calls, coding)
