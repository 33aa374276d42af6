"""Registered queries on reads, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import reads as R
from ..operators import order, pairs, stats, trim
from .views import view, with_views

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None, *views: str):
    """Register a function of (reads) under its name; sql may use the named views, reads always."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(view(spark, sf_dir, "reads"))
        if sql:
            ORACLES[f.__name__] = with_views(sql, "reads", *views)
        return f

    return register


Q = "list_transform(range(1, length(qual) + 1), lambda i: ascii(substr(qual, i, 1)) - 33)"
MEANQ = f"list_sum({Q}) / CAST(len AS DOUBLE)"


@query(
    f"""SELECT descr AS lang, count(*) AS n_reads, CAST(sum(len) AS BIGINT) AS n_bases FROM (
SELECT *, bool_and(len >= 200 AND coalesce(round({MEANQ}, 6) >= 20, false)) OVER (PARTITION BY pair) AS passed FROM reads)
WHERE passed GROUP BY descr"""
)
def clean_reads_by_lang(reads):
    ok = R.length_between(F.col("seq"), low=200) & (F.round(R.mean_quality(F.col("qual")), 6) >= 20)
    kept = pairs.flag_reads(reads, ok, pair=["pair"]).where("passed")
    return kept.groupBy(F.col("descr").alias("lang")).agg(F.count("*").alias("n_reads"), F.sum("len").alias("n_bases"))


@query(f"SELECT name, CAST(list_sum({Q}) AS BIGINT) AS total, CAST(list_max({Q}) AS INT) AS best FROM reads")
def prj_decode_quality(reads):
    q = R.decode_quality(F.col("qual"))
    return reads.select("name", F.aggregate(q, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_max(q).alias("best"))


@query("SELECT name, array_to_string(list_transform(range(1, length(qual) + 1), lambda i: chr(ascii(substr(qual, i, 1)) + 31)), '') AS qual FROM reads")
def prj_recode_quality(reads):
    return reads.select("name", R.recode_quality(F.col("qual"), 33, 64).alias("qual"))


@query("SELECT name, substr(seq, 11, 40) AS seq, substr(qual, 11, 40) AS qual FROM reads")
def prj_slice(reads):
    cut = lambda c: R.slice_text(F.col(c), F.lit(10), F.lit(50)).alias(c)
    return reads.select("name", cut("seq"), cut("qual"))


@query("SELECT name, upper(seq) AS u, lower(seq) AS l, translate(seq, 'ACGTNacgtn', 'acgtnACGTN') AS s, CAST(length(regexp_replace(seq, '[^A-Z]', '', 'g')) AS INT) AS n FROM reads")
def prj_change_case(reads):
    s = F.col("seq")
    return reads.select("name", R.change_case(s, "upper").alias("u"), R.change_case(s, "lower").alias("l"), R.change_case(s, "swap").alias("s"), R.upper_count(s).alias("n"))


@query("SELECT name, reverse(translate(seq, 'ACGT', 'TGCA')) AS seq, reverse(qual) AS qual FROM reads")
def prj_reverse_complement(reads):
    return reads.select("name", R.reverse_complement(F.col("seq")).alias("seq"), F.reverse("qual").alias("qual"))


@query("SELECT name, concat_ws(' ', descr, 'len', CAST(len AS VARCHAR)) AS descr, split_part(name || ' ' || descr, ' ', 1) AS id FROM reads")
def prj_descriptions(reads):
    return reads.select("name", F.concat_ws(" ", "descr", F.lit("len"), F.col("len").cast("string")).alias("descr"), F.get(F.split(F.concat_ws(" ", "name", "descr"), " ", 2), 0).alias("id"))


_TITLE = "CASE ord % 3 WHEN 0 THEN name || '/' || CAST(ord % 2 + 1 AS VARCHAR) WHEN 1 THEN name || ' ' || CAST(ord % 2 + 1 AS VARCHAR) || ':N:0' ELSE name || CASE WHEN ord % 2 = 0 THEN '.f' ELSE '.r' END END"


@query(
    f"""SELECT name, coalesce(nullif(regexp_extract(t, '^(.+)[/|\\\\](\\d+)', 1), ''), nullif(regexp_extract(t, '^(.+)\\s(\\d+):.+', 1), ''), nullif(regexp_extract(t, '^(.+)\\.(\\w)\\s?', 1), '')) AS template,
CASE WHEN coalesce(nullif(regexp_extract(t, '^(.+)[/|\\\\](\\d+)', 2), ''), nullif(regexp_extract(t, '^(.+)\\s(\\d+):.+', 2), ''), regexp_extract(t, '^(.+)\\.(\\w)\\s?', 2)) IN ('1', 'f') THEN 'fwd' ELSE 'rev' END AS direction
FROM (SELECT name, {_TITLE} AS t FROM reads)"""
)
def prj_pair_titles(reads):
    title = F.expr(_TITLE.replace("AS VARCHAR", "AS STRING"))
    p = R.pair_of_title(title)
    return reads.select("name", p["template"].alias("template"), p["direction"].alias("direction"))


@query("SELECT name, CASE WHEN n = 0 THEN NULL WHEN length(regexp_replace(s, '[^gcatnu]', '', 'g')) / CAST(n AS DOUBLE) > 0.8 THEN 'nucl' WHEN regexp_matches(s, '[efilopqxz]') THEN 'prot' END AS kind FROM (SELECT name, lower(seq) AS s, length(seq) AS n FROM reads)")
def src_guess_type(reads):
    return reads.select("name", R.guess_sequence_type(F.col("seq")).alias("kind"))


@query("SELECT CASE WHEN min(ascii(substr(qual, i, 1))) < 64 THEN 'fastq' ELSE 'fastq-illumina' END AS version FROM reads, LATERAL (SELECT unnest(range(1, length(qual) + 1)) AS i)")
def src_guess_fastq_version(reads):
    return R.guess_fastq_version(reads)


# Filters -------------------------------------------------------------------------------------------


def _filter(name: str, predicate, sql: str, **frame):
    """A filter on its own, on pairs that fail together, on pairs that pass together, and reversed."""
    for kind, options, over in (
        ("", {}, "coalesce({p}, false)"),
        ("_drag", {"pair": ["pair"]}, "bool_and(coalesce({p}, false)) OVER (PARTITION BY pair)"),
        ("_any", {"pair": ["pair"], "failed_drags_pair": False}, "bool_or(coalesce({p}, false)) OVER (PARTITION BY pair)"),
        ("_reverse", {"pair": ["pair"], "reverse": True}, "bool_and(NOT coalesce({p}, false)) OVER (PARTITION BY pair)"),
    ):
        key = f"flt_{name}{kind}"
        QUERIES[key] = lambda spark, sf_dir, o=options: pairs.flag_reads(view(spark, sf_dir, "reads"), predicate(), **o).select("name", "passed")
        ORACLES[key] = with_views(f"SELECT name, {over.format(p=sql)} AS passed FROM reads", "reads")


_filter("length", lambda: R.length_between(F.col("seq"), 100, 3000), "len BETWEEN 100 AND 3000")
_filter("length_unmasked", lambda: R.length_between(F.col("seq"), 500, None, True), "length(regexp_replace(seq, '[^A-Z]', '', 'g')) >= 500")
_filter("mean_quality", lambda: F.round(R.mean_quality(F.col("qual")), 6) >= 19, f"round({MEANQ}, 6) >= 19")
_filter(
    "mean_quality_masked",
    lambda: F.round(R.masked_mean_quality(F.col("seq"), F.col("qual")), 6) >= 18,
    "round(list_sum(list_transform(range(1, length(qual) + 1), lambda i: CASE WHEN regexp_matches(substr(seq, i, 1), '[A-Z]') THEN ascii(substr(qual, i, 1)) - 33 ELSE 0 END)) / CAST(len AS DOUBLE), 6) >= 18",
)
_filter("all_n", lambda: R.has_real_bases(F.regexp_replace("seq", "[ACGT]", "N")), "regexp_replace(seq, '[ACGT]', 'N', 'g') = '' OR regexp_matches(regexp_replace(seq, '[ACGT]', 'N', 'g'), '[^Nn*-]')")

DUST_SQL = """WITH win AS (
  SELECT name, true AS full_, substr(upper(seq), i * 32 + 1, 64) AS w FROM (SELECT name, seq, unnest(range(0, CASE WHEN len > 64 THEN CAST(floor((len - 64) / 32.0) AS BIGINT) + 1 ELSE 0 END)) AS i FROM reads)
  UNION ALL SELECT name, false, substr(upper(seq), CASE WHEN len > 64 THEN CAST(floor((len - 64) / 32.0) AS BIGINT) + 1 ELSE 0 END * 32 + 1) FROM reads),
num AS (SELECT row_number() OVER (ORDER BY name, full_, w) AS id, name, full_, w, length(w) AS m FROM win WHERE full_ OR length(w) > 5),
tri AS (SELECT id, substr(w, i, 3) AS t FROM (SELECT id, w, unnest(range(1, m - 1)) AS i FROM num)),
raw AS (SELECT id, sum(k * (k - 1) / 2.0) AS raw FROM (SELECT id, t, count(*) AS k FROM tri GROUP BY id, t) GROUP BY id),
sc AS (SELECT name, avg(CASE WHEN full_ THEN raw / 62.0 ELSE raw / (m - 3) * 62 / (m - 2) END) * 100 / 31 AS dust FROM num JOIN raw USING (id) GROUP BY name)
SELECT name, round(CASE WHEN len = 3 THEN 0.0 WHEN len > 5 THEN dust END, 6) AS dust FROM reads LEFT JOIN sc USING (name)"""


@query(DUST_SQL)
def agg_dust(reads):
    return reads.select("name", F.round(R.dust_score(F.col("seq")), 6).alias("dust"))


def _named(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select(F.col("doc_id").alias("ord")).distinct()
    return view(spark, sf_dir, "reads").join(names, "ord", "left_semi").select("name")


QUERIES["flt_name_in_list"] = _named
ORACLES["flt_name_in_list"] = with_views("SELECT name FROM reads WHERE ord IN (SELECT doc_id FROM labels WHERE quality = 1)", "reads")


QUERIES["flt_dust"] = lambda spark, sf_dir: pairs.flag_reads(view(spark, sf_dir, "reads"), F.round(R.dust_score(F.col("seq")), 6) < 3).select("name", "passed")
ORACLES["flt_dust"] = f"SELECT name, coalesce(dust < 3, false) AS passed FROM ({ORACLES['agg_dust']})"


# Trimming and segments -----------------------------------------------------------------------------


@query("SELECT name, route, CASE WHEN route = 'lost' THEN '' ELSE substr(seq, 6, len - 15) END AS seq FROM (SELECT *, CASE WHEN len <= 15 THEN 'lost' WHEN bool_and(len > 15) OVER (PARTITION BY pair) THEN 'passed' ELSE 'orphan' END AS route FROM reads)")
def trm_edges(reads):
    cut = trim.recommend(reads, trim.edge_segments(F.col("len"), 5, 10))
    return trim.trim_or_mask(cut, pair=["pair"]).select("name", "route", "seq")


@query("SELECT name, CASE WHEN len <= 15 THEN lower(seq) ELSE lower(substr(seq, 1, 5)) || substr(seq, 6, len - 15) || lower(substr(seq, len - 9, 10)) END AS seq FROM reads")
def trm_mask_edges(reads):
    cut = trim.recommend(reads, trim.edge_segments(F.col("len"), 5, 10))
    return trim.trim_or_mask(cut, mask=True).select("name", "seq")


_RUNS = """u AS (SELECT name, s, e FROM (SELECT name, min(i) AS s, max(i) AS e FROM (
  SELECT name, i, i - row_number() OVER (PARTITION BY name ORDER BY i) AS g FROM (
    SELECT name, seq, unnest(range(0, length(seq))) AS i FROM reads) WHERE regexp_matches(substr(seq, i + 1, 1), '[A-Z]')) GROUP BY name, g))"""


@query(f"WITH {_RUNS}, b AS (SELECT name, s, e, row_number() OVER (PARTITION BY name ORDER BY e - s DESC, s) AS k FROM u) SELECT r.name, coalesce(substr(seq, s + 1, e - s + 1), '') AS seq FROM reads r LEFT JOIN b ON r.name = b.name AND k = 1")
def trm_lower_case(reads):
    cut = trim.recommend(reads, trim.lower_case_segments(F.col("seq")))
    return trim.trim_or_mask(cut).select("name", "seq")


@query(f"WITH {_RUNS} SELECT name, CAST(s AS INT) AS s, CAST(e AS INT) AS e FROM u")
def prj_upper_segments(reads):
    return reads.select("name", F.explode(R.upper_segments(F.col("seq"))).alias("x")).select("name", F.col("x.start").alias("s"), F.col("x.end").alias("e"))


@query(
    """WITH w AS (SELECT name, i, s FROM (SELECT name, i, ascii(substr(qual, i, 1)) + ascii(substr(qual, i + 1, 1)) + ascii(substr(qual, i + 2, 1)) + ascii(substr(qual, i + 3, 1)) + ascii(substr(qual, i + 4, 1)) - 165 AS s
  FROM (SELECT name, qual, unnest(range(1, len - 3)) AS i FROM reads WHERE len >= 5))),
b AS (SELECT name, i AS bi, s AS bs FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY s DESC, i) AS k FROM w) WHERE k = 1 AND s >= 100),
x AS (SELECT name, bi, max(CASE WHEN s < 100 AND i < bi THEN i END) AS lo, min(CASE WHEN s < 100 AND i > bi THEN i END) AS hi FROM b JOIN w USING (name) GROUP BY name, bi)
SELECT r.name, coalesce(substr(seq, coalesce(lo, 0) + 1, coalesce(hi + 3, len) - coalesce(lo, 0)), '') AS seq FROM reads r LEFT JOIN x USING (name) WHERE x.name IS NOT NULL
UNION ALL SELECT name, '' FROM reads WHERE name NOT IN (SELECT name FROM x)"""
)
def trm_quality(reads):
    cut = trim.recommend(reads, trim.quality_segments(F.col("qual"), 5, 20))
    return trim.trim_or_mask(cut).select("name", "seq")


_SEG = "SELECT pair AS k, CAST(ord * 31 % 400 AS INT) AS s, CAST(ord * 31 % 400 + len % 60 AS INT) AS e FROM reads UNION ALL SELECT pair, CAST(len % 450 AS INT), CAST(len % 450 + 20 AS INT) FROM reads"
_MERGED = f"""g AS ({_SEG}), h AS (SELECT k, s, e, CASE WHEN s <= max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS n FROM g),
m AS (SELECT k, min(s) AS s, max(e) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM h) GROUP BY k, i)"""
_FREE = _MERGED + """, f AS (SELECT k, coalesce(lag(e) OVER (PARTITION BY k ORDER BY s) + 1, 0) AS s, s - 1 AS e FROM m UNION ALL SELECT k, max(e) + 1, 599 FROM m GROUP BY k)"""


def _segments(reads):
    one = reads.select("pair", F.struct((F.col("ord") * 31 % 400).cast("int").alias("start"), (F.col("ord") * 31 % 400 + F.col("len") % 60).cast("int").alias("end")).alias("x"))
    two = reads.select("pair", F.struct((F.col("len") % 450).cast("int").alias("start"), (F.col("len") % 450 + 20).cast("int").alias("end")).alias("x"))
    return one.unionByName(two).groupBy(F.col("pair").alias("k")).agg(F.collect_list("x").alias("x"))


def _ends(df, x):
    return df.select("k", F.explode(x).alias("y")).select("k", F.col("y.start").alias("s"), F.col("y.end").alias("e"))


@query(f"WITH {_MERGED} SELECT k, s, e FROM m")
def seg_merge(reads):
    return _ends(_segments(reads), trim.merge_segments(F.col("x")))


@query(f"WITH {_FREE} SELECT k, CAST(s AS INT) AS s, CAST(e AS INT) AS e FROM f WHERE e >= s")
def seg_complement(reads):
    return _ends(_segments(reads), trim.complement_segments(trim.merge_segments(F.col("x")), F.lit(600)))


@query(f"WITH {_FREE} SELECT k, CAST(s AS INT) AS s, CAST(e AS INT) AS e FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY e - s DESC, s) AS r FROM f WHERE e >= s) WHERE r = 1")
def seg_longest_free(reads):
    x = trim.longest_free(F.col("x"), F.lit(600))
    return _segments(reads).select("k", x["start"].alias("s"), x["end"].alias("e")).where("s IS NOT NULL")


@query(f"WITH {_FREE} SELECT k, CAST(s AS INT) AS s, CAST(e AS INT) AS e, c FROM (SELECT k, s, e, true AS c FROM m UNION ALL SELECT k, s, e, false FROM f WHERE e >= s)")
def seg_covered_and_free(reads):
    return _segments(reads).select("k", F.explode(trim.covered_and_free(F.col("x"), F.lit(600))).alias("y")).select("k", F.col("y.start").alias("s"), F.col("y.end").alias("e"), F.col("y.covered").alias("c"))


# Pairs and order -----------------------------------------------------------------------------------


@query("SELECT name, CAST(sum(n) OVER (PARTITION BY descr ORDER BY ord) AS BIGINT) AS group_no FROM (SELECT *, CASE WHEN k = lag(k) OVER (PARTITION BY descr ORDER BY ord) THEN 0 ELSE 1 END AS n FROM (SELECT *, len % 3 AS k FROM reads))")
def jon_group_adjacent(reads):
    return pairs.group_adjacent(reads.withColumn("k", F.col("len") % 3), "k", ["descr"]).select("name", "group_no")


@query("SELECT name, CASE count(*) OVER (PARTITION BY len) WHEN 2 THEN 'pair' WHEN 1 THEN 'orphan' ELSE 'discarded' END AS route FROM reads")
def jon_match_pairs(reads):
    return pairs.match_pairs(reads, "len").select("name", "route")


@query("SELECT name, row_number() OVER (PARTITION BY direction ORDER BY ord) - 1 AS n, CASE WHEN direction = 'fwd' THEN 0 ELSE 1 END AS side FROM reads")
def jon_interleave(reads):
    both = pairs.interleave(reads.where("direction = 'fwd'"), reads.where("direction = 'rev'"))
    return both.select("name", "n", "side")


@query("SELECT name, 0 AS file FROM (SELECT name, row_number() OVER (ORDER BY ord) AS n FROM reads) WHERE n % 2 = 1 UNION ALL SELECT name, 1 FROM (SELECT name, row_number() OVER (ORDER BY ord) AS n FROM reads) WHERE n % 2 = 0")
def jon_deinterleave(reads):
    one, two = pairs.deinterleave(reads)
    return order.concatenate(one, two).select("name", "file")


@query("SELECT name, ord = min(ord) OVER (PARTITION BY seq) AS is_first FROM reads")
def ord_duplicates(reads):
    return order.duplicates(reads).select("name", "is_first")


@query("SELECT name, ord = min(ord) OVER (PARTITION BY substr(seq, 1, 30)) AS is_first FROM reads")
def ord_duplicates_by_start(reads):
    return order.duplicates(reads, length=30).select("name", "is_first")


@query("WITH p AS (SELECT pair, string_agg(seq, chr(9) ORDER BY ord) AS s FROM reads GROUP BY pair) SELECT r.name, r.pair = min(r.pair) OVER (PARTITION BY s) AS is_first FROM reads r JOIN p USING (pair)")
def ord_duplicate_pairs(reads):
    return order.duplicates(reads, pair="pair").select("name", "is_first")


@query("SELECT name, descr FROM (SELECT *, lag(descr) OVER (PARTITION BY direction ORDER BY ord) AS b FROM reads) WHERE b IS NULL OR b <> descr")
def ord_unique_adjacent(reads):
    return order.unique_adjacent(reads, "descr", ["direction"]).select("name", "descr")


@query("SELECT name, seq FROM reads ORDER BY ord LIMIT 10")
def ord_head(reads):
    return order.head(reads, 10).select("name", "seq")


@query("SELECT name FROM reads ORDER BY md5(name || '|42'), name LIMIT 50")
def ord_sample(reads):
    return order.sample(reads, 50).select("name")


@query("SELECT name, len FROM reads ORDER BY len DESC, name LIMIT 25")
def ord_best_items(reads):
    return order.best_items(reads, 25, F.desc("len"), F.col("name")).select("name", "len")


@query("SELECT name, row_number() OVER (ORDER BY seq, ord) AS n FROM reads")
def ord_sort_by_seq(reads):
    by_seq = reads.select("name", "seq", "ord")
    numbered = pairs.index_rows(by_seq.withColumn("ord", F.struct("seq", "ord")))
    return numbered.select("name", (F.col("n") + 1).alias("n"))


@query("SELECT concat_ws('&', CASE WHEN len > 1000 THEN 'long_' END, CASE WHEN descr = 'en' THEN 'english' END, CASE WHEN ord % 3 = 0 THEN 'third' END) AS region, count(*) AS n FROM reads GROUP BY 1")
def ord_filter_regions(reads):
    flags = {"long_": F.col("len") > 1000, "english": F.col("descr") == "en", "third": F.col("ord") % 3 == 0}
    return order.filter_regions(reads.withColumns(flags), list(flags))


@query("SELECT count(*) AS n_reads, CAST(sum(len) AS BIGINT) AS n_bases FROM reads")
def agg_count_seqs(reads):
    return reads.agg(F.count("*").alias("n_reads"), F.sum("len").alias("n_bases"))


@query("SELECT name, lead(name) OVER (PARTITION BY descr ORDER BY ord) AS following FROM reads")
def ord_pairwise(reads):
    return order.pairwise(reads.select("name", "descr", "ord"), "name", ["descr"]).select("name", "following")


# Statistics ----------------------------------------------------------------------------------------


@query("SELECT descr, min(len) AS min, max(len) AS max, count(*) AS count, CAST(sum(len) AS BIGINT) AS sum, round(avg(len), 6) AS average, round(var_pop(len), 3) AS variance FROM reads GROUP BY descr")
def agg_moments(reads):
    m = stats.moments(stats.counter(reads, F.col("len"), "descr"), "descr")
    return m.withColumns({"average": F.round("average", 6), "variance": F.round("variance", 3)})


_QUART = """WITH s AS (SELECT descr, list_sort(list(len)) AS v, count(*) AS n FROM reads GROUP BY descr),
q AS (SELECT descr, n AS count,
 CASE WHEN n < 4 THEN NULL WHEN (n + 1) % 4 = 0 THEN CAST(v[(n + 1) // 4] AS DOUBLE) ELSE (v[(n + 1) // 4] + v[(n + 1) // 4 + 1]) / 2.0 END AS q1,
 CASE WHEN n % 2 = 1 THEN CAST(v[n // 2 + 1] AS DOUBLE) ELSE (v[n // 2] + v[n // 2 + 1]) / 2.0 END AS median,
 CASE WHEN n < 4 THEN NULL WHEN (n + 1) * 3 % 4 = 0 THEN CAST(v[(n + 1) * 3 // 4] AS DOUBLE) ELSE (v[(n + 1) * 3 // 4] + v[(n + 1) * 3 // 4 + 1]) / 2.0 END AS q3 FROM s)"""


@query(_QUART + " SELECT * FROM q")
def agg_quartiles(reads):
    return stats.quartiles(stats.counter(reads, F.col("len"), "descr"), "descr")


@query(_QUART + " SELECT *, q3 - q1 AS iqr, CAST(trunc(q1 - round(1.5 * (q3 - q1))) AS BIGINT) AS low, CAST(trunc(q3 + round(1.5 * (q3 - q1))) AS BIGINT) AS high FROM q")
def agg_outlier_limits(reads):
    return stats.outlier_limits(stats.quartiles(stats.counter(reads, F.col("len"), "descr"), "descr"))


@query(
    """WITH e AS (SELECT min(len) AS lo, max(len) AS hi, CAST(ceil((max(len) - min(len)) / 25.0) AS BIGINT) AS w FROM reads),
b AS (SELECT unnest(range(0, 25)) AS bin), p AS (SELECT least((len - lo) // w, 24) AS bin, count(*) AS n FROM reads, e GROUP BY 1)
SELECT bin, lo + bin * w AS low, lo + (bin + 1) * w AS high, coalesce(n, 0) AS n FROM b CROSS JOIN e LEFT JOIN p USING (bin)"""
)
def agg_histogram(reads):
    return stats.histogram(stats.counter(reads, F.col("len")), bins=25)


@query("WITH a AS (SELECT len, sum(len) OVER (ORDER BY len DESC RANGE UNBOUNDED PRECEDING) AS upto, sum(len) OVER () AS total FROM reads) SELECT max(len) AS n50 FROM a WHERE upto >= floor(total * 50 / 100)")
def agg_n50(reads):
    return stats.nx(stats.counter(reads, F.col("len")), 50)


@query("SELECT kmer, count(*) AS n FROM (SELECT substr(seq, i, 4) AS kmer FROM (SELECT seq, unnest(range(1, length(seq) - 2)) AS i FROM reads)) GROUP BY kmer")
def agg_kmers(reads):
    return stats.kmer_counts(reads, 4)


@query("SELECT i AS pos, CASE WHEN upper(substr(seq, i + 1, 1)) IN ('A', 'C', 'G', 'T') THEN upper(substr(seq, i + 1, 1)) ELSE 'N' END AS base, count(*) AS n FROM (SELECT seq, CAST(unnest(range(0, least(length(seq), 41))) AS INT) AS i FROM reads) GROUP BY ALL")
def agg_base_frequencies(reads):
    return stats.base_frequencies(reads)


_QS = "SELECT name, descr, ascii(substr(qual, i, 1)) - 33 AS q, CAST(i - 1 AS INT) AS pos FROM (SELECT name, descr, qual, unnest(range(1, length(qual) + 1)) AS i FROM reads)"


@query(f"SELECT pos, q AS value, count(*) AS n FROM ({_QS}) GROUP BY ALL")
def agg_quality_by_position(reads):
    return stats.quality_by_position(reads)


@query(f"SELECT count(*) AS bases, CAST(count_if(q >= 20) AS BIGINT) AS q20, CAST(count_if(q >= 30) AS BIGINT) AS q30, round(count_if(q >= 20) / CAST(count(*) AS DOUBLE), 6) AS share20, round(count_if(q >= 30) / CAST(count(*) AS DOUBLE), 6) AS share30 FROM ({_QS})")
def agg_quality_shares(reads):
    return stats.quality_shares(reads).withColumns({k: F.round(k, 6) for k in ("share20", "share30")})


@query(
    """WITH c AS (SELECT name, i, upper(substr(seq, len - i, 1)) AS b FROM (SELECT name, seq, len, unnest(range(0, len)) AS i FROM reads)),
k AS (SELECT name, i, b, CASE WHEN b NOT IN ('A', 'N') THEN 1 ELSE 0 END AS bad FROM c),
s AS (SELECT *, sum(bad) OVER (PARTITION BY name ORDER BY i) AS nb, max(CASE WHEN bad = 0 AND b = 'A' THEN i END) OVER (PARTITION BY name ORDER BY i) AS la FROM k),
t AS (SELECT name, min(i) AS stop FROM (SELECT *, sum(bad) OVER (PARTITION BY name, la ORDER BY i) AS run FROM s) WHERE run > 1 GROUP BY name),
z AS (SELECT s.name, s.i, sum(CASE WHEN b = 'A' THEN 1 ELSE 0 END) OVER (PARTITION BY s.name, nb ORDER BY s.i) AS poly FROM s LEFT JOIN t ON s.name = t.name WHERE stop IS NULL OR s.i < stop)
SELECT r.name, CAST(coalesce(x.tail, 0) AS INT) AS tail FROM reads r LEFT JOIN (SELECT name, max(i) + 1 AS tail FROM z WHERE poly >= 5 GROUP BY name) x USING (name)"""
)
def prj_polya_tail(reads):
    return reads.select("name", R.polya_tail(F.col("seq")).alias("tail"))


@query("SELECT name, CAST(list_sum(w) AS INT) AS s, i AS start FROM (SELECT name, i, list_transform(range(i + 1, i + 11), lambda j: ascii(substr(qual, j, 1)) - 33) AS w FROM (SELECT name, qual, CAST(unnest(range(0, len - 9, 5)) AS INT) AS i FROM reads WHERE len >= 10))")
def win_rolling(reads):
    w = R.rolling(R.decode_quality(F.col("qual")), 10, 5)
    return reads.select("name", F.posexplode(w).alias("k", "w")).select("name", F.aggregate("w", F.lit(0), lambda a, x: a + x).alias("s"), (F.col("k") * 5).alias("start"))


@query("SELECT '@' || name || ' ' || descr || chr(10) || seq || chr(10) || '+' || chr(10) || qual AS record FROM reads")
def snk_fastq_records(reads):
    from ..sources.fastx import format_records

    return reads.select(format_records("fastq").alias("record"))


@query("SELECT '>' || name || ' ' || descr || chr(10) || seq AS record FROM reads WHERE length(seq) > 0")
def snk_fasta_records(reads):
    from ..sources.fastx import format_records

    return reads.where("length(seq) > 0").select(format_records("fasta").alias("record"))
