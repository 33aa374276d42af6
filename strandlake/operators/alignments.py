"""Aligned reads: filters, counts, coverage, coordinates and mates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.reads import FLAG_BITS, has_flag
from .stats import quartiles

MAPQS = (0, 20, 30, 40)


def mapped() -> Column:
    return ~has_flag(F.col("flag"), "is_unmapped") & F.col("ref").isNotNull()


def filter_alignments(df: DataFrame, min_mapq: int = 0, required: int = 0, forbidden: int = 0, regions: list[tuple] | None = None) -> DataFrame:
    flag = F.col("flag")
    df = df.where((F.col("mapq") >= min_mapq) & (flag.bitwiseAND(F.lit(required)) == required) & (flag.bitwiseAND(F.lit(forbidden)) == 0))
    if regions is None:
        return df
    inside = [(F.col("ref") == r) & F.col("pos").between(s, e - 1) for r, s, e in regions]
    return df.where(reduce(lambda a, b: a | b, inside, F.lit(False)))


def cigar_ops(cigar: Column) -> Column:
    """(n, op) in order."""
    parts = F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"(\d+)", 1).cast("int").alias("n"), F.substring(p, -1, 1).alias("op")))


def blocks(pos: Column, cigar: Column) -> Column:
    """Aligned blocks as (ref_start, ref_end, read_start, read_end), 0-based and inclusive."""
    kind = "array<struct<ref_start:bigint,ref_end:bigint,read_start:bigint,read_end:bigint>>"
    zero = F.lit(0).cast("bigint")
    start = F.struct(pos.cast("bigint").alias("r"), zero.alias("q"), F.array().cast(kind).alias("out"))

    def step(a, c):
        both, ref, read = c["op"].isin("M", "=", "X"), c["op"].isin("D", "N"), c["op"].isin("I", "S")
        block = F.struct(a["r"].alias("ref_start"), (a["r"] + c["n"] - 1).alias("ref_end"), a["q"].alias("read_start"), (a["q"] + c["n"] - 1).alias("read_end"))
        return F.struct(
            F.when(both | ref, a["r"] + c["n"]).otherwise(a["r"]).alias("r"), F.when(both | read, a["q"] + c["n"]).otherwise(a["q"]).alias("q"),
            F.when(both, F.concat(a["out"], F.array(block))).otherwise(a["out"]).alias("out"),
        )

    return F.aggregate(cigar_ops(cigar), start, step)["out"]


def read_position(found: Column, ref_pos: Column) -> Column:
    """Place in the read of a reference position; null in a gap."""
    hit = F.get(F.filter(found, lambda b: ref_pos.between(b["ref_start"], b["ref_end"])), 0)
    return hit["read_start"] + ref_pos - hit["ref_start"]


def read_length(cigar: Column) -> Column:
    return F.aggregate(cigar_ops(cigar), F.lit(0), lambda a, c: a + F.when(c["op"].isin("M", "=", "X", "I", "S"), c["n"]).otherwise(0))


def reference_counts(df: DataFrame, refs: DataFrame) -> DataFrame:
    """Reads per reference, references without reads too."""
    counts = df.where(mapped()).groupBy("ref").agg(F.count("*").alias("reads"))
    return refs.join(counts, "ref", "left").withColumn("reads", F.coalesce("reads", F.lit(0)))


def rpkm(df: DataFrame, refs: DataFrame) -> DataFrame:
    """Reads per kilobase of reference and million of all reads."""
    total = df.agg(F.count("*").alias("total"))
    got = reference_counts(df, refs).crossJoin(F.broadcast(total))
    return got.withColumn("rpkm", F.col("reads") / (F.col("length") / 1000.0) / (F.col("total") / 1e6)).drop("total")


def flag_counts(df: DataFrame) -> DataFrame:
    bits = F.array(*[F.when(has_flag(F.col("flag"), b), F.lit(b)) for b in FLAG_BITS])
    return df.select(F.explode(F.array_compact(bits)).alias("bit")).groupBy("bit").agg(F.count("*").alias("n"))


def depth_runs(df: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Runs of neighbouring positions with equal depths: ref, start, end (not in it), depth (above 0), and the
    depths of the reads with mapq above each threshold.

    A block's ends are events that change the depths.  They are summed by position; bins of width positions
    add theirs up, a running sum over a reference's bins gives the depths at which a bin begins, and one
    within the bin those of its runs.  What is moved grows with the blocks and not with their bases, and
    a task holds the events of one bin.
    """
    kinds = ["depth", *[f"over{q}" for q in MAPQS]]
    counted = [F.lit(True), *[F.col("mapq") > q for q in MAPQS]]
    rows = df.where(mapped()).select(
        "ref", F.explode(blocks(F.col("pos"), F.col("cigar"))).alias("b"), *[F.coalesce(c, F.lit(False)).cast("long").alias(k) for k, c in zip(kinds, counted)]
    )
    ends = F.explode(F.array(F.struct(F.col("b.ref_start").alias("pos"), F.lit(1).alias("by")), F.struct((F.col("b.ref_end") + 1).alias("pos"), F.lit(-1).alias("by"))))
    events = rows.select("ref", ends.alias("e"), *kinds).groupBy("ref", F.col("e.pos").alias("pos")).agg(*[F.sum(F.col("e.by") * F.col(k)).alias(k) for k in kinds])
    events = events.withColumn("bin", F.floor(F.col("pos") / width))
    bins = events.groupBy("ref", "bin").agg(F.min("pos").alias("first"), *[F.sum(k).alias(f"in_{k}") for k in kinds])
    along = Window.partitionBy("ref").orderBy("bin")
    before = [F.coalesce(F.sum(f"in_{k}").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"at_{k}") for k in kinds]
    bins = bins.select("ref", "bin", F.lead("first").over(along).alias("following"), *before)
    within = Window.partitionBy("ref", "bin").orderBy("pos")
    found = events.withColumn("end", F.lead("pos").over(within)).withColumns({k: F.sum(k).over(within) for k in kinds}).join(bins, ["ref", "bin"])
    found = found.select("ref", F.col("pos").alias("start"), F.coalesce("end", "following").alias("end"), *[(F.col(k) + F.col(f"at_{k}")).alias(k) for k in kinds])
    return found.where("depth > 0")


def _bases() -> Column:
    return F.sum(F.col("end") - F.col("start")).alias("n")


def coverage_distribution(df: DataFrame) -> DataFrame:
    """(depth, n): how many positions that a read covers have each depth."""
    return depth_runs(df).groupBy("depth").agg(_bases())


def coverage_by_mapq(df: DataFrame) -> DataFrame:
    """(mapq, depth, n), mapq strictly greater."""
    each = F.explode(F.array(*[F.struct(F.lit(q).alias("mapq"), F.col(f"over{q}").alias("depth")) for q in MAPQS]))
    return depth_runs(df).select("start", "end", each.alias("x")).groupBy("x.mapq", "x.depth").agg(_bases())


def genome_coverage(df: DataFrame, refs: DataFrame) -> DataFrame:
    """Distribution over all positions of the references, those with depth 0 too."""
    covered = coverage_distribution(df)
    bases = refs.agg(F.sum("length").alias("total")).crossJoin(covered.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("have")))
    return covered.unionByName(bases.select(F.lit(0).cast("long").alias("depth"), (F.col("total") - F.col("have")).alias("n")))


def dense_counts(counts: DataFrame, value: str) -> DataFrame:
    """Every value from the least to the largest, with 0 for those that do not occur."""
    span = counts.agg(F.min(value).alias("a"), F.max(value).alias("b"))
    every = span.select(F.explode(F.sequence("a", "b")).alias(value))
    return every.join(counts, value, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def by_read_group(df: DataFrame, min_mapq: int) -> DataFrame:
    return df.groupBy(F.coalesce("rg", F.lit("unknown")).alias("rg")).agg(
        F.count_if(mapped()).alias("mapped"), F.count_if(~mapped()).alias("unmapped"), F.count_if(F.col("mapq") >= min_mapq).alias("over")
    )


def mate_pairs(df: DataFrame) -> DataFrame:
    """The first mapped alignment of mate 1 with every mapped alignment of mate 2 of its template."""
    end = F.aggregate(cigar_ops(F.col("cigar")), F.lit(0), lambda a, c: a + F.when(c["op"].isin("M", "=", "X", "D", "N"), c["n"]).otherwise(0))
    rows = df.where(mapped()).withColumns({"end": F.col("pos") + end - 1, "rev": has_flag(F.col("flag"), "strand")})
    first = rows.where(has_flag(F.col("flag"), "is_first_in_pair")).groupBy("qname").agg(F.min(F.struct("ord", "ref", "pos", "end", "rev")).alias("a"))
    second = rows.where(has_flag(F.col("flag"), "is_second_in_pair")).select("qname", F.struct("ref", "pos", "end", "rev").alias("b"))
    return first.join(second, "qname")


def pair_kind() -> Column:
    """innie, outie or other, of two mates a and b on one reference."""
    left_first = F.col("a.pos") <= F.col("b.pos")
    left, right = F.when(left_first, F.col("a.rev")).otherwise(F.col("b.rev")), F.when(left_first, F.col("b.rev")).otherwise(F.col("a.rev"))
    return F.when(~left & right, "innie").when(left & ~right, "outie").otherwise("other")


def pair_distance() -> Column:
    return F.greatest("a.end", "b.end") - F.least("a.pos", "b.pos") + 1


def pair_distances(df: DataFrame) -> DataFrame:
    """(kind, distance, n) of mates on one reference."""
    same = mate_pairs(df).where("a.ref = b.ref")
    return same.groupBy(pair_kind().alias("kind"), pair_distance().alias("distance")).agg(F.count("*").alias("n"))


def classify_mates(df: DataFrame, outie_range: tuple[int, int] = (2000, 8000), max_innie: int = 750) -> DataFrame:
    """non_chimeric for some outie pair within the range; chimera for a close innie pair; else unknown."""
    pairs = mate_pairs(df)
    same = F.col("a.ref") == F.col("b.ref")
    outie = same & (pair_kind() == "outie") & pair_distance().between(*outie_range)
    innie = same & (pair_kind() == "innie") & (pair_distance() < max_innie)
    found = pairs.groupBy("qname").agg(F.bool_or(outie).alias("o"), F.bool_or(innie).alias("i"))
    found = found.select("qname", F.when(F.col("o"), "non_chimeric").when(F.col("i"), "chimera").otherwise("unknown").alias("kind"))
    return df.select("qname").distinct().join(found, "qname", "left").withColumn("kind", F.coalesce("kind", F.lit("unknown")))


def _reads_over_sites(reads: DataFrame, sites: DataFrame, of_reads: list[str], of_sites: list[str]) -> DataFrame:
    """The given columns of each read (ref, pos, cigar, flipped, ..) and each site (ref, pos, ..) that it lies over, and
    the site's place in the read from its 5' end and from its 3' end.  Blocks and sites meet by an equi-join on bins
    as wide as a read."""
    width = 64
    rows = reads.select(*of_reads, "flipped", "ref", read_length(F.col("cigar")).alias("__n"), F.explode(blocks(F.col("pos"), F.col("cigar"))).alias("b"))
    rows = rows.withColumn("bin", F.explode(F.sequence(F.floor(F.col("b.ref_start") / width), F.floor(F.col("b.ref_end") / width))))
    at = sites.select(*of_sites, "ref", "pos", F.floor(F.col("pos") / width).alias("bin"))
    both = rows.join(at, ["ref", "bin"]).where(F.col("pos").between(F.col("b.ref_start"), F.col("b.ref_end")))
    place = F.col("b.read_start") + F.col("pos") - F.col("b.ref_start")
    from5 = F.when(F.col("flipped"), F.col("__n") - 1 - place).otherwise(place)
    return both.select(*of_sites, *of_reads, from5.alias("from5"), (F.col("__n") - 1 - from5).alias("from3"))


def site_read_positions(df: DataFrame, sites: DataFrame) -> DataFrame:
    """Each site with each read over it: ord (of the site), qname, rg, mapq, place in the read from its 5' end
    and from its 3' end."""
    reads = df.where(mapped()).withColumn("flipped", has_flag(F.col("flag"), "strand"))
    return _reads_over_sites(reads, sites.withColumn("ref", F.col("chrom")), ["qname", "rg", "mapq"], ["ord"])


def site_position_stats(df: DataFrame, sites: DataFrame, max_pos: int | None = None) -> DataFrame:
    """Where in the reads of each read group sites lie, and the sites' qualities there: rg (null: none), side (5 or 3),
    place (from 1 at that end, up to max_pos), reads, and the count, q1, median and q3 of the qualities.

    Reads that lie alike, and sites of one place and quality, are counted before they meet, so what meets grows with
    the places that are covered and not with reads times sites at a place."""
    reads = df.where(mapped()).groupBy("rg", "ref", "pos", "cigar", has_flag(F.col("flag"), "strand").alias("flipped")).agg(F.count("*").alias("n_reads"))
    at = sites.groupBy(F.col("chrom").alias("ref"), "pos", "qual").agg(F.count("*").alias("n_sites"))
    found = _reads_over_sites(reads, at, ["rg", "n_reads"], ["qual", "n_sites"])
    found = found.groupBy("rg", "qual", "from5", "from3").agg(F.sum(F.col("n_reads") * F.col("n_sites")).alias("n"))
    ends = F.explode(F.array(F.struct(F.lit(5).alias("side"), (F.col("from5") + 1).alias("place")), F.struct(F.lit(3).alias("side"), (F.col("from3") + 1).alias("place"))))
    rows = found.select("rg", "qual", "n", ends.alias("e")).select("rg", "qual", "n", "e.*")
    rows = rows if max_pos is None else rows.where(F.col("place") <= max_pos)
    keys = ["rg", "side", "place"]
    counts = rows.groupBy(*keys, F.col("qual").alias("value")).agg(F.sum("n").alias("n"))
    reads = counts.groupBy(*keys).agg(F.sum("n").alias("reads"))
    boxes = quartiles(counts.where("value IS NOT NULL"), *keys)
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = reads.alias("a").join(boxes.alias("b"), same, "left")
    return both.select(*[F.col(f"a.{k}").alias(k) for k in keys], "reads", F.coalesce("count", F.lit(0)).alias("count"), "q1", "median", "q3")
