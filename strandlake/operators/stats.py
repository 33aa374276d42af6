"""Statistics of counted values, read lengths, qualities, base content and complexity."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.reads import dust_score
from ..functions.vectors import count_kmers, count_places

MIN_BINS, MAX_BINS, VALUES_PER_BIN = 20, 500, 10000


def counter(df: DataFrame, value: Column, *by: str) -> DataFrame:
    """(value, n): how often each value occurs, by the given columns."""
    return df.groupBy(*by, value.alias("value")).agg(F.count("*").alias("n"))


def merge_counters(*counters: DataFrame) -> DataFrame:
    out = counters[0]
    for c in counters[1:]:
        out = out.unionByName(c)
    return out.groupBy("value").agg(F.sum("n").alias("n"))


def at_rank(by: list[str]) -> tuple:
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return w, w.orderBy("value")


def quartiles(counts: DataFrame, *by: str) -> DataFrame:
    """q1, median, q3 of counters; null below four values.

    q1 is value (n + 1) / 4, q3 value 3 (n + 1) / 4 (1-based); where that is no whole number the mean of
    the two neighbours.
    """
    w, ordered = at_rank(list(by))
    c = counts.withColumns({"__upto": F.sum("n").over(ordered), "__all": F.sum("n").over(w)})

    def value(rank: Column) -> Column:
        return F.min(F.when(F.col("__upto") > rank, F.col("value")))

    n = F.col("__all")
    one = F.floor((n + 1) / 4)
    three = F.floor((n + 1) * 3 / 4)
    half = F.floor(n / 2)
    got = c.groupBy(*by).agg(
        F.max("__all").alias("count"),
        value(one - 1).alias("a1"), value(one).alias("b1"), value(three - 1).alias("a3"), value(three).alias("b3"),
        value(half - 1).alias("am"), value(half).alias("bm"),
    )
    n = F.col("count")
    mean = lambda a, b: (F.col(a) + F.col(b)) / 2
    enough = lambda x: F.when(n >= 4, x)
    return got.select(
        *by,
        "count",
        enough(F.when((n + 1) % 4 == 0, F.col("a1").cast("double")).otherwise(mean("a1", "b1"))).alias("q1"),
        F.when(n % 2 == 1, F.col("bm").cast("double")).otherwise(mean("am", "bm")).alias("median"),
        enough(F.when((n + 1) * 3 % 4 == 0, F.col("a3").cast("double")).otherwise(mean("a3", "b3"))).alias("q3"),
    )


def outlier_limits(q: DataFrame) -> DataFrame:
    """iqr and the limits 1.5 of it, rounded, outside the quartiles, cut to whole numbers."""
    iqr = F.col("q3") - F.col("q1")
    away = F.round(1.5 * iqr)
    return q.withColumns({"iqr": iqr, "low": (F.col("q1") - away).cast("long"), "high": (F.col("q3") + away).cast("long")})


def moments(counts: DataFrame, *by: str) -> DataFrame:
    """min, max, count, sum, average and population variance of counters."""
    v, n = F.col("value"), F.col("n")
    total, s, s2 = F.sum("n"), F.sum(v * n), F.sum(v.cast("double") * v * n)
    return counts.groupBy(*by).agg(
        F.min("value").alias("min"), F.max("value").alias("max"), total.alias("count"), s.alias("sum"),
        (s / total).alias("average"), (s2 / total - (s / total) * (s / total)).alias("variance"),
    )


def histogram(counts: DataFrame, bins: int | None = None, outlier: int | None = None) -> DataFrame:
    """bin, low, high, n over (value, n): integer bin spans, the last bin closed.

    Without bins, one per value up to 20 values, else a bin for 10,000 items within 20 to 500.  outlier
    cuts so many per cent of the items on either side off the range.
    """
    w = Window.partitionBy(F.lit(0))
    c = counts.withColumns({"__upto": F.sum("n").over(w.orderBy("value")), "__all": F.sum("n").over(w)})
    left = F.floor(F.col("__all") * (outlier or 0) / 100)
    low = F.min(F.when(F.col("__upto") > left, F.col("value"))) if outlier else F.min("value")
    high = F.min(F.when(F.col("__upto") > F.col("__all") - left, F.col("value"))) if outlier else F.max("value")
    edges = c.agg(low.alias("lo"), F.coalesce(high, F.max("value")).alias("hi"), F.max("__all").alias("all"))
    span = F.col("hi") - F.col("lo")
    if bins is None:
        wanted = F.least(F.greatest(F.floor(F.col("all") / VALUES_PER_BIN), F.lit(MIN_BINS)), F.lit(MAX_BINS), span)
        n_bins = F.when(span == 0, 1).when(span < MIN_BINS, span).otherwise(wanted)
    else:
        n_bins = F.lit(bins)
    edges = edges.withColumn("bins", n_bins.cast("long"))
    width = F.ceil(F.when(span == 0, 1).otherwise(span) / F.col("bins")).cast("long")
    edges = edges.withColumn("width", width)
    every = edges.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("bin"))
    placed = counts.crossJoin(F.broadcast(edges)).where("value BETWEEN lo AND least(hi, lo + bins * width)")
    placed = placed.groupBy(F.least(F.floor((F.col("value") - F.col("lo")) / F.col("width")), F.col("bins") - 1).alias("bin")).agg(F.sum("n").alias("n"))
    return every.join(placed, "bin", "left").select(
        "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def nx(lengths: DataFrame, percent: int) -> DataFrame:
    """The length such that sequences of at least it hold percent of all bases; lengths is (value, n)."""
    w = Window.partitionBy(F.lit(0))
    c = lengths.withColumns({"__t": F.sum(F.col("value") * F.col("n")).over(w), "__a": F.sum(F.col("value") * F.col("n")).over(w.orderBy(F.desc("value")))})
    return c.where(F.col("__a") >= F.floor(F.col("__t") * percent / 100)).agg(F.max("value").alias(f"n{percent}"))


def kmer_counts(df: DataFrame, k: int) -> DataFrame:
    """(kmer, n), case kept; each batch of reads is counted before anything is moved."""

    def run(batches):
        for batch in batches:
            found, times = count_kmers(batch.column(0), k)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(times.astype(np.int64))], ["kmer", "n"])

    return df.select("seq").mapInArrow(run, "kmer string, n long").groupBy("kmer").agg(F.sum("n").alias("n"))


def base_frequencies(df: DataFrame, positions: int | None = 41) -> DataFrame:
    """pos, base, n: bases by position, the first positions of each read; all but A, C, G, T count as N."""
    text = F.substring("seq", 1, positions) if positions else F.col("seq")
    chars = F.filter(F.split(F.upper(text), ""), lambda c: c != "")
    base = F.when(F.col("c").isin("A", "C", "G", "T"), F.col("c")).otherwise("N")
    return df.select(F.posexplode(chars).alias("pos", "c")).groupBy("pos", base.alias("base")).agg(F.count("*").alias("n"))


def quality_by_position(df: DataFrame, offset: int = 33) -> DataFrame:
    """(pos, value, n): the counters behind the per-position box plot of qualities."""

    def run(batches):
        for batch in batches:
            pos, value, times = count_places(batch.column(0), offset)
            rows = [pa.array(pos.astype(np.int32)), pa.array(value.astype(np.int32)), pa.array(times.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(rows, ["pos", "value", "n"])

    return df.select("qual").mapInArrow(run, "pos int, value int, n long").groupBy("pos", "value").agg(F.sum("n").alias("n"))


def quality_shares(df: DataFrame, offset: int = 33) -> DataFrame:
    """Bases, those of at least Q20 and Q30, and their shares, over all reads."""
    q = quality_by_position(df, offset)
    bases = F.coalesce(F.sum("n"), F.lit(0))
    over = lambda t: F.coalesce(F.sum(F.when(F.col("value") >= t, F.col("n"))), F.lit(0))
    share = lambda t: over(t) / F.when(bases > 0, bases)
    return q.agg(bases.alias("bases"), over(20).alias("q20"), over(30).alias("q30"), share(20).alias("share20"), share(30).alias("share30"))


def array_stats(df: DataFrame, value: str, bins: int = 80) -> DataFrame:
    """Equal-width histogram of doubles, the last bin closed: bin, low, n."""
    edges = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1)))
    return df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(edges)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def ascii_histogram(bins: list[tuple[int, int, int]], width: int = 100) -> str:
    """Lines of low, high and a bar; for the few rows of a collected histogram."""
    most = max((n for *_, n in bins), default=0)
    digits = max((len(str(x)) for b in bins for x in b[:2]), default=1)
    rows = [f"[{low:>{digits}} , {high:>{digits}}) ({n}): {'*' * (n * width // most if most else 0)}" for low, high, n in bins]
    return "\n".join(rows)


def sequence_counters(df: DataFrame, kmer: int | None = 3, offset: int = 33) -> DataFrame:
    """All counters of a report on reads (seq, qual) in one pass and one shuffle: section, pos, value, text, n.

    length has value; quality has pos and value; base has pos and text (A, C, G, T, else N); kmer has text;
    dust has value, the whole part of the reads' scores.  Each batch is counted before anything is moved.
    Null and empty reads count as reads of no bases.
    """

    def run(batches):
        for batch in batches:
            sizes, times = np.unique(batch.column(2).to_numpy(zero_copy_only=False), return_counts=True)
            parts = [("length", None, sizes, None, times)]
            pos, value, times = count_places(batch.column(1), offset)
            parts.append(("quality", pos, value, None, times))
            pos, code, times = count_places(batch.column(0), 0)
            upper = np.where((code >= 97) & (code <= 122), code - 32, code)
            known = np.where(np.isin(upper, np.frombuffer(b"ACGT", np.uint8)), upper, ord("N"))
            place, at = np.unique(pos << 8 | known, return_inverse=True)
            parts.append(("base", place >> 8, None, [chr(x) for x in (place & 255).tolist()], np.bincount(at, times, len(place)).astype(np.int64)))
            if kmer:
                texts, times = count_kmers(batch.column(0), kmer)
                parts.append(("kmer", None, None, texts, times))
            score = batch.column(3).drop_null().to_numpy(zero_copy_only=False)
            scores, times = np.unique(score, return_counts=True)
            parts.append(("dust", None, scores, None, times))
            for section, pos, value, text, n in parts:
                size = len(n)
                column = lambda x, kind: pa.nulls(size, kind) if x is None else pa.array(x, kind)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([section] * size, pa.string()), column(pos, pa.int64()), column(value, pa.int64()), column(text, pa.string()), pa.array(n, pa.int64())],
                    ["section", "pos", "value", "text", "n"],
                )

    read = df.select(F.coalesce("seq", F.lit("")).alias("seq"), F.coalesce("qual", F.lit("")).alias("qual")).select(
        "seq", "qual", F.length("seq").cast("long").alias("size"), F.floor(F.round(dust_score(F.col("seq")), 6)).cast("long").alias("dust")
    )
    found = read.mapInArrow(run, "section string, pos long, value long, text string, n long")
    # A condition on the aggregate's own section stays above the shuffle, so all parts of a report share it.
    totals = found.groupBy(F.col("section").alias("__s"), "pos", "value", "text").agg(F.max("section").alias("section"), F.sum("n").alias("n"))
    return totals.select("section", "pos", "value", "text", "n")


def _metrics(row: DataFrame, section: str, *keys: str) -> DataFrame:
    """A row's (or, with keys, each row's) numbers as rows: section, metric, pos, text, value."""
    names = [c for c in row.columns if c not in keys]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names]))
    pos, text = (F.col(k) if k in keys else F.lit(None) for k in ("pos", "text"))
    return row.select(F.lit(section).alias("section"), pos.cast("long").alias("pos"), text.cast("string").alias("text"), pairs.alias("m")).select("section", "m.metric", "pos", "text", "m.value")


def sequence_report(counters: DataFrame, nxs: tuple[int, ...] = (50, 95), top: int = 20, low_complexity: int = 7) -> DataFrame:
    """The whole report on reads from sequence_counters: section, metric, pos, text, value.

    length: Nx and moments; quality: shares q20 and q30 in per cent and moments; quality_box: quartiles by
    pos; base: counts by pos and text; kmer: moments of the counts; kmer_top: the most common ones, ties by
    text; dust: the share above low_complexity and moments.  All parts read one shuffle's output.
    """
    of = lambda section, *columns: counters.where(F.col("section") == section).select(*columns)
    length, quality, dust = of("length", "value", "n"), of("quality", "pos", "value", "n"), of("dust", "value", "n")
    parts = [_metrics(nx(length, x), "length") for x in nxs] + [_metrics(moments(length), "length")]
    share = lambda t: (100 * F.sum(F.when(F.col("value") >= t, F.col("n")).otherwise(0)) / F.sum("n")).alias(f"q{t}")
    over = quality.groupBy("value").agg(F.sum("n").alias("n"))
    parts += [_metrics(over.agg(share(20), share(30)), "quality"), _metrics(moments(over), "quality")]
    parts.append(_metrics(quartiles(quality, "pos"), "quality_box", "pos"))
    parts.append(_metrics(of("base", "pos", "text", "n"), "base", "pos", "text"))
    kmers = of("kmer", "text", "n")
    parts.append(_metrics(moments(kmers.groupBy(F.col("n").alias("value")).agg(F.count("*").alias("n"))), "kmer"))
    parts.append(_metrics(kmers.orderBy(F.desc("n"), "text").limit(top), "kmer_top", "text"))
    above = (100 * F.sum(F.when(F.col("value") > low_complexity, F.col("n")).otherwise(0)) / F.sum("n")).alias("above")
    parts += [_metrics(dust.agg(above), "dust"), _metrics(moments(dust), "dust")]
    return reduce(lambda a, b: a.unionByName(b), parts)


def ascii_boxes(boxes: list[tuple], width: int = 60) -> str:
    """A line per (label, min, q1, median, q3, max): the range as dashes, the box as =, the median as |."""
    known = [b for b in boxes if b[1] is not None]
    low, high = min((b[1] for b in known), default=0), max((b[5] for b in known), default=0)
    scale = (width - 1) / (high - low) if high > low else 0
    size = max((len(str(b[0])) for b in boxes), default=1)
    lines = []
    for label, least, q1, median, q3, most in boxes:
        row = [" "] * width
        if least is not None:
            at = [round((x - low) * scale) if x is not None else None for x in (least, q1, median, q3, most)]
            row[at[0] : at[4] + 1] = "-" * (at[4] - at[0] + 1)
            if at[1] is not None and at[3] is not None:
                row[at[1] : at[3] + 1] = "=" * (at[3] - at[1] + 1)
            if at[2] is not None:
                row[at[2]] = "|"
        lines.append(f"{label:>{size}}: {''.join(row).rstrip()}")
    return "\n".join([f"axis from {low} to {high}", *lines])


def ascii_shares(counts: dict[int, dict[str, int]], letters: str = "ACTGN", width: int = 50) -> str:
    """A line per place: the shares of the letters as runs of each, in order of letters."""
    size, lines = max((len(str(p)) for p in counts), default=1), []
    for place in sorted(counts):
        total = sum(counts[place].values())
        ends = np.cumsum([counts[place].get(c, 0) for c in letters])
        cuts = [0, *[int(round(e * width / total)) if total else 0 for e in ends.tolist()]]
        lines.append(f"{place:>{size}}: " + "".join(c * (b - a) for c, a, b in zip(letters, cuts, cuts[1:])))
    return "\n".join(lines)


def report(df: DataFrame, offset: int = 33) -> DataFrame:
    """(metric, value) over reads: number, bases, N50, N95, mean quality and the shares of Q20 and Q30, in one pass."""
    counters = sequence_counters(df, None, offset)
    length = counters.where("section = 'length'").select("value", "n")
    quality = counters.where("section = 'quality'").groupBy("value").agg(F.sum("n").alias("n"))
    total = F.sum(F.col("value") * F.col("n"))
    basic = length.agg(F.sum("n").alias("reads"), total.alias("bases"), (total / F.sum("n")).alias("mean_length"))
    share = lambda t: (F.sum(F.when(F.col("value") >= t, F.col("n")).otherwise(0)) / F.sum("n")).alias(f"q{t}")
    scores = quality.agg((total / F.sum("n")).alias("mean_quality"), share(20), share(30))
    return reduce(lambda a, b: a.unionByName(b), [_metrics(x, "") for x in (basic, scores, nx(length, 50), nx(length, 95))]).select("metric", "value")
