"""Alignment hits: a row per match part, ordered by part_no within query and subject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .trim import merge_segments


def matches(hits: DataFrame) -> DataFrame:
    """A match per query and subject: bounds over its parts, scores of its first part."""
    low = lambda a, b: F.min(F.least(a, b))
    high = lambda a, b: F.max(F.greatest(a, b))
    first = lambda c: F.min_by(c, "part_no").alias(c)
    return hits.groupBy("query", "subject").agg(
        low("q_start", "q_end").alias("q_start"), high("q_start", "q_end").alias("q_end"),
        low("s_start", "s_end").alias("s_start"), high("s_start", "s_end").alias("s_end"),
        first("expect"), first("identity"), first("score"), F.count("*").alias("parts"),
    )


def score_threshold(hits: DataFrame, key: str, min_score: float | None = None, max_score: float | None = None) -> DataFrame:
    """Parts, then matches (by their first part left), over the threshold."""
    ok = F.lit(False)
    if min_score is not None:
        ok = ok | (F.col(key) >= min_score)
    if max_score is not None:
        ok = ok | (F.col(key) <= max_score)
    return hits.where(ok)


def best_scores(hits: DataFrame, key: str, log_tolerance: float, min_score: float | None = None, max_score: float | None = None) -> DataFrame:
    """Parts whose log10 score is near that of the query's best part.

    With max_score (lower is better) a score of 0 always passes and scores of at least max_score never
    do; with min_score those of at most min_score never do.  The logarithm of a best score of 0 is 0.
    """
    order = F.asc(key) if max_score is not None else F.desc(key)
    best = F.first(key).over(Window.partitionBy("query").orderBy(order))
    log_best = F.when(F.col("__best") == 0, 0.0).otherwise(F.log10("__best"))
    near = F.abs(F.log10(key) - log_best) < log_tolerance
    ok = F.coalesce(near, F.lit(False))
    if min_score is not None:
        ok = (F.col(key) > min_score) & ok
    if max_score is not None:
        ok = (F.col(key) == 0.0) | ((F.col(key) < max_score) & ok)
    return hits.withColumn("__best", best).where(ok).drop("__best")


def covered(hits: DataFrame, side: str = "q") -> DataFrame:
    """Merged segments that the parts of each match cover on the query (q) or subject (s)."""
    s = F.struct(F.least(f"{side}_start", f"{side}_end").alias("start"), F.greatest(f"{side}_start", f"{side}_end").alias("end"))
    return hits.groupBy("query", "subject").agg(merge_segments(F.collect_list(s)).alias("segments"))


def min_length(hits: DataFrame, residues: int | None = None, percent: float | None = None, side: str = "q") -> DataFrame:
    """Matches whose merged parts cover enough residues, or enough of the sequence."""
    lengths = covered(hits, side).withColumn("n", F.aggregate("segments", F.lit(0), lambda a, s: a + s["end"] - s["start"] + 1))
    whole = hits.groupBy("query", "subject").agg(F.max(f"{side}_len").alias("whole"))
    got = lengths.join(whole, ["query", "subject"])
    ok = F.col("n") >= residues if residues is not None else F.col("n") * 100.0 / F.col("whole") >= percent
    return hits.join(got.where(ok), ["query", "subject"], "left_semi")


def min_part_length(hits: DataFrame, residues: int, side: str = "q") -> DataFrame:
    """Parts by end - start."""
    return hits.where(F.abs(F.col(f"{side}_end") - F.col(f"{side}_start")) >= residues)


#: Filters of a chain by their kinds.
FILTERS = {"score_threshold": score_threshold, "best_scores": best_scores, "min_length": min_length, "min_part_length": min_part_length}


def filter_hits(hits: DataFrame, config: list[dict]) -> DataFrame:
    """Parts left by a chain of filters, each a kind of FILTERS and its arguments; each sees what those before it
    left, and a match or query without parts is gone.  matches() gives the bounds of what is left."""
    for step in config:
        arguments = {k: v for k, v in step.items() if k != "kind"}
        if step.get("kind") not in FILTERS:
            raise ValueError(f"{step.get('kind')} is none of the filters {', '.join(FILTERS)}")
        hits = FILTERS[step["kind"]](hits, **arguments)
    return hits


def subject_segments(hits: DataFrame, config: list[dict] | None = None) -> DataFrame:
    """query and segments: what the parts of all its matches cover, in the subjects' coordinates, merged.

    Subjects are not told apart, as in a search against one sequence; queries without parts have no row."""
    s = F.struct(F.least("s_start", "s_end").alias("start"), F.greatest("s_start", "s_end").alias("end"))
    return filter_hits(hits, config or []).groupBy("query").agg(merge_segments(F.collect_list(s)).alias("segments"))


def elongate(hits: DataFrame, complete: str = "s") -> DataFrame:
    """Stretch each part so that one side is aligned completely, as far as the other side reaches.
    Adds elongated, the residues added."""
    other = "q" if complete == "s" else "s"

    def ends(side: str) -> tuple[Column, Column, Column]:
        return F.least(f"{side}_start", f"{side}_end"), F.greatest(f"{side}_start", f"{side}_end"), F.col(f"{side}_start") > F.col(f"{side}_end")

    (lo, hi, _), (olo, ohi, _) = ends(complete), ends(other)
    left = F.least(lo, olo)
    right = F.least(F.col(f"{complete}_len") - hi - 1, F.col(f"{other}_len") - ohi - 1)
    out = {"elongated": left + right}
    for side in "qs":
        low, high, rev = ends(side)
        out[f"{side}_start"] = F.when(rev, high + right).otherwise(low - left)
        out[f"{side}_end"] = F.when(rev, low - left).otherwise(high + right)
    return hits.withColumns(out)


def scores(hits: DataFrame, key: str, keep_self: bool = False) -> DataFrame:
    rows = hits if keep_self else hits.where("query <> subject")
    return rows.select("query", "subject", F.col(key).alias("value"))


def reads_with_hits(reads: DataFrame, hits: DataFrame, present: bool) -> DataFrame:
    """Reads that have (or lack) hits, by name."""
    return reads.join(hits.select(F.col("query").alias("name")).distinct(), "name", "left_semi" if present else "left_anti")


def oligo_segments(hits: DataFrame) -> DataFrame:
    """Trim segments of reads from hits of oligos stretched to the whole oligo."""
    s = F.struct(F.lit("vector").alias("kind"), F.least("q_start", "q_end").alias("start"), F.greatest("q_start", "q_end").alias("end"))
    return elongate(hits).groupBy("query").agg(F.array_sort(F.collect_list(s)).alias("segments"))


def adapter_segments(hits: DataFrame) -> DataFrame:
    """Trim segments from the first base of an adapter, stretched to the whole adapter, to the read's 3' end.

    The segment of the leftmost hit holds those of all others, so a read has one."""
    start = F.min(F.least("q_start", "q_end"))
    return elongate(hits).groupBy("query").agg(F.array(F.struct(F.lit("other").alias("kind"), start.alias("start"), (F.max("q_len") - 1).alias("end"))).alias("segments"))
