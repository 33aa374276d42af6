"""Trimming and masking: recommenders append segments, one final projection applies them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.reads import let, longest_segment, slice_text
from ..functions.vectors import best_stretch, longest_upper

SEGMENTS = "array<struct<kind:string,start:int,end:int>>"


def no_segments() -> Column:
    return F.array().cast(SEGMENTS)


def segment(kind: str, start, end) -> Column:
    return F.struct(F.lit(kind).alias("kind"), start.cast("int").alias("start"), end.cast("int").alias("end"))


def recommend(df: DataFrame, segments: Column) -> DataFrame:
    """Append segments to trim_segments; the column appears where it is missing."""
    had = F.col("trim_segments") if "trim_segments" in df.columns else no_segments()
    return df.withColumn("trim_segments", F.concat(had, segments.cast(SEGMENTS)))


def edge_segments(length: Column, left: int = 0, right: int = 0) -> Column:
    both = []
    if left:
        both.append(segment("other", F.lit(0), F.lit(left - 1)))
    if right:
        both.append(segment("other", F.greatest(length - right, F.lit(0)), length - 1))
    return F.array(*both) if both else no_segments()


def outside(kind: str, keep: Column, length: Column) -> Column:
    """Everything outside the kept (start, end); the whole read where nothing is kept."""
    return F.when(keep.isNull(), F.array(segment(kind, F.lit(0), length - 1))).otherwise(
        F.filter(
            F.array(segment(kind, F.lit(0), keep["start"] - 1), segment(kind, keep["end"] + 1, length - 1)),
            lambda s: s["end"] >= s["start"],
        )
    )


def lower_case_segments(seq: Column) -> Column:
    """Recommend all but the longest upper-case run; a read without upper case goes whole."""
    return outside("other", longest_upper(seq), F.length(seq))


def quality_segments(qual: Column, window: int, threshold: float, left: bool = True, right: bool = True, offset: int = 33) -> Column:
    """Extend the best window both ways until a window's mean is below the threshold."""
    return outside("quality", best_stretch(qual, window, threshold, left, right, offset), F.length(qual))


def merge_segments(segments: Column, near: int = 1) -> Column:
    """Merge (start, end) segments that overlap or are at most near apart (1: adjacent ones merge)."""
    sorted_ = F.array_sort(F.transform(segments, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    return F.aggregate(
        sorted_,
        empty,
        lambda acc, s: F.when(
            F.coalesce(s["start"] <= F.get(acc, F.size(acc) - 1)["end"] + near, F.lit(False)),
            F.concat(
                F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(
                    F.struct(
                        F.get(acc, F.size(acc) - 1)["start"].alias("start"),
                        F.greatest(F.get(acc, F.size(acc) - 1)["end"], s["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )


def complement_segments(segments: Column, length: Column) -> Column:
    """What merged, ordered segments leave of [0, length)."""
    gaps = let(
        segments,
        lambda x: F.transform(
            F.sequence(F.lit(0), F.size(x)),
            lambda i: F.struct(
                F.coalesce(F.get(x, i - 1)["end"] + 1, F.lit(0)).alias("start"),
                F.coalesce(F.get(x, i)["start"] - 1, length - 1).cast("int").alias("end"),
            ),
        ),
    )
    return F.filter(gaps, lambda s: s["end"] >= s["start"])


def covered_and_free(segments: Column, length: Column) -> Column:
    """Covered and free segments of [0, length) in order, with a flag."""
    mark = lambda x, flag: F.transform(x, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(flag).alias("covered")))
    return let(merge_segments(segments), lambda m: F.array_sort(F.concat(mark(m, True), mark(complement_segments(m, length), False))))


def longest_free(segments: Column, length: Column) -> Column:
    return longest_segment(complement_segments(merge_segments(segments), length))


def mask_segments(seq: Column, segments: Column) -> Column:
    """Lower-case the covered letters: pieces between merged segments are joined again."""
    pieces = covered_and_free(segments, F.length(seq))
    return F.array_join(
        F.transform(pieces, lambda s: F.when(s["covered"], F.lower(slice_text(seq, s["start"], s["end"] + 1))).otherwise(slice_text(seq, s["start"], s["end"] + 1))),
        "",
    )


def trim_or_mask(df: DataFrame, mask: bool = False, pair: list[str] | None = None) -> DataFrame:
    """Apply trim_segments to seq and qual.  Masked reads keep their length; trimmed reads keep the
    longest free segment.  With pair (columns that name a pair) a route column tells passed, orphan
    (the mate is lost) and lost."""
    if mask:
        return df.withColumn("seq", mask_segments(F.col("seq"), F.col("trim_segments"))).drop("trim_segments")
    keep = longest_free(F.col("trim_segments"), F.length("seq"))
    df = df.withColumn("__keep", F.when(F.size("trim_segments") > 0, keep).otherwise(F.struct(F.lit(0).alias("start"), (F.length("seq") - 1).alias("end"))))
    alive = F.col("__keep").isNotNull() & (F.col("__keep.end") >= F.col("__keep.start"))
    df = df.withColumn("__alive", alive)
    if pair:
        everyone = F.min("__alive").over(Window.partitionBy(*pair))
        df = df.withColumn("route", F.when(~F.col("__alive"), "lost").when(everyone, "passed").otherwise("orphan"))
    else:
        df = df.withColumn("route", F.when(F.col("__alive"), "passed").otherwise("lost"))
    cut = lambda c: F.when(F.col("__alive"), slice_text(F.col(c), F.col("__keep.start"), F.col("__keep.end") + 1)).otherwise("")
    return df.withColumns({c: cut(c) for c in ("seq", "qual") if c in df.columns}).drop("__keep", "__alive", "trim_segments")


def trim_chimera_segments(alignments: DataFrame) -> DataFrame:
    """Of each read's alignments that start at its 5' end the longest: what follows its end is trimmed.
    alignments: qname, q_start, q_end (0-based, inclusive) and length of the read."""
    best = alignments.where("q_start = 0").groupBy("qname", "length").agg(F.max_by("q_end", F.struct(F.col("q_end") - F.col("q_start"), -F.col("ord"))).alias("end"))
    return best.where(F.col("end") < F.col("length") - 1).select("qname", segment("other", F.col("end") + 1, F.col("length") - 1).alias("segment"))
