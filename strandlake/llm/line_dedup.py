"""Line deduplication over overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import join_hot, materialise

#: Lines in a window.
SPAN = 3


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Remove the lines that later occurrences of a three-line window cover.

    Lines end at a line feed.  Every run of three consecutive lines is hashed, and windows are told
    apart by these 128 bits alone; windows seen more than once are found by an aggregate, and each occurrence but the first (smallest doc_id, then
    position) is removed whole.  Overlapping or touching occurrences merge into ranges, one row each.

    Replaces text and adds n_lines and n_removed; all other columns stay.  Null text has no lines and
    stays null; an empty text is one empty line; fewer than three lines are never removed.  Documents
    are told apart by doc_id and text, so rows equal in both count as one occurrence.  A null doc_id
    is smaller than all others.
    """
    docs = docs.withColumns({"__h": F.xxhash64("text"), "__lines": F.split("text", "\n")})
    count = F.coalesce(F.size("__lines"), F.lit(0))
    line = lambda i: F.get("__lines", i)

    def window(i):
        three = [line(i + k) for k in range(SPAN)]
        return F.struct(F.xxhash64(*three).alias("w1"), F.xxhash64(F.lit(1), *three).alias("w2"))

    windows = (
        docs.where(count >= SPAN)
        .select("doc_id", "__h", F.posexplode(F.transform(F.sequence(F.lit(0), count - SPAN), window)).alias("pos", "w"))
        .select("doc_id", "__h", "pos", "w.w1", "w.w2")
    )
    windows = materialise(windows, "line-windows")
    place = F.struct("doc_id", "__h", "pos")
    repeated = windows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    repeated = materialise(repeated, "repeated-windows")
    later = join_hot(windows, repeated, ["w1", "w2"], "n").where(~place.eqNullSafe(F.col("first")))

    in_doc = Window.partitionBy("doc_id", "__h").orderBy("pos")
    gap = F.coalesce(F.col("pos") - F.lag("pos").over(in_doc) > SPAN, F.lit(False)).cast("int")
    ranges = (
        later.groupBy("doc_id", "__h", "pos").agg(F.count("*").alias("n"))
        .withColumn("gap", gap)
        .withColumn("run", F.sum("gap").over(in_doc))
        .groupBy("doc_id", "__h", "run")
        .agg(F.min("pos").alias("start"), (F.max("pos") + SPAN).alias("end"))
        .groupBy(F.col("doc_id").alias("__id"), F.col("__h").alias("__k"))
        .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__cut"))
    )
    docs = docs.join(ranges, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__k")), "left")
    n_cut = F.coalesce(F.size("__cut"), F.lit(0))
    kept = F.flatten(
        F.transform(
            F.sequence(F.lit(0), n_cut),
            lambda i: F.slice(
                "__lines",
                F.coalesce(F.get("__cut", i - 1)["end"], F.lit(0)) + 1,
                F.coalesce(F.get("__cut", i)["start"], count) - F.coalesce(F.get("__cut", i - 1)["end"], F.lit(0)),
            ),
        )
    )
    return docs.withColumns(
        {
            "text": F.when(n_cut == 0, F.col("text")).otherwise(F.array_join(kept, "\n")),
            "n_lines": count.cast("long"),
            "n_removed": F.coalesce(F.aggregate("__cut", F.lit(0), lambda a, r: a + r["end"] - r["start"]), F.lit(0)).cast("long"),
        }
    ).drop("__h", "__lines", "__id", "__k", "__cut")


def op4_line_windows(spark, sf_dir: str) -> DataFrame:
    """Per document its lines, how many were removed, and the digest of what stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )
