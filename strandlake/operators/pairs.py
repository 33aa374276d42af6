"""Pairs of reads: grouping, matching, interleaving, and the pair rule of filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import index_rows, run_numbers


def flag_reads(df: DataFrame, predicate: Column, pair: list[str] | None = None, reverse: bool = False, failed_drags_pair: bool = True) -> DataFrame:
    """Adds passed.  reverse negates each read's result first; then all reads of a pair must pass, or
    (failed_drags_pair false) any.  A null result fails."""
    ok = F.coalesce(predicate, F.lit(False))
    ok = ~ok if reverse else ok
    if not pair:
        return df.withColumn("passed", ok)
    together = F.min if failed_drags_pair else F.max
    return df.withColumn("passed", together(ok).over(Window.partitionBy(*pair)))


def group_adjacent(df: DataFrame, key: str = "template", partition: list[str] | None = None) -> DataFrame:
    """Adds group_no: runs of adjacent rows (by ord) with the same key; a null key is a run of its own.
    Runs end with a partition (a file, a chromosome); its rows lie in as many tasks as they need."""
    return run_numbers(df, key, "group_no", partition or [])


def match_pairs(df: DataFrame, template: str = "template") -> DataFrame:
    """Adds route: pair for templates with two reads, orphan for one, discarded for more."""
    n = F.count("*").over(Window.partitionBy(template))
    return df.withColumn("route", F.when(n == 2, "pair").when(n == 1, "orphan").otherwise("discarded"))


def interleave(forward: DataFrame, reverse: DataFrame) -> DataFrame:
    """Two files' reads in turn: adds n (the pair) and side, whose order is the order of the reads; the shorter
    file just ends earlier."""
    one = index_rows(forward).withColumn("side", F.lit(0))
    two = index_rows(reverse).withColumn("side", F.lit(1))
    return one.unionByName(two)


def check_interleaved(df: DataFrame) -> DataFrame:
    """Pairs (n) whose names differ or whose directions are not fwd and rev."""
    pairs = df.groupBy("n").agg(F.countDistinct("template").alias("names"), F.sort_array(F.collect_set("direction")).alias("directions"), F.count("*").alias("reads"))
    return pairs.where((F.col("names") != 1) | (F.col("reads") != 2) | (F.col("directions") != F.array(F.lit("fwd"), F.lit("rev"))))


def group_pairs(df: DataFrame, size: int, template: str = "template") -> DataFrame:
    """Groups of size neighbours in order of ord: adds n, group_no and problem, which tells groups whose
    names differ and a last group that is too small; it is null in sound groups, and for size 1."""
    rows = index_rows(df).withColumn("group_no", F.floor(F.col("n") / size))
    if size == 1:
        return rows.withColumn("problem", F.lit(None).cast("string"))
    w = Window.partitionBy("group_no")
    differ = F.coalesce(F.min(template).over(w) != F.max(template).over(w), F.lit(False))
    return rows.withColumn("problem", F.when(F.count("*").over(w) < size, "fewer reads").when(differ, "names differ"))


def deinterleave(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    numbered = index_rows(df)
    return numbered.where("n % 2 = 0").drop("n"), numbered.where("n % 2 = 1").drop("n")
