"""Windows along chromosomes and range joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import rank_in


def range_join(one: DataFrame, two: DataFrame, key: str, distance: int) -> DataFrame:
    """Pairs with equal key and |pos - pos_2| <= distance; columns of two get the suffix _2.

    Positions fall in bins as wide as the distance, so each row of one meets three bins of two by an
    equi-join, whatever the lengths of the chromosomes.
    """
    width = max(1, distance)
    two = two.select(*[F.col(c).alias(f"{c}_2") for c in two.columns]).withColumn("__bin", F.floor(F.col("pos_2") / width))
    at = F.floor(F.col("pos") / width)
    one = one.withColumn("__bin", F.explode(F.array(at - 1, at, at + 1)))
    near = F.abs(F.col("pos") - F.col("pos_2")) <= distance
    return one.join(two, (F.col(key) == F.col(f"{key}_2")) & (one["__bin"] == two["__bin"]) & near).drop("__bin")


def count_near(sites: DataFrame, distance: int, key: str = "chrom", width: int = 1 << 16) -> DataFrame:
    """Adds near: other sites within the distance.

    Sites are dealt to blocks of width positions (twice the distance at least), and those near a block's ends
    to its neighbour too, so a task holds the sites of one block and its margins."""
    width = max(width, 2 * distance)
    at = lambda c: F.floor(c / width)
    pos = F.col("pos")
    dealt = sites.withColumn("__block", F.explode(F.sequence(at(pos - distance), at(pos + distance))))
    w = Window.partitionBy(key, "__block").orderBy("pos").rangeBetween(-distance, distance)
    return dealt.withColumn("near", F.count("*").over(w) - 1).where(F.col("__block") == at(pos)).drop("__block")


def make_windows(lengths: DataFrame, size: int, step: int) -> DataFrame:
    """Full half-open windows [start, end) of each ref."""
    last = F.col("length") - size
    starts = F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(step).cast("long")))
    return lengths.where(last >= 0).select("ref", starts.alias("start")).withColumn("end", F.col("start") + size)


def site_windows(sites: DataFrame, lengths: DataFrame, size: int, step: int, min_sites: int = 0) -> DataFrame:
    """Windows with their number of sites.  Each site is sent to the windows that hold it."""
    windows = make_windows(lengths, size, step).withColumnRenamed("ref", "chrom")
    first = F.greatest(F.ceil((F.col("pos") - size + 1) / step), F.lit(0)) * step
    placed = sites.where("pos >= 0").select("chrom", F.explode(F.filter(F.sequence(first, F.greatest(first, F.floor(F.col("pos") / step) * step), F.lit(step).cast("long")), lambda s: s <= F.col("pos"))).alias("start"))
    counts = placed.groupBy("chrom", "start").agg(F.count("*").alias("n"))
    got = windows.join(counts, ["chrom", "start"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return got.where(F.col("n") >= min_sites)


def index_pairs(sites: DataFrame, half: int, key: str = "chrom", block: int = 4096) -> DataFrame:
    """Pairs of sites of a chromosome at most half places apart in order of position, each once:
    ord, pos and ord_2, pos_2.

    Sites are numbered along each chromosome and cut into blocks of places; the first half of a block's
    places stand in the block before as well, so every pair lies in the block of its first site."""
    block = max(block, half)
    rows = rank_in(sites.select(key, "ord", "pos"), key, "__rank")
    own = F.expr(f"__rank div {block}")
    ahead = (F.col("__rank") % block < half) & (own > 0)
    rows = rows.withColumn("__block", F.explode(F.when(ahead, F.array(own, own - 1)).otherwise(F.array(own))))
    w = Window.partitionBy(key, "__block").orderBy("__rank")
    rows = rows.withColumn("others", F.collect_list(F.struct("ord", "pos")).over(w.rowsBetween(1, half))).where(F.col("__block") == own)
    return rows.select(key, "ord", "pos", F.explode("others").alias("o")).select(key, "ord", "pos", F.col("o.ord").alias("ord_2"), F.col("o.pos").alias("pos_2"))
