"""De-duplication, order, samples and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import with_neighbour


def duplicates(df: DataFrame, length: int | None = None, pair: str | None = None) -> DataFrame:
    """Adds is_first: the first read (or pair) by ord of each sequence (prefix).

    A key's first is found by an aggregate that is combined before the shuffle, so a very common
    sequence is no hot spot; the key that moves is a digest of the sequences.
    """
    text = F.substring("seq", 1, length) if length else F.col("seq")
    if pair:
        units = df.groupBy(pair).agg(F.min("ord").alias("__ord"), F.array_sort(F.collect_list(F.struct("ord", text.alias("s")))).alias("__s"))
        units = units.select(F.col(pair).alias("__unit"), "__ord", F.sha2(F.array_join(F.transform("__s", lambda s: s["s"]), "\t"), 256).alias("__key"))
    else:
        units = df.select(F.col("ord").alias("__unit"), F.col("ord").alias("__ord"), F.sha2(text, 256).alias("__key"))
    first = units.groupBy("__key").agg(F.min(F.struct("__ord", "__unit"))["__unit"].alias("__unit")).select("__unit", F.lit(True).alias("is_first"))
    return df.join(first, F.col(pair or "ord") == F.col("__unit"), "left").drop("__unit").withColumn("is_first", F.coalesce("is_first", F.lit(False)))


def unique_adjacent(df: DataFrame, key: str, partition: list[str]) -> DataFrame:
    """Rows whose key differs from the row before, by ord within the partition."""
    rows = with_neighbour(df, key, "__b", partition)
    return rows.where(~F.col(key).eqNullSafe(F.col("__b.v")) | F.col("__b.v").isNull()).drop("__b")


def pairwise(df: DataFrame, value: str, partition: list[str]) -> DataFrame:
    """Adds following: the value of the next row by ord within the partition, null at its end."""
    return with_neighbour(df, value, "following", partition, after=True).withColumn("following", F.col("following.v"))


def head(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy("ord").limit(n)


def sample(df: DataFrame, n: int, seed: int = 42, key: str = "name") -> DataFrame:
    """Exactly n rows by order of a seeded hash, the same at every run; in order of ord."""
    mark = F.md5(F.concat(F.col(key), F.lit(f"|{seed}")).cast("binary"))
    return df.withColumn("__m", mark).orderBy("__m", key).limit(n).drop("__m").orderBy("ord")


def best_items(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def concatenate(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [f.withColumn("file", F.lit(i)) for i, f in enumerate(frames)])


def filter_regions(df: DataFrame, flags: list[str]) -> DataFrame:
    """Rows per exact combination of filters passed (regions of a Venn diagram)."""
    region = F.array_join(F.filter(F.array(*[F.when(F.col(f), F.lit(f)) for f in flags]), lambda x: x.isNotNull()), "&")
    return df.groupBy(region.alias("region")).agg(F.count("*").alias("n"))


def symmetric_difference(one: Column, two: Column) -> Column:
    return F.array_union(F.array_except(one, two), F.array_except(two, one))


def sort_reads(df: DataFrame, key: str, alignments: DataFrame | None = None) -> DataFrame:
    """By seq, name or coordinate (of their alignments; unmapped ones last)."""
    if key != "coordinate":
        return df.orderBy(key, "ord")
    places = alignments.groupBy(F.col("qname").alias("name")).agg(F.min(F.struct("ref", "pos")).alias("place"))
    return df.join(places, "name", "left").orderBy(F.col("place.ref").asc_nulls_last(), F.col("place.pos"), "ord").drop("place")
