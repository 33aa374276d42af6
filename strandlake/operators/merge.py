"""Alignments of several files as one: joined dictionaries of references, read groups of their own, one order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import index_rows


#: Ids of the form id.n that files may have already; n is looked for so much further.
MOST_TAKEN = 100


def _numbered(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [f.withColumn("file", F.lit(k)) for k, f in enumerate(frames)])


def merged_references(headers: list[DataFrame]) -> DataFrame:
    """Headers' references (number, ref, length) as one dictionary: number, ref, length, in the order in which they
    first appear, file by file.  A reference with several lengths is an error."""
    rows = _numbered([h.select("number", "ref", "length") for h in headers])
    found = rows.groupBy("ref").agg(F.min(F.struct("file", "number")).alias("ord"), F.min("length").alias("length"), F.max("length").alias("most"))
    sound = F.when(F.col("length") == F.col("most"), F.col("length")).otherwise(F.raise_error(F.concat(F.lit("a reference with several lengths: "), "ref")).cast("long"))
    return index_rows(found.withColumn("length", sound).drop("most"), "number", parts=32).select(F.col("number").cast("int").alias("number"), "ref", "length")


def merged_read_groups(groups: list[DataFrame]) -> DataFrame:
    """Files' read groups (id, sample) with their ids in the joined header: file, id, sample, new_id.

    Groups equal in id and sample are one.  Where an id stands for several samples, the first file's keeps it;
    the others get .1, .2 and so on behind it, skipping ids that are taken.
    """
    rows = _numbered([g.select("id", "sample") for g in groups])
    kinds = rows.groupBy("id", "sample").agg(F.min("file").alias("first"))
    # How many other kinds of the id come before: by their first file, then by sample.
    kinds = kinds.join(kinds.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("first", "sample"))).alias("order")), "id")
    rank = (F.array_position("order", F.struct("first", "sample")) - 1).cast("int")
    kinds = kinds.withColumn("k", rank)
    known = rows.select(F.col("id").alias("other")).distinct()
    tries = kinds.where("k > 0").select("id", "sample", "k", F.explode(F.sequence(F.lit(1), F.size("order") + F.lit(MOST_TAKEN))).alias("n"))
    tries = tries.withColumn("other", F.concat("id", F.lit("."), F.col("n").cast("string"))).join(known, "other", "left_anti")
    # The k-th id that is free is the k-th kind's.
    free = tries.groupBy("id", "sample", "k").agg(F.array_sort(F.collect_list("n")).alias("free"))
    free = free.select("id", "sample", F.concat("id", F.lit("."), F.get("free", F.col("k") - 1).cast("string")).alias("renamed"))
    named = kinds.alias("x").join(free.alias("o"), (F.col("x.id") == F.col("o.id")) & F.col("x.sample").eqNullSafe(F.col("o.sample")), "left")
    named = named.select(F.col("x.id").alias("id"), F.col("x.sample").alias("sample"), F.coalesce("renamed", "x.id").alias("new_id"))
    return rows.alias("r").join(named.alias("o"), (F.col("r.id") == F.col("o.id")) & F.col("r.sample").eqNullSafe(F.col("o.sample"))).select(
        "r.file", "r.id", "r.sample", "new_id"
    )


def merge_alignments(files: list[DataFrame], headers: list[DataFrame], groups: list[DataFrame]) -> DataFrame:
    """Alignments of all files with file, their read groups' ids in the joined header, and the place by which they are
    sorted: ref_number (null for unmapped reads, which come last), pos, file, ord.

    Nothing is put into one order here; write_sorted and orderBy deal the rows by ranges of these columns."""
    rows = _numbered(files)
    ids = merged_read_groups(groups).select("file", F.col("id").alias("rg"), "new_id")
    rows = rows.join(ids.distinct(), ["file", "rg"], "left").withColumn("rg", F.coalesce("new_id", "rg")).drop("new_id")
    return rows.join(merged_references(headers).select("ref", F.col("number").alias("ref_number")), "ref", "left")


def write_sorted(merged: DataFrame, path: str) -> None:
    """Merged alignments as Parquet files by ranges of their place, each sorted."""
    place = [F.col("ref_number").asc_nulls_last(), F.col("pos").asc_nulls_last(), "file", "ord"]
    merged.repartitionByRange(*place).sortWithinPartitions(*place).write.parquet(path)
