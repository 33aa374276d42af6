"""Order without one task for it: explicit ranges, numbers, and neighbours carried over from range to range."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys that are sampled for each cut between ranges.
SAMPLED = 16


def _literal(value, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType) and value is not None:
        return F.struct(*[_literal(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
    return F.lit(value).cast(kind)


def range_of(df: DataFrame, by: str, parts: int = 128) -> Column:
    """Number of the range of by that a row falls in: at most parts ranges of about as many rows each.

    The cuts are keys picked by their hash, so they depend on the keys alone and the ranges are the same
    whenever the plan runs again.  At most some 2 x SAMPLED x parts keys reach the driver.
    """
    keys = df.select(F.col(by).alias("k")).where("k IS NOT NULL")
    n, bits = keys.count(), 1 << 30
    most = bits if n <= SAMPLED * parts else bits * SAMPLED * parts // n
    sample = [r["k"] for r in keys.where(F.pmod(F.xxhash64("k"), F.lit(bits)) < most).orderBy("k").collect()]
    step = max(1, len(sample) // parts)
    cuts = [_literal(k, df.schema[by].dataType) for k in sample[step::step][: parts - 1]]
    return reduce(lambda a, b: a + b, [F.coalesce((F.col(by) >= c).cast("int"), F.lit(0)) for c in cuts], F.lit(0))


def _same(keys: list[str], suffix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}{suffix}")) for k in keys])


def _with_cells(rows: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of cells (one row for each value of the keys, null like any other)."""
    renamed = cells.select(*[F.col(k).alias(f"{k}__c") if k in keys else F.col(k) for k in cells.columns])
    return rows.join(renamed, _same(keys, "__c"), "left").drop(*[f"{k}__c" for k in keys])


def index_rows(df: DataFrame, name: str = "n", by: str = "ord", parts: int = 128) -> DataFrame:
    """A gapless number from 0 in order of by: rows are numbered within explicit ranges, to which the rows of
    the ranges before are added.  Nothing is cached and no task orders more than a range."""
    dealt = df.withColumn("__cell", range_of(df, by, parts))
    counts = dealt.groupBy("__cell").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("__cell").orderBy(by)) - 1
    rows = dealt.withColumn(name, inside).join(F.broadcast(counts.select("__cell", before.alias("__before"))), "__cell")
    return rows.withColumn(name, F.col(name) + F.col("__before")).drop("__cell", "__before")


def rank_in(df: DataFrame, key: str, name: str, by: str = "pos", tie: str = "ord", width: int = 1 << 16) -> DataFrame:
    """A gapless number from 0 within each key in order of (by, tie); by is a position, and what one task orders
    are the rows of width neighbouring positions."""
    cells = df.withColumn("__cell", F.expr(f"{by} div {width}"))
    counts = cells.groupBy(key, "__cell").agg(F.count("*").alias("__n"))
    in_key = Window.partitionBy(key).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(key, "__cell", F.coalesce(F.sum("__n").over(in_key), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(key, "__cell").orderBy(by, tie)) - 1
    rows = _with_cells(cells.withColumn(name, inside), counts, [key, "__cell"])
    return rows.withColumn(name, F.col(name) + F.col("__before")).drop("__cell", "__before")


def with_neighbour(df: DataFrame, value: str, name: str, keys: list[str], by: str = "ord", after: bool = False, parts: int = 128) -> DataFrame:
    """Adds the value of the row before (or after) in order of by within the keys, as a struct v; null where there
    is no such row.

    Rows are ordered within explicit ranges; a range's first row takes what the range before ends with."""
    return _with_neighbour(df.withColumn("__cell", range_of(df, by, parts)), value, name, keys, by, after).drop("__cell")


def _with_neighbour(dealt: DataFrame, value: str, name: str, keys: list[str], by: str, after: bool) -> DataFrame:
    cell = [*keys, "__cell"]
    boxed = F.struct(F.col(value).alias("v"))
    edge = (F.min_by if after else F.max_by)(boxed, by)
    step = F.lead if after else F.lag
    edges = dealt.groupBy(*cell).agg(edge.alias("__edge"))
    edges = edges.select(*cell, step("__edge").over(Window.partitionBy(*keys).orderBy("__cell")).alias("__edge"))
    inside = step(boxed).over(Window.partitionBy(*cell).orderBy(by))
    rows = _with_cells(dealt.withColumn(name, inside), edges, cell)
    return rows.withColumn(name, F.coalesce(name, "__edge")).drop("__edge")


def run_numbers(df: DataFrame, value: str, name: str, keys: list[str], by: str = "ord", parts: int = 128) -> DataFrame:
    """Adds the number, from 1 within the keys, of the run of neighbours (in order of by) with equal values; a null
    value is a run of its own."""
    cell = [*keys, "__cell"]
    rows = _with_neighbour(df.withColumn("__cell", range_of(df, by, parts)), value, "__before", keys, by, False)
    rows = rows.withColumn("__new", F.coalesce(F.col(value) != F.col("__before.v"), F.lit(True)).cast("int")).drop("__before")
    in_keys = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*cell).agg(F.sum("__new").alias("__n"))
    sums = sums.select(*cell, F.coalesce(F.sum("__n").over(in_keys), F.lit(0)).alias("__start"))
    rows = rows.withColumn(name, F.sum("__new").over(Window.partitionBy(*cell).orderBy(by)))
    return _with_cells(rows, sums, cell).withColumn(name, F.col(name) + F.col("__start")).drop("__new", "__start", "__cell")
