"""Sharding by histogram sort: exact byte counts below probed boundaries, then one exchange."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, materialise, scratch_dir, utf8_bytes

#: Bytes that a row counts for besides its text.
ROW_OVERHEAD = 8
#: Bits of a cell's number that tell groups of rows with equal ids apart; no group is under 2^-16 of all bytes.
TIE_BITS = 20


def _part(value: str, low: str, step: str) -> Column:
    """Number of whole steps from low to value; decimals, as ids may span all 64 bits."""
    return F.expr(f"int((cast({value} as decimal(20,0)) - cast({low} as decimal(20,0))) div {step})")


def _cut(keys: DataFrame, cuts: list[tuple]) -> DataFrame:
    """__sub: the range of ids within a hot cell, by the ids that begin the ranges; 0 in other cells."""
    if not cuts:
        return keys.withColumn("__sub", F.lit(0))
    table = keys.sparkSession.createDataFrame(cuts, "__cell long, __starts array<long>")
    part = F.coalesce(F.size(F.filter("__starts", lambda s: s <= F.col("__d"))), F.lit(0))
    return keys.join(F.broadcast(table), "__cell", "left").withColumn("__sub", part).drop("__starts")


def _hot_cuts(keys: DataFrame, hot: dict[int, int]) -> list[tuple]:
    """Of each hot cell, the ids that cut its rows into so many ranges of about as many rows each."""
    if not hot:
        return []
    most = max(hot.values())
    ids = F.percentile_approx("__d", [k / most for k in range(1, most)] or [0.5], 10_000).alias("ids")
    found = keys.where(F.col("__cell").isin(list(hot))).groupBy("__cell").agg(ids, F.min("__d").alias("low")).collect()
    return [(r["__cell"], sorted({i for i in r["ids"][:: max(1, most // hot[r["__cell"]])] if i > r["low"]})) for r in found]


def _ties(keys: DataFrame, cells: list[tuple], total: int, n_shards: int, slack: float, limit: int) -> list[tuple]:
    """(cell, id, number within the cell from 1) of equal ids with more than slack bytes in several rows.

    Only cells that hold a boundary or more than limit bytes are looked at, as ties elsewhere do no harm."""
    below, looked, j = 0, [], 1
    for cell, size, *_ in sorted(cells):
        inside = below + size > total * j // n_shards
        while j < n_shards and below + size > total * j // n_shards:
            j += 1
        if inside or size > limit:
            looked.append(cell)
        below += size
    if not looked:
        return []
    groups = keys.where(F.col("__cell").isin(looked)).groupBy("__cell", "__d").agg(F.sum("__size").alias("size"), F.count("*").alias("n"))
    found, last, number = [], None, 0
    for cell, d in sorted(map(tuple, groups.where((F.col("n") > 1) & (F.col("size") > slack)).select("__cell", "__d").collect())):
        number = number + 1 if cell == last else 1
        found.append((cell, d, number))
        last = cell
    return found


def _splitters(keys: DataFrame, units: list[tuple], total: int, n_shards: int, tolerance: float, probes: int) -> list:
    """Boundaries (cell, id, rows below): each starts a shard.  A round probes all open ones at once."""
    spark, slack, closed, opened = keys.sparkSession, tolerance * total / n_shards, {}, {}
    starts, below, rows = [], 0, 0
    for cell, _, lo, hi, size, n in units:
        starts.append((cell, lo, hi, below, below + size, rows, rows + n))
        below, rows = below + size, rows + n
    at = 0
    for j in range(1, n_shards if units else 0):
        target = total * j / n_shards
        while at + 1 < len(starts) and starts[at][4] <= target:
            at += 1
        cell, lo, hi, first, last, r0, r1 = starts[at]
        if target - first <= slack:
            closed[j] = (cell, lo, r0)
        elif last - target <= slack:
            closed[j] = (cell, hi + 1, r1)
        else:
            opened[j] = (cell, lo, hi, first, r0)
    while opened:
        steps = {j: -(-(hi - lo + 1) // probes) for j, (_, lo, hi, _, _) in opened.items()}
        table = spark.createDataFrame(
            [(j, c, lo, hi, Decimal(steps[j])) for j, (c, lo, hi, _, _) in opened.items()],
            "__j int, __cell long, __lo long, __hi long, __step decimal(20,0)",
        )
        counts = (
            keys.join(F.broadcast(table), "__cell")
            .where(F.col("__d").between(F.col("__lo"), F.col("__hi")))
            .groupBy("__j", _part("__d", "__lo", "__step").alias("__p"))
            .agg(F.sum("__size").alias("size"), F.count("*").alias("n"))
            .collect()
        )
        for j, (cell, lo, hi, below, rows) in list(opened.items()):
            target, step = total * j / n_shards, steps[j]
            for _, p, size, n in sorted(c for c in counts if c["__j"] == j):
                if below + size > target:
                    break
                below, rows = below + size, rows + n
            start, end = lo + p * step, min(hi, lo + (p + 1) * step - 1)
            if target - below <= slack or (step == 1 and target - below <= below + size - target):
                closed[j] = (cell, start, rows)
            elif below + size - target <= slack or step == 1:
                closed[j] = (cell, end + 1, rows + n)
            else:
                opened[j] = (cell, start, end, below, rows)
        opened = {j: x for j, x in opened.items() if j not in closed}
    return [closed[j] for j in sorted(closed)]


def shard_documents(
    docs: DataFrame,
    n_shards: int = 24,
    tolerance: float = 0.002,
    probes: int = 64,
    cell_bytes: int = 4 << 20,
    hot_parts: int = 512,
) -> DataFrame:
    """Histogram sort of documents by (hash cell of the text, doc_id) into shards of near-equal bytes.

    Adds shard and slot (position in the shard, gapless from 0); columns of these names are replaced,
    all others stay.  A first histogram counts the exact bytes of 2^12 to 2^18 hash cells.  Each round
    then counts bytes between probes inside the cells that hold unmet boundaries, until every boundary
    is within tolerance of its share or falls between two rows.  Only counts reach the driver (at most
    2^18 cells, and n_shards x probes a round).  One exchange by cell moves the rows; cells with much
    of the data (copies of one text) are dealt by ranges of ids, cut at counted quantiles of their rows.

    So a shard's rows lie in many tasks, each with some cells of several shards: the layout is one
    file set in which shard and slot name the place, and a partitioned write needs no further shuffle.

    Equal texts share a cell, and so a shard, unless a boundary cuts their cell: the law is of bytes, and
    a group of copies may be larger than a shard.  Rows of one cell with equal ids (copies that repeat
    their id, null ids) are parted too where they weigh more than the tolerance and a boundary may fall
    among them, or where their cell is hot: these rows alone are written, each with a number that is its
    third key.  Groups of less than 2^-16 of all bytes stay whole.  A null text has size 8 and is a text
    of its own; a null doc_id sorts as -1; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    sized = docs.withColumns(
        {
            "__h": F.xxhash64("text"),
            "__d": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")),
            "__size": utf8_bytes(F.col("text")) + ROW_OVERHEAD,
        }
    )
    folder = scratch_dir(spark, "shards")
    keys = materialise(sized.select("__h", "__d", "__size"), "keys", folder)
    total = keys.agg(F.coalesce(F.sum("__size"), F.lit(0))).first()[0]
    bits = min(18, max(12, ceil(log2(max(1, total / cell_bytes)))))
    cell = F.shiftleft(F.shiftright("__h", 64 - bits), TIE_BITS)
    keys, sized = keys.withColumn("__cell", cell), sized.withColumn("__cell", cell)

    limit = max(1, total // hot_parts)
    measures = F.sum("__size"), F.min("__d"), F.max("__d")
    cells = [tuple(r) for r in keys.groupBy("__cell").agg(*measures).collect()]
    ties = _ties(keys, cells, total, n_shards, max(tolerance * total / n_shards, total / (1 << 16)), limit)
    if ties:
        # Equal ids become a cell of their own, behind their cell's other rows, with row numbers for ids.
        table = F.broadcast(spark.createDataFrame(ties, "__cell long, __d long, __tie int"))
        tied = sized.join(table, ["__cell", "__d"]).withColumns(
            {"__cell": F.col("__cell") + F.col("__tie"), "__d": F.monotonically_increasing_id()}
        )
        tied = materialise(tied.drop("__tie"), "shard-ties")
        sized = sized.join(table, ["__cell", "__d"], "left_anti").unionByName(tied)
        keys = keys.join(table, ["__cell", "__d"], "left_anti").unionByName(tied.select(*keys.columns))
        cells = [tuple(r) for r in keys.groupBy("__cell").agg(*measures).collect()]

    cuts = _hot_cuts(keys, {c: -(-size // limit) for c, size, lo, hi in cells if size > limit and hi > lo})
    units = sorted(
        map(
            tuple,
            _cut(keys, cuts)
            .groupBy("__cell", "__sub")
            .agg(F.min("__d"), F.max("__d"), F.sum("__size"), F.count("*"))
            .collect(),
        )
    )
    bounds = _splitters(keys, units, total, n_shards, tolerance, probes)
    discard(spark, folder)

    ranks, rows = [], 0
    for c, sub, *_, n in units:
        ranks.append((c, sub, rows))
        rows += n
    ranks = spark.createDataFrame(ranks, "__cell long, __sub int, __rank long")
    above = [
        (F.col("__cell") > c) | ((F.col("__cell") == c) & (F.col("__d") >= F.lit(d if d < 1 << 63 else Decimal(d))))
        for c, d, _ in bounds
    ]
    shard = reduce(lambda a, b: a + b, [x.cast("int") for x in above], F.lit(0))
    first_rank = F.element_at(F.array(*[F.lit(r).cast("long") for r in [0, *(r for *_, r in bounds)]]), F.col("shard") + 1)
    in_unit = Window.partitionBy("__cell", "__sub").orderBy("__d", "__h", "__size")
    return (
        _cut(sized, cuts)
        .join(F.broadcast(ranks), ["__cell", "__sub"])
        .withColumn("shard", shard)
        .withColumn("slot", F.row_number().over(in_unit) - 1 + F.col("__rank") - first_rank)
        .drop("__h", "__d", "__size", "__cell", "__sub", "__rank")
    )


def op1_histogram_sort(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near-equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard_documents(docs).select(
        "doc_id",
        (utf8_bytes(F.col("text")) + ROW_OVERHEAD).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
