"""SimHash near-duplicates: tiles of fingerprints compared exactly with exclusive-or and bit counts."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .shared import lean, materialise

SEED = 42
#: Cells of one exclusive-or matrix in numpy.
CELLS = 1 << 18


def simhash(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit fingerprint of the shingles of words, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts, ends = [0, *ends[:-1]], ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends)), "<u8", len(ends))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        part = h[k : k + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, name: str = "fp") -> DataFrame:
    """docs with the fingerprint of each text; a column of that name is replaced."""
    kept = [f for f in docs.schema.fields if f.name != name]
    text_at = [f.name for f in kept].index("text")

    def run(batches):
        for batch in batches:
            found = [simhash(t, shingle) for t in batch.column(text_at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], [*batch.schema.names, name])

    schema = T.StructType([*kept, T.StructField(name, T.LongType())])
    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(lean(run), schema)


def tile_pairs(unit: np.ndarray, side: np.ndarray):
    """Places (i, j) of the pairs to compare within each unit (rows sorted by unit and side), in blocks of
    about CELLS pairs: each pair of a unit of one side, or side 0 against side 1."""
    cuts = np.flatnonzero(np.diff(unit)) + 1
    starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(unit)]))
    small = ends - starts <= 32
    size = np.repeat(np.where(small & (side[ends - 1] == 0), ends - starts, 0), ends - starts)
    for k in range(1, int(size.max(initial=0))):
        a = np.flatnonzero((unit[:-k] == unit[k:]) & (size[:-k] > k))
        yield a, a + k
    large = ~small | (side[ends - 1] == 1)
    for s, e in zip(starts[large].tolist(), ends[large].tolist()):
        middle = s + int(np.searchsorted(side[s:e], 1))
        low, high = (s, e) if middle == e else (middle, e)
        step = max(1, CELLS // max(1, high - low))
        for k in range(s, middle, step):
            i = np.repeat(np.arange(k, min(k + step, middle)), high - low)
            j = np.tile(np.arange(low, high), min(k + step, middle) - k)
            yield (i[i < j], j[i < j]) if middle == e else (i, j)


def _spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest place that each of n places is linked to, through any number of links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _links_of(rows: list[np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within each unit, reduced to one link per linked fingerprint."""
    unit, side, fp = rows[0], rows[1], rows[2].view(np.uint64)
    found = []
    for i, j in tile_pairs(unit, side):
        near = np.bitwise_count(fp[i] ^ fp[j]) <= radius
        found.append((i[near], j[near]))
    if not found:
        return rows[2][:0], rows[2][:0]
    label = _spanning(len(fp), *map(np.concatenate, zip(*found)))
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return rows[2][moved], rows[2][label[moved]]


def compare_units(units: DataFrame, links_of) -> DataFrame:
    """Links (u, v) that links_of finds in the rows of whole units.  The first columns of units are unit
    and side; a unit's rows are together and sorted in one partition, and only whole units are held."""

    def run(batches):
        held: list[np.ndarray] = []
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rows = [np.concatenate(p) for p in zip(held, rows)] if held else rows
            last = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
            held = [r[last:] for r in rows]
            if last:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in links_of([r[:last] for r in rows])], ["u", "v"])
        if held and len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in links_of(held)], ["u", "v"])

    return units.repartition("unit").sortWithinPartitions("unit", "side").mapInArrow(lean(run), "u long, v long")


def tiled_units(entries: DataFrame, reach: int, tile: int) -> DataFrame:
    """Rows (band, total, pop, ...) to rows (unit, side, ...) of the units in which a band's rows are compared.

    A band of at most tile rows (total) is one unit; more are cut into tiles by pop (and the row's own
    column fp), and tile pairs whose pops differ by more than reach are skipped.
    """
    rest = [c for c in entries.columns if c not in ("band", "pop", "total")]
    small = entries.where(F.col("total").between(2, tile)).select(F.col("band").alias("unit"), F.lit(0).alias("side"), *rest)
    entries = entries.where(F.col("total") > tile).drop("total")
    sizes = entries.groupBy("band", "pop").agg(F.count("*").alias("n"))
    parts = materialise(
        sizes.select("band", "pop", F.ceil(F.col("n") / tile).cast("int").alias("parts")), "simhash-tiles"
    )
    if parts.isEmpty():
        return small
    tiles = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    one, two = (tiles.select("band", F.col("pop").alias(f"pop{k}"), F.col("part").alias(f"part{k}")) for k in (1, 2))
    pairs = (
        one.join(two, "band")
        .where(F.col("pop2").between(F.col("pop1"), F.col("pop1") + reach))
        .where("pop2 > pop1 OR part2 >= part1")
        .withColumn("unit", F.xxhash64("band", "pop1", "part1", "pop2", "part2"))
    )
    dealt = entries.join(parts, ["band", "pop"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    first = pairs.select("band", F.col("pop1").alias("pop"), F.col("part1").alias("part"), "unit", F.lit(0).alias("side"))
    second = pairs.where("pop1 <> pop2 OR part1 <> part2").select(
        "band", F.col("pop2").alias("pop"), F.col("part2").alias("part"), "unit", F.lit(1).alias("side")
    )
    tiled = dealt.join(first.unionByName(second), ["band", "pop", "part"]).select("unit", "side", *rest)
    return small.unionByName(tiled)


def linked_fingerprints(distinct: DataFrame, radius: int = 3, tile: int = 2048) -> DataFrame:
    """Links (u, v) that join all fingerprints at most radius bits apart; distinct has one row per fp.

    Two such fingerprints agree on one of radius + 1 bit ranges at least, so only fingerprints equal on
    a range are compared.  A range value with at most tile fingerprints is one tile; more are cut into
    tiles by bit count (and hash), and tile pairs whose bit counts differ by more than radius are
    skipped.  A comparison links each fingerprint to the smallest one that it reaches in its tiles, so
    the rows made grow with the fingerprints and not with the pairs.
    """
    n_bands = radius + 1
    edges = [round(64 * k / n_bands) for k in range(n_bands + 1)]
    bands = F.array(
        *[
            F.xxhash64(F.lit(k), F.shiftrightunsigned("fp", edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1)))
            for k in range(n_bands)
        ]
    )
    entries = distinct.select("fp", F.bit_count("fp").alias("pop"), F.explode(bands).alias("band"))
    totals = entries.groupBy("band").agg(F.count("*").alias("total")).where("total > 1")
    entries = entries.join(totals, "band")
    return compare_units(tiled_units(entries, radius, tile), lambda rows: _links_of(rows, radius))


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3) -> DataFrame:
    """One row per document: doc_id, h (hash of the text), fp (signed 64 bits), root (its component's
    smallest fingerprint), component_id.

    A-Z become lower case; words end at space and 0x09-0x0D; a text of fewer words is one shingle; a
    text without words (or null) has fingerprint 0 and is linked like any other.  Equal fingerprints
    are collapsed before any comparison.  component_id is the smallest doc_id reachable over links of
    at most radius bits; null ids are passed over.  Other columns are not read.
    """
    prints = materialise(fingerprints(docs.select("doc_id", "text"), shingle).select("doc_id", F.xxhash64("text").alias("h"), "fp"), "simhash")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    roots = connected_components(linked_fingerprints(nodes.select("fp"), radius)).withColumnRenamed("u", "fp")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp").select("doc_id", "h", "fp", "root", "component_id")


def op6_simhash_tiles(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
