"""MinHash near-duplicates: a multi-index Hamming join of b-bit signatures, each link confirmed on whole sets."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .exact_dedup import filter_bits, hit_filter, probe
from .near_copies import shingle_sets, similar_rows
from .shared import discard, join_hot, join_salted, materialise, scratch_dir
from .simhash import compare_units, tile_pairs, tiled_units
from .substring_dedup import MIX, ROLL, Filter, _mix

#: Words of a shingle; Jaccard similarity of links, as a fraction of whole numbers.
SHINGLE, SIMILARITY = 2, (4, 5)
#: A signature has CHUNKS x CHUNK positions of 8 bits; chunks that differ in at most ERRORS positions meet.
CHUNKS, CHUNK, ERRORS = 13, 6, 1
#: Pairs whose signatures are at most this far apart share a chunk with at most ERRORS errors (pigeonhole).
RADIUS = CHUNKS * (ERRORS + 1) - 1
#: Pairs farther apart than this aren't confirmed.
FARTHEST = 34
#: Bytes of a set's bitmap of parities.
PARITY = 128
#: Odd multipliers, one for each position.
_MULTIPLIERS = _mix(np.arange(1, CHUNKS * CHUNK + 1, dtype=np.uint64) * np.uint64(ROLL[0])) | np.uint64(1)


def signatures(row: np.ndarray, value: np.ndarray, n_rows: int) -> np.ndarray:
    """n_rows x positions bytes: of each set the low bits of the least product with each multiplier; zeros for
    an empty set.  row ascends."""
    out = np.zeros((n_rows, len(_MULTIPLIERS)), np.uint8)
    if len(row):
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        for k, m in enumerate(_MULTIPLIERS):
            least = np.minimum.reduceat(value * m, first)
            out[row[first], k] = (least >> np.uint64(24)).astype(np.uint8)
    return out


def parities(row: np.ndarray, value: np.ndarray, n_rows: int) -> np.ndarray:
    """n_rows x PARITY bytes: bit k tells whether an odd number of a set's shingles fall on k.  Two of these
    never differ in more bits than the sets differ in shingles."""
    out, bits = np.zeros((n_rows, PARITY), np.uint8), 8 * PARITY
    for low in range(0, n_rows, 1024):
        a, b = np.searchsorted(row, (low, low + 1024))
        n = min(1024, n_rows - low)
        place = (row[a:b] - low) * bits + (value[a:b] & np.uint64(bits - 1)).astype(np.int64)
        odd = np.bincount(place, minlength=n * bits) & 1
        out[low : low + n] = np.packbits(odd.astype(np.uint8).reshape(n, bits), axis=1, bitorder="little")
    return out


def chunk_keys(signature: np.ndarray) -> np.ndarray:
    """rows x keys: a hash of each chunk without each choice of ERRORS of its positions.

    Two chunks that differ in at most ERRORS positions are equal without these, so they share a key."""
    keys = []
    for c in range(CHUNKS):
        chunk = signature[:, c * CHUNK : (c + 1) * CHUNK].astype(np.uint64)
        for m, kept in enumerate(combinations(range(CHUNK), CHUNK - ERRORS)):
            key = np.full(len(chunk), (c << 8 | m) * MIX[1] & (1 << 64) - 1, np.uint64)
            for k in kept:
                key = key * np.uint64(ROLL[1]) + chunk[:, k]
            keys.append(_mix(key))
    return np.stack(keys, axis=1)


def _prints(docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, h (hash of the text), s1 and s2 (which set it has, in 128 bits), size, marks (signature and
    parities) of each row."""

    def run(batches):
        for batch in batches:
            columns = [[] for _ in range(4)]
            for _, row, value, n_rows in shingle_sets(batch.column(2).to_pylist(), SHINGLE):
                size = np.bincount(row, minlength=n_rows)
                ends = np.cumsum(size)
                got = []
                for salt in ROLL:
                    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(value + np.uint64(salt)), dtype=np.uint64)))
                    got.append((sums[ends] - sums[ends - size]).view(np.int64))
                marks = np.concatenate((signatures(row, value, n_rows), parities(row, value, n_rows)), axis=1)
                for x, y in zip(columns, (*got, size, marks)):
                    x.append(y)
            if not columns[0]:
                continue
            s1, s2, size, marks = map(np.concatenate, columns)
            marks = pa.array([m.tobytes() for m in marks], pa.binary())
            rest = [pa.array(s1), pa.array(s2), pa.array(size.astype(np.int64)), marks]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *rest], ["doc_id", "h", "s1", "s2", "size", "marks"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    schema = f"doc_id {kind}, h bigint, s1 bigint, s2 bigint, size bigint, marks binary"
    return materialise(read.mapInArrow(run, schema), "minhash-prints", folder)


def _signatures(marks: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(marks), np.uint8).reshape(len(marks), -1)[:, :-PARITY]


def _parities(marks: list[bytes]) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b"".join(marks), np.uint8).reshape(len(marks), -1)[:, -PARITY:]).view("<u8")


def _maybe(signature: tuple, parity: tuple, size: tuple) -> np.ndarray:
    """Which pairs of sets, given by two arrays each, may be links: by signatures and by parities."""
    top, bottom = SIMILARITY
    near = (signature[0] != signature[1]).sum(axis=1) <= FARTHEST
    apart = np.bitwise_count(parity[0] ^ parity[1]).sum(axis=1, dtype=np.int64)
    return near & (apart * (top + bottom) <= (size[0] + size[1]) * (bottom - top))


def _shared_keys(sets: DataFrame, folder: str) -> DataFrame:
    """id, size, key, at (which of a set's keys): of each set the keys that another set has too.

    A filter of 16 MB at most leaves out nearly all keys of one set only before anything is moved."""

    def every(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(chunk_keys(_signatures(batch.column(0).to_pylist())).ravel().view(np.int64))], ["key"])

    keys = sets.select("marks").mapInArrow(every, "key long")
    many = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    many = materialise(many, "minhash-many", folder)
    known = sets.sparkSession.sparkContext.broadcast(Filter(many, many.count()))

    def some(batches):
        for batch in batches:
            keys = chunk_keys(_signatures(batch.column(2).to_pylist()))
            row, at = np.nonzero(known.value.has(keys))
            taken = [batch.column(k).take(pa.array(row)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(keys[row, at].view(np.int64)), pa.array(at)], ["id", "size", "key", "at"])

    found = sets.select("id", "size", "marks").mapInArrow(some, "id long, size long, key long, at long")
    return materialise(found, "minhash-keys", folder)


def _alike(a, b):
    """Whether sets of these sizes can be as similar; columns or arrays."""
    top, bottom = SIMILARITY
    return (a * bottom >= b * top) & (b * bottom >= a * top)


def _near(pairs: DataFrame, sets: DataFrame, folder: str) -> DataFrame:
    """Of the pairs (u, v) those whose signatures are not too far apart."""
    pairs = materialise(pairs, "minhash-stars", folder)
    one, two = (sets.select(F.col("id").alias(c), F.col("marks").alias(f"m_{c}"), F.col("size").alias(f"n_{c}")) for c in "uv")

    def run(batches):
        for batch in batches:
            marks, size = [batch.column(k).to_pylist() for k in (2, 3)], tuple(batch.column(k).to_numpy() for k in (4, 5))
            use = _maybe(tuple(map(_signatures, marks)), tuple(map(_parities, marks)), size)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["u", "v"]).filter(pa.array(use))

    both = join_salted(pairs, two, "v", "u", folder=folder).join(one, "u")
    return both.select("u", "v", "m_u", "m_v", "n_u", "n_v").mapInArrow(run, "u long, v long")


def _row_key() -> Column:
    return F.xxhash64("h", "doc_id")


def _confirmed(pairs: DataFrame, sets: DataFrame, docs: DataFrame, folder: str) -> DataFrame:
    """Of the pairs (u, v) of sets those that are links, from the shingles of one whole text of each set.

    Texts are picked where they lie by a filter of row keys, so only those of candidates are moved."""
    pairs = materialise(pairs, "minhash-pairs", folder)
    used = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    wanted = sets.join(used, "id", "left_semi").select("id", "h", "doc_id").withColumn("digest", _row_key())
    wanted = materialise(wanted.drop("doc_id"), "minhash-wanted", folder)
    bits = filter_bits(wanted.count())
    read = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").select(_row_key().alias("digest"), "h", "text")
    read = probe(read, hit_filter(wanted, bits), bits).where("may_hit").drop("may_hit")
    texts = materialise(read.dropDuplicates(["digest", "h"]).join(wanted, ["digest", "h"]).select("id", "text"), "minhash-texts", folder)
    one, two = (texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}")) for c in "uv")

    def run(batches):
        for batch in batches:
            found = pa.array(list(similar_rows(batch, SHINGLE)), pa.bool_())
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["u", "v"]).filter(found)

    both = join_salted(pairs, two, "v", "u", folder=folder).join(one, "u").select("u", "v", "text_u", "text_v")
    links = materialise(both.mapInArrow(run, "u long, v long"), "minhash-links")
    discard(docs.sparkSession, folder)
    return links


def _apart_in_units(rows: list[np.ndarray], step: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a unit's sets that lie in different components and may be links; of a pair's common keys only
    the first reports it."""
    unit, side, ids, root, size, at, marks = rows
    marks = marks.tolist()
    signature, parity, found = _signatures(marks), _parities(marks), [np.zeros((0, 2), np.int64)]
    keys = None  # of each set once, when a pair needs them
    for i, j in tile_pairs(unit, side):
        use = (root[i] != root[j]) & _alike(size[i], size[j])
        i, j = i[use], j[use]
        for k in range(0, len(i), step):
            a, b = i[k : k + step], j[k : k + step]
            use = _maybe((signature[a], signature[b]), (parity[a], parity[b]), (size[a], size[b]))
            a, b = a[use], b[use]
            if not len(a):
                continue
            keys = chunk_keys(signature) if keys is None else keys
            first = (keys[a] == keys[b]).argmax(axis=1) == at[a]
            a, b = ids[a[first]], ids[b[first]]
            found.append(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1))
    pairs = np.concatenate(found)
    return pairs[:, 0], pairs[:, 1]


def minhash_components(docs: DataFrame, tile: int = 2048) -> DataFrame:
    """One row per document: doc_id, h (hash of the text), n_shingles, component_id (smallest doc_id reachable).

    A document's set are its distinct shingles of two words (A-Z in lower case, words cut at space and
    0x09-0x0D); one word is one shingle, and without words the set is empty and linked with nothing.
    Links join sets with a Jaccard similarity of 0.8 or more.

    1. Equal sets (told apart by 128 bits) are collapsed; a set's signature are the low 8 bits of its least
       hash at each of 78 positions.
    2. Multi-index join: signatures are split into 13 chunks of 6 positions.  Two at most 25 positions apart
       have a chunk with at most one error, and meet at one of the six keys that leave a position out: that
       is sure.  At a similarity of 0.8, a position differs with probability 0.2: 99.6 % of such pairs are
       within 25, and as pairs farther apart meet wherever a chunk has at most one error, all but 1 in 10^6
       of the pairs at exactly 0.8 meet (0.345^13), and of those at 0.85 all but 4 in 10^9.  Of these,
       signatures more than 34 apart are passed over (6 in 10^7 at exactly 0.8), and, surely no links,
       those whose bitmaps of parities differ in more bits than similar sets can differ in shingles.
    3. Each set is compared with the least and the last of those with which it shares a key; links are
       confirmed on the sets of whole texts (shingles by 64 bits).  Sets that share a key and are still in
       different components are compared in tiles, and what may be a link is confirmed.

    What is written grows with the documents, the links and the pairs that just fail to be links; keys that
    many sets have are spread over tasks.  A null doc_id is passed over by component_id (null if there is no
    other); rows that repeat are rows of their own; other columns are not read; an empty table gives an empty
    table.  The result is a table in the shared folder.
    """
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    kept, work, stage = (scratch_dir(spark, f"minhash-{c}") for c in ("kept", "work", "stars"))
    prints = _prints(docs, kept)
    row = F.min(F.struct("doc_id", "h", "size", "marks")).alias("row")
    sets = prints.where("size > 0").groupBy("s1", "s2").agg(row, F.min("doc_id").alias("first"), F.count("*").alias("n"))
    sets = sets.select("s1", "s2", "row.*", "first", "n", F.monotonically_increasing_id().alias("id"))
    sets = materialise(sets, "minhash-sets", kept)
    keys = _shared_keys(sets, work)

    one = F.struct("id", "size")
    lead = keys.groupBy("key").agg(F.count("*").alias("n"), F.min(one).alias("least"), F.max(one).alias("most")).where("n > 1")
    lead = materialise(lead, "minhash-leads", work)
    stars = join_hot(keys, lead, ["key"], "n").select("id", "size", F.explode(F.array("least", "most")).alias("lead"))
    stars = stars.where((F.col("id") != F.col("lead.id")) & _alike(F.col("size"), F.col("lead.size")))
    stars = stars.select(F.col("id").alias("u"), F.col("lead.id").alias("v")).distinct()
    links = _confirmed(_near(stars, sets, stage), sets, docs, stage)

    first = connected_components(links).withColumnRenamed("u", "id")
    rooted = keys.join(first, "id", "left").withColumn("root", F.coalesce("root", "id"))
    rooted = materialise(rooted, "minhash-rooted", work)
    mixed = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("total"))
    mixed = materialise(mixed.where("least <> most").select("key", "total"), "minhash-mixed", work)
    # Sizes of similar sets lie in the same class or in neighbouring ones.
    pop = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(SIMILARITY[1] / SIMILARITY[0])) + 1e-9).cast("int")
    open_ = join_hot(rooted, mixed, ["key"], "total").join(sets.select("id", "marks"), "id")
    open_ = open_.select(F.col("key").alias("band"), "total", pop.alias("pop"), F.col("id").alias("fp"), "root", "size", "at", "marks")
    units = tiled_units(materialise(open_, "minhash-open", work), 1, tile)
    more = materialise(compare_units(units, _apart_in_units), "minhash-apart", work)
    more = _confirmed(more, sets, docs, scratch_dir(spark, "minhash-tiles"))

    roots = connected_components(first.select(F.col("id").alias("u"), F.col("root").alias("v")).unionByName(more))
    named = sets.select("s1", "s2", "id", "first", "n").join(roots.withColumnRenamed("u", "id"), "id", "left")
    named = named.withColumn("root", F.coalesce("root", "id"))
    named = materialise(named, "minhash-named", work)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("m"))
    named = join_hot(named, materialise(least, "minhash-least", work), ["root"], "m").select("s1", "s2", "n", "component_id")
    full = join_hot(prints.where("size > 0"), materialise(named, "minhash-ids", work), ["s1", "s2"], "n")
    none = prints.where("size = 0").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "h", F.col("size").alias("n_shingles"), "component_id"]
    found = materialise(full.select(*columns).unionByName(none.select(*columns)), "minhash-found")
    for folder in (kept, work):
        discard(spark, folder)
    return found


def op13_minhash_multi_index(spark, sf_dir: str) -> DataFrame:
    """Set size and near-duplicate component of every document."""
    found = minhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
