"""Near copies by the Jaccard similarity of word shingles, on op6's tiles of fingerprints.

SimHash bits bound no Jaccard similarity, so the fingerprint here is a bitmap of parities: bit k tells
whether an odd number of a set's shingles fall on k.  Two bitmaps never differ in more bits than the
sets differ in shingles, so exclusive-or and bit counts skip pairs and lose none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .exact_dedup import filter_bits, hit_filter, probe
from .shared import discard, join_salted, lean, materialise, scratch_dir
from .simhash import _spanning, compare_units, linked_fingerprints, simhash, tile_pairs, tiled_units
from .substring_dedup import ROLL, Filter, _each, _mix, chunks, word_hashes

SHINGLE = 5
#: Jaccard similarity from which two texts are near copies, as a fraction of whole numbers.
SIMILARITY = (4, 5)
#: Counters of the sketch that orders shingles by how common they are; 64-bit words of a parity bitmap.
SLOTS, WORDS = 1 << 19, 4
#: Words of the wider bitmaps of sets that are held whole; most such sets on a side.
WIDE, HELD = 32, 256
_BITS = [f"b{k}" for k in range(WORDS)]


def shingle_sets(texts: list | pa.Array, shingle: int = SHINGLE):
    """Of neighbouring texts at a time: number of the first, row (the text of each value, counted from
    it), value (distinct shingle hashes, ascending in each text), n_rows.

    A-Z become lower case; words end at space and 0x09-0x0D; a text of fewer words is one shingle; a
    text without words (or null) has none.
    """
    for at, raws in chunks(texts):
        starts, words = word_hashes(b"\n".join(raws).lower())
        bounds = np.searchsorted(starts, np.cumsum([0] + [len(r) + 1 for r in raws]))
        begin, n = bounds[:-1], np.diff(bounds)
        size = np.clip(n - shingle + 1, np.minimum(n, 1), None)
        row = np.repeat(np.arange(len(raws)), size)
        place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + begin[row]
        value = np.zeros(len(row), np.uint64)
        for k in range(shingle):
            inside = k < n[row]
            value[inside] = value[inside] * np.uint64(ROLL[0]) + words[place[inside] + k]
        value = _mix(value ^ np.minimum(n[row], shingle).astype(np.uint64))
        order = np.lexsort((value, row))
        row, value = row[order], value[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        yield at, row[new], value[new], len(raws)


def parities(row: np.ndarray, value: np.ndarray, n_rows: int, words: int = WORDS) -> np.ndarray:
    """n_rows x words (a power of two) signed words: the parity bitmap of each set."""
    out = np.zeros((n_rows, words), np.int64)
    top = np.uint64(65 - (64 * words).bit_length())
    for low in range(0, n_rows, 1024):
        a, b = np.searchsorted(row, (low, low + 1024))
        n = min(1024, n_rows - low)
        odd = np.bincount((row[a:b] - low) * 64 * words + (value[a:b] >> top).astype(np.int64), minlength=n * 64 * words) & 1
        out[low : low + n] = np.packbits(odd.astype(np.uint8).reshape(n, -1), axis=1, bitorder="little").view("<i8")
    return out


def _slot(value: np.ndarray) -> np.ndarray:
    """Slot of each shingle, from bits that neither the filter of entries nor the parities use."""
    return (value >> np.uint64(32) & np.uint64(SLOTS - 1)).astype(np.int64)


def _counters(docs: DataFrame) -> np.ndarray:
    """How many shingles of all documents fall on each slot of a sketch of fixed size.

    It only orders the shingles, so that the filter seldom meets common ones; no link depends on it.
    """

    def run(batches):
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, _, value, _ in shingle_sets(batch.column(0)):
                total += np.bincount(_slot(value), minlength=SLOTS)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(total[slot])], ["slot", "n"])

    found = docs.select("text").mapInArrow(lean(run), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(SLOTS, np.int64)
    total[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return total


def _prefixes(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), fp (op6's SimHash fingerprint), sig (hash of its shingle set), size,
    parity words, and the rarest shingles toks.

    Two sets of at least the similarity share one of their size - ceil(similarity * size) + 1 first
    shingles, whatever order all sets keep.
    """
    counters = docs.sparkSession.sparkContext.broadcast(_counters(docs))
    top, bottom = SIMILARITY

    def run(batches):
        for batch in batches:
            columns = [[] for _ in range(4)]
            for _, row, value, n_rows in shingle_sets(batch.column(2)):
                size = np.bincount(row, minlength=n_rows)
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(value + np.uint64(ROLL[1])), dtype=np.uint64)))
                ends = np.cumsum(size)
                sig = np.where(size > 0, sums[ends] - sums[ends - size], np.uint64(0)).view(np.int64)
                often = counters.value[_slot(value)]
                ranked = np.lexsort((value, often, row))
                first = np.arange(len(row)) - np.repeat(ends - size, size) < np.repeat(size - -(-top * size // bottom) + 1, size)
                for x, got in zip(columns, (sig, size, parities(row, value, n_rows), value[ranked[first]].view(np.int64))):
                    x.append(got)
            if not columns[0]:
                continue
            sig, size, bits, toks = map(np.concatenate, columns)
            counts = np.where(size > 0, size - -(-top * size // bottom) + 1, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(toks))
            fp = pa.array([simhash(t) for t in _each(batch.column(2))], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), fp, pa.array(sig), pa.array(size.astype(np.int32)), *[pa.array(b) for b in bits.T.copy()], lists],
                ["doc_id", "h", "fp", "sig", "size", *_BITS, "toks"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    words = ", ".join(f"{b} bigint" for b in _BITS)
    return read.mapInArrow(lean(run), f"doc_id {kind}, h bigint, fp bigint, sig bigint, size int, {words}, toks array<bigint>")


def _distinct_sets(prints: DataFrame, folder: str) -> DataFrame:
    """One row for each sig.  Rows whose sig is the only one stay where they are; a filter picks the others."""
    again = prints.groupBy(F.col("sig").alias("key")).agg(F.count("*").alias("n")).where("n > 1").select("key")
    again = materialise(again, "near-again", folder)
    known = Filter(again, again.count())
    keyed = prints.withColumn("key", F.col("sig"))
    return sifted(keyed, known, inside=False).unionByName(sifted(keyed, known).dropDuplicates(["sig"])).drop("key")


def _entries(sets: DataFrame, folder: str) -> DataFrame:
    """sig, size, pos, tok: the places of those rarest shingles that more than one set has.

    A filter of 16 MB at most leaves out nearly all others before anything is moved.
    """
    many = sets.select(F.explode("toks").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    many = materialise(many, "near-shared", folder)
    known = sets.sparkSession.sparkContext.broadcast(Filter(many, many.count()))

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            n, toks = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
            use = known.value.has(toks.view(np.uint64))
            row = np.repeat(np.arange(len(n)), n)[use]
            pos = (np.arange(len(toks)) - np.repeat(np.cumsum(n) - n, n))[use]
            taken = [batch.column(k).take(pa.array(row)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(pos.astype(np.int32)), pa.array(toks[use])], ["sig", "size", "pos", "tok"])

    return sets.select("sig", "size", "toks").mapInArrow(lean(run), "sig bigint, size int, pos int, tok bigint")


def _alike(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can be as similar."""
    top, bottom = SIMILARITY
    return F.least(a, b) * bottom >= F.greatest(a, b) * top


def _bit_filter(pairs: DataFrame, sets: DataFrame, folder: str) -> DataFrame:
    """Of the pairs (u, v) of sets, those whose parities differ in few enough bits; many may name one v."""
    top, bottom = SIMILARITY
    pairs = materialise(pairs, "near-stars", folder)
    one, two = (sets.select(F.col("sig").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("size", *_BITS)]) for c in "uv")
    apart = sum((F.bit_count(F.col(f"{b}_u").bitwiseXOR(F.col(f"{b}_v"))) for b in _BITS[1:]), F.bit_count(F.col("b0_u").bitwiseXOR(F.col("b0_v"))))
    near = apart * (top + bottom) <= (F.col("size_u") + F.col("size_v")) * (bottom - top)
    return join_salted(pairs.join(one, "u"), two, "v", "u", folder=folder).where(near).select("u", "v")


def row_key() -> Column:
    """Which text (h) of which document a row is, in 64 bits."""
    return F.xxhash64("h", "doc_id")


def sifted(docs: DataFrame, known: Filter, inside: bool = True) -> DataFrame:
    """Rows whose key is in the filter (and a few that it takes for such), or all the others."""
    shared = docs.sparkSession.sparkContext.broadcast(known)
    at = docs.columns.index("key")

    def run(batches):
        for batch in batches:
            found = shared.value.has(batch.column(at).to_numpy(zero_copy_only=False).view(np.uint64))
            yield batch.filter(pa.array(found == inside))

    return docs.mapInArrow(lean(run), docs.schema)


def similar_rows(batch, shingle: int = SHINGLE, step: int = 256):
    """Which rows (u, v, text_u, text_v) are similar enough; sets of step rows are held at a time."""
    top, bottom = SIMILARITY
    for low in range(0, batch.num_rows, step):
        u, v, text_u, text_v = (c.to_pylist() for c in batch.slice(low, step).columns)
        texts = dict(zip(u, text_u)) | dict(zip(v, text_v))
        sets, names = {}, list(texts)
        for at, row, value, n_rows in shingle_sets(list(texts.values()), shingle):
            cuts = np.searchsorted(row, np.arange(n_rows + 1)).tolist()
            sets |= {names[at + k]: value[x:y] for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:]))}
        for pair in zip(u, v):
            x, y = sorted((sets[k] for k in pair), key=len)
            both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            yield both * bottom >= (len(x) + len(y) - both) * top


def _texts(used: DataFrame, sets: DataFrame, docs: DataFrame, folder: str) -> DataFrame:
    """sig, text: one text for each of the used sets; a filter picks them where they lie."""
    wanted = materialise(sets.join(used, "sig", "left_semi").select("sig", "h", row_key().alias("digest")), "near-wanted", folder)
    bits = filter_bits(wanted.count())
    read = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").select(row_key().alias("digest"), "h", "text")
    read = probe(read, hit_filter(wanted, bits), bits).where("may_hit").drop("may_hit")
    read = read.dropDuplicates(["digest", "h"]).join(wanted, ["digest", "h"])
    return materialise(read.select("sig", "text"), "near-texts", folder)


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, folder: str) -> DataFrame:
    """Of the pairs (u, v) of sets, those whose Jaccard similarity is high enough, from the texts.

    Only texts of these sets are moved, one for each set.  The folder, with all that the pairs are made
    from, is removed when the links are written.
    """
    pairs = materialise(pairs, "near-pairs", folder)
    texts = _texts(pairs.select(F.explode(F.array("u", "v")).alias("sig")).distinct(), sets, docs, folder)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["u", "v"]).filter(pa.array(list(similar_rows(batch)), pa.bool_()))

    one, two = (texts.select(F.col("sig").alias(c), F.col("text").alias(f"text_{c}")) for c in "uv")
    # Many pairs may name one v, so texts of u come last: they are not moved again.
    both = join_salted(pairs, two, "v", "u", folder=folder).join(one, "u").select("u", "v", "text_u", "text_v")
    links = materialise(both.mapInArrow(lean(run), "u bigint, v bigint"), "near-links")
    discard(docs.sparkSession, folder)
    return links


def _simhash_links(prints: DataFrame, radius: int, tile: int, folder: str) -> DataFrame:
    """Links (u, v) that join all sets with fingerprints at most radius bits apart: op6's tiles over the
    distinct fingerprints, each told by the least of its sets."""
    both = materialise(prints.select("fp", "sig").distinct(), "near-fp", folder)
    named = materialise(both.groupBy("fp").agg(F.min("sig").alias("least")), "near-fp-least", folder)
    equal = both.join(named, "fp").where("sig <> least").select(F.col("sig").alias("u"), F.col("least").alias("v"))
    one, two = (named.select(F.col("fp").alias(c), F.col("least").alias(f"least_{c}")) for c in "uv")
    near = materialise(linked_fingerprints(named.select("fp"), radius, tile).distinct(), "near-fp-links", folder)
    near = join_salted(near.join(one, "u"), two, "v", "u", folder=folder)
    return equal.unionByName(near.select(F.col("least_u").alias("u"), F.col("least_v").alias("v")))


def _candidates_in_units(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links that join a unit's sets which lie in different components and may be as similar, one for each
    set that is not the first of those joined."""
    top, bottom = SIMILARITY
    unit, side, sig, root, size, pos, *bits = rows
    bits = [b.view(np.uint64) for b in bits]
    label = np.arange(len(sig))
    for i, j in tile_pairs(unit, side):
        i, j = (x[root[i] != root[j]] for x in (i, j))
        # At the first shingle that two sets share, all that they can still share lies behind it in both.
        enough = np.minimum(size[i] - pos[i], size[j] - pos[j]) * (top + bottom) >= (size[i] + size[j]) * top
        i, j = i[enough], j[enough]
        apart = sum((np.bitwise_count(b[i] ^ b[j]).astype(np.int64) for b in bits), np.zeros(len(i), np.int64))
        use = apart * (top + bottom) <= (size[i] + size[j]) * (bottom - top)
        if use.any():
            known = np.flatnonzero(label != np.arange(len(sig)))
            label = _spanning(len(sig), np.concatenate((known, i[use])), np.concatenate((label[known], j[use])))
    moved = np.flatnonzero(label != np.arange(len(sig)))
    return sig[moved], sig[label[moved]]


def _links_in_units(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links between sets that are similar enough and lie in different components, from their texts: one
    for each two components that a unit's sets join, however many pairs join them."""
    unit, side, sig, root, texts = rows
    found = [np.zeros((0, 2), np.int64)]
    cuts = np.flatnonzero(np.diff(unit)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(unit)]):
        found.append(_links_of_unit(unit[a:b], side[a:b], sig[a:b], root[a:b], texts[a:b].tolist()))
    pairs = np.concatenate(found)
    return pairs[:, 0], pairs[:, 1]


def _links_of_unit(unit, side, sig, root, texts: list) -> np.ndarray:
    top, bottom = SIMILARITY
    sets, wide = [], []
    for _, row, value, n_rows in shingle_sets(texts):
        cuts = np.searchsorted(row, np.arange(n_rows + 1)).tolist()
        sets += [value[x:y] for x, y in zip(cuts[:-1], cuts[1:])]
        wide.append(parities(row, value, n_rows, WIDE))
    size, wide = np.array([len(x) for x in sets]), np.concatenate(wide).view(np.uint64)
    parent = np.unique(root, return_index=True, return_inverse=True)
    parent = parent[1][parent[2]].tolist()

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    links = []
    for i, j in tile_pairs(unit, side):
        use = (root[i] != root[j]) & (np.minimum(size[i], size[j]) * bottom >= np.maximum(size[i], size[j]) * top)
        i, j = i[use], j[use]
        apart = np.zeros(len(i), np.int64)
        for k in range(WIDE):
            apart += np.bitwise_count(wide[i, k] ^ wide[j, k])
            use = apart * (top + bottom) <= (size[i] + size[j]) * (bottom - top)
            i, j, apart = i[use], j[use], apart[use]
        order = np.argsort(apart, kind="stable")
        for a, b in zip(i[order].tolist(), j[order].tolist()):
            x, y = find(a), find(b)
            if x != y:
                p, q = sorted((sets[a], sets[b]), key=len)
                both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                if both * bottom >= (len(p) + len(q) - both) * top:
                    parent[max(x, y)] = min(x, y)
                    links.append((max(sig[a], sig[b]), min(sig[a], sig[b])))
    return np.array(links, np.int64).reshape(-1, 2)


def _size_class() -> Column:
    """Sizes of similar sets lie in the same class or in neighbouring ones."""
    return F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(SIMILARITY[1] / SIMILARITY[0])) + 1e-9).cast("int")


def _cluster_links(clusters: DataFrame, first: DataFrame, sets: DataFrame, docs: DataFrame, tile: int, folder: str) -> DataFrame:
    """Links between sets of a cluster that are similar enough and lie in different components.

    clusters: u, root for each set but the least of its cluster; first: sig, root of the components.
    """
    least = clusters.select(F.col("root").alias("sig"), F.col("root").alias("band")).distinct()
    member = materialise(clusters.select(F.col("u").alias("sig"), F.col("root").alias("band")).unionByName(least), "near-clusters", folder)
    total = member.groupBy("band").agg(F.count("*").alias("total"))
    known = member.join(sets.select("sig", "size"), "sig").join(first, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    known = materialise(known.join(total, "band").select("band", "total", _size_class().alias("pop"), F.col("sig").alias("fp"), "root"), "near-members", folder)
    texts = _texts(member.select("sig"), sets, docs, folder).withColumnRenamed("sig", "fp")
    units = tiled_units(known, 1, tile).join(texts, "fp").select("unit", "side", "fp", "root", "text")
    return materialise(compare_units(units, _links_in_units).distinct(), "near-more", folder)


def near_copies(docs: DataFrame, tile: int = 2048, radius: int | None = None) -> DataFrame:
    """One row per document: doc_id, h (hash of the text), root (equal within a component).

    Components of links between texts whose sets of five-word shingles have a Jaccard similarity of
    0.8 or more; a text of fewer words is one shingle, texts without words (or null) are one set.  With
    a radius, texts whose SimHash fingerprints differ in at most so many bits are linked as well, as op6
    links them.  All such links are found, and each of the former is verified by the whole sets:

    1. Fingerprints are compared in op6's tiles.  Bits bound no similarity, so the sets follow.
    2. Equal sets are collapsed.  Two similar sets share one of the rarest shingles of both, so only
       sets with such a shingle in common are compared; sizes and ranks rule out more of them.
    3. Each set is compared with the least and the last of those that share a shingle, which joins most
       of a group.
    4. Sets that share a shingle and are still in different components are compared in tiles by
       exclusive-or and bit counts of their parity bitmaps (tile rows a side, however many share it).
       What may be similar makes clusters, by one link for each set of a tile at most.
    5. Clusters are compared with the texts at hand, large ones in tiles, and give one link for each
       two components that are joined; pairs that fail leave the task as little as those that add nothing.

    So what is written grows with the documents and the links, not with the square of a group; tables
    that are no longer needed are removed, and the result is a table in the shared folder.  Rows
    equal in doc_id and text are one; a null doc_id is an id of its own; other columns are not read; an
    empty table gives an empty table.
    """
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    raw, whole, kept, stage = (scratch_dir(spark, f"near-{c}") for c in ("raw", "whole", "kept", "stars"))
    prints = materialise(_prefixes(docs), "near-prints", raw)
    sets = materialise(_distinct_sets(prints.drop("fp"), raw), "near-sets", whole)
    prints = materialise(prints.select("doc_id", "h", "fp", "sig"), "near-ids", kept)
    discard(spark, raw)
    entries = materialise(_entries(sets, whole), "near-entries", kept)
    sets = materialise(sets.drop("toks"), "near-bits", kept)
    discard(spark, whole)
    one = F.struct("sig", "size")
    lead = entries.groupBy("tok").agg(F.count("*").alias("n"), F.min(one).alias("least"), F.max(one).alias("most")).where("n > 1").drop("n")
    stars = entries.join(lead, "tok").select("sig", "size", F.explode(F.array("least", "most")).alias("lead"))
    stars = stars.where((F.col("sig") != F.col("lead.sig")) & _alike(F.col("size"), F.col("lead.size")))
    stars = stars.select(F.col("sig").alias("u"), F.col("lead.sig").alias("v")).distinct()
    links = _verified(_bit_filter(stars, sets, stage), sets, docs, stage)

    if radius is not None:
        links = links.unionByName(_simhash_links(prints, radius, tile, kept))
    first = connected_components(links).withColumnRenamed("u", "sig")
    rooted = entries.join(first, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    mixed = rooted.groupBy("tok").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("total"))
    mixed = mixed.where("least <> most").select("tok", "total")
    rooted = rooted.join(mixed, "tok").join(sets.select("sig", *_BITS), "sig")
    long = [F.col(c).cast("long").alias(c) for c in ("size", "pos")]
    rooted = materialise(rooted.select(F.col("tok").alias("band"), "total", _size_class().alias("pop"), F.col("sig").alias("fp"), "root", *long, *_BITS), "near-rooted", kept)
    drawn = materialise(compare_units(tiled_units(rooted, 1, tile), _candidates_in_units), "near-drawn", kept)
    more = _cluster_links(connected_components(drawn), first, sets, docs, min(tile, HELD), kept)

    roots = connected_components(first.select(F.col("sig").alias("u"), F.col("root").alias("v")).unionByName(more))
    roots = roots.withColumnRenamed("u", "sig")
    rooted = prints.join(roots, "sig", "left").select("doc_id", "h", F.coalesce("root", "sig").alias("root"))
    rooted = materialise(rooted, "near-roots")
    discard(spark, kept)
    return rooted
