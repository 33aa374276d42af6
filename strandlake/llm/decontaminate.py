"""Benchmark decontamination: a prefix-filtered join of item windows with whole documents."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .exact_dedup import filter_bits, hit_filter, probe
from .shared import discard, lean, materialise, scratch_dir
from .substring_dedup import chunks, word_hashes

#: Words of a window, and of the shingles that are ordered by rarity.
WINDOW, SHINGLE = 10, 3
#: Candidates that are verified at a time.
CELLS = 1 << 20
#: Bytes that end a word: 0x00-0x2F, 0x3A-0x60 but the letters, 0x7B-0x7F; A-Z become a-z.
_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


def hashed_words(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after the other, and where each text begins (and the end)."""
    starts, words = word_hashes(b"\n".join(raws).translate(_TABLE))
    return words, np.searchsorted(starts, np.cumsum([0] + [len(r) + 1 for r in raws]))


def _lookup(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value in the sorted array known, -1 where it isn't there."""
    if not len(known):
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


class Block:
    """Windows of a block of items in flat arrays: about 45 bytes for each word of the items.

    Words are numbered over the block; ids has those of all items, one after the other; window w is
    ids[at[w] : at[w] + size[w]] and occurs in the items owner[owners[w] : owners[w + 1]].
    """

    def __init__(self, items: list[tuple[str, str]]):
        self.names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        words, bounds = hashed_words([text.encode("utf-8", "replace") for _, text in items])
        self.vocabulary, ids = np.unique(words, return_inverse=True)
        self.ids, self.base = ids.astype(np.int32), len(self.vocabulary) + 1
        n = np.diff(bounds)
        each = np.where(n > 0, np.maximum(1, n - WINDOW + 1), 0)
        item = np.repeat(np.arange(len(items)), each)
        at = np.arange(len(item)) - np.repeat(np.cumsum(each) - each, each) + bounds[:-1][item]
        size = np.minimum(n[item], WINDOW)
        padded = np.concatenate((self.ids, np.full(WINDOW, -1, np.int32)))
        whole = np.stack([np.where(k < size, padded[at + k], -1) for k in range(WINDOW)], axis=1).astype(np.int32)
        _, first, same = np.unique(whole.view([("", np.int32)] * WINDOW).ravel(), return_index=True, return_inverse=True)
        self.at, self.size = at[first].astype(np.int32), size[first].astype(np.int8)
        owner = np.unique(same.astype(np.int64) << 32 | np.array([number[name] for name, _ in items], np.int64)[item])
        self.owner, self.owners = (owner & 0xFFFFFFFF).astype(np.int32), np.searchsorted(owner >> 32, np.arange(len(first) + 1))
        self.shingles = {}
        for k in np.unique(np.minimum(self.size, SHINGLE)).tolist():
            mine = self.at[np.minimum(self.size, SHINGLE) == k]
            reach = (WINDOW if k == SHINGLE else k) - k + 1
            codes = self.codes(np.concatenate((self.ids, np.full(WINDOW, -1, np.int32))), k)
            self.shingles[k] = np.unique(np.concatenate([codes[mine + j] for j in range(reach)]))
            self.shingles[k] = self.shingles[k][self.shingles[k] >= 0]
        self.prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def number(self, words: np.ndarray) -> np.ndarray:
        return _lookup(self.vocabulary, words)

    def codes(self, ids: np.ndarray, size: int) -> np.ndarray:
        """A number for each shingle; -1 where it has a word that no item has.

        Past 63 bits numbers wrap and may coincide, which costs a verification but loses nothing.
        """
        n = max(0, len(ids) - size + 1)
        code, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(size):
            part = ids[k : k + n].astype(np.int64)
            code, known = code * self.base + part, known & (part >= 0)
        return np.where(known, code & np.iinfo(np.int64).max, -1)

    def choose(self, counts: dict[int, np.ndarray]) -> None:
        """Prefix of each window: for containment of all its shingles the rarest one is enough.

        counts: for each shingle size, how often each of shingles occurs in all documents."""
        padded = np.concatenate((self.ids, np.full(WINDOW, -1, np.int32)))
        for size, known in self.shingles.items():
            mine = np.flatnonzero(np.minimum(self.size, SHINGLE) == size)
            codes = self.codes(padded, size)
            best, code, offset = np.full(len(mine), np.iinfo(np.int64).max), np.zeros(len(mine), np.int64), np.zeros(len(mine), np.int8)
            for k in range(WINDOW - size + 1):
                inside = k + size <= self.size[mine]
                c = np.where(inside, codes[np.minimum(self.at[mine] + k, len(codes) - 1)], 0)
                n = np.where(inside, counts[size][np.maximum(_lookup(known, c), 0)], np.iinfo(np.int64).max)
                less = inside & ((n < best) | ((n == best) & (c < code)))
                best, code, offset = np.where(less, n, best), np.where(less, c, code), np.where(less, np.int8(k), offset)
            order = np.argsort(code, kind="stable")
            self.prefix[size] = (code[order], mine[order].astype(np.int32), offset[order])
        self.shingles = dict.fromkeys(self.shingles)

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where windows occur in a sequence of numbered words (-1: no item's word): starts, ends, windows."""
        out = [(np.zeros(0, np.int64),) * 3]
        for size, (keys, window, offset) in self.prefix.items():
            codes = self.codes(ids, size)
            place = np.flatnonzero(codes >= 0)
            low, high = np.searchsorted(keys, codes[place]), np.searchsorted(keys, codes[place], side="right")
            place, low, n = place[high > low], low[high > low], (high - low)[high > low]
            begin = 0
            while begin < len(place):
                end = max(begin + 1, begin + int(np.searchsorted(np.cumsum(n[begin:]), CELLS)))
                some = n[begin:end]
                at = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some) + np.repeat(low[begin:end], some)
                w, start = window[at], np.repeat(place[begin:end], some) - offset[at]
                use = (start >= 0) & (start + self.size[w] <= len(ids))
                w, start = w[use], start[use]
                for k in range(WINDOW):
                    use = (k >= self.size[w]) | (ids[np.minimum(start + k, len(ids) - 1)] == self.ids[np.minimum(self.at[w] + k, len(self.ids) - 1)])
                    w, start = w[use], start[use]
                out.append((start, start + self.size[w], w.astype(np.int64)))
                begin = end
        return tuple(map(np.concatenate, zip(*out)))


def _numbered(block: Block, texts: list):
    """Of neighbouring texts at a time: number of the first, words of each, and their numbered words with
    a -1 after each text."""
    for at, raws in chunks(texts):
        words, bounds = hashed_words(raws)
        ids = np.insert(block.number(words), bounds[1:], -1)
        yield at, np.diff(bounds), ids


def _count_shingles(docs: DataFrame, block, shingles: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Occurrences of the block's shingles over all documents; as many counts as the block has shingles."""

    def count(batches):
        b = block.value
        totals = {size: np.zeros(len(c), np.int64) for size, c in b.shingles.items()}
        for batch in batches:
            for _, _, ids in _numbered(b, batch.column(0).to_pylist()):
                for size, known in b.shingles.items():
                    found = _lookup(known, b.codes(ids, size))
                    totals[size] += np.bincount(found[found >= 0], minlength=len(known))
        for size, n in totals.items():
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(seen), size, np.int32)), pa.array(seen), pa.array(n[seen])], ["size", "at", "n"]
            )

    found = docs.select("text").mapInArrow(lean(count), "size int, at long, n long").groupBy("size", "at").agg(F.sum("n").alias("n"))
    totals = {size: np.zeros(len(c), np.int64) for size, c in shingles.items()}
    table = found.toArrow()
    size, at, n = (table.column(k).to_numpy() for k in range(3))
    for s, total in totals.items():
        total[at[size == s]] = n[size == s]
    return totals


SPANS = "array<struct<start:int,end:int>>"
#: Arrow types of n_words, spans and items.
_ARROW = [pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string())]
#: A word of a text in which A-Z still are A-Z.
_CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = 4 << 20) -> DataFrame:
    """Find benchmark items in whole documents: adds n_words, spans and items (columns of these names are replaced).

    A window is ten consecutive words of an item, or all of a shorter item.  Its three-word shingles
    are ordered by how often they occur in all documents; the rarest joins with the documents' own
    shingles, its place bounds where the window can start and end, and the window is then verified
    word for word (words are told apart by 64 bits).  spans are the merged ranges [start, end) of words
    inside any occurrence; items the sorted names of the items that occur.

    Distinct items are collected in blocks of about block_bytes of text, or one longer item: as many
    blocks as the benchmark needs.  What is broadcast is about 45 bytes for each word of a block, 36 MB
    at the default.  One block is at work at a time; with several, each writes only the spans and items
    of the texts that it hits, by their digests, and documents join these once.  Documents are neither
    written nor collected, and only those that hits may belong to are shuffled.  Null texts have no words;
    items without words have no windows; a null item_id counts as an empty name, items of equal names as
    one; an empty benchmark marks nothing.
    """
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.coalesce("text", F.lit("")).alias("text")
    ).distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-total // block_bytes))
    docs = docs.drop("n_words", "spans", "items")
    if n_blocks > 1:
        return _mark_by_blocks(docs, items, n_blocks)
    schema = T.StructType(docs.schema.fields + T.StructType.fromDDL(f"n_words long, spans {SPANS}, items array<string>").fields)
    return docs.mapInArrow(lean(_marker(_broadcast(docs, items), docs.columns.index("text"))), schema)


def _broadcast(docs: DataFrame, items: DataFrame):
    """A block of the items, whose prefixes are chosen by all documents."""
    context = docs.sparkSession.sparkContext
    block = Block([tuple(r) for r in items.collect()])
    shared = context.broadcast(block)
    block.choose(_count_shingles(docs, shared, block.shingles))
    shared.unpersist()
    return context.broadcast(block)


def _mark_by_blocks(docs: DataFrame, items: DataFrame, n_blocks: int) -> DataFrame:
    spark, schema = docs.sparkSession, f"digest string, spans {SPANS}, items array<string>"
    folder = scratch_dir(spark, "marks")
    for k in range(n_blocks):
        block = _broadcast(docs, items.where(F.pmod(F.xxhash64("name", "text"), F.lit(n_blocks)) == k))
        materialise(docs.select("text").mapInArrow(lean(_finder(block)), schema), f"block={k}", folder)
        block.unpersist()
    found = spark.read.schema(f"{schema}, block string").parquet(folder)
    # Copies of a text have equal marks: one of each block is enough.
    one = found.groupBy("digest", "block").agg(F.first("spans").alias("spans"), F.first("items").alias("items"), F.count("*").alias("n"))
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
    together = one.groupBy("digest").agg(F.flatten(F.collect_list("spans")).alias("spans"), names.alias("items"), F.max("n").alias("n"))
    marks = materialise(together.mapInArrow(lean(_merge_spans), together.schema), "marked-texts")
    discard(spark, folder)

    # Other columns get names that nothing here has.
    names = [c if c == "text" else f"__kept_{k}" for k, c in enumerate(docs.columns)]
    size, rows = marks.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = filter_bits(size)
    after = dict(zip(names, docs.columns))
    docs = probe(docs.toDF(*names).withColumn("digest", F.sha2("text", 256)), hit_filter(marks, bits), bits)
    may, few = docs.where("may_hit"), F.col("n") * 4096 <= rows
    # Texts with more than a 4,096th of the marked rows are fewer than 4,096: their marks go to their rows.
    hot = F.broadcast(marks.where(~few))
    known = may.join(hot, "digest").unionByName(may.join(hot.select("digest"), "digest", "left_anti").join(marks.where(few), "digest", "left"))
    out = known.unionByName(docs.where("NOT may_hit"), allowMissingColumns=True)
    return out.select(
        *[F.col(n).alias(c) for n, c in after.items()],
        F.coalesce(F.regexp_count("text", F.lit(_CASED_WORD)), F.lit(0)).cast("long").alias("n_words"),
        F.coalesce("spans", F.array().cast(SPANS)).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def _marks(block, texts: list):
    """Of a batch's texts: the words of each, and its merged spans and sorted items by place, where it has any."""
    counts, spans, names = [], {}, {}
    for first, n, ids in _numbered(block, texts):
        counts += n.tolist()
        begin = np.cumsum(n + 1) - n - 1
        start, end, window = block.find(ids)
        row = np.searchsorted(begin, start, side="right") - 1
        for r in np.unique(row).tolist():
            mine = row == r
            edges = np.zeros(n[r] + 2, np.int64)
            np.add.at(edges, start[mine] - begin[r] + 1, 1)
            np.add.at(edges, end[mine] - begin[r] + 1, -1)
            cuts = np.flatnonzero(np.diff((np.cumsum(edges) > 0).view(np.int8))).tolist()
            spans[first + r] = [{"start": s, "end": e} for s, e in zip(cuts[::2], cuts[1::2])]
            w = np.unique(window[mine])
            names[first + r] = sorted({block.names[o] for x in w.tolist() for o in block.owner[block.owners[x] : block.owners[x + 1]].tolist()})
    return counts, spans, names


def _marker(block, text_at: int):
    """Documents with what a block marks in them."""

    def mark(batches):
        for batch in batches:
            counts, spans, names = _marks(block.value, batch.column(text_at).to_pylist())
            rows = range(len(counts))
            fresh = [counts, [spans.get(r, []) for r in rows], [names.get(r, []) for r in rows]]
            arrays = [pa.array(x, t) for x, t in zip(fresh, _ARROW)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, "n_words", "spans", "items"])

    return mark


def _finder(block):
    """Digest, spans and items of the texts that a block hits."""

    def find(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            _, spans, names = _marks(block.value, texts)
            digests = [hashlib.sha256(texts[r].encode()).hexdigest() for r in spans]
            arrays = [pa.array(digests, pa.string()), pa.array(list(spans.values()), _ARROW[1]), pa.array([names[r] for r in spans], _ARROW[2])]
            yield pa.RecordBatch.from_arrays(arrays, ["digest", "spans", "items"])

    return find


def _merge_spans(batches):
    """Spans of several blocks, in any order, to ranges that neither touch nor overlap."""
    for batch in batches:
        at, out = batch.schema.get_field_index("spans"), []
        for spans in batch.column(at).to_pylist():
            merged = []
            for s in sorted(spans, key=lambda s: s["start"]):
                if merged and s["start"] <= merged[-1]["end"]:
                    merged[-1]["end"] = max(merged[-1]["end"], s["end"])
                else:
                    merged.append(dict(s))
            out.append(merged)
        columns = [pa.array(out, _ARROW[1]) if k == at else c for k, c in enumerate(batch.columns)]
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)


def op9_prefix_filtered_decontamination(spark, sf_dir: str) -> DataFrame:
    """Per document how many words benchmark windows hit, and which items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = mark_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return marked.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
