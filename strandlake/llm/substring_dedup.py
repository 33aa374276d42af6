"""Substring deduplication: repeated passages are confirmed, compiled into Aho-Corasick automata and removed."""

from __future__ import annotations

from math import ceil, log2

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exact_dedup import BITMAP
from .shared import join_hot, materialise

#: Words of a window; words of the phrases of which each window picks one.
SPAN, PHRASE = 20, 8
#: Fixed odd multipliers of the rolling hashes, and the mixing constants of a 64-bit finaliser.
ROLL = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Bits of the largest filter that is broadcast (16 MB).
MOST_BITS = 27


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the multipliers and of their inverses modulo 2^64, as far as the longest text needs."""

    def __init__(self):
        self.tables = [(np.ones(1, np.uint64),) * 2 for _ in ROLL]

    def upto(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if len(self.tables[0][0]) <= n:
            size = max(4096, 2 * n)
            self.tables = []
            for r in ROLL:
                both = np.full((2, size), 1, np.uint64)
                both[:, 1:] = np.array([[r], [pow(r, -1, 1 << 64)]], np.uint64)
                self.tables.append(tuple(np.cumprod(both, axis=1, dtype=np.uint64)))
        return self.tables


_powers = _Powers()


def _sliding_least(x: np.ndarray, size: int) -> np.ndarray:
    """Least of each run of size values, by doubling."""
    n, have = len(x) - size + 1, 1
    while 2 * have <= size:
        x, have = np.minimum(x[:-have], x[have:]), 2 * have
    return np.minimum(x[:n], x[size - have : size - have + n])


#: Masks of the first k of 8 little-endian bytes.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer words are hashed one by one.
_LONG = 64


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a text starts and its 64-bit hash, from eight bytes of all words at a time."""
    text = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(text) + 2, bool)
    np.not_equal(text, 32, out=inside[1:-1])
    inside[1:-1] &= (text - np.uint8(9)) > 4
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, size = edges[::2], edges[1::2] - edges[::2]
    if not len(start):
        return start, np.zeros(0, np.uint64)
    eights = np.ndarray(len(raw) + 1, "<u8", raw + bytes(8), strides=(1,))
    h = _mix(size.astype(np.uint64))
    h = _mix(h ^ (eights[start] & _MASK[np.minimum(size, 8)]))
    for k in range(8, min(int(size.max()), _LONG), 8):
        on = np.flatnonzero(size > k)
        h[on] = _mix(h[on] ^ (eights[start[on] + k] & _MASK[np.minimum(size[on] - k, 8)]))
    for w in np.flatnonzero(size > _LONG).tolist():
        h[w] = xxhash.xxh64_intdigest(raw[start[w] : start[w] + size[w]])
    return start, h


def _each(texts, step: int = 256):
    """Texts of a list, or of an Arrow column without having all of them as Python's strings at once."""
    if isinstance(texts, list):
        yield from texts
        return
    for k in range(0, len(texts), step):
        yield from texts.slice(k, step).to_pylist()


def chunks(texts: list | pa.Array, most: int = 1 << 18):
    """(number of the first, encoded texts) of neighbouring texts, about most bytes together."""
    at, held, size = 0, [], 0
    for k, text in enumerate(_each(texts)):
        held.append((text or "").encode("utf-8", "replace"))
        size += len(held[-1])
        if size >= most or k + 1 == len(texts):
            yield at, held
            at, held, size = k + 1, [], 0


class Anchors:
    """Of each window of some texts the phrase with the least hash, the first of equal ones: equal
    windows pick equal phrases.

    row: number of the text; low, high: first and last window that picks a phrase, counted over the
    words of all texts; key: the phrase's hash; begin: where each text's words begin.
    """

    def __init__(self, raws: list[bytes]):
        starts, self.words = word_hashes(b"\n".join(raws))
        self.n = len(self.words)
        offsets = np.cumsum([0] + [len(r) + 1 for r in raws])
        bounds = np.searchsorted(starts, offsets)
        self.begin = bounds[:-1]
        self.row = self.low = self.high = np.zeros(0, np.int64)
        self.key = np.zeros(0, np.uint64)
        if self.n < SPAN:
            return
        text = np.repeat(np.arange(len(raws)), np.diff(bounds))
        window = np.arange(self.n - SPAN + 1)
        window = window[text[: self.n - SPAN + 1] == text[SPAN - 1 :]]
        if not len(window):
            return
        phrase, have = self.words, 1
        while have < PHRASE:  # PHRASE is a power of two
            phrase = phrase[:-have] * np.uint64(pow(ROLL[0], have, 1 << 64)) + phrase[have:]
            have *= 2
        phrase = _mix(phrase)
        bits = np.uint64(self.n.bit_length())
        placed = (phrase >> bits << bits) | np.arange(len(phrase), dtype=np.uint64)
        pick = (_sliding_least(placed, SPAN - PHRASE + 1) & np.uint64((1 << int(bits)) - 1)).astype(np.int64)[window]
        cut = np.flatnonzero((np.diff(pick) != 0) | (np.diff(window) != 1)) + 1
        self.low, self.high = window[np.concatenate(([0], cut))], window[np.concatenate((cut, [len(window)])) - 1]
        self.row = text[self.low]
        self.key = phrase[pick[np.concatenate(([0], cut))]]

    def digests(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of the word sequences [start, end)."""
        out = []
        for power, back in _powers.upto(self.n):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.words * power[: self.n], dtype=np.uint64)))
            out.append(_mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64)).view(np.int64))
        return out[0], out[1]


class Filter:
    """Bit set over hashes, read-only in tasks; bits is a power of two."""

    def __init__(self, table: DataFrame, n: int):
        """Of the n hashes in column key.  At most 2^MOST_BITS bits reach the driver, whatever n is."""
        self.bits = 1 << min(MOST_BITS, max(15, ceil(log2(max(1, 16 * n)))))
        place = table.select(F.expr(f"key & {self.bits - 1}L").alias("at"))
        maps = place.groupBy(F.expr(f"at div {BITMAP}").alias("word")).agg(F.expr(f"bitmap_construct_agg(at % {BITMAP})"))
        self.set = np.zeros(self.bits // 8, np.uint8)
        # At most 4,096 bitmaps of 4 KB in one job; a local iterator runs one job after another, as many as there are partitions.
        for word, bits in maps.collect():
            self.set[word * BITMAP // 8 : (word + 1) * BITMAP // 8] = np.frombuffer(bits, np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:  # unsigned
        at = keys & np.uint64(self.bits - 1)
        return (self.set[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _place() -> Column:
    return F.struct("doc_id", "h", "pos")


def _anchor_counts(docs: DataFrame) -> DataFrame:
    """How often each picked phrase occurs: key, n.  Equal ones in a batch are combined at once."""

    def run(batches):
        for batch in batches:
            keys = [Anchors(raws).key for _, raws in chunks(batch.column(0))]
            keys, n = np.unique(np.concatenate(keys or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    return docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


#: Which sequence of which document a row is, in 64 bits: for filters, which may take others for it.
ROW_KEY = "c1 ^ coalesce(doc_id, 0) ^ shiftleft(pos, 13)"


def _passages(docs: DataFrame, known: Filter, single: bool) -> DataFrame:
    """Word sequences around picked phrases: doc_id, h, key, c1, c2, pos, len, times.

    All windows that pick a phrase make one sequence, and known is a filter of phrases.  With single,
    known is a filter of such sequences (ROW_KEY), and each of their windows is one of its own.
    Neighbours that are equal (a word over and over) make one row with a number of times.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for batch in batches:
            ids = np.array(batch.column(0).fill_null(0)).view(np.uint64)
            out = [[] for _ in range(7)]
            for at, raws in chunks(batch.column(2)):
                found = Anchors(raws)
                row, start, end, key = found.row, found.low, found.high + SPAN, found.key
                if not single:
                    use = shared.value.has(key)
                    row, start, end, key = row[use], start[use], end[use], key[use]
                if not len(start):
                    continue
                c1, c2 = found.digests(start, end)
                if single:
                    pos = (start - found.begin[row]).astype(np.uint64)
                    use = shared.value.has(c1.view(np.uint64) ^ ids[at + row] ^ (pos << np.uint64(13)))
                    times = (end - SPAN + 1 - start)[use]
                    if not len(times):
                        continue
                    first = np.cumsum(times) - times
                    start = np.repeat(start[use] - first, times) + np.arange(times.sum())
                    row, key, end = np.repeat(row[use], times), np.repeat(key[use], times), start + SPAN
                    c1, c2 = found.digests(start, end)
                new = np.ones(len(start), bool)
                new[1:] = (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1]) | (start[1:] != start[:-1] + 1) | (row[1:] != row[:-1])
                times = np.diff(np.append(np.flatnonzero(new), len(start)))
                pos = start - found.begin[row]
                columns = (at + row[new], key.view(np.int64)[new], c1[new], c2[new], pos[new], (end - start)[new], times)
                for k, x in enumerate(columns):
                    out[k].append(x)
            rows, *rest = [np.concatenate(x or [np.zeros(0, np.int64)]) for x in out]
            taken = [batch.column(k).take(pa.array(rows.astype(np.int64))) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*taken, *map(pa.array, rest)], ["doc_id", "h", "key", "c1", "c2", "pos", "len", "times"])

    return docs.mapInArrow(run, "doc_id long, h long, key long, c1 long, c2 long, pos long, len long, times long")


def _later(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows with occurrences of a sequence besides the first (smallest doc_id, then position), whose
    place is told."""
    again = classes.where("n > 1").select("c1", "c2", "first", "n")
    return (
        join_hot(rows, again, ["c1", "c2"], "n")
        .where((F.col("times") > 1) | ~_place().eqNullSafe(F.col("first")))
        .select(
            "doc_id", "h", "pos", "len", F.when(F.col("times") > 1, F.col("pos")).alias("alone"),
            F.col("first.doc_id").alias("own_id"), F.col("first.h").alias("own_h"), F.col("first.pos").alias("own_pos"),
        )
    )


def _classes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("c1", "c2").agg(F.min(_place()).alias("first"), F.sum("times").alias("n"), F.min("key").alias("key"))


def _merged(later: DataFrame) -> DataFrame:
    """Runs of overlapping occurrences with the same shift to the same first document: one passage each.
    Those that repeat at once (alone) stay as they are, to be found at each place."""
    run = Window.partitionBy("doc_id", "h", "own_id", "own_h", "alone", "shift").orderBy("pos")
    reach = F.max(F.col("pos") + F.col("len")).over(run.rowsBetween(Window.unboundedPreceding, -1))
    return (
        later.withColumn("shift", F.col("own_pos") - F.col("pos"))
        .withColumn("gap", F.coalesce(F.col("pos") > reach, F.lit(True)).cast("int"))
        .withColumn("run", F.sum("gap").over(run))
        .groupBy("doc_id", "h", "own_id", "own_h", "alone", "shift", "run")
        .agg(F.min("own_pos").alias("start"), F.max(F.col("own_pos") + F.col("len")).alias("end"))
        .select("doc_id", "h", "own_id", "own_h", "start", "end")
    )


def _cut_out(owners: DataFrame) -> DataFrame:
    """The words of each passage, from the document in which it comes first."""

    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            for row, (text, spans) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                words = words_of(text)
                for s in spans:
                    for x, v in zip(out, (row, s["start"], s["end"], b" ".join(words[s["start"] : s["end"]]).decode())):
                        x.append(v)
            taken = [batch.column(k).take(pa.array(out[0], pa.int64())) for k in (0, 1)]
            rest = [pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())]
            yield pa.RecordBatch.from_arrays([*taken, *rest], ["own_id", "own_h", "start", "end", "passage"])

    return owners.mapInArrow(run, "own_id long, own_h long, start long, end long, passage string")


def locate(texts: list[bytes], claims: list[list[dict]], most_words: int = 2_000_000) -> list[np.ndarray]:
    """Words to remove of each text: all occurrences of its passages that start after the word first,
    found by automata over the passages of many texts.  first is where the text itself has the passage
    that others repeat, -1 where an earlier text has it.

    Texts are word-joined by single spaces.  A shard of texts, of about most_words bytes of passages,
    shares an automaton; longer passages of a text are shards of their own.
    """
    masks, at = [], 0
    while at < len(texts):
        last, size, automaton = at, 0, ahocorasick.Automaton()
        while last < len(texts) and (last == at or size < most_words):
            for c in claims[last] or ():
                key = f" {c['passage']} "
                automaton.add_word(key, key)
                size += len(key)
            last += 1
        if size:
            automaton.make_automaton()
        for text, mine in zip(texts[at:last], claims[at:last]):
            joined = f" {text.decode()} "
            n = joined.count(" ") - 1 if text else 0
            edges = np.zeros(n + 1, np.int64)
            if mine:
                first = {}
                for c in mine:
                    key = f" {c['passage']} "
                    first[key] = min(first.get(key, c["first"]), c["first"])
                spaces = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le"), "<u4") == 32)
                for end, key in automaton.iter(joined):
                    if key in first:
                        stop = int(np.searchsorted(spaces, end))
                        start = stop - key.count(" ") + 1
                        if start > first[key]:
                            edges[start] += 1
                            edges[stop] -= 1
            masks.append(np.cumsum(edges[:-1]) > 0)
        at = last
    return masks


def _remove(claimed: DataFrame, step: int = 256) -> DataFrame:
    """doc_id, text, n_words and n_removed of rows with their claims; words of step rows are held at a time."""

    def run(batches):
        for whole in batches:
            for low in range(0, whole.num_rows, step):
                batch = whole.slice(low, step)
                words = [words_of(t) for t in batch.column(2).to_pylist()]
                masks = locate([b" ".join(w) for w in words], batch.column(3).to_pylist())
                kept = [b" ".join([x for x, m in zip(w, mask.tolist()) if not m]) if mask.any() else b" ".join(w) for w, mask in zip(words, masks)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([k.decode() for k in kept], pa.string()),
                        pa.array([len(w) for w in words], pa.int64()),
                        pa.array([int(m.sum()) for m in masks], pa.int64()),
                    ],
                    ["doc_id", "text", "n_words", "n_removed"],
                )

    return claimed.mapInArrow(run, "doc_id long, text string, n_words long, n_removed long")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text (kept words joined by a space), n_words, n_removed for every document.

    A window is 20 consecutive words (ending at space and 0x09-0x0D).  Words covered by a window that
    also starts earlier (smaller doc_id, or earlier in the document) are removed.

    1. Each window picks one of its 8-word phrases by hash, so equal windows pick equal phrases.
       Phrases picked more than once are counted exactly; a bit set of them (16 MB at most) is broadcast.
    2. The windows that share a phrase make one word sequence, hashed to 128 bits; equal sequences are
       grouped.  Where a phrase has several sequences, the first occurrences of these are looked at
       window by window.  Overlapping repeats merge into passages, whose words come from the document
       that has them first.
    3. Each task compiles the passages of its documents into Aho-Corasick automata and streams the
       documents through: every occurrence but the first is removed, compared word for word.

    Documents are told apart by doc_id and text, so rows equal in both count as one occurrence.
    Null text has no words; a null doc_id is smaller than all others.  Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    counts = materialise(_anchor_counts(docs).where("n > 1").select("key"), "phrases")
    rows = materialise(_passages(docs, Filter(counts, counts.count()), single=False), "sequences")
    classes = materialise(_classes(rows), "sequence-classes")
    several = classes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    mixed = classes.join(several, "key").select("c1", "first.*").select(F.expr(ROW_KEY).alias("key"))
    mixed = materialise(mixed, "mixed-sequences")
    windows = materialise(_passages(docs, Filter(mixed, mixed.count()), single=True), "windows")
    own = materialise(_classes(windows), "window-classes")
    later = _later(rows, classes).unionByName(_later(windows, own))
    claims = materialise(_merged(later), "claims")

    spans = (
        claims.select("own_id", "own_h", "start", "end")
        .distinct()
        .groupBy("own_id", "own_h")
        .agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("h") == F.col("own_h"))
    passages = _cut_out(docs.join(spans, same).select("own_id", "own_h", "text", "spans"))
    key = [F.col(f"c.{k}").eqNullSafe(F.col(f"p.{k}")) for k in ("own_id", "own_h", "start", "end")]
    first = F.when(F.col("doc_id").eqNullSafe(F.col("c.own_id")) & (F.col("h") == F.col("c.own_h")), F.col("c.start"))
    per_doc = (
        claims.alias("c")
        .join(passages.alias("p"), key)
        .groupBy(F.col("doc_id").alias("own_id"), F.col("h").alias("own_h"))
        .agg(F.collect_set(F.struct("passage", F.coalesce(first, F.lit(-1).cast("long")).alias("first"))).alias("claims"))
    )
    return _remove(docs.join(per_doc, same, "left").select("doc_id", "h", "text", "claims"))


def op7_repeated_phrase_automata(spark, sf_dir: str) -> DataFrame:
    """Per document its words, how many are removed as repeats, and the digest of what stays."""
    kept = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    # Written by the helper, so that Python gets few texts at a time whoever reads the result.
    return materialise(kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256")), "repeats-removed")
