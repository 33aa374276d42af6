"""Token ids as length-delimited binary records with masked checksums and an offset index."""

from __future__ import annotations

import os
import re
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import lean, materialise, scratch_dir

#: Fixed values of the record format: 8 bytes length, 4 bytes its masked checksum, data, 4 bytes checksum.
MASK_DELTA = 0xA282EAD8
HEADER, FOOTER = 12, 4
#: Bytes of records that are read and handed on at a time, and that a task reads in all.
REQUEST, TASK = 1 << 20, 16 << 20
#: Words whose ids a worker remembers at most, in each of two generations.
WORDS = 400_000
INDEX_SCHEMA = "part int, file string, doc_id long, offset long, length long, n_tokens long, first long"

#: A space between two characters that are not white space starts a word, whatever surrounds it.
_WORD_START = re.compile(r"(?<=\S)(?= \S)")
#: Marks the word that no space precedes.
_FIRST = "\0"
_NEWLINE = "\n"
#: Marks that never share a token with the letter before them (the apostrophe may).
_MARKS = ".,!?;:%&*#$|)"


def masked_crc(data: bytes) -> int:
    """CRC-32 rotated right by 15 bits plus a constant, so that checksums of checksums stay good."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    size = len(data).to_bytes(8, "little")
    return b"".join((size, masked_crc(size).to_bytes(4, "little"), data, masked_crc(data).to_bytes(4, "little")))


def unframe(buffer, at: int = 0) -> tuple[bytes, int]:
    """The record at this place and where the next one starts; ValueError where a checksum differs."""
    size = bytes(buffer[at : at + 8])
    if masked_crc(size) != int.from_bytes(buffer[at + 8 : at + HEADER], "little"):
        raise ValueError(f"length checksum differs at {at}")
    end = at + HEADER + int.from_bytes(size, "little")
    data = bytes(buffer[at + HEADER : end])
    if len(data) != end - at - HEADER or masked_crc(data) != int.from_bytes(buffer[end : end + FOOTER], "little"):
        raise ValueError(f"data checksum differs at {at}")
    return data, end + FOOTER


class _Known(dict):
    """Ids of words: a full generation is kept aside until the next is full, and what is used moves over."""

    def __init__(self, most: int):
        self.most, self.older, self.new = most, {}, []

    def __missing__(self, word: str) -> bytes | None:
        ids = self.older.get(word)
        if ids is None:
            self.new.append(word)
        else:
            self[word] = ids
        return ids

    def turn(self) -> list[str]:
        """The words not known, once each; starts a generation where the last is full."""
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()
        new, self.new = list(set(self.new)), []
        return new


class Encoder:
    """Encodes whole texts, remembering the ids of words: a byte-level tokenizer cuts at word starts first."""

    def __init__(self, path: str, most: int = WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        #: Finds added tokens, which are matched before any text is cut at words.
        self.added = re.compile("|".join(re.escape(t.content) for t in added) or r"(?!)", re.IGNORECASE)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.width = int(self.dtype[-1])
        self.known = _Known(most)
        self.end_of_line = self.tokenizer.encode(_NEWLINE, add_special_tokens=False).ids
        self.line = np.array(self.end_of_line, self.dtype).tobytes()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _lines(self, bodies: list[str], lead: str) -> list[bytes]:
        """Ids of words without white space, each after lead: encoded together, a line each."""
        out = []
        for k in range(0, len(bodies), 500):
            some = bodies[k : k + 500]
            ids = self._ids(lead + f"\n{lead}".join(some) + "\n")
            ends = np.flatnonzero(ids == self.end_of_line[0])
            if len(self.end_of_line) == 1 and len(ends) == len(some):
                raw, ends = ids.tobytes(), (ends * self.width).tolist()
                out += [raw[a:b] for a, b in zip([0, *(e + self.width for e in ends)], ends)]
            else:
                out += [self._ids(lead + w).tobytes() for w in some]
        return out

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words with the space or line feed before them; none where a text can't be cut there.

        Marks after a letter are cut off first, as the tokenizer does, so that words with and without
        them share what is known.
        """
        known, older, learned = self.known, self.known.older, {}
        plain, marked, marks, first, other = [], [], set(), [], []
        for w in words:
            if w.isprintable() and w:
                core = w.rstrip(_MARKS)
                if len(core) == len(w) or not core or not core[-1].isalpha():
                    plain.append(w)
                else:
                    marked.append((w, core, w[len(core) :]))
            else:
                (first if w[:1] in (_FIRST, _NEWLINE) and w[1:] and w[1:].isprintable() else other).append(w)
        cores = {core for _, core, _ in marked}
        plain += [c for c in cores.difference(plain) if c not in known and c not in older]
        marks = list({m for *_, m in marked})
        learned.update(zip(plain, self._lines(plain, " ")))
        tails = dict(zip(marks, self._lines(marks, "")))
        for w, core, mark in marked:
            learned[w] = (learned.get(core) or dict.get(known, core) or older[core]) + tails[mark]
        for w, ids in zip(first, self._lines([w[1:] for w in first], "")):
            learned[w] = ids if w[0] == _FIRST else self.line + ids
        for w in other:
            mark = w[:1] if w[:1] in (_FIRST, _NEWLINE) else ""
            body = w[len(mark) :]
            if body and not body[0].isspace() and not body[-1].isspace():
                learned[w] = self._ids(body if mark == _FIRST else w if mark else " " + w).tobytes()
        known.update(learned)
        return learned

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian, as many bytes each as the vocabulary needs.

        A text that may hold an added token is encoded whole.
        """
        whole = [bool(self.added.search(t)) for t in texts]
        # Arrow cuts the texts and numbers their words, so that each word is looked up once for all of them.
        cut = ["" if all_ or _FIRST in t else (_FIRST + t).replace(_NEWLINE, " \n") for t, all_ in zip(texts, whole)]
        cut = pc.split_pattern(pa.array(cut, pa.large_string()), " ")
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.known.__getitem__, words))
        learned = self._learn(self.known.turn())
        ids = pa.array([learned.get(w) if x is None else x for w, x in zip(words, ids)], pa.binary())
        out = pc.binary_join(pa.ListArray.from_arrays(cut.offsets, ids.take(coded.indices)), b"").to_pylist()
        for k, (text, all_) in enumerate(zip(texts, whole)):
            if all_:
                out[k] = self._ids(text).tobytes()
            elif out[k] is None:  # white space next to a space, or our mark in the text
                out[k] = b"".join(self._ids(w).tobytes() for w in _WORD_START.split(text))
        return out


@lru_cache(maxsize=2)
def encoder(path: str, most: int) -> Encoder:
    return Encoder(path, most)


def write_records(docs: DataFrame, tokenizer: str, end_id: int = 2, most: int = WORDS) -> DataFrame:
    """Encode documents and write them as records in ascending doc_id order; returns the offset index.

    Tasks hold consecutive ranges of ids, so the files in order of part hold all documents in order.
    A file's name is new in every attempt and only finished tasks enter the index: a lost executor
    leaves an unused file at most.  The index (one row per document) is a Parquet table of its own.
    Null text is encoded as empty (the end id alone); a null doc_id comes first; equal ids follow each
    other in order of a hash of the text.  Other columns are not read.  An empty table gives no file.
    """
    base = scratch_dir(docs.sparkSession, "token-records")

    def write(batches):
        store, folder = fs.FileSystem.from_uri(base)
        store.create_dir(folder, recursive=True)
        part = TaskContext.get().partitionId()
        file = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.rec"
        coder, offset, first, out = encoder(tokenizer, most), 0, 0, None
        end = np.array([end_id], coder.dtype).tobytes()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            offsets, lengths, counts, firsts = [], [], [], []
            for lo in range(0, len(texts), 512):
                for data in coder.encode([t or "" for t in texts.slice(lo, 512).to_pylist()]):
                    record = frame(data + end)
                    out = out or store.open_output_stream(file, compression=None)
                    out.write(record)
                    n = len(data) // coder.width + 1
                    offsets.append(offset), lengths.append(len(record)), counts.append(n), firsts.append(first)
                    offset, first = offset + len(record), first + n
                pa.default_memory_pool().release_unused()
            size = len(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * size, pa.int32()), pa.array([file] * size, pa.string()), ids]
                + [pa.array(x, pa.int64()) for x in (offsets, lengths, counts, firsts)],
                ["part", "file", "doc_id", "offset", "length", "n_tokens", "first"],
            )
        if out:
            out.close()

    ordered = (
        docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
        .repartitionByRange("doc_id", "h")
        .sortWithinPartitions("doc_id", "h")
        .select("doc_id", "text")
    )
    return materialise(ordered.mapInArrow(lean(write), INDEX_SCHEMA), "token-index")


def _reader(base: str, forget: bool):
    """Rows of the index to the records that they name."""
    names = ["doc_id", "part", "first", "n_tokens", "ids"]

    def read(batches):
        store, _ = fs.FileSystem.from_uri(base)
        if forget:
            encoder.cache_clear()
        for batch in batches:
            rows = batch.to_pydict()
            at = 0
            while at < batch.num_rows:
                file, start = rows["file"][at], rows["offset"][at]
                stop, last, out = start, at, []
                while last < batch.num_rows and rows["file"][last] == file and rows["offset"][last] == stop and stop - start < REQUEST:
                    stop += rows["length"][last]
                    last += 1
                with store.open_input_file(file) as source:
                    source.seek(start)
                    buffer = memoryview(source.read(stop - start))
                for k in range(at, last):
                    data, _ = unframe(buffer, rows["offset"][k] - start)
                    # The end id is in every record, so there is one id at least.
                    out.append(np.frombuffer(data, f"<u{len(data) // rows['n_tokens'][k]}").astype("<u4").tobytes())
                some = batch.slice(at, last - at)
                counts = pa.array([len(x) // 4 for x in out], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("part"), some.column("first"), counts, pa.array(out, pa.binary())], names
                )
                at = last

    return read


def read_records(index: DataFrame, forget: bool = False) -> DataFrame:
    """Read the records that the index rows name, in any order, and check lengths and checksums.

    Returns doc_id, part, first (ids before it in its file), n_tokens and ids (unsigned 32-bit
    little-endian).  Neighbouring records are read with one request of about REQUEST bytes and handed on
    as one batch; the bytes of the records decide the number of tasks.  A record's length tells how wide
    its ids are, so no tokenizer is loaded; with forget, workers give up those loaded for writing.
    """
    size = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    n_tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-size // TASK))
    places = index.repartition(n_tasks, "file", F.floor(F.col("offset") / TASK)).sortWithinPartitions("file", "offset")
    read = lean(_reader(scratch_dir(index.sparkSession, ""), forget))
    return places.mapInArrow(read, "doc_id long, part int, first long, n_tokens long, ids binary")


def token_starts(index: DataFrame) -> DataFrame:
    """part, base: how many ids precede each file.  One row per file, not per document."""
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def encoded_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, most: int = WORDS, forget: bool = False) -> DataFrame:
    """Write all documents, read the files back, and tell per document where its ids are.

    forget: workers give up tokenizer and words when they read, as other work follows in their memory."""
    index = write_records(docs, tokenizer, end_id, most)
    back = read_records(index, forget).withColumn("ids_crc32", F.crc32("ids"))
    return back.drop("ids").join(token_starts(index), "part").select(
        "doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_token_records(spark, sf_dir: str) -> DataFrame:
    """Every document as token ids in record files, read back and measured."""
    return encoded_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
