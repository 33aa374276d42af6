"""Block-compressed VCF: a splittable source, a sidecar index of bins to places, range fetches, and a writer."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from bisect import bisect_right
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .bam import Blocks
from .fastx import _open

SCHEMA = "ord long, chrom string, pos long, stop long, value string"
#: Letters of a bin of the index; bytes of data in a block that is written; lines of a batch.
BIN, BLOCK, BATCH = 1 << 14, 0xFF00, 8192
#: Bits of ord below the file's number: a block's place and a line's offset in it.
PLACE_BITS = 56


@dataclass
class _Lines(InputPartition):
    """Lines of a file: those that begin in a range of its bytes, or (index) in pieces (after, first, last) of ord."""

    number: int
    uri: str
    start: int = 0
    end: int = 0
    pieces: list | None = None


@dataclass
class Region:
    """What is asked for: sites of chrom that reach over [low, high); None: not bounded."""

    chrom: str | None = None
    low: int | None = None
    high: int | None = None


def files_of(uri: str) -> list[str]:
    """A file, or the block-compressed files of a folder in order of their names."""
    store, path = _open(uri)
    if store.get_file_info(path).type != fs.FileType.Directory:
        return [uri]
    names = sorted(os.path.basename(f.path) for f in store.get_file_info(fs.FileSelector(path)))
    return [f"{uri.rstrip('/')}/{n}" for n in names if n.endswith((".gz", ".bgz")) and n[0] not in "._"]


def _lines(blocks: Blocks, place: int, offset: int, skip: bool, end: int):
    """(block << 16 | offset in it, line) of the lines from a place on.  skip: what comes before the first line's
    end belongs to the range before; a line is taken if it begins before, or exactly at, the first block from end on."""
    data, marks, following, at = bytearray(), [], place, offset

    def more() -> bool:
        nonlocal following
        if following >= blocks.size:
            return False
        marks.append((len(data), following))
        fresh, following = blocks.at(following)
        data.extend(fresh)
        return True

    while True:
        stop = data.find(b"\n", at)
        while stop < 0 and more():
            stop = data.find(b"\n", marks[-1][0])
        if at >= len(data):
            return
        limit = next((k for k, p in marks if p >= end), None)
        if limit is not None and (at > limit or (at == limit and skip)):
            return
        holder = marks[bisect_right(marks, at, key=lambda m: m[0]) - 1]
        line = bytes(data[at : stop if stop >= 0 else len(data)])
        if skip:
            skip = False
        else:
            yield holder[1] << 16 | at - holder[0], line
        if stop < 0:
            return
        at = stop + 1
        if at > 1 << 22:
            while len(marks) > 1 and marks[1][0] <= at:
                del marks[0]
            cut = marks[0][0]
            del data[:cut]
            marks, at = [(k - cut, p) for k, p in marks], at - cut


class BgzfVcfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = files_of(options["path"])
        self.split = max(1, int(options.get("splitBytes", 64 << 20)))
        self.index = options.get("index")
        bound = lambda k: int(options[k]) if k in options else None
        self.region = Region(options.get("chrom"), bound("start"), bound("end"))

    def partitions(self):
        if self.index is None or self.region.chrom is None:
            return [p for k, uri in enumerate(self.files) for p in self._whole(k, uri)]
        store, path = _open(self.index)
        r, bins = self.region, ds.field("bin")
        wanted = ds.field("chrom") == r.chrom
        wanted = wanted if r.low is None else wanted & (bins >= r.low // BIN)
        wanted = wanted if r.high is None else wanted & (bins <= (r.high - 1) // BIN)
        found = ds.dataset(path, filesystem=store, format="parquet").to_table(columns=["first", "last"], filter=wanted)
        out, done, held = [], -1, 0
        for first, last in sorted(zip(found["first"].to_pylist(), found["last"].to_pylist())):
            if last <= done:
                continue
            number, mask = first >> PLACE_BITS, (1 << PLACE_BITS) - 1
            after = done & mask if done >= 0 and done >> PLACE_BITS == number else -1
            if not out or out[-1].number != number or held > self.split:
                out.append(_Lines(number, self.files[number], pieces=[]))
                held = 0
            out[-1].pieces.append((after, first & mask, last & mask))
            held += (last >> 16) - (max(first, done) >> 16)
            done = last
        return out

    def _whole(self, number: int, uri: str):
        store, path = _open(uri)
        size = store.get_file_info(path).size
        return [_Lines(number, uri, s, min(s + self.split, size)) for s in range(0, size, self.split)]

    def _found(self, p: _Lines):
        store, path = _open(p.uri)
        with store.open_input_file(path) as f:
            blocks = Blocks(f, f.size())
            if p.pieces is None:
                place = blocks.first(p.start, p.end) if p.start else 0
                if place is not None:
                    yield from _lines(blocks, place, 0, p.start > 0, p.end)
                return
            for after, first, last in p.pieces:
                begin = max(after, first)
                for at, line in _lines(blocks, begin >> 16, begin & 0xFFFF, False, blocks.size):
                    if at > last:
                        break
                    if at > after:
                        yield at, line

    def read(self, p: _Lines | None):
        if p is None:  # no partitions: Spark asks once all the same
            return
        r, rows = self.region, []
        for at, line in self._found(p):
            if line[:1] in (b"#", b"", b"\r"):
                continue
            text = line.decode().rstrip("\r")
            chrom, pos, _, ref, _ = text.split("\t", 4)
            pos = int(pos) - 1
            if (r.chrom in (None, chrom)) and (r.low is None or pos + len(ref) > r.low) and (r.high is None or pos < r.high):
                rows.append((p.number << PLACE_BITS | at, chrom, pos, pos + len(ref), text))
            if len(rows) >= BATCH:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in SCHEMA.split(", ")])


@dataclass
class _Part(WriterCommitMessage):
    number: int
    path: str


def packed(data: bytes) -> bytes:
    """A block of BGZF with the data."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<HHHH", 6, 0x4342, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


class BgzfVcfWriter(DataSourceArrowWriter):
    """A file for each task, named only when all are written; a task that is run again writes another file."""

    def __init__(self, options: dict):
        self.uri = options["path"].rstrip("/")
        self.head = options.get("header", "").encode()

    def write(self, iterator):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        store, folder = _open(self.uri)
        store.create_dir(folder)
        path = f"{folder}/_{uuid.uuid4().hex}"
        with store.open_output_stream(path) as out:
            held = bytearray(self.head if number == 0 else b"")
            for batch in iterator:
                for value in batch.column(batch.schema.get_field_index("value")):
                    held += value.as_py().encode() + b"\n"
                    while len(held) >= BLOCK:
                        out.write(packed(bytes(held[:BLOCK])))
                        del held[:BLOCK]
            out.write((packed(bytes(held)) if held else b"") + packed(b""))
        return _Part(number, path)

    def commit(self, messages):
        store, folder = _open(self.uri)
        for m in messages:
            if m is not None:
                store.move(m.path, f"{folder}/part-{m.number:08d}.vcf.gz")

    def abort(self, messages):
        store, _ = _open(self.uri)
        for m in messages:
            if m is not None:
                store.delete_file(m.path)


class BgzfVcfDataSource(DataSource):
    """spark.read.format("bgzf_vcf").option("index", "file:///a.idx").load("file:///a.vcf.gz")"""

    @classmethod
    def name(cls):
        return "bgzf_vcf"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BgzfVcfReader(self.options)

    def writer(self, schema, overwrite):
        return BgzfVcfWriter(self.options)


def read_bgzf_vcf(spark: SparkSession, uri: str, index: str | None = None, split_bytes: int = 64 << 20, **region) -> DataFrame:
    """ord, chrom, pos (0-based), stop (behind the reference's letters) and value (the line) of a file's or folder's
    sites; sites_of and calls_of take them.  ord follows the order of the files and of their lines.

    With an index and a region (chrom, start, end) only the blocks of the wanted bins are read; otherwise files
    are cut into ranges of split_bytes.  The region is an argument and no pushed filter: Spark 4.1 keeps what it
    pushed into a Python source for later queries on the same DataFrame, which then lack rows.
    """
    spark.dataSource.register(BgzfVcfDataSource)
    reader = spark.read.format("bgzf_vcf").option("path", uri).option("splitBytes", split_bytes)
    for name, value in {"index": index, **region}.items():
        if value is not None:
            reader = reader.option(name, value)
    return reader.load()


def index_bgzf_vcf(spark: SparkSession, uri: str, index: str, split_bytes: int = 64 << 20) -> None:
    """Writes the index: for each chromosome and bin of 16,384 letters, per file, ord of the first and the last
    line whose site reaches over the bin.  Files need not be sorted, but bins of unsorted ones are wide."""
    sites = read_bgzf_vcf(spark, uri, split_bytes=split_bytes)
    bins = F.sequence(F.expr(f"pos div {BIN}"), F.expr(f"greatest(pos, stop - 1) div {BIN}"))
    rows = sites.select("ord", "chrom", F.explode(bins).alias("bin"))
    found = rows.groupBy("chrom", "bin", F.shiftright("ord", PLACE_BITS).alias("file")).agg(F.min("ord").alias("first"), F.max("ord").alias("last"))
    found.sort("chrom", "bin").write.parquet(index)


def fetch_range(spark: SparkSession, uri: str, index: str, chrom: str, start: int, end: int | None = None, split_bytes: int = 64 << 20) -> DataFrame:
    """Sites of chrom that reach over [start, end), 0-based, or from start on; an unknown chromosome has none."""
    return read_bgzf_vcf(spark, uri, index, split_bytes, chrom=chrom, start=start, end=end)


def write_bgzf_vcf(body: DataFrame, uri: str, head: list[str] = ()) -> None:
    """Lines (column value) to a folder: a block-compressed file for each partition, the header in the first one.
    Sort them by range before, so that bins lie in few blocks."""
    body.sparkSession.dataSource.register(BgzfVcfDataSource)
    text = "".join(f"{h}\n" for h in head)
    body.select("value").write.format("bgzf_vcf").option("header", text).mode("append").save(uri)


def vcf_head(uri: str) -> list[str]:
    """The header's lines, of the first file."""
    store, path = _open(files_of(uri)[0])
    out = []
    with store.open_input_file(path) as f:
        for _, line in _lines(Blocks(f, f.size()), 0, 0, False, f.size()):
            if line[:1] != b"#":
                break
            out.append(line.decode().rstrip("\r"))
    return out
