"""BAM: a splittable Python data source over blocks of BGZF, whose records are decoded in Arrow batches."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .fastx import _open

SCHEMA = "ord long, qname string, flag int, ref string, pos long, mapq int, cigar string, seq string, qual string, rg string"
#: Fixed values of the format: letters of CIGAR operations and of bases, bytes of a tag's value.
OPERATIONS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
TAG_BYTES = {b"A": 1, b"c": 1, b"C": 1, b"s": 2, b"S": 2, b"i": 4, b"I": 4, b"f": 4}
#: Bytes of a record's fixed fields, after its length; the largest block of BGZF.
FIXED, MOST_BLOCK = 32, 1 << 16
#: Records that must follow each other for a place to count as the start of a record; records of a batch.
CHAIN, BATCH = 8, 8192
_FIELDS = struct.Struct("<iiiBBHHHiiii")
_PAIRS = np.array([[ord(BASES[k >> 4]), ord(BASES[k & 15])] for k in range(256)], np.uint8)


def block_size(head: bytes) -> int | None:
    """Bytes of the BGZF block that begins with head; None if none does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    at, end = 12, 12 + int.from_bytes(head[10:12], "little")
    while at + 4 <= min(end, len(head)):
        size = int.from_bytes(head[at + 2 : at + 4], "little")
        if head[at : at + 2] == b"BC" and size == 2 and at + 6 <= len(head):
            return int.from_bytes(head[at + 4 : at + 6], "little") + 1
        at += 4 + size
    return None


class Blocks:
    """Blocks of a BGZF file by their places."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def at(self, place: int) -> tuple[bytes, int]:
        """Data of the block at a place and the place of the next one."""
        self.file.seek(place)
        head = self.file.read(MOST_BLOCK)
        n = block_size(head)
        if n is None or n > len(head):
            raise ValueError(f"no whole block of BGZF at byte {place}")
        return zlib.decompress(head[:n], 31), place + n

    def first(self, low: int, high: int) -> int | None:
        """Place of the first block in [low, high): a block's mark which leads on to those of two more, or to the end."""
        self.file.seek(low)
        reach = min(high - low, MOST_BLOCK)  # no block is longer, so if one begins at all, it begins before that
        data = self.file.read(reach + 4 * MOST_BLOCK)
        at = data.find(b"\x1f\x8b\x08\x04")
        while 0 <= at < reach:
            place, sound = at, True
            for _ in range(3):
                n = block_size(data[place : place + 64])
                sound = n is not None
                if not sound or (place := place + n) + low >= self.size:
                    break
            if sound and place + low <= self.size:
                return low + at
            at = data.find(b"\x1f\x8b\x08\x04", at + 1)
        return None


class Header:
    """Text and references of a BAM file, and the (block, offset in it) of its first record."""

    def __init__(self, blocks: Blocks):
        data, following, starts = b"", 0, []

        def need(n: int) -> None:
            nonlocal data, following
            while len(data) < n:
                if following >= blocks.size:
                    raise ValueError("the file ends within its header")
                starts.append((len(data), following))
                more, following = blocks.at(following)
                data += more

        need(12)
        if data[:4] != b"BAM\x01":
            raise ValueError("not a BAM file")
        at = 8 + int.from_bytes(data[4:8], "little")
        need(at + 4)
        self.text = data[8:at].rstrip(b"\0").decode()
        n, at = int.from_bytes(data[at : at + 4], "little"), at + 4
        self.names, self.lengths = [], []
        for _ in range(n):
            need(at + 4)
            size = int.from_bytes(data[at : at + 4], "little")
            need(at + 8 + size)
            self.names.append(data[at + 4 : at + 3 + size].decode())
            self.lengths.append(int.from_bytes(data[at + 4 + size : at + 8 + size], "little"))
            at += 8 + size
        if at == len(data):
            self.block, self.offset = following, 0
        else:
            base, self.block = max(s for s in starts if s[0] <= at)
            self.offset = at - base


def _record_end(data: bytes, at: int, lengths: list[int]) -> int | None:
    """End of the record that begins at a place; None if none can begin there, -1 if the data end too early
    to tell."""
    if at + 4 + FIXED > len(data):
        return -1
    size, ref, pos, l_name, _, _, n_ops, _, n_bases, ref2, pos2, _ = _FIELDS.unpack_from(data, at)
    n = len(lengths)
    if not (-1 <= ref < n and -1 <= ref2 < n and pos >= -1 and pos2 >= -1 and l_name > 0 and n_bases >= 0):
        return None
    if size < FIXED + l_name + 4 * n_ops + (n_bases + 1) // 2 + n_bases or (ref >= 0 and pos > lengths[ref]):
        return None
    name = data[at + 4 + FIXED : at + 4 + FIXED + l_name]
    if len(name) == l_name and (name[-1] or any(c < 33 or c > 126 for c in name[:-1])):
        return None
    ops = data[at + 4 + FIXED + l_name : at + 4 + FIXED + l_name + 4 * n_ops : 4]
    return None if any(c & 15 > 8 for c in ops) else at + 4 + size


def first_record(blocks: Blocks, place: int, high: int, lengths: list[int]) -> tuple[int, int] | None:
    """(block, offset in it) of the first record that begins in the blocks from place on, before high."""
    while place < high and place < blocks.size:
        data, following = blocks.at(place)
        own, ahead = len(data), following
        at = 0
        while at < own:
            end, n = at, 0
            while n < CHAIN and end is not None:
                if end == len(data) and ahead >= blocks.size and n:
                    break
                step = _record_end(data, end, lengths)
                if step == -1 or (step is not None and step > len(data)):
                    if ahead >= blocks.size:
                        end = None
                        break
                    more, ahead = blocks.at(ahead)
                    data += more
                    continue
                end, n = step, n + 1
            if end is not None:
                return place, at
            at += 1
        place = following
    return None


def _gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes [start, start + size) of each row, one after the other."""
    ends = np.cumsum(size)
    return data[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def _strings(flat: np.ndarray, size: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    mask = None if valid is None or valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little"))
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat)), mask)


def _tag(tags: bytes, name: bytes) -> bytes | None:
    """Value of a tag: a text without its end, else its bytes with kind and count."""
    at = 0
    while at + 3 <= len(tags):
        kind, here, at = tags[at + 2 : at + 3], tags[at : at + 2], at + 3
        if kind in (b"Z", b"H"):
            end = tags.index(b"\0", at)
            value, at = tags[at:end], end + 1
        elif kind == b"B":
            end = at + 5 + TAG_BYTES[tags[at : at + 1]] * int.from_bytes(tags[at + 1 : at + 5], "little")
            value, at = tags[at:end], end
        else:
            value, at = tags[at : at + TAG_BYTES[kind]], at + TAG_BYTES[kind]
        if here == name:
            return value
    return None


class _Decoder:
    """Records of a buffer to Arrow batches; texts of CIGARs that come again are made once."""

    def __init__(self, names: list[str]):
        self.names = np.array([*names, None], object)
        self.cigars: dict[bytes, str | None] = {b"": None}

    def _cigar(self, raw: bytes) -> str | None:
        found = self.cigars.get(raw)
        if found is None and raw:
            found = "".join(f"{x >> 4}{OPERATIONS[x & 15]}" for x in np.frombuffer(raw, "<u4").tolist())
            if len(self.cigars) < 1 << 16:
                self.cigars[raw] = found
        return found

    def batch(self, raw: bytes, starts: list[int], ords: list[int]) -> pa.RecordBatch:
        data, at = np.frombuffer(raw, np.uint8), np.array(starts, np.int64)
        fixed = data[at[:, None] + np.arange(4 + FIXED)]
        number = lambda k, kind: fixed[:, k : k + np.dtype(kind).itemsize].copy().view(kind).ravel().astype(np.int64)
        size, ref, pos, l_name, mapq, n_ops, flag, bases = (number(k, t) for k, t in ((0, "<i4"), (4, "<i4"), (8, "<i4"), (12, "u1"), (13, "u1"), (16, "<u2"), (18, "<u2"), (20, "<i4")))
        name = at + 4 + FIXED
        ops = name + l_name
        packed = ops + 4 * n_ops
        quals = packed + (bases + 1) // 2
        tags, ends = quals + bases, at + 4 + size
        halves = _gathered(data, packed, (bases + 1) // 2)
        letters = _PAIRS[halves].ravel()
        odd = (bases & 1).astype(bool)
        letters = np.delete(letters, (2 * np.cumsum((bases + 1) // 2) - 1)[odd])
        none = bases == 0
        seq = _strings(letters, bases)
        seq = pc.if_else(pa.array(none), pa.scalar("*"), seq) if none.any() else seq
        scores = _gathered(data, quals, bases)
        known = ~none
        known[known] = data[quals[known]] != 255
        qual = _strings(np.where(scores == 255, 33, scores + 33).astype(np.uint8), bases, known)
        cigars, groups = [], []
        for a, b, c, d in zip(ops.tolist(), packed.tolist(), tags.tolist(), ends.tolist()):
            own, rest = raw[a:b], raw[c:d]
            if b - a == 8 and own[4] & 15 == 3 and b"CGBI" in rest and (long := _tag(rest, b"CG")):
                own = long[5:]
            cigars.append(self._cigar(own))
            group = _tag(rest, b"RG") if b"RGZ" in rest else None
            groups.append(group.decode() if group is not None else None)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ords, pa.int64()), _strings(_gathered(data, name, l_name - 1), l_name - 1), pa.array(flag.astype(np.int32)),
                pa.array(self.names[ref], pa.string()), pa.array(pos, pa.int64(), mask=pos < 0), pa.array(mapq.astype(np.int32)),
                pa.array(cigars, pa.string()), seq, qual, pa.array(groups, pa.string()),
            ],
            [c.split()[0] for c in SCHEMA.split(", ")],
        )


class _Range(InputPartition):
    def __init__(self, number: int, uri: str, start: int, end: int):
        self.number, self.uri, self.start, self.end = number, uri, start, end


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p.strip() for p in options["path"].split(",")]
        self.split = max(1, int(options.get("splitBytes", 64 << 20)))
        self.headers: list[Header] = []
        self.sizes: list[int] = []
        for uri in self.paths:
            store, path = _open(uri)
            with store.open_input_file(path) as f:
                self.sizes.append(f.size())
                self.headers.append(Header(Blocks(f, f.size())))
        #: ord has a record's block and its offset there below the file's number.
        self.place_bits = max(s.bit_length() for s in self.sizes) + 16
        if self.place_bits + (len(self.paths) - 1).bit_length() > 63:
            raise ValueError("too many or too large files for one call: their places don't fit into ord")

    def partitions(self):
        return [_Range(k, uri, s, min(s + self.split, size)) for k, (uri, size) in enumerate(zip(self.paths, self.sizes)) for s in range(0, size, self.split)]

    def read(self, p: _Range):
        store, path = _open(p.uri)
        header = self.headers[p.number]
        with store.open_input_file(path) as f:
            blocks = Blocks(f, self.sizes[p.number])
            if header.block < p.start:
                place = blocks.first(p.start, p.end)
                found = first_record(blocks, place, p.end, header.lengths) if place is not None else None
            else:
                found = (header.block, header.offset) if header.block < p.end else None
            if found is not None:
                yield from self._batches(blocks, *found, p, header)

    def _batches(self, blocks: Blocks, place: int, offset: int, p: _Range, header: Header):
        """Batches of the records that begin in blocks before the range's end; the last one may end behind it."""
        decoder, high = _Decoder(header.names), p.number << self.place_bits
        data, marks, following = bytearray(), [], place  # marks: (where a block's data begin, its place)
        at, starts, ords = offset, [], []

        def reach(n: int) -> bool:
            nonlocal following
            while len(data) < n and following < blocks.size:
                marks.append((len(data), following))
                more, following = blocks.at(following)
                data.extend(more)
            return len(data) >= n

        while reach(at + 1):
            while len(marks) > 1 and marks[1][0] <= at:
                del marks[0]
            if marks[0][1] >= p.end:
                break
            if not reach(at + 4) or not reach(at + 4 + int.from_bytes(data[at : at + 4], "little")):
                raise ValueError(f"{p.uri} ends within a record")
            starts.append(at)
            ords.append(high | marks[0][1] << 16 | at - marks[0][0])
            at += 4 + int.from_bytes(data[at : at + 4], "little")
            if len(starts) >= BATCH or at >= 64 * MOST_BLOCK:
                yield decoder.batch(bytes(data[:at]), starts, ords)
                del data[:at]
                marks = [(k - at, x) for k, x in marks]
                at, starts, ords = 0, [], []
        if starts:
            yield decoder.batch(bytes(data[:at]), starts, ords)


class BamDataSource(DataSource):
    """spark.read.format("bam").option("path", "file:///a.bam,file:///b.bam").load()"""

    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BamReader(self.options)


def read_bam(spark: SparkSession, *uris: str, split_bytes: int = 64 << 20) -> DataFrame:
    """Alignments of BAM files as read_sam gives those of SAM text: ord, qname, flag, ref, pos (0-based), mapq,
    cigar, seq, qual, rg; null where the file has no value.

    Files are cut into ranges of split_bytes.  A range's first block is found by its mark and the chain of
    blocks behind it, its first record by a place from which several sound records follow each other; the
    record that reaches over a range's end is read by the range in which it begins.  ord follows the order of
    the files and of the records in them.
    """
    spark.dataSource.register(BamDataSource)
    return spark.read.format("bam").option("splitBytes", split_bytes).option("path", ",".join(uris)).load()


def _header(uri: str) -> Header:
    store, path = _open(uri)
    with store.open_input_file(path) as f:
        return Header(Blocks(f, f.size()))


def bam_references(spark: SparkSession, uri: str) -> DataFrame:
    """number, ref and length of each reference in a file's header, in its order."""
    found = _header(uri)
    return spark.createDataFrame([(k, *x) for k, x in enumerate(zip(found.names, found.lengths))], "number int, ref string, length long")


def bam_read_groups(spark: SparkSession, uri: str) -> DataFrame:
    """id and sample of each read group in a file's header."""
    rows = [dict(x.split(":", 1) for x in line.split("\t")[1:] if ":" in x) for line in _header(uri).text.splitlines() if line.startswith("@RG")]
    return spark.createDataFrame([(r.get("ID"), r.get("SM")) for r in rows], "id string, sample string")
