"""SFF: flowgram files as reads with their clips, masks and trims, advice on further clipping, trace information."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .fastx import PLACE_BITS, _open

CLIPS = ["clip_qual_left", "clip_qual_right", "clip_adapter_left", "clip_adapter_right"]
SCHEMA = "ord long, file string, name string, descr string, seq string, qual string, fmt string, " + ", ".join(f"{c} int" for c in CLIPS)
#: Fixed values of the format: the common header, a read's header, the marks of sorted indexes.
HEADER, READ = struct.Struct(">4s4sQIIHHHB"), struct.Struct(">HHI4H")
INDEXES = (b".srt1.00", b".mft1.00")
BATCH = 4096


def _padded(n: int) -> int:
    return (n + 7) // 8 * 8


class Layout:
    """What a file's header tells: where reads begin, how many flows each has, and where its index lies."""

    def __init__(self, file, size: int):
        self.size = size
        head = file.read(HEADER.size)
        if len(head) < HEADER.size or head[:4] != b".sff":
            raise ValueError("not an SFF file")
        _, version, self.index_at, self.index_size, self.reads, self.start, _, self.flows, _ = HEADER.unpack(head)
        if version != b"\0\0\0\1":
            raise ValueError(f"unknown version of SFF: {version!r}")

    def after(self, place: int) -> int:
        """The place itself, or what follows the index if that lies there."""
        return place + _padded(self.index_size) if self.index_size and place == self.index_at else place

    def starts(self, file) -> list[int] | None:
        """Places of all reads in order, from a sorted index; None without one."""
        if not self.index_size:
            return None
        file.seek(self.index_at)
        data = file.read(self.index_size)
        if data[:8] not in INDEXES:
            return None
        if data[:8] == INDEXES[1]:
            text, size = struct.unpack(">II", data[8:16])
            data = data[16 + text : 16 + text + size]
        else:
            data = data[8:].lstrip(b"\0")
        found, at = [], 0
        while (end := data.find(b"\0", at)) > 0 and end + 5 < len(data) and data[end + 5] == 255:
            # Four digits of base 255.
            found.append(sum(d * 255**k for k, d in enumerate(reversed(data[end + 1 : end + 5]))))
            at = end + 6
        return sorted(found) if len(found) == self.reads else None


class _Range(InputPartition):
    def __init__(self, number: int, uri: str, start: int, end: int | None):
        self.number, self.uri, self.start, self.end = number, uri, start, end


class SffReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p.strip() for p in options["path"].split(",")]
        self.split = max(1, int(options.get("splitBytes", 64 << 20)))

    def partitions(self):
        """Ranges of whole reads, cut at places that the index names; a file without a sorted index is one range."""
        out = []
        for number, uri in enumerate(self.paths):
            store, path = _open(uri)
            with store.open_input_file(path) as f:
                layout = Layout(f, f.size())
                cuts = [layout.start]
                for place in layout.starts(f) or []:
                    if place - cuts[-1] >= self.split:
                        cuts.append(place)
            out += [_Range(number, uri, a, b) for a, b in zip(cuts, [*cuts[1:], None])]
        return out

    def read(self, p: _Range):
        store, path = _open(p.uri)
        with store.open_input_file(path) as f:
            layout = Layout(f, f.size())
            place, rows = layout.after(p.start), []
            f.seek(place)
            while place < (p.end or layout.size):
                head = f.read(READ.size)
                if len(head) < READ.size:
                    raise ValueError(f"{p.uri} ends within a read")
                size, l_name, n, *clips = READ.unpack(head)
                rest = f.read(size - READ.size + _padded(2 * layout.flows + 3 * n))
                if len(rest) < size - READ.size + 2 * layout.flows + 3 * n:
                    raise ValueError(f"{p.uri} ends within a read")
                at = size - READ.size + 2 * layout.flows + n
                rows.append((p.number << PLACE_BITS | place, rest[:l_name], rest[at : at + n], rest[at + n : at + 2 * n], clips))
                place = layout.after(place + size + _padded(2 * layout.flows + 3 * n))
                f.seek(place)
                if len(rows) == BATCH:
                    yield self._batch(p, rows)
                    rows = []
            if rows:
                yield self._batch(p, rows)

    @staticmethod
    def _batch(p: _Range, rows: list) -> pa.RecordBatch:
        n = len(rows)
        quals = [(np.minimum(np.frombuffer(q, np.uint8), 93) + 33).tobytes().decode() for _, _, _, q, _ in rows]
        # Clips count from 1 and 0 is none: left ones become the first base that stays, right ones the end behind it.
        clips = np.array([c for *_, c in rows], np.int32) - np.array([1, 0, 1, 0], np.int32)
        clips = np.maximum(clips, 0)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()), pa.array([p.uri] * n), pa.array([r[1].decode() for r in rows]), pa.array([""] * n),
                pa.array([r[2].decode().upper() for r in rows]), pa.array(quals), pa.array(["sff"] * n), *[pa.array(clips[:, k].copy()) for k in range(4)],
            ],
            [c.split()[0] for c in SCHEMA.split(", ")],
        )


class SffDataSource(DataSource):
    """spark.read.format("sff").option("path", "file:///a.sff,file:///b.sff").load()"""

    @classmethod
    def name(cls):
        return "sff"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return SffReader(self.options)


def read_sff(spark: SparkSession, *uris: str, split_bytes: int = 64 << 20) -> DataFrame:
    """Reads of SFF files with all their bases in upper case and four clips: the first base that stays (left) and the
    end of what stays (right, 0: none), by quality and by adapter.  ord follows the files and their reads."""
    spark.dataSource.register(SffDataSource)
    return spark.read.format("sff").option("splitBytes", split_bytes).option("path", ",".join(uris)).load()


def clip_range(min_left: int = 0) -> tuple[Column, Column]:
    """Start and end (not in it) of what all four clips leave of a read; at least min_left bases are clipped."""
    n = F.length("seq")
    left = F.greatest("clip_qual_left", "clip_adapter_left", F.lit(min_left))
    ends = [F.when(F.col(c) > 0, F.col(c)).otherwise(n) for c in ("clip_qual_right", "clip_adapter_right")]
    right = F.least(*ends, n)
    return F.least(left, n), F.greatest(right, F.least(left, n))


def clip_sff(reads: DataFrame, trim: bool = False, min_left: int = 0) -> DataFrame:
    """Reads with what the clips take off in lower case or, with trim, cut off (qualities too).

    min_left raises the left clip and leaves the right one as it is."""
    start, end = clip_range(min_left)
    part = lambda c, a, b: F.substr(F.col(c), a + 1, F.greatest(b - a, F.lit(0)))
    if trim:
        return reads.withColumns({"seq": part("seq", start, end), "qual": part("qual", start, end)})
    n = F.length("seq")
    return reads.withColumn("seq", F.concat(F.lower(part("seq", F.lit(0), start)), part("seq", start, end), F.lower(part("seq", end, n))))


def clip_advice(reads: DataFrame, check: int = 50, most: float = 0.5, already: int = 0) -> DataFrame:
    """Per file how many bases more (with those already clipped) look like a tag, and which: file, bases, seq.

    Leading positions, of the first check ones, at which one base has at least the share most of A, C, G and T
    in upper case; positions without any are passed over.  A file whose first counted position has none such
    has null.  The count ends at the first position that falls short, or at the last that was checked.
    """
    chars = F.filter(F.split(F.substring("seq", 1, check), ""), lambda c: c != "")
    rows = reads.select("file", F.posexplode(chars).alias("pos", "base")).where(F.col("base").isin("A", "T", "C", "G"))
    # Of equal shares the first of A, T, C and G.
    order = F.instr(F.lit("GCTA"), F.col("base"))
    counts = rows.groupBy("file", "pos", "base").agg(F.count("*").alias("n"))
    top = counts.groupBy("file", "pos").agg(F.max(F.struct("n", order.alias("o"), "base")).alias("top"), F.sum("n").alias("all"))
    top = top.withColumn("high", F.col("top.n") / F.col("all") >= most)
    ahead = F.bool_and("high").over(Window.partitionBy("file").orderBy("pos"))  # at most check rows a file
    found = top.withColumn("ahead", ahead).groupBy("file").agg(
        F.min(F.when(~F.col("high"), F.col("pos"))).alias("first_low"), F.max("pos").alias("last"),
        F.array_sort(F.collect_list(F.when(F.col("ahead"), F.struct("pos", F.col("top.base").alias("b"))))).alias("s"),
    )
    some = F.size("s") > 0
    bases = F.coalesce("first_low", F.col("last") + 1) + already
    found = found.select("file", F.when(some, bases).cast("int").alias("bases"), F.when(some, F.array_join(F.transform("s", lambda x: x["b"]), "")).alias("seq"))
    return reads.select("file").distinct().join(found, "file", "left")


def trace_information(reads: DataFrame) -> Column:
    """A read's clips as an element of a trace volume; right clips at or behind the read's end are left out."""
    n = F.length("seq")
    tag = lambda name, value: F.when(value > 0, F.concat(F.lit(f"\t\t<{name}>"), value.cast("string"), F.lit(f"</{name}>\n"))).otherwise("")
    left = lambda c: F.when(F.col(c) > 0, F.col(c) + 1).otherwise(0)
    right = lambda c: F.when(F.col(c) < n, F.col(c)).otherwise(0)
    clean = F.replace(F.replace("name", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.concat(
        F.lit("\t<trace>\n\t\t<trace_name>"), clean, F.lit("</trace_name>\n"),
        tag("clip_quality_left", left("clip_qual_left")), tag("clip_quality_right", right("clip_qual_right")),
        tag("clip_vector_left", left("clip_adapter_left")), tag("clip_vector_right", right("clip_adapter_right")), F.lit("\t</trace>"),
    )


def write_trace_information(reads: DataFrame, path: str) -> None:
    """Trace volumes of the reads in order of ord, a file a task; each is a whole document."""
    rows = reads.select("ord", trace_information(reads).alias("value")).repartitionByRange("ord").sortWithinPartitions("ord")

    def run(batches):
        for k, batch in enumerate(batches):
            text = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(text if k else ['<?xml version="1.0"?>\n<trace_volume>', *text])], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["</trace_volume>"])], ["value"])

    rows.select("value").mapInArrow(run, "value string").write.text(path)
