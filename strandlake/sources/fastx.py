"""FASTA and FASTQ: a splittable Python data source, format guesses, and writers."""

from __future__ import annotations

import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "ord long, file string, name string, descr string, seq string, qual string, fmt string"
#: Bits of ord that hold a record's place in its file; the file's number stands above them.
PLACE_BITS = 44


def guess_format(start: bytes) -> str:
    """Format by the first bytes of a file: fasta, qual, fastq, genbank or embl."""
    text = start.lstrip()
    if text.startswith(b">"):
        first = text.split(b"\n", 2)[1:2]
        return "qual" if first and first[0].strip()[:1].isdigit() else "fasta"
    for mark, fmt in ((b"@", "fastq"), (b"LOCUS", "genbank"), (b"ID", "embl")):
        if text.startswith(mark):
            return fmt
    raise ValueError("unknown sequence format" if text else "the file is empty")


def split_title(title: str) -> tuple[str, str]:
    name, _, descr = title.partition(" ")
    return name, descr


def parse_fasta(lines):
    """(line number of the title, title, sequence) of each record; sequences may span lines."""
    title, at, parts = None, 0, []
    for k, line in enumerate(lines):
        line = line.rstrip("\r\n")
        if line.startswith(">"):
            if title is not None:
                yield at, title, "".join(parts)
            title, at, parts = line[1:], k, []
        elif title is not None:
            parts.append(line.strip())
    if title is not None:
        yield at, title, "".join(parts)


def parse_fastq(lines):
    """(line number, title, sequence, qualities); multi-line records by the sequence's length, so an @
    that starts a line of qualities is no title.  Raises ValueError where lengths disagree."""
    lines = enumerate(x.rstrip("\r\n") for x in lines)
    for at, line in lines:
        if not line:
            continue
        if not line.startswith("@"):
            raise ValueError(f"no title where one is due: {line[:40]!r}")
        seq, quals, have = [], [], 0
        for _, s in lines:
            if s.startswith("+"):
                break
            seq.append(s.strip())
        want = sum(map(len, seq))
        while have < want:
            _, q = next(lines, (0, None))
            if q is None:
                raise ValueError(f"qualities are missing: {line[:40]!r}")
            quals.append(q)
            have += len(q)
        if have != want:
            raise ValueError(f"lengths of sequence and qualities differ: {line[:40]!r}")
        yield at, line[1:], "".join(seq), "".join(quals)


class _Range(InputPartition):
    def __init__(self, number: int, uri: str, start: int, end: int | None, fmt: str):
        self.number, self.uri, self.start, self.end, self.fmt = number, uri, start, end, fmt


def _open(uri: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store, path


class FastxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p.strip() for p in options["path"].split(",")]
        self.fmt = options.get("format", "auto")
        self.split = int(options.get("splitBytes", 64 << 20))
        self.multiline = options.get("multiline", "false") == "true"

    def partitions(self):
        """Byte ranges; compressed files and FASTQ whose records span lines are one range each."""
        out = []
        for number, uri in enumerate(self.paths):
            store, path = _open(uri)
            with store.open_input_file(path) as f:
                head, size = f.read(4096), f.size()
            packed = head[:2] in (b"\x1f\x8b", b"BZ")
            if packed:
                with self._stream(uri) as f:
                    head = f.read(4096)
            fmt = guess_format(head) if self.fmt == "auto" else self.fmt
            if fmt not in ("fasta", "fastq"):
                raise ValueError(f"{uri}: {fmt} is not read by this source")
            step = size if packed or (fmt == "fastq" and self.multiline) else self.split
            out += [_Range(number, uri, s, None if packed else min(s + step, size), fmt) for s in range(0, max(size, 1), max(step, 1))]
        return out

    @staticmethod
    def _stream(uri: str):
        import pyarrow as pa

        store, path = _open(uri)
        with store.open_input_file(path) as f:
            mark = f.read(2)
        kind = {b"\x1f\x8b": "gzip", b"BZ": "bz2"}.get(mark)
        return pa.CompressedInputStream(store.open_input_file(path), kind) if kind else store.open_input_file(path)

    def _lines(self, p: _Range):
        """(offset, line) of whole lines from the range's first record on, past its end for the last one."""
        at = max(0, p.start - 1) if p.end is not None else 0
        stream = io.BufferedReader(_Raw(self._stream(p.uri), at), 1 << 20)
        if at or (p.end is not None and p.start):
            at += len(stream.readline())
        for raw in stream:
            yield at, raw.decode()
            at += len(raw)

    def read(self, p: _Range):
        mark = ">" if p.fmt == "fasta" else "@"
        held, started, window = [], p.start == 0 or p.end is None, []
        lines = self._lines(p)
        if not started:  # the first title: in FASTQ the line two further must begin with +
            for at, line in lines:
                window.append((at, line))
                if p.fmt == "fasta":
                    if line.startswith(mark):
                        held = window[-1:]
                        break
                elif len(window) >= 3 and window[-1][1].startswith("+") and window[-3][1].startswith(mark):
                    held = window[-3:]
                    break
                window = window[-3:]
            else:
                return
        offsets = []

        def text():
            for at, line in (*held, *lines):
                offsets.append(at)
                yield line

        parse = parse_fasta if p.fmt == "fasta" else parse_fastq
        for at, title, seq, *qual in parse(text()):
            place = offsets[at]
            if p.end is not None and place >= p.end:
                return
            name, descr = split_title(title)
            yield (p.number << PLACE_BITS) + place, p.uri, name, descr, seq, qual[0] if qual else None, p.fmt


class _Raw(io.RawIOBase):
    """A raw stream over an Arrow file, from a place on."""

    def __init__(self, source, start: int):
        self.source = source
        if start:
            source.seek(start)

    def readable(self):
        return True

    def readinto(self, buffer):
        data = self.source.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


class FastxDataSource(DataSource):
    """spark.read.format("fastx").option("path", "file:///a.fastq,file:///b.fastq").load()"""

    @classmethod
    def name(cls):
        return "fastx"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FastxReader(self.options)


def read_reads(spark: SparkSession, *uris: str, fmt: str = "auto", split_bytes: int = 64 << 20, multiline: bool = False) -> DataFrame:
    """Reads of FASTA and FASTQ files, in order of ord (file, then place)."""
    spark.dataSource.register(FastxDataSource)
    reader = spark.read.format("fastx").option("format", fmt).option("splitBytes", split_bytes)
    return reader.option("multiline", str(multiline).lower()).option("path", ",".join(uris)).load()


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """name: the distinct names of a list, one a line; blank lines are none.  For semi and anti joins with reads."""
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", r"\s+$", "")).alias("name")).where("name <> ''").distinct()


def join_qualities(fasta: DataFrame, qual: DataFrame, offset: int = 33) -> DataFrame:
    """FASTA reads and a table of name and whitespace-separated scores to FASTQ reads, by name."""
    scores = F.transform(F.split(F.trim("scores"), r"\s+"), lambda q: F.char(q.cast("int") + offset))
    return fasta.drop("qual").join(qual.select("name", F.array_join(scores, "").alias("qual")), "name").withColumn("fmt", F.lit("fastq"))


def format_records(fmt: str) -> Column:
    """One text per read, lines joined by line feeds, without the last one."""
    title = F.concat_ws(" ", "name", F.when(F.col("descr") != "", F.col("descr")))
    if fmt == "fasta":
        return F.concat(F.lit(">"), title, F.lit("\n"), "seq")
    return F.concat(F.lit("@"), title, F.lit("\n"), "seq", F.lit("\n+\n"), "qual")


def write_reads(df: DataFrame, path: str, fmt: str = "fastq", compression: str = "none") -> None:
    """Write reads in order of ord, a file a task; reads without bases are left out.  FASTQ reads may be
    written as FASTA, not the other way round."""
    if fmt == "fastq" and "qual" not in df.columns:
        raise ValueError("reads without qualities can't be written as fastq")
    rows = df.where(F.length("seq") > 0).repartitionByRange("ord").sortWithinPartitions("ord")
    rows.select(format_records(fmt).alias("value")).write.option("compression", compression).text(path)


def write_split(df: DataFrame, flag: str, passed: str, rest: str, fmt: str = "fastq") -> None:
    """Reads that passed and all others to two places, computed once."""
    df = df.persist()
    write_reads(df.where(F.col(flag)), passed, fmt)
    write_reads(df.where(~F.col(flag)), rest, fmt)
    df.unpersist()
