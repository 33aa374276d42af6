"""WARC archives with an index first: records are read by sorted, coalesced byte ranges."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, scratch_dir

#: Payloads of fewer bytes are never replaced by a revisit record.
LEAST_REVISIT = 1000
INDEX = "file string, offset long, length long, url string, digest string, record string"
READ = "record string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan_records(pages: DataFrame) -> DataFrame:
    """Adds payload, digest, record_type and refers_to.  Of equal payloads of at least 1000 bytes the
    page with the largest page_id is the response.  Only groups of more than one page are joined back."""
    payload = F.coalesce(F.encode("html", "utf-8"), F.lit(b""))
    pages = pages.select("page_id", "url", payload.alias("payload"))
    pages = pages.withColumns({"digest": F.sha1("payload"), "__key": F.sha2("payload", 256)})
    groups = (
        pages.where(F.octet_length("payload") >= LEAST_REVISIT)
        .groupBy("__key")
        .agg(F.max("page_id").alias("__keep"), F.count("*").alias("__n"))
        .where("__n > 1")
        .drop("__n")
    )
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("__keep")) & F.col("__keep").isNotNull(), F.lit(False))
    return pages.join(groups, "__key", "left").select(
        "page_id", "url", "payload", "digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("__keep")).alias("refers_to"),
    )


def record_name(page_id, digest: str) -> str:
    return f"urn:page:{'' if page_id is None else page_id}:{digest}"


def build_record(page_id, url: str | None, payload: bytes, digest: str, kind: str, refers_to, date: str) -> bytes:
    """One record as a gzip member of its own.  A revisit has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_name(page_id, digest)}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if url:
        head.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{record_name(refers_to, digest)}>", f"WARC-Profile: {PROFILE}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def parse_record(data: bytes) -> tuple[dict, bytes]:
    """Header fields (lower-case names) and payload of one unpacked record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record starts here")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])].partition(b"\r\n\r\n")[2]


def write_archives(planned: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write planned records, an archive a task, and the index: file, offset, length, url, digest, record.

    A file's name is new in every attempt and only finished tasks enter the index, so a lost executor
    leaves at most a file that no index row names.
    """
    base = scratch_dir(planned.sparkSession, "warc")

    def write(batches):
        store, folder = fs.FileSystem.from_uri(base)
        store.create_dir(folder, recursive=True)
        file = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, offset = None, 0
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            places = []
            for page_id, url, payload, digest, kind, refers_to in rows:
                record = build_record(page_id, url, payload, digest, kind, refers_to, date)
                out = out or store.open_output_stream(file, compression=None)
                out.write(record)
                places.append((offset, len(record)))
                offset += len(record)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([file] * len(rows), pa.string()),
                    pa.array([p[0] for p in places], pa.int64()),
                    pa.array([p[1] for p in places], pa.int64()),
                    batch.column(1),
                    batch.column(3),
                    pa.array([record_name(r[0], r[3]) for r in rows], pa.string()),
                ],
                ["file", "offset", "length", "url", "digest", "record"],
            )
        if out:
            out.close()

    columns = planned.select("page_id", "url", "payload", "digest", "record_type", "refers_to")
    return materialise(columns.mapInArrow(write, INDEX), "warc-index")


def read_archives(selected: DataFrame, request_bytes: int = 8 << 20, gap: int = 64 << 10, payloads: bool = True) -> DataFrame:
    """Read the records that index rows select.  Ranges of a file are sorted; those at most gap bytes
    apart are read with one request of about request_bytes, and records are handed on in batches of about
    as many bytes.  The bytes of the selected records decide the number of tasks.  A revisit has no
    payload of its own."""
    base = scratch_dir(selected.sparkSession, "")
    types = [pa.string()] * 3 + [pa.int64(), pa.string(), pa.binary()]
    names = ["record", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]

    def read(batches):
        store, _ = fs.FileSystem.from_uri(base)
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            at = 0
            while at < len(rows):
                file, start, length = rows[at]
                last, stop = at + 1, start + length
                while (
                    last < len(rows)
                    and rows[last][0] == file
                    and stop <= rows[last][1] <= stop + gap
                    and rows[last][1] + rows[last][2] - start <= request_bytes
                ):
                    stop, last = rows[last][1] + rows[last][2], last + 1
                with store.open_input_file(file) as source:
                    source.seek(start)
                    data = source.read(stop - start)
                out, held = [], 0
                for _, offset, size in rows[at:last]:
                    fields, payload = parse_record(zlib.decompress(data[offset - start : offset - start + size], 31))
                    digest = base64.b32decode(fields["warc-payload-digest"].split(":")[1]).hex()
                    kind, refers = fields["warc-type"], fields.get("warc-refers-to", "")[1:-1] or None
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"payload digest differs at {offset} in {file}")
                    whole = kind == "response"
                    out.append((fields["warc-record-id"][1:-1], kind, refers, len(payload) if whole else None, digest, payload if whole and payloads else None))
                    held += len(payload) if payloads else 0
                    if held >= request_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                at = last

    stripe = F.floor(F.col("offset") / request_bytes)
    size = selected.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    n_tasks = max(selected.sparkSession.sparkContext.defaultParallelism, -(-size // request_bytes))
    places = selected.repartition(n_tasks, "file", stripe).sortWithinPartitions("file", "offset")
    return places.select("file", "offset", "length").mapInArrow(read, READ)


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write all pages, read all archives back by their index, and describe each record.

    Null html is an empty payload.  Pages that repeat the response's page_id and payload are responses
    too; a null page_id revisits the largest one of its group.  Other columns are not read; an empty
    table writes no archive.  The archives are read once: what the records say is written down.
    """
    back = read_archives(write_archives(plan_records(pages)), payloads=False).drop("payload")
    back = materialise(back, "warc-records")
    page = F.element_at(F.split("record", ":"), 3)
    whole = back.where("record_type = 'response'").groupBy("record").agg(F.max("payload_bytes").alias("bytes"))
    whole = whole.withColumnRenamed("record", "refers_to")
    sizes = back.where("record_type = 'revisit'").join(whole, "refers_to", "left")
    rows = back.where("record_type = 'response'").withColumn("bytes", F.col("payload_bytes")).unionByName(sizes)
    return rows.select(
        F.when(page != "", page).cast("long").alias("page_id"),
        F.col("bytes").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        F.element_at(F.split("refers_to", ":"), 3).cast("long").alias("refers_to"),
    )


def op10_warc_index_first(spark, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, read back from the archives by their index."""
    return archived_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
