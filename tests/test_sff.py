"""SFF files that the tests write."""

import random
import struct
import xml.etree.ElementTree as xml

import pytest

from strandlake.sources.sff import clip_advice, clip_sff, read_sff, write_trace_information

FLOWS = 13


def pad(data):
    return data + bytes(-len(data) % 8)


def sff(reads, index=None, at=None):
    """An SFF file; index: none, b'.srt1.00' or b'.mft1.00', placed before read at, or last."""
    head = 31 + FLOWS + 4
    head_size = len(pad(bytes(head)))
    records = []
    for name, seq, qual, clips in reads:
        own = struct.pack(">HHI4H", len(pad(bytes(16 + len(name)))), len(name), len(seq), *clips) + name.encode()
        body = bytes(2 * FLOWS) + bytes(len(seq)) + seq.encode() + bytes(qual)
        records.append(pad(own) + pad(body))
    at = len(records) if at is None else at

    def laid(size):
        places, place, index_at = [], head_size, 0
        for k in range(len(records) + 1):
            if index and k == at:
                index_at, place = place, place + len(pad(bytes(size)))
            if k < len(records):
                places.append(place)
                place += len(records[k])
        return places, index_at

    def indexed(places):
        entries = b"".join(n.encode() + b"\0" + bytes([p // 255**3 % 255, p // 255**2 % 255, p // 255 % 255, p % 255]) + b"\xff" for (n, *_), p in sorted(zip(reads, places), key=lambda x: x[0][0]))
        return index + (struct.pack(">II", 5, len(entries)) + b"<xml>" if index == b".mft1.00" else b"\0\0\0\0") + entries

    block = b""
    if index:
        block = indexed(laid(len(indexed(laid(0)[0])))[0])
    places, index_at = laid(len(block))
    out = struct.pack(">4s4sQIIHHHB", b".sff", b"\0\0\0\1", index_at, len(block), len(reads), head_size, 4, FLOWS, 1) + b"T" * FLOWS + b"TCAG"
    out = pad(out)
    for k in range(len(records) + 1):
        if index and k == at:
            out += pad(block)
        out += records[k] if k < len(records) else b""
    return out


def made(n, seed=1):
    rng = random.Random(seed)
    reads = []
    for k in range(n):
        size = rng.randrange(1, 60)
        reads.append((f"R{rng.randrange(10**6):06}x{k}", "".join(rng.choices("ACGTN", k=size)), [rng.randrange(60) for _ in range(size)], [rng.choice([0, 0, 1, 5, size, 70]) for _ in range(4)]))
    return reads


def expected(reads):
    return [(n, s, "".join(chr(q + 33) for q in qual), *[max(0, c - (k % 2 == 0)) for k, c in enumerate(clips)]) for n, s, qual, clips in reads]


@pytest.mark.parametrize("index, at", [(None, None), (b".srt1.00", None), (b".mft1.00", None), (b".mft1.00", 20), (b".srt1.00", 0)])
def test_reads_for_any_split(spark, tmp_path, index, at):
    reads = made(60)
    (tmp_path / "a.sff").write_bytes(sff(reads, index, at))
    for split in (1, 500, 1 << 20):
        df = read_sff(spark, f"file://{tmp_path}/a.sff", split_bytes=split)
        got = [tuple(r) for r in df.orderBy("ord").drop("ord", "file", "descr", "fmt").collect()]
        assert got == expected(reads)
        assert (df.rdd.getNumPartitions() > 3) == bool(index and split < 1000)


def test_masks_and_trims(spark, tmp_path):
    reads = [("a", "ACGTACGTAC", list(range(10)), (3, 8, 0, 9)), ("b", "ACGTACGTAC", list(range(10)), (0, 0, 2, 0)), ("c", "ACGT", list(range(4)), (3, 2, 0, 0)), ("d", "ACGT", list(range(4)), (9, 0, 0, 0))]
    (tmp_path / "a.sff").write_bytes(sff(reads))
    df = read_sff(spark, f"file://{tmp_path}/a.sff")
    seqs = lambda d: [r.seq for r in d.orderBy("ord").collect()]
    assert seqs(clip_sff(df)) == ["acGTACGTac", "aCGTACGTAC", "acgt", "acgt"]
    assert seqs(clip_sff(df, trim=True)) == ["GTACGT", "CGTACGTAC", "", ""]
    assert seqs(clip_sff(df, min_left=4)) == ["acgtACGTac", "acgtACGTAC", "acgt", "acgt"]
    assert [r.qual for r in clip_sff(df, trim=True, min_left=4).orderBy("ord").collect()][0] == "%&'("


def test_advice(spark):
    def advice(seqs, **how):
        rows = spark.createDataFrame([("f", s) for s in seqs] + [("low", "acgt")], "file string, seq string")
        return {r.file: (r.bases, r.seq) for r in clip_advice(rows, **how).collect()}

    assert advice(["ACGA", "ACTC", "ACCG", "ACAT"]) == {"f": (2, "AC"), "low": (None, None)}
    assert advice(["acGT", "acGA"], already=3)["f"] == (7, "GA")
    assert advice(["ACGT", "CGTA", "GTAC", "TACG"])["f"] == (None, None)
    assert advice(["AAAA", "AAAA"], check=3)["f"] == (3, "AAA")


def test_trace_information(spark, tmp_path):
    reads = [("a&b", "ACGTACGTAC", [1] * 10, (3, 8, 0, 10)), ("c", "ACGT", [1] * 4, (0, 0, 2, 0))]
    (tmp_path / "a.sff").write_bytes(sff(reads))
    write_trace_information(read_sff(spark, f"file://{tmp_path}/a.sff"), f"{tmp_path}/out")
    traces = [t for part in sorted((tmp_path / "out").glob("part-*")) if part.stat().st_size for t in xml.parse(part).getroot()]
    assert [{c.tag: c.text for c in t} for t in traces] == [
        {"trace_name": "a&b", "clip_quality_left": "3", "clip_quality_right": "8"}, {"trace_name": "c", "clip_vector_left": "2"}]


def test_broken_files(spark, tmp_path):
    (tmp_path / "a.sff").write_bytes(b"no sff at all, but long enough")
    (tmp_path / "b.sff").write_bytes(sff(made(5))[:-30])
    for name, message in (("a", "not an SFF file"), ("b", "ends within a read")):
        with pytest.raises(Exception, match=message):
            read_sff(spark, f"file://{tmp_path}/{name}.sff").count()
