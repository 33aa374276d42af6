"""BAM files that the tests write, against the same reads as SAM text."""

import random
import re
import struct
import zlib

import pytest

from strandlake.sources.alignments import read_groups, read_sam
from strandlake.sources.bam import BASES, OPERATIONS, Header, Blocks, bam_read_groups, bam_references, block_size, read_bam

REFS = [("chr1", 100_000), ("chr2", 5000), ("scaffold_with_a_long_name", 900)]
HEADER = "@HD\tVN:1.6\n" + "".join(f"@SQ\tSN:{n}\tLN:{k}\n" for n, k in REFS) + "@RG\tID:g1\tSM:one\n@RG\tID:g2\tSM:two\tPL:x\n"


def bgzf(data, size):
    """Data in blocks of size bytes, and the empty last one."""
    out = b""
    for k in [*range(0, len(data), size), None]:
        part = b"" if k is None else data[k : k + size]
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = packer.compress(part) + packer.flush()
        head = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<HHHH", 6, 0x4342, 2, len(packed) + 25)
        out += head + packed + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def record(qname, flag, ref, pos, mapq, cigar, seq, qual, tags):
    ops = [(int(n), op) for n, op in re.findall(r"(\d+)(\D)", cigar)]
    codes = b"".join(struct.pack("<I", n << 4 | OPERATIONS.index(op)) for n, op in ops)
    extra = b""
    if len(ops) > 65535:
        bases = sum(n for n, op in ops if op in "MIS=X")
        extra, codes = b"CGBI" + struct.pack("<I", len(ops)) + codes, struct.pack("<II", bases << 4 | 4, 7 << 4 | 3)
    number = next((k for k, (n, _) in enumerate(REFS) if n == ref), -1)
    half = [BASES.index(c) for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(half[::2], half[1::2]))
    quals = b"\xff" * len(seq) if qual == "*" else bytes(ord(c) - 33 for c in qual)
    body = struct.pack("<iiBBHHHiiii", number, pos - 1, len(qname) + 1, mapq, 0, len(codes) // 4, flag, len(seq), -1, -1, 0)
    body += qname.encode() + b"\0" + codes + packed + quals + extra + b"".join(tags)
    return struct.pack("<i", len(body)) + body


def made(n, seed=1):
    """SAM text and BAM records of n reads: short and long ones, unmapped ones, odd tags, absent values."""
    rng = random.Random(seed)
    lines, records = [], []
    for k in range(n):
        size = rng.choice([1, 7, 50, 51, 90_000 if k % 40 == 3 else 100])
        seq = "".join(rng.choices("ACGTN", k=size))
        qual = "*" if k % 9 == 0 else "".join(chr(33 + rng.randrange(60)) for _ in seq)
        ref, pos = (("*", 0) if k % 6 == 0 else (rng.choice(REFS)[0], rng.randrange(1, 900)))
        cigar = "*" if ref == "*" else rng.choice([f"{size}M", f"{size // 2}S{size - size // 2}=" if size > 1 else "1X"])
        if k == 5:
            ref, pos, cigar = "chr1", 10, "1M1I" * 40_000
            seq = "A" * 80_000
            qual = "*"
        group = rng.choice([None, "g1", "g2"])
        plain, tags = ["NM:i:3", "CO:Z:see RGZ here", "XB:B:s,1,-2"], [b"NMC\x03", b"COZsee RGZ here\0", b"XBBs" + struct.pack("<ihh", 2, 1, -2)]
        if group:
            at = rng.randrange(4)
            plain.insert(at, f"RG:Z:{group}")
            tags.insert(at, b"RGZ" + group.encode() + b"\0")
        flag = 4 if ref == "*" else rng.choice([0, 16, 99])
        mapq = rng.randrange(61)
        lines.append("\t".join(map(str, (f"read/{k}", flag, ref, pos, mapq, cigar, "*", 0, 0, seq, qual, *plain))))
        records.append(record(f"read/{k}", flag, ref, pos, mapq, "" if cigar == "*" else cigar, seq, qual, tags))
    lines.append("empty\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*")
    records.append(record("empty", 4, "*", 0, 0, "", "", "*", []))
    return lines, records


def header_bytes():
    text = HEADER.encode()
    refs = b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k) for n, k in REFS)
    return b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(REFS)) + refs


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("bam")
    lines, records = made(150)
    (folder / "a.sam").write_text(HEADER + "\n".join(lines) + "\n")
    for name, size in (("small", 300), ("usual", 65_000)):
        (folder / f"{name}.bam").write_bytes(bgzf(header_bytes() + b"".join(records), size))
    return folder


def rows(df):
    return [tuple(r) for r in df.orderBy("ord").drop("ord").collect()]


@pytest.mark.parametrize("name, split", [("small", 1 << 30), ("small", 50_000), ("small", 7001), ("usual", 1 << 30), ("usual", 40_000), ("usual", 997)])
def test_bam_equals_sam_for_any_split(spark, files, name, split):
    want = rows(read_sam(spark, f"{files}/a.sam"))
    found = read_bam(spark, f"file://{files}/{name}.bam", split_bytes=split)
    assert rows(found) == want
    assert found.select("ord").distinct().count() == len(want) == 151


def test_several_files_in_order(spark, files):
    one = f"file://{files}/small.bam"
    got = rows(read_bam(spark, one, f"file://{files}/usual.bam", split_bytes=30_000))
    assert got == 2 * rows(read_bam(spark, one))


def test_headers(spark, files):
    uri = f"file://{files}/usual.bam"
    assert [tuple(r) for r in bam_references(spark, uri).collect()] == [(k, *x) for k, x in enumerate(REFS)]
    assert sorted(map(tuple, bam_read_groups(spark, uri).collect())) == sorted(map(tuple, read_groups(spark, f"{files}/a.sam").collect()))


def test_no_records_and_broken_files(spark, tmp_path):
    (tmp_path / "none.bam").write_bytes(bgzf(header_bytes(), 100))
    assert read_bam(spark, f"file://{tmp_path}/none.bam", split_bytes=50).count() == 0
    whole = header_bytes() + b"".join(made(30)[1])
    (tmp_path / "cut.bam").write_bytes(bgzf(whole[:-5], 4000))
    with pytest.raises(Exception, match="ends within a record"):
        read_bam(spark, f"file://{tmp_path}/cut.bam").count()
    (tmp_path / "text.bam").write_bytes(bgzf(b"not a bam file at all", 10))
    with pytest.raises(Exception, match="not a BAM file"):
        read_bam(spark, f"file://{tmp_path}/text.bam").count()
    with pytest.raises(ValueError):
        import io

        Header(Blocks(io.BytesIO(b"plain text, long enough"), 23))


def test_block_size():
    assert block_size(bgzf(b"x", 9)) == len(bgzf(b"x", 9)) - len(bgzf(b"", 9))
    assert block_size(b"\x1f\x8b\x08\x00" + bytes(20)) is None and block_size(b"short") is None
