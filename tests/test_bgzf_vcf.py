"""Block-compressed VCF that the tests write: whole reads, ranges through the index, and the writer."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.sources.bgzf_vcf import fetch_range, files_of, index_bgzf_vcf, packed, read_bgzf_vcf, vcf_head, write_bgzf_vcf
from strandlake.sources.vcf import sites_of

HEAD = ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"]
BINS = 1 << 14


def made(n=3000, seed=4):
    """(chrom, pos, stop, line), sorted: sites at bin borders, deletions over several bins, ties."""
    rng, rows = random.Random(seed), []
    for chrom in ("chr1", "chr10", "chr2"):
        places = sorted([rng.randrange(400_000) for _ in range(n // 3)] + [BINS - 1, BINS, BINS, 2 * BINS - 1, 70_000])
        for pos in places:
            ref = "A" * (40_000 if pos == 70_000 else rng.choice([1, 1, 1, 2, 30]))
            rows.append((chrom, pos, pos + len(ref), f"{chrom}\t{pos + 1}\t.\t{ref}\tC\t{rng.randrange(99)}\tPASS\tDP={rng.randrange(50)}"))
    return rows


def blocks_of(data, size, empty_every=5):
    out = b""
    for k, at in enumerate(range(0, len(data), size)):
        out += packed(data[at : at + size]) + (packed(b"") if k % empty_every == 0 else b"")
    return out + packed(b"")


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def indexed(spark, rows, tmp_path_factory):
    folder = tmp_path_factory.mktemp("bgzf")
    text = "\n".join([*HEAD, *(r[3] for r in rows)]) + "\n"
    (folder / "a.vcf.gz").write_bytes(blocks_of(text.encode(), 700))
    uri, index = f"file://{folder}/a.vcf.gz", f"file://{folder}/a.idx"
    index_bgzf_vcf(spark, uri, index, split_bytes=20_000)
    return uri, index


@pytest.mark.parametrize("split", [1, 333, 5000, 1 << 26])
def test_any_split_gives_each_line_once(spark, tmp_path, split):
    rows = made(90 if split == 1 else 900)
    for size, end in ((64, "\n"), (700, "")):
        # With 64 bytes a block, many lines begin exactly where a block does, and long ones fill many blocks.
        lines = [*HEAD, *(r[3] for r in rows if len(r[3]) < 1000)]
        lines = [x + "x" * (-(len(x) + 1) % 64) if k % 3 else x for k, x in enumerate(lines[2:])]
        (tmp_path / f"{size}.vcf.gz").write_bytes(blocks_of(("\n".join([*HEAD, *lines]) + end).encode(), size))
        got = read_bgzf_vcf(spark, f"file://{tmp_path}/{size}.vcf.gz", split_bytes=max(split, 40)).orderBy("ord").collect()
        assert [r.value for r in got] == lines


def test_ranges_equal_a_full_scan(spark, rows, indexed):
    for chrom, low, high in [("chr1", 0, 10), ("chr2", BINS - 1, BINS), ("chr2", BINS, BINS + 1), ("chr10", 100_000, 100_001), ("chr1", 50_000, 260_000), ("chr2", 390_000, None), ("chr1", 5_000_000, None), ("chrX", 0, None), ("chr", 0, 100)]:
        for split in (200, 1 << 26):
            got = fetch_range(spark, *indexed, chrom, low, high, split_bytes=split).orderBy("ord").collect()
            assert [r.value for r in got] == [r[3] for r in rows if r[0] == chrom and r[2] > low and (high is None or r[1] < high)]


def test_only_the_wanted_blocks_are_read(spark, indexed):
    from strandlake.sources.bgzf_vcf import BgzfVcfReader

    uri, index = indexed
    parts = BgzfVcfReader({"path": uri, "index": index, "chrom": "chr10", "start": "200000", "end": "200010"}).partitions()
    read = sum((last >> 16) - (first >> 16) for p in parts for _, first, last in p.pieces)
    whole = sum(p.end - p.start for p in BgzfVcfReader({"path": uri}).partitions())
    assert 0 < read < whole / 20
    assert BgzfVcfReader({"path": uri, "index": index, "chrom": "chrX"}).partitions() == []


def test_filters_on_one_table_do_not_meddle(spark, rows, indexed):
    table = read_bgzf_vcf(spark, *indexed, split_bytes=2000)
    for chrom in ("chr2", "chr1"):
        assert table.where(F.col("chrom") == chrom).count() == sum(r[0] == chrom for r in rows)
    assert table.count() == len(rows)


def test_written_files_are_read_back(spark, rows, tmp_path):
    body = spark.createDataFrame([(k, r[3]) for k, r in enumerate(rows)], "ord long, value string").repartitionByRange(4, "ord").sortWithinPartitions("ord")
    uri, index = f"file://{tmp_path}/out", f"file://{tmp_path}/out.idx"
    write_bgzf_vcf(body, uri, HEAD)
    assert len(files_of(uri)) == 4 and vcf_head(uri) == HEAD
    index_bgzf_vcf(spark, uri, index)
    assert [r.value for r in read_bgzf_vcf(spark, uri, split_bytes=3000).orderBy("ord").collect()] == [r[3] for r in rows]
    got = fetch_range(spark, uri, index, "chr10", 50_000, 80_000)
    want = [r for r in rows if r[0] == "chr10" and r[2] > 50_000 and r[1] < 80_000]
    assert [r.value for r in got.orderBy("ord").collect()] == [r[3] for r in want]
    assert sites_of(got).select(F.sum("pos")).first()[0] == sum(r[1] for r in want)


def test_no_sites(spark, tmp_path):
    (tmp_path / "none.vcf.gz").write_bytes(blocks_of("\n".join(HEAD).encode(), 700))
    uri, index = f"file://{tmp_path}/none.vcf.gz", f"file://{tmp_path}/none.idx"
    index_bgzf_vcf(spark, uri, index)
    assert read_bgzf_vcf(spark, uri).count() == 0 and fetch_range(spark, uri, index, "chr1", 0).count() == 0
