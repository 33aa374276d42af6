"""Golden values for reads: trimming, segments, statistics and sources."""

import gzip

import pytest
from pyspark.sql import functions as F

from strandlake.functions import reads as R
from strandlake.operators import order, pairs, stats, trim
from strandlake.sources import fastx


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).first()["x"]


def kept(spark, quals, window, threshold, **options):
    qual = "".join(chr(q + 33) for q in quals)
    df = spark.createDataFrame([(1, "A" * len(quals), qual)], "ord long, seq string, qual string")
    cut = trim.trim_or_mask(trim.recommend(df, trim.quality_segments(F.col("qual"), window, threshold, **options)))
    return [ord(c) - 33 for c in cut.first()["qual"]]


def test_quality_trimming(spark):
    quals = [10, 10, 20, 30, 30, 30, 40, 40, 30, 30, 20, 20, 10, 10]
    assert kept(spark, quals, 5, 30) == [20, 30, 30, 30, 40, 40, 30, 30, 20]
    assert kept(spark, quals, 5, 60) == []
    assert kept(spark, quals, 5, 5) == quals
    assert kept(spark, [20, 20, 20, 60, 60, 60, 60, 60, 20, 20, 20, 20], 5, 50) == [20, 60, 60, 60, 60, 60, 20]
    quals = [40, 40, 13, 11, 40, 9, 40, 4, 27, 38, 40, 4, 11, 40, 40, 10, 10, 21, 3, 40, 9, 9, 12, 10, 9]
    assert kept(spark, quals, 5, 25) == [40, 4, 27, 38, 40]
    assert kept(spark, quals, 5, 25, left=False) == quals[:11]
    assert kept(spark, quals, 5, 25, right=False) == quals[6:]


def test_edges_and_masks(spark):
    df = spark.createDataFrame([(1, "p", "ACCG"), (2, "p", "AAACCCGGG")], "ord long, pair string, seq string")
    cut = trim.trim_or_mask(trim.recommend(df, trim.edge_segments(F.length("seq"), 1, 0)), pair=["pair"])
    assert [r.seq for r in cut.orderBy("ord").collect()] == ["CCG", "AACCCGGG"]
    cut = trim.trim_or_mask(trim.recommend(df, trim.edge_segments(F.length("seq"), 4, 4)), pair=["pair"])
    assert [(r.seq, r.route) for r in cut.orderBy("ord").collect()] == [("", "lost"), ("C", "orphan")]
    masked = trim.trim_or_mask(trim.recommend(df, trim.edge_segments(F.length("seq"), 1, 1)), mask=True)
    assert [r.seq for r in masked.orderBy("ord").collect()] == ["aCCg", "aAACCCGGg"]


def test_lower_case_trimming(spark):
    df = spark.createDataFrame([(1, "aaCTTTC"), (2, "CTTCaaa"), (3, "aaaa"), (4, "aCTCaCTTTTa")], "ord long, seq string")
    cut = trim.trim_or_mask(trim.recommend(df, trim.lower_case_segments(F.col("seq"))))
    assert [r.seq for r in cut.orderBy("ord").collect()] == ["CTTTC", "CTTC", "", "CTTTT"]


@pytest.mark.parametrize(
    "segments, length, free",
    [
        ([(0, 10), (15, 20)], 30, [(11, 14), (21, 29)]),
        ([(15, 20)], 21, [(0, 14)]),
        ([(15, 21)], 21, [(0, 14)]),
        ([], 4, [(0, 3)]),
        ([(0, 3)], 4, []),
        ([(0, 3), (4, 9), (2, 5)], 12, [(10, 11)]),
    ],
)
def test_complement(spark, segments, length, free):
    x = F.lit(None).cast("array<struct<start:int,end:int>>") if not segments else F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in segments])
    x = F.coalesce(x, F.array().cast("array<struct<start:int,end:int>>"))
    got = one(spark, trim.complement_segments(trim.merge_segments(x), F.lit(length)), n=1)
    assert [(s.start, min(s.end, length - 1)) for s in got] == free


def test_dust(spark):
    for seq, score in (
        ("TTTTTTTTTTTTTTTTTTTTTTTTTTTT", 100), ("TATATATATATATATATATATATATATA", 48), ("GAAGAAGAAGAAGAAGAAGAAGAAGAAG", 30.76),
        ("AACTGCAGTCGCTGATTCGATCGATCGA", 4.31), ("TTTTTTTTTTTTTTTTTTTTTTTTATCG", None),
    ):
        got = one(spark, R.dust_score(F.col("s")), s=seq)
        assert score is None or abs(got - score) < 1
    assert one(spark, R.dust_score(F.col("s")), s="ACGTA") is None
    assert one(spark, R.dust_score(F.col("s")), s="ACG") == 0


def counts(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v long").groupBy(F.col("v").alias("value")).agg(F.count("*").alias("n"))


def test_quartiles_and_nx(spark):
    q = stats.outlier_limits(stats.quartiles(counts(spark, range(1, 9)))).first()
    assert (q.q1, q.median, q.q3, q.iqr, q.low, q.high) == (2.5, 4.5, 6.5, 4.0, -3, 12)
    assert stats.quartiles(counts(spark, [1, 2, 3])).first().q1 is None
    lengths = counts(spark, [2, 2, 2, 3, 3, 4, 8, 8])
    assert stats.nx(lengths, 50).first()[0] == 8
    assert stats.nx(lengths, 95).first()[0] == 2


def test_histogram_closes_last_bin_only(spark):
    rows = stats.histogram(counts(spark, [0, 1, 2, 3, 4]), bins=3).orderBy("bin").collect()
    assert [(r.low, r.high, r.n) for r in rows] == [(0, 2, 2), (2, 4, 2), (4, 6, 1)]


def test_titles_and_flags(spark):
    for title, name, direction in (("seq1/1", "seq1", "fwd"), ("seq1 2:Y:18:A", "seq1", "rev"), ("seq.f", "seq", "fwd"), ("seq.r x", "seq", "rev"), ("seq", None, None)):
        got = one(spark, R.pair_of_title(F.col("t")), t=title)
        assert (got.template, got.direction) == (name, direction)
    assert R.make_flag(["is_paired", "strand"]) == 17
    assert one(spark, R.flag_names(F.col("f")), f=17) == ["is_paired", "strand"]


def test_polya(spark):
    tail = R.polya_tail(F.col("s"))
    assert one(spark, tail, s="atccgtcagcatcCAATAAAAA") in (5, 7, 8)
    assert one(spark, tail, s="ACGTACGT") == 0
    assert one(spark, R.polya_tail(F.col("s"), end="five_prime"), s="TTTTTTACGCG") == 6


def test_pairs(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 50), (3, "b", 50)], "ord long, template string, len int")
    both = pairs.flag_reads(df, F.col("len") > 10, ["template"])
    assert [r.passed for r in both.orderBy("ord").collect()] == [False, False, True]
    some = pairs.flag_reads(df, F.col("len") > 10, ["template"], failed_drags_pair=False)
    assert [r.passed for r in some.orderBy("ord").collect()] == [True, True, True]
    assert [r.route for r in pairs.match_pairs(df).orderBy("ord").collect()] == ["pair", "pair", "orphan"]
    with pytest.raises(ValueError):
        R.length_between(F.col("s"))


def test_duplicates_keep_first(spark):
    df = spark.createDataFrame([(1, "ACGT"), (2, "ACGA"), (3, "ACGT")], "ord long, seq string")
    assert [r.is_first for r in order.duplicates(df).orderBy("ord").collect()] == [True, True, False]
    assert [r.is_first for r in order.duplicates(df, length=3).orderBy("ord").collect()] == [True, False, False]


FASTQ = "@r1 one\nACGT\n+\n@@@@\n@r2\nAC\n+r2\n+@\n@r3 x y\nACGTA\n+\nIIIII\n"


@pytest.mark.parametrize("split", [5, 11, 1000])
def test_fastq_source(spark, tmp_path, split):
    path = tmp_path / "a.fastq"
    path.write_text(FASTQ)
    (tmp_path / "b.fastq.gz").write_bytes(gzip.compress(FASTQ.encode()))
    reads = fastx.read_reads(spark, path.as_uri(), (tmp_path / "b.fastq.gz").as_uri(), split_bytes=split).orderBy("ord").collect()
    want = [("r1", "one", "ACGT", "@@@@"), ("r2", "", "AC", "+@"), ("r3", "x y", "ACGTA", "IIIII")]
    assert [(r.name, r.descr, r.seq, r.qual) for r in reads] == want * 2


@pytest.mark.parametrize("split", [3, 8, 1000])
def test_fasta_source(spark, tmp_path, split):
    path = tmp_path / "a.fasta"
    path.write_text(">s1 d\nACGT\nAC\n>s2\nGG\n")
    reads = fastx.read_reads(spark, path.as_uri(), split_bytes=split).orderBy("ord").collect()
    assert [(r.name, r.descr, r.seq, r.qual) for r in reads] == [("s1", "d", "ACGTAC", None), ("s2", "", "GG", None)]


def test_multiline_fastq_and_errors():
    got = list(fastx.parse_fastq("@a\nAC\nGT\n+\n@I\nII\n@b\nA\n+\nI\n".splitlines(True)))
    assert [(t, s, q) for _, t, s, q in got] == [("a", "ACGT", "@III"), ("b", "A", "I")]
    with pytest.raises(ValueError):
        list(fastx.parse_fastq("@a\nAC\n+\nIII\n".splitlines(True)))
    with pytest.raises(ValueError):
        fastx.guess_format(b"")
    assert fastx.guess_format(b">a\n12 13\n") == "qual"


def test_write_reads(spark, tmp_path):
    path = tmp_path / "a.fastq"
    path.write_text(FASTQ)
    reads = fastx.read_reads(spark, path.as_uri())
    fastx.write_reads(reads.coalesce(1), (tmp_path / "out").as_uri(), "fastq", "gzip")
    files = sorted((tmp_path / "out").glob("part-*.gz"))
    text = "".join(gzip.decompress(f.read_bytes()).decode() for f in files)
    assert text == FASTQ.replace("+r2", "+")


def test_fastq_version(spark):
    version = lambda *rows: R.guess_fastq_version(spark.createDataFrame(list(rows), "seq string, qual string")).collect()[0].version
    assert version(("ACT", "hhh"), ("AC", "h!")) == "fastq"
    assert version(("ACT", "hhh"), ("A" * 250, "h" * 250), (None, None)) == "fastq-illumina"
    assert version(("A" * 251, "h" * 251), ("A", "!")) == "fastq"
    with pytest.raises(Exception, match="can't be told"):
        version(("A" * 251, "h" * 251))


def test_titles_without_direction_are_errors_if_strict(spark):
    title = F.col("title")
    assert one(spark, R.pair_of_title(title, strict=True), title="read/1").direction == "fwd"
    for bad in ("read/3", "read"):
        assert one(spark, R.pair_of_title(title), title=bad).direction is None
        with pytest.raises(Exception, match="no pair direction"):
            one(spark, R.pair_of_title(title, strict=True), title=bad)


def test_copies_with_other_letters(spark):
    reads = spark.createDataFrame([("r", "ACTG", "hhhh"), ("f", "ACTG", None)], "name string, seq string, qual string")
    cut = R.with_letters(reads, F.substring("seq", 1, 2), F.substring("qual", 1, 2), F.concat("name", F.lit("_cut"))).orderBy("name").collect()
    assert [tuple(r) for r in cut] == [("f_cut", "AC", None), ("r_cut", "AC", "hh")]
    assert R.with_letters(reads.where("qual IS NULL"), F.lit("A")).count() == 1
    with pytest.raises(Exception, match="don't fit"):
        R.with_letters(reads, F.lit("A")).collect()
