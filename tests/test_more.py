"""Golden values for recombination, exports, transcripts, sources and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import export, linkage, recombination, transcripts, variants
from strandlake.operators import hits as H
from strandlake.sources import alignments as sources
from strandlake.sources import vcf
from strandlake.streaming.alignments import running_reference_counts, stream_sam

CALLS = "ord long, chrom string, pos long, sample string, called boolean, a1 int, a2 int"


def calls(spark, *sites):
    rows = []
    for ord_, genotypes in enumerate(sites):
        for k, g in enumerate(genotypes):
            a, b = [None if x == "." else int(x) for x in g.split("/")]
            rows.append((ord_, "1", ord_ * 100, f"S{k + 1}", a is not None, a, b))
    return spark.createDataFrame(rows, CALLS)


def test_votes_give_parental_codes(spark):
    """Site 1 has no parental coding of its own; its neighbours' offspring tell it."""
    c = calls(
        spark,
        ["0/0", "1/1", "0/0", "0/0", "1/1", "1/1"],
        ["0/1", "0/1", "1/1", "1/1", "0/0", "0/0"],
        ["0/0", "1/1", "0/0", "0/0", "1/1", "1/1"],
    )
    sites = c.select("ord", "chrom", "pos").distinct()
    coding = linkage.parent_alleles(c, ["S1"], ["S2"])
    assert {(r.ord, r.A, r.B) for r in coding.collect()} == {(0, 0, 1), (2, 0, 1)}
    got = {r.ord: (r.outcome, r.A, r.B) for r in recombination.vote_codes(sites, c, coding, ["S3", "S4", "S5", "S6"]).collect()}
    assert got[1] == ("enough_support", 1, 0) and got[0] == ("enough_support", 0, 1)


def test_fisher_2x3_and_kosambi_fit():
    assert abs(recombination.fisher_2x3(np.array([[8, 0, 2], [1, 0, 5]])) - linkage.fisher_2x2(8, 2, 1, 5)) < 1e-9
    assert abs(recombination.fisher_2x3(np.array([[3, 3, 3], [3, 3, 3]])) - 1) < 1e-9
    d = np.linspace(1000, 200000, 40)
    slope, zero, err = recombination.fit_kosambi(d, recombination.kosambi_rate(d, 2e-6, 0.02))
    assert abs(slope - 2e-6) < 1e-8 and abs(zero - 0.02) < 1e-4 and err < 1e-3


def test_flanks(spark):
    sites = spark.createDataFrame([(0, "c", 5, "A", ["G"]), (1, "c", 8, "C", ["T"]), (2, "c", 1, "T", ["TA"])], "ord long, chrom string, pos long, ref string, alts array<string>")
    refs = spark.createDataFrame([("c", "GTCCCAGGCTTA")], "chrom string, seq string")
    got = {r.ord: r.text for r in export.flanked_alleles(sites, refs, 4).collect()}
    assert got[0] == "^CCC[A/G]GGYT" and got[1] == "CRGG[C/T]TTA" and got[2] == "G[T/TA]CCCR"
    assert export.flanked_alleles(sites, refs, 4, 4).where("ord = 1").first().text is None


def test_flanks_of_many_sites_at_a_place(spark):
    """Sites never meet sites, however many share a place; references keep their case and tiles cut nothing."""
    rng = np.random.default_rng(5)
    refs = {c: "".join(rng.choice(list("ACGTacgtN"), n)) for c, n in (("c", 150), ("d", 40), ("e", 0))}
    rows = []
    for k in range(600):
        c, p = str(rng.choice(["c", "d", "e", "unknown"], p=[0.7, 0.2, 0.05, 0.05])), int(rng.integers(0, 160))
        rows.append((k, c, p, str(rng.choice(["A", "AT", "G"])), [str(x) for x in rng.choice(["A", "C", "T", "GGG"], rng.integers(1, 3))]))
    sites = spark.createDataFrame(rows, "ord long, chrom string, pos long, ref string, alts array<string>")
    references = spark.createDataFrame([*refs.items(), ("none", None)], "chrom string, seq string")
    codes = {r.ord: r.code for r in sites.select("ord", export.iupac(F.col("ref"), F.col("alts")).alias("code")).collect()}
    first = {}
    for o, c, p, _, _ in rows:
        first.setdefault((c, p), codes[o])
    letter = lambda c, q: first.get((c, q)) or refs[c][q]
    expected = {}
    for o, c, p, ref, alts in rows:
        if c in refs:
            end = p + len(ref)
            left, right = ("".join(letter(c, q) for q in range(max(0, a), min(b, len(refs[c])))) for a, b in ((p - 20, p), (end, end + 20)))
            expected[o] = f"{left}[{'/'.join([ref, *alts])}]{right}" if min(len(left), len(right)) >= 5 else None
    for width in (7, 64, 4096):
        found = export.flanked_alleles(sites, references, 20, 5, width)
        assert {r.ord: r.text for r in found.collect()} == expected and found.count() == len(expected)
    assert "pos_2" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_sites_and_reads_are_counted_before_they_meet(spark):
    from collections import defaultdict

    from strandlake.operators.alignments import site_position_stats, site_read_positions

    reads = [(k, f"q{k}", [0, 16, 4][k % 3 % 2 if k % 7 else 2], "r", 10 + k % 4, 30, ["5M", "2S3M", "2M3D3M"][k % 3], [None, "a", "b"][k % 5 % 3]) for k in range(90)]
    sites = [(k, "r", 8 + k % 12, None if k % 6 == 0 else float(k % 9)) for k in range(80)]
    a = spark.createDataFrame(reads, "ord long, qname string, flag int, ref string, pos long, mapq int, cigar string, rg string")
    s = spark.createDataFrame(sites, "ord long, chrom string, pos long, qual double")
    each, quals = defaultdict(list), {k: q for k, _, _, q in sites}
    for r in site_read_positions(a, s).collect():
        each[r.rg, 5, r.from5 + 1].append(quals[r.ord])
        each[r.rg, 3, r.from3 + 1].append(quals[r.ord])
    found = site_position_stats(a, s, 4)
    got = {(r.rg, r.side, r.place): (r.reads, r["count"], r.median) for r in found.collect()}
    some = {k: sorted(q for q in v if q is not None) for k, v in each.items()}
    assert got == {k: (len(each[k]), len(v), float(np.median(v)) if v else None) for k, v in some.items() if k[2] <= 4} and len(got) > 12
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate", plan.rindex("Join Inner")) == 2


def test_orfs_and_orientation(spark):
    assert transcripts.translate("ATGTAANNN") == "M*X"
    orf = transcripts.longest_orf("CC" + "ATG" * 12 + "TAA", 30)
    assert orf is not None and orf[1] - orf[0] + 1 >= 36
    reads = spark.createDataFrame([("a", "CCGTCGATCGAAAAAAAAA"), ("b", "TTTTTTTTTTCGATCGACGG"), ("c", "CGCG")], "name string, seq string")
    hits = spark.createDataFrame([("c", "s", 1, 0, 3, 9, 6, 0.1)], "query string, subject string, part_no int, q_start int, q_end int, s_start int, s_end int, expect double")
    got = {r.name: (r.reason, r.turned, r.seq) for r in transcripts.orientate(reads, hits, 300).collect()}
    assert got["a"] == ("polyA", False, "CCGTCGATCGAAAAAAAAA") and got["b"][:2] == ("polyA", True) and got["b"][2].endswith("AAAAAAAAAA")
    assert got["c"] == ("hit", True, "CGCG")


def test_oligos_and_mates(spark):
    oligo = "ACGTTGCATTCGAGCA"
    reads = spark.createDataFrame([("one", "G" * 20 + oligo + "C" * 20), ("two", oligo + "C" * 20), ("none", "GC" * 20), ("many", ("G" * 20 + oligo) * 3 + "T" * 9)], "name string, seq string")
    found = transcripts.oligo_hits(reads, [("l", oligo)])
    assert found.where("query = 'one'").first().q_start == 20
    linkers = found.groupBy(F.col("query").alias("name")).agg(F.array_sort(F.collect_list(F.struct(F.col("q_start").alias("start"), F.col("q_end").alias("end"), "partial"))).alias("segments"))
    got = {r.name: r.seq for r in transcripts.split_mates(reads, linkers).collect()}
    assert got["one\\1"] == "G" * 20 and got["one\\2"] == "C" * 20 and got["two"] == "C" * 20 and got["none"] == "GC" * 20
    assert got["many_mlc.part4"] == "T" * 9


def test_tabular_and_sam(spark, tmp_path):
    (tmp_path / "a.tab").write_text("# comment\nq1 s1 98.5 50 0 0 1 50 101 150 1e-10 90\nq1\ts1\t90\t20\t0\t0\t60\t80\t30\t11\t0.1\t20\n")
    got = sources.read_tabular(spark, (tmp_path / "a.tab").as_uri()).orderBy("part_no").collect()
    assert [(r.q_start, r.q_end, r.s_start, r.s_end, r.part_no) for r in got] == [(0, 49, 100, 149, 1), (59, 79, 29, 10, 2)]
    assert H.matches(sources.read_tabular(spark, (tmp_path / "a.tab").as_uri())).first().s_start == 10
    (tmp_path / "bad.tab").write_text("q1 s1 3\n")
    with pytest.raises(Exception, match="wrong number of columns"):
        sources.read_tabular(spark, (tmp_path / "bad.tab").as_uri()).collect()
    folder = tmp_path / "sam"
    folder.mkdir()
    (folder / "a.sam").write_text("@RG\tID:g\tSM:x\nr1\t0\tref1\t5\t30\t4M\t*\t0\t0\tACGT\tIIII\tRG:Z:g\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\t*\n")
    rows = sources.read_sam(spark, folder.as_uri()).orderBy("ord").collect()
    assert [(r.qname, r.ref, r.pos, r.cigar, r.qual, r.rg) for r in rows] == [("r1", "ref1", 4, "4M", "IIII", "g"), ("r2", None, None, None, None, None)]
    assert sources.read_groups(spark, folder.as_uri()).first().sample == "x"
    stream = running_reference_counts(stream_sam(spark, folder.as_uri()))
    run = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert [tuple(r) for r in spark.sql("select * from counts").collect()] == [("ref1", 1)]


def test_letters_and_depths_have_no_cap(spark, tmp_path):
    """Thirty genotypes and 150 alternative alleles."""
    rows = [(1, "c", 10, f"S{k:02d}", True, k, k) for k in range(30)]
    got = export.rqtl_genotypes(spark.createDataFrame(rows, "ord long, chrom string, pos long, sample string, called boolean, a1 int, a2 int")).first()
    assert got.letters.split(",") == [*"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A1", "B1", "C1", "D1"]
    line = "\t".join(["1", "5", ".", "A", ",".join(["C"] * 150), ".", ".", ".", "GT:AD:DP", "0/1:" + ",".join(["2"] * 151) + ":302"])
    head = ["##source=UnifiedGenotyper", "##GATKCommandLine=x", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "S1"])]
    call = vcf.calls_of(spark.createDataFrame([(0, line)], "ord long, value string"), head).first()
    assert (call.rd, call.ad, len(call.depths)) == (2, 300, 151)


def test_positions_are_rounded_by_their_exact_values(spark):
    """Halfway between two texts, C and Java differ; some quotients are exact, and places may lie before 0."""
    places = [0, 7, 1234567, 10001285, 10001295, 12345675, 99999995, 9999999500, 1234567500000, 1234566500000, 123456789012345, -10001285, -10001295]
    places += [37 * k for k in range(270300, 270500)] + [25 * k + 10**9 for k in range(200)]
    got = spark.createDataFrame([(p,) for p in places], "pos long").select("pos", export.megabases(F.col("pos")).alias("x")).collect()
    assert {r.pos: r.x for r in got} == {p: f"{p / 1e6:.6e}" for p in places}


def test_depths_by_allele(spark):
    """A homozygous second alternative is judged by its own reads; the deepest allele is the major one."""
    rows = [(0, "c", 1, "S1", True, 2, 2, 22, 30.0, 1, 21, [1, 20, 1]), (0, "c", 1, "S2", True, 1, 1, 22, 30.0, 1, 21, [1, 20, 1]), (0, "c", 1, "S3", True, 0, 0, 5, 30.0, 5, 0, [5, 0, 0])]
    table = spark.createDataFrame(rows, CALLS + ", dp int, gq double, rd int, ad int, depths array<int>")
    got = {r["sample"]: r.outcome for r in variants.low_evidence_alleles(table, 0.9999, "ril_self").collect()}
    assert got["S1"] == "not_enough_evidence" and got["S2"] == "enough_evidence"
    assert abs(variants.depth_stats(table).first().maf_depth - 40 / 49) < 1e-9


def test_names_filter_reads(spark, tmp_path):
    from strandlake.sources.fastx import read_names

    (tmp_path / "names.txt").write_text("b\n\n a \r\nb\nlast\t\n")
    names = read_names(spark, f"file://{tmp_path}/names.txt")
    assert sorted(r.name for r in names.collect()) == ["a", "b", "last"]
    reads = spark.createDataFrame([("a",), ("c",)], "name string")
    assert [r.name for r in reads.join(names, "name", "left_anti").collect()] == ["c"]


def test_a_chain_of_filters(spark):
    from strandlake.operators.hits import filter_hits, matches, subject_segments

    kind = "query string, subject string, part_no int, q_start int, q_end int, s_start int, s_end int, q_len int, s_len int, expect double, identity double, score double"
    rows = [
        ("q", "s", 1, 0, 49, 10, 59, 100, 90, 1e-9, 99.0, 80.0), ("q", "s", 2, 60, 69, 65, 60, 100, 90, 1e-8, 98.0, 20.0),
        ("q", "t", 1, 0, 9, 0, 9, 100, 90, 1e-9, 99.0, 90.0), ("p", "s", 1, 0, 99, 0, 80, 100, 90, 1.0, 70.0, 5.0),
    ]
    hits = spark.createDataFrame(rows, kind)
    chain = [{"kind": "score_threshold", "key": "score", "min_score": 10.0}, {"kind": "min_length", "residues": 20}]
    (left,) = matches(filter_hits(hits, chain)).collect()
    assert (left.query, left.subject, left.q_start, left.q_end, left.parts) == ("q", "s", 0, 69, 2)
    (found,) = subject_segments(hits, chain).collect()
    assert [(s.start, s.end) for s in found.segments] == [(10, 65)]
    assert len(filter_hits(hits, []).collect()) == 4 and subject_segments(hits.limit(0)).count() == 0
    with pytest.raises(ValueError):
        filter_hits(hits, [{"kind": "unknown"}])
