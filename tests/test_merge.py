"""Several files as one, definitions and repeated keys of a VCF header."""

import pytest
from pyspark.sql import functions as F

from strandlake.operators.merge import merge_alignments, merged_read_groups, merged_references, write_sorted
from strandlake.operators.variants import called_alleles
from strandlake.sources import vcf


def test_merge(spark, tmp_path):
    heads = [[(0, "b", 10), (1, "a", 20)], [(0, "c", 5), (1, "a", 20)]]
    heads = [spark.createDataFrame(h, "number int, ref string, length long") for h in heads]
    assert [tuple(r) for r in merged_references(heads).orderBy("number").collect()] == [(0, "b", 10), (1, "a", 20), (2, "c", 5)]
    groups = [[("g", "one"), ("g.1", "x"), ("k", None)], [("g", "two"), ("k", None)], [("g", "three"), ("g", "one")]]
    groups = [spark.createDataFrame(g, "id string, sample string") for g in groups]
    got = {(r.file, r.id, r.sample): r.new_id for r in merged_read_groups(groups).collect()}
    assert got == {(0, "g", "one"): "g", (0, "g.1", "x"): "g.1", (0, "k", None): "k", (1, "k", None): "k", (2, "g", "one"): "g",
                   (1, "g", "two"): "g.2", (2, "g", "three"): "g.3"}
    files = [[(1, "a", 5, "g"), (2, None, None, None), (3, "b", 9, "k")], [(1, "a", 5, "g"), (2, "c", 1, None), (3, "a", 2, "k")]]
    files = [spark.createDataFrame(f, "ord long, ref string, pos long, rg string") for f in files]
    merged = merge_alignments(files, heads, groups[:2])
    write_sorted(merged.repartition(3), f"{tmp_path}/out")
    rows = spark.read.parquet(f"{tmp_path}/out").orderBy(F.col("ref_number").asc_nulls_last(), "pos", "file", "ord").collect()
    assert [(r.ref, r.pos, r.file, r.rg) for r in rows] == [("b", 9, 0, "k"), ("a", 2, 1, "k"), ("a", 5, 0, "g"), ("a", 5, 1, "g.2"), ("c", 1, 1, None), (None, None, 0, None)]


def test_lengths_must_agree(spark):
    heads = [spark.createDataFrame([(0, "a", n)], "number int, ref string, length long") for n in (1, 2)]
    with pytest.raises(Exception, match="several lengths"):
        merged_references(heads).collect()


def test_vcf_header_and_repeated_keys(spark, tmp_path):
    head = ['##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth, of \\"all\\" reads">', '##FILTER=<ID=q10,Description="low">', "##fileformat=VCFv4.1", "#CHROM\tPOS"]
    assert vcf.definitions_of(head, "INFO") == {"DP": {"Number": "1", "Type": "Integer", "Description": 'Depth, of \\"all\\" reads'}}
    assert vcf.definitions_of(head, "FILTER") == {"q10": {"Description": "low"}} and vcf.definitions_of(head, "FORMAT") == {}
    (tmp_path / "a.vcf").write_text("c\t5\t.\tA\tT\t.\t.\tDP=1;DP=2;X;X\nc\t6\t.\tA\tT\t.\t.\t.\n")
    rows = vcf.sites_of(vcf.read_lines(spark, f"{tmp_path}/a.vcf")).orderBy("ord").collect()
    assert [r.info for r in rows] == [{"DP": "1", "X": "true"}, {}]


def test_called_alleles(spark):
    df = spark.createDataFrame([(True, 0, 2), (True, 1, None), (False, None, None)], "called boolean, a1 int, a2 int")
    assert [r.a for r in df.select(called_alleles().alias("a")).collect()] == [[0, 2], [1], []]
    assert [r.a for r in df.select(called_alleles(0).alias("a")).collect()] == [[0], [], []]
