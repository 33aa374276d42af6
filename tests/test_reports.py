"""Similarity reports in text and XML, GenBank and EMBL entries."""

import pytest

from strandlake.operators import hits as H
from strandlake.sources import reports

TEXT = """BLASTN 2.2.24+


Query=  one with words
Length=90

Subject=  first
Length=80


 Score =  144 bits (160),  Expect = e-100
 Identities = 70/75 (93%), Gaps = 2/75 (2%)
 Strand=Plus/Plus

Query  3    ACGTA-CGT  60
            ||||| |||
Sbjct  1    ACGTAACGT  59

Query  61   ACG  63
            |||
Sbjct  60   ACG  62


 Score = 30.1 bits (32),  Expect = 6e-05
 Identities = 18/19 (94%), Gaps = 0/19 (0%)
 Strand=Plus/Minus

Query  70   ACGTACG  88
            |||||||
Sbjct  40   ACGTACG  22


Query=  none
Length=10

 ***** No hits found *****

Query= two
Length=30

> second protein
Length=33

 Score = 50.4 bits (100),  Expect(2) = 2e-08, Method: Composition-based stats.
 Identities = 9/10 (90%), Positives = 10/10 (100%), Gaps = 0/10 (0%)

Query  1  MKVLA*XMKV  10
          MKVLA  MKV
Sbjct  5  MKVLA*XMKV  14
"""

PART = "<Hsp><Hsp_num>1</Hsp_num><Hsp_bit-score>{}</Hsp_bit-score><Hsp_evalue>1e-20</Hsp_evalue><Hsp_query-from>1</Hsp_query-from><Hsp_query-to>50</Hsp_query-to><Hsp_hit-from>{}</Hsp_hit-from><Hsp_hit-to>{}</Hsp_hit-to><Hsp_identity>40</Hsp_identity><Hsp_positive>45</Hsp_positive><Hsp_align-len>50</Hsp_align-len></Hsp>"
HIT = "<Hit><Hit_id>gnl|1</Hit_id><Hit_def>{}</Hit_def><Hit_accession>{}</Hit_accession><Hit_len>300</Hit_len><Hit_hsps>{}</Hit_hsps></Hit>"
ROW = "<Iteration><Iteration_query-ID>Query_1</Iteration_query-ID><Iteration_query-def>{}</Iteration_query-def><Iteration_query-len>60</Iteration_query-len><Iteration_hits>{}</Iteration_hits></Iteration>"


def test_text_report(spark, tmp_path):
    (tmp_path / "a.txt").write_text(TEXT)
    df = reports.read_blast_text(spark, (tmp_path / "a.txt").as_uri())
    got = [tuple(r) for r in df.orderBy("query", "part_no").collect()]
    assert got == [
        ("one", 90, "first", 80, 1, 2, 62, 1, 0, 61, 1, 1e-100, 93.0, 93.0, 144.0),
        ("one", 90, "first", 80, 2, 69, 87, 1, 21, 39, -1, 6e-05, 94.0, 94.0, 30.1),
        ("two", 30, "second", 33, 1, 0, 9, 1, 4, 13, 1, 2e-08, 90.0, 100.0, 50.4),
    ]
    match = H.matches(df).where("query = 'one'").first()
    assert (match.q_start, match.q_end, match.expect, match.parts) == (2, 87, 1e-100, 2)


def test_xml_report(spark, tmp_path):
    one = HIT.format("s1 a subject", "0", PART.format(90, 11, 60) + PART.format(30, 200, 151))
    rows = ROW.format("q1 a query", one + HIT.format("s2", "1", PART.format(40, 1, 50))) + ROW.format("q2", "") + ROW.format("q3", HIT.format("s1", "0", PART.format(20, 1, 50)))
    (tmp_path / "a.xml").write_text(f'<?xml version="1.0"?>\n<BlastOutput><BlastOutput_iterations>{rows}</BlastOutput_iterations></BlastOutput>\n')
    path = (tmp_path / "a.xml").as_uri()
    got = {(r.query, r.subject, r.part_no): (r.q_start, r.q_end, r.s_start, r.s_end, r.s_strand, r.identity, r.similarity, r.score) for r in reports.read_blast_xml(spark, path).collect()}
    assert got == {
        ("q1", "s1", 1): (0, 49, 10, 59, 1, 80.0, 90.0, 90.0),
        ("q1", "s1", 2): (0, 49, 150, 199, -1, 80.0, 90.0, 30.0),
        ("q1", "s2", 1): (0, 49, 0, 49, 1, 80.0, 90.0, 40.0),
        ("q3", "s1", 1): (0, 49, 0, 49, 1, 80.0, 90.0, 20.0),
    }
    assert {r.subject for r in reports.read_blast_xml(spark, path, subject_from_def=False).collect()} == {"0", "1"}


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_entries(spark, tmp_path, end):
    genbank = "LOCUS       AB1   14 bp\nDEFINITION  A long\n            name.\nACCESSION   AB1\nVERSION     AB1.2  GI:1\nFEATURES\nORIGIN      \n        1 acgtacgtac gtnn\n//\nLOCUS       AB2   3 bp\nDEFINITION  Other.\nORIGIN\n        1 ggg\n//\n"
    embl = "ID   X5; SV 3; linear; mRNA; STD; PLN; 12 BP.\nXX\nDE   Some plant\nDE   gene.\nSQ   Sequence 12 BP; 3 A;\n     acgtac gtacgt                                                         12\n//\n"
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "a.gb").write_bytes(genbank.replace("\n", end).encode())
    (tmp_path / "e" / "b.embl").write_bytes(embl.replace("\n", end).encode())
    got = {tuple(r)[1:] for r in reports.read_entries(spark, (tmp_path / "e").as_uri()).collect()}
    assert got == {
        ("AB1.2", "A long name", "ACGTACGTACGTNN", None, "genbank"),
        ("AB2", "Other", "GGG", None, "genbank"),
        ("X5.3", "Some plant gene", "ACGTACGTACGT", None, "embl"),
    }
