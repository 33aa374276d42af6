"""Transcripts and mate pairs: open reading frames, orientation, linkers and oligo search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.reads import polya_tail, reverse_complement

#: The standard genetic code, bases in the order T, C, A, G.
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def translate(seq: str) -> str:
    """Amino acids of the codons from the first base on; X for codons with other letters."""
    value = {b: k for k, b in enumerate("TCAG")}
    codons = (seq[k : k + 3].upper() for k in range(0, len(seq) - 2, 3))
    return "".join(AMINO_ACIDS[16 * value[a] + 4 * value[b] + value[c]] if {a, b, c} <= value.keys() else "X" for a, b, c in codons)


def longest_orf(seq: str, min_len: int = 30) -> tuple[int, int, int] | None:
    """start, end (0-based, inclusive) and strand of the longest stretch of codons without a stop."""
    best = None
    flipped = seq.upper()[::-1].translate(str.maketrans("ACGT", "TGCA"))
    for strand, text in ((1, seq.upper()), (-1, flipped)):
        for frame in range(3):
            at = frame
            for part in translate(text[frame:]).split("*"):
                size = 3 * len(part)
                if size >= min_len and (best is None or size > best[1] - best[0] + 1):
                    start = at if strand == 1 else len(seq) - at - size
                    best = (start, start + size - 1, strand)
                at += size + 3
    return best


@F.pandas_udf(T.StructType([T.StructField(k, T.IntegerType()) for k in ("start", "end", "strand")]))
def orf_of(seq: pd.Series, min_len: pd.Series) -> pd.DataFrame:
    found = [longest_orf(s or "", int(m)) or (None, None, None) for s, m in zip(seq, min_len)]
    return pd.DataFrame(found, columns=["start", "end", "strand"]).astype("Int32")


def orientate(reads: DataFrame, hits: DataFrame | None = None, min_orf: int = 300) -> DataFrame:
    """Transcripts turned to their sense strand, with the reason: poly-A, then the frame, then hits.
    Each rule sees only what those before it left undecided."""
    tail_a, tail_t = polya_tail(F.col("seq")), polya_tail(F.col("seq"), end="five_prime")
    by_tail = F.when(tail_a + tail_t == 0, None).when(tail_a >= tail_t, 1).otherwise(-1)
    df = reads.withColumn("__o", orf_of(F.col("seq"), F.lit(min_orf)))
    by_hit = F.lit(None).cast("int")
    if hits is not None:
        strand = F.when((F.col("q_start") <= F.col("q_end")) == (F.col("s_start") <= F.col("s_end")), 1).otherwise(-1)
        best = hits.groupBy(F.col("query").alias("name")).agg(F.min_by(strand, F.struct("expect", "subject", "part_no")).alias("__h"))
        df, by_hit = df.join(best, "name", "left"), F.col("__h")
    df = df.withColumn("__s", F.coalesce(by_tail, F.col("__o.strand"), by_hit))
    reason = F.when(by_tail.isNotNull(), "polyA").when(F.col("__o.strand").isNotNull(), "ORF").when(by_hit.isNotNull(), "hit")
    turned = F.when(F.col("__s") == -1, reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    return df.withColumns({"reason": reason, "turned": F.coalesce(F.col("__s") == -1, F.lit(False)), "seq": turned}).drop("__o", "__s", "__h")


def split_mates(reads: DataFrame, linkers: DataFrame) -> DataFrame:
    """Reads cut at linker hits: name and seq of each part.

    linkers: name and segments (start, end, merged and ordered, partial).  One inner hit gives mates \\1
    and \\2 (with _pl where the hit is partial), a hit at an edge trims, several inner hits give parts
    _mlc.part1 and so on; reads without hits stay.
    """
    df = reads.join(linkers, "name", "left")
    n = F.length("seq")
    found = F.coalesce("segments", F.array().cast("array<struct<start:int,end:int,partial:boolean>>"))
    pieces = F.transform(
        F.sequence(F.lit(0), F.size(found)),
        lambda i: F.struct(
            F.coalesce(F.get(found, i - 1)["end"] + 1, F.lit(0)).alias("start"), F.coalesce(F.get(found, i)["start"] - 1, n - 1).alias("end")
        ),
    )
    df = df.withColumn("pieces", F.filter(pieces, lambda p: p["end"] >= p["start"])).withColumn("partial", F.exists(found, lambda s: s["partial"]))
    out = df.select("name", "seq", "partial", F.size("pieces").alias("n"), F.posexplode("pieces").alias("k", "p"))
    mark = F.when(F.col("n") == 1, "").when(F.col("n") == 2, F.concat(F.when(F.col("partial"), "_pl").otherwise(""), F.lit("\\"), (F.col("k") + 1).cast("string"))).otherwise(F.concat(F.lit("_mlc.part"), (F.col("k") + 1).cast("string")))
    return out.select(F.concat("name", mark).alias("name"), F.substring("seq", F.col("p.start") + 1, F.col("p.end") - F.col("p.start") + 1).alias("seq"))


def oligo_hits(reads: DataFrame, oligos: list[tuple[str, str]], min_identity: float = 87.0, min_length: int = 13) -> DataFrame:
    """Ungapped matches of short oligos, both strands: seeds of exact 8-mers, stretched over the oligo.

    A few oligos are given by hand and go to all tasks; the reads are streamed.
    """
    flip = str.maketrans("ACGT", "TGCA")
    both = [(name, s, strand) for name, seq in oligos for strand, s in ((1, seq.upper()), (-1, seq.upper()[::-1].translate(flip)))]
    seeds: dict[str, list] = {}
    for number, (_, s, _) in enumerate(both):
        for k in range(len(s) - 7):
            seeds.setdefault(s[k : k + 8], []).append((number, k))

    def search(frames):
        for frame in frames:
            rows = []
            for name, seq in zip(frame["name"], frame["seq"]):
                text, seen = (seq or "").upper(), set()
                for k in range(len(text) - 7):
                    for number, offset in seeds.get(text[k : k + 8], ()):
                        oligo_name, oligo, strand = both[number]
                        start = k - offset
                        if (number, start) in seen:
                            continue
                        seen.add((number, start))
                        lo, hi = max(0, start), min(len(text), start + len(oligo))
                        same = sum(a == b for a, b in zip(text[lo:hi], oligo[lo - start :]))
                        if hi - lo >= min_length and 100 * same / (hi - lo) >= min_identity:
                            ends = (lo - start, hi - start - 1) if strand == 1 else (len(oligo) - 1 - (lo - start), len(oligo) - (hi - start))
                            rows.append((name, oligo_name, lo, hi - 1, *ends, 100 * same / (hi - lo), hi - lo < len(oligo)))
            yield pd.DataFrame(rows, columns=["query", "subject", "q_start", "q_end", "s_start", "s_end", "identity", "partial"])

    return reads.select("name", "seq").mapInPandas(search, "query string, subject string, q_start int, q_end int, s_start int, s_end int, identity double, partial boolean")


def hit_features(hits: DataFrame) -> DataFrame:
    """Features of reads from hits: type, ends, strand and the subject, a list per query."""
    strand: Column = F.when((F.col("q_start") <= F.col("q_end")) == (F.col("s_start") <= F.col("s_end")), 1).otherwise(-1)
    one = F.struct(F.lit("match_part").alias("type"), F.least("q_start", "q_end").alias("start"), F.greatest("q_start", "q_end").alias("end"), strand.alias("strand"), F.create_map(F.lit("Target"), "subject").alias("qualifiers"))
    return hits.groupBy(F.col("query").alias("name")).agg(F.array_sort(F.collect_list(one), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0)).alias("features"))
