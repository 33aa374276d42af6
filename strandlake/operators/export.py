"""Marker exports: flanked alleles, R/qtl genotypes and a parent-checker matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import index_rows
from .tiles import contexts_in, reference_tiles

#: IUPAC codes of two bases.
TWO_BASES = {"AG": "R", "CT": "Y", "CG": "S", "AT": "W", "GT": "K", "AC": "M"}


def iupac(ref: Column, alts: Column) -> Column:
    """Code of a site in a flank: two bases by their code, a deletion -, an insertion ^, all else *."""
    pair = F.array_join(F.array_sort(F.array(ref, F.get(alts, 0))), "")
    code = F.coalesce(*[F.when(pair == k, v) for k, v in TWO_BASES.items()])
    one = (F.size(alts) == 1) & (F.length(ref) == 1) & (F.length(F.get(alts, 0)) == 1)
    longest = F.array_max(F.transform(alts, F.length))
    return F.when(one, code).when((F.size(alts) == 1) & (longest < F.length(ref)), "-").when((F.size(alts) == 1) & (longest > F.length(ref)), "^").otherwise("*")


def _marked(tiles: DataFrame, sites: DataFrame, width: int) -> DataFrame:
    """References' tiles (ref, bin, tile) with the codes of sites (ref, pos, code; one at a place) put in."""
    at = F.col("pos") - F.col("bin") * width
    marks = sites.withColumn("bin", F.floor(F.col("pos") / width)).groupBy("ref", "bin").agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), "code"))).alias("marks"))
    rows = tiles.join(marks, ["ref", "bin"], "left").withColumn("marks", F.filter("marks", lambda m: m["at"] < F.length("tile")))
    after = lambda i: F.when(i > 0, F.get("marks", i - 1)["at"] + 1).otherwise(0)
    bases = lambda start, end: F.substr("tile", (start + 1).cast("int"), (end - start).cast("int"))
    pieces = F.transform("marks", lambda m, i: F.concat(bases(after(i), m["at"]), m["code"]))
    text = F.concat(F.array_join(pieces, ""), bases(after(F.size("marks")), F.length("tile")))
    return rows.select("ref", "bin", F.coalesce(text, "tile").alias("tile"))


def flanked_alleles(sites: DataFrame, references: DataFrame, length: int = 60, min_length: int = 0, width: int = 1 << 12) -> DataFrame:
    """ord and text left[ref/alt]right, the flanks as they are in references (chrom, seq), with codes where
    other sites fall (of several at a place the one of least ord).  Flanks end at the ends of the reference; those shorter than min_length give null.

    A place has the same code in all flanks, so codes are put into the references' tiles of width bases, and flanks
    are cut out of these once for all sites of equal place and ref; no site meets another."""
    code = F.min(F.struct("ord", iupac(F.col("ref"), F.col("alts")).alias("code")))["code"]
    first = sites.groupBy(F.col("chrom").alias("ref"), "pos").agg(code.alias("code")).where("code IS NOT NULL")
    tiles = _marked(reference_tiles(references.select(F.col("chrom").alias("ref"), "seq"), width, upper=False), first, width)
    place = ["chrom", "pos", "ref"]
    places = sites.select(*place).distinct().withColumn("ord", F.struct(*place))
    flanks = contexts_in(places, tiles, length, length, width).select(*place, F.coalesce("before", F.lit("")).alias("l"), F.coalesce("after", F.lit("")).alias("r"))
    known = references.select("chrom", F.col("seq").isNotNull().alias("__known"))
    rows = sites.select("ord", *place, "alts").join(known, "chrom").join(flanks, place, "left")
    text = F.concat("l", F.lit("["), F.concat_ws("/", F.concat(F.array("ref"), F.col("alts"))), F.lit("]"), "r")
    return rows.select("ord", F.when(F.col("__known") & (F.length("l") >= min_length) & (F.length("r") >= min_length), text).alias("text"))


def genotype_letter() -> Column:
    """A for homozygous reference, B for homozygous alternative, H for heterozygous, - without two alleles."""
    return F.when(~F.col("called") | F.col("a2").isNull(), "-").when(F.col("a1") != F.col("a2"), "H").when(F.col("a1") == 0, "A").otherwise("B")


def megabases(pos: Column) -> Column:
    """pos / 10^6 as a text with seven digits, as C's %.6e gives it.

    Java rounds the shortest text of a number, C the number itself, so they differ where a position lies
    halfway between two texts.  There the remainder of the division, which is exact in two halves of the
    quotient's bits, tells on which side of it the quotient lies; quotients that are exact go to the even digit.
    """
    pos = pos.cast("long")
    quotient, whole = pos / 1e6, pos.cast("double")
    high = quotient * 134217729.0 - (quotient * 134217729.0 - quotient)
    above = (high * 1e6 - whole) + (quotient - high) * 1e6
    cut = F.pow(F.lit(10.0), F.greatest(F.length(F.abs(pos).cast("string")) - 7, F.lit(0))).cast("long")
    rest = F.pmod(pos, cut)
    low = pos - rest
    up = F.when(2 * rest != cut, 2 * rest > cut).when(above != 0, above > 0).otherwise(F.pmod(low / cut, F.lit(2)) == 1)
    return F.format_string("%.6e", (low + F.when(up, cut).otherwise(0)) / 1e6)


def rqtl_genotypes(calls: DataFrame) -> DataFrame:
    """ord, map position in Mb as text, and the samples' genotype letters by order of first appearance:
    A to Z, then A1 to Z1 and so on."""
    text = F.when(F.col("called") & F.col("a2").isNotNull(), F.concat_ws("/", F.array_sort(F.array("a1", "a2")).cast("array<string>")))
    rows = calls.withColumn("g", text)
    first = rows.where("g IS NOT NULL").groupBy("ord", "g").agg(F.min("sample").alias("s")).withColumn("k", F.row_number().over(Window.partitionBy("ord").orderBy("s")))
    turn = F.floor((F.col("k") - 1) / 26)
    letter = F.concat(F.char((F.col("k") - 1) % 26 + 65), F.when(turn > 0, turn.cast("string")).otherwise(""))
    coded = rows.join(first.select("ord", "g", letter.alias("letter")), ["ord", "g"], "left")
    return coded.groupBy("ord", "chrom", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sample", F.coalesce("letter", F.lit("-")).alias("x")))), lambda s: s["x"]), ",").alias("letters")).withColumn(
        "position", megabases(F.col("pos"))
    )


def _filled(cells: Column, at: str, text: str, width: Column) -> Column:
    """Texts of cells, ascending by their places, in a row; - stands width times for each place between them that has none."""
    before = lambda i: F.when(i > 0, F.get(cells, i - 1)[at]).otherwise(F.lit(-1))
    return F.array_join(F.transform(cells, lambda c, i: F.concat(F.repeat(F.lit("-"), ((c[at] - before(i) - 1) * width).cast("int")), c[text])), "")


def marker_matrix(codes: DataFrame, block: int = 1000) -> DataFrame:
    """A row per sample: its parental codes at the markers in order of ord, - where it has none.

    Markers are numbered in parallel; codes are put together in blocks of markers, then the blocks of a
    sample, so no task holds all samples' codes.  The result's texts are as long as there are markers.
    """
    numbered = index_rows(codes.select("ord").distinct(), "k")
    total = F.broadcast(numbered.agg(F.count("*").alias("total")))
    cell = F.struct((F.col("k") % block).alias("k"), F.coalesce("code", F.lit("-")).alias("code"))
    blocks = codes.join(numbered, "ord").groupBy("sample", F.expr(f"k div {block}").alias("b")).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    size = F.least(F.lit(block), F.col("total") - F.col("b") * block)
    rest = F.repeat(F.lit("-"), (size - 1 - F.element_at("cells", -1)["k"]).cast("int"))
    blocks = blocks.crossJoin(total).select("sample", "total", "b", F.concat(_filled(F.col("cells"), "k", "code", F.lit(1)), rest).alias("text"))
    samples = blocks.groupBy("sample", "total").agg(F.array_sort(F.collect_list(F.struct("b", "text"))).alias("blocks"))
    behind = F.greatest(F.lit(0), F.col("total") - (F.element_at("blocks", -1)["b"] + 1) * block)
    return samples.select("sample", F.concat(_filled(F.col("blocks"), "b", "text", F.lit(block)), F.repeat(F.lit("-"), behind.cast("int"))).alias("codes"))
