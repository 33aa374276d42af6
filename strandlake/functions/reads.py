"""Column functions on reads: sequences, qualities, titles and the predicates of the read filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import mean_code

SANGER, ILLUMINA = 33, 64
DUST_WINDOW, DUST_STEP = 64, 32
#: SAM flag bits by name.
FLAG_BITS = {
    "is_paired": 1, "is_in_proper_pair": 2, "is_unmapped": 4, "mate_is_unmapped": 8, "strand": 16, "mate_strand": 32,
    "is_first_in_pair": 64, "is_second_in_pair": 128, "is_not_primary": 256, "failed_quality": 512, "is_duplicate": 1024,
}


def let(value: Column, body) -> Column:
    """body(value) with value computed once: within a lambda an outer expression is computed per element."""
    return F.get(F.transform(F.array(value), body), 0)


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def decode_quality(qual: Column, offset: int = SANGER) -> Column:
    """Phred scores of a quality string (an empty one has none)."""
    return F.transform(chars(qual), lambda c: F.ascii(c) - offset)


def encode_quality(scores: Column, offset: int = SANGER) -> Column:
    return F.array_join(F.transform(scores, lambda q: F.char(q + offset)), "")


def recode_quality(qual: Column, source: int, target: int) -> Column:
    return encode_quality(decode_quality(qual, source), target)


def slice_text(text: Column, start: Column, stop: Column) -> Column:
    """Characters [start, stop), 0-based."""
    return F.substring(text, start + 1, F.greatest(stop - start, F.lit(0)))


def upper_count(seq: Column) -> Column:
    return F.length(F.regexp_replace(seq, "[^A-Z]", ""))


def swap_case(seq: Column) -> Column:
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(seq, low + up, up + low)


def change_case(seq: Column, action: str) -> Column:
    return {"upper": F.upper, "lower": F.lower, "swap": swap_case}[action](seq)


def reverse_complement(seq: Column) -> Column:
    """Only upper-case A, C, G and T have a complement; all else stays."""
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def segments_of(seq: Column, pattern: str) -> Column:
    """Runs of a pattern in a text as (start, end), 0-based and inclusive, in order."""
    runs = F.regexp_extract_all(seq, F.lit(f"({pattern}|(?:(?!{pattern}).)+)"), F.lit(1))
    step = F.aggregate(
        runs,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
        lambda acc, run: F.struct(
            (acc["at"] + F.length(run)).alias("at"),
            F.when(run.rlike(f"^(?:{pattern})$"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(run) - 1).alias("end")))))
            .otherwise(acc["out"])
            .alias("out"),
        ),
    )
    return step["out"]


def upper_segments(seq: Column) -> Column:
    return segments_of(seq, "[A-Z]+")


def longest_segment(segments: Column) -> Column:
    """The longest of (start, end) segments; of equal ones the first."""
    keyed = F.transform(segments, lambda s: F.struct((s["end"] - s["start"]).alias("n"), (-s["start"]).alias("o"), s.alias("s")))
    return F.array_max(keyed)["s"]


def pair_of_title(title: Column, strict: bool = False) -> Column:
    """Struct of template name and direction (fwd, rev, null where no rule matches, or an error if strict).

    Three rules in turn: name then / or | or backslash then digits; name, white space, digits, colon;
    name, dot, word character.  1 or f is forward, 2 or r reverse.
    """
    rules = [r"^(.+)[/|\\](\d+)", r"^(.+)\s(\d+):.+", r"^(.+)\.(\w)\s?"]
    name = F.coalesce(*[F.when(title.rlike(r), F.regexp_extract(title, r, 1)) for r in rules])
    mark = F.coalesce(*[F.when(title.rlike(r), F.regexp_extract(title, r, 2)) for r in rules])
    direction = F.when(mark.isin("1", "f"), "fwd").when(mark.isin("2", "r"), "rev")
    if strict:
        direction = F.coalesce(direction, F.raise_error(F.concat(F.lit("no pair direction in title: "), F.coalesce(title, F.lit("null")))))
    return F.struct(name.alias("template"), direction.alias("direction"))


def guess_fastq_version(reads: DataFrame, longest: int = 250) -> DataFrame:
    """One row, version: fastq (Sanger) where any quality letter is below 64, else fastq-illumina; an error
    where the letters don't tell and a read is longer than longest.  All reads are looked at; without
    qualities it is fastq-illumina."""
    found = reads.agg(F.min(F.array_min(decode_quality(F.col("qual"), 0))).alias("low"), F.max(F.length("seq")).alias("n"))
    unclear = F.raise_error(F.lit(f"reads longer than {longest} and no quality letter below 64: the version can't be told"))
    return found.select(F.when(F.col("low") < 64, "fastq").when(F.col("n") > longest, unclear).otherwise("fastq-illumina").alias("version"))


def with_letters(reads: DataFrame, seq: Column | None = None, qual: Column | None = None, name: Column | None = None) -> DataFrame:
    """Reads with another sequence, qualities or name; an error where there are qualities and their number
    is not the sequence's."""
    new = {c: x for c, x in (("seq", seq), ("qual", qual), ("name", name)) if x is not None}
    out = reads.withColumns(new)
    fits = F.col("qual").isNull() | F.coalesce(F.length("seq") == F.length("qual"), F.lit(False))
    checked = F.when(fits, F.col("qual")).otherwise(F.raise_error(F.concat(F.lit("qualities don't fit the sequence of "), F.coalesce("name", F.lit("null")))))
    return out.withColumn("qual", checked)


def make_flag(bits: list[str]) -> int:
    return sum(FLAG_BITS[b] for b in set(bits))


def has_flag(flag: Column, bit: str) -> Column:
    return flag.bitwiseAND(F.lit(FLAG_BITS[bit])) > 0


def flag_names(flag: Column) -> Column:
    """Names of the bits that are set, in bit order."""
    return F.filter(F.array(*[F.when(has_flag(flag, b), F.lit(b)) for b in FLAG_BITS]), lambda b: b.isNotNull())


def rolling(values: Column, size: int, step: int = 1) -> Column:
    """Full windows of an array."""
    return let(
        values,
        lambda v: F.transform(
            F.filter(F.sequence(F.lit(1), F.greatest(F.size(v) - size + 1, F.lit(1)), F.lit(step)), lambda i: i + size - 1 <= F.size(v)),
            lambda i: F.slice(v, i, F.lit(size)),
        ),
    )


def kmers(seq: Column, k: int) -> Column:
    """All k-mers of a text, repeats included, case kept; linear in the text."""
    return let(
        chars(seq),
        lambda c: F.transform(
            F.filter(F.sequence(F.lit(0), F.greatest(F.size(c) - k, F.lit(0))), lambda i: i + k <= F.size(c)),
            lambda i: F.concat(*[F.get(c, i + j) for j in range(k)]),
        ),
    )


def _triplet_score(seq: Column) -> Column:
    """Sum of n (n - 1) / 2 over the triplets: pairs of equal triplets."""
    zero = F.lit(0).cast("long")

    def step(a, t):
        run = F.when(a["last"] == t, a["run"] + 1).otherwise(zero)
        return F.struct(t.alias("last"), run.alias("run"), (a["total"] + run).alias("total"))

    start = F.struct(F.lit("").alias("last"), zero.alias("run"), zero.alias("total"))
    return F.aggregate(F.sort_array(kmers(F.upper(seq), 3)), start, step)["total"].cast("double")


def dust_score(seq: Column) -> Column:
    """Low-complexity score: mean of the windows' triplet scores, 100 at most.

    Windows of 64 every 32; the rest after the last window counts where it is longer than 5.  Texts of
    3 score 0; of at most 5 null.
    """
    n = F.length(seq)
    windows = F.when(n > DUST_WINDOW, F.floor((n - DUST_WINDOW) / DUST_STEP) + 1).otherwise(0).cast("int")
    # Cut once into steps: a substring would be looked for from the start of the text at each window.
    steps = F.regexp_extract_all(seq, F.lit(f"(?s).{{1,{DUST_STEP}}}"), F.lit(0))

    def scores(cut):
        p, w = cut["p"], cut["w"]
        places = F.filter(F.sequence(F.lit(0), F.greatest(w - 1, F.lit(0))), lambda i: i < w)
        full = F.transform(places, lambda i: _triplet_score(F.concat(*[F.get(p, i + k) for k in range(DUST_WINDOW // DUST_STEP)])) / (DUST_WINDOW - 2))
        rest = F.filter(F.array(F.array_join(F.slice(p, w + 1, F.greatest(F.size(p) - w, F.lit(0))), "")), lambda r: F.length(r) > 5)
        return F.concat(full, F.transform(rest, lambda r: _triplet_score(r) / (F.length(r) - 3) * (DUST_WINDOW - 2) / (F.length(r) - 2)))

    found = let(F.struct(steps.alias("p"), windows.alias("w")), scores)
    mean = let(found, lambda s: F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / F.size(s))
    return F.when(n == 3, F.lit(0.0)).when(n > 5, mean * 100 / 31)


def mean_quality(qual: Column, offset: int = SANGER) -> Column:
    return mean_code(qual, offset)


def masked_mean_quality(seq: Column, qual: Column, offset: int = SANGER) -> Column:
    """Qualities of upper-case bases only, over the length of the read."""
    pairs = F.zip_with(chars(seq), decode_quality(qual, offset), lambda b, q: F.when(b.rlike("[A-Z]"), q).otherwise(0))
    return F.when(F.size(pairs) > 0, F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a + x) / F.size(pairs))


def has_real_bases(seq: Column) -> Column:
    """Not all N, n, - or *; an empty sequence passes."""
    return (seq == "") | seq.rlike("[^Nn*-]")


def length_between(seq: Column, low: int | None = None, high: int | None = None, only_upper: bool = False) -> Column:
    if low is None and high is None:
        raise ValueError("a minimum or a maximum length is needed")
    n = upper_count(seq) if only_upper else F.length(seq)
    return (F.lit(True) if low is None else n >= low) & (F.lit(True) if high is None else n <= high)


def guess_sequence_type(seq: Column) -> Column:
    """nucl where over 80 % of the letters are of gcatnu, prot where a letter only proteins have occurs."""
    letters = F.regexp_replace(F.lower(seq), "[^a-z]", "")
    share = F.length(F.regexp_replace(letters, "[^gcatnu]", "")) / F.when(F.length(letters) > 0, F.length(letters))
    return F.when(share > 0.8, "nucl").when(letters.rlike("[efilopqxz]"), "prot")


def polya_tail(seq: Column, min_len: int = 5, max_mismatches: int = 1, end: str = "three_prime") -> Column:
    """Length of the poly-A at the 3' end (or poly-T at the 5' end); 0 where there is none.

    Letters are read from the end inwards: a run of min_len of the tail's base (N is neutral) makes all
    letters up to there tail; more than max_mismatches other letters in a row end the search.
    """
    base = "A" if end == "three_prime" else "T"
    text = F.upper(F.reverse(seq) if end == "three_prime" else seq)
    start = F.struct(*[F.lit(0).alias(k) for k in ("poly", "bad", "n", "tail")], F.lit(False).alias("over"))

    def step(a, c):
        poly = F.when(c == base, a["poly"] + 1).when(c == "N", a["poly"]).otherwise(0)
        bad = F.when(c == base, 0).when(c == "N", a["bad"]).otherwise(a["bad"] + 1)
        new = F.struct(
            poly.alias("poly"), bad.alias("bad"), (a["n"] + 1).alias("n"),
            F.when(poly >= min_len, a["n"] + 1).otherwise(a["tail"]).alias("tail"), (bad > max_mismatches).alias("over"),
        )
        return F.when(a["over"], a).otherwise(new)

    return F.aggregate(chars(text), start, step)["tail"]
