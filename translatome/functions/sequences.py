"""Nucleotide sequence expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bases in base-5 order, start codons, stop codons.
BASES = "ACGTN"
STOPS = ("TAA", "TAG", "TGA")
CANDIDATE_STARTS = ("ATG", "CTG", "GTG", "TTG", "AAG", "ACG", "AGG", "ATA", "ATC", "ATT")
NEAR_STARTS = ("CTG", "GTG", "TTG", "ACG")
#: The standard genetic code, first base slowest, in the order T C A G.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODE_BASES = "TCAG"


def safe_range(low: Column, high: Column) -> Column:
    """low .. high, empty if high < low."""
    return F.when(high >= low, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def codons(seq: Column) -> Column:
    """Codons in frame 0, the last one maybe partial."""
    count = F.ceil(F.length(seq) / 3)
    return F.transform(safe_range(F.lit(0), count - 1), lambda i: F.substr(seq, i * 3 + 1, F.lit(3)))


def amino(codon: Column) -> Column:
    """One-letter amino acid, * for stops, X for anything else."""
    at = [F.instr(F.lit(CODE_BASES), F.substr(codon, F.lit(k), F.lit(1))) for k in (1, 2, 3)]
    known = F.length(codon) == 3
    for x in at:
        known &= x > 0
    index = (at[0] - 1) * 16 + (at[1] - 1) * 4 + at[2]
    return F.when(known, F.substr(F.lit(CODE), index, F.lit(1))).otherwise(F.lit("X"))


def translated(seq: Column) -> Column:
    return F.array_join(F.transform(codons(F.upper(seq)), amino), "")


def first_stop_codon(seq: Column) -> Column:
    """0-based index of the first in-frame stop codon, or null."""
    whole = F.regexp_extract_all(F.upper(seq), F.lit(r"[\s\S]{3}"), F.lit(0))  # one pass over seq; in a lambda it would be worked out again for each codon
    stop = F.array_position(F.transform(whole, lambda c: c.isin(*STOPS)), F.lit(True))
    return F.when(stop > 0, stop - 1).cast("bigint")


def codon_starts(seq: Column, low: Column, high: Column, wanted: tuple[str, ...]) -> Column:
    """0-based offsets low .. high whose codon is wanted."""
    return F.filter(safe_range(low, high), lambda i: F.substr(seq, i + 1, F.lit(3)).isin(*wanted))


def hamming(a: Column, b: Column, ignore_case: bool = True) -> Column:
    """Mismatches over the shorter length."""
    if ignore_case:
        a, b = F.upper(a), F.upper(b)
    n = F.least(F.length(a), F.length(b))
    differs = lambda i: F.when(F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)), 1).otherwise(0)
    return F.aggregate(safe_range(F.lit(1), n), F.lit(0), lambda s, i: s + differs(i)).cast("bigint")


def neighbours(seq: Column) -> Column:
    """All sequences with one base replaced by another of ACGTN."""
    alphabet = F.array(*[F.lit(b) for b in BASES])

    def at(i: Column) -> Column:
        own = F.substr(seq, i, F.lit(1))
        return F.transform(
            F.filter(alphabet, lambda b: b != own), lambda b: F.concat(F.substr(seq, F.lit(1), i - 1), b, F.substr(seq, i + 1, F.length(seq)))
        )

    return F.flatten(F.transform(safe_range(F.lit(1), F.length(seq)), at))


def base5(seq: Column) -> Column:
    """Big-endian base-5 number of a sequence over ACGTN; other letters raise an error."""
    digit = lambda c: F.instr(F.lit(BASES), c) - 1
    letters = F.transform(safe_range(F.lit(1), F.length(seq)), lambda i: F.substr(seq, i, F.lit(1)))
    return F.aggregate(
        letters,
        F.lit(0).cast("bigint"),
        lambda n, c: F.when(digit(c) >= 0, n * 5 + digit(c)).otherwise(
            F.raise_error(F.concat(F.lit("not a base: "), c)).cast("bigint")
        ),
    )


def from_base5(number: Column, length: Column) -> Column:
    """The sequence of a given length for a base-5 number; what doesn't fit raises an error."""
    digits = F.transform(
        safe_range(F.lit(1), length),
        lambda i: F.substr(F.lit(BASES), (F.pmod(F.floor(number / F.pow(F.lit(5), length - i)), F.lit(5)) + 1).cast("int"), F.lit(1)),
    )
    fits = (number >= 0) & (number < F.pow(F.lit(5), length))
    return F.when(fits, F.array_join(digits, "")).otherwise(F.raise_error(F.lit("number out of range")).cast("string"))
