"""Column functions on sequences: cleaning, lengths, codons, stops (X-1 to X-5, X-10, X-11, F-1, F-3, S-3)."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stop codons by NCBI genetic code number.
STOPS = {
    1: "TAA TAG TGA", 2: "TAA TAG AGA AGG", 3: "TAA TAG", 4: "TAA TAG", 5: "TAA TAG", 6: "TGA", 9: "TAA TAG", 10: "TAA TAG", 11: "TAA TAG TGA",
    12: "TAA TAG TGA", 13: "TAA TAG", 14: "TAG", 16: "TAA TGA", 21: "TAA TAG", 22: "TCA TAA TGA", 23: "TTA TAA TAG TGA", 24: "TAA TAG", 25: "TAA TAG",
    26: "TAA TAG TGA", 29: "TGA", 30: "TGA", 33: "TAG",
}
#: Bases that each IUPAC letter stands for.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}


def stop_codons(table: int) -> list[str]:
    """All codons, ambiguous ones included, whose every reading is a stop."""
    if table not in STOPS:
        raise ValueError(f"no stop codons known for genetic code {table}")
    stops = set(STOPS[table].split())
    return sorted("".join(c) for c in product(IUPAC, repeat=3) if all("".join(x) in stops for x in product(*(IUPAC[b] for b in c))))


def degapped(seq: Column) -> Column:
    return F.upper(F.translate(seq, "-", ""))


def plain_name(name: Column) -> Column:
    """Without a ;size= tag and what follows it."""
    return F.regexp_replace(name, r";size=.*$", "")


def library_of_header(header: Column) -> Column:
    """The library named in a read's header, empty if none."""
    return F.regexp_extract(header, r";(?:barcodelabel|sample)=([^;]+);", 1)


def base_name(path: Column) -> Column:
    """A file's name without folder and extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN"))


def stop_count(seq: Column, frame: int, stops: list[str]) -> Column:
    """Stop codons in a reading frame (1 to 3); bases after the last whole codon don't count."""
    codons = F.floor((F.length(seq) - (frame - 1)) / 3).cast("int")
    starts = F.when(codons > 0, F.sequence(F.lit(0), codons - 1)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(starts, lambda i: F.substring(seq, F.lit(frame) + i * 3, F.lit(3)).isin(stops)))


def length_passes(length: Column, low: int | None, high: int | None, expected: int | None = None, by_codon: bool = False) -> Column:
    """low to high, both included (null: no bound); by_codon: and off the expected length by whole codons."""
    tests = [F.lit(True)]
    if low is not None:
        tests.append(length >= low)
    if high is not None:
        tests.append(length <= high)
    if by_codon:
        if expected is None:
            raise ValueError("an expected length is needed to vary by codons")
        tests.append(F.abs(F.lit(expected) - length) % 3 == 0)
    return reduce(lambda a, b: a & b, tests)


def length_bounds(minimum: int | None = None, maximum: int | None = None, expected: int | None = None, bases: int | None = None, percent: float | None = None, codons: int | None = None) -> tuple[int | None, int | None]:
    """Bounds from minimum and maximum, or from an expected length and at most one variation (none: exact)."""
    given = [x for x in (bases, percent, codons) if x is not None]
    if len(given) > 1:
        raise ValueError("give one of bases, percent and codons")
    if minimum is not None or maximum is not None:
        if given:
            raise ValueError("a variation goes with an expected length, not with a minimum or maximum")
        if minimum is not None and maximum is not None and minimum > maximum:
            raise ValueError("the minimum is above the maximum")
        return minimum, maximum
    if expected is None:
        raise ValueError("no length given")
    by = bases if bases is not None else round(percent / 100 * expected) if percent is not None else 3 * codons if codons is not None else 0
    return expected - by, expected + by


def even_odds(counts: list[Column]) -> Column:
    """1 - p of a chi-squared test that three counts are alike: exact for two degrees of freedom."""
    mean = reduce(lambda a, b: a + b, counts).cast("double") / len(counts)
    x = reduce(lambda a, b: a + b, (F.try_divide((c - mean) * (c - mean), mean) for c in counts))
    return F.lit(1.0) - F.exp(-x / 2)
