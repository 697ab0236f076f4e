"""Threshold specifications: the text grammar and the grid of threshold sets (X-6, X-7, X-8, S-16, W-4)."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASES, PARTS, METRICS = ("library", "total"), ("clade", "taxon"), ("n", "p")


class SpecError(ValueError):
    """A specification that can't be read."""


@dataclass(frozen=True)
class Spec:
    """How counts are binned and measured."""

    base: str
    parts: tuple[str, ...]
    metric: str

    @property
    def name(self) -> str:
        return "|".join((self.base, *self.parts)) + f"_{self.metric}"


@dataclass
class Grid:
    """Specs in the order first seen, and for each additive term its thresholds by spec name."""

    specs: list[Spec] = field(default_factory=list)
    terms: list[dict[str, list[float]]] = field(default_factory=list)

    def names(self) -> list[str]:
        return [s.name for s in self.specs]

    def used(self, term: int) -> list[str]:
        """The term's specs in the grid's order, which is that of the product: the last varies fastest."""
        return [n for n in self.names() if n in self.terms[term]]

    def sizes(self) -> list[int]:
        return [prod(map(len, t.values())) for t in self.terms]

    def __len__(self) -> int:
        return sum(self.sizes())


def split_top(text: str, sign: str) -> list[str]:
    """Splits at a sign outside brackets."""
    parts, depth = [""], 0
    for c in text:
        depth += (c == "[") - (c == "]")
        if depth < 0 or depth > 1:
            raise SpecError(f"unbalanced brackets in {text!r}")
        if c == sign and not depth:
            parts.append("")
        else:
            parts[-1] += c
    if depth:
        raise SpecError(f"unbalanced brackets in {text!r}")
    return parts


def _number(text: str) -> float:
    try:
        return float(text)
    except ValueError:
        raise SpecError(f"{text!r} isn't a number") from None


def spaced(start: float, stop: float, n: int) -> list[float]:
    """n evenly spaced numbers; the last is stop itself."""
    if n < 1:
        raise SpecError("a range needs at least one step")
    if n == 1:
        return [start]
    step = (stop - start) / (n - 1)
    return [start + i * step for i in range(n - 1)] + [stop]


def parse_thresholds(text: str) -> list[float]:
    """Comma-separated numbers and ranges a-b/n or a/b/n; numbers may have exponents (1e-5)."""
    out: list[float] = []
    for item in text.split(","):
        head, *steps = item.split("/")
        if not steps:
            if "-" in head.lstrip("-").replace("e-", ""):
                raise SpecError(f"range {item!r} lacks its number of steps")
            out.append(_number(head))
            continue
        if len(steps) == 2:
            ends = [head, steps[0]]
        else:
            marked = head.replace("e-", "e~")
            ends = [x.replace("~", "-") for x in marked.split("-")]
        if len(ends) != 2 or not steps[-1].isdigit():
            raise SpecError(f"range {item!r} isn't start-stop/steps")
        out += spaced(_number(ends[0]), _number(ends[1]), int(steps[-1]))
    return out


def parse_term(text: str) -> tuple[Spec, list[float]]:
    if not (text.startswith("[") and text.endswith("]")):
        raise SpecError(f"term {text!r} isn't in square brackets")
    entries = text[1:-1].split(";")
    if len(entries) != 3:
        raise SpecError(f"term {text!r} needs categories; metric; thresholds")
    base, *parts = entries[0].replace("+", "|").split("|")
    if base not in BASES:
        raise SpecError(f"{text!r}: the first category is library or total")
    if any(p not in PARTS for p in parts):
        raise SpecError(f"{text!r}: further categories are clade or taxon")
    if entries[1] not in METRICS:
        raise SpecError(f"{text!r}: the metric is n or p")
    return Spec(base, tuple(parts), entries[1]), parse_thresholds(entries[2])


def parse_specs(text: str) -> Grid:
    """Lines that are blank or start with # are left out; spaces and line breaks don't matter. Terms are added with +, and
    multiplied with *. A spec named twice in one product keeps its last thresholds, with a warning."""
    lines = (x.strip() for x in text.splitlines())
    joined = "".join(x for x in lines if x and not x.startswith("#")).replace(" ", "").replace("\t", "")
    grid, seen = Grid(), {}
    for product in split_top(joined, "+"):
        term: dict[str, list[float]] = {}
        for factor in split_top(product, "*"):
            spec, thresholds = parse_term(factor)
            if spec.name in term:
                warnings.warn(f"{spec.name} is given twice in one term; the last thresholds hold", stacklevel=2)
            term[spec.name] = thresholds
            seen.setdefault(spec.name, spec)
        grid.terms.append(term)
    grid.specs = list(seen.values())
    return grid


def single_set(texts: list[str]) -> Grid:
    """Terms given one by one, all multiplied, that must make just one threshold set."""
    grid = parse_specs("*".join(t.replace("'", "") for t in texts))
    if len(grid) != 1:
        raise SpecError(f"{len(grid)} threshold sets where one is wanted")
    return grid


def threshold_column(name: str) -> str:
    return f"{name}_threshold"


def threshold_sets(spark: SparkSession, grid: Grid) -> DataFrame:
    """resultindex (from 0, in product order), term, and a threshold column for each spec (0 where the term lacks it).

    Each term's sets come from a range of numbers, digit by digit in mixed radix, so the product isn't made on the driver."""
    out, offset = None, 0
    for i, size in enumerate(grid.sizes()):
        used, stride = grid.used(i), size
        digits: dict[str, Column] = {}
        for name in used:
            values = grid.terms[i][name]
            stride //= len(values)
            digits[name] = F.element_at(F.array(*map(F.lit, values)), (F.floor(F.col("id") / stride) % len(values) + 1).cast("int"))
        cols = [digits.get(n, F.lit(0.0)).alias(threshold_column(n)) for n in grid.names()]
        rows = spark.range(size).select((F.col("id") + offset).alias("resultindex"), F.lit("*".join(used)).alias("term"), *cols)
        out, offset = rows if out is None else out.unionByName(rows), offset + size
    return out
