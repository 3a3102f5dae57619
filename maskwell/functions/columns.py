"""Column helpers: let-binding inside lambdas, and spans of regular-expression matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,match:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once: lambdas have no common-subexpression elimination."""
    return F.element_at(F.transform(F.array(value), body), 1)


def java_regex(pattern: str) -> str:
    """Unicode classes for \\d, \\s, \\w and \\b."""
    return pattern if pattern.startswith("(?U)") else f"(?U){pattern}"


def matches(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """Non-overlapping leftmost matches with character offsets: the gaps that split() leaves and the matches, added up.

    The pattern must not match the empty string. A text without a match costs one scan.
    """
    re = java_regex(pattern)
    gaps, found = F.split(text, re, -1), F.regexp_extract_all(text, F.lit(re), F.lit(0))
    empty = F.struct(F.lit(0).alias("pos"), F.array().cast(SPAN).alias("out"))

    def step(a: Column, x: Column) -> Column:
        start = a["pos"] + F.length(x["0"])
        end = start + F.length(F.coalesce(x["1"], F.lit("")))
        more = F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["1"].alias("match"))))
        return F.struct(end.alias("pos"), F.when(x["1"].isNull(), a["out"]).otherwise(more).alias("out"))

    spans = F.aggregate(F.arrays_zip(gaps, found), empty, step, lambda a: a["out"])
    test = text.rlike(re) if gate is None else gate & text.rlike(re)
    return F.when(test, spans).otherwise(F.array().cast(SPAN))


def digits(m: Column) -> Column:
    """ASCII digits of m."""
    return F.regexp_replace(m, "[^0-9]", "")


def weighted(d: Column, weights: list[int], first: int = 1) -> Column:
    """Sum of the digits from position `first` on, times the weights."""
    w = F.array(*[F.lit(x) for x in weights])
    return F.aggregate(F.zip_with(F.slice(F.split(d, ""), first, len(weights)), w, lambda x, y: x.cast("int") * y), F.lit(0), lambda a, x: a + x)


def digit(d: Column, i: int) -> Column:
    """The digit at 0-based place i."""
    return F.substring(d, i + 1, 1).cast("int")
