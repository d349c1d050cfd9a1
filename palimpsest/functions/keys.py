"""Key bounds, tombstones and prefixes as column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The schema of a version log: keys and values are bytes in unsigned bytewise order, an empty value is a tombstone.
VERSIONS = "key binary, ts long, value binary"


@dataclass(frozen=True)
class Bound:
    """One side of a range: a key that belongs to it or doesn't, or none."""

    key: Any = None
    included: bool = True
    limited: bool = True


UNBOUNDED = Bound(limited=False)


def included(key: Any) -> Bound:
    return Bound(key)


def excluded(key: Any) -> Bound:
    return Bound(key, included=False)


def within(key: Column, lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED) -> Column:
    """Whether a key lies between the bounds: plain comparisons, which reach the Parquet scan."""
    tests = []
    if lower.limited:
        tests.append(key >= F.lit(lower.key) if lower.included else key > F.lit(lower.key))
    if upper.limited:
        tests.append(key <= F.lit(upper.key) if upper.included else key < F.lit(upper.key))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def holds(key: bytes, lower: Bound, upper: Bound) -> bool:
    """The same for one key on the driver."""
    above = not lower.limited or key > lower.key or (lower.included and key == lower.key)
    return above and (not upper.limited or key < upper.key or (upper.included and key == upper.key))


def overlaps(low: bytes, high: bytes, lower: Bound, upper: Bound) -> bool:
    """Whether some key from `low` to `high` may lie between the bounds."""
    return (not lower.limited or high > lower.key or (lower.included and high == lower.key)) and (not upper.limited or low < upper.key or (upper.included and low == upper.key))


def is_tombstone(value: Column) -> Column:
    return F.length(value) == 0


def shared_prefix(key: Column, first: Column, most: int) -> Column:
    """How many leading characters (bytes, for binary) two keys share, `most` at most."""
    equal = lambda n: F.substr(key, F.lit(1), n) == F.substr(first, F.lit(1), n)
    lengths = F.sequence(F.lit(1), F.least(F.length(key), F.length(first), F.lit(most)))
    counted = F.aggregate(lengths, F.lit(0), lambda n, i: F.when((n == i - 1) & equal(i), i).otherwise(n))
    return F.when(F.least(F.length(key), F.length(first)) > 0, counted).otherwise(0)
