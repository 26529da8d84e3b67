"""Sums and means of doubles that are the same in whatever order the rows are added.

Adding doubles rounds at every step, so partial sums that meet in another order end in
other digits. Here a value is cut into its whole part and twice 26 bits of its fraction.
These are whole numbers, and sums of whole numbers are exact. Only the last step, from
three sums to one double, rounds, and it does so once. What a fraction has below 2^-52 is
left out, so a value of 1 and more counts with every bit that it has.

The three sums of a group can be added to those of another, or taken from them, before
they are joined. Missing values, NaN among them, and infinite ones are not added.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 26
PARTS = ("whole", "high", "low")
_SCALE = 1 << BITS
_MASK = _SCALE - 1
_LARGEST = float(1 << 62)


def _finite(value: Column) -> Column:
    return F.when(F.abs(value) < F.lit(_LARGEST), value)


def parts(value: Column) -> dict[str, Column]:
    """The three whole numbers that a double is cut into; NULL for what is not added."""
    value = _finite(value.cast("double"))
    # towards zero, so that what is left is exact for either sign
    whole = value.cast("long")
    fraction = (value - whole) * F.lit(float(_SCALE))
    high = fraction.cast("long")
    low = ((fraction - high) * F.lit(float(_SCALE))).cast("long")
    return dict(zip(PARTS, (whole, high, low), strict=True))


def joined(whole: Column, high: Column, low: Column) -> Column:
    """The double next to three sums of parts."""
    carried = high + F.shiftright(low, BITS)
    fraction = carried.bitwiseAND(F.lit(_MASK)) * F.lit(_SCALE) + low.bitwiseAND(F.lit(_MASK))
    return (whole + F.shiftright(carried, BITS)).cast("double") + fraction.cast("double") / F.lit(
        float(_SCALE * _SCALE)
    )


def part_sums(name: str, value: Column) -> list[Column]:
    """Aggregates for a column to be joined later: ``<name>_whole`` and so on, ``<name>_n``."""
    cut = parts(value)
    sums = [F.sum(cut[p]).alias(f"{name}_{p}") for p in PARTS]
    return [*sums, F.count(cut["whole"]).alias(f"{name}_n")]


def part_names(name: str) -> list[str]:
    return [*(f"{name}_{p}" for p in PARTS), f"{name}_n"]


def of_parts(name: str) -> Column:
    """Sum of a column from its part sums; NULL where nothing was added."""
    return F.when(F.col(f"{name}_n") > 0, joined(*[F.col(f"{name}_{p}") for p in PARTS]))


def mean_of_parts(name: str) -> Column:
    return of_parts(name) / F.col(f"{name}_n")


def total(value: str | Column) -> Column:
    """Sum of a column of doubles; NULL where there is nothing to add."""
    value = F.col(value) if isinstance(value, str) else value
    return joined(*[F.sum(p) for p in parts(value).values()])


def mean(value: str | Column) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return total(value) / F.count(_finite(value.cast("double")))
