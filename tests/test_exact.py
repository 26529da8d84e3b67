"""Sums of doubles that do not depend on the order of rows."""

import math
import random
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from carequeue.functions import exact


def plain_sum(values):
    """By fractions: each value down to 2^-52, then one rounding of each half."""
    units = sum(math.trunc(Fraction(v) * 2**52) for v in values)
    whole, rest = divmod(units, 2**52)
    return float(whole) + rest / 2**52


def added(spark, values, parts):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(parts)
    return df.agg(exact.total("x"), exact.mean("x"), F.sum("x")).first()


def test_any_order_gives_the_same_digits(spark):
    rng = random.Random(3)
    values = [rng.choice([1e9, 1.0, 1e-3]) * rng.uniform(-1, 1) for _ in range(5000)]
    found = set()
    for parts in (1, 3, 7, 16):
        rng.shuffle(values)
        found.add(tuple(added(spark, values, parts)[:2]))
    assert found == {(plain_sum(values), plain_sum(values) / len(values))}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-1e12, 1e12), min_size=1, max_size=30))
def test_equals_fractions(spark, values):
    assert added(spark, values, 2)[0] == plain_sum(values)


def test_values_that_are_not_added(spark):
    row = added(spark, [1.5, None, float("nan"), float("inf"), 2.25], 2)
    assert row[:2] == (3.75, 1.875)
    assert added(spark, [None, float("nan")], 1)[:2] == (None, None)
    empty = spark.createDataFrame([], "x double").agg(exact.total("x"), exact.mean("x")).first()
    assert empty[:] == (None, None)


def test_parts_can_be_taken_away(spark):
    rng = random.Random(1)
    first, second = ([rng.uniform(-10, 10) for _ in range(50)] for _ in range(2))
    rows = [(1, v) for v in first] + [(2, v) for v in second]
    df = spark.createDataFrame(rows, "g int, x double")
    names = exact.part_names("s")
    of = df.groupBy("g").agg(*exact.part_sums("s", F.col("x")))
    both = df.agg(*exact.part_sums("s", F.col("x")))
    left = both.crossJoin(of.where("g = 1").select(*[F.col(n).alias(f"b_{n}") for n in names]))
    difference = left.select(*[(F.col(n) - F.col(f"b_{n}")).alias(n) for n in names])
    row = difference.select(exact.of_parts("s"), exact.mean_of_parts("s")).first()
    assert row[0] == plain_sum(second) and row[1] == pytest.approx(sum(second) / 50, abs=1e-12)
