"""Sums of doubles that don't depend on the order of the rows."""

import math
import random
from fractions import Fraction

import pytest

from ecotally.functions.nulls import expr, strict_sum, total
from ecotally.operators.aggregate import group_area
from ecotally.operators.reshape import to_wide
from helpers import SF_SMALL


def sums(spark, values, parts):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(parts)
    return df.agg(expr(f"{total('x', 'double')} AS t")).first()[0]


@pytest.mark.parametrize("seed", range(3))
def test_totals_are_equal_for_any_partitions_and_near_the_exact_sum(spark, seed):
    rng = random.Random(seed)
    values = [rng.uniform(-1, 1) * 10.0 ** rng.randint(-6, 12) for _ in range(3000)]
    exact = sum(map(Fraction, values))
    got = {sums(spark, rng.sample(values, len(values)), n) for n in (1, 4, 32)}
    assert len(got) == 1
    # cut off below 2^-60 for each value, two roundings of the result
    assert abs(Fraction(got.pop()) - exact) <= Fraction(len(values), 2**60) + abs(exact) * Fraction(1, 2**51)


def test_cancellation_and_signs(spark):
    assert sums(spark, [1e15, 0.1, -1e15], 3) == 0.1
    assert sums(spark, [-0.5, -0.25], 1) == -0.75 and sums(spark, [-(2.0**40), 2.0**-40], 2) == -(2.0**40) + 2.0**-40
    assert sums(spark, [0.0, -0.0], 1) == 0.0
    assert sums(spark, [2.0**59 + 512] * 20_000, 8) == 20_000 * (2.0**59 + 512)


def test_values_out_of_range(spark):
    assert sums(spark, [1e300, 1.0], 1) == 1e300 and sums(spark, [math.inf, 1.0], 2) == math.inf
    assert math.isnan(sums(spark, [math.nan, 1.0], 2)) and math.isnan(sums(spark, [math.inf, -math.inf], 1))
    assert sums(spark, [2.0**60, 2.0**59], 2) == 2.0**60 + 2.0**59


def test_missing_and_empty(spark):
    df = spark.createDataFrame([("a", 1.5), ("a", None), ("b", 2.5)], "k string, x double")
    out = {r["k"]: (r["t"], r["s"]) for r in df.groupBy("k").agg(
        expr(f"{total('x', 'double')} AS t"), expr(f"{strict_sum('x', 'double')} AS s")).collect()}
    assert out == {"a": (1.5, None), "b": (2.5, 2.5)}
    assert df.limit(0).agg(expr(f"{total('x', 'double')} AS t")).first()[0] is None
    assert df.selectExpr("CAST(x AS FLOAT) AS x").agg(expr(f"{total('x', 'float')} AS t")).first()[0] == 4.0


def test_pivoted_and_grouped_sums(spark):
    rng = random.Random(9)
    rows = [(k % 3, rng.choice("ab"), rng.uniform(0, 1e6)) for k in range(2000)]
    df = spark.createDataFrame(rows, "i int, z string, area_t double")
    results = set()
    for n in (1, 7):
        wide = to_wide(df.repartition(n), ["i"], "z", ["a", "b"], "area_t").collect()
        long = group_area(df.repartition(n), ["i", "z"]).collect()
        cells = {(r["i"], z): r[z] for r in wide for z in "ab"}
        assert cells == {(r["i"], r["z"]): r["area_t"] for r in long}
        results.add(str(sorted(cells.items())))
    assert len(results) == 1


def test_registered_query_is_bit_equal_for_any_partitions(spark):
    from ecotally import queries
    from ecotally.plans import ecosystems as eco

    p = queries.odd_doubles(queries.inputs(spark, SF_SMALL))
    key = lambda df: sorted((str(r["bec_variant"]), str(r["ecosystem"]), str(r["strct"]), repr(r["area_t"])) for r in df.collect())
    got = [key(eco.eu_units(eco.components(p.repartition(n)))) for n in (1, 4, 32)]
    assert got[0] == got[1] == got[2]
