"""Repeated keys by bitmaps."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ecotally.operators import repeats


def merged(df, found=None):
    return sorted(map(tuple, repeats.once_per_key(df, "k", ["max(v) AS v"], found).collect()), key=str)


def want(rows):
    best = {}
    for k, v in rows:
        best[k] = max([v, *([best[k]] if best.get(k) is not None else [])], key=lambda x: (x is not None, x or 0))
    return sorted(best.items(), key=str)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-70_000, 70_000), st.integers(-3, 3)), st.integers(0, 9)), max_size=30))
def test_once_per_key_equals_grouping(spark, rows):
    dense = [(k, 0) for k in range(-70_000, 70_001, 16)] if len(rows) % 2 else []  # else too sparse for bitmaps
    df = spark.createDataFrame([*rows, *dense], "k bigint, v int")
    assert merged(df) == want([*rows, *dense])


def test_only_suspect_buckets_are_grouped(spark):
    df = spark.range(200_000).selectExpr("if(id = 150000, 149999, id) AS k", "CAST(id % 10 AS INT) AS v")
    found = repeats.suspects(df, "k")
    assert found.buckets.count() == 1 and not found.nulls and not found.none()
    clean, some = found.split(df)
    assert clean.count() + some.count() == 200_000 and 0 < some.count() <= 32_768
    assert repeats.suspects(spark.range(5), "id").none()
    assert repeats.suspects(spark.range(0), "id").none()


@pytest.mark.parametrize("kind", ["string", "double", "decimal(20,0)"])
def test_other_keys_are_grouped_as_a_whole(spark, kind):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "k int, v int").selectExpr(f"CAST(k AS {kind}) AS k", "v")
    found = repeats.suspects(df, "k")
    assert found.buckets is None and found.split(df)[0] is None
    assert [v for _, v in merged(df, found)] == [2, 3]


def test_sparse_ids_are_grouped_as_a_whole(spark):
    df = spark.createDataFrame([(10**15, 1), (-(10**15), 2), (10**15, 3)], "k bigint, v int")
    assert repeats.suspects(df, "k").buckets is None and merged(df) == [(-(10**15), 2), (10**15, 3)]


def test_repeated_missing_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 1), (2, 2)], "k bigint, v int")
    assert merged(df) == [(1, 1), (2, 2), (None, 2)]
    one = spark.createDataFrame([(None, 1), (1, 1)], "k bigint, v int")
    assert repeats.suspects(one, "k").none() and merged(one) == [(1, 1), (None, 1)]
