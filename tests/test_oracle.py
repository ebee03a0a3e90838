"""Every registered query against its DuckDB oracle on sf0.001."""

import math

import pytest

import __spark_entry__ as entry
from helpers import SF_SMALL

from ecotally.oracle import ORACLE
from ecotally.queries import QUERIES


def _norm(v):
    """Exact comparison: the library and the oracle compute every double the
    same way (exact integer sums, one division), so values must be equal to
    the last bit."""
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, "nan" if math.isnan(v) else repr(v))
    return (1, str(v))


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    s_cols, s_rows = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(ORACLE[name])
    d_cols, d_rows = _rows([c[0] for c in cur.description], cur.fetchall())
    assert s_cols == d_cols
    assert len(s_rows) == len(d_rows)
    assert s_rows == d_rows


def test_entry_holds_every_query():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_map_code_report_is_in_sort_order(spark):
    rows = QUERIES["mc_report"](spark, SF_SMALL).collect()
    keys = [(r["sort"] is None, r["sort"] or 0, r["bec_variant"] is not None, r["bec_variant"] or "", r["ecosystem"]) for r in rows]
    assert keys == sorted(keys) and any(k[0] for k in keys) and not all(k[0] for k in keys)


def test_neighbours_differ(spark):
    """Queries on their own inputs give results of their own."""
    rows = lambda name: sorted(map(str, QUERIES[name](spark, SF_SMALL).collect()))
    assert rows("whr_rate") != rows("whr_rate_revised")
    assert rows("bhc_crosswalked") != rows("bhc_crosswalked_tem")
    assert QUERIES["whi_first_component"](spark, SF_SMALL).filter("rating IS NOT NULL").count() > 0
    assert QUERIES["recode_rules"](spark, SF_SMALL).filter("cem_ecp = '87238' AND strct_3 = '3'").count() == 1


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["bhc20", "total_area"]
    assert len(rows) > 0
    # level order, missing category last
    levels = [r["bhc20"] for r in rows]
    assert levels[-1] is None


_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_column_types_match_oracle(spark, duck, name):
    s = {c: _TYPES.get(t, t.upper().replace(" ", "")) for c, t in QUERIES[name](spark, SF_SMALL).dtypes}
    d = {r[0]: r[1].replace(" ", "") for r in duck.execute("DESCRIBE " + ORACLE[name]).fetchall()}
    assert s == d
