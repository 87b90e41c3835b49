"""Every query with SQL gives the SQL's rows on the smallest tables; the others run."""

import math

import pytest

from oracle_check import connect, norm
from panelweave.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def close(a, b):
    if a == b:
        return True
    try:
        x, y = float(a), float(b)
    except ValueError:
        return False
    return math.isclose(x, y, rel_tol=2e-6, abs_tol=2e-3)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    # text and whole numbers first, so that rows line up before decimals are compared
    exact = [f.name for f in df.schema.fields if f.dataType.simpleString() not in ("double", "float")]
    cols = sorted(exact) + sorted(c for c in df.columns if c not in exact)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert len(got) == len(want)
    bad = [(g, w) for g, w in zip(got, want) if not all(close(a, b) for a, b in zip(g, w))]
    assert not bad, (cols, bad[:3])


# Columns that tell the rows of a query without SQL apart.
KEYS = {
    "class_letters": ["variable", "class"],
    "cluster_robust_errors": ["outcome", "term"],
    "huber_unit_trend": ["aquifer", "cc"],
    "unit_trend_tests": ["aquifer", "cc"],
    "propensity_scores": ["unit_id"],
    "tail_probabilities": ["o_custkey"],
    "weighted_mixed_model": ["aquifer", "term"],
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_values(spark, name):
    """Queries without SQL: rows, told apart by their keys; finite numbers; errors, shares and counts in their range."""
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    keys = [k for k in KEYS.get(name, []) if k in df.columns]
    assert not keys or len({tuple(r[k] for k in keys) for r in rows}) == len(rows)
    numbers = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")]
    for c in numbers:
        seen = [r[c] for r in rows if r[c] is not None]
        assert all(math.isfinite(v) for v in seen), c
        if c == "se" or c.startswith("se_") or c in ("df", "tau2", "weights"):
            assert all(v >= 0 for v in seen), c
        if c in ("p", "ps", "p_value") or c.startswith("p_"):
            assert all(0 <= v <= 1 for v in seen), c
    if {"estimate", "se"} <= set(df.columns):
        assert any(r["estimate"] is not None and r["se"] is not None and r["se"] > 0 for r in rows)
    for c in ("n", "k", "k_cluster"):
        if c in df.columns:
            assert all(r[c] is None or r[c] >= 0 for r in rows)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(e.oracle_sql()) <= set(e.queries())
