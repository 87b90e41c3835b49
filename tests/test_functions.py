import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle_check import norm
from panelweave.functions import distributions as D
from panelweave.functions import labels, nulls, projection
from panelweave.operators import summaries
from panelweave.plans import ORACLES, QUERIES


def one(spark, col, **vals):
    schema = ", ".join(f"{k} double" for k in vals)
    return spark.createDataFrame([tuple(vals.values())], schema).select(col.alias("o")).first()["o"]


@pytest.mark.parametrize(
    "a,b,want",
    [(1.0, 2.0, 0.5), (1.0, 0.0, math.inf), (-1.0, 0.0, -math.inf), (0.0, 0.0, None), (None, 1.0, None), (1.0, None, None), (0.0, 3.0, 0.0)],
)
def test_ratio(spark, a, b, want):
    assert one(spark, nulls.ratio("a", "b"), a=a, b=b) == want


@pytest.mark.parametrize(
    "x,want",
    [((0.029 - 0.05) / (34.6 - 25), -0.002188), (0.0078125, 0.007813), (0.5e-6, 1e-6), (2.5e-6, 3e-6), (0.4999e-6, 0.0), (1e300, 1e300), (math.inf, math.inf), (-math.inf, -math.inf), (None, None)],
)
def test_round_scaled(spark, x, want):
    assert one(spark, nulls.round_scaled("x", 6), x=x) == want


def test_null_rules_rounds_as_its_sql(spark, tmp_path):
    rows = [(q, d) for q in (5.0, 6.0, 15.0, 25.0, 34.6, 23.72, 24.99999, 1e300, math.inf, math.nan, None) for d in (0.0, 0.029, 0.05, 0.06, 1e15, math.inf, math.nan, None)]
    df = spark.createDataFrame([(i, 1, q, d, "A") for i, (q, d) in enumerate(rows)], "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string")
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    sql = con.execute(f"SELECT l_orderkey, l_linenumber, hi, lo, r FROM ({ORACLES['null_rules']}) ORDER BY 1").fetchall()
    got = QUERIES["null_rules"](spark, str(tmp_path)).select("l_orderkey", "l_linenumber", "hi", "lo", "r").orderBy("l_orderkey").collect()
    assert [[norm(v) for v in r] for r in got] == [[norm(v) for v in r] for r in sql]


def test_strict_extremes(spark):
    assert one(spark, nulls.strict_greatest("a", "b"), a=1.0, b=None) is None
    assert one(spark, nulls.strict_greatest("a", "b"), a=1.0, b=2.0) == 2.0
    assert one(spark, nulls.strict_least("a", "b"), a=1.0, b=2.0) == 1.0


def test_exclusion_keeps_null(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "c string")
    assert {r.c for r in df.where(nulls.not_in_keep_null("c", ["a"])).collect()} == {None, "b"}


def test_strict_mean_and_empty_sum(spark):
    df = spark.createDataFrame([(1, 2.0), (1, None), (2, 3.0), (3, None)], "g int, x double")
    got = {r.g: (r.m, r.s) for r in df.groupBy("g").agg(nulls.strict_avg("x").alias("m"), nulls.sum_or_zero("x").alias("s")).collect()}
    assert got == {1: (None, 2.0), 2: (3.0, 3.0), 3: (None, 0.0)}


def test_labels(spark):
    assert [one(spark, labels.stars("p"), p=p) for p in (0.001, 0.02, 0.07, 0.5, None)] == ["***", "**", "*", "", ""]
    assert one(spark, labels.slope_class("b", "p"), b=-1.0, p=0.05) == "neg_sig"
    assert one(spark, labels.slope_class("b", "p"), b=0.0, p=0.05) is None
    assert one(spark, labels.compact_number("x", 1), x=0.0012) == "1.2e-03"
    assert one(spark, labels.compact_number("x"), x=12.345) == "12.35"


def _t_tail(t, df):
    x = np.linspace(0, abs(t), 400001)
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    return 1 - 2 * np.trapezoid(c * (1 + x * x / df) ** (-(df + 1) / 2), x)


@pytest.mark.parametrize("t,df", [(0.3, 1), (2.0, 2.28), (1.1, 3.61), (2.5, 17), (4.0, 300), (0.0, 5)])
def test_t_tail(t, df):
    assert D.t_two_sided(np.array([t]), np.array([df]))[0] == pytest.approx(_t_tail(t, df), abs=1e-9)


def test_t_quantile_and_range():
    # textbook values
    assert D.t_quantile(0.975, np.array([10.0]))[0] == pytest.approx(2.228139, abs=1e-6)
    assert D.studentised_range_tail(3.877, 3, 10) == pytest.approx(0.05, abs=1e-4)
    assert D.studentised_range_tail(4.039, 5, 40) == pytest.approx(0.05, abs=2e-4)


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(12.5, 47.25), (-170.0, -60.0)], "lon double, lat double")
    r = df.select("lon", "lat", projection.lon_from_web(projection.web_x("lon")).alias("a"), projection.lat_from_web(projection.web_y("lat")).alias("b")).collect()
    for x in r:
        assert (x.a, x.b) == (pytest.approx(x.lon), pytest.approx(x.lat))
    # the equal-area grid keeps the ellipsoid's area: 4 pi R_authalic^2
    top = df.sparkSession.range(1).select((projection.equal_area_x(F.lit(180.0)) * projection.equal_area_y(F.lit(90.0)) * 4).alias("v")).first().v
    assert top == pytest.approx(4 * math.pi * 6371007.1809**2, rel=1e-9)


def test_class_intervals_against_tabled_quantiles(spark):
    """The t interval of class means, with the 97.5 percent points of printed tables."""
    table = {1: 12.7062, 2: 4.30265, 4: 2.77645, 9: 2.26216, 29: 2.04523}
    rng = np.random.default_rng(4)
    data = {df: rng.normal(10, 3, df + 1) for df in table}
    rows = [(str(df), float(v)) for df, vs in data.items() for v in vs] + [("one", 1.0), ("one", None)]
    got = {r["class"]: r for r in summaries.class_means(spark.createDataFrame(rows, "class string, v double"), [], "class", "v").collect()}
    for df, vs in data.items():
        half = table[df] * vs.std(ddof=1) / np.sqrt(df + 1)
        r = got[str(df)]
        assert (r["mean"], r.se, r.ci_low, r.ci_high) == pytest.approx((vs.mean(), vs.std(ddof=1) / np.sqrt(df + 1), vs.mean() - half, vs.mean() + half), rel=2e-5)
    assert got["one"].ci_low is None and got["one"].se is None
