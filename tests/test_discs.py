"""Disc and Gaussian sums in tiles: the same as comparing all pairs, and rows are moved once."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelweave.operators import discs, gauss, spatial


def scattered(n=600, seed=3):
    """Two groups: even places, a crowd, copies of one place and long keys that a double cannot hold."""
    rng = np.random.default_rng(seed)
    xy = np.concatenate([rng.uniform(0, 60, (n // 2, 2)), rng.normal(20, 0.5, (n // 4, 2)), np.full((n // 8, 2), 20.0)])
    xy = np.concatenate([xy, rng.integers(0, 9, (n - len(xy), 2)).astype(float)])
    return pd.DataFrame({"g": np.where(np.arange(n) % 3, "a", "b"), "id": np.arange(n) + 2**60, "x": xy[:, 0], "y": xy[:, 1]})


def distances(part):
    x, y = part.x.to_numpy(), part.y.to_numpy()
    return np.sqrt((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2)


@pytest.fixture(params=[(0, 50, 10**6), (0, 50, 60), (0, 10**6, 10**6), (10**9, 50, 10**6)], ids=["tiles", "too crowded", "one tile", "cells"])
def ways(request, monkeypatch):
    rows, tile, block = request.param
    monkeypatch.setattr(spatial, "SWEEP_ROWS", rows)
    monkeypatch.setattr(discs, "TILE_ROWS", tile)
    monkeypatch.setattr(discs, "BLOCK_ROWS", block)
    monkeypatch.setattr(discs, "CHUNK", 100)


def test_counts_and_squares_of_all_pairs(spark, ways):
    pdf = scattered()
    df = spark.createDataFrame(pdf).withColumn("maybe", F.when(F.col("id") % 2 == 0, F.col("id")))
    n = {r.id: (r.n, r.maybe) for r in spatial.neighbours_within(df, ["g"], 3.0, "n").collect()}
    dens = {r.id: r.dens for r in spatial.kernel_density(df, ["g"], 3.0, "epanechnikov").collect()}
    assert len(n) == len(dens) == len(pdf)
    for _, part in pdf.groupby("g"):
        for i, row in zip(part.id, distances(part)):
            assert n[i] == ((row <= 3.0).sum(), None if i % 2 else i)
            assert dens[i] == pytest.approx(np.where(row <= 3.0, 0.75 * (1 - (row / 3) ** 2), 0).sum() / (np.pi * 9), rel=1e-9)


def test_weights_of_all_radii_at_once(spark, ways):
    """The weights of each radius alone; a row without a place has one at radius zero only."""
    pdf = scattered(240).assign(v=1.0)
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([("a", 1, None, 2.0, 1.0), ("c", 2, 1.0, 1.0, 1.0), ("c", 3, 1.0, 1.0, 1.0)], "g string, id long, x double, y double, v double"))
    got = spatial.decluster_by_radius(df, ["g"], [0.0, 1.0, 3.0, 40.0]).collect()
    for r in (0.0, 1.0, 3.0, 40.0):
        alone = {(q.g, q.id): q.w for q in spatial.decluster_weights(df, ["g"], r).collect()}
        assert {(q.g, q.id): q.w for q in got if q.dclust == r} == pytest.approx(alone, rel=1e-12)
        assert sum(q.dclust == r for q in got) == len(alone) == 242 + (r == 0)


def test_rows_are_written_once_for_all_radii(spark, monkeypatch):
    monkeypatch.setattr(spatial, "SWEEP_ROWS", 0)
    df, sizes, store = spark.createDataFrame(scattered()), [], spatial.cut_lineage

    def counting(frame):
        out = store(frame)
        sizes.extend([out.count()] if "id" in out.columns else [])
        return out

    monkeypatch.setattr(spatial, "cut_lineage", counting)
    out = spatial.decluster_by_radius(df, ["g"], [float(r) for r in range(1, 12)])
    assert out.count() == 11 * 600 and max(sizes) == 600
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan  # what is repeated is not shuffled


@pytest.mark.parametrize("limit, part", [(100, 10**5), (0, 40), (10**6, 10**5)])
def test_gaussian_of_all_pairs(spark, monkeypatch, limit, part):
    """Through nodes, over pairs, and both side by side; the work per row does not grow with the crowd."""
    monkeypatch.setattr(spatial, "SWEEP_ROWS", 0)
    monkeypatch.setattr(spatial, "GAUSS_PAIRS", limit)
    monkeypatch.setattr(gauss, "PART_ROWS", part)
    pdf = scattered()
    got = {r.id: r.dens for r in spatial.kernel_density(spark.createDataFrame(pdf), ["g"], 0.8).collect()}
    assert len(got) == len(pdf)
    for _, p in pdf.groupby("g"):
        want = np.exp(-0.5 * (distances(p) / 0.8) ** 2).sum(axis=1) / (2 * np.pi * 0.64)
        assert [got[i] for i in p.id] == pytest.approx(want.tolist(), rel=1e-12)


def test_gaussian_joins_no_pairs_of_a_crowd(spark, monkeypatch):
    monkeypatch.setattr(spatial, "SWEEP_ROWS", 0)
    frames, pairs = [], spatial._gaussian_pairs
    monkeypatch.setattr(spatial, "_gaussian_pairs", lambda d, wanted, x, y: (frames.append(wanted), pairs(d, wanted, x, y))[1])
    rng = np.random.default_rng(2)
    xy = np.concatenate([rng.uniform(0, 1, (2500, 2)), rng.uniform(500, 900, (40, 2))])
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "x": xy[:, 0], "y": xy[:, 1]}))
    assert spatial.kernel_density(df, ["g"], 1.0).count() == len(xy)
    assert [f.count() for f in frames] == [40]
