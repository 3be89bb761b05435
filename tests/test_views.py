"""The validation of views on pictures whose depth is known."""

import numpy as np
import pandas as pd
import pytest

from quarryline.operators import views

W, H = 48, 32


def scene(seed: int = 0):
    """Two planes that meet at u = 24 with an edge, regions of 8 by 8, and noise, outliers, gaps and weak states."""
    rng = np.random.default_rng(seed)
    v, u = np.indices((H, W))
    true = np.where(u < 24, 100 + 0.2 * u + 0.1 * v, 160 - 0.3 * u + 0.2 * v)
    g = pd.DataFrame({"view": 3, "u": u.ravel(), "v": v.ravel(), "region": ((v // 8) * 6 + u // 8).ravel(), "true": true.ravel()})
    g["inside"], g["usable"], g["state"], g["confidence"] = True, True, 1, 0.8
    g["gradient"] = np.where(np.abs(g["u"] - 23.5) < 1, 80.0, 5.0)
    g["disparity"] = g["true"] + rng.normal(0, 0.2, len(g))
    return g


def run(spark, g):
    df = spark.createDataFrame(g.drop(columns="true")).repartition(3)
    out = views.validate_views(df, W, H, 1000.0, 50.0)
    return out.toPandas().merge(g[["u", "v", "true"]], on=["u", "v"]), views.view_report(out).collect()[0]


def test_clean_view(spark):
    out, report = run(spark, scene())
    assert len(out) == W * H and set(out["source"]) == {2} and set(out["loss"]) == {0}
    assert np.allclose(out["depth"], 5e4 / out["true"], rtol=0.02)
    assert report["verdict"] == "warning" and report["warn_reasons"] == ["high_coverage"] and report["source_2"] == W * H


def test_sources_and_losses(spark):
    g = scene(1)
    at = lambda u, v: (g["u"] == u) & (g["v"] == v)
    g.loc[at(3, 3), "disparity"] += 60  # contradicted by model and neighbours
    g.loc[at(5, 5), "disparity"] = np.nan  # a gap among supported pixels
    g.loc[at(12, 12), "state"] = 3  # one-sided
    g.loc[at(13, 13), "state"] = 5  # weak, but model and neighbours agree
    g.loc[at(14, 14), "state"] = 4  # contradicted match
    empty = g["region"] == 8  # nothing observed, neighbours on one plane
    g.loc[empty, "disparity"] = np.nan
    g.loc[g["region"] == 23, "inside"] = False
    out, report = run(spark, g)
    one = lambda u, v: out[(out["u"] == u) & (out["v"] == v)].iloc[0]
    assert (one(3, 3)["source"], one(3, 3)["loss"]) == (0, 3) and np.isnan(one(3, 3)["depth"])
    assert one(5, 5)["source"] == 3 and abs(one(5, 5)["value"] - one(5, 5)["true"]) < 0.5
    assert one(12, 12)["source"] == 8 and one(13, 13)["source"] == 9 and one(14, 14)["source"] == 0
    hole = out[out["region"] == 8]
    assert set(hole["source"]) == {7} and np.abs(hole["value"] - hole["true"]).max() < 1.0
    assert len(out) == W * H - 64 and report["inside"] == len(out) and report["source_7"] == 64


def test_region_without_a_model(spark):
    g = scene(2)
    rng = np.random.default_rng(0)
    wild = g["region"] == 0
    g.loc[wild, "disparity"] = rng.uniform(10, 900, wild.sum())
    g.loc[wild, "confidence"] = 0.1
    few = g["region"] == 1
    g.loc[few, "disparity"] = np.where(rng.random(few.sum()) < 0.25, g.loc[few, "disparity"], np.nan)  # a consensus, but too few seeds
    out, _ = run(spark, g)
    assert (out[out["region"] == 0]["source"] > 0).mean() < 0.3
    some = out[(out["region"] == 1) & out["physical"]]
    assert set(some["source"]) <= {1, 2, 5, 6} and len(some) > 5


def test_local_statistics_match_brute_force(spark):
    g = scene(3)
    g.loc[::7, "state"] = 4
    df = spark.createDataFrame(g.drop(columns="true"))
    got = views.local_statistics(views.observations(df)).toPandas().sort_values(["v", "u"])
    ok = got["eligible"].to_numpy().reshape(H, W)
    d, w = (got[c].to_numpy().reshape(H, W) for c in ("disparity", "confidence"))
    for y, x in ((0, 0), (10, 20), (31, 47), (5, 46)):
        here = np.zeros((H, W), bool)
        here[max(0, y - 5) : y + 6, max(0, x - 5) : x + 6] = True
        here[y, x] = False
        here &= ok
        mean = np.average(d[here], weights=w[here])
        row = got[(got["u"] == x) & (got["v"] == y)].iloc[0]
        assert row["local_mean"] == pytest.approx(mean) and row["local_scale"] == pytest.approx(np.sqrt(np.average((d[here] - mean) ** 2, weights=w[here])), abs=1e-4)
