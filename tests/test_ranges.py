"""Quantiles of groups that are cut into ranges, and these again, against numpy."""

import numpy as np
import pytest

from quarryline.operators import stats


@pytest.mark.parametrize("fits", [True, False])
def test_ranges_of_ranges(spark, monkeypatch, fits):
    if not fits:
        monkeypatch.setattr(stats, "SMALL", 7)
        monkeypatch.setattr(stats, "PARTS", 4)
        monkeypatch.setattr(stats, "_fits", lambda values, by: False)
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=400), "b": np.r_[np.zeros(60), rng.integers(0, 5, 40)].astype(float), None: rng.uniform(size=90), "c": np.array([3.0])}
    rows = [(g, float(x), float(w)) for g, some in groups.items() for x, w in zip(some, rng.uniform(0.1, 2, len(some)), strict=True)]
    df = spark.createDataFrame([*rows, ("a", float("nan"), 1.0), ("d", None, 1.0)], "g string, x double, w double")
    got = {r["g"]: r for r in stats.quantiles(df, ["g"], "x", {"q10": 0.1, "q50": 0.5, "q93": 0.93}).collect()}
    assert set(got) == set(groups)
    for g, some in groups.items():
        assert [got[g][q] for q in ("q10", "q50", "q93")] == pytest.approx(np.percentile(some, [10, 50, 93]).tolist())
    weighted = {r["g"]: r for r in stats.weighted_stats(df, ["g"], "x", "w").collect()}
    trimmed = {r["g"]: r for r in stats.trimmed_rmse(df, ["g"], "x", 0.8, 1.0).collect()}
    for g in groups:
        own = sorted((x, w) for k, x, w in rows if k == g)
        total, upto = sum(w for _, w in own), 0.0
        for x, w in own:
            upto += w
            if upto >= 0.5 * total:
                break
        assert weighted[g]["median"] == x and weighted[g]["n"] == len(own)
        low = np.minimum(sorted(groups[g]), 1.0)
        low = low[: min(len(low), max(8, int(np.ceil(0.8 * len(low)))))]
        assert trimmed[g]["rmse"] == pytest.approx(float(np.sqrt(np.mean(low**2)))) and trimmed[g]["n"] == len(low)


def test_only_ranges_with_a_wanted_rank_are_sorted(spark, monkeypatch):
    """Of a large group few rows reach a window; a value that fills nearly all of a group ends the search too."""
    monkeypatch.setattr(stats, "SMALL", 50)
    monkeypatch.setattr(stats, "PARTS", 16)
    monkeypatch.setattr(stats, "_fits", lambda values, by: False)
    seen, picked = [], stats._picked
    monkeypatch.setattr(stats, "_picked", lambda inside, keys, ready: seen.append(stats._same(inside, ready.select(*keys, "_b").distinct(), [*keys, "_b"]).count()) or picked(inside, keys, ready))
    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(size=3000), "b": np.r_[np.ones(3), np.full(997, 2.0)], "c": np.arange(9.0)}
    df = spark.createDataFrame([(g, float(x)) for g, some in groups.items() for x in some], "g string, x double")
    got = {r["g"]: r for r in stats.finite_stats(df, ["g"], "x", {"p05": 0.05}).collect()}
    for g, some in groups.items():
        middle = np.median(some)
        assert [got[g]["median"], got[g]["p05"], got[g]["mad"]] == pytest.approx([middle, np.percentile(some, 5), np.median(np.abs(some - middle))])
    assert seen and sum(seen) < 1000
