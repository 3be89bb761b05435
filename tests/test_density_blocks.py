"""Counts by blocks and chunks, where the radius cuts most of them, against all pairs."""

import numpy as np
import pytest

from quarryline.operators import density, near


@pytest.mark.parametrize("k", [2, 3, 4])
@pytest.mark.parametrize("radius", [0.05, 0.6, 9.0])
def test_no_list_of_cells_or_pairs(spark, monkeypatch, k, radius):
    for name, n in {"POINTS": 16, "BLOCKS": 6, "FEW": 5}.items():
        monkeypatch.setattr(near, name, n)
    monkeypatch.setattr(density, "_neighbours", None)  # no table of cells that meet, whose points would be joined into pairs
    rng = np.random.default_rng(k)
    p = np.r_[rng.normal(0, 0.4, (150, k)), np.round(rng.normal(0, 0.5, (40, k)), 1), np.repeat(rng.normal(0, 0.4, (2, k)), 9, 0)]
    axes = tuple(f"a{i}" for i in range(k))
    rows = [(i, *map(float, x)) for i, x in enumerate(p)]
    df = spark.createDataFrame([*rows, (500, *[float("nan")] * k), (501, *[None] * k)], "id long, " + ", ".join(f"{a} double" for a in axes))
    d2 = sum(((p[:, None, i] - p[None, :, i]) ** 2 for i in range(1, k)), (p[:, None, 0] - p[None, :, 0]) ** 2)
    want = dict(enumerate(((d2 <= radius * radius).sum(1) - 1).tolist())) | {500: 0, 501: 0}
    assert {r["id"]: r["neighbors"] for r in density.counts(df, radius, "id", axes).collect()} == want
    assert {r["id"] for r in density.at_least(df, radius, 6, "id", axes).collect()} == {i for i, n in want.items() if n >= 6}
