"""Work on neighbours that keeps no pairs, against numpy."""

import numpy as np
import pytest

from quarryline.operators import contacts, near, surface


def small(monkeypatch):
    for name, n in {"PROBES": 16, "POINTS": 8, "BINS": 4, "LEFT": 3, "PENDING": 20}.items():
        monkeypatch.setattr(near, name, n)


def test_nearest_of_each_kind(spark, monkeypatch):
    small(monkeypatch)
    rng = np.random.default_rng(3)
    p = np.r_[np.round(rng.normal(size=(90, 3)), 1), np.zeros((10, 3))]
    rows = [(i, *map(float, x), None if i % 7 == 0 else i % 3) for i, x in enumerate(p)]
    df = spark.createDataFrame([*rows, (100, float("nan"), 0.0, 0.0, 1), (101, None, 0.0, 0.0, 1)], "id long, x double, y double, z double, kind int")
    got = sorted((r["a_id"], -1 if r["b_kind"] is None else r["b_kind"], r["distance"], r["b_id"]) for r in near.nearest_of_each(df, df, 0.9, 2, "id", "kind").collect())
    want = []
    for i, a in enumerate(p):
        for kind in (None, 0, 1, 2):
            d = sorted((float(np.sqrt(((a - b) ** 2).sum())), j) for j, b in enumerate(p) if rows[j][4] == kind)
            want += [(i, -1 if kind is None else kind, x, j) for x, j in d[:2] if x <= 0.9]
    assert [(g[0], g[1], g[3]) for g in got] == [(w[0], w[1], w[3]) for w in sorted(want)]
    assert near.nearest_of_each(df, df.where("false"), 0.9, 2, "id", "kind").count() == 0


@pytest.mark.parametrize("plain", [False, True])
def test_median_heights(spark, monkeypatch, plain):
    small(monkeypatch)
    monkeypatch.setattr(surface, "radius_join", None)  # the list of all pairs isn't made
    rng = np.random.default_rng(4)
    p, w = rng.normal(size=(120, 3)), np.zeros(120) if plain else rng.uniform(0, 2, 120)
    p[0] = 50.0
    rows = [(i, *map(float, x), 0.0, 0.0, 1.0, float(c)) for i, (x, c) in enumerate(zip(p, w, strict=True))]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double, nx double, ny double, nz double, w double")
    got = {r["id"]: r["residual"] for r in surface.local_residual(df, 1.0, "w").collect()}
    assert len(got) == 120 and got[0] is None
    for i, a in enumerate(p):
        d = np.sqrt(((p - a) ** 2).sum(1))
        at = np.flatnonzero((d <= 1.0) & (np.arange(120) != i))
        if not len(at):
            assert got[i] is None
            continue
        h = np.abs(p[at, 2] - a[2])
        if plain:
            assert got[i] == pytest.approx(float(np.median(h)))
            continue
        v = np.exp(-0.5 * (d[at] / 0.5) ** 2) * np.exp(-0.5 * (h / 0.25) ** 2) * w[at]
        order = np.argsort(h)
        c = np.cumsum(v[order])
        assert got[i] == pytest.approx(float(h[order][np.argmax(c >= 0.5 * c[-1])]))


def test_contact_counts(spark, monkeypatch):
    small(monkeypatch)
    rng = np.random.default_rng(5)
    v = [(i, *map(float, np.round(x, 1))) for i, x in enumerate(rng.normal(size=(60, 3)))]
    f = [(i, *map(int, rng.choice(60, 3, replace=False))) for i in range(70)] + [(70, 1, 1, 2), (71, 3, 4, 5), (72, 3, 4, 5)]
    faces, vertices = spark.createDataFrame(f, "fid long, a long, b long, c long"), spark.createDataFrame(v, "vid long, x double, y double, z double")
    want = {r["category"]: r["count"] for r in contacts.contacts(faces, vertices, 0.5).groupBy("category").count().collect()}
    assert {r["category"]: r["n"] for r in contacts.contact_counts(faces, vertices).collect()} == want
    assert {"crossing", "separate", "shared_edge", "degenerate", "duplicate"} <= set(want)
    assert contacts.contact_counts(faces.where("false"), vertices).count() == 0
