"""Distances to faces that span the whole cloud: most of them have to be left out unmeasured, and none that is nearest."""

import numpy as np
import pyarrow as pa
import pytest

from quarryline.operators import mesh

NINE = [f"{k}{x}" for k in "abc" for x in "xyz"]


def slow(p, t):
    return np.array([mesh.triangle_distance(np.repeat(x[None], len(t), 0), t[:, 0], t[:, 1], t[:, 2]).min() for x in p])


def test_few_faces_are_measured(monkeypatch):
    rng = np.random.default_rng(11)
    p, v = rng.normal(0, 0.125, (600, 3)), rng.normal(0, 0.125, (4002, 3))
    t = np.stack([v[:-2], v[1:-1], v[2:]], 1)  # a strip over random points
    t[5, 2], t[6, 1:], t[7, 2] = t[5, 1], t[6, 0], t[7, 0] / 2 + t[7, 1] / 2  # without area
    t[8, 2] = t[8, 0] + (t[8, 1] - t[8, 0]) * 0.3 + 1e-9
    want, measured, exact = slow(p, t), [], mesh.triangle_distance
    monkeypatch.setattr(mesh, "triangle_distance", lambda q, *corners: measured.append(len(q)) or exact(q, *corners))
    state = mesh._Nearest(pa.table({**dict(zip("xyz", p.T, strict=True)), "id": np.arange(len(p))}))
    for some in np.array_split(t.reshape(-1, 9), 3):
        state.add(pa.RecordBatch.from_arrays([pa.array(c.copy()) for c in some.T], names=NINE))
    (out,) = state.end()
    got = dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True))
    assert [got[i] for i in range(len(p))] == want.tolist()
    assert sum(measured) < len(p) * len(t) * 0.05


@pytest.mark.parametrize("shift", [0.0, 1e7])
def test_strip_over_the_cloud(spark, monkeypatch, shift):
    monkeypatch.setattr(mesh, "LEAF", 16)
    monkeypatch.setattr(mesh, "POINTS", 100)
    rng = np.random.default_rng(12)
    p, v = rng.normal(size=(400, 3)) + shift, rng.normal(size=(302, 3)) + shift
    f = spark.createDataFrame([(i, i, i + 1, i + 2) for i in range(300)], "fid long, a long, b long, c long")
    vertices, points = (spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(a)], f"{k} long, x double, y double, z double") for k, a in (("vid", v), ("id", p)))
    got = {r["id"]: r["distance"] for r in mesh.point_to_mesh(points, f, vertices).collect()}
    assert [got[i] for i in range(400)] == slow(p, np.stack([v[:-2], v[1:-1], v[2:]], 1)).tolist()
