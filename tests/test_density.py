"""Counts and clusters by cell sums against all pairs."""

import time

import numpy as np
import pytest

from quarryline.operators import density, joins, surface

AXES = ("x", "y", "z")


def frame(spark, points, ids=None):
    ids = range(len(points)) if ids is None else ids
    return spark.createDataFrame([(int(i), *map(float, p)) for i, p in zip(ids, points, strict=True)], "id long, x double, y double, z double")


def within(points, radius):
    d = points[:, None] - points[None]
    return (d[..., 0] ** 2 + d[..., 1] ** 2 + d[..., 2] ** 2) <= radius * radius


def linked(points, radius, least):
    near = within(points, radius)
    core = near.sum(1) >= least
    label = np.where(core, np.arange(len(points)), -1)
    while True:
        new = label.copy()
        for i in np.flatnonzero(core):
            new[i] = label[near[i] & core].min()
        if (new == label).all():
            break
        label = new
    return [int(label[i]) if core[i] else int(label[np.flatnonzero(near[i] & core)[0]]) if (near[i] & core).any() else None for i in range(len(points))]


def cloud(case):
    rng = np.random.default_rng(case)
    return {
        0: rng.uniform(0, 4, (250, 3)),
        1: np.concatenate([rng.normal(0, 0.05, (120, 3)), rng.normal(0, 0.05, (60, 3)) + [0.9, 0, 0], rng.uniform(-3, 3, (80, 3)), np.zeros((30, 3))]),
        2: np.concatenate([np.stack([np.arange(0, 12, 0.11), np.sin(np.arange(0, 12, 0.11)), np.zeros(110)], 1), rng.uniform(0, 12, (60, 3))]),
        3: np.floor(rng.uniform(-3, 3, (220, 3))) * 0.5,
    }[case]


@pytest.mark.parametrize("case", range(4))
def test_same_as_all_pairs(spark, case):
    points, radius = cloud(case), 0.5
    df = frame(spark, points)
    near = within(points, radius)
    assert {r["id"]: r["neighbors"] for r in density.counts(df, radius, "id", AXES).collect()} == dict(enumerate((near.sum(1) - 1).tolist()))
    assert {r["id"] for r in density.at_least(df, radius, 4, "id", AXES).collect()} == set(np.flatnonzero(near.sum(1) > 4).tolist())
    assert {r["id"]: r["cluster"] for r in density.clusters(df, radius, 4, "id", AXES).collect()} == dict(enumerate(linked(points, radius, 4)))


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, -0.0, 0.0, 0.0), (2, 0.1, 0.0, 0.0), (3, None, 0.0, 0.0), (4, float("nan"), 0.0, 0.0), (5, float("inf"), 0.0, 0.0), (6, 9.0, 9.0, 9.0)], "id long, x double, y double, z double")
    assert sorted((r["id"], r["neighbors"]) for r in joins.radius_counts(df, 0.2, "id", AXES).collect()) == [(1, 2), (2, 2), (2, 2), (3, 0), (4, 0), (5, 0), (6, 0)]
    assert sorted((r["id"], r["cluster"]) for r in surface.clusters(df, 0.2, 3).collect() if r["cluster"] is not None) == [(1, 1), (2, 1), (2, 1)]
    assert joins.radius_counts(df.where("false"), 0.2, "id", AXES).count() == surface.clusters(df.where("false"), 0.2, 3).count() == 0
    assert {(r["a_id"], r["b_id"]) for r in joins.knn_join(df.where("id in (1, 5, 6)"), df.where("id in (1, 5, 6)"), 1, "id", AXES, skip_self=True).collect()} == {(1, 6), (6, 1)}


def test_copies_cost_no_more_than_points(spark):
    """Copies are one row with their number, so their pairs are never listed."""
    from pyspark.sql import functions as F

    n = 24_000
    spread = spark.range(n).select("id", *[(F.rand(i) * 40).alias(x) for i, x in enumerate(AXES)]).cache()
    copies = spark.range(n).select("id", *[F.lit(0.5).alias(x) for x in AXES])
    took = {}
    for name, df in (("warm", copies), ("spread", spread), ("copies", copies)):
        began = time.time()
        total = joins.radius_counts(df, 1.0, "id", AXES).agg(F.sum("neighbors")).first()[0]
        took[name] = time.time() - began
    assert total == n * (n - 1) and took["copies"] < took["spread"] * 1.5 + 2
    assert surface.clusters(copies, 1.0, 5).select("cluster").distinct().count() == 1
