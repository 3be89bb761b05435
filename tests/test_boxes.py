"""Boxes of any sizes, contacts of faces and distances to a mesh, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.operators import boxes, contacts, mesh


def mesh_of(spark, triangles):
    v = spark.createDataFrame([(3 * i + j, *map(float, t[j])) for i, t in enumerate(triangles) for j in range(3)], "vid long, x double, y double, z double")
    f = spark.createDataFrame([(i, 3 * i, 3 * i + 1, 3 * i + 2) for i in range(len(triangles))], "fid long, a long, b long, c long")
    return f, v


def triangles(n, seed, sizes=(0.02, 0.3, 4.0)):
    rng = np.random.default_rng(seed)
    return rng.uniform(-2, 2, (n, 1, 3)) + rng.normal(size=(n, 3, 3)) * rng.choice(sizes, (n, 1, 1))


def box_pairs(t):
    lo, hi = t.min(1), t.max(1)
    meet = ((lo[:, None] <= hi[None]) & (lo[None] <= hi[:, None])).all(2)
    return {(i, j) for i, j in zip(*np.nonzero(meet), strict=True) if i < j}


@pytest.mark.parametrize("cell", [2048, 9])
def test_contacts_are_those_of_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(boxes, "CELL", cell)
    t = triangles(160, 3)
    t[5] = t[6] = t[7]  # repeated faces
    t[8] = t[8][:1]  # a point
    t = np.concatenate([t, [[[-60, -60, 0.1], [60, -60, 0.1], [0, 90, 0.1]]]])  # one face across everything
    f, v = mesh_of(spark, t)
    for unit in (1.0, 0.013):
        got = {(r["fa"], r["fb"]): r["category"] for r in contacts.contacts(f, v, unit).collect()}
        want = box_pairs(t)
        assert set(got) == want
        assert all(got[i, j] == contacts.classify(t[i], t[j]) for i, j in want)


def test_pairs_come_once(spark):
    t = triangles(120, 5)
    f, v = mesh_of(spark, t)
    assert contacts.contacts(f, v).count() == len(box_pairs(t))


def test_no_face_and_odd_corners(spark):
    f, v = mesh_of(spark, triangles(6, 1))
    odd = v.withColumn("x", F.when(F.col("vid") == 0, float("nan")).when(F.col("vid") == 4, float("inf")).when(F.col("vid") != 7, F.col("x")))
    assert contacts.contacts(f.where("false"), v).count() == 0
    assert {x for r in contacts.contacts(f, odd).collect() for x in (r["fa"], r["fb"])} <= {3, 4, 5}


def test_one_huge_face_and_a_crowd_stay_in_bounds(spark, monkeypatch):
    """No block of a crowded cell meets more than CELL boxes of either side."""
    monkeypatch.setattr(boxes, "CELL", 50)
    rng = np.random.default_rng(0)
    rows = [(i, *p.tolist(), *(p + 0.01).tolist()) for i, p in enumerate(rng.uniform(0, 1, (700, 3)))]
    df = spark.createDataFrame([*rows, (9999, -1.0, -1.0, -1.0, 9.0, 9.0, 9.0)], "fid long, lox double, loy double, loz double, hix double, hiy double, hiz double")
    met = boxes.meeting(df, "fid")
    assert met.where("qfid = 9999").count() == 700
    shuffled = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # else the join of so few rows is broadcast
    for k, v in shuffled.items():
        spark.conf.set(k, v)
    try:
        met = boxes.meeting(df, "fid")
        largest = met.where("qfid = 9999").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        for k in shuffled:
            spark.conf.unset(k)
    assert largest < 500  # of 4 partitions


def slow(p, t):
    q = np.repeat(p, len(t), axis=0)
    f = np.tile(t, (len(p), 1, 1))
    return mesh.triangle_distance(q, f[:, 0], f[:, 1], f[:, 2]).reshape(len(p), -1).min(1)


def test_every_point_has_its_distance(spark, monkeypatch):
    monkeypatch.setattr(mesh, "LEAF", 4)
    monkeypatch.setattr(mesh, "POINTS", 16)
    monkeypatch.setattr(boxes, "FAN", 3)
    monkeypatch.setattr(boxes, "NODES", 9)
    t = triangles(150, 2, (0.05, 0.4))
    t[3] = t[3][:1]
    rng = np.random.default_rng(8)
    p = np.concatenate([rng.uniform(-3, 3, (200, 3)), rng.normal(size=(20, 3)) * 1e4, t[:10, 0], np.repeat(rng.uniform(-1, 1, (1, 3)), 60, 0)])
    f, v = mesh_of(spark, t)
    df = spark.createDataFrame([(i % 240, *map(float, x), "k") for i, x in enumerate(p)], "id long, x double, y double, z double, block string")
    got = sorted((r["id"], r["distance"]) for r in mesh.point_to_mesh(df, f, v).collect())
    want = sorted((i % 240, d) for i, d in enumerate(slow(p, t).tolist()))
    assert len(got) == len(want) and all(a == b and x == pytest.approx(y, rel=1e-9, abs=1e-9) for (a, x), (b, y) in zip(got, want, strict=True))
    near = mesh.point_to_mesh(df, f, v, reach=0.5).collect()
    assert len(near) == len(p) and all(r["distance"] is None or r["distance"] <= 0.5 for r in near) and sum(r["distance"] is None for r in near) == sum(d > 0.5 for _, d in want)


def test_distance_odd(spark):
    f, v = mesh_of(spark, triangles(5, 4))
    p = spark.createDataFrame([(1, None, 0.0, 0.0), (2, float("nan"), 0.0, 0.0), (3, float("inf"), 1.0, 1.0), (None, 0.0, 0.0, 0.0), (4, 0.0, 0.0, 0.0)], "id long, x double, y double, z double")
    got = {r["id"]: r["distance"] for r in mesh.point_to_mesh(p, f, v).collect()}
    assert [got[i] for i in (1, 2, 3)] == [None] * 3 and got[None] == got[4] > 0
    assert {r["distance"] for r in mesh.point_to_mesh(p, f.where("false"), v).collect()} == {None}
    assert mesh.point_to_mesh(p.where("false"), f, v).count() == 0
