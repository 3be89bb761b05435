"""Fusion on planes whose truth is known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.functions.geometry import rotation
from quarryline.operators import alignment, fusion

POINT = "id int, x double, y double, z double, nx double, ny double, nz double, w double, mask long"


def sheet(spark, n=14, noise=0.05, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, i % n * 1.0, i // n * 1.0, float(rng.normal(0, noise)), 0.0, 0.0, 1.0, 1.0, 1 << (i % 3)) for i in range(n * n)]
    return spark.createDataFrame(rows, POINT).repartition(3)


def heights(df):
    return np.array([r["z"] for r in df.collect()])


def test_regularize(spark):
    df = sheet(spark)
    flat = fusion.regularize(df, 2, 8, 1.0, 2.5, "w", mask="mask")
    assert flat.columns == df.columns and flat.count() == df.count()
    assert heights(flat).std() < 0.6 * heights(df).std()
    normals = np.array([[r[c] for c in ("nx", "ny", "nz")] for r in flat.collect()])
    assert (normals[:, 2] > 0.95).all()
    still = fusion.regularize(df, 1, 8, 1.0, 2.5, "w", total=0.0)
    assert np.allclose(sorted(heights(still)), sorted(heights(df)))
    turned = fusion.aligned_normals(df, 2.5, df.withColumn("nz", F.lit(-1.0)))
    assert all(r["nz"] < -0.9 for r in turned.collect())


def posed(spark, bias, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(600):
        p, x, y = i % 5, *rng.uniform(0, 20, 2)
        h = bias[p] + rng.normal(0, 0.01)
        rows.append((i, p, float(x), float(y), float(h), 0.0, 0.0, 1.0, float(h)))
    return spark.createDataFrame(rows, "id int, pose int, x double, y double, z double, nx double, ny double, nz double, height double").repartition(3)


def test_pose_bias(spark):
    bias = [0.0, 0.3, -0.2, 0.0, 2.0]
    moved, poses = fusion.pose_bias_consensus(posed(spark, bias), (5.0, 10.0), 0.05, 1.0)
    found = {r["pose"]: r for r in poses.collect()}
    assert all(abs(found[p]["bias_0"] - b) < 0.06 and found[p]["accepted"] == (p < 4) for p, b in enumerate(bias))
    z = {p: np.mean([r["z"] for r in moved.where(F.col("pose") == p).collect()]) for p in range(5)}
    assert all(abs(z[p]) < 0.06 for p in range(4)) and abs(z[4] - 2) < 0.02


def test_regional_shift(spark):
    df = posed(spark, [0.0] * 5).withColumn("height", F.col("height") + F.when(F.col("x") < 10, 0.4).otherwise(F.when(F.col("pose") == 2, 0.4).otherwise(0.0)))
    df = df.withColumn("z", F.lit(0.5) + F.col("height"))
    moved, regions = fusion.regional_pose_shift(df, 10.0, 1.0)
    got = {r["region"]["x"]: (round(r["shift"], 1), r["accepted"]) for r in regions.where("region.z = 0").collect()}
    assert got[0] == (0.4, True) and got[1][1] is False
    assert abs(np.mean([r["height"] for r in moved.where("x < 10").collect()])) < 0.01


def test_layers_and_regions(spark):
    rows = [(0, p, 0.01 * p) for p in range(4)] + [(0, p, 1.0) for p in range(2)] + [(1, 0, 0.0), (1, 0, 0.02), (1, 1, 3.0), (1, 2, 3.1)]
    layers = fusion.resolve_layers(spark.createDataFrame(rows, "seed int, pose int, height double"), 0.5)
    got = {(r["seed"], r["layer"]): (round(r["height"], 3), r["poses"], r["chosen"]) for r in layers.collect()}
    assert got == {(0, 0): (0.015, 4, True), (0, 1): (1.0, 2, False), (1, 0): (0.01, 1, False), (1, 1): (3.05, 2, True)}
    patches = [(i, 0.1 * i, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0 if i != 7 else 4.0, 0.01, 0.02, 3 if i != 3 else 1) for i in range(20)]
    df = spark.createDataFrame(patches, "id int, x double, y double, z double, nx double, ny double, nz double, height double, rmse double, held_out double, poses int")
    accepted = {r["id"] for r in fusion.region_models(df, 10.0).where("accepted").collect()}
    assert accepted == set(range(20)) - {3, 7}
    surfels = fusion.fuse_regions(df, 10.0, 0.5).collect()
    assert sum(r["patches"] for r in surfels) == 18 and all(abs(r["z"]) < 1e-9 and r["nz"] == pytest.approx(1.0) for r in surfels)


def test_coverage_and_selection(spark):
    whole = sheet(spark, noise=0.01).withColumn("confidence", F.lit(0.9))
    hole = (F.col("x").between(5, 7)) & (F.col("y").between(5, 7))
    off = whole.where(hole & (F.col("x") == 6) & (F.col("y") == 6)).withColumn("z", F.lit(2.0))
    df = whole.where(~(hole & (F.col("x") == 6) & (F.col("y") == 6))).unionByName(off)
    out = fusion.gated_coverage(df, whole.where(~hole), 1.0, "confidence", 0.5, 1.6, 0.3)
    assert out.count() == 14 * 14 - 1 and out.where("z > 1").count() == 0
    assert fusion.gated_coverage(df, whole.where(~hole), 1.0, "confidence", 0.95, 1.6, 0.3).count() == 14 * 14 - 9
    judged = whole.withColumns({"heldout_ok": F.col("id") % 2 == 0, "diversity": F.lit(4), "conflict_ratio": F.lit(0.1), "layer_ok": F.lit(True), "poses": F.lit(4), "agreement": F.lit(0.7)})
    kept = fusion.select_patches(judged, 1.0)
    assert kept.count() == 14 * 14


def test_patches_beyond_the_rim(spark):
    got = fusion.missing_patches(sheet(spark, noise=0.0), 2.5, 1.0, least=6).collect()
    rim = {i for i in range(196) if i % 14 in (0, 13) or i // 14 in (0, 13)}
    assert {r["seed"] for r in got} == rim and {r["ring"] for r in got} == {1, 2}
    for r in got:
        assert abs(r["z"]) < 1e-6 and r["nz"] > 0.999 and not (0.01 < r["x"] < 12.99 and 0.01 < r["y"] < 12.99)


def test_axis_and_centre():
    rng = np.random.default_rng(3)
    axis = np.array([0.1, 1.0, -0.08])
    axis /= np.linalg.norm(axis)
    turn, centre = 2 * np.pi / 25, np.array([4.0, 0.0, -3.0])
    faces = [np.array(v, float) / np.linalg.norm(v) for v in ((1, 0.1, 0), (0, 0.2, 1), (-1, 0, 0.3))]
    planes = [(p, rotation(axis, p * turn) @ n, 1.0) for p in range(8) for n in faces] + [(p, (lambda v: v / np.linalg.norm(v))(rng.normal(size=3)), 1.0) for p in range(8)]
    found, agree = alignment.axis_consensus(planes, turn, np.array([0.0, 1.0, 0.0]))
    assert found @ axis > 0.99999 and agree >= 3 * 28
    body = rng.normal(size=(200, 3)) * [20, 30, 12]
    views = {p: (body[rng.random(200) < 0.9] - centre) @ rotation(axis, p * turn).T + centre for p in range(4)}
    at, off = alignment.search_centre(views, turn, axis, np.zeros(3), 8.0, rounds=9)
    across = (at - centre) - axis * ((at - centre) @ axis)
    assert np.linalg.norm(across) < 0.2 and off < 0.5


def test_turntable_is_adjusted():
    rng = np.random.default_rng(5)
    axis, centre, turn = np.array([0.02, 1.0, 0.01]), np.array([1.5, 0.0, -1.0]), 2 * np.pi / 25
    axis /= np.linalg.norm(axis)
    fix = {0: 0.0, 1: 0.004, 2: -0.006, 3: 0.0}
    body, normal = rng.normal(size=(150, 3)) * 30, rng.normal(size=(150, 3))
    normal /= np.linalg.norm(normal, axis=1)[:, None]
    turned = lambda p, v, c: (v - c) @ rotation(axis, p * turn + fix[p]).T + c
    matches = [(p, p + 1, turned(p, body, centre), turned(p + 1, body, centre), turned(p + 1, normal, np.zeros(3))) for p in range(3)]
    a, c, found, left = alignment.adjust_turntable(matches, turn, np.array([0.0, 1.0, 0.0]), np.zeros(3), prior=1e-3, tangential=1.0)
    across = (c - centre) - axis * ((c - centre) @ axis)
    assert left < 1e-2 and a @ axis > 0.999999 and np.linalg.norm(across) < 0.05 and all(abs(found[p] - fix[p]) < 1e-3 for p in fix)
    views = {p: turned(p, rng.normal(size=(250, 3)) * [20, 30, 12] if p < 0 else body, centre) for p in range(4)}
    best, accepted, before, after = alignment.propose_shift(views, turn, axis, np.zeros(3), 4.0)
    assert accepted == (after <= 0.98 * before) and (not accepted or not np.allclose(best, 0))


def test_affine_consensus():
    from quarryline.operators import fitting

    rng = np.random.default_rng(8)
    p = rng.uniform(0, 600, (200, 2))
    dy = p @ [0.002, -0.001] + 0.5 + rng.normal(0, 0.02, 200)
    dy[:60] += rng.uniform(2, 9, 60)
    beta, near = fitting.affine_consensus(p, dy, 0.1)
    assert np.allclose(beta, [0.002, -0.001, 0.5], atol=0.02) and near[60:].mean() > 0.98 and not near[:60].any()
    assert not fitting.affine_consensus(p[:2], dy[:2], 0.1)[1].any()


def test_features_are_rescued(spark):
    rows = [(i, i % 10 * 0.5, i // 10 * 0.5, 0.0, 0.0, 0.0, 1.0) for i in range(100)] + [(100 + i, 0.0, i % 10 * 0.5, 0.5 + i // 10 * 0.5, -1.0, 0.0, 0.0) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, x double, y double, z double, nx double, ny double, nz double")
    seeds = df.where("id in (40, 105, 99)").unionByName(df.where("id = 50").withColumns({"id": F.lit(500), "z": F.lit(0.9)}))
    got = {r["id"]: r for r in fusion.feature_rescue(df, seeds, 0.5).collect()}
    assert got[40]["rescued"] and got[105]["rescued"] and got[40]["families"] == 2
    assert not got[99]["rescued"] and got[99]["families"] == 1  # a flat place needs no rescue
    assert not got[500]["rescued"] and got[500]["residual"] > 0.8


def test_posed_fits():
    from quarryline.operators import fitting

    rng = np.random.default_rng(9)
    uv = rng.uniform(-1, 1, (400, 2))
    n = np.array([0.2, 0.1, 1.0]) / np.linalg.norm([0.2, 0.1, 1.0])
    side = np.linalg.svd(n[None])[2][1:]
    pose = np.r_[np.zeros(340, int), np.arange(60) % 3 + 1]
    p = uv * [3, 1.5] @ side + (0.1 * uv[:, :1] ** 2) * n
    flat, bent = (fitting.posed_fit(p, n, pose, np.ones(400), kind) for kind in ("plane", "quadratic"))
    assert bent["rmse"] < 1e-3 < flat["rmse"] and bent["frame"][2] @ n > 0.99
    assert fitting.posed_fit(p[:2], n, pose[:2], np.ones(2)) == {}
    design = np.stack([uv[:, 0], uv[:, 1], np.ones(400)], 1)
    y = design @ [1.0, 2.0, 3.0]
    y[pose == 3] += 4
    assert fitting.held_out_votes(design, y, pose, np.ones(400), 0.1) == (3, 4)
