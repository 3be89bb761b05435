"""Surface, mesh repair and distance operators on small shapes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.operators import graph, mesh, surface

AXES = ("x", "y", "z")
POINT = "id long, x double, y double, z double, nx double, ny double, nz double, w double, pose int"


def sheet(spark, n=12, noise=0.0, z=0.0, first=0):
    rng = np.random.default_rng(0)
    rows = [(first + i * n + j, float(i), float(j), float(z + noise * rng.normal()), 0.0, 0.0, 1.0, 1.0, (i + j) % 5) for i in range(n) for j in range(n)]
    return spark.createDataFrame(rows, POINT)


def test_layers_have_seeds_of_their_own(spark):
    two = sheet(spark, 4).unionByName(sheet(spark, 4, z=4.0, first=100))
    seeds = surface.surface_seeds(two, 10.0, 30.0, 1.0, "w").select("seed").distinct()
    assert seeds.count() == 2


def test_smoothing_flattens(spark):
    s = sheet(spark, noise=0.1)
    before = s.agg(F.stddev("z")).first()[0]
    after = surface.smooth(s, 2.5, "w").agg(F.stddev("z")).first()[0]
    assert after < 0.8 * before
    assert surface.local_residual(s, 2.5, "w").where("residual is null").count() == 0


def test_clusters_and_cleaning(spark):
    far = spark.createDataFrame([(900, 50.0, 50.0, 50.0, 0.0, 0.0, 1.0, 1.0, 0)], POINT)
    two = sheet(spark, 6).unionByName(sheet(spark, 6, z=20.0, first=200)).unionByName(far)
    c = surface.clusters(two, 1.5, 3).collect()
    assert len({r["cluster"] for r in c if r["cluster"] is not None}) == 2 and [r["id"] for r in c if r["cluster"] is None] == [900]
    kept = surface.clean_cloud(two, "w", k=4, factor=2.0, radius=1.5, least=2, cluster_points=3)
    assert kept.where("id = 900").count() == 0 and kept.count() == 72


def test_selection_classes(spark):
    df = sheet(spark, 6).withColumn("confidence", F.when(F.col("x") < 4, 0.9).otherwise(0.3)).withColumn("support", F.when(F.col("y") < 5, 3).otherwise(1))
    got = {r["class"]: r["n"] for r in surface.hierarchical_selection(df, [0.5, 0.8], "confidence", "support", 1.1).groupBy("class").agg(F.count("*").alias("n")).collect()}
    assert got == {3: 20, 2: 5, 1: 5, 0: 6}
    patches = surface.independent_patches(sheet(spark, 4).unionByName(sheet(spark, 4, z=9.0, first=50)), 1.5, 40.0, 4)
    assert patches.select("patch").distinct().count() == 2


def test_patches_and_guard(spark):
    s = sheet(spark, 8)
    fit = surface.local_patches(s, s.where("id = 27"), 3.0).first()
    assert abs(fit["height"]) < 1e-6 and fit["rmse"] < 1e-6 and fit["poses"] == 5
    share, _ = surface.scale_guard(s, s.withColumns({"x": F.col("x") * 0.5, "y": F.col("y") * 0.5}), 0.9, 6)
    assert 0.1 < share < 0.21


def test_pixel_hysteresis(spark):
    weak = spark.createDataFrame([(0, 0), (1, 0), (5, 5), (6, 6)], "u int, v int")
    got = surface.pixel_hysteresis(weak, spark.createDataFrame([(1, 0)], "u int, v int"))
    assert {(r["u"], r["v"]) for r in got.collect()} == {(0, 0), (1, 0)}


def test_visual_evidence(spark):
    df = spark.createDataFrame([(0, 0.1, 0.1, 0.1, 0.1, True), (1, -8.0, 0.0, 0.0, 0.0, False), (2, 0.0, 30.0, 0.0, 9.0, False)], "p int, dl double, da double, db double, dgrad double, stable boolean")
    scales = surface.noise_scales(df, {"dl": 2.0, "da": 1.5, "db": 1.5, "dgrad": 4.0}, "stable")
    got = {r["p"]: (r["shadow"], r["strong"]) for r in surface.visual_evidence(df, scales).collect()}
    assert got == {0: (False, False), 1: (True, False), 2: (False, True)}


def strip(spark):
    v = spark.createDataFrame([(i, float(i // 2), float(i % 2), 0.0) for i in range(8)], "vid long, x double, y double, z double")
    f = spark.createDataFrame([(i, i, i + 1, i + 2) if i % 2 == 0 else (i, i + 1, i, i + 2) for i in range(6)], "fid long, a long, b long, c long")
    return f, v


def test_bow_tie_splits(spark):
    v = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(5)], "vid long, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 1, 2), (1, 2, 3, 4)], "fid long, a long, b long, c long")
    faces, vertices = mesh.split_fans(f, v)
    assert vertices.count() == 6 and not ({0, 1, 2} & {x for r in faces.where("fid = 1").collect() for x in (r["a"], r["b"], r["c"])})
    same_f, same_v = mesh.split_fans(*strip(spark))
    assert same_v.count() == 8 and same_f.count() == 6


def test_orientation_is_repaired(spark):
    f, v = strip(spark)
    turned = f.select("fid", "a", F.when(F.col("fid") == 2, F.col("c")).otherwise(F.col("b")).alias("b"), F.when(F.col("fid") == 2, F.col("b")).otherwise(F.col("c")).alias("c"))
    assert mesh.edge_summary(turned).first()["misoriented"] > 0
    evidence = v.select("vid", F.lit(1.0).alias("evidence"))
    fixed = mesh.repair_orientation(turned, v, evidence)
    assert fixed.count() == 6 and mesh.edge_summary(fixed).first()["misoriented"] == 0


def test_moebius_is_over_budget(spark):
    n = 9
    v = spark.createDataFrame([(i, float(np.cos(i)), float(np.sin(i)), float(i % 2)) for i in range(n)], "vid long, x double, y double, z double")
    f = spark.createDataFrame([(i, i, (i + 1) % n, (i + 2) % n) for i in range(n)], "fid long, a long, b long, c long")
    assert graph.parity(f, mesh.face_pairs(f), "fid").where("conflict").count() == n
    with pytest.raises(ValueError):
        mesh.repair_orientation(f, v, v.select("vid", F.lit(1.0).alias("evidence")), budget=0.01)


def test_rim_is_one_ordered_loop(spark):
    f, v = strip(spark)
    loops = mesh.ordered_loops(f, v).collect()
    assert len(loops) == 1 and len(loops[0]["ring"]) == 8


def test_distances_and_samples(spark):
    f, v = strip(spark)
    p = spark.createDataFrame([(0, 1.0, 0.5, 0.25), (1, -0.3, 0.0, 0.4), (2, 9.0, 9.0, 9.0)], "id long, x double, y double, z double")
    got = {r["id"]: r["distance"] for r in mesh.point_to_mesh(p, f, v, 1.0).collect()}
    assert got[0] == pytest.approx(0.25) and got[1] == pytest.approx(0.5) and got[2] is None
    s = mesh.sample_surface(f, v, 600)
    assert 560 < s.count() < 640 and s.where("x < 0 or x > 3 or y < 0 or y > 1").count() == 0


def test_spike_goes_back(spark):
    n = 7
    v = spark.createDataFrame([(i * n + j, float(i), float(j), 2.0 if (i, j) == (3, 3) else 0.001 * ((i * 7 + j * 3) % 5)) for i in range(n) for j in range(n)], "vid long, x double, y double, z double")
    quads = [(i * n + j, i * n + j + 1, (i + 1) * n + j, (i + 1) * n + j + 1) for i in range(n - 1) for j in range(n - 1)]
    f = spark.createDataFrame([t for k, (a, b, c, d) in enumerate(quads) for t in ((2 * k, a, c, b), (2 * k + 1, b, c, d))], "fid long, a long, b long, c long")
    after = {r["vid"]: r["z"] for r in mesh.despike(f, v, most=5.0).collect()}
    assert after[3 * n + 3] < 1.0 and abs(after[0]) < 0.1
    kept = mesh.guarded(v, v.withColumn("x", F.col("x") * 1.5), f, 0.01)
    assert kept.agg(F.max("x") - F.min("x")).first()[0] == pytest.approx(6.06, abs=0.02)
    assert mesh.clip_below(f.where("fid < 4"), v, 1.0).count() == 2 and mesh.retract_rim(f, v.where("vid = 0").select("vid"), 3).count() == 71


def test_signs_agree(spark):
    rng = np.random.default_rng(0)
    p = rng.normal(size=(150, 3))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    s = rng.choice([-1.0, 1.0], 150)
    df = spark.createDataFrame([(i, *map(float, q), *map(float, q * t), 1.0, 0) for i, (q, t) in enumerate(zip(p, s, strict=True))], POINT)
    out = surface.orient_normals(df)
    assert out.count() == 150 and out.where("x * nx + y * ny + z * nz > 0").count() >= 135


def test_coherence_of_a_sheet_and_a_stray(spark):
    s = sheet(spark, 8).withColumn("uncertainty", F.lit(0.2))
    stray = s.where("id = 27").withColumns({"id": F.lit(999).cast("long"), "z": F.lit(4.0), "nx": F.lit(1.0), "nz": F.lit(0.0)})
    whole = s.unionByName(stray)
    got = {r["id"]: r for r in surface.coherence(whole, whole.where("id in (36, 999)"), 1.0).collect()}
    assert got[36]["accept"] and got[36]["strict"] and got[999]["flags"] >= 2 and not got[999]["strict"]


def test_fairing_pulls_a_bump_back(spark):
    n = 7
    v = spark.createDataFrame([(i * n + j, float(i), float(j), 0.6 if (i, j) == (3, 3) else 0.001 * ((i * 7 + j * 3) % 5)) for i in range(n) for j in range(n)], "vid long, x double, y double, z double")
    f = spark.createDataFrame([t for k, (i, j) in enumerate((i, j) for i in range(n - 1) for j in range(n - 1)) for t in ((2 * k, i * n + j, (i + 1) * n + j, i * n + j + 1), (2 * k + 1, i * n + j + 1, (i + 1) * n + j, (i + 1) * n + j + 1))], "fid long, a long, b long, c long")
    after = {r["vid"]: r["z"] for r in mesh.fair(f, v, v, 1.0).collect()}
    assert 0.49 < after[3 * n + 3] < 0.55 and after[0] == pytest.approx(0.0, abs=1e-9)


def test_change_mask():
    from quarryline.operators import raster

    rng = np.random.default_rng(0)
    gray = rng.uniform(0, 3, (60, 60))
    gray[20:40, 20:40] += 60
    ok = np.ones((60, 60), bool)
    mask, limit = raster.change_mask(np.stack([gray] * 3), gray, ok, ok, least_area=50)
    assert mask[25:35, 25:35].all() and not mask[:10].any() and limit >= 12
    assert raster.ellipse(5).sum() == 17 and (raster.opening(ok, raster.ellipse(5)) == ok).all()


def test_trend_and_recovery(spark):
    from quarryline.operators import raster

    n = 12
    v = spark.createDataFrame([(i * n + j, float(i), float(j), 0.8 if (i, j) == (6, 6) else 0.0) for i in range(n) for j in range(n)], "vid long, x double, y double, z double")
    f = spark.createDataFrame([t for k, (i, j) in enumerate((i, j) for i in range(n - 1) for j in range(n - 1)) for t in ((2 * k, i * n + j, (i + 1) * n + j, i * n + j + 1), (2 * k + 1, i * n + j + 1, (i + 1) * n + j, (i + 1) * n + j + 1))], "fid long, a long, b long, c long")
    after = {r["vid"]: r["z"] for r in mesh.scale_trend(f, v, 1.0, small=2.0, large=4.0, angle_deg=80.0).collect()}
    assert after[6 * n + 6] <= 0.8 and after[0] == 0.0 and len(after) == n * n
    depth = np.full((40, 40), 500.0)
    depth[10:20, 10:20] = 450.0
    seed = np.zeros((40, 40), bool)
    seed[10:20, 10:16] = True
    ok = np.ones((40, 40), bool)
    got, said = raster.before_support(seed, depth, ok, ok, ok & (depth > 490), most_added=1.0)
    assert said == "applied" and got[10:20, 10:20].all() and got.sum() == 100
    assert raster.before_support(seed, depth, ok, ok, ok & (depth > 490), most_added=0.1)[0].sum() == 60


def test_axis_guard_and_coverage(spark):
    from quarryline.functions.geometry import rotation
    from quarryline.operators import alignment, contacts, raster

    rng = np.random.default_rng(0)
    axis, centre = np.array([0.05, 1.0, -0.03]), np.array([3.0, 0.0, -2.0])
    axis /= np.linalg.norm(axis)
    p = rng.normal(size=(60, 3)) * 20
    t = rng.choice([0.25, 0.5], 60)
    q = np.array([rotation(axis, a) @ (x - centre) + centre for x, a in zip(p, t, strict=True)])
    a, c, rms = alignment.fit_turn_axis(p, q, t, np.array([0.0, 1.0, 0.0]), np.zeros(3))
    assert rms < 1e-5 and np.allclose(a, axis, atol=1e-6) and np.linalg.norm(np.cross(c - centre, axis)) < 1e-4
    pairs = spark.createDataFrame([(i, 1.0 + i / 10) for i in range(5)], "pair int, rmse double")
    assert alignment.worth_applying(pairs, pairs.withColumn("rmse", F.col("rmse") * 0.9)) and not alignment.worth_applying(pairs, pairs)

    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 2.0, 0.0, 0.0), (2, 0.0, 2.0, 0.0), (3, 0.5, 0.5, 1.0), (4, 0.6, 0.4, 2.0), (5, 0.4, 0.6, 2.0)], "vid long, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 1, 2), (1, 3, 4, 5)], "fid long, a long, b long, c long")
    moved = v.withColumn("z", F.when(F.col("vid") == 3, -1.0).otherwise(F.col("z")))
    safe = {r["vid"]: r["z"] for r in contacts.intersection_guard(v, moved, f, 1.0).collect()}
    assert safe[3] == 1.0
    assert {r["vid"]: r["z"] for r in contacts.intersection_guard(v, v.withColumn("z", F.col("z") + 1), f, 1.0).collect()}[3] == 2.0

    s = sheet(spark, 6).withColumn("confidence", F.lit(0.9))
    kept = s.where("x < 3")
    assert surface.recover_coverage(s, kept, 1.0, "confidence", 0.5, 1.1).count() == 24

    line = np.ones((1, 9), bool)
    seeds = np.zeros((1, 9), bool)
    seeds[0, 0] = True
    assert np.allclose(raster.geodesic(seeds, np.ones((1, 9)), line)[0], range(9))
    got = raster.contact_recovery(seeds, line & ~seeds & (np.arange(9) < 8)[None], (np.arange(9) == 8)[None], np.full((1, 9), 0.5))
    assert got[0, 1] and not got[0, 7]


def test_sizes_of_solids():
    from quarryline.operators import fitting

    rng = np.random.default_rng(2)
    turn = rng.uniform(0, 2 * np.pi, 4000)
    wall = np.c_[40 + 25 * np.cos(turn), rng.uniform(0, 80, 4000), -10 + 25 * np.sin(turn)]
    wall[:120, [0, 2]] *= 3  # stray points
    wall[-1, 1], wall[-2, 1] = 0.0, 80.0
    got = fitting.dimensions(wall, "cylinder")
    assert got["height"] == 80.0 and abs(got["diameter"] - 50) < 0.3 and abs(2 * fitting.circle(wall[:, [0, 2]])[2] - 50) > 1
    corners, tip = np.array([[0, 0, 0], [60, 0, 0], [30, 0, 52.0]]), np.array([30, 70.0, 17.3])
    w = rng.dirichlet(np.ones(3), 6000)
    faces = [w[:1500] @ corners, *(w[1500 * k : 1500 * (k + 1)] @ np.array([corners[k - 1], corners[k % 3], tip]) for k in (1, 2, 3))]
    sizes = fitting.dimensions(np.concatenate([*faces, corners, np.repeat(tip[None], 50, 0)]), "pyramid")
    assert abs(sizes["side"] - 60) < 1.5 and abs(sizes["edge"] - np.mean(np.linalg.norm(corners - tip, axis=1))) < 3
    assert fitting.dimensions(rng.uniform(0, 50, (500, 3)), "pyramid") == {}
    box = fitting.dimensions(np.array([[x, y, z] for x in (0, 30.0) for y in (0, 9.0) for z in (0, 20.0)]), "cube")
    assert box == {"height": 9.0, "width": 30.0, "depth": 20.0}


def test_edge_structure(spark):
    from quarryline.operators import mesh

    # a roof: two flat quads of two triangles each that meet at 90 degrees
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 0.0, 2.0, 0.0), (2, 1.0, 0.0, 1.0), (3, 1.0, 2.0, 1.0), (4, 2.0, 0.0, 0.0), (5, 2.0, 2.0, 0.0), (6, 9.0, 9.0, 9.0)], "vid long, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 2, 1), (1, 1, 2, 3), (2, 2, 4, 3), (3, 3, 4, 5)], "fid long, a long, b long, c long")
    e, w = mesh.edge_structure(f, v)
    edges = {(r["lo"], r["hi"]): (round(r["dihedral"], 4), round(r["weight"], 6), r["rim"]) for r in e.collect()}
    assert edges[2, 3] == (90.0, 0.08, False) and edges[1, 2] == (0.0, 1.0, False) and edges[0, 1] == (180.0, 0.0, True) and len(edges) == 9
    assert {r["vid"]: r["strength"] for r in w.collect()} == {**{i: 0.0 for i in range(6)}, 6: 1.0}


def test_turntable_and_silhouette():
    from quarryline.operators import raster

    rng = np.random.default_rng(0)
    y, x = np.indices((120, 160))
    disc = ((x - 80) / 45) ** 2 + ((y - 85) / 18) ** 2 <= 1
    gray = np.where(disc, 150.0, 60.0) + rng.normal(0, 1, disc.shape)
    valid = np.ones(disc.shape, bool)
    depth = np.where(disc, 500.0, 900.0)
    mask, found = raster.support_mask(gray, valid, depth)
    assert found["status"] == "detected" and (mask & disc).sum() / (mask | disc).sum() > 0.9 and abs(found["ellipse"][0] - 80) < 1
    assert raster.support_mask(np.full(disc.shape, 60.0) + rng.normal(0, 1, disc.shape), valid)[1]["status"] == "not detected"
    scene = np.repeat(gray[..., None], 3, 2)
    thing = (np.abs(x - 80) < 14) & (y > 30) & (y < 84)
    shadow = disc & (np.abs(x - 110) < 8)
    picture = scene + thing[..., None] * 70.0 - (shadow & ~thing)[..., None] * 9.0
    got, how = raster.silhouette(picture, scene, valid, disc)
    assert (got & thing).sum() / (got | thing).sum() > 0.85 and not (got & shadow).any() and how["verdict"] == "accepted"
    empty, how = raster.silhouette(scene, scene, valid, disc)
    assert not empty.any() and how["verdict"] == "rejected"
