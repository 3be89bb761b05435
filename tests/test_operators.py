"""Operators against brute force, known shapes and round trips."""


import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.functions import bitmask, geometry, scalar
from quarryline.operators import contacts, fitting, gates, graph, joins, lineage, mesh, raster, sampling, stats, voxels, windows
from quarryline.plans.campaign import Campaign, Stage
from quarryline.sources import arrays, files
from quarryline.streaming import logs

AXES = ("x", "y", "z")


def cloud(spark, n=200, seed=0):
    p = np.random.default_rng(seed).normal(size=(n, 3))
    return p, spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "id long, x double, y double, z double")


def test_angle_tokens(spark):
    rows = spark.createDataFrame([("a_V001_A0000",), ("a_V002_A0144",), ("a_V003_A0288",), ("a_V025_A3456",), ("a_V9_A45",), ("none",)], "s string")
    got = [tuple(r) for r in rows.select(scalar.angle_token(F.col("s")), scalar.view_index(F.col("s"))).collect()]
    assert got == [(0.0, 0), (14.4, 1), (28.8, 2), (345.6, 24), (45.0, 8), (None, None)]


def test_steps_of_a_turn(spark):
    got = [r[0] for r in spark.range(26).select(scalar.steps_before("id")).collect()]
    assert got[1] == 82 and got[5] == 411 and got[25] == 2055
    assert spark.range(1, 2).select(scalar.physical_angle("id")).first()[0] == pytest.approx(14.364963503649635, abs=1e-12)


def test_key_values(spark):
    got = spark.createDataFrame([("a=1 noise b=x=y c=",)], "s string").select(scalar.key_values(F.col("s"))).first()[0]
    assert got == {"a": "1", "b": "x=y", "c": ""}


def test_masks(spark):
    m = spark.createDataFrame([((1 << 0) | (1 << 24),), ((1 << 0) | (1 << 12),), (0,)], "m long")
    got = [tuple(r) for r in m.select(bitmask.pose_count("m"), bitmask.angular_span("m", 25), bitmask.diversity("m", 25)).collect()]
    assert got == [(2, 1, 1), (2, 12, 2), (0, 0, 0)]


def test_stats_of_nothing_and_nan(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", float("nan")), ("b", None)], "k string, v double")
    got = {r["k"]: r for r in stats.finite_stats(df, ["k"], "v").collect()}
    assert (got["a"]["n"], got["a"]["median"], got["a"]["mad"]) == (2, 2.0, 1.0)
    assert got["b"]["n"] == 0 and got["b"]["median"] is None


def test_quantiles_by_ranges_match_numpy(spark, monkeypatch):
    """Ties, skew, single values and negative numbers, in groups that are cut into ranges."""
    monkeypatch.setattr(stats, "SMALL", 0)
    rng = np.random.default_rng(4)
    groups = {"ties": rng.integers(0, 5, 700), "skew": np.exp(rng.normal(0, 4, 900)), "one": np.array([3.5]), "two": np.array([-1.0, 4.0]), "same": np.full(50, 2.0), "wide": rng.normal(0, 1e9, 333)}
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v] + [("none", None), ("ties", float("inf"))], "k string, v double").repartition(4)
    wanted = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.62, "e": 0.99, "f": 1.0}
    got = {r["k"]: r for r in stats.quantiles(df, ["k"], "v", wanted).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        for n, q in wanted.items():
            assert got[k][n] == pytest.approx(np.quantile(v.astype(float), q), rel=1e-12)
    assert stats.quantiles(df, [], "v", {"m": 0.5}).first()["m"] == pytest.approx(np.median(np.concatenate(list(groups.values())).astype(float)))
    full = {r["k"]: r for r in stats.finite_stats(df, ["k"], "v").collect()}
    assert full["none"]["n"] == 0 and full["none"]["median"] is None
    assert full["skew"]["mad"] == pytest.approx(np.median(np.abs(groups["skew"] - np.median(groups["skew"]))))


def test_ranks_by_ranges(spark):
    from quarryline.operators import sampling

    df = spark.createDataFrame([(i % 3 if i % 7 else None, (i * 37) % 101, i) for i in range(500)], "g int, o int, id int").repartition(5)
    got = sampling.ranked(df, ["g"], [F.col("o"), F.col("id")]).collect()
    by = {}
    for r in got:
        by.setdefault(r["g"], []).append((r["_i"], r["o"], r["id"], r["_n"]))
    for rows in by.values():
        rows.sort()
        assert [x[0] for x in rows] == list(range(len(rows))) and {x[3] for x in rows} == {len(rows)}
        assert [x[1:3] for x in rows] == sorted(x[1:3] for x in rows)


def test_radius_and_nearest(spark):
    p, df = cloud(spark)
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    got = {r["id"]: r["neighbors"] for r in joins.radius_counts(df, 0.5, "id", AXES).collect()}
    assert got == {i: int((d[i] <= 0.5).sum() - 1) for i in range(len(p))}
    near = joins.knn_join(df, df, 3, "id", AXES, skip_self=True).collect()
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j), k + 1) for i in range(len(p)) for k, j in enumerate(np.argsort(d[i])[:3])}
    assert {(r["a_id"], r["b_id"], r["rank"]) for r in near} == want


def test_nearest_of_far_and_empty(spark):
    _, df = cloud(spark, 5)
    far = spark.createDataFrame([(99, 1e3, 0.0, 0.0)], "id long, x double, y double, z double")
    assert joins.knn_join(far, df, 2, "id", AXES).count() == 2
    assert joins.knn_join(df, df.where("false"), 2, "id", AXES).count() == 0
    assert joins.knn_join(df.where("false"), df, 2, "id", AXES).count() == 0


def test_nearest_of_copies_clusters_and_outliers(spark):
    """Copies of one place, a dense cluster, an outlier far away and more probes than are scanned at the end."""
    rng = np.random.default_rng(3)
    p = np.r_[rng.normal(size=(300, 3)), rng.normal(size=(900, 3)) * 1e-4, np.zeros((200, 3)), [[1e6, 0, 0]], rng.normal(size=(20, 3)) * 500]
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double, z double").repartition(4)
    few, joins.FEW = joins.FEW, 8
    try:
        near = joins.knn_join(df, df, 3, "id", AXES, skip_self=True).collect()
    finally:
        joins.FEW = few
    got = {}
    for row in near:
        got.setdefault(row["a_id"], {})[row["rank"]] = (row["distance"], row["b_id"])
    off = p[:, None] - p[None]
    d = np.sqrt(off[..., 0] ** 2 + off[..., 1] ** 2 + off[..., 2] ** 2)
    np.fill_diagonal(d, np.inf)
    for i in range(len(p)):
        assert [got[i][k] for k in (1, 2, 3)] == [(d[i, j], j) for j in np.lexsort((np.arange(len(p)), d[i]))[:3]]


def test_radius_join_cuts_crowded_cells(spark):
    p, df = cloud(spark)
    cell, joins.CELL = joins.CELL, 5
    try:
        got = {(r["a_id"], r["b_id"]) for r in joins.radius_join(df, df, 1.5, "id", AXES).collect()}
    finally:
        joins.CELL = cell
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    assert got == {(i, j) for i, j in np.argwhere(d <= 1.5).tolist()}


def test_components_and_parity(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r["node"]: r["root"] for r in graph.components(e).collect()}
    assert all(got[i] == 0 for i in range(1, 51)) and got[101] == 100
    assert graph.components(e.where("false")).count() == 0
    n = spark.range(3).withColumnRenamed("id", "n")
    ok = spark.createDataFrame([(0, 1, 1), (1, 2, 1), (0, 2, 0)], "u long, v long, flip int")
    labels = {r["n"]: (r["label"], r["conflict"]) for r in graph.parity(n, ok, "n").collect()}
    assert labels[0][0] != labels[1][0] and labels[0][0] == labels[2][0] and not labels[0][1]
    bad = ok.withColumn("flip", F.lit(1))
    assert all(r["conflict"] for r in graph.parity(n, bad, "n").collect())


def octahedron(spark):
    v = [(0, 1, 0, 0), (1, -1, 0, 0), (2, 0, 1, 0), (3, 0, -1, 0), (4, 0, 0, 1), (5, 0, 0, -1)]
    f = [(0, 2, 4), (2, 1, 4), (1, 3, 4), (3, 0, 4), (2, 0, 5), (1, 2, 5), (3, 1, 5), (0, 3, 5)]
    vertices = spark.createDataFrame([(i, float(x), float(y), float(z)) for i, x, y, z in v], "vid long, x double, y double, z double")
    return spark.createDataFrame([(i, *t) for i, t in enumerate(f)], "fid long, a long, b long, c long"), vertices


def test_closed_mesh(spark):
    f, v = octahedron(spark)
    assert tuple(mesh.edge_summary(f).first()) == (12, 0, 0, 0)
    assert mesh.signed_volume(f, v).first()[0] == pytest.approx(4 / 3)
    assert mesh.face_geometry(f, v).agg(F.sum("area")).first()[0] == pytest.approx(4 * np.sqrt(3))
    assert mesh.component_summary(f, v).first()["components"] == 1
    up = {r["vid"]: r for r in mesh.vertex_normals(f, v).collect()}
    assert up[4]["nz"] == pytest.approx(1.0)
    assert {r["category"] for r in contacts.contacts(f, v, 0.7).collect()} <= {"shared_vertex", "shared_edge", "separate"}


def test_open_mesh_has_one_loop(spark):
    f, v = octahedron(spark)
    loops = mesh.boundary_loops(f.where("fid <> 0"), v).collect()
    assert len(loops) == 1 and loops[0]["closed"] and loops[0]["edges"] == 3
    assert loops[0]["perimeter"] == pytest.approx(3 * np.sqrt(2))
    assert mesh.signed_volume(f.where("fid <> 0"), v).first()[0] is None


def test_crossing_triangles():
    a = np.array([[0, 0, 0], [2, 0, 0], [0, 2, 0]], float)
    assert contacts.classify(a, a + [0, 0, 1]) == "separate"
    assert contacts.classify(a, np.array([[0.5, 0.5, -1], [0.5, 0.5, 1], [0.6, 0.4, 1]])) == "crossing"
    assert contacts.classify(a, a[[1, 2, 0]]) == "duplicate"
    assert contacts.classify(a, a * 0.5 + [0.1, 0.1, 0]) == "coplanar_overlap"
    assert contacts.classify(a, np.zeros((3, 3))) == "degenerate"


def test_pairs_by_arrays_are_the_same():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(600, 3, 3)), rng.normal(size=(600, 3, 3))
    b[:100, 0] = a[:100, 1]
    b[100:150, :2] = a[100:150, 1:]
    b[150:200, :, 2] = a[150:200, :, 2] = 0
    b[200:210] = a[200:210]
    b[210:220, 2] = b[210:220, 1]
    assert contacts.classify_all(a, b) == [contacts.classify(x, y) for x, y in zip(a, b, strict=True)]


def test_clean_merges(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 0.0), (4, 9.0, 9.0, 9.0)], "vid long, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 1, 2), (1, 3, 1, 2), (2, 0, 3, 1)], "fid long, a long, b long, c long")
    faces, vertices = mesh.clean(f, v)
    assert [r["fid"] for r in faces.collect()] == [0] and vertices.count() == 3


def test_plane_and_quadratic(spark):
    rng = np.random.default_rng(1)
    p = np.c_[rng.uniform(-1, 1, (300, 2)), np.zeros(300)]
    p[:, 2] = 0.2 * p[:, 0] - 0.1 * p[:, 1] + 3
    p[:30, 2] += rng.uniform(1, 5, 30)
    n, d, near = fitting.ransac_plane(p, 0.01)
    assert near.sum() == 270 and np.allclose(n / n[2], [-0.2, 0.1, 1], atol=1e-6)
    z = fitting.quadratic_design(p[:, 0], p[:, 1]) @ np.array([1, 2, 0.5, -1, 0, 4.0])
    assert np.allclose(fitting.irls(fitting.quadratic_design(p[:, 0], p[:, 1]), z, np.ones(300)), [1, 2, 0.5, -1, 0, 4], atol=1e-6)
    assert np.allclose(fitting.smallest_rectangle(np.array([[0, 0], [2, 0], [2, 1], [0, 1]], float)), (2, 1))
    x = fitting.damped_least_squares(lambda q: q - [1.0, 5.0], np.zeros(2), (np.array([-2.0, -2.0]), np.array([2.0, 2.0])))
    assert np.allclose(x, [1, 2], atol=1e-6)


def test_transform_moves_and_turns(spark):
    _, df = cloud(spark, 10)
    poses = geometry.poses_table(spark, {0: geometry.about_line((0, 0, 1), (1, 0, 0), np.pi)})
    got = geometry.transform(df.withColumn("pose_index", F.lit(0)), poses).orderBy("id").collect()
    want = df.orderBy("id").collect()
    assert all(g["x"] == pytest.approx(2 - w["x"]) and g["z"] == pytest.approx(w["z"]) for g, w in zip(got, want, strict=True))
    with pytest.raises(ValueError):
        geometry.rotation((0, 0, 0), 1.0)


def test_voxel_fusion_keeps_mask(spark):
    df = spark.createDataFrame([(0.1, 0.1, 0.1, 0, 5.0), (0.3, 0.1, 0.1, 1, 0.5), (-0.1, 0.0, 0.0, 2, 1.0)], "x double, y double, z double, pose int, w double")
    got = {r["kx"]: r for r in voxels.fuse(df, AXES, 1.0, "pose", "w").collect()}
    assert got[0]["mask"] == 3 and got[0]["x"] == pytest.approx((1.0 * 0.1 + 0.5 * 0.3) / 1.5) and got[-1]["mask"] == 4


def test_samples_are_stable(spark):
    df = spark.range(1000).withColumn("w", F.col("id") % 7 + 1.0)
    a = sampling.weighted_sample(df, 50, "w", "id")
    b = sampling.weighted_sample(df.repartition(7), 50, "w", "id")
    assert {r["id"] for r in a.collect()} == {r["id"] for r in b.collect()} and a.count() == 50
    conflicts = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "b"), ("q", "c")], "conflict string, member string")
    cost = spark.createDataFrame([(m, 1.0) for m in "abc"], "member string, cost double")
    assert [r["member"] for r in sampling.greedy_cover(conflicts, cost).collect()] == ["b"]


def test_gates(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 15.0), (3, None)], "k int, v double")
    out = {r["k"]: r["verdict"] for r in gates.ladder(df, [("high", F.col("v") > 10)], [("low", F.col("v") > 4)]).collect()}
    assert out == {1: "warning", 2: "rejected", 3: "accepted"}
    passed = {r["k"]: r["passed"] for r in gates.all_passed(gates.gate_rows(df, ["k"], [("v", "v", "<=", 10)]), ["k"]).collect()}
    assert passed == {1: True, 2: False, 3: False}


def test_circular_wraps(spark):
    df = spark.createDataFrame([(i, 1.0 if i else 50.0) for i in range(10)], "s int, v double")
    got = {r["s"]: r["outlier"] for r in windows.circular_outliers(df, "s", "v", 10, 2, 3.0, 0.5).collect()}
    assert got[0] and not got[9] and not got[5]


def test_array_files(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(6.0).reshape(2, 3))
    got = arrays.read_npy(spark, str(tmp_path)).orderBy("index").collect()
    assert [r["value"] for r in got] == list(range(6)) and got[0]["shape"] == [2, 3]
    np.savez(tmp_path / "b.npz", x=np.arange(3.0), label=np.array([1, 2, 3]), odd=np.arange(5))
    rows = arrays.read_npz(spark, str(tmp_path), "x double, label int, odd double, missing double", {"missing": 7.0}).orderBy("row_id").collect()
    assert [(r["x"], r["label"], r["odd"], r["missing"]) for r in rows] == [(0.0, 1, None, 7.0), (1.0, 2, None, 7.0), (2.0, 3, None, 7.0)]


@pytest.mark.parametrize("form", ["ascii", "binary_little_endian", "binary_big_endian"])
def test_ply(spark, tmp_path, form):
    head = f"ply\nformat {form} 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n".encode()
    p, ring = np.array([[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 0.5]], "f4"), [0, 1, 2, 3]
    order = ">" if "big" in form else "<"
    body = ("\n".join(" ".join(map(str, r)) for r in p) + "\n4 0 1 2 3\n").encode() if form == "ascii" else p.astype(order + "f4").tobytes() + bytes([4]) + np.array(ring, order + "i4").tobytes()
    (tmp_path / "m.ply").write_bytes(head + body)
    v = arrays.read_ply_vertices(spark, str(tmp_path)).orderBy("vid").collect()
    assert [(r["x"], r["y"], r["z"]) for r in v] == [tuple(map(float, r)) for r in p] and v[0]["nx"] is None
    f = mesh.fan(arrays.read_ply_faces(spark, str(tmp_path)), "fid", "ring").orderBy("i").collect()
    assert [(r["a"], r["b"], r["c"]) for r in f] == [(0, 1, 2), (0, 2, 3)]


def test_written_ply_reads_back(spark, tmp_path):
    f, v = octahedron(spark)
    arrays.write_ply(v, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert arrays.parse_ply(text.encode())["vertex"]["z"][5] == -1.0
    arrays.write_obj(v, f, str(tmp_path / "obj"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "obj").glob("part-*"))).splitlines()
    assert lines[0] == "v 1.000000000 0.000000000 0.000000000" and lines[6] == "f 1 3 5"


def test_matrix_yaml():
    text = "%YAML:1.0\nP1: !!opencv-matrix\n   rows: 2\n   cols: 2\n   dt: d\n   data: [1., 2., 3., 4.]\n"
    assert arrays.matrix_yaml(text, "P1").tolist() == [[1, 2], [3, 4]]


def test_captures(spark):
    paths = [(f"/c/S0{s}/{side}/o_V{v + 1:03d}_A{round(v * 144):04d}.png",) for s in (1, 2) for v in range(25) for side in ("left", "right") if not (s == 2 and v == 3 and side == "right")]
    c = files.pair_captures(spark.createDataFrame(paths, "path string"))
    got = {r["session"]: r["reasons"] for r in files.capture_problems(c).collect()}
    assert got["S01"] == [] and "count" in got["S02"]
    groups = {r["pose_index"]: r["independent_observations"] for r in files.pose_groups(c).collect()}
    assert groups[0] == 2 and groups[3] == 1


def test_raster_kernels():
    rng = np.random.default_rng(0)
    img = rng.uniform(0, 255, (20, 30))
    y, x = np.indices(img.shape, dtype=float)
    assert np.allclose(raster.remap(img, x, y), img)
    flat = raster.local_deviation(np.full((9, 9), 5.0), 3)
    assert np.allclose(flat, 0)
    valid = rng.random(img.shape) > 0.3
    s = raster.smooth_valid(np.full(img.shape, 7.0), valid, 5)
    assert np.allclose(s[valid], 7.0) and np.isnan(s[~valid]).all()
    m = np.zeros((6, 6), bool)
    m[0, 0] = m[1, 1] = m[4, 4] = True
    assert raster.label(m).max() == 2 and raster.label(m, diagonal=False).max() == 3
    ring = np.zeros((5, 5), bool)
    ring[1:4, 1:4] = True
    ring[2, 2] = False
    assert raster.fill_holes(ring, 1)[2, 2] and not raster.fill_holes(ring, 0)[2, 2]
    assert raster.equalise(img).shape == img.shape
    assert raster.bounding_box(ring) == (1, 1, 4, 4) and raster.bounding_box(ring & False) is None
    assert len(np.unique(raster.superpixels(img, 5))) > 4


def test_per_tile(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], 2, 2), (None, 2, 2)], "t array<double>, h int, w int")
    got = raster.per_tile(df, lambda a: a * 2, "t", "h", "w", "o").collect()
    assert got[0]["o"] == [2.0, 4.0, 6.0, 8.0] and got[1]["o"] is None


def test_lineage(spark):
    rows = spark.createDataFrame([("a", "h1", 1), ("b", "h2", 2)], "path string, sha256 string, size_bytes long")
    one = lineage.digest_of(rows, []).first()["digest"]
    assert one == lineage.digest_of(rows.orderBy(F.desc("path")), []).first()["digest"]
    now = spark.createDataFrame([("a", "hX", 1)], "path string, sha256 string, size_bytes long")
    assert {r["path"]: r["state"] for r in lineage.drift(rows, now).collect()} == {"a": "content_changed", "b": "missing"}


def test_campaign_reuse(spark, tmp_path):
    ran = []

    def stage(name, parameters):
        return Stage(name, lambda t: (ran.append(name), spark.range(3))[1], parameters)

    c = Campaign(spark, str(tmp_path / "c"))
    assert [r[2] for r in c.run([stage("one", {}), stage("two", {})])] == [False, False]
    assert [r[2] for r in c.run([stage("one", {}), stage("two", {})])] == [True, True]
    assert [r[2] for r in c.run([stage("one", {"k": 1}), stage("two", {})])] == [False, False]
    stopped = c.run([Stage("one", lambda t: spark.range(1), {"k": 2}, lambda df: "rejected"), stage("two", {})])
    assert [r[0] for r in stopped] == ["one"] and ran.count("two") == 2


def test_streamed_log(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = logs.event_stream(spark, str(tmp_path / "in"))
    logs.append_log(stream, str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == src.count()
    q = logs.windowed_counts(stream).writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").agg(F.sum("n")).first()[0] == src.count()


def test_numpy_median_and_percentile(spark):
    v = np.random.default_rng(0).normal(size=101)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    assert df.select(stats.percentile("v", 0.37)).first()[0] == pytest.approx(np.percentile(v, 37))


def test_large_groups_are_fitted_by_sums(spark, monkeypatch):
    rng = np.random.default_rng(6)
    u, v = rng.normal(size=(2, 400))
    y = 0.5 * u * u - v * v + 0.3 * u * v + u - 2 * v + 4 + rng.normal(0, 0.05, 400)
    y[:30] += 9
    df = spark.createDataFrame([(i % 2, i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(u, v, y, strict=True))], "k int, i int, u double, v double, y double").repartition(3)
    one = {r["k"]: r for r in fitting.quadratic_per_group(df, ["k"], "u", "v", "y", "i", rounds=4).collect()}
    monkeypatch.setattr(fitting, "LARGE", 0)
    two = {r["k"]: r for r in fitting.quadratic_per_group(df, ["k"], "u", "v", "y", "i", rounds=4).collect()}
    for k in (0, 1):
        assert [two[k][c] for c in [*"abcdef", "rmse"]] == pytest.approx([one[k][c] for c in [*"abcdef", "rmse"]], rel=1e-6)


def test_planes_of_groups(spark):
    rng = np.random.default_rng(7)
    n = np.array([[0.0, 0.6, 0.8], [1.0, 0.0, 0.0]])
    rows = []
    for k in (0, 1):
        side = np.linalg.svd(n[k : k + 1])[2][1:]
        p = rng.normal(size=(300, 2)) @ side + n[k] * (k + 1) + rng.normal(0, 0.005, (300, 1)) * n[k]
        p[:80] += rng.normal(0, 3, (80, 3))
        rows += [(k, i, *map(float, x)) for i, x in enumerate(p)]
    df = spark.createDataFrame([*rows, (2, 0, 0.0, 0.0, 0.0), (2, 1, 1.0, 1.0, 1.0)], "k int, i int, x double, y double, z double")
    got = {r["k"]: r for r in fitting.plane_per_group(df, ["k"], AXES, "i", 0.03).collect()}
    assert set(got) == {0, 1}
    for k, r in got.items():
        assert abs(np.array([r["nx"], r["ny"], r["nz"]]) @ n[k]) > 0.9999 and abs(r["d"] - (k + 1)) < 0.01 and r["inliers"] >= 215 and r["rmse"] < 0.015
