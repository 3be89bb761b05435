"""Closing loops, frames, and file housekeeping."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.operators import alignment, closing, lineage, mesh
from quarryline.sources import arrays


def test_ear_clip_covers_area():
    p = np.array([[0, 0], [4, 0], [4, 4], [2, 1], [0, 4]], float)
    tri = closing.ear_clip(p)
    area = lambda q: 0.5 * abs(sum(q[i - 1][0] * q[i][1] - q[i - 1][1] * q[i][0] for i in range(len(q))))
    assert len(tri) == 3 and sum(area(p[list(t)]) for t in tri) == pytest.approx(area(p))


def test_open_box_is_closed(spark):
    v = spark.createDataFrame([(i, float(i & 1), float(i >> 1 & 1), float(i >> 2)) for i in range(8)], "vid long, x double, y double, z double")
    quads = [(0, 2, 3, 1), (0, 1, 5, 4), (1, 3, 7, 5), (3, 2, 6, 7), (2, 0, 4, 6)]  # no top
    f = spark.createDataFrame([t for k, (a, b, c, d) in enumerate(quads) for t in ((2 * k, a, b, c), (2 * k + 1, a, c, d))], "fid long, a long, b long, c long")
    whole = closing.fill_loops(f, v, 8, 0.01)
    assert tuple(mesh.edge_summary(whole).first()) == (18, 0, 0, 0)
    assert abs(mesh.signed_volume(whole, v).first()[0]) == pytest.approx(1.0)
    assert closing.fill_loops(f, v, 3, 0.01).count() == f.count()


def test_frame_and_faces(spark):
    t = np.radians([20, 110, 200, 290, 65])
    n = np.c_[np.cos(t), np.zeros(5), np.sin(t)]
    got = alignment.frame_angle(n, np.array([1, 1, 1, 1, 0.1]), np.array([0.0, 1.0, 0.0]))
    assert min(got % 90, 90 - got % 90) == pytest.approx(20, abs=1) or got == pytest.approx(70, abs=1)
    df = spark.createDataFrame([(float(x), 1.0) for x in [*np.linspace(-0.1, 0.1, 21), *np.linspace(9.9, 10.1, 21)]], "x double, w double")
    faces = {r["face"]: r for r in alignment.face_compactness(df, "x", "w").collect()}
    assert faces[0]["center"] == pytest.approx(0.0, abs=0.02) and faces[1]["center"] == pytest.approx(10.0, abs=0.02) and faces[1]["p90"] <= 0.1
    assert alignment.face_compactness(df.where("false"), "x", "w").count() == 0


def test_axis_from_normals():
    rng = np.random.default_rng(0)
    n = rng.normal(size=(30, 3))
    c, s = np.cos(0.3), np.sin(0.3)
    turn = np.array([[c, 0, s], [0, 1, 0], [-s, 0, c]])
    axis = alignment.axis_from_normals(np.stack([n, n @ turn.T], 1), np.ones(30))
    assert abs(axis[1]) == pytest.approx(1.0)


def test_freeze_drift_and_compact(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.txt").write_text("one")
    frozen = lineage.freeze(spark, {"model": f"file://{tmp_path}/src/a.txt"}, f"file://{tmp_path}/kept")
    rows = frozen.drop("resource").collect()
    recorded = spark.createDataFrame(rows, frozen.drop("resource").schema)
    now = lineage.file_manifest(spark, f"file://{tmp_path}/kept")
    assert [r["state"] for r in lineage.drift(recorded, now).collect()] == ["same"]
    assert lineage.without_self(recorded, now, "nothing").count() == 1
    (tmp_path / "kept" / "model").write_text("two")
    (tmp_path / "kept" / ".model.crc").unlink(missing_ok=True)
    assert [r["state"] for r in lineage.drift(recorded, lineage.file_manifest(spark, f"file://{tmp_path}/kept")).collect()] == ["content_changed"]
    assert [n for _, n in lineage.compact(spark, f"file://{tmp_path}/src", ["b.txt"])] == [3]
    lineage.compact(spark, f"file://{tmp_path}/src", [], dry_run=False)
    assert not (tmp_path / "src" / "a.txt").exists()
    arrays.write_mtl(spark, f"file://{tmp_path}/m.mtl")
    assert spark.read.text(f"file://{tmp_path}/m.mtl").where(F.col("value").startswith("newmtl")).count() == 1


def test_promotion_keeps_a_backup(spark, tmp_path):
    (tmp_path / "new.json").write_text("2")
    (tmp_path / "active.json").write_text("1")
    backup = lineage.promote(spark, f"file://{tmp_path}/new.json", f"file://{tmp_path}/active.json", f"file://{tmp_path}/records", "t1")
    assert (tmp_path / "active.json").read_text() == "2" and (tmp_path / "records" / "t1-active.json").read_text() == "1" and backup.endswith("t1-active.json")


def test_components_and_samples(spark):
    from quarryline.operators import surface

    px = spark.createDataFrame([(0, 0), (1, 0), (1, 1), (30, 30)], "u int, v int")
    assert surface.components_near_anchor(px, (0, 0, 5, 5), 10.0).count() == 3
    rows = [(i, float(i % 10), float(i // 10), 5.0 if i == 44 else 0.0, 0.0, 0.0, 1.0, 1.0) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double, nx double, ny double, nz double, w double")
    kept = surface.supported_samples(df, F.col("id") != 44, 5.5, weight="w")
    assert kept.count() in (99, 100)
    assert surface.region_report(df.withColumn("s", F.lit("a")), "nz", "s", "z").first()["n"] == 100


def grid_mesh(spark, n=6, hole=(2, 2)):
    """A flat grid of squares, two triangles each, with one square left out."""
    v = spark.createDataFrame([(y * n + x, float(x), float(y), 0.0) for y in range(n) for x in range(n)], "vid long, x double, y double, z double")
    rows = []
    for y in range(n - 1):
        for x in range(n - 1):
            if (x, y) != hole:
                i = y * n + x
                rows += [(i, i + 1, i + n), (i + 1, i + n + 1, i + n)]
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "fid long, a long, b long, c long"), v


def test_holes_are_filled_where_observed(spark):
    from quarryline.operators import closing

    f, v = grid_mesh(spark)
    dense = spark.createDataFrame([(i, 2 + i % 11 / 10, 2 + i // 11 / 10, 0.0) for i in range(121)], "id long, x double, y double, z double")
    out = closing.fill_supported(f, v, dense, 0.5, 1.0, most_wide=3.0)
    new = out.where("inferred").collect()
    assert len(new) == 2 and {x for r in new for x in (r["a"], r["b"], r["c"])} == {14, 15, 20, 21} and out.count() == f.count() + 2
    assert closing.fill_supported(f, v, dense.where("x < 2.3"), 0.5, 1.0, most_wide=3.0).where("inferred").count() == 0
    assert closing.fill_supported(f, v, dense, 0.5, 1.0, most_wide=1.0).where("inferred").count() == 0
    assert closing.fill_supported(f, v, dense, 0.5, 1.0, most_wide=3.0, initial=f).where("inferred").count() == 0


def test_meshes_keep_to_observations(spark):
    from quarryline.operators import closing

    f, v = grid_mesh(spark, 8, hole=(9, 9))
    seen = v.where("x <= 3").select(F.col("vid").alias("id"), "x", "y", "z")
    held = closing.trim_unsupported(f, v, seen, 0.1, 1.1)
    assert held.count() == 4 * 7 * 2
    back = closing.retract_unsupported(f, v, seen, 1.1, 20)
    assert back.count() == 4 * 7 * 2
    flap = spark.createDataFrame([(100, 2.2, 2.2, -1.0), (101, 2.8, 2.2, 1.0), (102, 2.5, 2.8, 1.0)], "vid long, x double, y double, z double")
    more = f.unionByName(spark.createDataFrame([(500, 100, 101, 102)], f.schema))
    cost = more.select("fid", F.when(F.col("fid") == 500, 0.1).otherwise(5.0).alias("cost"))
    fixed = closing.repair_contacts(more, v.unionByName(flap), cost, 1.0)
    assert {r["fid"] for r in more.select("fid").subtract(fixed.select("fid")).collect()} == {500}
    with pytest.raises(ValueError):
        closing.repair_contacts(more, v.unionByName(flap), cost, 1.0, budget=0.0)
