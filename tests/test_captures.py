"""A small campaign on disk, read and written as tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.functions import geometry
from quarryline.sources import captures


@pytest.fixture
def campaign(tmp_path):
    rng = np.random.default_rng(0)
    for session in ("S01", "S02"):
        folder = tmp_path / "depth" / session
        folder.mkdir(parents=True)
        for pose in (1, 2):
            for layer in ("depth", "confidence"):
                np.save(folder / f"obj_V{pose:03d}_A000_{layer}.npy", rng.random((4, 6)))
        np.save(folder / "obj_V001_A000_silhouette.npy", np.eye(4, 6))
    np.save(tmp_path / "depth" / "S01" / "empty_V001_A000_background.npy", np.array([[500.0, np.inf], [0.0, 700.0]]))
    (tmp_path / "clouds").mkdir()
    for pose in (0, 3):
        np.savez(tmp_path / "clouds" / f"P{pose:02d}_cloud.npz", x=np.arange(3.0) + pose, y=np.zeros(3), z=np.ones(3))
        np.savez(tmp_path / "clouds" / f"P{pose:02d}_planes.npz", plane=np.array([1, -1, 2]))
        np.savez(tmp_path / "clouds" / f"P{pose:02d}_registered_clean.npz", x=np.full(2, pose * 1.0), y=np.zeros(2), z=np.zeros(2))
    (tmp_path / "manifest.json").write_text(json.dumps([{"session": "S01", "stem": "obj_V001_A000", "usable": True}, {"session": "S01", "stem": "obj_V002_A000", "usable": False}]))
    (tmp_path / "summary.json").write_text(json.dumps([{"pose_index": 3, "verdict": "accepted"}]))
    return tmp_path


def test_reads(spark, campaign):
    depth = str(campaign / "depth")
    rows = captures.rasters(spark, depth, ["depth", "confidence"])
    assert rows.count() == 2 * 2 * 24 and {tuple(r) for r in rows.select("pose_index", "u", "v").distinct().collect()} == {(p, u, v) for p in (0, 1) for u in range(6) for v in range(4)}
    want = np.load(campaign / "depth" / "S02" / "obj_V002_A000_depth.npy")
    got = {(r["v"], r["u"]): r["depth"] for r in rows.where("session = 'S02' and pose_index = 1").collect()}
    assert all(got[i] == want[i] for i in got)
    assert captures.observations(spark, depth, str(campaign / "manifest.json"), ["depth", "confidence"]).select("session", "stem").distinct().collect() == [("S01", "obj_V001_A000")]
    assert sorted(map(tuple, captures.background_depths(spark, depth, ["S01", "S02"]).collect())) == [("S01", 0, 0, 500.0), ("S01", 1, 1, 700.0)]
    with pytest.raises(FileNotFoundError):
        captures.background_depths(spark, depth, ["S02"])
    assert {tuple(r) for r in captures.silhouettes(spark, depth).collect()} == {(0, i, i) for i in range(4)}
    np.save(campaign / "depth" / "S02" / "obj_V002_A000_confidence.npy", np.zeros((2, 12)))
    with pytest.raises(Exception, match="shapes differ"):
        captures.rasters(spark, depth, ["depth", "confidence"]).collect()


def test_views(spark, campaign):
    clouds, summary = str(campaign / "clouds"), str(campaign / "summary.json")
    v = captures.labelled_views(spark, clouds, clouds, summary).orderBy("pose_index", "row_id").collect()
    assert [(r["pose_index"], r["x"], r["plane"], r["verdict"]) for r in v] == [(0, 0.0, 1, None), (0, 1.0, -1, None), (0, 2.0, 2, None), (3, 3.0, 1, "accepted"), (3, 4.0, -1, "accepted"), (3, 5.0, 2, "accepted")]
    assert captures.registered_clean_views(spark, clouds).count() == 4


def test_files_and_sinks(spark, campaign, tmp_path):
    assert captures.require_file(spark, str(campaign / "summary.json"), "summary").endswith("summary.json")
    for wrong in (campaign / "nothing", campaign):
        with pytest.raises(FileNotFoundError, match="summary"):
            captures.require_file(spark, str(wrong), "summary")
    rows = captures.rasters(spark, str(campaign / "depth"), ["depth"])
    out = str(tmp_path / "out")
    captures.write_views(rows, out)
    assert spark.read.parquet(out).count() == rows.count()
    with pytest.raises(Exception, match="(?i)already exists"):
        captures.write_views(rows, out)
    verdicts = spark.createDataFrame([("S01", "rejected")], "session string, verdict string")
    kept = captures.finalized(rows, verdicts)
    assert kept.count() == rows.count() and kept.where("session_quality = 'rejected' and depth_enabled").count() == rows.where("session = 'S01'").count()
    poses = geometry.poses_table(spark, {0: np.eye(4), 3: geometry.about_line((0, 1, 0), (0, 0, 0), np.pi)})
    points = captures.views(spark, str(campaign / "clouds")).select("pose_index", "x", "y", "z")
    made = captures.export_registered(points, poses, str(tmp_path / "registered"))
    assert sorted(round(r["x"], 6) for r in made.where(F.col("pose_index") == 3).collect()) == [-5.0, -4.0, -3.0]
