"""A campaign's artefacts as tables: what each stage reads and writes, keyed by session and pose.

Arrays of one capture lie beside each other as ``<folder>/<session>/<stem>_<layer>.npy`` and clouds as ``P<pose>_<kind>.npz``; a pose is
the number after ``_V`` of a stem, less one, or the one after ``P``. Shapes that differ within a capture are an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import transform
from ..functions.scalar import view_index
from .arrays import read_npy, read_npz
from .files import read_json

CLOUD = "x double, y double, z double, nx double, ny double, nz double, confidence double, support int"


def require_file(spark: SparkSession, path: str, label: str) -> str:
    """The full name of a file that has to be there; FileNotFoundError, with its label, if it isn't or is a folder."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(conf)
    if not system.exists(at) or not system.getFileStatus(at).isFile():
        raise FileNotFoundError(f"{label}: {path}")
    return system.makeQualified(at).toString()


def rasters(spark: SparkSession, folder: str, layers: list[str]) -> DataFrame:
    """session, stem, pose_index, u, v and a column for each layer: one row for each pixel of each capture that has all of them."""
    name = r"/([^/]+)/([^/]+)_(" + "|".join(layers) + r")\.npy$"
    a = read_npy(spark, folder).withColumns({"session": F.regexp_extract("path", name, 1), "stem": F.regexp_extract("path", name, 2), "layer": F.regexp_extract("path", name, 3)}).where("layer <> ''")
    same = F.when(F.size(F.collect_set("shape")) > 1, F.raise_error(F.concat(F.lit("shapes differ in "), F.first("stem")))).otherwise(F.first("shape"))
    wide = a.groupBy("session", "stem", "index").agg(same.alias("shape"), F.count("*").alias("n"), *[F.max(F.when(F.col("layer") == x, F.col("value"))).alias(x) for x in layers])
    cols = F.col("shape")[1]
    return wide.where(F.col("n") == len(layers)).select("session", "stem", view_index(F.col("stem")).alias("pose_index"), (F.col("index") % cols).cast("int").alias("u"), F.floor(F.col("index") / cols).cast("int").alias("v"), *layers)


def observations(spark: SparkSession, folder: str, manifest: str, layers: list[str]) -> DataFrame:
    """The pixels of captures that the manifest (JSON rows of session, stem, usable) lists as usable."""
    listed = read_json(spark, manifest, "session string, stem string, usable boolean").where("usable").select("session", "stem")
    return rasters(spark, folder, layers).join(F.broadcast(listed) if listed.count() <= 100_000 else listed, ["session", "stem"], "left_semi")


def background_depths(spark: SparkSession, folder: str, sessions: list[str]) -> DataFrame:
    """session, u, v, background: finite positive depths of the empty scene; sessions without one are left out, none at all is an error."""
    found = rasters(spark, folder, ["background"]).where(F.col("session").isin(sessions) & (F.col("background") > 0) & (F.col("background") < float("inf")))
    if not found.limit(1).count():
        raise FileNotFoundError(f"background depths: none under {folder}")
    return found.select("session", "u", "v", "background")


def silhouettes(spark: SparkSession, folder: str) -> DataFrame:
    """pose_index, u, v of the pixels inside each pose's consensus silhouette."""
    return rasters(spark, folder, ["silhouette"]).where("silhouette > 0").select("pose_index", "u", "v")


def views(spark: SparkSession, folder: str, kind: str = "cloud", schema: str = CLOUD, summary: str | None = None) -> DataFrame:
    """pose_index, row_id and the columns of ``schema`` of each ``P<pose>_<kind>.npz``; with a summary (JSON rows of pose_index and a verdict)
    its verdict too, null where it has none."""
    rows = read_npz(spark, folder, schema).withColumn("pose_index", F.regexp_extract("path", rf"/P(\d+)_{kind}\.npz$", 1)).where("pose_index <> ''")
    rows = rows.withColumn("pose_index", F.col("pose_index").cast("int")).drop("path")
    return rows if summary is None else rows.join(F.broadcast(read_json(spark, summary, "pose_index int, verdict string")), "pose_index", "left")  # a row for each pose


def labelled_views(spark: SparkSession, clouds: str, labels: str, summary: str | None = None) -> DataFrame:
    """The points of each view with the plane that the geometry stage gave them (-1: none)."""
    planes = views(spark, labels, "planes", "plane int").select("pose_index", "row_id", "plane")
    return views(spark, clouds, summary=summary).join(planes, ["pose_index", "row_id"], "left").fillna(-1, ["plane"])


def registered_clean_views(spark: SparkSession, folder: str) -> DataFrame:
    return views(spark, folder, "registered_clean")


def completion_context(candidates: DataFrame, poses: DataFrame, masks: DataFrame, depths: DataFrame, focal: float, cx: float, cy: float, tolerance: float, id_: str = "voxel") -> DataFrame:
    """Each candidate with what all poses say of it: inside silhouettes, agreeing, contradicting and occluding depths."""
    from ..operators.consensus import reprojection_support, silhouette_support

    inside = silhouette_support(candidates, poses, masks, focal, cx, cy, id_=id_)
    return inside.join(reprojection_support(candidates, poses, depths, focal, cx, cy, tolerance, id_=id_), id_, "left").fillna(0, ["agree", "contradict", "occluded"])


def write_views(df: DataFrame, path: str, by: tuple = ("session", "pose_index")) -> None:
    """One folder for each session and pose; an existing result is an error, never mixed with."""
    df.write.partitionBy(*by).mode("errorifexists").parquet(path)


def finalized(df: DataFrame, verdicts: DataFrame, on: str = "session") -> DataFrame:
    """Every row, with its session's verdict beside it: quality is advice here and leaves nothing out."""
    return df.join(verdicts.select(on, F.col("verdict").alias("session_quality")), on, "left").withColumn("depth_enabled", F.lit(True))


def export_registered(points: DataFrame, poses: DataFrame, path: str, normals: tuple | None = None) -> DataFrame:
    """Points of all poses in the common frame, written by pose; returns the union that reads them."""
    transform(points, poses, normals=normals).write.partitionBy("pose_index").mode("errorifexists").parquet(path)
    return points.sparkSession.read.parquet(path)
