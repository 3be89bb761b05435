"""JSON, CSV and Parquet tables of a campaign, and the pairing of its capture files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import angle_token, nominal_angle, physical_angle, session_order, steps_before, view_index

CAPTURE = "session string, session_index int, stem string, view_index int, pose_index int, filename_angle_deg double, nominal_angle_deg double, cumulative_steps int, physical_angle_deg double, left_path string, right_path string"
ANGLE_TOLERANCE_DEG = 0.051


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def with_defaults(df: DataFrame, schema: str, defaults: dict | None = None) -> DataFrame:
    """The columns of ``schema`` in order; missing ones are null or their default, the rest are left out."""
    fields = df.sparkSession.createDataFrame([], schema).schema.fields
    defaults = defaults or {}
    return df.select(*[(F.coalesce(F.col(f.name), F.lit(defaults.get(f.name))) if f.name in df.columns else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in fields])


def sessions(files: DataFrame, path: str = "path") -> DataFrame:
    """Session names S## in file paths, in natural order."""
    name = F.regexp_extract(path, r"/(S\d+)/", 1)
    return files.select(name.alias("session")).where("session <> ''").distinct().orderBy(session_order(F.col("session")), "session")


def pair_captures(files: DataFrame, path: str = "path") -> DataFrame:
    """Left and right image of each capture, joined on session and stem, with the angles its name and pose give."""
    named = files.select(F.col(path).alias("path"), F.regexp_extract(path, r"/(S\d+)/", 1).alias("session"), F.regexp_extract(path, r"/(left|right)/", 1).alias("side"), F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1).alias("stem"))
    left, right = (named.where(F.col("side") == s).select("session", "stem", F.col("path").alias(f"{s}_path")) for s in ("left", "right"))
    both = left.join(right, ["session", "stem"])
    return both.select("session", session_order(F.col("session")).alias("session_index"), "stem", view_index(F.col("stem")).alias("view_index"), view_index(F.col("stem")).alias("pose_index"), angle_token(F.col("stem")).alias("filename_angle_deg"), "left_path", "right_path").withColumns(
        {"nominal_angle_deg": nominal_angle("pose_index"), "cumulative_steps": steps_before("pose_index"), "physical_angle_deg": physical_angle("pose_index")}
    )


def capture_problems(captures: DataFrame, poses: int = 25) -> DataFrame:
    """Reasons against each session: number of poses, gaps, or names whose angle isn't the pose's."""
    from ..operators.gates import reasons

    s = captures.groupBy("session").agg(F.count("*").alias("n"), F.countDistinct("pose_index").alias("d"), F.min("pose_index").alias("lo"), F.max("pose_index").alias("hi"), F.max(F.abs(F.col("filename_angle_deg") - F.col("nominal_angle_deg"))).alias("off"))
    return s.select("session", reasons([("count", F.col("n") != poses), ("poses", (F.col("d") != poses) | (F.col("lo") != 0) | (F.col("hi") != poses - 1)), ("angles", F.coalesce(F.col("off") > ANGLE_TOLERANCE_DEG, F.lit(True)))]).alias("reasons"))


def pose_groups(captures: DataFrame) -> DataFrame:
    """One row for each pose with its members in session order."""
    member = F.struct("session", "stem", "filename_angle_deg")
    return captures.groupBy("pose_index").agg(F.count("*").alias("independent_observations"), F.array_sort(F.collect_list(member)).alias("members")).withColumns({"nominal_angle_deg": nominal_angle("pose_index"), "cumulative_steps": steps_before("pose_index"), "physical_angle_deg": physical_angle("pose_index")})


def write_flat_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """Fixed columns with a header; lists are joined by `` | ``."""
    kinds = dict(df.dtypes)
    df.select(*[F.array_join(f, " | ").alias(f) if kinds[f].startswith("array") else F.col(f) for f in fields]).write.option("header", True).csv(path)
