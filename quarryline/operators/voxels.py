"""Voxel keys, downsampling and two-level fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bitmask import pose_mask
from .stats import weighted_mean

KEYS = ("kx", "ky", "kz")


def voxel_keys(axes: tuple, size: float) -> list[Column]:
    """floor(coordinate / size) as BIGINT; floor, not truncation."""
    return [F.floor(F.col(a) / size).cast("bigint").alias(k) for a, k in zip(axes, KEYS, strict=True)]


def with_voxels(df: DataFrame, axes: tuple, size: float) -> DataFrame:
    return df.select("*", *voxel_keys(axes, size))


def first_per_voxel(df: DataFrame, axes: tuple, size: float, order: str) -> DataFrame:
    """The row of least ``order`` of each voxel; a size of 0 or less keeps all rows."""
    if size <= 0:
        return df
    rows = with_voxels(df, axes, size)
    return rows.groupBy(*KEYS).agg(F.min_by(F.struct(*[F.col(c) for c in df.columns]), order).alias("r")).select(*KEYS, "r.*")


def voxel_mean(df: DataFrame, axes: tuple, size: float, weight: str, values: tuple = (), keys: tuple = ()) -> DataFrame:
    """Weighted means of the axes and ``values`` by voxel (and ``keys``), with n and the weight."""
    rows = with_voxels(df, axes, size)
    return rows.groupBy(*keys, *KEYS).agg(F.count("*").alias("n"), F.sum(weight).alias("weight"), *[weighted_mean(c, weight).alias(c) for c in (*axes, *values)])


def voxel_label(df: DataFrame, axes: tuple, size: float, label: str, weight: str) -> DataFrame:
    """The label of most weight in each voxel; ties go to the smaller label."""
    votes = with_voxels(df, axes, size).groupBy(*KEYS, label).agg(F.sum(weight).alias("vote"))
    return votes.groupBy(*KEYS).agg(F.max_by(label, F.struct("vote", (-F.col(label)).alias("first"))).alias(label))


def fuse(df: DataFrame, axes: tuple, size: float, pose: str, weight: str, low: float = 0.05, high: float = 1.0) -> DataFrame:
    """Two levels: weighted means by (voxel, pose), whose weights are clipped before the means by voxel.

    The clipping makes the levels differ from one flat mean, so they stay two aggregates. Gives n, poses, mask, weight,
    the axes and spread (root of the weighted mean squared distance of the poses from the voxel's mean).
    """
    per_pose = voxel_mean(df, axes, size, weight, keys=(pose,)).withColumn("w", F.least(F.greatest("weight", F.lit(low)), F.lit(high)))
    moments = [F.sum(F.col("w") * F.col(a) * F.col(a)).alias(f"_{a}") for a in axes]
    whole = per_pose.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.count("*").alias("poses"), pose_mask(pose).alias("mask"), F.sum("w").alias("weight"), *[weighted_mean(a, "w").alias(a) for a in axes], *moments)
    spread = sum((F.col(f"_{a}") / F.col("weight") - F.col(a) * F.col(a) for a in axes[1:]), F.col(f"_{axes[0]}") / F.col("weight") - F.col(axes[0]) * F.col(axes[0]))
    return whole.withColumn("spread", F.sqrt(F.greatest(spread, F.lit(0.0)))).drop(*[f"_{a}" for a in axes])


def retention(reference: DataFrame, kept: DataFrame, axes: tuple, size: float) -> DataFrame:
    """Occupied cells of ``reference`` and how many of them hold a row of ``kept``."""
    cells = with_voxels(reference, axes, size).select(*KEYS).distinct()
    held = with_voxels(kept, axes, size).select(*KEYS).distinct().withColumn("held", F.lit(1))
    return cells.join(held, list(KEYS), "left").agg(F.count("*").alias("cells"), F.coalesce(F.sum("held"), F.lit(0)).alias("retained"), F.avg(F.coalesce("held", F.lit(0))).alias("ratio"))
