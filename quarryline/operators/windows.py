"""Ordered and circular windows, and session quality control."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import MAD_SIGMA, finite_stats, percentile


def exclusive_sum(df: DataFrame, value: str, order: list[str], by: list[str], name: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))


def last_per_key(df: DataFrame, keys: list[str], score: str, order: str) -> DataFrame:
    """The row of highest score for each key; of ties the last in ``order``."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(score, order)).alias("r")).select("r.*")


def circular_neighbors(df: DataFrame, slot: str, value: str, n: int, reach: int) -> DataFrame:
    """slot, value and, over the values up to ``reach`` slots away on a circle of n (itself left out), their median, MAD and number.

    Each row is dealt to its 2 * reach neighbours, so a slot's task sees that many rows at most.
    """
    rows = df.select(F.col(slot).alias("s"), F.col(value).cast("double").alias("x")).where("x is not null")
    offsets = F.array(*[F.lit(d) for d in range(-reach, reach + 1) if d])
    near = rows.withColumn("d", F.explode(offsets)).select(F.pmod(F.col("s") + F.col("d"), F.lit(n)).alias("s"), F.col("x").alias("nx"))
    stats = finite_stats(near, ["s"], "nx", {}).select("s", F.col("median").alias("near_median"), F.col("mad").alias("near_mad"), F.col("n").alias("near_n"))
    return rows.join(stats, "s").select(F.col("s").alias(slot), F.col("x").alias(value), "near_median", "near_mad", "near_n")


def circular_outliers(df: DataFrame, slot: str, value: str, n: int, reach: int, factor: float, least: float) -> DataFrame:
    near = circular_neighbors(df, slot, value, n, reach)
    limit = F.greatest(F.lit(least), factor * MAD_SIGMA * F.col("near_mad"))
    return near.withColumn("outlier", F.abs(F.col(value) - F.col("near_median")) > limit)


def session_quality(df: DataFrame, session: str, value: str, absolute: float, factor: float, least: int = 3) -> DataFrame:
    """``df`` with the session's median and tolerance, and reasons against each row; sessions of fewer than ``least`` values judge none."""
    stats = finite_stats(df, [session], value, {}).select(session, F.col("median").alias("session_median"), F.greatest(F.lit(absolute), factor * MAD_SIGMA * F.col("mad")).alias("tolerance"), F.col("n").alias("session_n"))
    joined = df.join(stats, session, "left")
    off = (F.col("session_n") >= least) & (F.abs(F.col(value) - F.col("session_median")) > F.col("tolerance"))
    missing = F.col(value).isNull() | F.isnan(value)
    return joined.withColumn("reasons", F.array_compact(F.array(F.when(missing, "missing"), F.when(off, "far_from_session"))))


def hourly_rollup(df: DataFrame, time: str, value: str, by: list[str]) -> DataFrame:
    return df.groupBy(F.date_trunc("hour", time).alias("hour"), *by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("highest"))


def per_pixel_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median of a pixel over frames, cut to an integer as an image cast does."""
    return df.groupBy(*keys).agg(percentile(value, 0.5).cast("int").alias("median"))
