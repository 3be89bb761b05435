"""Quality gates: metrics become rows (name, value, passed), reasons and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERDICTS = ("accepted", "warning", "rejected")


def reasons(rules: list[tuple[str, Column]]) -> Column:
    """Names of the rules that hold, in order; a rule whose value is unknown doesn't hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))


def verdict(reject: Column, warn: Column) -> Column:
    """Any reason to reject, else any to warn, else accepted."""
    return F.when(F.size(reject) > 0, "rejected").when(F.size(warn) > 0, "warning").otherwise("accepted")


def ladder(df: DataFrame, rejects: list[tuple[str, Column]], warns: list[tuple[str, Column]]) -> DataFrame:
    out = df.withColumn("reject_reasons", reasons(rejects)).withColumn("warn_reasons", reasons(warns))
    return out.withColumn("verdict", verdict(F.col("reject_reasons"), F.col("warn_reasons")))


def gate_rows(df: DataFrame, keys: list[str], gates: list[tuple[str, str, str, float]]) -> DataFrame:
    """One row for each gate (name, column, '<=' or '>=', limit) of each row; an unknown value fails."""
    one = lambda n, c, op, x: F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("value"), F.lit(f"{op} {x:g}").alias("threshold"), F.coalesce(F.col(c) <= x if op == "<=" else F.col(c) >= x, F.lit(False)).alias("passed"))
    return df.select(*keys, F.explode(F.array(*[one(*g) for g in gates])).alias("g")).select(*keys, "g.*")


def all_passed(gates: DataFrame, keys: list[str]) -> DataFrame:
    return gates.groupBy(*keys).agg(F.bool_and("passed").alias("passed"), F.sort_array(F.collect_list(F.when(~F.col("passed"), F.col("name")))).alias("failed"))


def category_counts(df: DataFrame, category: str, blocking: list[str]) -> DataFrame:
    return df.groupBy(category).agg(F.count("*").alias("n")).withColumn("blocking", F.col(category).isin(blocking))


def share_of_total(df: DataFrame, category: str) -> DataFrame:
    """n and percent by category, with the total from one more aggregate of the counts."""
    counts = df.groupBy(category).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_t")))).select(category, "n", (100.0 * F.col("n") / F.col("_t")).alias("percent"))  # one row


def comparison_table(df: DataFrame, keys: list[str], measured: str, expected: str) -> DataFrame:
    """Mean, sample deviation and mean absolute and percent difference by group."""
    d = F.col(measured) - F.col(expected)
    return df.groupBy(*keys).agg(F.count(measured).alias("n"), F.avg(measured).alias("mean"), F.stddev_samp(measured).alias("std"), F.avg(F.abs(d)).alias("mean_abs_difference"), F.avg(100.0 * d / F.col(expected)).alias("mean_percent"))


def changed(before: DataFrame, after: DataFrame, on: list[str], value: str, tolerance: float) -> DataFrame:
    """Rows whose value got worse (grew) by more than the tolerance, or that are missing after."""
    b = before.select(*on, F.col(value).alias("before"))
    return b.join(after.select(*on, F.col(value).alias("after")), on, "left").withColumn("reasons", reasons([("missing", F.col("after").isNull()), ("worse", F.col("after") > F.col("before") + tolerance)]))


def symmetric_edges(directed: DataFrame, overlap_least: float, rmse_most: float) -> DataFrame:
    """Both directions of each edge (source, target, overlap, rmse, weight) as one: mean overlap, weighted rmse, accepted."""
    rows = directed.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), "overlap", "rmse", "weight")
    out = rows.groupBy("a", "b").agg(F.count("*").alias("directions"), F.avg("overlap").alias("overlap"), F.sqrt(F.sum(F.col("weight") * F.col("rmse") ** 2) / F.sum("weight")).alias("rmse"))
    return out.withColumn("accepted", (F.col("directions") == 2) & (F.col("overlap") >= overlap_least) & (F.col("rmse") <= rmse_most))


def pose_weights(edges: DataFrame) -> DataFrame:
    """Edge weight sqrt of factors against the medians; a pose's is sqrt(least * geometric mean) of its edges'."""
    med = edges.agg(*[F.percentile(c, F.lit(0.5)).alias(f"m_{c}") for c in ("rmse", "p90", "overlap")])
    f = lambda c, up: F.least(F.lit(1.0), (F.col(c) / F.col(f"m_{c}")) if up else (F.col(f"m_{c}") / F.col(c)))
    w = edges.crossJoin(F.broadcast(med)).withColumn("w", F.sqrt(f("rmse", False) * f("p90", False) * f("overlap", True)))  # one row
    return w.select(F.explode(F.array("source", "target")).alias("pose"), "w").groupBy("pose").agg(F.sqrt(F.min("w") * F.exp(F.avg(F.log("w")))).alias("weight"))


def plane_pairs(planes: DataFrame, key: str, normal: tuple, offset: str, parallel_deg: float, right_deg: float) -> DataFrame:
    """Angle and relation of all pairs of one view's few planes, by key order."""
    a = planes.select(F.col(key).alias("a"), *[F.col(c).alias(f"a{i}") for i, c in enumerate(normal)], F.col(offset).alias("ao"))
    b = planes.select(F.col(key).alias("b"), *[F.col(c).alias(f"b{i}") for i, c in enumerate(normal)], F.col(offset).alias("bo"))
    cos = F.abs(F.col("a0") * F.col("b0") + F.col("a1") * F.col("b1") + F.col("a2") * F.col("b2"))
    angle = F.degrees(F.acos(F.least(F.lit(1.0), cos)))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", angle.alias("angle"), F.abs(F.col("ao") - F.col("bo")).alias("separation"), F.when(angle <= parallel_deg, "parallel").when(angle >= right_deg, "perpendicular").otherwise("oblique").alias("relation"))


def evidence_distinct(manifests: DataFrame, campaign: str, geometry: str, digest: str, campaigns: int = 3, unseen: int = 2) -> DataFrame:
    """Gates of promotion evidence: enough distinct campaigns and unseen geometries, and no capture counted twice."""
    return manifests.agg((F.countDistinct(campaign) >= campaigns).alias("campaigns_ok"), (F.countDistinct(geometry) >= unseen).alias("geometries_ok"), (F.countDistinct(digest) == F.count(digest)).alias("captures_ok"))
