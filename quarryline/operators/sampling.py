"""Deterministic samples and ranked choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut


def uniform(key: str, seed: int = 0) -> Column:
    """A number in (0, 1) from a row's key: the same at any partitioning."""
    return (F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def weighted_sample(df: DataFrame, most: int, weight: str, key: str, by: list[str] | None = None, power: float = 1.0, seed: int = 0) -> DataFrame:
    """At most ``most`` rows for each group without replacement, by Efraimidis and Spirakis; all rows if there are no more."""
    w = F.greatest(F.pow(F.greatest(F.col(weight), F.lit(0.0)), F.lit(power)), F.lit(1e-12))
    ranked = df.withColumn("_k", -F.log(uniform(key, seed)) / w)
    if not by:
        return ranked.orderBy("_k", key).limit(most).drop("_k")
    return ranked.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_k", key))).where(F.col("_r") <= most).drop("_k", "_r")


def ranked(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``df`` with _i, the place from 0 of each row in its group by ``order``, and _n, the group's rows.

    Rows are dealt by ranges of group and order; a place is the rows of lower ranges plus a window inside the range, so no task
    holds a group. Ties in ``order`` are in no defined order, but each row has its own place.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(parts, *by, *order).withColumn("_p", F.spark_partition_id()))
    group = Window.partitionBy(*by)
    lower = F.sum("_k").over(group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    sums = dealt.groupBy(*by, "_p").agg(F.count("*").alias("_k")).select(*by, "_p", F.coalesce(lower, F.lit(0)).alias("_l"), F.sum("_k").over(group).alias("_n"))
    inside = dealt.withColumn("_i", F.row_number().over(Window.partitionBy(*by, "_p").orderBy(*order)) - 1)
    both = inside.join(sums.select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate((*by, "_p"))], "_l", "_n"), [inside[c].eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate((*by, "_p"))])
    return both.select(*df.columns, (F.col("_l") + F.col("_i")).alias("_i"), "_n")


def evenly_spaced(df: DataFrame, most: int, order: str, by: list[str]) -> DataFrame:
    """Rows floor(i (n - 1) / (most - 1)) of each group in order; all if there are at most ``most``."""
    step = F.ceil(F.col("_i") * (most - 1) / (F.col("_n") - 1)).cast("long")
    hit = F.floor(step * (F.col("_n") - 1) / (most - 1)) == F.col("_i")
    return ranked(df, by, [F.col(order)]).where((F.col("_n") <= most) | hit).drop("_i", "_n")


def best_candidate(df: DataFrame, reasons: str, score: str, key: str) -> DataFrame:
    """The candidate of least score among those without a reason against them."""
    return df.where(F.size(reasons) == 0).orderBy(score, key).limit(1)


def top_or_passing(df: DataFrame, passes: Column, least: int, score: str, key: str) -> DataFrame:
    """Rows that pass; if fewer than ``least`` do, the best by score instead."""
    if df.where(passes).limit(least).count() >= least:
        return df.where(passes)
    return df.orderBy(F.desc(score), key).limit(least)


def capped_removal(df: DataFrame, flagged: str, score: str, key: str, by: list[str], share: float) -> DataFrame:
    """Flagged rows go, worst score first, but at most ``share`` of each group."""
    flag = F.coalesce(F.col(flagged), F.lit(False))
    placed = ranked(df.withColumn("_flag", flag), by, [F.desc("_flag"), F.desc(score), F.col(key)])  # flagged rows come first, worst first
    return placed.where(~F.col("_flag") | (F.col("_i") >= F.floor(share * F.col("_n")))).drop("_flag", "_i", "_n")


def greedy_cover(conflicts: DataFrame, cost: DataFrame) -> DataFrame:
    """Members that hit every conflict: of ``conflicts(conflict, member)`` those that taking the most open conflicts per cost first takes.

    ``cost(member, cost)``; members without one cost 1. Ties go to the smaller member. A member whose score beats those of all members it shares a
    conflict with is taken at once with all others like it: until it is taken, scores around it only fall, so the one-by-one order would take it
    before any of them too, and the cover is the same.
    """
    open_ = conflicts.select("conflict", "member").where("conflict is not null and member is not null").distinct()
    open_, taken = cut(open_.join(cost.groupBy("member").agg(F.min("cost").alias("cost")), "member", "left").select("conflict", "member", F.greatest(F.coalesce("cost", F.lit(1.0)), F.lit(1e-12)).alias("cost"))), None
    while open_.limit(1).count():
        per = cut(open_.groupBy("member").agg(F.count("*").alias("n"), (-F.count("*") / F.first("cost")).alias("score")))
        best = open_.join(per, "member").groupBy("conflict").agg(F.min(F.struct("score", "member")).alias("m"))
        wins = best.groupBy(F.col("m.member").alias("member")).agg(F.count("*").alias("wins"))
        chosen = cut(per.join(wins, "member").where("wins = n").select("member"))
        taken = chosen if taken is None else taken.unionByName(chosen)
        gone = open_.join(chosen, "member", "left_semi").select("conflict").distinct()
        open_ = cut(open_.join(gone, "conflict", "left_anti"))
    return open_.select("member") if taken is None else taken
