"""Fusion of posed surface points: regularising, biases of poses, layers and regions, coverage, and patches over gaps.

Points have id, x, y, z, a unit normal nx, ny, nz and, where a function says so, the pose that saw them. Neighbourhoods are radius or
nearest joins; what is estimated for many points at once (a pose's bias, a region's height) is aggregates and quantiles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clip
from ..session import ship
from .fitting import irls, normals, quadratic_design
from .graph import cut
from .joins import knn_join, radius_join
from .stats import MAD_SIGMA, finite_stats, quantiles
from .surface import AXES, NORMAL, evidence_class, independent_patches, local_residual, recover_coverage

ROWS = 250_000  # members in a task


def aligned_normals(df: DataFrame, radius: float, reference: DataFrame, id_: str = "id") -> DataFrame:
    """``df`` with PCA normals turned to the side of ``reference`` normals (id, nx, ny, nz); with too few neighbours those stay."""
    made = normals(df, id_, AXES, radius).select(id_, *[F.col(c).alias(f"p{c}") for c in NORMAL])
    both = df.drop(*NORMAL).join(reference.select(id_, *NORMAL), id_).join(made, id_, "left")
    dot = sum((F.col(f"p{c}") * F.col(c) for c in NORMAL[1:]), F.col("pnx") * F.col("nx"))
    known = F.col("pnx").isNotNull() & ~F.isnan("pnx")
    return both.withColumns({c: F.when(known, F.col(f"p{c}") * F.when(dot < 0, -1.0).otherwise(1.0)).otherwise(F.col(c)) for c in NORMAL}).select(*df.columns)


def bilateral_step(df: DataFrame, k: int, spacing: float, weight: str, mask: str | None = None, most: float = 0.2, id_: str = "id") -> DataFrame:
    """Points moved along their normals by the weighted mean height of k neighbours, at most ``most``.

    Weights fall with distance, height and the angle of normals and rise with the neighbour's own; with a pose mask they also rise with
    the share of the neighbour's poses that see the point too (a half where none does).
    """
    near = knn_join(df, df, k, id_, AXES, skip_self=True).select("a_id", "b_id", "distance")
    side = lambda p: df.select(F.col(id_).alias(f"{p}id"), *[F.col(c).alias(f"{p}{c}") for c in (*AXES, *NORMAL, weight, *([mask] if mask else []))])
    met = near.join(side("a_"), "a_id").join(side("b_"), "b_id")
    h = sum(((F.col(f"b_{x}") - F.col(f"a_{x}")) * F.col(f"a_{n}") for x, n in zip(AXES[1:], NORMAL[1:], strict=True)), (F.col("b_x") - F.col("a_x")) * F.col("a_nx"))
    dot = sum((F.col(f"a_{c}") * F.col(f"b_{c}") for c in NORMAL[1:]), F.col("a_nx") * F.col("b_nx"))
    w = F.exp(-0.5 * F.pow(F.col("distance") / (2 * spacing), 2)) * F.exp(-0.5 * F.pow(F.col("h") / spacing, 2)) * F.pow(F.greatest(dot, F.lit(0.0)), 4) * F.greatest(F.col(f"b_{weight}"), F.lit(0.0))
    if mask:
        w = w * (0.5 + 0.5 * F.bit_count(F.col(f"a_{mask}").bitwiseAND(F.col(f"b_{mask}"))) / F.greatest(F.bit_count(F.col(f"b_{mask}")), F.lit(1)))
    step = met.withColumn("h", h).withColumn("w", w).groupBy(F.col("a_id").alias(id_)).agg((F.sum(F.col("w") * F.col("h")) / F.greatest(F.sum("w") + 1, F.lit(1e-12))).alias("_s"))  # the point's own weight is 1
    moved = clip(F.coalesce("_s", F.lit(0.0)), -most, most)
    return df.join(step, id_, "left").withColumns({a: F.col(a) + moved * F.col(n) for a, n in zip(AXES, NORMAL, strict=True)}).drop("_s")


def regularize(df: DataFrame, rounds: int, k: int, spacing: float, radius: float, weight: str, mask: str | None = None, most: float = 0.2, total: float = 0.5, id_: str = "id") -> DataFrame:
    """Rounds of bilateral steps, with normals found anew before each and turned to those before; no point ends more than ``total``
    from where it began."""
    first, now = df.select(id_, *[F.col(a).alias(f"_{a}") for a in AXES]), df
    for _ in range(rounds):
        now = cut(bilateral_step(cut(aligned_normals(now, radius, now, id_)), k, spacing, weight, mask, most, id_))
    both = now.join(first, id_)
    far = F.sqrt(sum(((F.col(a) - F.col(f"_{a}")) ** 2 for a in AXES[1:]), (F.col("x") - F.col("_x")) ** 2))
    share = F.least(F.lit(1.0), total / F.greatest(far, F.lit(1e-12)))
    return both.withColumn("_k", share).withColumns({a: F.col(f"_{a}") + F.col("_k") * (F.col(a) - F.col(f"_{a}")) for a in AXES}).select(*df.columns)


def pose_biases(residuals: DataFrame, rounds: int = 4, least: int = 3) -> DataFrame:
    """pose, bias, cells of residuals (cell, pose, r): r is a pose's bias less its cell's gauge, by alternating medians; cells that fewer
    than two poses reach, and poses with fewer than ``least`` cells, don't count, and the median bias is 0."""
    r = cut(residuals.join(residuals.groupBy("cell").agg(F.countDistinct("pose").alias("_n")).where("_n > 1").select("cell"), "cell"))
    r = cut(r.join(r.groupBy("pose").count().where(F.col("count") >= least).select("pose"), "pose", "left_semi"))
    bias = r.select("pose").distinct().withColumn("bias", F.lit(0.0))
    for _ in range(rounds):
        gauge = quantiles(r.join(bias, "pose").withColumn("_o", F.col("bias") - F.col("r")), ["cell"], "_o", {"g": 0.5})
        bias = cut(quantiles(r.join(gauge, "cell").withColumn("_o", F.col("r") + F.col("g")), ["pose"], "_o", {"bias": 0.5}))
    middle = quantiles(bias, [], "bias", {"m": 0.5})
    return bias.crossJoin(F.broadcast(middle)).join(r.groupBy("pose").agg(F.countDistinct("cell").alias("cells")), "pose").select("pose", (F.col("bias") - F.col("m")).alias("bias"), "cells")  # one row


def pose_bias_consensus(points: DataFrame, sizes: tuple, agreement: float, most: float, id_: str = "id", pose: str = "pose", height: str = "height") -> tuple[DataFrame, DataFrame]:
    """Points (id, pose, x, y, z, normal, height over the fused surface) with the bias of their pose taken off along the normal, and the
    poses: pose, biases at both cell sizes, accepted. A bias counts if both sizes agree and neither is over ``most``."""
    found = None
    for i, size in enumerate(sizes):
        cell = F.struct(*[F.floor(F.col(a) / size).cast("bigint").alias(a) for a in AXES])
        rows = points.select(cell.alias("cell"), F.col(pose).alias("pose"), F.col(height).alias("r")).dropna()
        mid = quantiles(rows, ["cell", "pose"], "r", {"r": 0.5})
        b = pose_biases(mid).select("pose", F.col("bias").alias(f"bias_{i}"))
        found = b if found is None else found.join(b, "pose")
    ok = (F.abs(F.col("bias_0") - F.col("bias_1")) <= agreement) & (F.greatest(F.abs("bias_0"), F.abs("bias_1")) <= most)
    poses = cut(found.withColumn("accepted", ok))
    shift = poses.where("accepted").select(F.col("pose").alias(pose), ((F.col("bias_0") + F.col("bias_1")) / 2).alias("_b"))
    moved = points.join(shift, pose, "left").withColumn("_b", F.coalesce("_b", F.lit(0.0)))
    return moved.withColumns({a: F.col(a) - F.col("_b") * F.col(n) for a, n in zip(AXES, NORMAL, strict=True)}).withColumn(height, F.col(height) - F.col("_b")).select(*points.columns), poses


def regional_pose_shift(points: DataFrame, size: float, most: float, gain: float = 0.1, least_poses: int = 3, pose: str = "pose", height: str = "height") -> tuple[DataFrame, DataFrame]:
    """Points with each region's common height taken off where poses left out agree with it: region, shift, before, after, accepted.

    A region is a cell; the shift that the other poses give is tried on each pose in turn, and a region moves by the median of its
    poses if that lowers the mean error of the poses left out by ``gain`` of itself and stays within ``most``.
    """
    cell = F.struct(*[F.floor(F.col(a) / size).cast("bigint").alias(a) for a in AXES])
    rows = points.withColumn("region", cell)
    per = cut(quantiles(rows.select("region", pose, height), ["region", pose], height, {"h": 0.5}))
    others = per.alias("a").join(per.select("region", F.col(pose).alias("other"), F.col("h").alias("oh")), "region").where(F.col(pose) != F.col("other"))
    tried = quantiles(others.select("region", pose, "h", "oh"), ["region", pose, "h"], "oh", {"s": 0.5})  # a pose's others: few
    judged = tried.groupBy("region").agg(F.avg(F.abs("h")).alias("before"), F.avg(F.abs(F.col("h") - F.col("s"))).alias("after"), F.count("*").alias("poses"))
    regions = judged.join(quantiles(per, ["region"], "h", {"shift": 0.5}), "region")
    regions = cut(regions.withColumn("accepted", (F.col("poses") >= least_poses) & (F.col("after") <= (1 - gain) * F.col("before")) & (F.abs("shift") <= most)))
    moved = rows.join(regions.where("accepted").select("region", "shift"), "region", "left").withColumn("_b", F.coalesce("shift", F.lit(0.0)))
    return moved.withColumns({a: F.col(a) - F.col("_b") * F.col(n) for a, n in zip(AXES, NORMAL, strict=True)}).withColumn(height, F.col(height) - F.col("_b")).select(*points.columns), regions


def resolve_layers(members: DataFrame, gap: float, seed: str = "seed", pose: str = "pose", height: str = "height") -> DataFrame:
    """Layers of a seed's members along its normal: seed, layer, height, poses, held_out, chosen.

    Heights part where the next is more than ``gap`` away. The layer of most poses is chosen; of ties the one that poses left out
    in turn stay closest to, then the lower. A seed's members are the points near it, so one window each is small; tasks get about ROWS
    members, so that what a task sorts and groups doesn't grow with the table.
    """
    from pyspark.sql import Window

    parts = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-members.count() // ROWS))
    order = Window.partitionBy(seed).orderBy(height, pose)
    start = F.coalesce((F.col(height) - F.lag(height).over(order) > gap).cast("int"), F.lit(0))
    rows = members.select(seed, pose, height).repartition(parts, seed).withColumn("_s", start).withColumn("layer", F.sum("_s").over(order))
    per = cut(rows.groupBy(seed, "layer", pose).agg(F.avg(height).alias("h"))).repartition(parts, seed)
    whole = Window.partitionBy(seed, "layer")
    n, t = F.count("*").over(whole), F.sum("h").over(whole)
    others = per.withColumn("_o", F.when(n > 1, F.abs(F.col("h") - (t - F.col("h")) / (n - 1))))
    layers = others.groupBy(seed, "layer").agg(F.avg("h").alias(height), F.count("*").alias("poses"), F.avg("_o").alias("held_out"))
    best = Window.partitionBy(seed).orderBy(F.desc("poses"), F.col("held_out").asc_nulls_last(), height)
    return layers.withColumn("chosen", F.row_number().over(best) == 1)


def region_models(patches: DataFrame, size: float, factor: float = 2.5, least: int = 4) -> DataFrame:
    """Local patches (id, x, y, z, normal, height, rmse, held_out, poses) judged by their region, a cell of ``size``: each with accepted.

    A patch is accepted if its height keeps to the region's median within ``factor`` robust sigmas (0.05 of the size at least), its poses
    are two or more and their held-out error isn't over three times its own; small regions judge nobody by height.
    """
    cell = F.struct(*[F.floor(F.col(a) / size).cast("bigint").alias(a) for a in AXES])
    rows = patches.withColumn("region", cell)
    s = finite_stats(rows, ["region"], "height", {}).select("region", "n", F.col("median").alias("_m"), F.greatest(MAD_SIGMA * F.col("mad"), F.lit(0.02 * size)).alias("_s"))
    near = (F.col("n") < least) | (F.abs(F.col("height") - F.col("_m")) <= factor * F.col("_s"))
    held = F.coalesce(F.isnan("held_out") | (F.col("held_out") <= 3 * F.greatest(F.col("rmse"), F.lit(0.01 * size))), F.lit(True))
    return rows.join(s, "region").withColumn("accepted", near & held & (F.col("poses") >= 2)).select(*patches.columns, "region", "accepted")


def fuse_regions(patches: DataFrame, size: float, voxel: float) -> DataFrame:
    """Surfels of accepted patches: one for each voxel, at the mean of its patches' surface points and normals, weighted by 1 / error^2."""
    ok = region_models(patches, size).where("accepted")
    w = 1 / F.greatest(F.coalesce(F.nanvl("held_out", F.col("rmse")), F.col("rmse")), F.lit(0.01 * voxel)) ** 2
    at = ok.withColumns({a: F.col(a) + F.col("height") * F.col(n) for a, n in zip(AXES, NORMAL, strict=True)}).withColumn("_w", w)
    keyed = at.withColumns({f"k{a}": F.floor(F.col(a) / voxel).cast("bigint") for a in AXES})
    out = keyed.groupBy("kx", "ky", "kz").agg(*[(F.sum(F.col("_w") * F.col(c)) / F.sum("_w")).alias(c) for c in (*AXES, *NORMAL)], F.count("*").alias("patches"), F.max("poses").alias("poses"))
    size_ = F.greatest(F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2), F.lit(1e-12))
    return out.withColumn("_n", size_).withColumns({c: F.col(c) / F.col("_n") for c in NORMAL}).drop("_n")


def gated_coverage(df: DataFrame, kept: DataFrame, size: float, confidence: str, least: float, reach: float, most_height: float, angle_deg: float = 40.0, least_gain: float = 0.001, most_loss: float = 0.05, id_: str = "id") -> DataFrame:
    """``kept`` with candidates for its empty cells that lie on its surface, or ``kept`` itself where that isn't worth it.

    A candidate has to lie within ``most_height`` of the nearest kept point's tangent plane with a normal within ``angle_deg`` of its own.
    All are taken back if they fill less than ``least_gain`` of the cells held, or if the median residual over neighbours grows by more
    than ``most_loss`` of itself.
    """
    more = cut(recover_coverage(df, kept, size, confidence, least, reach, id_))
    added = more.join(kept.select(id_), id_, "left_anti")
    near = knn_join(added, kept, 1, id_, AXES).select("a_id", "b_id")
    side = lambda d, p: d.select(F.col(id_).alias(f"{p}id"), *[F.col(c).alias(f"{p}{c}") for c in (*AXES, *NORMAL)])
    met = near.join(side(added, "a_"), "a_id").join(side(kept, "b_"), "b_id")
    h = sum(((F.col(f"a_{x}") - F.col(f"b_{x}")) * F.col(f"b_{n}") for x, n in zip(AXES[1:], NORMAL[1:], strict=True)), (F.col("a_x") - F.col("b_x")) * F.col("b_nx"))
    dot = sum((F.col(f"a_{c}") * F.col(f"b_{c}") for c in NORMAL[1:]), F.col("a_nx") * F.col("b_nx"))
    good = met.where((F.abs(h) <= most_height) & (dot >= float(np.cos(np.radians(angle_deg))))).select(F.col("a_id").alias(id_))
    out = cut(kept.unionByName(added.join(good, id_, "left_semi")))
    cells = lambda d: d.select(*[F.floor(F.col(a) / size) for a in AXES]).distinct().count()
    if cells(out) < (1 + least_gain) * cells(kept):
        return kept
    middle = lambda d: next((r["m"] for r in quantiles(local_residual(d, reach, confidence, id_), [], "residual", {"m": 0.5}).collect()), 0.0)
    return out if middle(out) <= (1 + most_loss) * middle(kept) + 1e-9 else kept


def select_patches(df: DataFrame, spacing: float, confidence: str = "confidence", least: int = 20, least_share: float = 0.8, most_residual: float = 0.6, id_: str = "id") -> DataFrame:
    """Points worth keeping for a surface: of an evidence class, on their neighbours' surface, in patches of one orientation; if the
    patches hold less than ``least_share`` of those points all of these stay. Then empty cells are filled from the rest."""
    eligible = cut(df.withColumn("class", evidence_class(df)).where(F.col("class") > 0).drop("class"))
    flat = local_residual(eligible, 3 * spacing, confidence, id_).where(F.coalesce(F.col("residual"), F.lit(0.0)) <= most_residual * spacing).select(id_)
    smooth = cut(eligible.join(flat, id_, "left_semi"))
    patches = cut(independent_patches(smooth, 3 * spacing, 40.0, least, id_).select(id_))
    kept = smooth.join(patches, id_, "left_semi") if patches.count() >= least_share * smooth.count() else smooth
    return gated_coverage(df, cut(kept), 2 * spacing, confidence, 0.5, 4 * spacing, most_residual * spacing, id_=id_)


def missing_patches(df: DataFrame, radius: float, step: float, rings: int = 2, gap_deg: float = 120.0, least: int = 10, id_: str = "id") -> DataFrame:
    """Points inferred beyond a surface's open rim: seed, ring, x, y, z, normal, uncertainty.

    A point whose neighbours leave more than ``gap_deg`` free in its tangent plane lies on a rim; the robust quadratic of its neighbours
    goes on into the gap for ``rings`` steps, and the uncertainty grows with the fit's error and the distance.
    """
    ship(df.sparkSession)
    kind = dict(df.dtypes)[id_]
    near = radius_join(df, df, radius, id_, AXES, carry=(*AXES, *NORMAL)).where("a_id <> b_id")
    names = ["seed", "ring", *AXES, *NORMAL, "uncertainty"]

    def extend(g: pd.DataFrame) -> pd.DataFrame:
        if len(g) < least:
            return pd.DataFrame(columns=names)
        p0, n = (g[[f"a_{c}" for c in cs]].iloc[0].to_numpy(float) for cs in (AXES, NORMAL))
        side = np.eye(3)[int(np.argmin(np.abs(n)))]
        u = side - n * (side @ n)
        u /= max(np.linalg.norm(u), 1e-12)
        v = np.cross(n, u)
        d = g.sort_values("b_id")[[f"b_{c}" for c in AXES]].to_numpy(float) - p0
        a, b, h = d @ u, d @ v, d @ n
        turns = np.sort(np.arctan2(b, a))
        free = np.diff(np.r_[turns, turns[0] + 2 * np.pi])
        k = int(free.argmax())
        if np.degrees(free[k]) <= gap_deg:
            return pd.DataFrame(columns=names)
        x = np.r_[quadratic_design(a, b), quadratic_design(np.zeros(1), np.zeros(1))]
        beta = irls(x, np.r_[h, 0.0], np.ones(len(h) + 1))
        error = float(np.sqrt(np.mean((np.r_[h, 0.0] - x @ beta) ** 2)))
        way, out = turns[k] + free[k] / 2, []
        for ring in range(1, rings + 1):
            s, t = ring * step * np.cos(way), ring * step * np.sin(way)
            z = float(quadratic_design(np.array([s]), np.array([t]))[0] @ beta)
            slope = (2 * beta[0] * s + beta[2] * t + beta[3], 2 * beta[1] * t + beta[2] * s + beta[4])
            m = n - slope[0] * u - slope[1] * v
            out.append((g["a_id"].iloc[0], ring, *(p0 + s * u + t * v + z * n), *(m / np.linalg.norm(m)), error + 0.1 * ring * step))
        return pd.DataFrame(out, columns=names)

    return near.groupBy("a_id").applyInPandas(extend, f"seed {kind}, ring int, {', '.join(f'{c} double' for c in (*AXES, *NORMAL, 'uncertainty'))}")


def feature_rescue(df: DataFrame, seeds: DataFrame, voxel: float, k: int = 36, angle_deg: float = 25.0, least: int = 6, most: float = 0.5, id_: str = "id") -> DataFrame:
    """Seeds on sharp features that one of the surfaces meeting there carries: id, families, members, residual, rescued.

    A seed's neighbours fall into families of like normals, largest first; the seed is rescued if there are two or three families of
    ``least`` members or more, its normal belongs to one, and it lies within ``most`` voxels of that family's plane, as 90 % of the members do.
    """
    ship(df.sparkSession)
    kind = dict(seeds.dtypes)[id_]
    side = lambda d, p: d.select(F.col(id_).alias(f"{p}id"), *[F.col(c).alias(f"{p}{c}") for c in (*AXES, *NORMAL)])
    met = knn_join(seeds, df, k, id_, AXES, skip_self=True).select("a_id", "b_id", "rank").join(side(df, "b_"), "b_id").join(side(seeds, "a_"), "a_id")
    names = [id_, "families", "members", "residual", "rescued"]

    def judge(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rank")
        p, n = g[[f"b_{c}" for c in AXES]].to_numpy(float), g[[f"b_{c}" for c in NORMAL]].to_numpy(float)
        p0, n0 = (g[[f"a_{c}" for c in cs]].iloc[0].to_numpy(float) for cs in (AXES, NORMAL))
        left, families = np.ones(len(p), bool), []
        while left.sum() >= least:
            near = (n @ n.T >= np.cos(np.radians(angle_deg))) & left[None] & left[:, None]
            best = near[int(near.sum(1).argmax())]
            if best.sum() < least:
                break
            families.append(best)
            left &= ~best
        mean = [f_n / max(np.linalg.norm(f_n), 1e-12) for f_n in (n[f].mean(0) for f in families)]
        own = max(range(len(mean)), key=lambda i: mean[i] @ n0, default=None)
        if own is None or mean[own] @ n0 < np.cos(np.radians(angle_deg)):
            return pd.DataFrame([(g["a_id"].iloc[0], len(families), 0, None, False)], columns=names)
        c = p[families[own]]
        off = np.abs((c - c.mean(0)) @ mean[own])
        mine = abs(float((p0 - c.mean(0)) @ mean[own]))
        return pd.DataFrame([(g["a_id"].iloc[0], len(families), int(families[own].sum()), mine, 2 <= len(families) <= 3 and mine <= most * voxel and np.quantile(off, 0.9) <= most * voxel)], columns=names)

    return met.groupBy("a_id").applyInPandas(judge, f"{id_} {kind}, families int, members int, residual double, rescued boolean")
