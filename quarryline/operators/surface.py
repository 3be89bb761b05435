"""Cleaning, smoothing, selection and evidence of point clouds. Neighbourhoods come from the grid radius join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip
from ..session import ship
from . import density, near
from .graph import cut, label_nodes
from .joins import knn_join, outlier_filter, radius_filter, radius_join
from .stats import MAD_SIGMA, finite_stats, percentile, quantiles, weighted_median

AXES, NORMAL = ("x", "y", "z"), ("nx", "ny", "nz")


def surface_seeds(df: DataFrame, size: float, angle_deg: float, height: float, weight: str, id_: str = "id") -> DataFrame:
    """The greedy representatives of each voxel: by falling weight, a point joins a seed of similar normal that it lies close to
    on both sides, or becomes a seed of its own (a layer). Voxels of one cloud hold few points."""
    ship(df.sparkSession)
    kind = dict(df.dtypes)[id_]
    keyed = df.select(id_, *AXES, *NORMAL, weight, *[F.floor(F.col(a) / size).cast("bigint").alias(f"k{a}") for a in AXES])
    least = float(np.cos(np.radians(angle_deg)))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([weight, id_], ascending=[False, True])
        p, n, ids = g[list(AXES)].to_numpy(float), g[list(NORMAL)].to_numpy(float), g[id_].to_numpy()
        seeds: list[int] = []
        owner = np.zeros(len(g), int)
        for i in range(len(g)):
            for s in seeds:
                d = p[i] - p[s]
                if n[i] @ n[s] >= least and abs(d @ n[s]) <= height and abs(d @ n[i]) <= height:
                    owner[i] = s
                    break
            else:
                seeds.append(i)
                owner[i] = i
        return pd.DataFrame({"seed": ids[owner], "member": ids})

    return keyed.groupBy("kx", "ky", "kz").applyInPandas(run, f"seed {kind}, member {kind}")


def _heights(df: DataFrame, radius: float, least_dot: float, weight: str, id_: str, probe: DataFrame | None = None) -> DataFrame:
    """Signed heights of compatible neighbours over each point's tangent plane, with spatial, plane and confidence weights."""
    near = radius_join(df if probe is None else probe, df, radius, id_, AXES, carry=(*NORMAL, weight, *AXES)).where("a_id <> b_id")
    d = {x: F.col(f"b_{x}") - F.col(f"a_{x}") for x in AXES}
    dot = F.col("a_nx") * F.col("b_nx") + F.col("a_ny") * F.col("b_ny") + F.col("a_nz") * F.col("b_nz")
    h = d["x"] * F.col("a_nx") + d["y"] * F.col("a_ny") + d["z"] * F.col("a_nz")
    near = near.withColumn("h", h).where(dot >= least_dot)
    w = F.exp(-0.5 * F.pow(F.col("distance") / (0.5 * radius), 2)) * F.exp(-0.5 * F.pow(F.col("h") / (0.25 * radius), 2)) * F.greatest(F.col(f"b_{weight}"), F.lit(0.0))
    return near.select(F.col("a_id").alias(id_), "h", w.alias("w"))


def _median_heights(df: DataFrame, radius: float, least_dot: float, weight: str, id_: str, absolute: bool) -> DataFrame:
    """(id_, median) of ``_heights``. Neighbours of rows that share an id count together; only these rows' pairs are listed."""
    shared = cut(df.groupBy(id_).count().where("count > 1").select(id_))
    if not shared.limit(1).count():
        return near.weighted_median_height(df, radius, least_dot, weight, id_, absolute)
    h = _heights(df, radius, least_dot, weight, id_, df.join(shared, id_, "left_semi"))
    together = weighted_median(h.withColumn("h", F.abs("h")) if absolute else h, [id_], "h", "w")
    return near.weighted_median_height(df, radius, least_dot, weight, id_, absolute, df.join(shared, id_, "left_anti")).unionByName(together)


def local_residual(df: DataFrame, radius: float, weight: str, id_: str = "id", least_dot: float = 0.5) -> DataFrame:
    """Weighted median of neighbours' absolute heights; null without a neighbour."""
    return df.select(id_).join(_median_heights(df, radius, least_dot, weight, id_, True), id_, "left").withColumnRenamed("median", "residual")


def smooth(df: DataFrame, radius: float, weight: str, most: float = 0.2, id_: str = "id", least_dot: float = 0.5) -> DataFrame:
    """Points moved along their normals by the weighted median height, at most ``most``."""
    m = _median_heights(df, radius, least_dot, weight, id_, False).withColumnRenamed("median", "_m")
    step = clip(F.coalesce("_m", F.lit(0.0)), -most, most)
    return df.join(m, id_, "left").withColumns({a: F.col(a) + step * F.col(n) for a, n in zip(AXES, NORMAL, strict=True)}).drop("_m")


def smooth_rounds(df: DataFrame, radius: float, weight: str, rounds: int, most: float = 0.2, id_: str = "id") -> DataFrame:
    for _ in range(rounds):
        df = cut(smooth(df, radius, weight, most, id_))
    return df


def clusters(df: DataFrame, radius: float, least: int, id_: str = "id") -> DataFrame:
    """Density clusters: core points have ``least`` neighbours or more (themselves included); cores within the radius share a
    cluster, and a border point takes its least core neighbour's; noise has null."""
    return density.clusters(df, radius, least, id_, AXES)


def clean_cloud(df: DataFrame, weight: str, k: int = 16, factor: float = 2.0, radius: float = 3.0, least: int = 4, cluster_points: int = 10, share: float = 0.02, id_: str = "id") -> DataFrame:
    """Statistical outliers go, then lone points, then clusters that are small against the largest and weakly supported."""
    kept = cut(outlier_filter(df, k, factor, id_, AXES))
    kept = cut(radius_filter(kept, radius, least, id_, AXES))
    named = cut(clusters(kept, radius, cluster_points, id_).where("cluster is not null").join(kept.select(id_, weight), id_))
    per = named.groupBy("cluster").agg(F.count("*").alias("n"), F.avg(weight).alias("w"))
    best = per.agg(F.max("n").alias("top"), F.avg("w").alias("mean"))
    good = per.crossJoin(F.broadcast(best)).where((F.col("n") >= share * F.col("top")) | (F.col("w") >= F.col("mean"))).select("cluster")  # one row
    return kept.join(named.join(good, "cluster", "left_semi").select(id_), id_, "left_semi")


def component_score(components: DataFrame) -> DataFrame:
    """Evidence of components (n, support, confidence, views, density, distance; all but n in [0, 1]) and whether to keep each."""
    score = 0.15 * F.col("density") + 0.15 * F.col("views") + 0.25 * F.col("support") + 0.20 * F.col("confidence") + 0.25 * F.col("size_share")
    share = F.col("n") / F.max("n").over(Window.partitionBy())  # components of one cloud are few
    return components.withColumn("size_share", share).withColumn("score", score * (1 - 0.5 * F.col("distance"))).withColumn("keep", (F.col("size_share") == 1) | (F.col("score") >= 0.5) | (F.col("support") >= 0.8) & (F.col("n") >= 30))


def foreground(df: DataFrame, depth: str, background: str, spread: str, stereo: dict[str, str], weak: float = 2.0, strong: float = 4.0, pixel: tuple = ("u", "v"), least_strong: int = 4) -> DataFrame:
    """Pixels before the background: residual in 1/z over its deviation, a stereo score, and components of weak pixels
    with ``least_strong`` strong ones or more."""
    sigma = F.greatest(F.col(spread) / (F.col(depth) * F.col(depth)), F.lit(1e-9))
    residual = (1 / F.col(depth) - 1 / F.col(background)) / sigma
    s = {k: F.coalesce(F.col(v), F.lit(0.0)) for k, v in stereo.items()}
    score = (0.30 * s["confidence"] + 0.12 * s["lr"] + 0.20 * s["regional"] + 0.20 * s["sessions"] + 0.18 * s["local"]) * (0.75 + 0.25 * s["gradient"])
    scored = cut(df.withColumn("residual", residual).withColumn("stereo_score", score).where(F.col("residual") >= weak))
    from .consensus import pixel_components

    named = cut(pixel_components(scored, *pixel))
    good = named.join(scored.where(F.col("residual") >= strong).select(*pixel), list(pixel), "left_semi").groupBy("component").count().where(F.col("count") >= least_strong).select("component")
    return scored.join(named.join(good, "component", "left_semi").select(*pixel), list(pixel), "left_semi")


def hierarchical_selection(df: DataFrame, thresholds: list[float], confidence: str, support: str, near: float, least_share: float = 0.6, id_: str = "id") -> DataFrame:
    """Classes 3 (anchors), 2 (extension within ``near`` of an anchor), 1 (other supported points), 0.

    The anchors' threshold is the highest that keeps ``least_share`` of the supported points, or the lowest there is.
    """
    supported = cut(df.where(F.col(support) >= 2))
    scan = supported.withColumn("t", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))).groupBy("t").agg(F.avg((F.col(confidence) >= F.col("t")).cast("int")).alias("share"))
    rows = scan.collect()  # a row for each threshold
    chosen = max([r["t"] for r in rows if r["share"] >= least_share], default=min(thresholds))
    anchors = supported.where(F.col(confidence) >= chosen)
    rest = cut(supported.join(anchors.select(id_), id_, "left_anti"))
    close = knn_join(rest, anchors, 1, id_, AXES).where(F.col("distance") <= near).select(F.col("a_id").alias(id_))
    classes = anchors.select(id_, F.lit(3).alias("class")).unionByName(close.withColumn("class", F.lit(2))).unionByName(rest.join(close, id_, "left_anti").select(id_, F.lit(1).alias("class")))
    return df.select(id_).join(classes, id_, "left").select(id_, F.coalesce("class", F.lit(0)).alias("class"))


def evidence_class(df: DataFrame) -> Column:
    """3: held-out fit validated, pose diversity, little conflict, accepted layer; 2: strong observed; else 0."""
    three = F.col("heldout_ok") & (F.col("diversity") >= 3) & (F.col("conflict_ratio") <= 0.35) & F.col("layer_ok")
    two = (F.col("poses") >= 3) & (F.col("confidence") >= 0.68) & (F.col("agreement") >= 0.68)
    return F.when(F.coalesce(three, F.lit(False)), 3).when(F.coalesce(two, F.lit(False)), 2).otherwise(0)


def independent_patches(df: DataFrame, radius: float, angle_deg: float, least: int, id_: str = "id", k: int = 25) -> DataFrame:
    """Components of the k-nearest graph whose edges are short and of like normals, of ``least`` points or more: id, patch."""
    near = cut(knn_join(df, df, k, id_, AXES, skip_self=True).where(F.col("distance") <= radius).select("a_id", "b_id"))
    n = df.select(id_, *NORMAL)
    met = near.join(n.toDF("a_id", "ax", "ay", "az"), "a_id").join(n.toDF("b_id", "bx", "by", "bz"), "b_id")
    ok = met.where(F.col("ax") * F.col("bx") + F.col("ay") * F.col("by") + F.col("az") * F.col("bz") >= float(np.cos(np.radians(angle_deg)))).select(F.col("a_id").alias("u"), F.col("b_id").alias("v"))
    named = cut(label_nodes(df, ok, id_))
    large = named.groupBy("component").count().where(F.col("count") >= least).select("component")
    return named.join(large, "component", "left_semi").select(id_, F.col("component").alias("patch"))


def static_hypothesis(points: DataFrame, poses: int, reach: int, gate: float, share: float, id_: str = "id", pose: str = "pose", cam: tuple = ("cx", "cy", "cz"), obj: tuple = AXES) -> DataFrame:
    """Points that stay put in camera frames of neighbouring poses rather than in the object's go, at most ``share`` of a pose."""
    from .sampling import capped_removal

    def hits(axes: tuple) -> DataFrame:
        pts = points.select(id_, pose, *[F.col(c).alias(a) for c, a in zip(axes, AXES, strict=True)])
        near = radius_join(pts, pts, gate, id_, AXES, carry=(pose,))
        gap = F.least(F.abs(F.col(f"a_{pose}") - F.col(f"b_{pose}")), poses - F.abs(F.col(f"a_{pose}") - F.col(f"b_{pose}")))
        return near.where(gap.between(1, reach)).groupBy(F.col("a_id").alias(id_)).agg(F.countDistinct(f"b_{pose}").alias("n"))

    both = points.join(hits(cam).withColumnRenamed("n", "still"), id_, "left").join(hits(obj).withColumnRenamed("n", "turning"), id_, "left").fillna(0, ["still", "turning"])
    flagged = both.withColumn("flag", F.col("still") > F.col("turning")).withColumn("excess", F.col("still") - F.col("turning"))
    return capped_removal(flagged, "flag", "excess", id_, [pose], share).drop("still", "turning", "flag", "excess")


def noise_scales(df: DataFrame, floors: dict[str, float], stable: str) -> DataFrame:
    """1.4826 MAD of each channel on stable pixels, at least its floor: one row, a column for each channel."""
    out = None
    for c, floor in floors.items():
        s = finite_stats(df.where(stable), [], c, {}).select(F.greatest(F.lit(floor), F.coalesce(MAD_SIGMA * F.col("mad"), F.lit(0.0))).alias(c))
        out = s if out is None else out.crossJoin(s)  # one row each
    return out


def visual_evidence(df: DataFrame, scales: DataFrame, weak: float = 2.5, strong: float = 5.0) -> DataFrame:
    """Scores of pixels (dl, da, db, dgrad: differences from the background) in noise deviations, and their masks."""
    s = df.crossJoin(F.broadcast(scales.select(*[F.col(c).alias(f"s_{c}") for c in ("dl", "da", "db", "dgrad")])))  # one row
    z = {c: F.abs(F.col(c)) / F.col(f"s_{c}") for c in ("dl", "da", "db", "dgrad")}
    chroma = F.sqrt(z["da"] * z["da"] + z["db"] * z["db"])
    shadow = (F.col("dl") < 0) & (chroma < 1.5) & (z["dgrad"] < 1.5)
    out = s.withColumn("score", 1.05 * chroma + 0.42 * z["dl"] + 0.52 * z["dgrad"]).withColumn("shadow", shadow)
    return out.withColumn("weak", (F.col("score") >= weak) & ~F.col("shadow")).withColumn("strong", (F.col("score") >= strong) & ~F.col("shadow")).select(*df.columns, "score", "shadow", "weak", "strong")


def pixel_hysteresis(weak: DataFrame, strong: DataFrame, u: str = "u", v: str = "v", shadow: DataFrame | None = None) -> DataFrame:
    """Weak pixels whose component holds a strong pixel outside the shadow."""
    from .consensus import pixel_components

    seeds = strong if shadow is None else strong.join(shadow, [u, v], "left_anti")
    named = cut(pixel_components(weak, u, v))
    hit = named.join(seeds.select(u, v), [u, v], "left_semi").select("component").distinct()
    return named.join(hit, "component", "left_semi").select(u, v)


def inconsistent_pairs(boundary: DataFrame, jump: float, gradient: float) -> DataFrame:
    """Pairs of regions (a, b, jump, gradient, quality_a, quality_b by boundary pixel) whose models part without an image edge;
    the weaker model is blocked."""
    p = boundary.groupBy("a", "b").agg(percentile("jump", 0.5).alias("jump"), percentile("gradient", 0.5).alias("gradient"), F.first("quality_a").alias("qa"), F.first("quality_b").alias("qb"))
    bad = (F.col("jump") > jump) & (F.col("gradient") < gradient)
    return p.withColumn("blocked", F.when(bad, F.when(F.col("qa") < F.col("qb"), F.col("a")).otherwise(F.col("b"))))


def fill_from_neighbors(missing: DataFrame, models: DataFrame, links: DataFrame, spread: float = 6.0, least: int = 2) -> DataFrame:
    """Pixels of regions without a model (region, u, v) take the median of ``least`` or more neighbours' models (region, a, b, c)
    over links (region, other), where these agree within ``spread`` (one pass)."""
    m = models.select(F.col("region").alias("other"), "a", "b", "c")
    made = missing.join(links, "region").join(m, "other").withColumn("d", F.col("a") * F.col("u") + F.col("b") * F.col("v") + F.col("c"))
    s = made.groupBy("region", "u", "v").agg(F.count("*").alias("n"), percentile("d", 0.5).alias("disparity"), (F.max("d") - F.min("d")).alias("gap"))
    return s.where((F.col("n") >= least) & (F.col("gap") <= spread)).select("region", "u", "v", "disparity")


def local_patches(df: DataFrame, seeds: DataFrame, radius: float, id_: str = "id", pose: str = "pose", most: int = 12, least: int = 8, vote: float = 0.5) -> DataFrame:
    """A robust quadratic patch for each seed over at most ``most`` nearest points of every pose, with the error of poses left
    out in turn and how many of these keep within ``vote`` of the others' fit: id, height, slope_u, slope_v, rmse, held_out, poses, passed, tested."""
    from .fitting import held_out_error, held_out_votes, irls, quadratic_design
    from .joins import per_seed_nearest

    ship(df.sparkSession)
    near = per_seed_nearest(radius_join(seeds, df.withColumns({n: F.lit(0.0) for n in NORMAL if n not in df.columns}), radius, id_, AXES, carry=(*NORMAL, pose, *AXES)), ["a_id", f"b_{pose}"], most)
    kind, names = dict(seeds.dtypes)[id_], [id_, "height", "slope_u", "slope_v", "rmse", "held_out", "poses", "passed", "tested"]

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        n = g[[f"a_{c}" for c in NORMAL]].iloc[0].to_numpy(float)
        side = np.eye(3)[int(np.argmin(np.abs(n)))]
        a = side - n * (side @ n)
        a = a / max(np.linalg.norm(a), 1e-12)
        d = g[[f"b_{c}" for c in AXES]].to_numpy(float) - g[[f"a_{c}" for c in AXES]].to_numpy(float)
        q, t, folds = quadratic_design(d @ a, d @ np.cross(n, a)), d @ n, g[f"b_{pose}"].to_numpy()
        if len(g) < least:
            return pd.DataFrame(columns=names)
        beta = irls(q, t, np.ones(len(t)))
        return pd.DataFrame([[g["a_id"].iloc[0], beta[5], beta[3], beta[4], float(np.sqrt(np.mean((t - q @ beta) ** 2))), held_out_error(q, t, folds), len(set(folds)), *held_out_votes(q, t, folds, np.ones(len(t)), vote)]], columns=names)

    return near.groupBy("a_id").applyInPandas(fit, f"{id_} {kind}, height double, slope_u double, slope_v double, rmse double, held_out double, poses long, passed long, tested long")


def scale_guard(original: DataFrame, moved: DataFrame, least_ratio: float, rounds: int = 6, id_: str = "id") -> tuple[float, DataFrame]:
    """The largest share of a move that keeps the median spacing at ``least_ratio`` of the original, by bisection."""
    joined = original.select(id_, *AXES).join(moved.select(id_, *[F.col(a).alias(f"m{a}") for a in AXES]), id_)
    at = lambda f: joined.select(id_, *[(F.col(a) + f * (F.col(f"m{a}") - F.col(a))).alias(a) for a in AXES])
    spacing = lambda df: next((r["m"] for r in quantiles(knn_join(df, df, 1, id_, AXES, skip_self=True), [], "distance", {"m": 0.5}).collect()), 0.0)
    first = spacing(original)
    lo, hi = 0.0, 1.0
    if spacing(at(1.0)) >= least_ratio * first:
        return 1.0, at(1.0)
    for _ in range(rounds):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if spacing(at(mid)) >= least_ratio * first else (lo, mid)
    return lo, at(lo)



def supported_samples(df: DataFrame, strong: Column, radius: float, factor: float = 3.0, floor: float = 0.9, weight: str = "w", id_: str = "id") -> DataFrame:
    """Points that stand off their neighbours' surface near strong points go, worst first, but ``floor`` of all stay."""
    res = cut(local_residual(df, radius, weight, id_))
    scale = quantiles(res, [], "residual", {"m": 0.5})
    near = radius_join(df.where(~strong), df.where(strong), radius, id_, AXES).select(F.col("a_id").alias(id_)).distinct().withColumn("near", F.lit(True))
    flagged = df.join(res, id_).join(near, id_, "left").crossJoin(F.broadcast(scale)).withColumn("flag", F.coalesce(F.col("near") & (F.col("residual") > factor * F.col("m")), F.lit(False)))  # one row
    from .sampling import capped_removal

    return capped_removal(flagged.withColumn("one", F.lit(1)), "flag", "residual", id_, ["one"], 1 - floor).select(*df.columns)


def components_near_anchor(pixels: DataFrame, anchor: tuple, most_gap: float, least_share: float = 0.05, u: str = "u", v: str = "v") -> DataFrame:
    """Pixels of mask components that overlap or lie near an anchor box (left, top, right, bottom), largest and closest first:
    score = area share * exp(-gap / most_gap), kept from ``least_share`` of the best."""
    from .consensus import pixel_components

    named = cut(pixel_components(pixels, u, v))
    boxes = named.groupBy("component").agg(F.count("*").alias("n"), F.min(u).alias("l"), F.min(v).alias("t"), (F.max(u) + 1).alias("r"), (F.max(v) + 1).alias("b"))
    left, top, right, bottom = map(F.lit, anchor)
    gap = F.hypot(F.greatest(F.lit(0), F.col("l") - right, left - F.col("r")), F.greatest(F.lit(0), F.col("t") - bottom, top - F.col("b")))
    scored = boxes.withColumn("gap", gap).where(F.col("gap") <= most_gap).withColumn("score", F.col("n") * F.exp(-F.col("gap") / most_gap))
    best = scored.agg(F.max("score").alias("best"))
    good = scored.crossJoin(F.broadcast(best)).where(F.col("score") >= least_share * F.col("best")).select("component")  # one row
    return named.join(good, "component", "left_semi").select(u, v)


def region_report(points: DataFrame, region: str, status: str, value: str) -> DataFrame:
    """Status counts and finite statistics of each region."""
    counts = points.groupBy(region).pivot(status).count()
    return counts.join(finite_stats(points, [region], value), region)


def orient_normals(df: DataFrame, k: int = 8, id_: str = "id") -> DataFrame:
    """Normals with signs that agree along the spanning forest of nearest neighbours whose normals differ least (1 - |cos|), each
    tree pointing away from its median."""
    from .graph import parity, spanning_forest

    near = cut(knn_join(df, df, k, id_, AXES, skip_self=True).select("a_id", "b_id"))
    n = df.select(id_, *NORMAL)
    met = near.join(n.toDF("a_id", "ax", "ay", "az"), "a_id").join(n.toDF("b_id", "bx", "by", "bz"), "b_id")
    dot = F.col("ax") * F.col("bx") + F.col("ay") * F.col("by") + F.col("az") * F.col("bz")
    tree = spanning_forest(met.select(F.col("a_id").alias("u"), F.col("b_id").alias("v"), (1 - F.abs(dot)).alias("w"))).select("u", "v")
    ends = tree.join(n.toDF("u", "ax", "ay", "az"), "u").join(n.toDF("v", "bx", "by", "bz"), "v")
    tree = cut(ends.select("u", "v", (dot < 0).cast("int").alias("flip")))
    signs = parity(df, tree, id_).select(id_, F.when(F.col("label") == 1, -1.0).otherwise(1.0).alias("_s"))
    turned = df.join(signs, id_).withColumns({c: F.col(c) * F.col("_s") for c in NORMAL}).join(label_nodes(df, tree.select("u", "v"), id_).withColumnRenamed("component", "_t"), id_)
    out = turned
    for a in AXES:
        out = out.join(quantiles(turned, ["_t"], a, {f"_{a}": 0.5}), "_t")
    out = out.withColumn("_v", sum((F.col(n_) * (F.col(a) - F.col(f"_{a}")) for a, n_ in zip(AXES[1:], NORMAL[1:], strict=True)), F.col("nx") * (F.col("x") - F.col("_x"))))
    side = quantiles(out, ["_t"], "_v", {"_m": 0.5}).select("_t", F.when(F.col("_m") < 0, -1.0).otherwise(1.0).alias("_g"))
    return out.join(side, "_t").withColumns({c: F.col(c) * F.col("_g") for c in NORMAL}).select(*df.columns)


def coherence(df: DataFrame, seeds: DataFrame, voxel: float, small: int = 18, large: int = 36, least: int = 10, uncertainty: str = "uncertainty", id_: str = "id") -> DataFrame:
    """How well a seed's two neighbourhoods make one surface: id, flags (of six), accept (fewer than three; too few neighbours
    accept), strict (at most one)."""
    ship(df.sparkSession)
    kind = dict(seeds.dtypes)[id_]
    near = knn_join(seeds, df, large, id_, AXES, skip_self=True)
    info = df.select(F.col(id_).alias("b_id"), *[F.col(c).alias(f"b_{c}") for c in (*AXES, *NORMAL, uncertainty)])
    own = seeds.select(F.col(id_).alias("a_id"), *[F.col(c).alias(f"a_{c}") for c in (*AXES, *NORMAL, uncertainty)])
    wide = near.join(info, "b_id").join(own, "a_id")

    def judge(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rank")
        if len(g) < least:
            return pd.DataFrame({id_: [g["a_id"].iloc[0]], "flags": [0], "accept": [True], "strict": [False]})
        p, n = g[[f"b_{c}" for c in AXES]].to_numpy(float), g[[f"b_{c}" for c in NORMAL]].to_numpy(float)
        p0, n0 = g[[f"a_{c}" for c in AXES]].iloc[0].to_numpy(float), g[[f"a_{c}" for c in NORMAL]].iloc[0].to_numpy(float)
        u0 = g[f"a_{uncertainty}"].iloc[0]
        u0 = u0 if u0 and np.isfinite(u0) and u0 > 0 else 0.25 * voxel
        u = g[f"b_{uncertainty}"].to_numpy(float)
        u = np.where(np.isfinite(u) & (u > 0), u, u0)

        def patch(q):
            x = q - q.mean(0)
            values, vectors = np.linalg.eigh(x.T @ x / len(q))
            return np.percentile(np.abs(x @ vectors[:, 0]), 90), vectors[:, 0], values[0] / max(values.sum(), 1e-12)

        near_p90, near_n, _ = patch(p[:small])
        far_p90, far_n, variation = patch(p)
        angle = np.degrees(np.arccos(np.clip(np.abs(n @ n0), 0, 1)))
        mean = n + n0
        mean = mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)
        sheet = (angle <= 32) & (np.abs(((p - p0) * mean).sum(1)) <= np.clip(1.5 * np.minimum(u0, u), 0.18 * voxel, 0.5 * voxel))
        turn = np.degrees(np.arccos(np.clip(abs(near_n @ far_n), 0, 1)))
        flags = int(near_p90 > max(0.55 * voxel, 1.75 * u0)) + int(far_p90 > max(0.8 * voxel, 2.2 * u0)) + int(np.percentile(angle, 90) > 42) + int(turn > 25) + int(variation > 0.16) + int(sheet.mean() < 0.3)
        return pd.DataFrame({id_: [g["a_id"].iloc[0]], "flags": [flags], "accept": [flags < 3], "strict": [flags <= 1]})

    return wide.groupBy("a_id").applyInPandas(judge, f"{id_} {kind}, flags int, accept boolean, strict boolean")


def recover_coverage(df: DataFrame, kept: DataFrame, size: float, confidence: str, least: float, reach: float, id_: str = "id") -> DataFrame:
    """``kept`` and, for each empty cell, its most confident candidate of confidence ``least`` or more within ``reach`` of a kept point."""
    keys = [F.floor(F.col(a) / size).cast("bigint").alias(f"k{a}") for a in AXES]
    held = kept.select(*keys).distinct()
    cand = df.join(kept.select(id_), id_, "left_anti").where(F.col(confidence) >= least).select("*", *keys).join(held, ["kx", "ky", "kz"], "left_anti")
    best = cand.groupBy("kx", "ky", "kz").agg(F.max_by(id_, F.struct(confidence, (-F.col(id_)).alias("first"))).alias(id_)).select(id_)
    points = df.join(best, id_, "left_semi")
    near = knn_join(points, kept, 1, id_, AXES).where(F.col("distance") <= reach).select(F.col("a_id").alias(id_))
    return kept.unionByName(points.join(near, id_, "left_semi").select(*kept.columns))
