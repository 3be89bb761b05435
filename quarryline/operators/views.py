"""Validation of stereo views by regions: from pixel rows to depth, with the source of every pixel that has one.

``pixels`` has a row for each pixel of each view: view, u, v, region, inside (the object's silhouette), usable (rectified),
disparity, confidence, state (of the match, scalar.match_state) and gradient (of the image). Everything but the fit is column
expressions, windows and joins; a fit is one small group, a region of one view.

A pixel's ``source``: 1 strict observation without a model, 2 observation that the region's model explains, 3 gap near support filled
by the region's model, 5 member of a region's observed consensus, 6 ambiguous but coherent observation, 7 gap filled by neighbouring
regions' models, 8 one-sided match, 9 weak state that model and neighbours confirm, 0 none. A pixel inside without one has a
``loss``: 1 nothing observed, 3 contradicted, 4 model out of range, 6 not part of any consensus.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import adaptive_tolerance, affine, centred_pixel, clip, is_finite
from ..session import ship
from .fitting import irls
from .gates import ladder
from .graph import cut
from .stats import quantiles
from .surface import inconsistent_pairs

REGION = ["view", "region"]


@dataclass(frozen=True)
class Rules:
    """Fixed values of the validation, in pixels unless said otherwise."""

    least_disparity: float = 1.0
    most_disparity: float = 1500.0
    seed_confidence: float = 0.62
    seeds: int = 24
    seed_share: float = 0.035
    region_area: int = 35
    adaptive_confidence: float = 0.35
    adaptive_percentile: float = 70.0
    draws: int = 900
    inlier_distance: float = 3.5
    inlier_share: float = 0.62
    plane_rmse: float = 3.2
    plane_mad: float = 2.4
    consensus_confidence: float = 0.30
    consensus_count: int = 12
    consensus_mad: float = 3.5
    consensus_rmse: float = 5.5
    consensus_sigma: float = 3.0
    consensus_tolerance: tuple = (3.0, 8.0)
    window: int = 11
    neighbors: int = 8
    local_sigma: float = 3.25
    local_tolerance: tuple = (3.5, 12.0)
    model_tolerance: tuple = (6.0, 12.0)
    model_factor: float = 2.75
    hard_model: float = 1.85
    hard_local: float = 1.65
    extreme_model: float = 3.0
    absolute_outlier: float = 24.0
    alone_confidence: float = 0.18
    gap_distance: float = 24.3
    neighbor_models: int = 2
    neighbor_spread: float = 6.0
    neighbor_gradient: float = 28.0
    neighbor_boundary: int = 6
    passes: int = 2
    jump: float = 10.0
    jump_gradient: float = 30.0
    jump_boundary: int = 8
    coverage: tuple = (0.20, 0.98)


def observations(pixels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``pixels`` with what may be used of them: physical, eligible (of a matched state) and strict (also confident)."""
    physical = F.col("inside") & F.col("usable") & is_finite("disparity") & is_finite("confidence") & F.col("disparity").between(rules.least_disparity, rules.most_disparity)
    out = pixels.withColumn("physical", F.coalesce(physical, F.lit(False)))
    out = out.withColumn("eligible", F.col("physical") & F.col("state").isin(1, 2, 3))
    return out.withColumn("strict", F.col("eligible") & F.col("state").isin(1, 2) & (F.col("confidence") >= rules.seed_confidence))


def local_statistics(pixels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``pixels`` with the weighted mean and scale of eligible neighbours in a square window, the pixel itself left out, or null.

    The box sums are two windows, along rows and then along columns, so every pixel of a view needs its row.
    """
    half = rules.window // 2
    w = F.when(F.col("eligible"), clip(F.col("confidence"), 0.08, 1.0)).otherwise(0.0)
    d = F.when(F.col("eligible"), F.col("disparity").cast("double")).otherwise(0.0)
    own = {"_w": w, "_d": w * d, "_q": w * d * d, "_n": F.col("eligible").cast("int")}
    out = pixels.withColumns(own)
    for line, along in (("v", "u"), ("u", "v")):
        box = Window.partitionBy("view", line).orderBy(along).rangeBetween(-half, half)
        out = out.withColumns({f"{c}s": F.sum(f"{c}s" if line == "u" else c).over(box) for c in own})
    rest = {c: F.col(f"{c}s") - F.col(c) for c in own}
    enough = (rest["_n"] >= rules.neighbors) & (rest["_w"] > 1e-5)
    mean = rest["_d"] / rest["_w"]
    spread = F.sqrt(F.greatest(rest["_q"] / rest["_w"] - mean * mean, F.lit(0.0)))
    return out.withColumns({"local_mean": F.when(enough, mean), "local_scale": F.when(enough, spread)}).drop(*own, *[f"{c}s" for c in own])


def _weighted(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    root = np.sqrt(w)
    return np.linalg.lstsq(x * root[:, None], y * root, rcond=None)[0]


def _consensus_plane(x: np.ndarray, y: np.ndarray, w: np.ndarray, rules: Rules, rng) -> np.ndarray | None:
    """The inliers of the plane through three points, drawn by confidence, that most points agree with."""
    p = np.maximum(w, 1e-4)
    best = (0, -np.inf, None)
    for _ in range(rules.draws):
        some = rng.choice(len(y), 3, replace=False, p=p / p.sum())
        if abs(np.linalg.det(x[some])) < 1e-12:
            continue
        off = np.abs(y - x @ np.linalg.solve(x[some], y[some]))
        near = off <= rules.inlier_distance
        if near.sum() >= 3 and (key := (int(near.sum()), -float(np.median(off[near])))) > best[:2]:
            best = (*key, near)
    return best[2] if best[0] >= rules.inlier_share * len(y) else None


def _plane(x: np.ndarray, y: np.ndarray, w: np.ndarray, rules: Rules, seed: int) -> dict | None:
    """Coefficients, mad and rmse of a region's plane, or nothing if too few seeds agree with one."""
    if len(y) < rules.seeds or (near := _consensus_plane(x, y, w, rules, np.random.default_rng(seed))) is None:
        return None
    beta = irls(x[near], y[near], w[near], smallest=0.5)
    off = np.abs(y - x @ beta)
    within = off <= rules.inlier_distance
    if within.sum() < max(3, rules.inlier_share * len(y)):
        return None
    rmse, mad = float(np.sqrt(np.mean(off[within] ** 2))), float(np.median(off[within]))
    return {"a": beta[0], "b": beta[1], "c": beta[2], "rmse": rmse, "mad": mad, "inliers": int(within.sum())} if rmse <= rules.plane_rmse and mad <= rules.plane_mad else None


def _observed_plane(x: np.ndarray, y: np.ndarray, w: np.ndarray, rules: Rules) -> dict | None:
    """The plane that observations without a model keep to, with how far from it they may lie."""
    if len(y) < rules.consensus_count:
        return None
    beta = irls(x, y, np.maximum(w, 1e-4), rounds=15, smallest=0.75)
    off = np.abs(y - x @ beta)
    tolerance = float(np.clip(rules.consensus_sigma * max(0.75, 1.4826 * float(np.median(off))), *rules.consensus_tolerance))
    near = off <= tolerance
    compact = near.sum() >= rules.consensus_count and np.median(off[near]) <= rules.consensus_mad and np.sqrt(np.mean(off[near] ** 2)) <= rules.consensus_rmse
    return {"a": beta[0], "b": beta[1], "c": beta[2], "tolerance": tolerance} if compact else None


MODEL = "mode string, a double, b double, c double, rmse double, mad double, tolerance double, inliers long, area long, strict_seeds long"


def region_models(observed: DataFrame, width: int, height: int, rules: Rules = Rules()) -> DataFrame:
    """A row for each region of each view: mode strict or adaptive (a plane fitted on such seeds), observed (a consensus only) or none.

    Adaptive seeds are the region's own most confident ones, where strict seeds are too few or agree with no plane.
    """
    ship(observed.sparkSession)
    un, vn = centred_pixel("u", "v", width, height)
    rows = observed.where("inside").select(*REGION, "u", "v", un.alias("un"), vn.alias("vn"), "disparity", "confidence", "eligible", "strict")
    head = ", ".join(f"{k} {dict(observed.dtypes)[k]}" for k in REGION)
    names = [x.split()[0] for x in f"{head}, {MODEL}".split(", ")]

    def run(name: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["v", "u"])
        x = np.c_[g["un"], g["vn"], np.ones(len(g))].astype(float)
        y, w, eligible, strict = (g[c].to_numpy() for c in ("disparity", "confidence", "eligible", "strict"))
        least = max(rules.seeds, int(np.ceil(len(g) * rules.seed_share)))
        row = dict(zip(REGION, name, strict=True)) | {"mode": "none", "area": len(g), "strict_seeds": int(strict.sum())}
        seed = zlib.crc32(repr(name).encode())
        found = None
        if len(g) >= rules.region_area:
            if strict.sum() >= least:
                found, mode = _plane(x[strict], y[strict].astype(float), w[strict].astype(float), rules, seed), "strict"
            if found is None and eligible.any():
                level = np.percentile(w[eligible].astype(float), rules.adaptive_percentile)
                some = eligible & (w >= min(rules.seed_confidence, max(rules.adaptive_confidence, level)))
                if some.sum() >= least:
                    found, mode = _plane(x[some], y[some].astype(float), w[some].astype(float), rules, seed + 1), "adaptive"
        if found is None:
            some = eligible & (w >= rules.consensus_confidence)
            found, mode = _observed_plane(x[some], y[some].astype(float), w[some].astype(float), rules), "observed"
        return pd.DataFrame([row | (found | {"mode": mode} if found else {})], columns=names)

    return rows.groupBy(*REGION).applyInPandas(run, f"{head}, {MODEL}")


def _borders(observed: DataFrame) -> DataFrame:
    """Pixels beside a pixel of another region, to the right or below, with both regions and the greater gradient."""
    here = observed.where("inside").select("view", "u", "v", F.col("region").alias("a"), F.col("gradient").alias("g"))
    steps = here.withColumn("d", F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((1, 0), (0, 1))])))
    there = here.select("view", F.col("u").alias("u2"), F.col("v").alias("v2"), F.col("a").alias("b"), F.col("g").alias("g2"))
    met = steps.withColumns({"u2": F.col("u") + F.col("d.x"), "v2": F.col("v") + F.col("d.y")}).join(there, ["view", "u2", "v2"]).where("a <> b")
    return met.select("view", "u", "v", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.greatest("g", "g2").alias("gradient"))


def _predict(models: DataFrame, prefix: str, width: int, height: int) -> Column:
    return affine(tuple(F.col(f"{prefix}{c}") for c in "abc"), *centred_pixel("u", "v", width, height))


def blocked_regions(borders: DataFrame, models: DataFrame, width: int, height: int, rules: Rules = Rules()) -> DataFrame:
    """Regions (view, region) whose model parts from a better neighbour's without an edge in the image; they fill no gaps."""
    m = models.where(F.col("mode").isin("strict", "adaptive"))
    side = lambda n: m.select("view", F.col("region").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in ("a", "b", "c")], (F.col("inliers") / (1.0 + F.col("rmse"))).alias(f"quality_{n}"))
    met = borders.join(side("a"), ["view", "a"]).join(side("b"), ["view", "b"])
    jump = F.abs(_predict(m, "a_", width, height) - _predict(m, "b_", width, height))
    pairs = F.struct("view", F.col("a").alias("region")), F.struct("view", F.col("b").alias("region"))
    rows = met.select(pairs[0].alias("a"), pairs[1].alias("b"), jump.alias("jump"), "gradient", "quality_a", "quality_b")
    wide = rows.join(rows.groupBy("a", "b").count().where(F.col("count") >= rules.jump_boundary).select("a", "b"), ["a", "b"], "left_semi")
    return inconsistent_pairs(wide, rules.jump, rules.jump_gradient).where("blocked is not null").select("blocked.*").distinct()


def _near_support(missing: DataFrame, support: DataFrame, reach: float) -> DataFrame:
    """Missing pixels with a supported pixel of their own region within ``reach``."""
    cell = [F.floor(F.col(c) / reach).cast("int").alias(f"c{c}") for c in "uv"]
    around = F.array(*[F.struct(F.lit(i).alias("x"), F.lit(j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    m = missing.select(*REGION, "u", "v", *cell).withColumn("o", F.explode(around)).withColumns({"cu": F.col("cu") + F.col("o.x"), "cv": F.col("cv") + F.col("o.y")})
    s = support.select(*REGION, F.col("u").alias("su"), F.col("v").alias("sv"), *cell)
    met = m.join(s, [*REGION, "cu", "cv"]).where((F.col("u") - F.col("su")) ** 2 + (F.col("v") - F.col("sv")) ** 2 <= reach * reach)
    return met.select(*REGION, "u", "v").distinct()


def classify(observed: DataFrame, models: DataFrame, blocked: DataFrame, width: int, height: int, rules: Rules = Rules()) -> DataFrame:
    """``observed`` (with local statistics) with model and neighbour evidence, source, loss and the disparity that is kept."""
    rows = observed.where("inside").join(models.drop("area", "strict_seeds", "inliers"), REGION, "left").join(blocked.withColumn("blocked", F.lit(True)), REGION, "left")
    modelled = F.col("mode").isin("strict", "adaptive")
    rows = rows.withColumn("predicted", F.when(F.col("mode") != "none", _predict(models, "", width, height)))
    rows = rows.withColumns({"plausible": F.coalesce(modelled & F.col("predicted").between(rules.least_disparity, rules.most_disparity), F.lit(False)), "off": F.abs(F.col("disparity") - F.col("predicted"))})
    none = rows.groupBy(*REGION).agg((~F.bool_or("plausible")).alias("unusable"))
    rows = rows.join(none, REGION)
    tolerance = adaptive_tolerance(*rules.model_tolerance, F.col("mad"), F.col("rmse"), rules.model_factor)
    local = F.col("local_mean").isNotNull()
    local_off = F.abs(F.col("disparity") - F.col("local_mean"))
    local_tolerance = clip(rules.local_sigma * F.greatest(F.col("local_scale"), F.lit(0.75)), *rules.local_tolerance)
    truth = lambda c: F.coalesce(c, F.lit(False))
    rows = rows.withColumns({
        "model_good": truth(F.col("plausible") & (F.col("off") <= tolerance)), "local_good": truth(local & (local_off <= local_tolerance)),
        "model_bad": truth(~F.col("plausible") | (F.col("off") > rules.hard_model * tolerance)), "local_bad": truth(local & (local_off > rules.hard_local * local_tolerance)),
        "extreme": truth(F.col("off") > F.greatest(rules.extreme_model * tolerance, F.lit(rules.absolute_outlier))), "alone": ~local,
        "fits_consensus": truth((F.col("mode") == "observed") & (F.col("confidence") >= rules.consensus_confidence) & (F.col("off") <= F.col("tolerance"))),
    })
    sure = F.col("confidence") >= rules.alone_confidence
    outlier = (F.col("model_bad") & (F.col("local_bad") | F.col("alone") & ~sure)) | (F.col("extreme") & ~(F.col("local_good") & (F.col("confidence") >= rules.seed_confidence)))
    kept_by_model = F.col("eligible") & ~outlier
    confirmed = F.col("physical") & (F.col("state") == 5) & F.col("model_good") & F.col("local_good") & sure
    coherent = F.col("eligible") & (F.col("local_good") | F.col("alone") & sure)
    with_model = modelled & ~F.col("unusable")
    one_sided = F.col("state") == 3
    source = F.when(with_model, F.when(confirmed, 9).when(kept_by_model, F.when(one_sided, 8).when(F.col("model_good"), 2).otherwise(6)).otherwise(0)).otherwise(
        F.when(F.col("strict"), 1).when(F.col("fits_consensus") & F.col("eligible"), 5).when(coherent, F.when(one_sided, 8).otherwise(6)).otherwise(0))
    rows = cut(rows.withColumn("with_model", truth(with_model)).withColumn("source", truth_int(source)))
    gaps = rows.where("with_model and not physical and plausible and blocked is null")
    filled = _near_support(gaps, rows.where("with_model and source > 0"), rules.gap_distance).withColumn("filled", F.lit(True))
    rows = rows.join(filled, [*REGION, "u", "v"], "left").withColumn("source", F.when(F.col("filled"), 3).otherwise(F.col("source")))
    loss = F.when(F.col("source") > 0, 0).when(F.col("with_model"), F.when(~F.col("physical"), F.when(F.col("plausible"), 1).otherwise(4)).otherwise(3)).when(F.col("eligible"), F.when(modelled, 4).otherwise(6)).otherwise(1)
    value = F.when(F.col("source") == 3, F.col("predicted")).when(F.col("source") > 0, F.col("disparity").cast("double"))
    return cut(rows.withColumns({"loss": loss, "value": value}).select("view", "region", "u", "v", "physical", "eligible", "mode", "source", "loss", "value"))


def truth_int(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast("int")


def fill_across(classified: DataFrame, borders: DataFrame, models: DataFrame, blocked: DataFrame, width: int, height: int, rules: Rules = Rules()) -> DataFrame:
    """Gaps without any observation take the median of the models of neighbours, over soft borders, where enough of them agree.

    A second pass looks one region further, through those that the pass before reached.
    """
    usable = models.where(F.col("mode").isin("strict", "adaptive")).join(blocked, REGION, "left_anti").select("view", F.col("region").alias("other"), F.col("a").alias("m_a"), F.col("b").alias("m_b"), F.col("c").alias("m_c"))
    soft = borders.groupBy("view", "a", "b").agg(F.count("*").alias("n"), F.expr("percentile(gradient, 0.5)").alias("g")).where((F.col("n") >= rules.neighbor_boundary) & (F.col("g") <= rules.neighbor_gradient))
    links = cut(soft.select("view", F.col("a").alias("region"), F.col("b").alias("other")).unionByName(soft.select("view", F.col("b").alias("region"), F.col("a").alias("other"))))
    out, reach = classified, links
    for k in range(rules.passes):
        if k:
            further = reach.join(links.select("view", F.col("region").alias("other"), F.col("other").alias("next")), ["view", "other"]).select("view", "region", F.col("next").alias("other"))
            reach = cut(reach.unionByName(further).where("region <> other").distinct())
        gaps = out.where("source = 0 and not physical").select("view", "region", "u", "v")
        made = gaps.join(reach, REGION).join(usable, ["view", "other"]).withColumn("d", _predict(models, "m_", width, height)).where(F.col("d").between(rules.least_disparity, rules.most_disparity))
        found = made.groupBy("view", "region", "u", "v").agg(F.count("*").alias("n"), F.expr("percentile(d, 0.5)").alias("across"), (F.max("d") - F.min("d")).alias("gap"))  # a few neighbours each
        found = found.where((F.col("n") >= rules.neighbor_models) & (F.col("gap") <= rules.neighbor_spread)).select("view", "region", "u", "v", "across")
        hit = F.col("across").isNotNull()
        out = out.join(found, ["view", "region", "u", "v"], "left").withColumns({"source": F.when(hit, 7).otherwise(F.col("source")), "loss": F.when(hit, 0).otherwise(F.col("loss")), "value": F.coalesce("value", "across")}).drop("across")
        out = cut(out)
    return out


def validate_views(pixels: DataFrame, width: int, height: int, focal: float, baseline: float, rules: Rules = Rules()) -> DataFrame:
    """The pixels inside each view's silhouette with source, loss, kept disparity (value) and depth."""
    observed = cut(local_statistics(observations(pixels, rules), rules))
    models, borders = cut(region_models(observed, width, height, rules)), cut(_borders(observed))
    blocked = cut(blocked_regions(borders, models, width, height, rules))
    out = fill_across(classify(observed, models, blocked, width, height, rules), borders, models, blocked, width, height, rules)
    return out.withColumn("depth", F.when(F.col("value").between(rules.least_disparity, rules.most_disparity), focal * baseline / F.col("value")))


def view_report(validated: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """A row for each view: pixels inside, with depth and by source, share, median depth, and a verdict with its reasons."""
    counts = validated.groupBy("view").agg(F.count("*").alias("inside"), F.count("depth").alias("valid"), *[F.count_if(F.col("source") == s).alias(f"source_{s}") for s in (1, 2, 3, 5, 6, 7, 8, 9)])
    rows = counts.join(quantiles(validated, ["view"], "depth", {"median_depth": 0.5}), "view", "left").withColumn("share", F.col("valid") / F.col("inside"))
    low, high = rules.coverage
    return ladder(rows, [("no_depth", F.col("median_depth").isNull())], [("low_coverage", F.col("share") < low), ("high_coverage", F.col("share") > high)])
