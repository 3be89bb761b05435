"""Consensus of repeated depth observations of one cell, votes, and agreement of masks.

Observations of a cell are few (sessions of one campaign), so a cell's list is a bounded array and the medoid and the
reweighting run as array functions inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut
from .stats import MAD_SIGMA, finite_stats, quantiles

FEW = 4096


def majority(df: DataFrame, keys: list[str], flag: str, sessions: int) -> DataFrame:
    """Cells flagged in at least half of the sessions, rounded up."""
    return df.groupBy(*keys).agg(F.sum(F.col(flag).cast("int")).alias("votes")).where(F.col("votes") >= -(-sessions // 2)).select(*keys)


def pairwise_agreement(df: DataFrame, cell: list[str], session: str, depth: str, factor: float, low: float, high: float, least: int = 500) -> DataFrame:
    """Pooled differences of all session pairs with ``least`` shared cells or more: pairs, median, mad and the clamped tolerance."""
    a = df.select(*cell, F.col(session).alias("sa"), F.col(depth).alias("da"))
    b = df.select(*cell, F.col(session).alias("sb"), F.col(depth).alias("db"))
    both = cut(a.join(b, cell).where("sa < sb").select("sa", "sb", F.abs(F.col("da") - F.col("db")).alias("d")))  # read several times
    enough = both.groupBy("sa", "sb").count().where(F.col("count") >= least).select("sa", "sb")
    s = finite_stats(both.join(enough, ["sa", "sb"], "left_semi"), [], "d", {})
    return s.select(F.col("n").alias("pairs"), "median", "mad", F.least(F.greatest(F.coalesce(F.col("median") + factor * MAD_SIGMA * F.col("mad"), F.lit(low)), F.lit(low)), F.lit(high)).alias("tolerance"))


def session_bias(df: DataFrame, cell: list[str], session: str, depth: str, reference) -> DataFrame:
    """Median depth difference of each session from the reference session; measured, never applied."""
    ref = df.where(F.col(session) == reference).select(*cell, F.col(depth).alias("_r"))
    off = df.join(ref, cell).select(session, (F.col(depth) - F.col("_r")).alias("_o"))
    counts = off.groupBy(session).agg(F.count("*").alias("n"), F.lit(0.0).alias("applied"))
    return counts.join(quantiles(off, [session], "_o", {"bias": 0.5}), session, "left").select(session, "bias", "n", "applied")


def fuse_depth(df: DataFrame, cell: list[str], session: str, depth: str, weight: str, sigma: str, agreement: float = 6.0, most: float = 12.0, support: int = 2, factor: float = 2.5, rounds: int = 3, excluded: Column | None = None) -> DataFrame:
    """One row for each cell: n, depth, support, spread, valid.

    The medoid is the observation of least weighted absolute difference from all others (ties to the first session). An
    observation agrees with it within clip(factor * sqrt(sa^2 + sb^2), agreement, most). Agreeing ones are averaged in inverse
    depth with ``rounds`` Huber steps of width max(0.45 * agreement, 0.75). Below ``support`` agreeing ones the cell is not
    valid and its depth null. Rows that are ``excluded`` have no vote, and depths that aren't positive none either.
    """
    rows = df if excluded is None else df.where(~F.coalesce(excluded, F.lit(False)))
    rows = rows.where(F.col(depth).isNotNull() & ~F.isnan(depth) & (F.col(depth) > 0))
    obs = rows.groupBy(*cell).agg(F.array_sort(F.collect_list(F.struct(F.col(session).alias("s"), F.col(depth).cast("double").alias("z"), F.col(weight).cast("double").alias("w"), F.col(sigma).cast("double").alias("e")))).alias("o"))
    total = lambda arr, f: F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + f(x))
    cost = F.transform("o", lambda a: F.struct(F.round(total(F.col("o"), lambda b: b["w"] * F.abs(a["z"] - b["z"])), 9).alias("c"), a["s"].alias("s"), a["z"].alias("z"), a["e"].alias("e")))
    medoid = obs.withColumn("m", F.array_min(cost))
    tolerance = lambda b: F.least(F.greatest(factor * F.sqrt(b["e"] * b["e"] + F.col("m.e") * F.col("m.e")), F.lit(agreement)), F.lit(most))
    near = medoid.withColumn("k", F.filter("o", lambda b: F.abs(b["z"] - F.col("m.z")) <= tolerance(b)))
    width = max(0.45 * agreement, 0.75)
    out = near.withColumn("q", F.lit(1.0) / F.col("m.z"))
    for _ in range(rounds):
        huber = lambda b: b["w"] * F.least(F.lit(1.0), width / F.greatest(F.abs(b["z"] - 1 / F.col("q")), F.lit(1e-9)))
        out = out.withColumn("q", total(F.col("k"), lambda b: huber(b) / b["z"]) / F.greatest(total(F.col("k"), huber), F.lit(1e-12)))
    valid = F.size("k") >= support
    return out.select(*cell, F.size("o").alias("n"), F.when(valid, 1 / F.col("q")).alias("depth"), F.size("k").alias("support"), (F.array_max(F.transform("k", lambda b: b["z"])) - F.array_min(F.transform("k", lambda b: b["z"]))).alias("spread"), valid.alias("valid"))


def surface_veto(df: DataFrame, cell: list[str], depth: str, background: str, sigma: str, least: int = 2, factor: float = 2.5) -> DataFrame:
    """Votes of a cell for the background surface and for an object before it; vetoed with ``least`` of the first and none of the second."""
    gap = (F.col(background) - F.col(depth)) / F.col(sigma)
    votes = df.groupBy(*cell).agg(F.sum((F.abs(gap) <= factor).cast("int")).alias("surface_votes"), F.sum((gap > factor).cast("int")).alias("object_votes"))
    return votes.withColumn("vetoed", (F.col("surface_votes") >= least) & (F.col("object_votes") == 0))


def mask_iou(a: str, b: str) -> Column:
    """Aggregate: |a and b| / |a or b|; null for an empty union."""
    a, b = F.coalesce(F.col(a), F.lit(False)), F.coalesce(F.col(b), F.lit(False))
    return F.sum((a & b).cast("int")) / F.nullif(F.sum((a | b).cast("int")), F.lit(0))


def pairwise_iou(cells: DataFrame, mask: str, cell: list[str]) -> DataFrame:
    """IoU of each pair of masks that are given as sets of cells: a, b, iou. Pairs come from shared cells and sizes, never all cells."""
    sets = cells.select(F.col(mask).alias("m"), *cell).distinct()
    sizes = sets.groupBy("m").agg(F.count("*").alias("n"))
    shared = sets.select(F.col("m").alias("a"), *cell).join(sets.select(F.col("m").alias("b"), *cell), cell).where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    names = sizes.select(F.col("m").alias("a"), F.col("n").alias("na")).join(sizes.select(F.col("m").alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b"))  # masks are few
    return names.join(shared, ["a", "b"], "left").select("a", "b", (F.coalesce("both", F.lit(0)) / (F.col("na") + F.col("nb") - F.coalesce("both", F.lit(0)))).alias("iou"))


def shift(df: DataFrame, u: str, v: str, dx: int, dy: int, width: int, height: int) -> DataFrame:
    """Integer shift of a raster table; rows that leave the frame go."""
    moved = df.withColumns({u: F.col(u) + dx, v: F.col(v) + dy})
    return moved.where(F.col(u).between(0, width - 1) & F.col(v).between(0, height - 1))


def best_shift(reference: DataFrame, moving: DataFrame, u: str, v: str, reach: int, step: int = 1) -> DataFrame:
    """The integer shift of ``moving`` with the highest IoU: dx, dy, iou; ties prefer the smaller shift, so first none."""
    ref = reference.select(F.col(u).alias("u"), F.col(v).alias("v")).distinct()
    mov = moving.select(F.col(u).alias("u"), F.col(v).alias("v")).distinct()
    offsets = [(dx, dy) for dx in range(-reach, reach + 1, step) for dy in range(-reach, reach + 1, step)]
    grid = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets])
    tried = mov.withColumn("o", F.explode(grid)).select(F.col("o.dx").alias("dx"), F.col("o.dy").alias("dy"), (F.col("u") + F.col("o.dx")).alias("u"), (F.col("v") + F.col("o.dy")).alias("v"))
    shared = tried.join(ref, ["u", "v"], "left_semi").groupBy("dx", "dy").agg(F.count("*").alias("both"))
    total = ref.agg(F.count("*").alias("nr")).crossJoin(mov.agg(F.count("*").alias("nm")))  # one row each
    scored = shared.crossJoin(F.broadcast(total)).select("dx", "dy", (F.col("both") / (F.col("nr") + F.col("nm") - F.col("both"))).alias("iou"))
    return scored.orderBy(F.desc(F.round("iou", 12)), F.abs(F.col("dx")) + F.abs(F.col("dy")), "dx", "dy").limit(1)


def similarity(df: DataFrame, keys: list[str], a: str, b: str, ga: str, gb: str) -> DataFrame:
    """0.45 correlation of intensities and 0.55 of gradients, by group."""
    return df.groupBy(*keys).agg((0.45 * F.corr(a, b) + 0.55 * F.corr(ga, gb)).alias("similarity"))


def adjacency(labels: DataFrame, u: str, v: str, label: str) -> DataFrame:
    """Pairs of labels that touch to the right or below, with the number of touching pixels: a, b, boundary."""
    here = labels.select(F.col(u).alias("u"), F.col(v).alias("v"), F.col(label).alias("la"))
    there = labels.select(F.col(u).alias("u2"), F.col(v).alias("v2"), F.col(label).alias("lb"))
    steps = here.withColumn("d", F.explode(F.array(F.struct(F.lit(1).alias("x"), F.lit(0).alias("y")), F.struct(F.lit(0).alias("x"), F.lit(1).alias("y")))))
    met = steps.withColumns({"u2": F.col("u") + F.col("d.x"), "v2": F.col("v") + F.col("d.y")}).join(there, ["u2", "v2"]).where("la <> lb")
    return met.groupBy(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).agg(F.count("*").alias("boundary"))


def pixel_components(mask: DataFrame, u: str, v: str, diagonal: bool = True) -> DataFrame:
    """Mask pixels with the component they belong to, named by its least (v, u) pixel."""
    from .graph import label_nodes

    id_ = lambda x, y: F.struct(y.alias("v"), x.alias("u"))
    nodes = mask.select(id_(F.col(u), F.col(v)).alias("node")).distinct()
    steps = [(1, 0), (0, 1), *([(1, 1), (-1, 1)] if diagonal else [])]
    moves = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in steps])
    near = nodes.withColumn("d", F.explode(moves)).select(F.col("node").alias("u"), F.struct((F.col("node.v") + F.col("d.y")).alias("v"), (F.col("node.u") + F.col("d.x")).alias("u")).alias("v"))
    edges = near.join(nodes.withColumnRenamed("node", "v"), "v", "left_semi").select("u", "v")
    return label_nodes(nodes, edges, "node").select(F.col("node.u").alias(u), F.col("node.v").alias(v), "component")


def silhouette_support(voxels: DataFrame, poses: DataFrame, silhouettes: DataFrame, focal: float, cx: float, cy: float, id_: str = "voxel", pose: str = "pose_index") -> DataFrame:
    """Every voxel in every pose (poses are few): how many poses test it and in how many its pixel is inside the silhouette."""
    seen = _project(voxels, poses, focal, cx, cy, id_, pose)
    hit = seen.join(silhouettes.select(pose, "u", "v").distinct().withColumn("hit", F.lit(1)), [pose, "u", "v"], "left")
    return hit.groupBy(id_).agg(F.count("*").alias("tested"), F.coalesce(F.sum("hit"), F.lit(0)).alias("inside"), F.avg(F.coalesce("hit", F.lit(0))).alias("ratio"))


def _project(voxels: DataFrame, poses: DataFrame, focal: float, cx: float, cy: float, id_: str, pose: str) -> DataFrame:
    few = poses.limit(FEW + 1).count() <= FEW  # poses of one turn; past that a join that Spark can split
    all_ = voxels.select(id_, "x", "y", "z").crossJoin(F.broadcast(poses) if few else poses)
    at = lambda i, t: F.col(f"r{i}0") * F.col("x") + F.col(f"r{i}1") * F.col("y") + F.col(f"r{i}2") * F.col("z") + F.col(f"t{t}")
    cam = all_.select(id_, pose, at(0, "x").alias("px"), at(1, "y").alias("py"), at(2, "z").alias("pz")).where("pz > 1e-9")
    return cam.select(id_, pose, F.rint(F.col("px") * focal / F.col("pz") + cx).cast("int").alias("u"), F.rint(F.col("py") * focal / F.col("pz") + cy).cast("int").alias("v"), "pz")


def reprojection_support(voxels: DataFrame, poses: DataFrame, depths: DataFrame, focal: float, cx: float, cy: float, tolerance: float, id_: str = "voxel", pose: str = "pose_index") -> DataFrame:
    """Poses whose depth agrees with the voxel, lies behind it (contradicts: free space) or before it (occluded), as masks and counts.

    A missing depth is no vote.
    """
    from ..functions.bitmask import pose_bit

    met = _project(voxels, poses, focal, cx, cy, id_, pose).join(depths.select(pose, "u", "v", F.col("depth").alias("_d")), [pose, "u", "v"]).withColumn("delta", F.col("pz") - F.col("_d"))
    state = {"agree": F.abs(F.col("delta")) <= tolerance, "contradict": F.col("delta") < -tolerance, "occluded": F.col("delta") > tolerance}
    return met.groupBy(id_).agg(*[F.coalesce(F.bit_or(F.when(c, pose_bit(pose))), F.lit(0)).alias(f"{k}_mask") for k, c in state.items()], *[F.sum(c.cast("int")).alias(k) for k, c in state.items()])
