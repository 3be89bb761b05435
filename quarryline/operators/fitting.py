"""Model fitting that built-in expressions can't say, as numpy on Arrow groups: each group is one region, view or patch.

Random choices are seeded by the caller, so a repeated task gives the same answer.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .graph import cut
from .stats import MAD_SIGMA, quantiles

DRAWN, LARGE = 1024, 500_000


def fit_plane(p: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit normal (largest component positive) and offset of the least-squares plane n.p = d."""
    c = p.mean(0)
    n = np.linalg.svd(p - c, full_matrices=False)[2][-1]
    n = n * np.sign(n[np.argmax(np.abs(n))])
    return n, float(n @ c)


def ransac_plane(p: np.ndarray, tolerance: float, rounds: int = 200, seed: int = 0) -> tuple[np.ndarray, float, np.ndarray]:
    """Most inliers, then least median distance of them; refined on the inliers."""
    rng = np.random.default_rng(seed)
    best = (-1, np.inf, None)
    for _ in range(rounds):
        a, b, c = p[rng.choice(len(p), 3, replace=False)]
        n = np.cross(b - a, c - a)
        size = np.linalg.norm(n)
        if size < 1e-12:
            continue
        far = np.abs((p - a) @ (n / size))
        near = far <= tolerance
        key = (int(near.sum()), -float(np.median(far[near])))
        if best[2] is None or key > best[:2]:
            best = (*key, near)
    near = best[2] if best[2] is not None else np.ones(len(p), bool)
    n, d = fit_plane(p[near])
    return n, d, np.abs(p @ n - d) <= tolerance


def plane_per_group(df: DataFrame, keys: list[str], axes: tuple, order: str, tolerance: float, seed: int = 0, rounds: int = 200) -> DataFrame:
    """A RANSAC plane for each group: keys, unit normal (largest component positive), d, inliers, rmse.

    Planes are drawn through three of DRAWN rows of a group, chosen by a hash of ``order``; all rows vote on them by aggregates, so no
    task holds a group. Most inliers win, of ties the least median distance, then the first drawn; the winner is refined on its
    inliers by their covariance. Groups of fewer than three points in general position give none.
    """
    ship(df.sparkSession)
    rows = df.select(*keys, order, *[F.col(a).cast("double").alias(a) for a in axes]).dropna(subset=list(axes))
    head = ", ".join(f"{k} {t}" for k, t in rows.dtypes if k in keys)
    by_hash = Window.partitionBy(*keys).orderBy(F.xxhash64(F.col(order), F.lit(seed)), order)
    some = rows.withColumn("_r", F.row_number().over(by_hash)).where(F.col("_r") <= DRAWN)

    def draw(name: tuple, g: pd.DataFrame) -> pd.DataFrame:
        p, rng, out = g.sort_values("_r")[list(axes)].to_numpy(float), np.random.default_rng(seed), []
        for h in range(rounds if len(p) >= 3 else 0):
            a, b, c = p[rng.choice(len(p), 3, replace=False)]
            n = np.cross(b - a, c - a)
            if (size := np.linalg.norm(n)) >= 1e-12:
                out.append((*name, h, *(n / size), float(n @ a / size)))
        return pd.DataFrame(out, columns=[*keys, "h", "hx", "hy", "hz", "hd"])

    drawn = cut(some.groupBy(*keys).applyInPandas(draw, f"{head}, h int, hx double, hy double, hz double, hd double"))
    if drawn.count() <= 100_000:
        drawn = F.broadcast(drawn)  # ``rounds`` planes for each of a counted number of groups
    far = lambda n, d: F.abs(sum((F.col(a) * F.col(x) for a, x in zip(axes[1:], n[1:], strict=True)), F.col(axes[0]) * F.col(n[0])) - F.col(d))
    votes = rows.join(drawn, keys).withColumn("far", far(("hx", "hy", "hz"), "hd")).where(F.col("far") <= tolerance)
    counted = votes.groupBy(*keys, "h", "hx", "hy", "hz", "hd").agg(F.count("*").alias("n"))
    best = cut(counted.withColumn("top", F.max("n").over(Window.partitionBy(*keys))).where("n = top").drop("top", "n"))  # ``rounds`` rows a group
    near = rows.join(F.broadcast(best) if best.count() <= 100_000 else best, keys).withColumn("far", far(("hx", "hy", "hz"), "hd")).where(F.col("far") <= tolerance)
    median = quantiles(near, [*keys, "h"], "far", {"m": 0.5})
    chosen = best.join(median, [*keys, "h"]).groupBy(*keys).agg(F.min_by(F.struct("hx", "hy", "hz", "hd"), F.struct("m", "h")).alias("p")).select(*keys, "p.*")
    near = rows.join(chosen, keys).where(far(("hx", "hy", "hz"), "hd") <= tolerance)
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    moments = near.groupBy(*keys).agg(*[F.avg(a).alias(f"m{i}") for i, a in enumerate(axes)], *[F.covar_pop(axes[i], axes[j]).alias(f"c{i}{j}") for i, j in pairs])

    def refine(g: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in g.to_dict("records"):
            c = np.array([[r[f"c{min(i, j)}{max(i, j)}"] for j in range(3)] for i in range(3)])
            n = np.linalg.eigh(c)[1][:, 0]
            n = n * np.sign(n[np.argmax(np.abs(n))])
            out.append((*[r[k] for k in keys], *n, float(n @ [r["m0"], r["m1"], r["m2"]])))
        return pd.DataFrame(out, columns=[*keys, "nx", "ny", "nz", "d"])

    planes = moments.groupBy(*keys).applyInPandas(refine, f"{head}, nx double, ny double, nz double, d double")
    off = rows.join(planes, keys).withColumn("far", far(("nx", "ny", "nz"), "d"))
    hit = F.col("far") <= tolerance
    return off.groupBy(*keys, "nx", "ny", "nz", "d").agg(F.count_if(hit).alias("inliers"), F.sqrt(F.avg(F.when(hit, F.col("far") * F.col("far")))).alias("rmse"))


def dominant_planes(p: np.ndarray, tolerance: float, least: int, most: int = 3, seed: int = 0) -> list[tuple]:
    """Planes one after another, each from what the ones before left."""
    out = []
    while len(out) < most and len(p) >= max(3, least):
        n, d, near = ransac_plane(p, tolerance, seed=seed + len(out))
        if near.sum() < least:
            break
        out.append((n, d, int(near.sum())))
        p = p[~near]
    return out


def irls(design: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 12, huber: float = 1.345, smallest: float = 1e-6) -> np.ndarray:
    """Weighted least squares with Huber weights on residuals in robust sigmas."""
    w = weight.copy()
    for _ in range(rounds):
        root = np.sqrt(np.maximum(w, 0))
        beta = np.linalg.lstsq(design * root[:, None], y * root, rcond=None)[0]
        r = y - design @ beta
        sigma = max(smallest, 1.4826 * float(np.median(np.abs(r - np.median(r)))))
        w = weight * np.minimum(1.0, huber * sigma / np.maximum(np.abs(r), 1e-12))
    return beta


def affine_consensus(points: np.ndarray, error: np.ndarray, threshold: float, draws: int = 500, refits: int = 3, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (per u, per v, constant) of an affine error over image points and its inliers: three points drawn at a time, the draw
    with most inliers refitted by least squares on them until they stay; fewer than three inliers give zeros and none."""
    design, rng, best = np.c_[points, np.ones(len(points))], np.random.default_rng(seed), np.zeros(len(points), bool)
    for _ in range(draws if len(points) >= 3 else 0):
        some = design[rows := rng.choice(len(points), 3, replace=False)]
        if abs(np.linalg.det(some)) < 1e-9:
            continue
        near = np.abs(error - design @ np.linalg.solve(some, error[rows])) <= threshold
        best = near if near.sum() > best.sum() else best
    beta = np.zeros(3)
    for _ in range(refits):
        if best.sum() < 3:
            return np.zeros(3), np.zeros(len(points), bool)
        beta = np.linalg.lstsq(design[best], error[best], rcond=None)[0]
        now = np.abs(error - design @ beta) <= threshold
        if (now == best).all():
            break
        best = now
    return beta, best


def quadratic_design(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.stack([u * u, v * v, u * v, u, v, np.ones_like(u)], 1)


def quadratic_per_group(df: DataFrame, keys: list[str], u: str, v: str, y: str, order: str, rounds: int = 12, huber: float = 1.345) -> DataFrame:
    """Coefficients a..f and rmse of a robust quadratic for each group of six rows or more.

    Groups that are all counted to hold LARGE rows at most are fitted each in one task; else by the same rounds over aggregates:
    weighted normal equations, then the residuals' scale from quantiles.
    """
    ship(df.sparkSession)
    rows = df.select(*keys, order, u, v, y).dropna(subset=[u, v, y])
    head = ", ".join(f"{k} {t}" for k, t in df.dtypes if k in keys)
    names = [*keys, *"abcdef", "rmse"]
    if (rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > LARGE:
        return _quadratic_by_sums(rows, keys, u, v, y, rounds, huber)

    def run(name: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order)
        if len(g) < 6:
            return pd.DataFrame(columns=names)
        x, z = quadratic_design(g[u].to_numpy(float), g[v].to_numpy(float)), g[y].to_numpy(float)
        beta = irls(x, z, np.ones(len(z)), rounds, huber)
        return pd.DataFrame([[*name, *beta, float(np.sqrt(np.mean((z - x @ beta) ** 2)))]], columns=names)

    return rows.groupBy(*keys).applyInPandas(run, f"{head}, {', '.join(f'{c} double' for c in 'abcdef')}, rmse double")


def _quadratic_by_sums(rows: DataFrame, keys: list[str], u: str, v: str, y: str, rounds: int, huber: float) -> DataFrame:
    design = [F.col(u) * F.col(u), F.col(v) * F.col(v), F.col(u) * F.col(v), F.col(u), F.col(v), F.lit(1.0)]
    base = cut(rows.select(*keys, *[d.cast("double").alias(f"_d{i}") for i, d in enumerate(design)], F.col(y).cast("double").alias("_y")))
    head, pairs = ", ".join(f"{k} {t}" for k, t in base.dtypes if k in keys), [(i, j) for i in range(6) for j in range(i, 6)]

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in g.to_dict("records"):
            m = np.array([[r[f"s{min(i, j)}{max(i, j)}"] for j in range(6)] for i in range(6)])
            out.append((*[r[k] for k in keys], *np.linalg.lstsq(m, np.array([r[f"t{i}"] for i in range(6)]), rcond=None)[0]))
        return pd.DataFrame(out, columns=[*keys, *"abcdef"])

    weighted, fit = base.withColumn("_w", F.lit(1.0)), None
    off = F.col("_y") - sum((F.col(f"_d{i}") * F.col(c) for i, c in enumerate("bcdef", 1)), F.col("_d0") * F.col("a"))
    for _ in range(rounds):
        sums = weighted.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(F.col("_w") * F.col(f"_d{i}") * F.col(f"_d{j}")).alias(f"s{i}{j}") for i, j in pairs], *[F.sum(F.col("_w") * F.col(f"_d{i}") * F.col("_y")).alias(f"t{i}") for i in range(6)])
        fit = cut(sums.where("n >= 6").groupBy(*keys).applyInPandas(solve, f"{head}, {', '.join(f'{c} double' for c in 'abcdef')}"))
        left = base.join(fit, keys).withColumn("_r", off)
        middle = quantiles(left, keys, "_r", {"_m": 0.5})
        scale = quantiles(left.join(middle, keys).withColumn("_s", F.abs(F.col("_r") - F.col("_m"))), keys, "_s", {"_mad": 0.5})
        sigma = F.greatest(F.lit(1e-6), MAD_SIGMA * F.col("_mad"))
        weighted = left.join(scale, keys).withColumn("_w", F.least(F.lit(1.0), huber * sigma / F.greatest(F.abs(F.col("_r")), F.lit(1e-12)))).select(*base.columns, "_w")
    return base.join(fit, keys).groupBy(*keys, *"abcdef").agg(F.sqrt(F.avg(off * off)).alias("rmse"))


def held_out_error(design: np.ndarray, y: np.ndarray, fold: np.ndarray) -> float:
    """RMS error of each fold under the fit of the others; NaN if no fold can be left out."""
    errors = []
    for f in np.unique(fold):
        train = fold != f
        if train.sum() >= design.shape[1]:
            errors.append(y[~train] - design[~train] @ irls(design[train], y[train], np.ones(train.sum())))
    return float(np.sqrt(np.mean(np.concatenate(errors) ** 2))) if errors else float("nan")


def held_out_votes(design: np.ndarray, y: np.ndarray, fold: np.ndarray, weight: np.ndarray, tolerance: float) -> tuple[int, int]:
    """How many folds keep, in the median, within ``tolerance`` of the fit of the others, and how many could be left out."""
    passed = tested = 0
    for f in np.unique(fold):
        train = fold != f
        if train.sum() >= design.shape[1]:
            tested += 1
            passed += float(np.median(np.abs(y[~train] - design[~train] @ irls(design[train], y[train], weight[train])))) <= tolerance
    return int(passed), tested


def posed_fit(p: np.ndarray, normal: np.ndarray, pose: np.ndarray, weight: np.ndarray, kind: str = "plane") -> dict:
    """A robust plane or quadratic of points that several poses saw, each pose of equal total weight: origin, frame (rows u, v and the
    normal's side), coefficients over (u, v) and rmse.

    The frame is the weighted principal axes; too few points for the kind give a plane, fewer than three nothing.
    """
    if len(p) < 3:
        return {}
    names, which = np.unique(pose, return_inverse=True)
    w = np.maximum(weight, 1e-12)
    w = w / np.bincount(which, w, len(names))[which] / len(names)
    origin = w @ p
    d = p - origin
    axes = np.linalg.eigh((d * w[:, None]).T @ d)[1][:, ::-1].T
    frame = np.stack([axes[0], axes[1], axes[2] * (1.0 if axes[2] @ normal >= 0 else -1.0)])
    u, v, h = (d @ frame.T).T
    design = quadratic_design(u, v) if kind == "quadratic" and len(p) >= 6 else np.stack([u, v, np.ones(len(p))], 1)
    beta = irls(design, h, w * len(p))
    return {"origin": origin, "frame": frame, "coefficients": beta, "rmse": float(np.sqrt(w @ (h - design @ beta) ** 2))}


def normals(df: DataFrame, id_: str, axes: tuple, radius: float, view: tuple = (0.0, 0.0, 0.0)) -> DataFrame:
    """PCA normal of each point's neighbours within ``radius``, turned to the viewpoint; null with fewer than three.

    Covariance sums are built-in aggregates over the radius join, so no group is collected; only the 3 x 3 eigenvectors are numpy.
    """
    from pyspark.sql import functions as F

    from .joins import radius_join

    near = radius_join(df, df, radius, id_, axes).select("a_id", "b_id")
    pts = df.select(F.col(id_).alias("b_id"), *[F.col(a).cast("double").alias(c) for a, c in zip(axes, "xyz", strict=True)])
    made = {"n": F.count("*"), **{f"s{c}": F.sum(c) for c in "xyz"}, **{f"q{c}{e}": F.sum(F.col(c) * F.col(e)) for c, e in ("xx", "xy", "xz", "yy", "yz", "zz")}}
    sums = near.join(pts, "b_id").groupBy("a_id").agg(*[v.alias(k) for k, v in made.items()])
    wide = sums.join(pts.withColumnRenamed("b_id", "a_id"), "a_id")
    kind = dict(df.dtypes)[id_]

    def run(batches):
        for g in batches:
            m = np.stack([g[f"s{c}"] for c in "xyz"], 1) / g["n"].to_numpy()[:, None]
            q = np.array([[g[f"q{min(a, b)}{max(a, b)}"] for b in "xyz"] for a in "xyz"]).transpose(2, 0, 1) / g["n"].to_numpy()[:, None, None]
            v = np.linalg.eigh(q - m[:, :, None] * m[:, None, :])[1][:, :, 0]
            p = g[["x", "y", "z"]].to_numpy()
            v = v * np.where(((np.array(view) - p) * v).sum(1) < 0, -1.0, 1.0)[:, None]
            v[g["n"].to_numpy() < 3] = np.nan
            yield pd.DataFrame({id_: g["a_id"], "nx": v[:, 0], "ny": v[:, 1], "nz": v[:, 2], "neighbors": g["n"]})

    return wide.mapInPandas(run, f"{id_} {kind}, nx double, ny double, nz double, neighbors long")


def two_way_bias(values: np.ndarray, neighbor: np.ndarray, rounds: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Alternating medians of r[j, p] = b[p] - g[j]; NaN cells don't count. neighbor: weights of rows, 0 leaves one out."""
    used = values[neighbor > 0]
    bias, gauge = np.zeros(values.shape[1]), np.zeros(len(used))
    for _ in range(rounds):
        bias = np.nan_to_num(np.nanmedian(used + gauge[:, None], axis=0))
        gauge = np.nan_to_num(np.nanmedian(bias[None, :] - used, axis=1))
    return bias, gauge


def damped_least_squares(residual, start: np.ndarray, bounds: tuple[np.ndarray, np.ndarray], rounds: int = 50) -> np.ndarray:
    """Levenberg-Marquardt inside a box, with numeric derivatives: for the few parameters of one turntable."""
    x, damp = np.clip(np.asarray(start, float), *bounds), 1e-3
    r = residual(x)
    for _ in range(rounds):
        step = 1e-6 * np.maximum(1.0, np.abs(x))
        jac = np.stack([(residual(x + step * e) - r) / s for e, s in zip(np.eye(len(x)), step, strict=True)], 1)
        a, g = jac.T @ jac, jac.T @ r
        new = np.clip(x - np.linalg.solve(a + damp * np.diag(np.maximum(np.diag(a), 1e-12)), g), *bounds)
        new_r = residual(new)
        if new_r @ new_r < r @ r:
            done = np.abs(new - x).max() < 1e-10
            x, r, damp = new, new_r, damp / 3
            if done:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return x


def circle(p: np.ndarray) -> tuple[float, float, float]:
    """Least-squares circle: centre and radius."""
    a = np.c_[2 * p, np.ones(len(p))]
    cx, cy, c = np.linalg.lstsq(a, (p**2).sum(1), rcond=None)[0]
    return float(cx), float(cy), float(np.sqrt(max(0.0, c + cx * cx + cy * cy)))


def hull(p: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, by the monotone chain."""
    pts = np.unique(p, axis=0).tolist()
    if len(pts) < 3:
        return np.array(pts)

    def half(points):
        out: list = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def smallest_rectangle(p: np.ndarray) -> tuple[float, float]:
    """Sides of the rectangle of least area around the points: one side lies along a hull edge."""
    h = hull(p)
    best = (np.inf, 0.0, 0.0)
    for a, b in zip(h, np.roll(h, -1, axis=0), strict=True):
        d = b - a
        size = np.linalg.norm(d)
        if size < 1e-12:
            continue
        d = d / size
        along, across = h @ d, h @ np.array([-d[1], d[0]])
        w, t = np.ptp(along), np.ptp(across)
        best = min(best, (w * t, max(w, t), min(w, t)))
    return best[1], best[2]


def robust_circle(p: np.ndarray, rounds: int = 100) -> tuple[float, float, float]:
    """Centre and radius of least summed soft distance 2 (sqrt(1 + r^2) - 1), by reweighted steps from the least-squares circle."""
    at = np.array(circle(p))
    for _ in range(rounds):
        away = p - at[:2]
        far = np.maximum(np.linalg.norm(away, axis=1), 1e-12)
        r = far - at[2]
        root = (1 + r * r) ** -0.25
        slope = np.c_[-away / far[:, None], -np.ones(len(p))] * root[:, None]
        step = np.linalg.lstsq(slope, -r * root, rcond=None)[0]
        at = at + step
        if np.abs(step).max() < 1e-10:
            break
    return float(at[0]), float(at[1]), float(max(at[2], 0.0))


def simplified(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Corners of a closed polygon that stand off the chords between kept corners by more than ``tolerance``."""
    def kept(first: int, last: int) -> list[int]:
        if last - first < 2:
            return [first]
        a, d = ring[first], ring[last % len(ring)] - ring[first]
        q = ring[first + 1 : last] - a
        size = np.linalg.norm(d)
        off = np.abs(q[:, 0] * d[1] - q[:, 1] * d[0]) / size if size > 1e-12 else np.linalg.norm(q, axis=1)
        k = first + 1 + int(off.argmax())
        return kept(first, k) + kept(k, last) if off.max() > tolerance else [first]

    far = int(np.linalg.norm(ring - ring[0], axis=1).argmax())
    found = kept(0, far) + kept(far, len(ring))
    corners = ring[found]
    if len(corners) > 3:  # the two it began with may lie on a side themselves
        d = np.roll(corners, -1, axis=0) - np.roll(corners, 1, axis=0)
        q = corners - np.roll(corners, 1, axis=0)
        off = np.abs(q[:, 0] * d[:, 1] - q[:, 1] * d[:, 0]) / np.maximum(np.linalg.norm(d, axis=1), 1e-12)
        corners = corners[off > tolerance]
    return corners


def polygon_area(ring: np.ndarray) -> float:
    x, y = ring.T if len(ring) else (np.zeros(0), np.zeros(0))
    return 0.5 * abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1)))


def _pyramid(p: np.ndarray, band: float = 2.0, share: float = 0.04) -> dict[str, float]:
    """Mean side of a triangular base, mean height of the faces and mean edge to the tip; nothing where the base isn't a flat triangle
    or the tip doesn't stand over every side."""
    y = p[:, 1]
    ends = [p[y <= y.min() + band], p[y >= y.max() - band]]
    base, top = sorted(ends, key=lambda e: -polygon_area(hull(e[:, [0, 2]])))
    centre = base.mean(0)
    axes = np.linalg.svd(base - centre, full_matrices=False)[2]
    ring = hull((base - centre) @ axes[:2].T)
    length = float(np.linalg.norm(ring - np.roll(ring, -1, axis=0), axis=1).sum())
    corners = simplified(ring, share * length)
    if len(corners) != 3 or np.quantile(np.abs((base - centre) @ axes[2]), 0.95) > band:
        return {}
    corners, tip = centre + corners @ axes[:2], top.mean(0)
    side = np.roll(corners, -1, axis=0) - corners
    at = ((tip - corners) * side).sum(1) / (side * side).sum(1)
    if ((at < 0) | (at > 1)).any():
        return {}
    feet = corners + at[:, None] * side
    return {"side": float(np.linalg.norm(side, axis=1).mean()), "face_height": float(np.linalg.norm(tip - feet, axis=1).mean()), "edge": float(np.linalg.norm(tip - corners, axis=1).mean())}


def dimensions(p: np.ndarray, kind: str) -> dict[str, float]:
    """Sizes of a standing object with +Y up: cube (height, width, depth), cylinder (height, diameter; a robust circle around the middle
    three fifths) or pyramid (side, face_height, edge; empty where these can't be told)."""
    y, height = p[:, 1], float(np.ptp(p[:, 1]))
    if kind == "pyramid":
        return _pyramid(p)
    if kind == "cylinder":
        middle = p[(y >= y.min() + 0.2 * height) & (y <= y.min() + 0.8 * height)][:, [0, 2]]
        if len(middle) < 20:
            raise ValueError("too few points for a diameter")
        return {"height": height, "diameter": 2 * robust_circle(middle)[2]}
    wide, deep = smallest_rectangle(p[:, [0, 2]])
    return {"height": height, "width": wide, "depth": deep}
