"""Frames and compactness of registered views: small searches over few directions, and two-means along an axis."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import weighted_stats


def golden_section(cost, low: float, high: float, tolerance: float = 1e-6) -> float:
    ratio = (np.sqrt(5) - 1) / 2
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    fa, fb = cost(a), cost(b)
    while high - low > tolerance:
        if fa <= fb:
            high, b, fb = b, a, fa
            a = high - ratio * (high - low)
            fa = cost(a)
        else:
            low, a, fa = a, b, fb
            b = low + ratio * (high - low)
            fb = cost(b)
    return (low + high) / 2


def frame_angle(normals: np.ndarray, weights: np.ndarray, axis: np.ndarray, huber_deg: float = 8.0) -> float:
    """The turn in [0, 90) degrees about ``axis`` of the right-angled frame that few plane normals fit best (weighted Huber)."""
    y = axis / np.linalg.norm(axis)
    seed = np.eye(3)[int(np.argmin(np.abs(y)))]
    x = seed - y * (seed @ y)
    x /= np.linalg.norm(x)
    angle = np.degrees(np.arctan2(normals @ np.cross(y, x), normals @ x))

    def cost(t: float) -> float:
        off = np.abs((angle - t + 45) % 90 - 45)
        return float((weights * np.where(off <= huber_deg, 0.5 * off**2, huber_deg * (off - 0.5 * huber_deg))).sum())

    grid = np.arange(0.0, 90.0, 2.0)
    best = grid[int(np.argmin([cost(t) for t in grid]))]
    return float(golden_section(cost, best - 2.0, best + 2.0) % 90)


def face_compactness(df: DataFrame, axis: str, weight: str, rounds: int = 20, apart: float = 5.0) -> DataFrame:
    """Points split in one or two faces along ``axis`` by weighted two-means (centres only reach the driver), and the weighted
    spread of each about its weighted median: face, center, p90, p95."""
    lo, hi = df.agg(F.min(axis), F.max(axis)).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "face int, center double, p90 double, p95 double")
    for _ in range(rounds):
        mid = (lo + hi) / 2
        side = F.col(axis) > mid
        r = df.agg((F.sum(F.when(~side, F.col(axis) * F.col(weight))) / F.sum(F.when(~side, F.col(weight)))).alias("a"), (F.sum(F.when(side, F.col(axis) * F.col(weight))) / F.sum(F.when(side, F.col(weight)))).alias("b")).first()
        new = (r["a"] if r["a"] is not None else lo, r["b"] if r["b"] is not None else hi)
        if max(abs(new[0] - lo), abs(new[1] - hi)) < 1e-9:
            break
        lo, hi = new
    two = hi - lo > apart
    faces = df.withColumn("face", (F.col(axis) > (lo + hi) / 2).cast("int") if two else F.lit(0))
    center = weighted_stats(faces, ["face"], axis, weight).select("face", F.col("median").alias("center"))
    off = faces.join(center, "face").withColumn("off", F.abs(F.col(axis) - F.col("center")))
    return center.join(weighted_stats(off, ["face"], "off", weight).select("face", "p90", "p95"), "face")


def axis_from_normals(pairs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The axis of a turn from differences of normals before and after it: the direction they are all across from."""
    d = pairs[:, 1] - pairs[:, 0]
    return np.linalg.eigh((d * weights[:, None]).T @ d)[1][:, 0]


def fit_turn_axis(p: np.ndarray, q: np.ndarray, angles: np.ndarray, axis: np.ndarray, centre: np.ndarray, most_tilt: float = 0.2, most_shift: float = 50.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Axis, a point on it, and the RMS distance left, for points p that a turn by known ``angles`` (radians) takes to q.

    Two tilts and two shifts across the axis are searched within bounds from the start that is given.
    """
    from ..functions.geometry import rotation
    from .fitting import damped_least_squares

    y = np.asarray(axis, float) / np.linalg.norm(axis)
    seed = np.eye(3)[int(np.argmin(np.abs(y)))]
    x = seed - y * (seed @ y)
    x /= np.linalg.norm(x)
    z = np.cross(x, y)

    def at(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = y + v[0] * x + v[1] * z
        return a / np.linalg.norm(a), np.asarray(centre, float) + v[2] * x + v[3] * z

    def residual(v: np.ndarray) -> np.ndarray:
        a, c = at(v)
        out = np.empty_like(q, float)
        for t in np.unique(angles):
            m = angles == t
            out[m] = (p[m] - c) @ rotation(a, float(t)).T + c - q[m]
        return out.ravel()

    bound = np.array([most_tilt, most_tilt, most_shift, most_shift])
    v = damped_least_squares(residual, np.zeros(4), (-bound, bound))
    a, c = at(v)
    return a, c, float(np.sqrt(np.mean(np.sum(residual(v).reshape(-1, 3) ** 2, axis=1))))


def worth_applying(before: DataFrame, after: DataFrame, least_gain: float = 0.02) -> bool:
    """True if held-out errors (pair, rmse) of a refinement are lower in the median by ``least_gain`` of themselves, and no pair is worse by more."""
    both = before.join(after.withColumnRenamed("rmse", "new"), "pair")
    r = both.agg(F.percentile("rmse", F.lit(0.5)).alias("a"), F.percentile("new", F.lit(0.5)).alias("b"), F.max(F.col("new") / F.col("rmse")).alias("w")).first()
    return r["a"] is not None and r["b"] <= (1 - least_gain) * r["a"] and r["w"] <= 1 + least_gain


def axis_consensus(planes: list[tuple[int, np.ndarray, float]], turn: float, prior: np.ndarray, most_tilt: float = 0.35, tolerance_deg: float = 3.0, trials: int = 2000, rounds: int = 3) -> tuple[np.ndarray, int]:
    """The turn axis that most pairs of planes agree on, and how many: planes are (pose, unit normal, weight), poses ``turn`` radians apart.

    Directions spread evenly over the cap of ``most_tilt`` radians around ``prior`` are tried; a pair agrees if the turn between its poses
    takes one normal to the other within the tolerance. The best is refined on the pairs that agree with it, by the direction their
    differences of normals are across from.
    """
    from ..functions.geometry import rotation

    prior = np.asarray(prior, float) / np.linalg.norm(prior)
    pairs = [(i, j) for i in range(len(planes)) for j in range(i + 1, len(planes)) if planes[i][0] != planes[j][0]]
    least = np.cos(np.radians(tolerance_deg))

    def agreeing(axis: np.ndarray) -> list[tuple[int, int]]:
        level = np.array([rotation(axis, -p * turn) @ n for p, n, _ in planes])  # all in the first pose's frame
        near = level @ level.T >= least
        return [(i, j) for i, j in pairs if near[i, j]]

    side = np.eye(3)[int(np.argmin(np.abs(prior)))]
    x = side - prior * (side @ prior)
    x /= np.linalg.norm(x)
    y, best = np.cross(prior, x), (0.0, prior, [])
    for k in range(trials):
        tilt, way = most_tilt * np.sqrt((k + 0.5) / trials), k * np.pi * (3 - np.sqrt(5))
        axis = np.cos(tilt) * prior + np.sin(tilt) * (np.cos(way) * x + np.sin(way) * y)
        found = agreeing(axis)
        score = sum(planes[i][2] * planes[j][2] for i, j in found)
        if score > best[0]:
            best = (score, axis, found)
    _, axis, found = best
    for _ in range(rounds):
        if not found:
            break
        moved = [(i, j) for i, j in found if np.linalg.norm(planes[i][1] - planes[j][1]) > 0.05]
        if len(moved) < 2:
            break
        new = axis_from_normals(np.array([[planes[i][1], planes[j][1]] for i, j in moved]), np.array([planes[i][2] * planes[j][2] for i, j in moved]))
        new = new * np.sign(new @ prior)
        again = agreeing(new)
        if len(again) < len(found):
            break
        axis, found = new, again
    return axis, len(found)


def search_centre(views: dict[int, np.ndarray], turn: float, axis: np.ndarray, start: np.ndarray, reach: float, share: float = 0.8, rounds: int = 6, grid: int = 5) -> tuple[np.ndarray, float]:
    """The point across the axis about which neighbouring views turn into each other best, and the trimmed RMS distance there.

    ``views`` are bounded samples of points by pose. A grid around the best centre shrinks by half in each round; a centre's cost is the
    RMS of the closest ``share`` of distances from each view's points to the next view's.
    """
    from ..functions.geometry import rotation

    y = np.asarray(axis, float) / np.linalg.norm(axis)
    side = np.eye(3)[int(np.argmin(np.abs(y)))]
    x = side - y * (side @ y)
    x /= np.linalg.norm(x)
    z = np.cross(x, y)
    poses = sorted(views)
    steps = [(a, b, rotation(y, (b - a) * turn)) for a, b in zip(poses, poses[1:], strict=False)]

    def cost(c: np.ndarray) -> float:
        total = []
        for a, b, r in steps:
            p = (views[a] - c) @ r.T + c
            d = np.sqrt(np.maximum((p * p).sum(1)[:, None] + (views[b] ** 2).sum(1)[None] - 2 * p @ views[b].T, 0).min(1))
            total.append(np.sort(d)[: max(1, int(np.ceil(share * len(d))))])
        return float(np.sqrt(np.mean(np.concatenate(total) ** 2))) if total else np.inf

    best = (cost(np.asarray(start, float)), np.asarray(start, float))
    for k in range(rounds):
        middle = best[1]
        for i in np.linspace(-1, 1, grid):
            for j in np.linspace(-1, 1, grid):
                c = middle + reach / 2**k * (i * x + j * z)
                best = min(best, (cost(c), c), key=lambda b: b[0])
    return best[1], best[0]


def adjust_turntable(matches: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]], turn: float, axis: np.ndarray, centre: np.ndarray, most_tilt: float = 0.05, most_shift: float = 5.0, most_angle: float = 0.02, tangential: float = 0.1, prior: float = 1.0, huber: float = 1.0, rounds: int = 4) -> tuple[np.ndarray, np.ndarray, dict[int, float], float]:
    """Axis, centre and each pose's angle correction that make matched points of neighbouring views meet, and the RMS point-to-plane
    distance left.

    ``matches`` are (pose a, pose b, points of a, points of b, normals of b). All views are turned back to the first pose's frame; a
    residual is the distance along b's normal, ``tangential`` of the rest, and every parameter's share of its bound times ``prior``.
    Rounds reweight residuals over ``huber`` and solve inside the bounds; the first pose's angle stays.
    """
    from ..functions.geometry import rotation
    from .fitting import damped_least_squares

    y = np.asarray(axis, float) / np.linalg.norm(axis)
    side = np.eye(3)[int(np.argmin(np.abs(y)))]
    x = side - y * (side @ y)
    x /= np.linalg.norm(x)
    z, start = np.cross(x, y), np.asarray(centre, float)
    poses = sorted({p for m in matches for p in m[:2]})
    bound = np.r_[most_tilt, most_tilt, most_shift, most_shift, np.full(len(poses) - 1, most_angle)]
    weights = [np.ones(len(m[2])) for m in matches]

    def at(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict]:
        a = y + v[0] * x + v[1] * z
        return a / np.linalg.norm(a), start + v[2] * x + v[3] * z, dict(zip(poses, [0.0, *v[4:]], strict=True))

    def parts(v: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        a, c, fix = at(v)
        back = {p: rotation(a, -p * turn - fix[p]) for p in poses}
        out = []
        for i, j, p, q, n in matches:
            d, m = (p - c) @ back[i].T - (q - c) @ back[j].T, n @ back[j].T
            along = (d * m).sum(1)
            out.append((along, d - along[:, None] * m))
        return out

    def residual(v: np.ndarray) -> np.ndarray:
        rows = [np.r_[along * np.sqrt(w), (tangential * rest * np.sqrt(w)[:, None]).ravel()] for (along, rest), w in zip(parts(v), weights, strict=True)]
        return np.concatenate([*rows, prior * v / bound])

    v = np.zeros(len(bound))
    for _ in range(rounds):
        v = damped_least_squares(residual, v, (-bound, bound))
        weights = [np.minimum(1.0, huber / np.maximum(np.abs(along), 1e-12)) for along, _ in parts(v)]
    a, c, fix = at(v)
    return a, c, fix, float(np.sqrt(np.mean(np.concatenate([along for along, _ in parts(v)]) ** 2)))


def propose_shift(views: dict[int, np.ndarray], turn: float, axis: np.ndarray, centre: np.ndarray, reach: float, least_gain: float = 0.02, seed: int = 0) -> tuple[np.ndarray, bool, float, float]:
    """A better centre found on half of each view's points and judged on the other half: centre, accepted, error before, error after."""
    rng = np.random.default_rng(seed)
    first = {p: rng.random(len(v)) < 0.5 for p, v in sorted(views.items())}
    found, _ = search_centre({p: v[first[p]] for p, v in views.items()}, turn, axis, centre, reach)
    held = {p: v[~first[p]] for p, v in views.items()}
    before, after = (search_centre(held, turn, axis, c, 0.0, rounds=1, grid=1)[1] for c in (centre, found))
    accepted = after <= (1 - least_gain) * before
    return (found if accepted else np.asarray(centre, float)), accepted, before, after
