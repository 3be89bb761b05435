"""Contacts of triangle pairs: candidates by grids of the levels of their boxes, classes by exact predicates in Arrow batches. Mere counts go
over blocks of faces by products of matrices (``tiles``), which leave few pairs to these predicates.

Classes: separate, shared_vertex, shared_edge (allowed); touching, crossing, coplanar_overlap, duplicate, degenerate (blocking).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import near
from .boxes import SIDES, around, finite, in_blocks, leaves_within, meeting, tree
from .graph import cut
from .mesh import corners
from .tiles import count_pairs

NINE = tuple(f"{k}{x}" for k in "abc" for x in "xyz")
BLOCKS, LEAST, LARGEST, LINKS = 16, 512, 131_072, 100_000
ALLOWED = ("separate", "shared_vertex", "shared_edge")
BLOCKING = ("touching", "crossing", "coplanar_overlap", "duplicate", "degenerate")


def segment_hits(p: np.ndarray, q: np.ndarray, t: np.ndarray, eps: float) -> bool:
    """True if the segment meets the triangle away from their shared plane."""
    e1, e2, d = t[1] - t[0], t[2] - t[0], q - p
    h = np.cross(d, e2)
    det = float(e1 @ h)
    if abs(det) < eps:
        return False
    s = p - t[0]
    u = float(s @ h) / det
    k = np.cross(s, e1)
    v, w = float(d @ k) / det, float(e2 @ k) / det
    return -eps <= u and -eps <= v and u + v <= 1 + eps and -eps <= w <= 1 + eps


def clip_polygon(subject: list, clip: list, eps: float = 1e-9) -> list:
    """What of a convex polygon lies inside another, both counter-clockwise in the plane."""
    out = subject
    for a, b in zip(clip, clip[1:] + clip[:1], strict=True):
        side = lambda p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])  # noqa: B023, E731
        ring, out = out, []
        for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
            sp, sq = side(p), side(q)
            if sp >= -eps:
                out.append(p)
            if (sp >= -eps) != (sq >= -eps):
                f = sp / (sp - sq)
                out.append((p[0] + f * (q[0] - p[0]), p[1] + f * (q[1] - p[1])))
        if not out:
            return []
    return out


def area(ring: list) -> float:
    return 0.5 * sum(p[0] * q[1] - p[1] * q[0] for p, q in zip(ring, ring[1:] + ring[:1], strict=True)) if len(ring) > 2 else 0.0


def classify(a: np.ndarray, b: np.ndarray, eps: float = 1e-9) -> str:
    na, nb = np.cross(a[1] - a[0], a[2] - a[0]), np.cross(b[1] - b[0], b[2] - b[0])
    size = max(np.ptp(np.r_[a, b], axis=0).max(), 1e-12)
    if min(np.linalg.norm(na), np.linalg.norm(nb)) < eps * size * size:
        return "degenerate"
    same = [(i, j) for i in range(3) for j in range(3) if np.abs(a[i] - b[j]).max() <= eps * size]
    if len({i for i, _ in same}) == 3:
        return "duplicate"
    unit = na / np.linalg.norm(na)
    if np.abs((b - a[0]) @ unit).max() <= 1e-7 * size:
        keep = [k for k in range(3) if k != int(np.argmax(np.abs(unit)))]
        flat = [[tuple(x) for x in t[:, keep]] for t in (a, b)]
        flat = [f if area(f) > 0 else f[::-1] for f in flat]
        if area(clip_polygon(*flat)) > 1e-9 * size * size:
            return "coplanar_overlap"
        return "shared_edge" if len(same) == 2 else "shared_vertex" if same else "separate"
    if len(same) == 2:
        return "shared_edge"
    hits = [segment_hits(s[i], s[j], t, 1e-9) for s, t, mine in ((a, b, 0), (b, a, 1)) for i, j in ((0, 1), (1, 2), (2, 0)) if not same or {p[mine] for p in same}.isdisjoint({i, j})]
    if same:
        return "crossing" if any(hits) else "shared_vertex"
    if not any(hits):
        return "separate"
    inside = [(a - b[0]) @ nb, (b - a[0]) @ na]
    proper = all(x.max() > 1e-9 * size**3 and x.min() < -1e-9 * size**3 for x in inside)
    return "crossing" if proper else "touching"


def _hits_all(a: np.ndarray, b: np.ndarray, eps: float = 1e-9) -> np.ndarray:
    """Whether any side of each triangle of ``a`` meets that of ``b``, away from their shared plane."""
    e1, e2 = b[:, 1] - b[:, 0], b[:, 2] - b[:, 0]
    out = np.zeros(len(a), bool)
    for i, j in ((0, 1), (1, 2), (2, 0)):
        d, s = a[:, j] - a[:, i], a[:, i] - b[:, 0]
        h = np.cross(d, e2)
        det = (e1 * h).sum(1)
        ok = np.abs(det) >= eps
        safe = np.where(ok, det, 1.0)
        k = np.cross(s, e1)
        u, v, w = (s * h).sum(1) / safe, (d * k).sum(1) / safe, (e2 * k).sum(1) / safe
        out |= ok & (u >= -eps) & (v >= -eps) & (u + v <= 1 + eps) & (w >= -eps) & (w <= 1 + eps)
    return out


def _less(u: list, v: list) -> list:
    return [x - y for x, y in zip(u, v, strict=True)]


def _cross(u: list, v: list) -> list:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def _dot(u: list, v: list) -> np.ndarray:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def _side_hits(p: list, q: list, t: list, eps: float = 1e-9) -> np.ndarray:
    """``segment_hits`` of many, each coordinate an array."""
    e1, e2, d, s = _less(t[1], t[0]), _less(t[2], t[0]), _less(q, p), _less(p, t[0])
    h, k = _cross(d, e2), _cross(s, e1)
    det = _dot(e1, h)
    ok = np.abs(det) >= eps
    safe = np.where(ok, det, 1.0)
    u, v, w = _dot(s, h) / safe, _dot(d, k) / safe, _dot(e2, k) / safe
    return ok & (u >= -eps) & (v >= -eps) & (u + v <= 1 + eps) & (w >= -eps) & (w <= 1 + eps)


def count_all(a: np.ndarray, b: np.ndarray, eps: float = 1e-9) -> Counter:
    """How many pairs ``classify_all`` gives each class: first those clearly on one side of the other's plane, then those clearly through it or
    past it, by arrays for each coordinate; what is close to a limit or shares a corner goes to ``classify_all``."""
    out: Counter = Counter()
    low, high = np.minimum(a.min(1), b.min(1)), np.maximum(a.max(1), b.max(1))
    size = np.maximum((high - low).max(1), 1e-12)
    take = lambda t, at: [[np.ascontiguousarray(t[at, k, c]) for c in range(3)] for k in range(3)]
    at, lengths = np.arange(len(a)), {}
    for k, t in (("a", take(a, at)), ("b", take(b, at))):
        n = _cross(_less(t[1], t[0]), _less(t[2], t[0]))
        lengths[k] = np.sqrt(_dot(n, n))
    solid = np.minimum(lengths["a"], lengths["b"]) >= eps * size * size * (1 + 1e-6)
    for name, first, second in (("a", a, b), ("b", b, a)):
        t, o, s, length = take(first, at), take(second, at), size[at], lengths[name][at]
        n = _cross(_less(t[1], t[0]), _less(t[2], t[0]))
        side = [_dot(_less(o[k], t[0]), n) for k in range(3)]
        least = np.maximum(1e-7 * s * length, eps * s**3) * (1 + 1e-6)
        apart = (np.minimum(np.minimum(*side[:2]), side[2]) > least) | (np.maximum(np.maximum(*side[:2]), side[2]) < -least)
        apart &= solid[at]
        out["separate"] += int(apart.sum())
        at = at[~apart]
    if not len(at):
        return out
    p, q, s = take(a, at), take(b, at), size[at]
    n, m = _cross(_less(p[1], p[0]), _less(p[2], p[0])), _cross(_less(q[1], q[0]), _less(q[2], q[0]))
    la, lb = np.sqrt(_dot(n, n)), np.sqrt(_dot(m, m))
    side_b, side_a = [_dot(_less(x, p[0]), n) for x in q], [_dot(_less(x, q[0]), m) for x in p]
    far_b, far_a = 1e-6 * s * la, 1e-6 * s * lb  # a shared corner would lie in both planes
    clear = (np.minimum(la, lb) >= 1e-8 * s * s) & (far_b > 1e-8 * s**3) & (far_a > 1e-8 * s**3)
    for v in side_b:
        clear &= np.abs(v) > far_b
    for v in side_a:
        clear &= np.abs(v) > far_a
    hit = np.zeros(len(at), bool)
    for x, y in ((p, q), (q, p)):
        for i, j in ((0, 1), (1, 2), (2, 0)):
            hit |= _side_hits(x[i], x[j], y)
    out["crossing"] += int((clear & hit).sum())
    out["separate"] += int((clear & ~hit).sum())
    rest = at[~clear]
    out.update(classify_all(a[rest], b[rest], eps))
    return out


def classify_all(a: np.ndarray, b: np.ndarray, eps: float = 1e-9) -> list[str]:
    """``classify`` of many pairs: pairs without a shared corner and off each other's plane by arrays, the rest one by one."""
    if not len(a):
        return []
    na, nb = np.cross(a[:, 1] - a[:, 0], a[:, 2] - a[:, 0]), np.cross(b[:, 1] - b[:, 0], b[:, 2] - b[:, 0])
    size = np.maximum(np.ptp(np.concatenate([a, b], 1), axis=1).max(1), 1e-12)
    la, lb = np.linalg.norm(na, axis=1), np.linalg.norm(nb, axis=1)
    shared = (np.abs(a[:, :, None] - b[:, None]).max(3) <= eps * size[:, None, None]).any((1, 2))
    off = np.einsum("nij,nj->ni", b - a[:, :1], na / np.maximum(la, 1e-300)[:, None])
    plain = ~shared & (np.minimum(la, lb) >= eps * size * size) & (np.abs(off).max(1) > 1e-7 * size)
    out = np.full(len(a), "separate", object)
    for i in np.flatnonzero(~plain):
        out[i] = classify(a[i], b[i], eps)
    at = np.flatnonzero(plain)
    side_b, side_a = np.einsum("nij,nj->ni", b[at] - a[at, :1], na[at]), np.einsum("nij,nj->ni", a[at] - b[at, :1], nb[at])
    tiny = 1e-9 * size[at] ** 3
    near = (side_b.max(1) >= -tiny) & (side_b.min(1) <= tiny) & (side_a.max(1) >= -tiny) & (side_a.min(1) <= tiny)
    at, side_a, side_b, tiny = at[near], side_a[near], side_b[near], tiny[near]
    hit = _hits_all(a[at], b[at]) | _hits_all(b[at], a[at])
    proper = (side_a.max(1) > tiny) & (side_a.min(1) < -tiny) & (side_b.max(1) > tiny) & (side_b.min(1) < -tiny)
    out[at[hit]] = np.where(proper, "crossing", "touching")[hit]
    return out.tolist()


def contacts(faces: DataFrame, vertices: DataFrame, cell: float = 1.0) -> DataFrame:
    """fa < fb and category of every pair of faces whose boxes meet. ``cell`` is the unit of the grids' levels and changes no result.

    Faces with a corner that is missing, null or not finite meet nothing.
    """
    ship(faces.sparkSession)
    wide = finite(corners(faces, vertices), NINE)
    for x in "xyz":
        wide = wide.withColumns({f"lo{x}": F.least(f"a{x}", f"b{x}", f"c{x}"), f"hi{x}": F.greatest(f"a{x}", f"b{x}", f"c{x}")})
    met = meeting(wide.select("fid", *NINE, *SIDES), "fid", cell)
    met = met.select("pfid", "qfid", *[f"{s}{c}" for s in "pq" for c in NINE])

    def run(batches):
        for g in batches:
            p, q = (g[[f"{s}{k}{x}" for k in "abc" for x in "xyz"]].to_numpy(float).reshape(-1, 3, 3) for s in "pq")
            yield pd.DataFrame({"fa": g["pfid"], "fb": g["qfid"], "category": classify_all(p, q)})

    kind = dict(faces.dtypes)["fid"]
    return met.mapInPandas(run, f"fa {kind}, fb {kind}, category string")


def contact_counts(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """category and n: how many of ``contacts`` are of each class. Every pair whose boxes meet is looked at, but none is a row.

    A task takes two blocks of faces, or one with itself. Blocks are about ``BLOCKS``, so a face is shuffled BLOCKS times at most, as long
    as they hold no more than ``LARGEST`` faces.
    """
    spark = faces.sparkSession
    ship(spark)
    wide = cut(finite(corners(faces, vertices), NINE).where("fid is not null").select("fid", *NINE))
    sides = {f"{s}{x}": f(f"a{x}", f"b{x}", f"c{x}") for s, f in (("lo", F.least), ("hi", F.greatest)) for x in "xyz"}
    place = {x: F.col(f"lo{x}") / 2 + F.col(f"hi{x}") / 2 for x in "xyz"}
    blocks = cut(in_blocks(wide.withColumns(sides), place, "fid", min(max(-(-wide.count() // BLOCKS), LEAST), LARGEST)))
    own = cut(around(blocks, "block"))
    n = own.count()
    if not n:
        return spark.createDataFrame([], "category string, n long")
    boxed = own.select("block", *[F.col(c).alias(f"b_{c}") for c in SIDES], F.lit(0.0).alias("most"))
    pairs = leaves_within(boxed, tree(own), "most").where("block <= node").withColumn("task", F.col("block") * n + F.col("node"))
    second = pairs.where("block < node").select(F.col("node").alias("block"), "task", F.lit(True).alias("second"))
    links = cut(pairs.select("block", "task", F.lit(False).alias("second")).unionByName(second))
    m = links.count()
    rows = blocks.select("block", "fid", *NINE).join(F.broadcast(links) if m <= LINKS else links, "block").drop("block")

    def run(table: pa.Table) -> pa.Table:
        t, at = near.numbers(table, *NINE).T.reshape(-1, 3, 3), table.column("second").to_numpy()
        some = {k: v for k, v in count_pairs(t, table.column("fid").to_numpy(), at, count_all).items() if v}
        return pa.table({"category": pa.array(list(some), pa.string()), "n": pa.array(list(some.values()), pa.int64())})

    counts = rows.repartition(min(m, near.TASKS), "task").groupBy("task").applyInArrow(run, "category string, n long")
    return counts.groupBy("category").agg(F.sum("n").alias("n"))


def _largest(fits, steps: int) -> float:
    """The largest share found by bisection for which ``fits`` holds; 0 is taken to."""
    lo, hi = 0.0, 1.0
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if fits(mid) else (lo, mid)
    return lo


def intersection_guard(original: DataFrame, moved: DataFrame, faces: DataFrame, cell: float, rounds: int = 8, rings: int = 2, widenings: int = 4, floor: float = 0.25, steps: int = 6) -> DataFrame:
    """``moved`` without faces that newly touch in a blocking way, losing as little of the move as three ways allow.

    First the vertices of such faces, and of faces that turn over, go back, for up to ``rounds`` rounds. If that doesn't settle, the
    vertices of all conflicts seen and ``rings`` rings around them keep a share of their move, which grows from the conflicts to
    ``floor`` at the outermost ring's weight; the share at the conflicts is bisected, and rings are widened up to ``widenings`` times.
    If no share does, the whole move is bisected; the original is the last resort.
    """
    from .mesh import edges, face_geometry

    moved = cut(moved.select("vid", "x", "y", "z"))
    known = cut(contacts(faces, original, cell).where(F.col("category").isin(*BLOCKING)).select("fa", "fb"))
    clash = lambda v: cut(contacts(faces, v, cell).where(F.col("category").isin(*BLOCKING)).join(known, ["fa", "fb"], "left_anti"))
    free = lambda v: clash(v).limit(1).count() == 0
    before = face_geometry(faces, original).select("fid", F.col("nx").alias("ox"), F.col("ny").alias("oy"), F.col("nz").alias("oz"))
    corners_of = lambda ids: faces.join(ids, "fid", "left_semi").select(F.explode(F.array("a", "b", "c")).alias("vid")).distinct()
    current, frozen, seen = moved, None, None
    for _ in range(rounds):
        turned = face_geometry(faces, current).join(before, "fid").where("nx * ox + ny * oy + nz * oz < 0").select("fid")
        new = clash(current).select(F.explode(F.array("fa", "fb")).alias("fid"))
        bad = cut(corners_of(new.unionByName(turned).distinct()))
        if bad.limit(1).count() == 0:
            return current
        seen = bad if seen is None else cut(seen.unionByName(bad).distinct())
        wider = bad if frozen is None else cut(frozen.unionByName(bad).distinct())
        if frozen is not None and wider.count() == frozen.count():
            break
        frozen = wider
        current = cut(moved.join(frozen, "vid", "left_anti").unionByName(original.select("vid", "x", "y", "z").join(frozen, "vid", "left_semi")))
    e = edges(faces).select("lo", "hi")
    near = cut(e.unionByName(e.select(F.col("hi").alias("lo"), F.col("lo").alias("hi"))))
    pairs = cut(original.select("vid", "x", "y", "z").join(moved.toDF("vid", "mx", "my", "mz"), "vid"))
    for widening in range(widenings):
        n = rings + widening
        reached = seen.withColumn("ring", F.lit(0))
        for ring in range(1, n + 1):
            step = near.join(reached.select(F.col("vid").alias("lo")), "lo", "left_semi").select(F.col("hi").alias("vid")).distinct().join(reached, "vid", "left_anti")
            reached = cut(reached.unionByName(step.withColumn("ring", F.lit(ring))))
        weight = reached.select("vid", (1.0 - F.col("ring") / (n + 1) * (1.0 - floor)).alias("w"))
        both = cut(pairs.join(weight, "vid", "left").fillna(0.0, ["w"]))
        at = lambda beta, both=both: cut(both.select("vid", *[(F.col(x) + (1 - F.col("w") * (1 - F.lit(beta))) * (F.col(f"m{x}") - F.col(x))).alias(x) for x in "xyz"]))
        if free(at(0.0)):
            return at(_largest(lambda beta, at=at: free(at(beta)), steps))
    whole = lambda share: cut(pairs.select("vid", *[(F.col(x) + share * (F.col(f"m{x}") - F.col(x))).alias(x) for x in "xyz"]))
    return whole(_largest(lambda share: free(whole(share)), steps))
