"""Vectors and rigid transforms as column expressions; a pose table of a few rows is joined, never looped over."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


def length(v: tuple) -> Column:
    return F.sqrt(sum((F.col(c) * F.col(c) for c in v[1:]), F.col(v[0]) * F.col(v[0])))


def dot(a: tuple, b: tuple) -> Column:
    return sum((F.col(x) * F.col(y) for x, y in zip(a[1:], b[1:], strict=True)), F.col(a[0]) * F.col(b[0]))


def cross(a: tuple, b: tuple) -> list[Column]:
    a, b = [F.col(c) if isinstance(c, str) else c for c in a], [F.col(c) if isinstance(c, str) else c for c in b]
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def unit(v: tuple, smallest: float = 1e-12, otherwise: tuple = (0.0, 0.0, 0.0)) -> list[Column]:
    """v at length 1; shorter than ``smallest`` gives ``otherwise``."""
    n = length(v)
    return [F.when(n > smallest, F.col(c) / n).otherwise(F.lit(o)) for c, o in zip(v, otherwise, strict=True)]


def point_to_line(point: tuple, start: tuple, axis: tuple) -> Column:
    """Distance of a point from the line through ``start`` along the unit ``axis`` (numbers)."""
    d = [F.col(c) - s for c, s in zip(point, start, strict=True)]
    c = cross(tuple(d), tuple(F.lit(float(a)) for a in axis))
    return F.sqrt(c[0] * c[0] + c[1] * c[1] + c[2] * c[2])


def back_project(depth: str, u: str, v: str, fx: float, fy: float, cx: float, cy: float) -> list[Column]:
    z = F.col(depth)
    return [((F.col(u) - cx) * z / fx).alias("x"), ((F.col(v) - cy) * z / fy).alias("y"), z.alias("z")]


def transform(points: DataFrame, poses: DataFrame, pose: str = "pose_index", xyz: tuple = XYZ, normals: tuple | None = None) -> DataFrame:
    """Points, and normals if named, of each pose by that pose's r00..r22, tx, ty, tz; a join on the pose."""
    joined = points.join(poses, pose)
    move = lambda v, t: [sum((F.col(f"r{i}{j}") * F.col(v[j]) for j in (1, 2)), F.col(f"r{i}0") * F.col(v[0])) + (F.col(f"t{c}") if t else F.lit(0.0)) for i, c in enumerate("xyz")]
    new = dict(zip(xyz, move(xyz, True), strict=True))
    if normals:
        turned = move(normals, False)
        n = F.sqrt(turned[0] * turned[0] + turned[1] * turned[1] + turned[2] * turned[2])
        new |= {c: F.when(n > 1e-12, t / n).otherwise(t) for c, t in zip(normals, turned, strict=True)}
    return joined.withColumns(new).select(*points.columns)


def rotation(axis, angle: float) -> np.ndarray:
    """Rodrigues' rotation by ``angle`` radians; a zero or non-finite axis is an error."""
    a = np.asarray(axis, float)
    n = np.linalg.norm(a)
    if not np.isfinite(n) or n < 1e-12:
        raise ValueError("the axis has no direction")
    x, y, z = a / n
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k


def about_line(axis, centre, angle: float) -> np.ndarray:
    """4 x 4 rotation about the line through ``centre``."""
    out = np.eye(4)
    out[:3, :3] = rotation(axis, angle)
    out[:3, 3] = np.asarray(centre, float) - out[:3, :3] @ np.asarray(centre, float)
    return out


def frame_with_axis(axis, origin) -> np.ndarray:
    """Rigid 4 x 4 transform that takes ``axis`` to +Y and ``origin`` to zero; X comes from the coordinate axis least along it."""
    y = np.asarray(axis, float) / np.linalg.norm(axis)
    seed = np.eye(3)[int(np.argmin(np.abs(y)))]
    x = seed - y * (seed @ y)
    x /= np.linalg.norm(x)
    r = np.stack([x, y, np.cross(x, y)])
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = r, -r @ np.asarray(origin, float)
    return out


def poses_table(spark, matrices: dict[int, np.ndarray]) -> DataFrame:
    """pose_index, r00..r22, tx, ty, tz of 4 x 4 matrices."""
    names = ["pose_index", *[f"r{i}{j}" for i in range(3) for j in range(3)], "tx", "ty", "tz"]
    rows = [(int(p), *map(float, m[:3, :3].ravel()), *map(float, m[:3, 3])) for p, m in sorted(matrices.items())]
    return spark.createDataFrame(rows, ", ".join(f"{n} {'int' if n == 'pose_index' else 'double'}" for n in names))
