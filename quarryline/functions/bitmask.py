"""Sets of poses as bit masks in a BIGINT; up to 62 poses on a circle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pose_bit(pose: str) -> Column:
    return F.expr(f"shiftleft(1L, cast({pose} as int))")


def pose_mask(pose: str) -> Column:
    """Aggregate: the bits of all poses of a group; null for an empty group."""
    return F.bit_or(pose_bit(pose))


def pose_count(mask) -> Column:
    return F.bit_count(mask)


def pose_ids(mask: str, n: int) -> Column:
    return F.expr(f"filter(sequence(0, {n - 1}), i -> getbit({mask}, i) = 1)")


def angular_span(mask: str, n: int) -> Column:
    """The largest circular offset at which two poses of the mask lie."""
    full = (1 << n) - 1
    rotated = f"((shiftleft({mask}, i) | shiftright({mask}, {n} - i)) & {full}L)"
    return F.expr(f"coalesce(array_max(filter(sequence(1, {n // 2}), i -> ({mask} & {rotated}) <> 0)), 0)")


def circular_distance(a: str, b: str, n: int) -> Column:
    return F.expr(f"least(abs({a} - {b}), {n} - abs({a} - {b}))")


def diversity(mask: str, n: int, separation: int = 2) -> Column:
    """Size of the largest greedy subset of poses that lie ``separation`` or more apart on the circle, over all first poses."""
    ids = f"filter(sequence(0, {n - 1}), i -> getbit({mask}, i) = 1)"
    far = f"least(abs(p - q), {n} - abs(p - q)) >= {separation}"
    greedy = f"aggregate(transform(sequence(0, {n - 1}), k -> (s + k) % {n}), array(s), (kept, p) -> if(getbit({mask}, p) = 1 and forall(kept, q -> {far}), kept || array(p), kept), kept -> size(kept))"
    return F.expr(f"coalesce(array_max(transform({ids}, s -> {greedy})), 0)")
