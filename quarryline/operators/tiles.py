"""Counts over all pairs of many faces, tile by tile, by small matrix products in single precision.

Three products settle nearly every pair: corners against the other's plane, and sides against the other's sides (Plücker coordinates; a line
goes through a triangle if it passes all three sides the same way round). Coordinates are taken from the middle of the task's faces, in
units of half their widest extent, so a product is off by less than ``ERROR``. A value within its limit of zero leaves the pair open, and
open pairs go to the exact predicates. Limits hold those of ``contacts.count_all``, so what is settled here is what they would say.
"""

from __future__ import annotations

from collections import Counter

import numpy as np

TILE, GROUP, OPEN = 256, 128, 16_384  # TILE: a multiple of 8
ERROR, LIMIT = 2e-6, 2e-6


def tiled(p: np.ndarray, most: int) -> np.ndarray:
    """Rows of ``p`` (n, 3) in an order whose runs of ``most`` are compact."""
    out, left = [], [np.arange(len(p))]
    while left:
        i = left.pop()
        if len(i) <= most:
            out.append(i)
            continue
        q = p[i]
        k = -(-len(i) // (2 * most)) * most  # all but the last tile are full
        order = np.argpartition(q[:, np.argmax(q.max(0) - q.min(0))], k - 1)
        left += [i[order[k:]], i[order[:k]]]
    return np.concatenate(out)


class Side:
    """One block of faces (n, 3, 3) in tiles; ``lo`` and ``hi`` are its boxes as ranks, ``ids`` the ranks of its ids."""

    def __init__(self, t: np.ndarray, lo: np.ndarray, hi: np.ndarray, ids: np.ndarray, middle: np.ndarray, unit: float):
        at = tiled(t.min(1) / 2 + t.max(1) / 2, TILE)
        self.t, self.ids, n = t[at], ids[at], len(at)
        self.size = -(-n // TILE)
        p = (self.t - middle) / unit
        edges = np.roll(p, -1, 1) - p
        normal = np.cross(edges[:, 0], p[:, 2] - p[:, 0])
        area, sides = np.sqrt((normal * normal).sum(1)), np.sqrt((edges * edges).sum(2))
        with np.errstate(all="ignore"):
            limit = ERROR + np.maximum(np.maximum(LIMIT, 8e-8 / area), 1e-9 / (area * unit) / unit / unit)
            normal = normal / area[:, None]
            along = edges / sides[:, :, None]
            solid = (area > 8e-9) & (area > 1e-6 * sides.max(1) ** 2) & (sides.min(1) > 1e-8) & np.isfinite(limit)
            planes = np.c_[normal, -(normal * p[:, 0]).sum(1)] / limit[:, None]
        turn = np.cross(p, along)
        lines, flipped = (np.concatenate(x, 2) for x in ((along, turn), (turn, along)))
        kept = lambda x: self._tiles(np.where(solid.reshape(-1, *[1] * (x.ndim - 1)), x, 0.0).astype(np.float32))
        right = lambda x: np.ascontiguousarray(x.swapaxes(-1, -2))
        self.planes, self.corners = kept(planes), kept(np.concatenate([p, np.ones((n, 3, 1))], 2)).swapaxes(1, 2).copy()
        self.lines, flipped = kept(lines / (ERROR + LIMIT)).swapaxes(1, 2).copy(), kept(flipped).swapaxes(1, 2)
        self.planes_t, self.corners_t, self.flipped_t = right(self.planes), right(self.corners), right(flipped)
        self.lo, self.hi, self.rank = self._tiles(lo[at], np.iinfo(np.int32).max), self._tiles(hi[at], -1), self._tiles(ids[at], -1)
        self.least, self.most = self.lo.min(1), self.hi.max(1)

    def meeting(self, some: np.ndarray, other: Side, j: int) -> np.ndarray:
        """Which boxes of the tiles ``some`` meet those of the other's tile ``j``: (len(some), TILE, TILE), packed to bits.

        Boxes that begin before a value, or end after it, are those up to, or from, a place in their order: one row of bits for each place."""
        out, places = None, np.arange(TILE + 1)[:, None]
        for k in range(3):
            for mine, theirs, right in ((self.hi, other.lo[j, :, k], True), (self.lo, other.hi[j, :, k], False)):
                order = np.argsort(theirs)
                place = np.argsort(order)
                bits = np.packbits(place < places if right else place >= places, axis=1)
                row = bits[np.searchsorted(theirs[order], mine[some, :, k], "right" if right else "left")]
                out = row if out is None else np.bitwise_and(out, row, out=out)
        return out

    def _tiles(self, x: np.ndarray, empty: float = 0) -> np.ndarray:
        out = np.full((self.size * TILE, *x.shape[1:]), empty, x.dtype)
        out[: len(x)] = x
        return out.reshape(self.size, TILE, *x.shape[1:])


def _same(up: np.ndarray, down: np.ndarray) -> np.ndarray:
    return (up[0] & up[1] & up[2]) | (down[0] & down[1] & down[2])


def _any(x: np.ndarray) -> np.ndarray:
    return x[0] | x[1] | x[2]


def _all(x: np.ndarray) -> np.ndarray:
    return x[0] & x[1] & x[2]


NEXT = [1, 2, 0]


def _settled(a: Side, i: int, b: Side, j: int, met: np.ndarray, room: dict) -> tuple[int, np.ndarray]:
    """The number of ``met`` pairs that clearly cross, and which are open; all others are separate."""
    s = np.matmul(a.planes[i], b.corners_t[j], out=room["b"])
    up_b, down_b = s > 1, s < -1
    s = np.matmul(a.corners[i], b.planes_t[j], out=room["a"])
    up_a, down_a = s > 1, s < -1
    left = met & ~(_same(up_a, down_a) | _same(up_b, down_b))
    if not left.any():
        return 0, left
    x = np.matmul(a.lines[i][:, None], b.flipped_t[j][None], out=room["lines"])
    up, down = x > 1, x < -1
    known = up | down
    clear = _all(up_a | down_a) & _all(up_b | down_b) & _all(known[0]) & _all(known[1]) & _all(known[2])
    through_b = _same(up.swapaxes(0, 1), down.swapaxes(0, 1)) & (up_a ^ up_a[NEXT])
    through_a = _same(up, down) & (up_b ^ up_b[NEXT])
    hit = left & clear & (_any(through_a) | _any(through_b))
    return int(np.count_nonzero(hit)), left & ~clear


def count_pairs(t: np.ndarray, ids: np.ndarray, second: np.ndarray, exact) -> Counter:
    """Classes of the pairs, of different ids and boxes that meet, between faces (n, 3, 3) of the first and of the ``second`` kind; of all
    pairs among them if there are none of the second. ``exact(a, b)`` counts what is left open; ``a`` has the smaller ids."""
    ids = np.unique(ids, return_inverse=True)[1].astype(np.int32)
    low, high = t.min(1), t.max(1)
    ranks = [np.unique(np.r_[low[:, k], high[:, k]], return_inverse=True)[1].astype(np.int32).reshape(2, -1) for k in range(3)]
    lo, hi = (np.stack([r[s] for r in ranks], 1) for s in (0, 1))
    middle, unit = low.min(0) / 2 + high.max(0) / 2, float((high.max(0) / 2 - low.min(0) / 2).max())
    side = lambda at: Side(t[at], lo[at], hi[at], ids[at], middle, unit if unit > 0 else 1.0)
    one = not second.any()
    a = side(~second)
    b = a if one else side(second)
    out, waiting, n = Counter(), [], 0
    room = {k: np.empty((*s, TILE, TILE), np.float32) for k, s in (("a", (3,)), ("b", (3,)), ("lines", (3, 3)))}
    upper, twice = np.triu(np.ones((TILE, TILE), bool), 1), len(np.unique(ids)) < len(ids)

    def clear_up() -> None:
        nonlocal n
        if waiting:
            every = [np.concatenate(x) for x in zip(*waiting, strict=True)]
            for s in range(0, n, OPEN):
                i, j = (x[s : s + OPEN] for x in every)
                swap = (a.ids[i] > b.ids[j])[:, None, None]
                p, q = a.t[i], b.t[j]
                out.update(exact(np.where(swap, q, p), np.where(swap, p, q)))
        waiting.clear()
        n = 0

    for j in range(b.size):
        some = np.flatnonzero(((a.least <= b.most[j]) & (a.most >= b.least[j])).all(1))
        some = some[some <= j] if one else some
        for g in range(0, len(some), GROUP):
            for i, bits in zip(some[g : g + GROUP], a.meeting(some[g : g + GROUP], b, j), strict=True):
                met = np.unpackbits(bits, axis=1).view(bool)
                if one and i == j:
                    met &= upper
                if twice:
                    met &= a.rank[i][:, None] != b.rank[j]
                pairs = int(np.count_nonzero(met))
                if not pairs:
                    continue
                crossing, open_ = _settled(a, i, b, j, met, room)
                rows = np.flatnonzero(open_.any(1))
                p, q = np.nonzero(open_[rows])
                out["crossing"] += crossing
                out["separate"] += pairs - crossing - len(p)
                if len(p):
                    waiting.append((i * TILE + rows[p], j * TILE + q))
                    n += len(p)
                if n >= OPEN:
                    clear_up()
    clear_up()
    return out
