"""Spanning forests, covers of conflicts and loops of any length against plain versions."""

import numpy as np
import pytest

from quarryline.operators import graph, mesh, sampling, surface


def kruskal(edges):
    root = {x: x for e in edges for x in e[:2]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    out = set()
    for w, u, v in sorted((w, min(u, v), max(u, v)) for u, v, w in edges if u != v):
        a, b = find(u), find(v)
        if a != b:
            root[a] = b
            out.add((u, v, w))
    return out


@pytest.mark.parametrize("ties", [False, True])
def test_spanning_forest(spark, ties):
    rng = np.random.default_rng(ties)
    edges = [(int(u), int(v), float(rng.integers(0, 3) if ties else rng.random())) for u, v in rng.integers(0, 60, (150, 2))] + [(100, 101, 1.0), (7, 7, 0.0), (101, 100, 0.5)]
    df = spark.createDataFrame([*edges, (1, 2, None), (None, 3, 0.0), (2, 3, float("nan"))], "u long, v long, w double")
    assert {tuple(r) for r in graph.spanning_forest(df).collect()} == kruskal(edges)
    assert graph.spanning_forest(df.where("false")).count() == 0


def one_by_one(conflicts, cost):
    open_, out = dict(conflicts), set()
    while open_:
        n = {}
        for members in open_.values():
            for m in members:
                n[m] = n.get(m, 0) + 1
        best = min(n, key=lambda m: (-n[m] / max(cost.get(m, 1.0), 1e-12), m))
        out.add(best)
        open_ = {c: m for c, m in open_.items() if best not in m}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_cover_is_that_of_one_by_one(spark, seed):
    rng = np.random.default_rng(seed)
    conflicts = {c: set(rng.integers(0, 40, rng.integers(1, 4)).tolist()) for c in range(70)}
    cost = {m: float(rng.integers(1, 4)) for m in range(30)}
    rows = spark.createDataFrame([(c, m) for c, some in conflicts.items() for m in some], "conflict long, member long")
    got = {r["member"] for r in sampling.greedy_cover(rows, spark.createDataFrame(list(cost.items()), "member long, cost double")).collect()}
    assert got == one_by_one(conflicts, cost)


def test_loops_are_those_of_following_them(spark):
    rng = np.random.default_rng(4)
    loops, used = [], 0
    names = rng.permutation(5000).tolist()
    for n in (1, 2, 3, 700, 9):
        loops.append(names[used : used + n])
        used += n
    steps = [(some[i], some[(i + 1) % len(some)]) for some in loops for i in range(len(some))]
    steps += [(6000, 6001), (6001, 6002)]  # not closed
    steps += [(7000, 7001), (7001, 7000), (7001, 7002), (7002, 7001)]  # a node twice
    got = {}
    for r in graph.loop_places(spark.createDataFrame(steps, "p long, q long")).collect():
        got.setdefault(r["component"], [None] * r["size"])[r["place"]] = r["node"]
    turned = {min(some): some[(k := some.index(min(some))) :] + some[:k] for some in loops}
    assert got == turned


def test_rings_up_to_a_length(spark):
    n = 12
    v = spark.createDataFrame([(i, float(np.cos(i)), float(np.sin(i)), float(z)) for z in (0, 1) for i in range(n * z, n * z + n)], "vid long, x double, y double, z double")
    tube = [t for i in range(n) for t in ((i, (i + 1) % n, n + i), ((i + 1) % n, n + (i + 1) % n, n + i))]
    f = spark.createDataFrame([(k, *t) for k, t in enumerate(tube)], "fid long, a long, b long, c long")
    rings = {r["component"]: r["ring"] for r in mesh.ordered_loops(f, v).collect()}
    assert rings == {0: list(range(n)), n: [n, *range(2 * n - 1, n, -1)]}
    assert mesh.ordered_loops(f, v, most=n - 1).count() == 0 and mesh.rim_places(f).count() == 2 * n


def test_normals_agree_on_each_patch(spark):
    """Two spheres whose normals have random signs, with a crease; each ends up pointing outwards as a whole."""
    rng = np.random.default_rng(3)
    out = rng.normal(size=(300, 3))
    out /= np.linalg.norm(out, axis=1)[:, None]
    at = out.copy()
    at[150:] = at[150:] * 0.5 + [8, 0, 0]
    sign = rng.choice([-1, 1], 300)
    rows = [(i, *map(float, p), *map(float, s * n)) for i, (p, n, s) in enumerate(zip(at, out, sign, strict=True))]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double, nx double, ny double, nz double")
    got = {r["id"]: (r["nx"], r["ny"], r["nz"]) for r in surface.orient_normals(df).collect()}
    assert all(np.dot(got[i], out[i]) > 0.99 for i in range(300))
