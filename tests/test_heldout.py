"""Fits without one pose, by sums, against direct fits."""

import numpy as np
import pytest

from quarryline.operators import heldout

RADIUS, VOXEL, FLOOR, COS = 3.0, 1.0, 0.02, 0.8


def neighbourhood(seed, poses, n, noise, bad=None):
    rng = np.random.default_rng(seed)
    pose = rng.choice(poses, n)
    u, v = rng.uniform(-1, 1, (2, n))
    z = 0.2 + 0.3 * u - 0.1 * v + 0.4 * u * u - 0.2 * v * v + rng.normal(0, noise, n)
    if bad is not None:
        z[pose == bad] += 1.5
    m = np.stack([-(0.3 + 0.8 * u) / RADIUS, -(-0.1 - 0.4 * v) / RADIUS, np.ones(n)], 1) + rng.normal(0, 0.01, (n, 3))
    m /= np.linalg.norm(m, axis=1)[:, None]
    return pose, u, v, z, rng.uniform(0.3, 1, n), m


def direct(pose, u, v, z, w, m):
    """By lstsq over gathered rows; the frame is that of the axes."""
    names = np.unique(pose)
    if len(names) < 4:
        return None
    full = np.stack([np.ones(len(u)), u, v, u * u, u * v, v * v], 1)
    told = []
    for out in sorted({names[int(np.rint(f * (len(names) - 1)))] for f in (0, 0.5, 1)}):
        keep = pose != out
        if keep.sum() < 12 or len(set(pose[keep])) < 3 or (~keep).sum() < 2:
            continue
        r = w[keep].copy()
        for _ in range(4):
            s = np.sqrt(r)
            c = np.linalg.lstsq(full[keep] * s[:, None], z[keep] * s, rcond=None)[0]
            off = z[keep] - full[keep] @ c
            mid = {p: np.median(off[pose[keep] == p]) for p in set(pose[keep])}
            inner = 1.4826 * np.median(np.abs(off - np.array([mid[p] for p in pose[keep]])))
            outer = np.array(list(mid.values()))
            outer = 1.4826 * np.median(np.abs(outer - np.median(outer)))
            sigma = np.sqrt(FLOOR**2 + inner**2 + outer**2)
            r = w[keep] * np.minimum(1, 1.5 * min(sigma, 0.3 * VOXEL) / np.maximum(np.abs(off), 1e-12))
        e = np.abs(z[~keep] - full[~keep] @ c)
        gx = (c[1] + 2 * c[3] * u[~keep] + c[4] * v[~keep]) / RADIUS
        gy = (c[2] + c[4] * u[~keep] + 2 * c[5] * v[~keep]) / RADIUS
        side = np.stack([-gx, -gy, np.ones(len(gx))], 1)
        dot = np.median((side / np.linalg.norm(side, axis=1)[:, None] * m[~keep]).sum(1))
        e50, e90 = np.median(e), np.percentile(e, 90)
        told.append((e50, e90, dot, e50 <= max(0.18 * VOXEL, 2.5 * sigma) and e90 <= max(0.35 * VOXEL, 3.5 * sigma) and dot >= COS))
    if not told:
        return None
    return len(told), sum(x[3] for x in told), *(float(np.median([x[i] for x in told])) for i in range(3))


def test_same_as_direct_fits(spark):
    cases = {1: neighbourhood(1, range(6), 80, 0.02), 2: neighbourhood(2, range(5), 60, 0.05, bad=0), 3: neighbourhood(3, range(3), 40, 0.02), 4: neighbourhood(4, range(4), 14, 0.02), 5: neighbourhood(5, range(10, 18), 120, 0.2, bad=14)}
    flat = neighbourhood(6, range(5), 50, 0.02)
    cases[6] = (flat[0], flat[1], flat[1].copy(), *flat[3:])  # a line: no quadratic
    rows = [(k, int(p), *map(float, (a, b, c, d)), *map(float, n)) for k, some in cases.items() for p, a, b, c, d, n in zip(*some, strict=True)]
    df = spark.createDataFrame([*rows, (1, None, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0), (None, 1, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0)], "seed long, pose int, u double, v double, z double, w double, nx double, ny double, nz double")
    frames = spark.createDataFrame([(k, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0) for k in cases], "seed long, " + ", ".join(f"{a}{i} double" for a in "ntb" for i in range(3)))
    got = {r["seed"]: (r["tests"], r["passed_tests"], r["median_abs_error"], r["p90_abs_error"], r["median_normal_dot"]) for r in heldout.cross_validated(df, frames, RADIUS, VOXEL, FLOOR, COS).collect()}
    want = {k: direct(*some) for k, some in cases.items() if k != 6}
    assert set(got) == {k for k, x in want.items() if x}
    for k, x in got.items():
        assert x[:2] == want[k][:2] and x[2:] == pytest.approx(want[k][2:], rel=1e-6, abs=1e-9)
    assert got[2][1] < got[2][0]  # the shifted pose fails
    assert heldout.cross_validated(df.where("false"), frames, RADIUS, VOXEL, FLOOR, COS).count() == 0
