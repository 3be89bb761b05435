"""Scalar column expressions of measurement tables. All are built-in expressions, so they stay inside generated code.

Nulls propagate unless a function says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

POSES, STEPS_PER_TURN = 25, 2055
STEP_PATTERN = (82, 82, 83, 82, 82)


def _all(columns) -> Column:
    return reduce(lambda a, b: a & b, columns)


def is_finite(x) -> Column:
    """False for null, NaN and infinities."""
    x = F.col(x) if isinstance(x, str) else x
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def clip(x, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high)


def view_index(stem) -> Column:
    """Zero-based view number after ``_V``; null where there is none."""
    return F.nullif(F.regexp_extract(stem, r"(?i)_V(\d+)", 1), F.lit("")).cast("int") - 1


def angle_token(stem) -> Column:
    """Degrees after ``_A``: four digits or more are tenths; null where there is none."""
    token = F.nullif(F.regexp_extract(stem, r"(?i)_A(\d+)", 1), F.lit(""))
    return F.when(F.length(token) >= 4, token.cast("double") / 10).otherwise(token.cast("double"))


def session_order(name) -> Column:
    """Number of a session ``S##`` for sorting; other names come last."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"^S(\d+)$", 1), F.lit("")).cast("int"), F.lit(10**9))


def nominal_angle(pose) -> Column:
    return F.col(pose) * (360.0 / POSES) if isinstance(pose, str) else pose * (360.0 / POSES)


def steps_before(pose) -> Column:
    """Motor steps before a pose: the exclusive prefix sum of the repeating step pattern."""
    pose = F.col(pose) if isinstance(pose, str) else pose
    whole, rest = F.floor(pose / len(STEP_PATTERN)).cast("int"), F.pmod(pose, F.lit(len(STEP_PATTERN)))
    head = F.element_at(F.array(*[F.lit(sum(STEP_PATTERN[:i])) for i in range(len(STEP_PATTERN))]), (rest + 1).cast("int"))
    return whole * sum(STEP_PATTERN) + head


def physical_angle(pose) -> Column:
    return steps_before(pose) * 360.0 / STEPS_PER_TURN


def wrap_periodic(value, period: float = 360.0) -> Column:
    """Into [-period/2, period/2)."""
    return F.pmod(value + period / 2, F.lit(period)) - period / 2


def positive_delta(source, target) -> Column:
    d = F.pmod(F.col(target) - F.col(source), F.lit(360.0))
    return F.when(d < 1e-9, 0.0).otherwise(d)


def depth_from_disparity(disparity, focal: float, baseline: float, mask=None) -> Column:
    """focal * baseline / disparity where the disparity is finite, above 0.1 and inside the mask, else null."""
    ok = is_finite(disparity) & (F.col(disparity) > 0.1)
    return F.when(ok & F.coalesce(F.col(mask), F.lit(False)) if mask else ok, focal * baseline / F.col(disparity))


def centred_pixel(u, v, width: int, height: int) -> tuple[Column, Column]:
    return (F.col(u) - 0.5 * (width - 1)) / width, (F.col(v) - 0.5 * (height - 1)) / height


def affine(coefficients, u, v) -> Column:
    a, b, c = (F.lit(x) if not isinstance(x, Column) else x for x in coefficients)
    return a * u + b * v + c


def adaptive_tolerance(base: float, most: float, mad, rmse, factor: float) -> Column:
    """factor times the larger of 1.4826 MAD, RMSE and 0.75, kept in [base, most]."""
    return clip(factor * F.greatest(1.4826 * mad, rmse, F.lit(0.75)), base, most)


def quadratic(coefficients, u, v) -> Column:
    a, b, c, d, e, f = (F.lit(x) if not isinstance(x, Column) else x for x in coefficients)
    return a * u * u + b * v * v + c * u * v + d * u + e * v + f


def smoothstep(x) -> Column:
    z = clip(x, 0.0, 1.0)
    return z * z * (3 - 2 * z)


def lenient_double(x) -> Column:
    """A number, or NaN where there is none."""
    return F.coalesce(F.expr(f"try_cast(`{x}` as double)"), F.lit(float("nan")))


def lenient_bool(x) -> Column:
    return F.coalesce(F.lower(F.trim(x)).isin("1", "true", "yes", "si", "sí"), F.lit(False))


def stage_confidence(scores: list[Column]) -> Column:
    """Geometric mean of scores, each clipped to [0, 1]."""
    return F.pow(reduce(lambda a, b: a * b, [clip(s, 0.0, 1.0) for s in scores]), 1.0 / len(scores))


def match_state(valid, mutual, photo, tolerance, occluded) -> Column:
    """State of a stereo match by precedence: 5 occluded, 4 contradicted, 3 weak photo, 2 loose, 1 mutual, 0 none."""
    return F.when(~valid, 0).when(occluded, 5).when(mutual > 2 * tolerance, 4).when(photo, 3).when(mutual > tolerance, 2).otherwise(1)


def vote_passes(passed, tests, numerator: int, denominator: int) -> Column:
    """An integer vote; no tests at all pass."""
    return (tests == 0) | (passed * denominator >= tests * numerator)


def box_gap(a: tuple, b: tuple) -> Column:
    """Distance of two boxes (left, top, right, bottom)."""
    gap = lambda lo_a, hi_a, lo_b, hi_b: F.greatest(F.lit(0.0), F.col(lo_b) - F.col(hi_a), F.col(lo_a) - F.col(hi_b))
    return F.hypot(gap(a[0], a[2], b[0], b[2]), gap(a[1], a[3], b[1], b[3]))


def key_values(line) -> Column:
    """``k=v`` tokens of a line as a map; tokens without ``=`` are left out, and a value may hold further ``=``."""
    tokens = F.filter(F.split(line, r"\s+"), lambda t: t.contains("="))
    pairs = F.transform(tokens, lambda t: F.struct(F.substring_index(t, "=", 1).alias("k"), t.substr(F.instr(t, "=") + 1, F.length(t)).alias("v")))
    distinct = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["k"]), F.create_map(p["k"], p["v"])))
    return distinct


def portable_paths(text) -> Column:
    """Absolute paths inside JSON text become ``local_path_omitted/<name>``."""
    return F.regexp_replace(text, r'"(?:[A-Za-z]:[\\/]+|/)(?:[^"\\/]+[\\/]+)*([^"\\/]+)"', '"local_path_omitted/$1"')


def selection_score(terms: list[tuple[Column, float, str]]) -> Column:
    """Sum of weighted penalties, each ``linear`` or ``log`` (log1p of the positive part)."""
    return reduce(lambda a, b: a + b, [F.lit(w) * (F.log1p(F.greatest(x, F.lit(0.0))) if kind == "log" else x) for x, w, kind in terms])


def history_weight(old, factor, rmse, reference: float, low: float = 0.05, high: float = 1.0) -> Column:
    """0.55 of the old weight and 0.45 of the clipped evidence factor * exp(-(rmse/reference)^2 / 2)."""
    return clip(0.55 * old + 0.45 * clip(factor * F.exp(-0.5 * F.pow(rmse / reference, 2)), 0.0, 1.0), low, high)


def scaled_limit(absolute: float, spacing, factor: float, ceiling: float) -> Column:
    """A limit that grows with the sampling spacing but not past a ceiling."""
    return F.least(F.greatest(F.lit(absolute), factor * spacing), F.lit(ceiling))


def reliability(confidence, spread, radius: float, support, foreground, stereo) -> Column:
    """Point reliability: confidence damped by spread, support, foreground and stereo scores."""
    s = F.least(spread, F.lit(4 * radius)) / radius
    return confidence * F.exp(-0.5 * s * s) * (0.75 + 0.25 * support / 3) * (0.4 + 0.6 * foreground) * (0.35 + 0.65 * stereo)


def consensus_weight(mode, spread_factor, disagreement) -> Column:
    """Weight of a pose by its selection quality, spread and disagreement, kept in [0.35, 1]."""
    base = F.when(mode == "accepted", 1.0).when(mode == "warning", 0.82).otherwise(0.5)
    return F.coalesce(clip(base * spread_factor * F.greatest(F.exp(-2 * disagreement), F.lit(0.55)), 0.35, 1.0), F.lit(1.0))
