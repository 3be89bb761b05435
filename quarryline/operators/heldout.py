"""Surfaces tested by poses that took no part in their fit, as sums over rows: no neighbourhood is gathered anywhere.

The normal equations of a weighted quadratic are sums, so a fit without one pose is the sums of all rows less that pose's. Each later
round reweights rows by their residuals, which differ with the pose left out, and sums again by neighbourhood and pose left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .graph import cut
from .stats import MAD_SIGMA, percentile

ROUNDS, MOST_TESTS, LEAST_ROWS, LEAST_POSES, CONDITION = 4, 3, 12, 3, 5000.0
TERMS = 6


def _design(u: Column, v: Column) -> list[Column]:
    return [F.lit(1.0), u, v, u * u, u * v, v * v]


def _sums(weight: Column) -> list[Column]:
    """Sums of the normal equations: the upper triangle, then the right side."""
    d = _design(F.col("u"), F.col("v"))
    return [F.sum(weight * d[i] * d[j]) for i in range(TERMS) for j in range(i, TERMS)] + [F.sum(weight * x * F.col("z")) for x in d]


def _solved(sums: Column) -> Column:
    """The coefficients of the equations with these sums; null where the design is too near to singular."""

    def run(column: pa.Array) -> pa.Array:
        out = []
        upper = np.triu_indices(TERMS)
        for row in column.to_pylist():
            if row is None or not all(x is not None and np.isfinite(x) for x in row):
                out.append(None)
                continue
            matrix = np.zeros((TERMS, TERMS))
            matrix[upper] = row[: len(upper[0])]
            matrix = matrix + np.triu(matrix, 1).T
            values, vectors = np.linalg.eigh(matrix)
            if values[0] <= 0 or values[-1] > CONDITION**2 * values[0]:
                out.append(None)
                continue
            found = vectors @ ((vectors.T @ np.array(row[len(upper[0]) :])) / values)
            out.append(found.tolist() if np.isfinite(found).all() else None)
        return pa.array(out, pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>")(sums)


def held_out_poses(rows: DataFrame) -> DataFrame:
    """(seed, heldout): of each neighbourhood with more than LEAST_POSES poses, MOST_TESTS at most, evenly spread over them in order."""
    poses = rows.select("seed", "pose").distinct()
    by = Window.partitionBy("seed")
    placed = poses.withColumns({"i": F.row_number().over(by.orderBy("pose")) - 1, "n": F.count("*").over(by)}).where(F.col("n") > LEAST_POSES)
    spread = F.array(*[F.rint(F.lit(k / (MOST_TESTS - 1)) * (F.col("n") - 1)).cast("int") for k in range(MOST_TESTS)])
    return placed.where(F.array_contains(spread, F.col("i"))).select("seed", F.col("pose").alias("heldout"))


def cross_validated(rows: DataFrame, frames: DataFrame, radius: float, voxel: float, floor: float, cos_angle: float) -> DataFrame:
    """How poses left out in turn agree with the surface of the others: a row for each neighbourhood that could be tested.

    ``rows(seed, pose, u, v, z, w, nx, ny, nz)``: points over a seed, u and v in units of the radius, z along its normal, observed normals.
    ``frames(seed, n0, n1, n2, t0, t1, t2, b0, b1, b2)``: the seed's normal and tangents. Result: seed, tests, passed_tests, pass_ratio, and the medians
    over its tests of median_abs_error, p90_abs_error and median_normal_dot.

    A test fits a quadratic to LEAST_ROWS rows or more of LEAST_POSES poses or more, reweighted by residuals against a scale that adds the spread within
    poses about their own middles, the spread of these middles, and ``floor``. It passes if the pose left out (two rows or more) keeps within
    limits of the voxel and that scale in the median and the 90th percentile, and its normals lie along the surface. Rows with a null are left out.
    """
    ship(rows.sparkSession)
    keys = ["seed", "heldout"]
    rows = cut(rows.select("seed", "pose", "u", "v", "z", "w", "nx", "ny", "nz").dropna())
    tests = cut(held_out_poses(rows))
    both = rows.join(tests, "seed")
    of_test = F.col("pose") == F.col("heldout")
    enough = both.groupBy(*keys).agg(F.count_if(~of_test).alias("rows"), F.countDistinct(F.when(~of_test, F.col("pose"))).alias("poses"), F.count_if(of_test).alias("own"))
    tests = cut(enough.where((F.col("rows") >= LEAST_ROWS) & (F.col("poses") >= LEAST_POSES) & (F.col("own") >= 2)).select(*keys))
    # the first round: all sums less the pose's
    by_pose = cut(rows.groupBy("seed", "pose").agg(F.array(*_sums(F.col("w"))).alias("s")))
    size = TERMS * (TERMS + 1) // 2 + TERMS
    total = by_pose.groupBy("seed").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(size)]).alias("all"))
    own = by_pose.select("seed", F.col("pose").alias("heldout"), "s")
    sums = tests.join(total, "seed").join(own, keys).select(*keys, F.zip_with("all", "s", lambda a, b: a - b).alias("s"))
    train = rows.join(tests, "seed").where(~of_test).withColumn("r", F.col("w"))
    d = _design(F.col("u"), F.col("v"))
    fitted = sum((F.col("c")[i] * d[i] for i in range(1, TERMS)), F.col("c")[0] * d[0])
    middle = lambda x: percentile(x, 0.5)  # noqa: E731  neighbourhoods are small
    for k in range(ROUNDS):
        if k:
            sums = train.groupBy(*keys).agg(F.array(*_sums(F.col("r"))).alias("s"))
        fit = cut(sums.select(*keys, _solved("s").alias("c")).where("c is not null"))
        off = cut(train.drop("c", "off").join(fit, keys).withColumn("off", F.col("z") - fitted).drop("c"))
        centres = cut(off.groupBy(*keys, "pose").agg(middle("off").alias("centre")))
        within = off.join(centres, [*keys, "pose"]).groupBy(*keys).agg(middle(F.abs(F.col("off") - F.col("centre"))).alias("within"))
        level = centres.groupBy(*keys).agg(middle("centre").alias("level"))
        between = centres.join(level, keys).groupBy(*keys).agg(middle(F.abs(F.col("centre") - F.col("level"))).alias("between"))
        spread = lambda c: (F.lit(MAD_SIGMA) * F.col(c)) * (F.lit(MAD_SIGMA) * F.col(c))
        sigma = cut(within.join(between, keys).select(*keys, F.sqrt(F.lit(floor * floor) + spread("within") + spread("between")).alias("sigma")))
        if k < ROUNDS - 1:
            scale = F.least(F.col("sigma"), F.lit(0.30 * voxel))
            train = cut(off.join(sigma, keys).withColumn("r", F.col("w") * F.least(F.lit(1.0), 1.5 * scale / F.greatest(F.abs("off"), F.lit(1e-12)))).drop("sigma"))
    own = rows.join(fit.join(sigma, keys).withColumnRenamed("heldout", "pose"), ["seed", "pose"]).join(frames, "seed")
    c, u, v = F.col("c"), F.col("u"), F.col("v")
    gx, gy = (c[1] + 2 * c[3] * u + c[4] * v) / radius, (c[2] + c[4] * u + 2 * c[5] * v) / radius
    side = [F.col(f"n{i}") - gx * F.col(f"t{i}") - gy * F.col(f"b{i}") for i in range(3)]
    length = F.greatest(F.sqrt(side[0] * side[0] + side[1] * side[1] + side[2] * side[2]), F.lit(1e-12))
    along = (side[0] * F.col("nx") + side[1] * F.col("ny") + side[2] * F.col("nz")) / length
    error = F.abs(F.col("z") - fitted)
    told = own.groupBy("seed", "pose").agg(middle(error).alias("e50"), percentile(error, 0.9).alias("e90"), middle(along).alias("dot"), F.first("sigma").alias("sigma"))
    passed = (F.col("e50") <= F.greatest(F.lit(0.18 * voxel), 2.5 * F.col("sigma"))) & (F.col("e90") <= F.greatest(F.lit(0.35 * voxel), 3.5 * F.col("sigma"))) & (F.col("dot") >= cos_angle)
    out = told.groupBy("seed").agg(F.count("*").alias("tests"), F.count_if(passed).alias("passed_tests"), middle("e50").alias("median_abs_error"), middle("e90").alias("p90_abs_error"), middle("dot").alias("median_normal_dot"))
    return out.select("seed", "tests", "passed_tests", (F.col("passed_tests") / F.col("tests")).alias("pass_ratio"), "median_abs_error", "p90_abs_error", "median_normal_dot")
