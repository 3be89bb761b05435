"""Keyed pairing, membership, and radius and nearest joins over a grid.

A radius join is an equi-join on cells as wide as the radius: the probe side is dealt to its 27 neighbours, then the exact
predicate; a cell of more than ``CELL`` points is cut into blocks, to each of which its probes go. A nearest join starts with
cells that hold few points where points are dense (measured on a bounded sample, whatever the box), keeps the answers whose kth
distance lies within the cells looked at, and widens the rest by doubling. The last ``FEW`` probes, such as outliers, meet all
points in one scan that keeps the best of each batch, so every probe ends with an exact answer.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import is_finite
from ..session import ship
from . import density
from .graph import cut

KEYS = ("kx", "ky", "kz")
CELL, SAMPLE, FEW = 4096, 20_000, 512


def pair(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right, on, "inner")


def rows_in(query: DataFrame, reference: DataFrame, on: list[str]) -> DataFrame:
    return query.join(reference.select(*on), on, "left_semi")


def rows_not_in(query: DataFrame, reference: DataFrame, on: list[str]) -> DataFrame:
    return query.join(reference.select(*on), on, "left_anti")


def optional(df: DataFrame, more: DataFrame, on: list[str], fallback: dict) -> DataFrame:
    """A left join whose missing columns take fallback values."""
    return df.join(more, on, "left").fillna(fallback)


def _cells(axes: tuple, size: float, prefix: str) -> list[Column]:
    return [F.floor(F.col(a) / size).cast("bigint").alias(f"{prefix}{i}") for i, a in enumerate(axes)]


def _around(n: int, reach: int = 1) -> Column:
    return F.array(*[F.struct(*[F.lit(d).alias(f"d{i}") for i, d in enumerate(o)]) for o in itertools.product(range(-reach, reach + 1), repeat=n)])


def distance2(a: tuple, b: tuple) -> Column:
    d = [F.col(x) - F.col(y) for x, y in zip(a, b, strict=True)]
    return sum((x * x for x in d[1:]), d[0] * d[0])


def _sides(probe: DataFrame, points: DataFrame, id_: str, axes: tuple, carry: tuple = ()) -> tuple[DataFrame, DataFrame]:
    one = lambda df, p, more: df.select(F.col(id_).alias(f"{p}id"), *[F.col(a).cast("double").alias(f"{p}{a}") for a in axes], *[F.col(c).alias(f"{p}{c}") for c in more if c not in axes])
    return one(probe, "a_", carry), one(points, "b_", carry)


def radius_join(probe: DataFrame, points: DataFrame, radius: float, id_: str, axes: tuple, carry: tuple = ()) -> DataFrame:
    """All pairs within ``radius``: a_id, b_id, distance and the carried columns of both sides; rows pair with themselves too."""
    a, b = _sides(probe, points, id_, axes, carry)
    na, nb = tuple(f"a_{x}" for x in axes), tuple(f"b_{x}" for x in axes)
    a = a.select("*", *_cells(na, radius, "c")).withColumn("o", F.explode(_around(len(axes))))
    a = a.select(*[c for c in a.columns if c != "o" and not c.startswith("c")], *[(F.col(f"c{i}") + F.col(f"o.d{i}")).alias(f"c{i}") for i in range(len(axes))])
    b, cell = b.select("*", *_cells(nb, radius, "c")), [f"c{i}" for i in range(len(axes))]
    hot = b.groupBy(*cell).agg(F.ceil(F.count("*") / CELL).cast("int").alias("blocks")).where("blocks > 1")
    a = a.join(hot, cell, "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    b = b.join(hot, cell, "left").withColumn("block", F.pmod(F.xxhash64("b_id"), F.coalesce("blocks", F.lit(1))).cast("int")).drop("blocks")
    joined = a.join(b, [*cell, "block"])
    return joined.where(distance2(na, nb) <= radius * radius).select("a_id", "b_id", F.sqrt(distance2(na, nb)).alias("distance"), *[f"{p}{c}" for c in carry for p in ("a_", "b_")])


def radius_counts(df: DataFrame, radius: float, id_: str, axes: tuple) -> DataFrame:
    """Neighbours within the radius of every row, itself left out; rows without any have 0."""
    return density.counts(df, radius, id_, axes)


def _cell_size(points: np.ndarray, n: int, k: int) -> float:
    """The widest of the cells, each half of the one before, in which a point of a sample of n meets about k others or fewer."""
    low, widest = points.min(0), max(float(np.ptp(points, axis=0).max()), 1e-9)
    for level in range(1, 40):
        cells = np.floor((points - low) / (widest / 2**level))
        met = np.unique(cells, axis=0, return_counts=True)[1]
        if float((met.astype(np.float64) ** 2).sum()) / len(points) * (n / len(points)) <= 2 * (k + 1) or met.max() == 1:
            return widest / 2**level
    return widest / 2**40


def _scan_all(probes: list, points: DataFrame, k: int, n_axes: int) -> DataFrame:
    """(probe, b_id, distance): for a few probes, by number, the k + 1 nearest points of each batch of ``points``."""
    at = np.array(probes, np.float64)

    def run(batches):
        for batch in batches:
            names = batch.column(0)
            order = pc.sort_indices(names)  # ties go to the smaller id
            x = np.stack([batch.column(i + 1).take(order).to_numpy(zero_copy_only=False) for i in range(n_axes)], axis=1)
            found, far = [], []
            for p in at:
                off = x - p
                d = np.sqrt(sum((off[:, j] * off[:, j] for j in range(1, n_axes)), off[:, 0] * off[:, 0]))
                found.append(np.argsort(d, kind="stable")[: k + 1])
                far.append(d[found[-1]])
            which = np.repeat(np.arange(len(at), dtype=np.int32), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(which), names.take(order.take(pa.array(np.concatenate(found)))), pa.array(np.concatenate(far))], names=["probe", "b_id", "distance"])

    ship(points.sparkSession)
    return points.mapInArrow(run, f"probe int, b_id {dict(points.dtypes)['b_id']}, distance double")


def knn_join(probe: DataFrame, points: DataFrame, k: int, id_: str, axes: tuple, skip_self: bool = False) -> DataFrame:
    """The k nearest ``points`` of each probe: a_id, b_id, distance, rank; ties go to the smaller b_id.

    Of points in one place only the k + 1 of smallest ids can be an answer, so copies don't multiply. Rows with a null or
    non-finite axis are no answer and have none.
    """
    a, b = _sides(probe, points, id_, axes)
    na, nb = tuple(f"a_{x}" for x in axes), tuple(f"b_{x}" for x in axes)
    kinds = dict(a.dtypes)["a_id"], dict(b.dtypes)["b_id"]
    for x, y in zip(na, nb, strict=True):
        a, b = a.where(is_finite(x)), b.where(is_finite(y))
    place = Window.partitionBy(*nb).orderBy("b_id")
    b = cut(b.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= k + 1).drop("_r"))
    n = b.count()
    if not n:
        return a.sparkSession.createDataFrame([], f"a_id {kinds[0]}, b_id {kinds[1]}, distance double, rank int")
    some = b.select(*nb).sample(min(1.0, 2 * SAMPLE / n), seed=1).limit(SAMPLE) if n > SAMPLE else b.select(*nb)
    box = a.select(*[F.col(c).alias(x) for c, x in zip(na, nb, strict=True)]).unionByName(b.select(*nb)).agg(*[(F.max(c) - F.min(c)).alias(c) for c in nb]).first()
    size, widest = _cell_size(np.array(some.collect(), np.float64).reshape(-1, len(axes)), n, k), max(box)  # SAMPLE rows at most
    order = Window.partitionBy("a_id").orderBy("distance", "b_id")
    ranked = lambda met: met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    done, left = None, a
    while True:
        probe_cells = left.select("*", *_cells(na, size, "c")).withColumn("o", F.explode(_around(len(axes))))
        probe_cells = probe_cells.select("a_id", *na, *[(F.col(f"c{i}") + F.col(f"o.d{i}")).alias(f"c{i}") for i in range(len(axes))])
        met = probe_cells.join(b.select("*", *_cells(nb, size, "c")), [f"c{i}" for i in range(len(axes))])
        if skip_self:
            met = met.where("a_id <> b_id")
        near = ranked(met.select("a_id", "b_id", F.sqrt(distance2(na, nb)).alias("distance")))
        if size > widest:  # the cells around a probe hold all points
            near = cut(near)
            return near if done is None else done.unionByName(near)
        whole = near.groupBy("a_id").agg(F.count("*").alias("n"), F.max("distance").alias("far")).where((F.col("n") == k) & (F.col("far") <= size)).select("a_id")
        near = cut(near.join(whole, "a_id", "left_semi"))
        done = near if done is None else done.unionByName(near)
        left = cut(left.join(near.select("a_id").distinct(), "a_id", "left_anti"))
        rest = left.limit(FEW + 1).collect()
        if not rest:
            return done
        if len(rest) <= FEW:
            named = a.sparkSession.createDataFrame([(i, r["a_id"]) for i, r in enumerate(rest)], f"probe int, a_id {kinds[0]}")
            found = _scan_all([[r[c] for c in na] for r in rest], b.select("b_id", *nb), k, len(axes)).join(F.broadcast(named), "probe").select("a_id", "b_id", "distance")
            return done.unionByName(cut(ranked((found.where("a_id <> b_id") if skip_self else found).distinct())))
        size *= 2


def mutual_nearest(a: DataFrame, b: DataFrame, id_: str, axes: tuple, gate: float | None = None) -> DataFrame:
    """Pairs that are each other's nearest, within ``gate`` if given: a_id, b_id, distance."""
    forth = knn_join(a, b, 1, id_, axes).select("a_id", "b_id", "distance")
    back = knn_join(b, a, 1, id_, axes).select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"))
    both = forth.join(back, ["a_id", "b_id"], "left_semi")
    return both if gate is None else both.where(F.col("distance") <= gate)


def outlier_filter(df: DataFrame, k: int, factor: float, id_: str, axes: tuple) -> DataFrame:
    """Statistical outliers go: rows whose mean distance to k neighbours is over mean + factor * std of all (sample std)."""
    mean = knn_join(df, df, k, id_, axes, skip_self=True).groupBy(F.col("a_id").alias(id_)).agg(F.avg("distance").alias("d"))
    limit = mean.agg((F.avg("d") + factor * F.stddev_samp("d")).alias("limit"))
    return df.join(mean.crossJoin(F.broadcast(limit)).where("d <= limit").select(id_), id_, "left_semi")  # one row


def radius_filter(df: DataFrame, radius: float, least: int, id_: str, axes: tuple) -> DataFrame:
    """Rows with ``least`` neighbours or more within the radius."""
    return df.join(density.at_least(df, radius, least, id_, axes), id_, "left_semi")


def circular_pairs(poses: DataFrame, pose: str, n: int, order: int, most_deg: float) -> DataFrame:
    """Edges of poses up to ``order`` apart on the circle whose gap is at most ``most_deg``: source, target, step, primary, closure."""
    a, b = poses.select(F.col(pose).alias("source")), poses.select(F.col(pose).alias("target"))
    steps = a.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(order)))).withColumn("target", F.pmod(F.col("source") + F.col("step"), F.lit(n)))
    return steps.join(b, "target").where(F.col("step") * 360.0 / n <= most_deg).select("source", "target", "step", (F.col("step") == 1).alias("primary"), (F.col("target") < F.col("source")).alias("closure"))


def dilate(strong: DataFrame, weak: DataFrame, hops: int, keys: tuple = KEYS) -> DataFrame:
    """Weak cells that reach a strong cell in at most ``hops`` steps through weak cells, by 26-adjacency."""
    front, found = strong.select(*keys).distinct(), None
    weak = weak.select(*keys).distinct().join(front, list(keys), "left_anti")
    for _ in range(hops):
        near = front.withColumn("o", F.explode(_around(len(keys)))).select(*[(F.col(k) + F.col(f"o.d{i}")).alias(k) for i, k in enumerate(keys)]).distinct()
        front = weak.join(near, list(keys), "left_semi")
        front = front.checkpoint() if front.sparkSession.sparkContext.getCheckpointDir() else front
        found = front if found is None else found.unionByName(front)
        weak = weak.join(front, list(keys), "left_anti")
    return found


def core_neighbors(cells: DataFrame, core: DataFrame, reach: int, keys: tuple = KEYS) -> DataFrame:
    """Core cells within a Chebyshev distance, for each cell that isn't core."""
    others = cells.select(*keys).distinct().join(core, list(keys), "left_anti")
    spread = core.select(*keys).distinct().withColumn("o", F.explode(_around(len(keys), reach))).select(*[(F.col(k) + F.col(f"o.d{i}")).alias(k) for i, k in enumerate(keys)])
    return others.join(spread.groupBy(*keys).agg(F.count("*").alias("n")), list(keys), "left").select(*keys, F.coalesce("n", F.lit(0)).alias("neighbors"))


def per_seed_nearest(pairs: DataFrame, by: list[str], most: int) -> DataFrame:
    """The ``most`` nearest pairs for each value of ``by``."""
    return pairs.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("distance", "b_id"))).where(F.col("_r") <= most).drop("_r")
