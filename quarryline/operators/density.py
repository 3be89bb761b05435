"""Neighbour counts and density clusters by sums of cells, without a list of all pairs.

Equal places are one row with their number. A count goes over blocks and, inside tasks, chunks of places: those that lie within the radius as a
whole are added as one number, and only chunks that the radius cuts are compared place by place. Where only enough neighbours are asked for,
cells so narrow that their points lie within the radius of each other have enough if they are full, so just the points of cells with few look
around. Cells whose boxes (around their own points) are within the radius of each other are neighbours.

Clusters are those of density linkage: the core points of a cell belong together; cells are linked if two of their core points are
within the radius. The outermost points of both cells show most links at once; cells that these leave in different components, and
only those, are compared point by point, and as soon as one pair is found nothing is left to compare.

Rows with a null or non-finite coordinate have no neighbours and no cluster. Ids may repeat; each row counts.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import is_finite
from . import near
from .graph import components, cut


def _places(df: DataFrame, id_: str, axes: tuple, radius: float) -> tuple[DataFrame, DataFrame]:
    """The finite rows (id, p0, p1, ...), and (cell, p0, p1, ..., n, least) of each distinct place, least being its least id."""
    rows = df.select(F.col(id_).alias("id"), *[F.col(a).cast("double").alias(f"p{i}") for i, a in enumerate(axes)])
    right = F.lit(True)
    for i in range(len(axes)):
        right = right & is_finite(f"p{i}")
    rows = rows.where(right)
    ps = [f"p{i}" for i in range(len(axes))]
    size = radius / math.sqrt(len(axes)) * (1 - 1e-9)
    cell = F.struct(*[F.floor(F.col(p) / size).alias(f"k{i}") for i, p in enumerate(ps)])
    return rows, cut(rows.groupBy(*ps).agg(F.count("*").alias("n"), F.min("id").alias("least")).withColumn("cell", cell))


def _boxed(places: DataFrame, k: int) -> DataFrame:
    """(cell, n, lo, hi) of each cell."""
    ends = lambda f, name: F.array(*[f(f"p{i}") for i in range(k)]).alias(name)
    return places.groupBy("cell").agg(F.sum("n").alias("n"), ends(F.min, "lo"), ends(F.max, "hi"))


def _sum(parts: list[Column]) -> Column:
    out = parts[0] * parts[0]
    for x in parts[1:]:
        out = out + x * x
    return out


def _gap2(k: int, lo: str, hi: str, other_lo, other_hi) -> Column:
    return _sum([F.greatest(F.lit(0.0), F.col(lo)[i] - other_hi(i), other_lo(i) - F.col(hi)[i]) for i in range(k)])


def _point2(k: int, a: str = "p", b: str = "q") -> Column:
    return _sum([F.col(f"{a}{i}") - F.col(f"{b}{i}") for i in range(k)])


def _neighbours(cells: DataFrame, k: int, radius: float) -> DataFrame:
    """(cell, o_cell, o_n, o_lo, o_hi) of every ordered pair of cells, and of each cell with itself, within the radius of each other."""
    reach = math.ceil(math.sqrt(k))
    half = [o for o in itertools.product(range(-reach, reach + 1), repeat=k) if o >= (0,) * k]  # one of o and -o
    steps = F.array(*[F.struct(*[F.lit(d).alias(f"d{i}") for i, d in enumerate(o)]) for o in half])
    looked = cells.withColumn("o", F.explode(steps)).withColumn("o_cell", F.struct(*[(F.col(f"cell.k{i}") + F.col(f"o.d{i}")).alias(f"k{i}") for i in range(k)])).drop("o")
    met = looked.join(cells.select(F.col("cell").alias("o_cell"), *[F.col(c).alias(f"o_{c}") for c in ("n", "lo", "hi")]), "o_cell")
    met = met.where(_gap2(k, "lo", "hi", lambda i: F.col("o_lo")[i], lambda i: F.col("o_hi")[i]) <= radius * radius)
    one = lambda a, b: F.struct(*[F.col(f"{a}{c}").alias(c) for c in ("cell", "n", "lo", "hi")], *[F.col(f"{b}{c}").alias(f"o_{c}") for c in ("cell", "n", "lo", "hi")])
    both = F.when(F.col("cell") == F.col("o_cell"), F.array(one("", "o_"))).otherwise(F.array(one("", "o_"), one("o_", "")))
    return met.select(F.explode(both).alias("s")).select("s.*")


def _around(asking: DataFrame, places: DataFrame, k: int, radius: float) -> DataFrame:
    """(p0, ..., total): rows within the radius of each asking place, itself included.

    A block of places that lies within the radius of a whole block of asking ones is one number; what the radius cuts goes to the asking
    block's task, where the same holds for chunks, and only chunks that the radius cuts are compared place by place.
    """
    ps, r2, few = [f"p{i}" for i in range(k)], radius * radius, near.FEW
    xs = [*near.AXES[:k], *ps[3:]]
    asking = cut(asking)
    named = lambda df, *more: df.select("least", *[F.col(p).alias(x) for p, x in zip(ps, xs, strict=True)], *[F.lit(0.0).alias(x) for x in near.AXES[k:]], *more)
    met = near.Near(named(asking), named(places, "n"), radius, "least", near.share(asking.count(), near.FEW))
    schema = ", ".join(f"{p} double" for p in ps) + ", total long"
    if not met.n:
        return asking.sparkSession.createDataFrame([], schema)
    whole = (F.col("far") <= r2) & F.lit(k <= 3)  # boxes of blocks have three axes
    sums = met.points.groupBy(F.col("block").alias("node")).agg(F.sum("n").alias("n"))
    base = met.pairs.where(whole).join(sums, "node").groupBy("block").agg(F.sum("n").alias("base"))
    probe = cut(met.probe.join(base, "block", "left").select("block", *xs, F.coalesce("base", F.lit(0)).alias("base")))
    met.points, met.pairs = met.points.select("block", *xs, "n"), cut(met.pairs.where(~whole))

    class Counts:
        def __init__(self, probes):
            self.p, self.ends, order, self.lo, self.hi = self.chunked(near.numbers(probes, *xs))
            self.total = near.numbers(probes, "base")[0][order]

        @staticmethod
        def chunked(p):
            order = near.chunks(p, few)
            ends = np.r_[0, np.cumsum([len(i) for i in order])]
            order = np.concatenate(order)
            p = p[:, order]
            return p, ends, order, np.minimum.reduceat(p, ends[:-1], axis=1), np.maximum.reduceat(p, ends[:-1], axis=1)

        def add(self, batch):
            x, ends, order, lo, hi = self.chunked(near.numbers(batch, *xs))
            n = near.numbers(batch, "n")[0][order]
            gap = far = 0.0
            for i in range(k):  # in the order of _sum, so that rounding never parts a box from its points
                up, down = hi[i] - self.lo[i][:, None], self.hi[i][:, None] - lo[i]
                far = far + np.maximum(up, down) ** 2
                gap = gap + np.maximum(0.0, np.maximum(-up, -down)) ** 2
            all_ = far <= r2
            self.total += np.repeat(all_ @ np.add.reduceat(n, ends[:-1]), np.diff(self.ends))
            open_ = (gap <= r2) & ~all_
            for s in np.flatnonzero(open_.any(1)):
                at, some = slice(self.ends[s], self.ends[s + 1]), np.repeat(open_[s], np.diff(ends))
                d2 = 0.0
                for i in range(k):
                    d = np.subtract.outer(self.p[i, at], x[i, some])
                    d *= d
                    d2 = d if i == 0 else np.add(d2, d, out=d2)
                self.total[at] += (d2 <= r2) @ n[some]

        def end(self):
            yield near.pa.RecordBatch.from_arrays([*map(near.pa.array, self.p), near.pa.array(self.total.astype(np.int64))], names=[*ps, "total"])

    lone = probe.join(met.pairs.select("block").distinct(), "block", "left_anti")
    return met.fold(Counts, schema, probe).unionByName(lone.select(*[F.col(x).alias(p) for p, x in zip(ps, xs, strict=True)], F.col("base").alias("total")))


def counts(df: DataFrame, radius: float, id_: str, axes: tuple) -> DataFrame:
    """id and neighbors of every row: the other rows within the radius."""
    k = len(axes)
    rows, places = _places(df, id_, axes, radius)
    found = rows.join(_around(places, places, k, radius), [f"p{i}" for i in range(k)]).select("id", (F.col("total") - 1).alias("neighbors"))
    lone = df.select(F.col(id_).alias("id"), *[is_finite(a).alias(f"ok{i}") for i, a in enumerate(axes)]).where(" or ".join(f"not ok{i}" for i in range(k))).select("id", F.lit(0).cast("long").alias("neighbors"))
    return found.unionByName(lone).withColumnRenamed("id", id_)


def _dense(places: DataFrame, boxed: DataFrame, k: int, radius: float, least: int) -> DataFrame:
    """The places with ``least`` rows or more within the radius, their own included."""
    full = boxed.where((F.col("n") >= least) & (_sum([F.col("hi")[i] - F.col("lo")[i] for i in range(k)]) <= radius * radius)).select("cell")
    few = places.join(full, "cell", "left_anti")
    enough = _around(few, places, k, radius).where(F.col("total") >= least).select(*[f"p{i}" for i in range(k)])
    return places.join(full, "cell", "left_semi").unionByName(few.join(enough, [f"p{i}" for i in range(k)], "left_semi"))


def at_least(df: DataFrame, radius: float, least: int, id_: str, axes: tuple) -> DataFrame:
    """The ids of rows with ``least`` other rows or more within the radius."""
    k = len(axes)
    rows, places = _places(df, id_, axes, radius)
    boxed = _boxed(places, k)
    good = _dense(places, boxed, k, radius, least + 1)
    return rows.join(good.select(*[f"p{i}" for i in range(k)]), [f"p{i}" for i in range(k)], "left_semi").select(F.col("id").alias(id_))


def clusters(df: DataFrame, radius: float, least: int, id_: str, axes: tuple) -> DataFrame:
    """id and cluster of every row. Core rows have ``least`` rows or more within the radius, themselves included; a cluster is named by
    its least core id, a border row belongs to the cluster of its least core neighbour; noise has null."""
    k, r2 = len(axes), radius * radius
    ps = [f"p{i}" for i in range(k)]
    rows, places = _places(df, id_, axes, radius)
    boxed = _boxed(places, k)
    beside = cut(_neighbours(boxed, k, radius))
    core = cut(_dense(places, boxed, k, radius, least).select("cell", *ps, "n", "least"))
    point = F.struct(*ps)
    outer = F.array_distinct(F.array(*[f(point, F.col(p)) for p in ps for f in (F.min_by, F.max_by)]))
    summed = core.groupBy("cell").agg(outer.alias("outer"), F.min("least").alias("least"))
    pairs = beside.where(F.col("cell") < F.col("o_cell")).select("cell", "o_cell")
    pairs = pairs.join(summed.select("cell", "outer"), "cell").join(summed.select(F.col("cell").alias("o_cell"), F.col("outer").alias("o_outer")), "o_cell")
    reach = F.exists("outer", lambda a: F.exists("o_outer", lambda b: _sum([a[p] - b[p] for p in ps]) <= r2))
    pairs = cut(pairs.select("cell", "o_cell", reach.alias("linked")))
    named = lambda nodes, edges: nodes.join(components(edges).withColumnRenamed("node", "cell"), "cell", "left").select("cell", F.coalesce("root", "cell").alias("root"))
    seen = cut(named(summed.select("cell"), pairs.where("linked").select(F.col("cell").alias("u"), F.col("o_cell").alias("v"))))
    open_ = pairs.where("not linked").select("cell", "o_cell").join(seen.withColumnRenamed("root", "u"), "cell").join(seen.select(F.col("cell").alias("o_cell"), F.col("root").alias("v")), "o_cell").where(F.col("u") != F.col("v"))
    other = core.select(F.col("cell").alias("o_cell"), *[F.col(p).alias(f"q{i}") for i, p in enumerate(ps)])
    more = open_.join(core.select("cell", *ps), "cell").join(other, "o_cell").where(_point2(k) <= r2).select("u", "v").distinct()
    more, roots = cut(more), seen.select(F.col("root").alias("cell")).distinct()
    joined = (named(roots, more) if more.limit(1).count() else roots.withColumn("root", F.col("cell"))).select(F.col("cell").alias("root"), F.col("root").alias("last"))
    of_cell = seen.join(joined, "root").join(summed.select("cell", "least"), "cell").select("cell", "last", "least")
    label = of_cell.groupBy("last").agg(F.min("least").alias("cluster"))
    of_cell = cut(of_cell.join(label, "last").select("cell", "cluster"))
    inner = core.join(of_cell, "cell").select(*ps, "cluster")
    border = places.join(core.select(*ps), ps, "left_anti").select("cell", *ps).join(beside.select("cell", "o_cell"), "cell")
    border = border.join(core.select(F.col("cell").alias("o_cell"), *[F.col(p).alias(f"q{i}") for i, p in enumerate(ps)], "least"), "o_cell").where(_point2(k) <= r2)
    border = border.groupBy(*ps).agg(F.min_by(F.col("o_cell"), F.col("least")).alias("cell")).join(of_cell, "cell").select(*ps, "cluster")
    found = rows.join(inner.unionByName(border), ps, "left").select("id", "cluster")
    bad = df.select(F.col(id_).alias("id"), *[is_finite(a).alias(f"ok{i}") for i, a in enumerate(axes)]).where(" or ".join(f"not ok{i}" for i in range(k))).select("id", F.lit(None).cast(dict(rows.dtypes)["id"]).alias("cluster"))
    return found.unionByName(bad).withColumnRenamed("id", id_)
