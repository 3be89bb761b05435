"""Work on all neighbours within a radius, without a list of pairs.

Probes and points go into blocks in Morton order. A block of probes meets, in one task, the points of every block whose box is within
the radius of its own, nearest first and one block at a time, and keeps a state whose size doesn't depend on how many pairs there
are: the nearest few of each kind, or sums by ranges of a value. A weighted median goes down ranges, each cut into BINS again, until
what is left is a few values for each probe; so pairs are looked at again, never stored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import is_finite
from ..session import ship
from . import boxes
from .graph import cut

AXES, NORMAL = ("x", "y", "z"), ("nx", "ny", "nz")
PROBES, POINTS, TASKS = 2048, 512, 2000
BINS, LEFT, ROUNDS, PENDING = 512, 128, 8, 50_000
BLOCKS, LARGEST, FEW = 96, 65_536, 64  # FEW: of a chunk inside a task


def _blocks(df: DataFrame, id_: str, most: int) -> DataFrame:
    right = F.lit(True)
    for x in AXES:
        right = right & is_finite(x)
    return cut(boxes.in_blocks(df.where(right), {x: F.col(x) for x in AXES}, id_, most))


def _boxed(blocks: DataFrame, p: str) -> DataFrame:
    return blocks.groupBy("block").agg(*[f(x).alias(f"{p}{s}{x}") for s, f in (("lo", F.min), ("hi", F.max)) for x in AXES])


def streamed(rows: DataFrame, state, schema: str) -> DataFrame:
    """A state for each ``block`` of ``rows``, which come sorted by block, _kind (0: the block's own, 1: what it meets) and _node."""

    def run(batches):
        block, waiting, now = None, [], None
        for batch in batches:
            names = batch.schema.names
            at = np.stack([batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("block", "_kind", "_node")])
            ends = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1
            for s, e in zip([0, *ends], [*ends, batch.num_rows], strict=True):
                if e == s:
                    continue
                if at[0, s] != block:
                    if now is not None:
                        yield from now.end()
                    block, waiting, now = at[0, s], [], None
                piece = batch.slice(s, e - s)
                if at[1, s] == 0:
                    waiting.append(piece)
                elif waiting:
                    now = state(pa.Table.from_batches(waiting).combine_chunks()) if now is None else now
                    now.add(piece)
        if now is not None:
            yield from now.end()

    return rows.mapInArrow(run, schema)


def share(n: int, least: int) -> int:
    """Rows of a block, so that there are about BLOCKS of them: what meets every block grows with the rows, not with their square."""
    return min(max(-(-n // BLOCKS), least), LARGEST)


def chunks(p: np.ndarray, most: int) -> list[np.ndarray]:
    """The columns of ``p`` in compact groups of ``most`` or fewer: halves along the widest axis."""
    out, open_ = [], [np.arange(p.shape[1])]
    while open_:
        i = open_.pop()
        if len(i) <= most:
            out.append(i)
            continue
        q = p[:, i]
        order = np.argpartition(q[np.argmax(q.max(1) - q.min(1))], len(i) // 2)
        open_ += [i[order[: len(i) // 2]], i[order[len(i) // 2 :]]]
    return out


class Near:
    """``probe`` and ``points`` (id_, x, y, z and other columns; ids of probes differ) in blocks; ``fold`` runs a state over the pairs."""

    def __init__(self, probe: DataFrame, points: DataFrame, radius: float, id_: str, probes: int | None = None):
        ship(probe.sparkSession)
        place = lambda df: df.withColumns({x: F.col(x).cast("double") for x in AXES})
        self.probe, self.points, self.radius, self.id_ = _blocks(place(probe), id_, probes or PROBES), _blocks(place(points), id_, POINTS), radius, id_
        own, other = cut(_boxed(self.probe, "b_")), cut(_boxed(self.points, ""))
        self.n = own.count()
        if not self.n or not other.limit(1).count():
            self.n = 0
            return
        levels = boxes.tree(other)
        pairs = boxes.leaves_within(own.withColumn("most", F.lit(float(radius))), levels, "most")
        sides = other.select(F.col("block").alias("node"), *[F.col(s).alias(f"n_{s}") for s in boxes.SIDES])
        self.pairs = cut(pairs.join(own, "block").join(sides, "node").select("block", "node", boxes.gap2("b_", "n_").alias("gap"), boxes.far2("b_", "n_").alias("far")))

    def fold(self, state, schema: str, probe: DataFrame | None = None) -> DataFrame:
        """``state(probes)`` takes a table, ``add(points)`` a batch of points near them, ``end()`` yields batches of ``schema``."""
        a = self.probe if probe is None else probe
        if not self.n:
            return a.sparkSession.createDataFrame([], schema)
        kinds = {**dict(self.points.dtypes), **dict(a.dtypes)}
        columns = [c for c in kinds if c != "block"]
        side = lambda df, kind, gap, node: df.select("block", F.lit(kind).alias("_kind"), gap.alias("_gap"), node.alias("_node"), *[F.col(c) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in columns])
        pairs = self.pairs if probe is None else self.pairs.join(a.select("block").distinct(), "block", "left_semi")
        met = self.points.withColumnRenamed("block", "node").join(pairs, "node")
        rows = side(a, 0, F.lit(0.0), F.lit(0).cast("long")).unionByName(side(met, 1, F.col("gap"), F.col("node")))
        rows = rows.repartition(min(2 * self.n, TASKS), "block").sortWithinPartitions("block", "_kind", "_gap", "_node")

        return streamed(rows, state, schema)


def numbers(table, *columns: str) -> np.ndarray:
    return np.stack([np.asarray(table.column(c).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(c).to_numpy(), float) for c in columns])


def _one(column) -> pa.Array:
    return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)


def _meet(p: np.ndarray, x: np.ndarray, r2: float, most2: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The probes that the points' box leaves within reach, and their squared distances to the points."""
    off = np.maximum(np.maximum(x.min(1)[:, None] - p, p - x.max(1)[:, None]), 0.0)
    some = np.flatnonzero((off * off).sum(0) * (1 - 1e-9) <= (r2 if most2 is None else np.minimum(most2, r2)))
    d2 = np.subtract.outer(p[0, some], x[0]) ** 2
    d2 += np.subtract.outer(p[1, some], x[1]) ** 2
    d2 += np.subtract.outer(p[2, some], x[2]) ** 2
    return some, d2


def nearest_of_each(probe: DataFrame, points: DataFrame, radius: float, most: int, id_: str, by: str) -> DataFrame:
    """The ``most`` nearest points within ``radius`` of each probe and value of ``by``: a_id, b_id, distance, b_<by>; ties go to the smaller b_id.

    Of points of one place and value only the ``most`` of smallest ids can be an answer, so copies don't multiply.
    """
    kinds = dict(points.dtypes)
    points = points.select(id_, *AXES, F.col(by).alias("_by"))
    points = points.withColumn("_r", F.row_number().over(Window.partitionBy(*AXES, "_by").orderBy(id_))).where(F.col("_r") <= most).drop("_r")
    r2 = radius * radius

    class State:
        def __init__(self, probes):
            self.p, self.ids, self.codes = numbers(probes, *AXES), _one(probes.column(id_)), {}
            self.far, self.new, self.n = np.empty((self.p.shape[1], 0)), [], 0
            self.kept = None

        def add(self, batch):
            x, names = numbers(batch, *AXES), batch.column(batch.schema.names.index("_by")).to_pylist()
            code = np.array([self.codes.setdefault(v, len(self.codes)) for v in names])
            if len(self.codes) > self.far.shape[1]:
                more = np.full((self.p.shape[1], len(self.codes) - self.far.shape[1]), np.inf)
                self.far = np.concatenate([self.far, more], 1)
            far = self.far[:, np.unique(code)].max(1)
            some, d2 = _meet(self.p, x, r2, far * far * (1 + 1e-9))
            near = d2 <= r2
            d = np.sqrt(d2)
            near &= d <= self.far[some][:, code]
            i, j = np.nonzero(near)
            if len(i):
                ids = batch.column(batch.schema.names.index(id_)).take(pa.array(j))
                self.new.append((some[i], code[j], d[i, j], ids))
                self.n += len(i)
                if self.n > PENDING:
                    self.merge()

        def merge(self):
            parts = ([self.kept] if self.kept else []) + self.new
            self.new, self.n = [], 0
            if not parts:
                return
            i, code, d = (np.concatenate([p[k] for p in parts]) for k in range(3))
            ids = pa.concat_arrays([p[3] for p in parts])
            rank = np.empty(len(ids), np.int64)
            rank[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
            order = np.lexsort((rank, d, code, i))
            i, code, d, ids = i[order], code[order], d[order], ids.take(pa.array(order))
            first = np.r_[True, (i[1:] != i[:-1]) | (code[1:] != code[:-1])]
            place = np.arange(len(i)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            last = place == most - 1
            self.far[i[last], code[last]] = d[last]
            keep = np.flatnonzero(place < most)
            self.kept = (i[keep], code[keep], d[keep], ids.take(pa.array(keep)))

        def end(self):
            self.merge()
            if self.kept:
                i, code, d, ids = self.kept
                values = pa.array(list(self.codes), type=self.kind) if self.kind else pa.array(list(self.codes))
                yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(i)), ids, pa.array(d), values.take(pa.array(code))], names=["a_id", "b_id", "distance", "by"])

        kind = None

    State.kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}.get(kinds[by])
    near = Near(probe.select(id_, *AXES), points, radius, id_)
    return near.fold(State, f"a_id {dict(probe.dtypes)[id_]}, b_id {kinds[id_]}, distance double, by {kinds[by]}").withColumnRenamed("by", f"b_{by}")


def _heights_near(state, batch, radius: float, least_dot: float, weight: str, id_: str, weighted: bool, absolute: bool):
    """(probe, height, weight) of compatible neighbours, as ``surface`` defines them."""
    x, n, conf = numbers(batch, *AXES), numbers(batch, *NORMAL), numbers(batch, weight)[0]
    some, d2 = _meet(state.p, x, radius * radius)
    i, j = np.nonzero(d2 <= radius * radius)
    d2, i = d2[i, j], some[i]
    ids = batch.column(batch.schema.names.index(id_))
    other = pc.not_equal(state.ids.take(pa.array(i)), ids.take(pa.array(j))).fill_null(False).to_numpy(zero_copy_only=False)
    a = state.normal[:, i]
    b = n[:, j]
    keep = other & (a[0] * b[0] + a[1] * b[1] + a[2] * b[2] >= least_dot)
    i, j, a, d2 = i[keep], j[keep], a[:, keep], d2[keep]
    p = state.p[:, i]
    h = (x[0, j] - p[0]) * a[0] + (x[1, j] - p[1]) * a[1] + (x[2, j] - p[2]) * a[2]
    if weighted:
        w = np.exp(-0.5 * (np.sqrt(d2) / (0.5 * radius)) ** 2) * np.exp(-0.5 * (h / (0.25 * radius)) ** 2) * np.maximum(conf[j], 0.0)
        ok = np.isfinite(h) & np.isfinite(w) & (w > 0)
    else:
        w, ok = np.ones(len(h)), np.isfinite(h)
    return i[ok], (np.abs(h) if absolute else h)[ok], w[ok]


GOALS = {"half": lambda t: 0.5 * t, "lower": lambda t: np.floor(0.5 * (t - 1)) + 1, "upper": lambda t: np.ceil(0.5 * (t - 1)) + 1}


def _selected(near: Near, radius: float, least_dot: float, weight: str, goal: str, absolute: bool, probe: DataFrame | None = None) -> DataFrame:
    """(id, v): the first height at which the summed weights (numbers, unless ``goal`` is half) reach ``goal``; none without a neighbour."""
    id_, weighted = near.id_, goal == "half"
    kind = dict(near.probe.dtypes)[id_]

    class Base:
        def __init__(self, probes):
            self.p, self.normal, self.ids = numbers(probes, *AXES), numbers(probes, *NORMAL), _one(probes.column(id_))
            size = np.sqrt((self.normal**2).sum(0)) * radius * (1 + 1e-6)
            narrowed = "lo" in probes.schema.names
            self.lo, self.hi = numbers(probes, "lo", "hi") if narrowed else (np.zeros_like(size) if absolute else -size, size)
            self.below, self.total = numbers(probes, "below", "total") if narrowed else (np.zeros_like(size), None)

        def inside(self, batch):
            i, h, w = _heights_near(self, batch, radius, least_dot, weight, id_, weighted, absolute)
            ok = (h >= self.lo[i]) & (h <= self.hi[i])
            return i[ok], h[ok], w[ok]

    class Ranges(Base):
        def __init__(self, probes):
            super().__init__(probes)
            n = self.p.shape[1] * BINS
            self.w, self.n, self.least, self.most = np.zeros(n), np.zeros(n), np.full(n, np.inf), np.full(n, -np.inf)

        def add(self, batch):
            i, h, w = self.inside(batch)
            wide = np.maximum(self.hi - self.lo, 1e-300)[i]
            at = i * BINS + np.clip(np.floor((h - self.lo[i]) / wide * BINS), 0, BINS - 1).astype(np.int64)
            self.w += np.bincount(at, w, len(self.w))
            self.n += np.bincount(at, minlength=len(self.n))
            np.minimum.at(self.least, at, h)
            np.maximum.at(self.most, at, h)

        def end(self):
            w, n = self.w.reshape(-1, BINS), self.n.reshape(-1, BINS)
            upto = self.below[:, None] + np.cumsum(w, 1)
            total = upto[:, -1] if self.total is None else self.total
            met = (np.round(upto, 9) >= np.round(GOALS[goal](total), 9)[:, None]) & (n > 0)
            last = BINS - 1 - np.argmax((n > 0)[:, ::-1], 1)
            k, rows = np.where(met.any(1), np.argmax(met, 1), last), np.arange(len(w))
            below = np.where(k > 0, upto[rows, np.maximum(k - 1, 0)], self.below)
            at = rows * BINS + k
            some = np.flatnonzero(n.sum(1) > 0)
            made = [self.least[at], self.most[at], below, total, n[rows, k]]
            yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(some)), *[pa.array(m[some]) for m in made]], names=[id_, "lo", "hi", "below", "total", "n"])

    class Values(Base):
        def __init__(self, probes):
            super().__init__(probes)
            self.found = []

        def add(self, batch):
            i, h, w = self.inside(batch)
            if len(i):
                self.found.append((i, h, w))

        def end(self):
            if not self.found:
                return
            i, h, w = (np.concatenate(c) for c in zip(*self.found, strict=True))
            order = np.lexsort((h, i))
            i, h, w = i[order], h[order], w[order]
            starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            out = []
            for s, e in zip(starts, [*starts[1:], len(i)], strict=True):
                upto = self.below[i[s]] + np.cumsum(w[s:e])
                met = np.round(upto, 9) >= np.round(GOALS[goal](self.total[i[s]]), 9)
                out.append(h[s + (int(np.argmax(met)) if met.any() else e - s - 1)])
            yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(i[starts])), pa.array(out, pa.float64())], names=[id_, "v"])

    probe, ranges, done = near.probe if probe is None else probe, f"{id_} {kind}, lo double, hi double, below double, total double, n double", None
    for _ in range(ROUNDS):
        found = cut(near.fold(Ranges, ranges, probe))
        one = found.where("lo = hi").select(id_, F.col("lo").alias("v"))
        done = one if done is None else done.unionByName(one)
        more = found.where("lo < hi")
        probe = cut(near.probe.join(more.drop("n"), id_))
        n, left = more.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0.0))).first()
        if left <= LEFT * n:
            break
    return done.unionByName(near.fold(Values, f"{id_} {kind}, v double", probe)) if n else done


def weighted_median_height(df: DataFrame, radius: float, least_dot: float, weight: str, id_: str, absolute: bool, probe: DataFrame | None = None) -> DataFrame:
    """(id_, median) of the rows with a compatible neighbour: the lower weighted median of the neighbours' heights, or the plain
    median where no weight is positive. Ids differ."""
    columns = [id_, *AXES, *NORMAL, weight]
    df = df.select(*columns)
    near = Near(df if probe is None else probe.select(*columns), df, radius, id_)
    found = cut(_selected(near, radius, least_dot, weight, "half", absolute))
    rest = cut(near.probe.join(found.select(id_), id_, "left_anti"))
    if not near.n or not rest.limit(1).count():
        return found.withColumnRenamed("v", "median")
    low, high = (_selected(near, radius, least_dot, weight, g, absolute, rest) for g in ("lower", "upper"))
    plain = low.join(high.withColumnRenamed("v", "u"), id_).select(id_, (F.col("v") + 0.5 * (F.col("u") - F.col("v"))).alias("median"))
    return found.withColumnRenamed("v", "median").unionByName(plain)
