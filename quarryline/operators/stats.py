"""Robust and weighted statistics by group.

Percentiles are exact with linear interpolation, at any size of a group. Groups of more than ``SMALL`` rows go down ranges: a range's values
are cut by approximate quantiles into ``PARTS``, the weights of these are summed, which needs no shuffle of rows, and only the parts that hold
a wanted rank are cut again, until each has ``SMALL`` rows at most; these are the only rows that are shuffled. Smaller groups, and few groups
of up to five times that, take the built-in percentile or one window, which give the same. A statistic that needs another one's
value (MAD needs the median) is a second aggregate joined on the group. Empty groups have count 0 and nulls. Values that are null,
NaN or infinite don't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import is_finite
from .graph import cut

MAD_SIGMA, PARTS, GROUPS, SMALL = 1.4826, 64, 5000, 100_000


def _finite(x: str) -> Column:
    return F.when(is_finite(x), F.col(x).cast("double"))


def percentile(x, q: float) -> Column:
    """For groups that are known or counted to be small: one aggregate that holds a group's distinct values."""
    return F.percentile(x, F.lit(q))


def _part(value: str, edges: str) -> Column:
    """How many of PARTS - 1 ascending edges lie below a value, by halving."""
    at, step = F.lit(0), PARTS // 2
    while step:
        at = at + F.when(F.element_at(edges, at + step) < F.col(value), step).otherwise(0)
        step //= 2
    return at


def _same(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on ``on`` in which null equals null."""
    named = b.select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(on)], *[c for c in b.columns if c not in on])
    return a.join(named, [a[c].eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate(on)], how).drop(*[f"_s{i}" for i in range(len(on))])


def _reached(c: Column, goal: Column) -> Column:
    return F.round(c, 9) >= F.round(goal, 9)


def _first_at(rows: DataFrame, keys: list[str], goals: dict[str, Column]) -> DataFrame:
    """One row for each group of ``rows`` (keys, _x, _v): _total, the summed weights _v, _n, the rows, and for each name the least _x up to which the
    weights reach its goal, a column of _total."""
    sizes = cut(rows.groupBy(*keys).agg(F.sum("_v").alias("_total"), F.count("*").alias("_n")))
    most, large, groups = sizes.agg(F.coalesce(F.max("_n"), F.lit(0)), F.count_if(F.col("_n") > SMALL), F.count("*")).first()
    few = F.broadcast if groups <= GROUPS else lambda df: df
    whole = None
    if not large:
        return _windowed(rows, keys, sizes, goals)
    if large < groups:
        whole = _windowed(_same(rows, few(sizes.where(F.col("_n") <= SMALL).select(*keys)), keys), keys, sizes.where(F.col("_n") <= SMALL), goals)
        sizes = sizes.where(F.col("_n") > SMALL)
    wanted = sizes.select(*keys, "_total", "_n", F.explode(F.array(*[F.struct(F.lit(n).alias("_name"), g.cast("double").alias("_goal")) for n, g in goals.items()])).alias("_g")).select(*keys, "_g._name", "_g._goal", F.lit(0.0).alias("_below"), F.lit(0).cast("long").alias("_b"), F.col("_n"))
    inside = _same(rows, few(sizes.select(*keys)), keys).withColumn("_b", F.lit(0).cast("long"))
    done = None
    while True:
        ready = cut(wanted.where(F.col("_n") <= max(SMALL, 1)))
        more = cut(wanted.where(F.col("_n") > max(SMALL, 1)))
        if ready.limit(1).count():
            found = _picked(inside, keys, ready)
            done = found if done is None else done.unionByName(found)
        open_ = cut(more.select(*keys, "_b").distinct())
        n = open_.count()
        if not n:
            break
        small = F.broadcast if n <= GROUPS else lambda df: df  # an array of PARTS for each of GROUPS ranges at most
        at = _same(inside, small(open_.withColumn("_in", F.lit(True))), [*keys, "_b"]).drop("_in")
        edges = cut(at.groupBy(*keys, "_b").agg(F.percentile_approx("_x", [i / PARTS for i in range(1, PARTS)], 20 * PARTS).alias("_e")))
        # an edge's own value is a part of its own, so every part is smaller than the range
        parted = _same(at, small(edges), [*keys, "_b"]).withColumn("_p", _part("_x", "_e"))
        parted = parted.withColumn("_p", 2 * F.col("_p") + F.coalesce((F.get("_e", F.col("_p")) == F.col("_x")).cast("int"), F.lit(0))).drop("_e")
        sums = cut(parted.groupBy(*keys, "_b", "_p").agg(F.sum("_v").alias("_s"), F.count("*").alias("_k"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")))
        ranges = Window.partitionBy(*keys, "_b").orderBy("_p")
        sums = sums.withColumn("_up", F.sum("_s").over(ranges.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_last", F.lead("_p").over(ranges).isNull())
        named = _same(more.drop("_n"), sums, [*keys, "_b"]).where(_reached(F.col("_below") + F.col("_up"), F.col("_goal")) | F.col("_last"))
        first = Window.partitionBy(*keys, "_name").orderBy("_p")
        part = named.withColumn("_r", F.row_number().over(first)).where("_r = 1").withColumn("_below", F.col("_below") + F.col("_up") - F.col("_s"))
        part = cut(part.select(*keys, "_name", "_goal", "_below", "_lo", "_hi", "_k", (2 * PARTS * F.col("_b") + F.col("_p")).alias("_b")))
        one = part.where("_lo = _hi").select(*keys, "_name", F.col("_lo").alias("_x"))
        done = one if done is None else done.unionByName(one)
        wanted = part.where("_lo < _hi").select(*keys, "_name", "_goal", "_below", "_b", F.col("_k").alias("_n"))
        kept = parted.withColumn("_b", 2 * PARTS * F.col("_b") + F.col("_p")).drop("_p")
        inside = cut(_same(kept, small(wanted.select(*keys, "_b").distinct()), [*keys, "_b"]))
    values = done.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, F.col("_x"))).alias(n) for n in goals])
    out = _same(sizes, values, keys).select(*keys, "_total", "_n", *goals)
    return out if whole is None else whole.unionByName(out)


def _windowed(rows: DataFrame, keys: list[str], sizes: DataFrame, goals: dict[str, Column]) -> DataFrame:
    """``_first_at`` of groups of bounded size: a window over each."""
    summed = rows.groupBy(*keys, "_x").agg(F.sum("_v").alias("_w"))
    upto = summed.withColumn("_c", F.sum("_w").over(Window.partitionBy(*keys).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)))
    made = _same(upto, sizes, keys).groupBy(*keys).agg(F.first("_total").alias("_total"), F.first("_n").alias("_n"), *[F.coalesce(F.min(F.when(_reached(F.col("_c"), g), F.col("_x"))), F.max("_x")).alias(n) for n, g in goals.items()])
    return made.select(*keys, "_total", "_n", *goals)


def _picked(inside: DataFrame, keys: list[str], ready: DataFrame) -> DataFrame:
    """(keys, _name, _x): the wanted ranks of ranges of few rows."""
    ranges = inside.groupBy(*keys, "_b", "_x").agg(F.sum("_v").alias("_w"))
    upto = ranges.withColumn("_c", F.sum("_w").over(Window.partitionBy(*keys, "_b").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)))
    met = _same(upto, ready.select(*keys, "_b", "_name", "_goal", "_below"), [*keys, "_b"])
    return met.groupBy(*keys, "_name").agg(F.coalesce(F.min(F.when(_reached(F.col("_below") + F.col("_c"), F.col("_goal")), F.col("_x"))), F.max("_x")).alias("_x"))


def _keyed(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Without keys all rows are one group."""
    return (df, list(keys)) if keys else (df.withColumn("_all", F.lit(0)), ["_all"])


def _fits(values: DataFrame, by: list[str]) -> bool:
    """Whether groups are counted to be so small, or so few and not too large, that one aggregate may hold their values."""
    most, large = values.groupBy(*by).count().agg(F.coalesce(F.max("count"), F.lit(0)), F.count_if(F.col("count") > SMALL)).first()
    return not large or most <= 5 * SMALL and large <= 8


def quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """The named quantiles of finite values by group; groups without any are left out."""
    df, by = _keyed(df, keys)
    values = df.select(*by, _finite(value).alias("_x")).where("_x is not null")
    if _fits(values, by):
        return values.groupBy(*by).agg(*[percentile("_x", q).alias(n) for n, q in wanted.items()]).select(*keys, *wanted)
    return _large_quantiles(values, by, wanted).select(*keys, *wanted)


def _large_quantiles(values: DataFrame, by: list[str], wanted: dict[str, float]) -> DataFrame:
    at = {n: F.lit(q) * (F.col("_total") - 1) for n, q in wanted.items()}
    goals = {f"_{s}_{n}": f(a) + 1 for n, a in at.items() for s, f in (("l", F.floor), ("h", F.ceil))}
    found = _first_at(values.withColumn("_v", F.lit(1).cast("long")), by, goals)
    return found.select(*by, *[(F.col(f"_l_{n}") + (a - F.floor(a)) * (F.col(f"_h_{n}") - F.col(f"_l_{n}"))).alias(n) for n, a in at.items()])


def finite_stats(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float] | None = None) -> DataFrame:
    """n, lowest, median, mean, highest, the named quantiles and mad of finite values, by group."""
    wanted = {"p05": 0.05, "p95": 0.95} if wanted is None else wanted
    rows, by = _keyed(df.select(*keys, _finite(value).alias("_x")), keys)
    plain = [F.count("_x").alias("n"), F.min("_x").alias("lowest"), F.avg("_x").alias("mean"), F.max("_x").alias("highest")]
    if _fits(rows, by):
        first = rows.groupBy(*by).agg(*plain, *[percentile("_x", q).alias(n) for n, q in {"median": 0.5, **wanted}.items()])
        mad = rows.join(first.select(*by, "median"), by).groupBy(*by).agg(percentile(F.abs(F.col("_x") - F.col("median")), 0.5).alias("mad"))
        return first.join(mad, by, "left").select(*keys, "n", "lowest", "median", "mean", "highest", *wanted, "mad")
    first, values = rows.groupBy(*by).agg(*plain), rows.where("_x is not null")
    ranks = cut(_large_quantiles(values, by, {"median": 0.5, **wanted}))
    off = values.join(_small(ranks.select(*by, "median")), by)
    mad = _large_quantiles(off.select(*by, F.abs(F.col("_x") - F.col("median")).alias("_x")), by, {"mad": 0.5})
    return first.join(ranks, by, "left").join(mad, by, "left").select(*keys, "n", "lowest", "median", "mean", "highest", *wanted, "mad")


def location_scale(df: DataFrame, keys: list[str], value: str, smallest: float = 0.0) -> DataFrame:
    """center, sigma (1.4826 MAD, at least ``smallest``) and n by group."""
    s = finite_stats(df, keys, value, {})
    return s.select(*keys, F.col("median").alias("center"), F.greatest(F.lit(smallest), F.coalesce(MAD_SIGMA * F.col("mad"), F.lit(0.0))).alias("sigma"), "n")


def background_threshold(df: DataFrame, keys: list[str], value: str, least: float, factor: float, share: float = 0.62, enough: int = 2000) -> DataFrame:
    """median + factor * max(0.75, 1.4826 MAD) of the values up to their ``share`` quantile (of all, if fewer than ``enough`` remain), at least ``least``."""
    rows = df.select(*keys, _finite(value).alias("_x")).where("_x is not null")
    edge = quantiles(rows, keys, "_x", {"_edge": share})
    low = rows.join(edge, keys)
    n = low.groupBy(*keys).agg(F.sum((F.col("_x") <= F.col("_edge")).cast("long")).alias("_n"))
    used = low.join(n, keys).where((F.col("_n") < enough) | (F.col("_x") <= F.col("_edge"))).select(*keys, "_x")
    s = finite_stats(used, keys, "_x", {})
    return s.select(*keys, F.greatest(F.lit(least), F.col("median") + factor * F.greatest(F.lit(0.75), MAD_SIGMA * F.col("mad"))).alias("threshold"))


def _weighted(df: DataFrame, keys: list[str], value: str, weight: str) -> tuple[DataFrame, list[str]]:
    df, by = _keyed(df, keys)
    return df.where(is_finite(value) & is_finite(weight) & (F.col(weight) > 0)).select(*by, F.col(value).cast("double").alias("_x"), F.col(weight).alias("_v")), by


def _small(df: DataFrame) -> DataFrame:
    """Kept, and broadcast where it's counted to have few rows."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= GROUPS else df


def weighted_stats(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """n, weight, and weighted median, mean, p90, p95 and highest, by group; quantiles are the lower weighted ones."""
    rows, by = _weighted(df, keys, value, weight)
    plain = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("_v").alias("weight"), (F.sum(F.col("_x") * F.col("_v")) / F.sum("_v")).alias("mean"), F.max("_x").alias("highest"))
    ranks = _first_at(rows, by, {n: q * F.col("_total") for n, q in (("median", 0.5), ("p90", 0.9), ("p95", 0.95))})
    return _same(plain, ranks.drop("_total", "_n"), by).select(*keys, "n", "weight", "median", "mean", "p90", "p95", "highest")


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Weighted median by group, or the plain median where no weight is positive."""
    rows, by = _weighted(df, keys, value, weight)
    weighted = cut(_first_at(rows, by, {"median": 0.5 * F.col("_total")}).select(*by, "median"))
    every = _keyed(df, keys)[0]
    groups = _same(every.select(*by).distinct(), weighted.withColumn("_in", F.lit(True)), by, "left")
    bare = cut(groups.where("_in is null").select(*by))
    if bare.limit(1).count():
        plain = quantiles(_same(every, _small(bare), by), by, value, {"median": 0.5})
        weighted = weighted.unionByName(_same(bare, plain, by, "left").select(*by, "median"))
    return weighted.select(*keys, "median")


def weighted_robust_stats(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """weighted_stats and the weighted MAD about the weighted median."""
    first = cut(weighted_stats(df, keys, value, weight))
    off = df.join(_small(first.select(*keys, F.col("median").alias("_m"))), keys).withColumn("_off", F.abs(F.col(value) - F.col("_m")))
    rows, by = _weighted(off, keys, "_off", weight)
    return first.join(_first_at(rows, by, {"mad": 0.5 * F.col("_total")}).select(*keys, "mad"), keys)


def trimmed_rmse(df: DataFrame, keys: list[str], value: str, share: float, cap: float, least: int = 8) -> DataFrame:
    """RMS of the smallest ceil(share * n) values after capping, of ``least`` values at least."""
    df, by = _keyed(df, keys)
    rows = df.where(is_finite(value)).select(*by, F.least(F.col(value).cast("double"), F.lit(cap)).alias("_x"))
    most = F.least(F.greatest(F.ceil(share * F.col("_total")), F.lit(least)), F.col("_total"))
    edge = _first_at(rows.withColumn("_v", F.lit(1).cast("long")), by, {"_t": most}).select(*by, most.cast("long").alias("n"), "_t")
    low = _same(rows, _small(edge), by).where(F.col("_x") <= F.col("_t"))
    below = F.col("_x") < F.col("_t")  # of the values at the edge as many as are left
    sums = low.groupBy(*by).agg(F.first("n").alias("n"), F.first("_t").alias("_t"), F.count_if(below).alias("_k"), F.coalesce(F.sum(F.when(below, F.col("_x") * F.col("_x"))), F.lit(0.0)).alias("_s"))
    return sums.select(*keys, F.sqrt((F.col("_s") + (F.col("n") - F.col("_k")) * F.col("_t") * F.col("_t")) / F.col("n")).alias("rmse"), "n")


def weighted_mean(value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.greatest(F.sum(weight), F.lit(1e-12))


def robust_extent(df: DataFrame, keys: list[str], axes: tuple, least: int = 8) -> DataFrame:
    """P99 - P01 of each axis; null below ``least`` rows."""
    out = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    for a in axes:
        out = out.join(quantiles(df, keys, a, {"_low": 0.01, "_high": 0.99}), keys, "left").withColumn(f"extent_{a}", F.when(F.col("_rows") >= least, F.col("_high") - F.col("_low"))).drop("_low", "_high")
    return out.drop("_rows")


def bounds(df: DataFrame, keys: list[str], axes: tuple) -> DataFrame:
    """Box, extent and centroid."""
    made = []
    for a in axes:
        made += [F.min(a).alias(f"low_{a}"), F.max(a).alias(f"high_{a}"), (F.max(a) - F.min(a)).alias(f"extent_{a}"), F.avg(a).alias(f"mean_{a}")]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *made)


def line_fit(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least squares y = slope x + intercept by group; null where x doesn't vary."""
    return df.groupBy(*keys).agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"))


def linear_fit(df: DataFrame, keys: list[str], u: str, v: str, y: str, weight: str) -> DataFrame:
    """Weighted least squares y = a u + b v + c by normal equations, solved in closed form (Cramer's rule)."""
    w, cu, cv, cy = (F.col(x).cast("double") for x in (weight, u, v, y))
    s = df.groupBy(*keys).agg(*[F.sum(w * x).alias(k) for k, x in {"s1": F.lit(1.0), "su": cu, "sv": cv, "suu": cu * cu, "suv": cu * cv, "svv": cv * cv, "sy": cy, "suy": cu * cy, "svy": cv * cy}.items()])
    m = [["suu", "suv", "su"], ["suv", "svv", "sv"], ["su", "sv", "s1"]]
    rhs = ["suy", "svy", "sy"]

    def det(rows) -> Column:
        a = [[F.col(c) for c in r] for r in rows]
        return a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])

    whole = det(m)
    solve = lambda j: F.when(F.abs(whole) > 1e-12, det([[rhs[i] if k == j else m[i][k] for k in range(3)] for i in range(3)]) / whole)
    return s.select(*keys, solve(0).alias("a"), solve(1).alias("b"), solve(2).alias("c"))
