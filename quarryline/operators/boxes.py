"""Pairs of boxes that meet, and trees of boxes.

``meeting`` deals each box to a grid of its own level, whose cells are the powers of two next above its widest side, so it lies in
eight cells at most, and lets it look into the same level and all coarser ones that are in use: a pair meets at the level of its wider
box. Boxes of any mixture of sizes give a few rows each; one that spans everything is one row at a coarse level. A cell that
holds, or is looked into by, more than ``CELL`` boxes is cut into blocks on both sides.

A tree takes boxes in Morton order, ``FAN`` at a time: a node is the box around the nodes of its range. Going down is a join on
the parent, and what a bound excludes goes no deeper.

Boxes with a null or non-finite side meet nothing. Columns are lox, hix and so on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import is_finite
from .graph import cut
from .sampling import ranked

CELL, FAN, NODES, FINE = 2048, 32, 4096, 50
AXES = ("x", "y", "z")
SIDES = tuple(f"{s}{x}" for s in ("lo", "hi") for x in AXES)


def finite(df: DataFrame, columns: tuple[str, ...] = SIDES) -> DataFrame:
    """Rows whose ``columns`` are all finite."""
    right = F.lit(True)
    for c in columns:
        right = right & is_finite(c)
    return df.where(right)


def _levels(boxes: DataFrame, unit: float) -> DataFrame:
    """With ``level``: cells of unit * 2 ** level are as wide as the box or less than twice that; not so fine that a cell's number is inexact."""
    far = boxes.agg(F.max(F.greatest(*[F.abs(c) for c in SIDES]))).first()[0] or 0.0
    least = math.ceil(math.log2(far / unit)) - FINE if far > 0 else 0
    width = F.greatest(*[F.col(f"hi{x}") - F.col(f"lo{x}") for x in AXES])
    own = F.when(width > 0, F.ceil(F.log2(width / unit)).cast("int"))
    return boxes.withColumn("level", F.greatest(F.coalesce(own, F.lit(least)), F.lit(least)))


def _celled(boxes: DataFrame, level: str, unit: float) -> DataFrame:
    size = F.lit(float(unit)) * F.pow(F.lit(2.0), F.col(level))
    for x in AXES:
        boxes = boxes.withColumn(f"k{x}", F.explode(F.sequence(F.floor(F.col(f"lo{x}") / size), F.floor(F.col(f"hi{x}") / size))))
    return boxes


def meeting(boxes: DataFrame, id_: str, unit: float = 1.0) -> DataFrame:
    """Each pair of rows with boxes that meet, once, the row of smaller ``id_`` first: all columns, prefixed p and q. Ids differ."""
    columns = boxes.columns
    boxes = cut(_levels(finite(boxes), unit))
    levels = sorted(r[0] for r in boxes.select("level").distinct().collect())  # powers of two of doubles
    at = ["at", *[f"k{x}" for x in AXES]]
    looking = boxes.withColumn("at", F.explode(F.filter(F.array(*[F.lit(v) for v in levels]) if levels else F.array().cast("array<int>"), lambda v: v >= F.col("level"))))
    looking, lying = _celled(looking, "at", unit), _celled(boxes.withColumn("at", F.col("level")), "level", unit)
    count = lambda df, name: df.groupBy(*at).agg(F.count("*").alias(name))
    blocks = lambda name: F.ceil(F.col(name) / CELL).cast("int")
    crowded = count(lying, "n").join(count(looking, "m"), at).where((F.col("n") > CELL) | (F.col("m") > CELL)).select(*at, blocks("m").alias("rows"), blocks("n").alias("blocks"))
    crowded = cut(crowded)
    one = F.lit(1)

    def dealt(df: DataFrame, p: str, own: str, other: str) -> DataFrame:
        """Each row in one block of its own side and in all of the other's."""
        df = df.join(crowded, at, "left").withColumn(f"_{own}", F.pmod(F.xxhash64(id_), F.coalesce(own, one)).cast("int")).withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), F.coalesce(other, one) - 1)))
        return df.select(*at, "_rows", "_blocks", *[F.col(c).alias(f"{p}{c}") for c in (*columns, "level")])

    met = dealt(looking, "p", "rows", "blocks").join(dealt(lying, "q", "blocks", "rows"), [*at, "_rows", "_blocks"])
    size = F.lit(float(unit)) * F.pow(F.lit(2.0), F.col("at"))
    for x in AXES:
        first = F.floor(F.greatest(f"plo{x}", f"qlo{x}") / size)
        met = met.where((F.col(f"plo{x}") <= F.col(f"qhi{x}")) & (F.col(f"qlo{x}") <= F.col(f"phi{x}")) & (F.col(f"k{x}") == first))
    met = met.where((F.col("plevel") < F.col("qlevel")) | (F.col("plevel") == F.col("qlevel")) & (F.col(f"p{id_}") < F.col(f"q{id_}")))
    swap = F.col(f"p{id_}") > F.col(f"q{id_}")
    side = lambda a, b: [F.when(swap, F.col(f"{b}{c}")).otherwise(F.col(f"{a}{c}")).alias(f"{a}{c}") for c in columns]
    return met.where(F.col(f"p{id_}") != F.col(f"q{id_}")).select(*side("p", "q"), *side("q", "p"))


def _spread(x: Column) -> Column:
    """20 bits, each followed by two zeros."""
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def in_blocks(df: DataFrame, place: dict[str, Column], key: str, most: int) -> DataFrame:
    """``df`` with ``block``: rows in Morton order of their place (finite), ``most`` to a block; ties by ``key``."""
    named = df.withColumns({f"_m{x}": c for x, c in place.items()})
    box = named.agg(*[f(f"_m{x}").alias(f"{n}{x}") for x in AXES for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if box["lox"] is None:
        return df.withColumn("block", F.lit(None).cast("long"))
    code = F.lit(0).cast("long")
    for i, x in enumerate(AXES):
        wide = box[f"hi{x}"] - box[f"lo{x}"]
        cell = F.floor((F.col(f"_m{x}") - box[f"lo{x}"]) / wide * ((1 << 20) - 1)) if 0 < wide < math.inf else F.lit(0).cast("long")
        code = code.bitwiseOR(F.shiftleft(_spread(cell), i))
    return ranked(named.withColumn("_code", code), [], [F.col("_code"), F.col(key)]).withColumn("block", F.floor(F.col("_i") / most)).select(*df.columns, "block")


def around(df: DataFrame, node: str) -> DataFrame:
    """The box of each node's rows."""
    return df.groupBy(node).agg(*[F.min(f"lo{x}").alias(f"lo{x}") for x in AXES], *[F.max(f"hi{x}").alias(f"hi{x}") for x in AXES])


def tree(leaves: DataFrame, node: str = "block") -> list[tuple[DataFrame, int]]:
    """Levels (node, parent, sides) from the leaves to the root's children, each with its number of nodes; node numbers are ranges in Morton order."""
    level = leaves.select(F.col(node).alias("node"), *SIDES)
    out = []
    while True:
        level = cut(level.withColumn("parent", F.floor(F.col("node") / FAN)))
        n = level.count()
        out.append((level, n))
        if n <= FAN:
            return out
        level = around(level.drop("node"), "parent").withColumnRenamed("parent", "node")


def gap2(a: str, b: str) -> Column:
    """The squared least distance between two boxes."""
    out = F.lit(0.0)
    for x in AXES:
        d = F.greatest(F.lit(0.0), F.col(f"{a}lo{x}") - F.col(f"{b}hi{x}"), F.col(f"{b}lo{x}") - F.col(f"{a}hi{x}"))
        out = out + d * d
    return out


def far2(a: str, b: str) -> Column:
    """The squared largest distance between two boxes."""
    out = F.lit(0.0)
    for x in AXES:
        d = F.greatest(F.col(f"{a}hi{x}") - F.col(f"{b}lo{x}"), F.col(f"{b}hi{x}") - F.col(f"{a}lo{x}"))
        out = out + d * d
    return out


def _children(front: DataFrame, level: DataFrame, n: int) -> DataFrame:
    below = level.select(F.col("parent").alias("node"), F.col("node").alias("child"), *[F.col(c).alias(f"n_{c}") for c in SIDES])
    return front.join(F.broadcast(below) if n <= NODES else below, "node")  # NODES boxes; beyond, parents are many


def nearest_leaf(blocks: DataFrame, levels: list[tuple[DataFrame, int]]) -> DataFrame:
    """(block, node): a near leaf of each block, by going down to the nearest child; blocks have ``block`` and b_ sides."""
    sides = [f"b_{c}" for c in SIDES]
    front = blocks.select("block", *sides, F.lit(0).cast("long").alias("node"))
    for level, n in reversed(levels):
        met = _children(front, level, n).groupBy("block").agg(F.min(F.struct(gap2("b_", "n_").alias("d"), F.col("child"))).alias("m"), *[F.first(c).alias(c) for c in sides])
        front = cut(met.select("block", *sides, F.col("m.child").alias("node")))
    return front.select("block", "node")


def leaves_within(blocks: DataFrame, levels: list[tuple[DataFrame, int]], most: str) -> DataFrame:
    """(block, node): all leaves that are ``most`` or less away from a block."""
    sides = [f"b_{c}" for c in SIDES]
    front = blocks.select("block", *sides, F.col(most).alias("most"), F.lit(0).cast("long").alias("node"))
    limit = F.col("most") * F.col("most") * (1 + 1e-9)
    for level, n in reversed(levels):
        front = cut(_children(front, level, n).where(gap2("b_", "n_") <= limit).select("block", *sides, "most", F.col("child").alias("node")))
    return front.select("block", "node")
