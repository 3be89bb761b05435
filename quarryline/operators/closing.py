"""Closing boundary loops, repairing contacts, and keeping a mesh to what was observed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .contacts import BLOCKING, contacts
from .graph import cut, keep_touching
from .joins import knn_join
from .mesh import boundary, corners, face_geometry, face_pairs, half_edges, ordered_loops, retract_rim
from .sampling import greedy_cover, ranked


def ear_clip(p: np.ndarray) -> list[tuple[int, int, int]]:
    """Triangles of a simple polygon in the plane, in its own direction; empty if it has no ear to cut (it crosses itself)."""
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    sign = 1.0 if sum(p[i - 1][0] * p[i][1] - p[i - 1][1] * p[i][0] for i in range(len(p))) > 0 else -1.0
    left, out = list(range(len(p))), []
    while len(left) > 3:
        for k in range(len(left)):
            i, j, m = left[k - 1], left[k], left[(k + 1) % len(left)]
            a, b, c = p[i], p[j], p[m]
            if sign * turn(a, b, c) <= 1e-12:
                continue
            if any(min(sign * turn(a, b, p[o]), sign * turn(b, c, p[o]), sign * turn(c, a, p[o])) >= -1e-12 for o in left if o not in (i, j, m)):
                continue
            out.append((i, j, m))
            del left[k]
            break
        else:
            return []
    return [*out, tuple(left)]


def loop_patches(faces: DataFrame, vertices: DataFrame, most_edges: int, most_off: float, most_wide: float = float("inf")) -> DataFrame:
    """component, k, a, b, c: triangles over the corners of each loop of at most ``most_edges`` corners that lies within ``most_off`` of a
    plane and is at most ``most_wide`` across its box; they run against the loop, so their sides pair with the rim's."""
    ship(faces.sparkSession)
    kind = dict(vertices.dtypes)["vid"]
    loops = ordered_loops(faces, vertices, most_edges)
    corners = loops.select("component", F.posexplode("ring").alias("at", "vid")).join(vertices.select("vid", "x", "y", "z"), "vid")

    def close(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("at")
        p, ids = g[["x", "y", "z"]].to_numpy(float), g["vid"].to_numpy()
        c = p - p.mean(0)
        axes = np.linalg.svd(c, full_matrices=False)[2]
        if np.abs(c @ axes[2]).max() > most_off or np.linalg.norm(np.ptp(p, axis=0)) > most_wide:
            return pd.DataFrame(columns=["component", "k", "a", "b", "c"])
        tri = ear_clip(c @ axes[:2].T)
        return pd.DataFrame([(g["component"].iloc[0], k, ids[t[2]], ids[t[1]], ids[t[0]]) for k, t in enumerate(tri)], columns=["component", "k", "a", "b", "c"])

    return corners.groupBy("component").applyInPandas(close, f"component {kind}, k long, a {kind}, b {kind}, c {kind}")


def _numbered(faces: DataFrame, made: DataFrame) -> DataFrame:
    """fid, a, b, c, component of new faces, numbered after the old."""
    top = faces.agg(F.coalesce(F.max("fid"), F.lit(0)).alias("top"))
    return ranked(made, [], [F.col("component"), F.col("k")]).crossJoin(F.broadcast(top)).select((F.col("top") + 1 + F.col("_i")).cast(dict(faces.dtypes)["fid"]).alias("fid"), "a", "b", "c", "component")  # one row


def fill_loops(faces: DataFrame, vertices: DataFrame, most_edges: int, most_off: float) -> DataFrame:
    """``faces`` with small flat loops closed; vertices and old faces are untouched."""
    return faces.select("fid", "a", "b", "c").unionByName(_numbered(faces, loop_patches(faces, vertices, most_edges, most_off)).drop("component"))


def fill_supported(faces: DataFrame, vertices: DataFrame, points: DataFrame, gate: float, cell: float, most_edges: int = 64, most_off: float = 0.6, most_wide: float = float("inf"), angle_deg: float = 35.0, initial: DataFrame | None = None, id_: str = "id") -> DataFrame:
    """``faces`` with those loops closed that observations fill: fid, a, b, c, inferred.

    A loop's patch stays if every place of it is within ``gate`` of a point (samples, plus half their spacing as a bound for what lies
    between), its plane is within ``angle_deg`` of the faces around it, and no new face touches another in a blocking way; else the
    whole patch goes. With ``initial`` faces only loops that those didn't have are closed.
    """
    known = boundary(initial).select("lo", "hi") if initial is not None else None
    made = cut(loop_patches(faces, vertices, most_edges, most_off, most_wide))
    sides = half_edges(made.select(F.struct("component", "k").alias("fid"), "a", "b", "c"))
    if known is not None:
        old = sides.join(known, ["lo", "hi"], "left_semi").select("fid.component").distinct()
        made = cut(made.join(old, "component", "left_anti"))
    new = cut(_numbered(faces, made))
    if not new.limit(1).count():
        return faces.select("fid", "a", "b", "c", F.lit(False).alias("inferred"))
    wide = corners(new.select("fid", "a", "b", "c"), vertices)
    side = lambda p, q: F.sqrt(sum(((F.col(f"{p}{x}") - F.col(f"{q}{x}")) ** 2 for x in "yz"), (F.col(f"{p}x") - F.col(f"{q}x")) ** 2))
    wide = wide.withColumn("long", F.greatest(side("a", "b"), side("b", "c"), side("c", "a"))).withColumn("n", F.greatest(F.lit(2), F.ceil(2 * F.col("long") / min(0.4, gate / 4)).cast("int")))
    grid = wide.withColumn("i", F.explode(F.expr("sequence(0, n)"))).withColumn("j", F.explode(F.expr("sequence(0, n - i)")))
    at = {x: F.col(f"a{x}") + F.col("i") / F.col("n") * (F.col(f"b{x}") - F.col(f"a{x}")) + F.col("j") / F.col("n") * (F.col(f"c{x}") - F.col(f"a{x}")) for x in "xyz"}
    samples = cut(grid.select("fid", (2 * F.col("long") / F.col("n")).alias("gap"), *[c.alias(x) for x, c in at.items()]).withColumn(id_, F.monotonically_increasing_id()))
    near = knn_join(samples, points.select(F.col(id_).cast("long").alias(id_), "x", "y", "z"), 1, id_, ("x", "y", "z")).select(F.col("a_id").alias(id_), "distance")
    bare = samples.join(near, id_, "left").where(F.coalesce(F.col("distance"), F.lit(float("inf"))) + F.col("gap") > gate).select("fid").distinct()
    normal = lambda f: face_geometry(f, vertices).select("fid", "nx", "ny", "nz")
    rims = half_edges(new.select("fid", "a", "b", "c")).select("lo", "hi", "fid").join(half_edges(faces).select("lo", "hi", F.col("fid").alias("old")), ["lo", "hi"])
    turned = rims.join(normal(new.select("fid", "a", "b", "c")), "fid").join(normal(faces).toDF("old", "ox", "oy", "oz"), "old").where(F.col("nx") * F.col("ox") + F.col("ny") * F.col("oy") + F.col("nz") * F.col("oz") < float(np.cos(np.radians(angle_deg)))).select("fid")
    whole = faces.select("fid", "a", "b", "c").unionByName(new.select("fid", "a", "b", "c"))
    clash = contacts(whole, vertices, cell).where(F.col("category").isin(*BLOCKING)).select(F.explode(F.array("fa", "fb")).alias("fid")).distinct()
    bad = new.join(bare.unionByName(turned).unionByName(clash).distinct(), "fid", "left_semi").select("component").distinct()
    good = new.join(bad, "component", "left_anti").select("fid", "a", "b", "c", F.lit(True).alias("inferred"))
    return cut(faces.select("fid", "a", "b", "c", F.lit(False).alias("inferred")).unionByName(good))


def repair_contacts(faces: DataFrame, vertices: DataFrame, cost: DataFrame, cell: float, rounds: int = 4, budget: float = 0.02) -> DataFrame:
    """``faces`` without those that a cheap cover of all blocking contacts takes out, round by round; more than ``budget`` of all faces is
    an error, as is a contact that is left after the rounds. ``cost``: fid, cost."""
    total, kept = faces.count(), faces.select("fid", "a", "b", "c")
    known = cost.select(F.col("fid").alias("member"), "cost")
    for _ in range(rounds + 1):
        pairs = cut(contacts(kept, vertices, cell).where(F.col("category").isin(*BLOCKING)).select("fa", "fb"))
        if not pairs.limit(1).count():
            return kept
        gone = greedy_cover(pairs.select(F.struct("fa", "fb").alias("conflict"), F.explode(F.array("fa", "fb")).alias("member")), known)
        kept = cut(kept.join(gone.withColumnRenamed("member", "fid"), "fid", "left_anti").select("fid", "a", "b", "c"))
        if total - kept.count() > int(budget * total):
            break
    raise ValueError("contacts exceed the budget")


def trim_unsupported(faces: DataFrame, vertices: DataFrame, points: DataFrame, near: float, far: float, id_: str = "id") -> DataFrame:
    """Faces that observations carry: those with all corners within ``near`` of a point, and what connects to them over shared edges
    through faces with all corners within ``far``."""
    at = knn_join(vertices.select(F.col("vid").cast("long").alias(id_), "x", "y", "z"), points.select(F.col(id_).cast("long").alias(id_), "x", "y", "z"), 1, id_, ("x", "y", "z"))
    off = cut(at.select(F.col("a_id").alias("vid"), "distance"))
    worst = faces.select("fid", F.explode(F.array("a", "b", "c")).alias("vid")).join(off, "vid").groupBy("fid").agg(F.max("distance").alias("d"), F.count("*").alias("n")).where("n = 3")
    within = cut(faces.join(worst.where(F.col("d") <= far), "fid").select("fid", "a", "b", "c", "d"))
    pairs = face_pairs(within.select("fid", "a", "b", "c")).select("u", "v")
    held = keep_touching(within.select("fid"), pairs, within.where(F.col("d") <= near), "fid")
    return within.join(held, "fid", "left_semi").select("fid", "a", "b", "c")


def retract_unsupported(faces: DataFrame, vertices: DataFrame, points: DataFrame, far: float, rounds: int, id_: str = "id") -> DataFrame:
    """Rim faces with a corner farther than ``far`` from every point go, round by round from the outside."""
    at = knn_join(vertices.select(F.col("vid").cast("long").alias(id_), "x", "y", "z"), points.select(F.col(id_).cast("long").alias(id_), "x", "y", "z"), 1, id_, ("x", "y", "z"))
    return retract_rim(faces, cut(at.where(F.col("distance") > far).select(F.col("a_id").alias("vid"))), rounds)
