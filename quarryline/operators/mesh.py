"""Triangle meshes as tables: vertices(vid, x, y, z) and faces(fid, a, b, c)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import cross
from .graph import label_nodes
from .sampling import ranked as ranked_rows
from .stats import quantiles


def fan(polygons: DataFrame, id_: str, ring: str) -> DataFrame:
    """Triangles (a, b, c) of each polygon, as a fan from its first corner; fewer than three corners give none."""
    steps = polygons.where(F.size(ring) >= 3).select(id_, ring, F.explode(F.sequence(F.lit(1), F.size(ring) - 2)).alias("i"))
    return steps.select(id_, "i", F.element_at(ring, 1).alias("a"), F.expr(f"element_at({ring}, i + 1)").alias("b"), F.expr(f"element_at({ring}, i + 2)").alias("c"))


def half_edges(faces: DataFrame) -> DataFrame:
    """fid, p, q and lo <= hi of each side of each face, in the face's direction."""
    sides = F.array(*[F.struct(F.col(p).alias("p"), F.col(q).alias("q")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))])
    return faces.select("fid", F.explode(sides).alias("s")).select("fid", "s.p", "s.q", F.least("s.p", "s.q").alias("lo"), F.greatest("s.p", "s.q").alias("hi"))


def edges(faces: DataFrame) -> DataFrame:
    """Undirected edges with their number of faces, and how many run from lo to hi."""
    return half_edges(faces).groupBy("lo", "hi").agg(F.count("*").alias("faces"), F.sum((F.col("p") == F.col("lo")).cast("int")).alias("forward"))


def edge_summary(faces: DataFrame) -> DataFrame:
    e = edges(faces)
    return e.agg(F.count("*").alias("edges"), *[F.coalesce(F.sum(c.cast("int")), F.lit(0)).alias(n) for n, c in (("boundary", F.col("faces") == 1), ("non_manifold", F.col("faces") > 2), ("misoriented", (F.col("faces") == 2) & (F.col("forward") != 1)))])


def incidence(faces: DataFrame) -> DataFrame:
    return half_edges(faces).groupBy("lo", "hi").agg(F.sort_array(F.collect_list("fid")).alias("fids"))


def boundary(faces: DataFrame) -> DataFrame:
    return edges(faces).where("faces = 1").select("lo", "hi")


def face_pairs(faces: DataFrame) -> DataFrame:
    """Faces that share an edge of exactly two faces: u, v and flip (1 if they run along it in the same direction)."""
    h = half_edges(faces)
    two = h.groupBy("lo", "hi").agg(F.count("*").alias("n"), F.min("fid").alias("u"), F.max("fid").alias("v"), F.sum((F.col("p") == F.col("lo")).cast("int")).alias("f")).where("n = 2 and u <> v")
    return two.select("u", "v", (F.col("f") != 1).cast("int").alias("flip"))


def face_components(faces: DataFrame) -> DataFrame:
    """fid, component: the least face reachable over shared edges, of any number of faces."""
    h = half_edges(faces)
    hub = h.join(h.groupBy("lo", "hi").agg(F.min("fid").alias("u")), ["lo", "hi"]).select("u", F.col("fid").alias("v"))
    return label_nodes(faces, hub, "fid")


def corners(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    out = faces.select("fid", "a", "b", "c")
    for k in "abc":
        out = out.join(vertices.select(F.col("vid").alias(k), *[F.col(x).alias(f"{k}{x}") for x in "xyz"]), k)
    return out


def _normal() -> list[Column]:
    side = lambda k: tuple(F.col(f"{k}{x}") - F.col(f"a{x}") for x in "xyz")
    return cross(side("b"), side("c"))


def face_geometry(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """fid, a, b, c, area and unit normal (zero for a degenerate face)."""
    n = _normal()
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    wide = corners(faces, vertices).withColumn("size", size)
    return wide.select("fid", "a", "b", "c", (F.col("size") / 2).alias("area"), *[F.when(F.col("size") > 1e-15, c / F.col("size")).otherwise(0.0).alias(f"n{x}") for c, x in zip(n, "xyz", strict=True)])


def vertex_normals(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """vid, nx, ny, nz: the sum of unit face normals at length 1; (0, 0, 1) where they cancel or there are none."""
    g = face_geometry(faces, vertices)
    summed = g.select(F.explode(F.array("a", "b", "c")).alias("vid"), "nx", "ny", "nz").groupBy("vid").agg(*[F.sum(c).alias(c) for c in ("nx", "ny", "nz")])
    n = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)
    unit = [F.when(n > 1e-12, F.col(c) / n).otherwise(o).alias(c) for c, o in (("nx", 0.0), ("ny", 0.0), ("nz", 1.0))]
    return vertices.select("vid").join(summed, "vid", "left").select("vid", *[F.coalesce(u, F.lit(1.0 if c == "nz" else 0.0)).alias(c) for u, c in zip(unit, ("nx", "ny", "nz"), strict=True)])


def component_summary(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Components, and the largest one's shares of triangles and of area."""
    per = face_components(faces).join(face_geometry(faces, vertices).select("fid", "area"), "fid").groupBy("component").agg(F.count("*").alias("n"), F.sum("area").alias("s"))
    return per.agg(F.count("*").alias("components"), (F.max("n") / F.sum("n")).alias("largest_share"), (F.max("s") / F.sum("s")).alias("largest_area_share"))


def boundary_loops(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Boundary components: vertices, edges, perimeter, highest degree, and whether it is one closed loop."""
    b = boundary(faces)
    nodes = b.select(F.explode(F.array("lo", "hi")).alias("vid")).distinct()
    named = label_nodes(nodes, b.select(F.col("lo").alias("u"), F.col("hi").alias("v")), "vid")
    v = vertices.select("vid", "x", "y", "z")
    ends = b.join(v.toDF("lo", "x0", "y0", "z0"), "lo").join(v.toDF("hi", "x1", "y1", "z1"), "hi")
    size = F.sqrt((F.col("x0") - F.col("x1")) ** 2 + (F.col("y0") - F.col("y1")) ** 2 + (F.col("z0") - F.col("z1")) ** 2)
    per_edge = ends.withColumn("size", size).join(named.withColumnRenamed("vid", "lo"), "lo").groupBy("component").agg(F.count("*").alias("edges"), F.sum("size").alias("perimeter"))
    degree = b.select(F.explode(F.array("lo", "hi")).alias("vid")).groupBy("vid").count().join(named, "vid").groupBy("component").agg(F.count("*").alias("vertices"), F.max("count").alias("degree"), F.min("count").alias("least"))
    return per_edge.join(degree, "component").select("component", "vertices", "edges", "perimeter", "degree", ((F.col("degree") == 2) & (F.col("least") == 2)).alias("closed"))


def laplacian(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """vid, lx, ly, lz: the mean of edge vectors to the neighbours, weighted by inverse edge length."""
    e = edges(faces)
    both = e.select(F.col("lo").alias("vid"), F.col("hi").alias("other")).unionByName(e.select(F.col("hi").alias("vid"), F.col("lo").alias("other")))
    v = vertices.select("vid", "x", "y", "z")
    met = both.join(v, "vid").join(v.toDF("other", "ox", "oy", "oz"), "other")
    d = {x: F.col(f"o{x}") - F.col(x) for x in "xyz"}
    w = 1 / F.greatest(F.sqrt(d["x"] ** 2 + d["y"] ** 2 + d["z"] ** 2), F.lit(1e-12))
    return met.groupBy("vid").agg(*[(F.sum(w * c) / F.sum(w)).alias(f"l{x}") for x, c in d.items()])


def limited_step(faces: DataFrame, vertices: DataFrame, original: DataFrame, factor: float, step: float, total: float) -> DataFrame:
    """One smoothing step along the Laplacian, no longer than ``step``, that stays within ``total`` of the original."""
    cap = lambda v, most: [F.col(c) * F.least(F.lit(1.0), most / F.greatest(F.sqrt(sum((F.col(x) ** 2 for x in v[1:]), F.col(v[0]) ** 2)), F.lit(1e-12))) for c in v]
    moved = vertices.join(laplacian(faces, vertices), "vid", "left").fillna(0.0, ["lx", "ly", "lz"]).withColumns({f"l{x}": F.col(f"l{x}") * factor for x in "xyz"})
    moved = moved.withColumns(dict(zip(("dx", "dy", "dz"), cap(("lx", "ly", "lz"), step), strict=True)))
    far = moved.join(original.select("vid", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz")), "vid").withColumns({f"t{x}": F.col(x) + F.col(f"d{x}") - F.col(f"o{x}") for x in "xyz"})
    kept = far.withColumns(dict(zip(("kx", "ky", "kz"), cap(("tx", "ty", "tz"), total), strict=True)))
    return kept.select("vid", *[(F.col(f"o{x}") + F.col(f"k{x}")).alias(x) for x in "xyz"])


def smooth_normals(faces: DataFrame, vertices: DataFrame, rounds: int = 5, angle_deg: float = 25.0) -> DataFrame:
    """fid and normal after rounds of area- and angle-weighted means over face neighbours."""
    g = face_geometry(faces, vertices)
    pairs = face_pairs(faces)
    both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    cur = g.select("fid", "area", "nx", "ny", "nz")
    for _ in range(rounds):
        near = both.join(cur.toDF("v", "va", "vx", "vy", "vz"), "v").join(cur.withColumnRenamed("fid", "u"), "u")
        cos = F.col("nx") * F.col("vx") + F.col("ny") * F.col("vy") + F.col("nz") * F.col("vz")
        w = F.col("va") * F.exp(-0.5 * F.pow(F.acos(F.least(F.greatest(cos, F.lit(-1.0)), F.lit(1.0))) / F.radians(F.lit(angle_deg)), 2))
        more = near.groupBy(F.col("u").alias("fid")).agg(*[F.sum(w * F.col(f"v{x}")).alias(f"s{x}") for x in "xyz"])
        mixed = cur.join(more, "fid", "left").select("fid", "area", *[(F.col("area") * F.col(f"n{x}") + F.coalesce(f"s{x}", F.lit(0.0))).alias(f"m{x}") for x in "xyz"])
        n = F.sqrt(F.col("mx") ** 2 + F.col("my") ** 2 + F.col("mz") ** 2)
        cur = mixed.select("fid", "area", *[F.when(n > 1e-12, F.col(f"m{x}") / n).otherwise(0.0).alias(f"n{x}") for x in "xyz"])
    return cur.select("fid", "nx", "ny", "nz")


def clean(faces: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal vertices become one, repeated and degenerate faces and unused vertices go."""
    first = vertices.groupBy("x", "y", "z").agg(F.min("vid").alias("keep"))
    to = vertices.join(first, ["x", "y", "z"]).select("vid", "keep")
    out = faces
    for k in "abc":
        out = out.join(to.toDF(k, f"_{k}"), k).drop(k).withColumnRenamed(f"_{k}", k)
    out = out.where("a <> b and b <> c and a <> c").withColumn("_s", F.array_sort(F.array("a", "b", "c"))).groupBy("_s").agg(F.min_by(F.struct("fid", "a", "b", "c"), "fid").alias("r")).select("r.*")
    used = out.select(F.explode(F.array("a", "b", "c")).alias("vid")).distinct()
    return out, vertices.join(used, "vid", "left_semi")


def exact_duplicates(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy("x", "y", "z").agg(F.sort_array(F.collect_list("vid")).alias("vids")).where(F.size("vids") > 1)


def coincident_groups(vertices: DataFrame, tolerance: float) -> DataFrame:
    """vid and group of vertices that chain together within the tolerance; lone vertices are left out."""
    from .joins import radius_join

    near = radius_join(vertices, vertices, tolerance, "vid", ("x", "y", "z")).where("a_id < b_id").select(F.col("a_id").alias("u"), F.col("b_id").alias("v"))
    named = label_nodes(vertices, near, "vid")
    several = named.groupBy("component").count().where("count > 1").select("component")
    return named.join(several, "component", "left_semi").select("vid", F.col("component").alias("group"))


def face_key(faces: DataFrame, vertices: DataFrame, quantum: float = 1e-5) -> DataFrame:
    """fid and a key of its sorted, rounded corners, by which faces of two meshes are matched."""
    point = lambda k: F.concat_ws(",", *[F.rint(F.col(f"{k}{x}") / quantum).cast("bigint").cast("string") for x in "xyz"])
    return corners(faces, vertices).select("fid", F.array_join(F.array_sort(F.array(*[point(k) for k in "abc"])), ";").alias("key"))


def inherit_flags(final_keys: DataFrame, source_keys: DataFrame, flagged_keys: DataFrame) -> DataFrame:
    """A face is inferred if its key isn't in the source or was flagged there."""
    known = source_keys.select("key", F.lit(True).alias("known")).distinct()
    flags = flagged_keys.select("key", F.lit(True).alias("flag")).distinct()
    return final_keys.join(known, "key", "left").join(flags, "key", "left").select("fid", (F.col("known").isNull() | F.col("flag").isNotNull()).alias("inferred"))


def face_evidence(faces: DataFrame, vertices: DataFrame, evidence: DataFrame) -> DataFrame:
    """Median of the corners' evidence, area and boundary sides of each face."""
    out = faces
    for k in "abc":
        out = out.join(evidence.select(F.col("vid").alias(k), F.col("evidence").alias(f"e{k}")), k, "left")
    rim = half_edges(faces).join(boundary(faces), ["lo", "hi"], "left_semi").groupBy("fid").agg(F.count("*").alias("rim"))
    return out.join(face_geometry(faces, vertices).select("fid", "area"), "fid").join(rim, "fid", "left").select("fid", F.element_at(F.array_sort(F.array("ea", "eb", "ec")), 2).alias("evidence"), "area", F.coalesce("rim", F.lit(0)).alias("rim"))


def drop_weak_components(faces: DataFrame, vertices: DataFrame, evidence: DataFrame, least_faces: int, least_evidence: float) -> DataFrame:
    """Components that are both small and weakly supported go, whole."""
    per = face_components(faces).join(face_evidence(faces, vertices, evidence), "fid").groupBy("component").agg(F.count("*").alias("n"), F.avg("evidence").alias("e"))
    weak = per.where((F.col("n") < least_faces) & (F.col("e") < least_evidence)).select("component")
    return faces.join(face_components(faces).join(weak, "component", "left_semi").select("fid"), "fid", "left_anti")


def retract_rim(faces: DataFrame, far: DataFrame, rounds: int) -> DataFrame:
    """Faces with a boundary side that touch a vertex of ``far(vid)`` go, round by round."""
    from .graph import cut

    for _ in range(rounds):
        rim = half_edges(faces).join(boundary(faces), ["lo", "hi"], "left_semi").select("fid").distinct()
        bad = faces.select("fid", F.explode(F.array("a", "b", "c")).alias("vid")).join(far, "vid", "left_semi").select("fid").distinct().join(rim, "fid", "left_semi")
        left = cut(faces.join(bad, "fid", "left_anti"))
        if left.count() == faces.count():
            return left
        faces = left
    return faces


def signed_volume(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Volume of a closed mesh; null if an edge hasn't exactly two faces of opposite direction."""
    c = corners(faces, vertices)
    n = cross(tuple(F.col(f"b{x}") for x in "xyz"), tuple(F.col(f"c{x}") for x in "xyz"))
    v = c.agg((F.sum(F.col("ax") * n[0] + F.col("ay") * n[1] + F.col("az") * n[2]) / 6).alias("v"))
    bad = edges(faces).agg(F.coalesce(F.sum(((F.col("faces") != 2) | (F.col("forward") != 1)).cast("int")), F.lit(1)).alias("bad"))
    return v.crossJoin(bad).select(F.when(F.col("bad") == 0, F.col("v")).alias("volume"))  # one row each


def clip_below(faces: DataFrame, vertices: DataFrame, base: float) -> DataFrame:
    """Faces wholly at or above y = base, and cut polygons of those that cross it, as rings of points for ``fan``; no cap."""
    pts = corners(faces, vertices).select("fid", F.array(*[F.struct(*[F.col(f"{k}{x}").alias(x) for x in "xyz"]) for k in "abc"]).alias("p"))
    cross_at = lambda a, b: F.struct(*[(a[x] + (b[x] - a[x]) * (base - a["y"]) / (b["y"] - a["y"])).alias(x) for x in "xyz"])
    ring = None
    parts = []
    for i, j in ((1, 2), (2, 3), (3, 1)):
        a, b = F.element_at("p", i), F.element_at("p", j)
        parts += [F.when(a["y"] >= base, a), F.when((a["y"] - base) * (b["y"] - base) < 0, cross_at(a, b))]
    ring = F.array_compact(F.array(*parts))
    return pts.select("fid", ring.alias("ring")).where(F.size("ring") >= 3)


def split_fans(faces: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A vertex gets one copy for each further fan of faces around it that shares no edge with the first.

    The corners (fid, vid) of a mesh are nodes; two corners at one vertex link where their faces share an edge at it.
    """
    h = half_edges(faces)
    ends = h.select("fid", "lo", "hi", F.explode(F.array("lo", "hi")).alias("vid"))
    hub = ends.groupBy("vid", "lo", "hi").agg(F.min("fid").alias("first"))
    corner = lambda f, v: F.struct(F.col(v).alias("v"), F.col(f).alias("f"))
    links = ends.join(hub, ["vid", "lo", "hi"]).where("fid <> first").select(corner("first", "vid").alias("u"), corner("fid", "vid").alias("v"))
    nodes = faces.select("fid", F.explode(F.array("a", "b", "c")).alias("vid")).select(corner("fid", "vid").alias("node"))
    named = label_nodes(nodes, links, "node").select(F.col("node.v").alias("vid"), F.col("node.f").alias("fid"), F.col("component.f").alias("fan"))
    from pyspark.sql import Window

    ranked = named.select("vid", "fan").distinct().withColumn("k", F.row_number().over(Window.partitionBy("vid").orderBy("fan")) - 1)
    extra = ranked.where("k > 0")
    top = vertices.agg(F.max("vid").alias("top"))
    fresh = extra.crossJoin(F.broadcast(top)).withColumn("at", F.xxhash64("vid", "fan"))  # one row
    total = fresh.count()
    numbered = ranked_rows(fresh, [], [F.col("vid"), F.col("fan")]).withColumn("new", F.col("top") + 1 + F.col("_i")) if total else fresh.withColumn("new", F.col("top"))
    numbered = numbered.select("vid", "fan", "new")
    moved = named.join(numbered, ["vid", "fan"], "left").select("fid", "vid", F.coalesce("new", "vid").alias("to"))
    out = faces
    for k in "abc":
        out = out.join(moved.select("fid", F.col("vid").alias(k), F.col("to").alias(f"_{k}")), ["fid", k]).drop(k).withColumnRenamed(f"_{k}", k)
    copies = numbered.join(vertices, "vid").select(F.col("new").alias("vid"), *[c for c in vertices.columns if c != "vid"])
    return out.select("fid", "a", "b", "c"), vertices.unionByName(copies)


def orientation_cost(evidence: DataFrame) -> DataFrame:
    """Cost of removing a face: more evidence and area cost more, rim faces less; areas count against the median."""
    return evidence.crossJoin(F.broadcast(quantiles(evidence, [], "area", {"m": 0.5}))).select("fid", (1.0 + 2.0 * F.coalesce("evidence", F.lit(0.0)) + F.least(F.col("area") / F.greatest("m", F.lit(1e-12)), F.lit(4.0)) - 0.25 * F.col("rim")).alias("cost"))  # one row


def repair_orientation(faces: DataFrame, vertices: DataFrame, evidence: DataFrame, budget: float = 0.02) -> DataFrame:
    """Faces turned so that neighbours agree; in components that can't agree the cheapest faces go, within ``budget`` of all.

    More than the budget is an error, and nothing is changed.
    """
    from .graph import cut, parity
    from .sampling import greedy_cover

    total, kept, removed = faces.count(), faces, 0
    while True:
        pairs = cut(face_pairs(kept))
        labels = cut(parity(kept, pairs, "fid"))
        bad = labels.where("conflict").select("fid")
        if bad.limit(1).count() == 0:
            break
        cost = orientation_cost(face_evidence(kept, vertices, evidence)).select(F.col("fid").alias("member"), "cost")
        wrong = pairs.where("flip = 1").join(bad.withColumnRenamed("fid", "u"), "u", "left_semi")
        chosen = cut(greedy_cover(wrong.select(F.struct("u", "v").alias("conflict"), F.explode(F.array("u", "v")).alias("member")), cost))
        removed += chosen.count()
        if removed > budget * total:
            raise ValueError("orientation conflicts exceed the budget")
        kept = cut(kept.join(chosen.withColumnRenamed("member", "fid"), "fid", "left_anti").select(faces.columns))
    turned = kept.join(labels.select("fid", "label"), "fid", "left")
    return turned.select("fid", "a", F.when(F.col("label") == 1, F.col("c")).otherwise(F.col("b")).alias("b"), F.when(F.col("label") == 1, F.col("b")).otherwise(F.col("c")).alias("c"))


def rim_places(faces: DataFrame) -> DataFrame:
    """component, place, size and node of the simple closed boundary loops, in face direction, whatever their length."""
    from .graph import loop_places

    return loop_places(half_edges(faces).join(boundary(faces), ["lo", "hi"], "left_semi").select("p", "q"))


def ordered_loops(faces: DataFrame, vertices: DataFrame, most: int | None = None) -> DataFrame:
    """component and ring (an array) of the simple closed boundary loops, in face direction, of ``most`` edges or fewer if given;
    other boundary components are left out."""
    places = rim_places(faces)
    if most is not None:
        places = places.where(F.col("size") <= most)
    return places.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("place", "node"))).alias("r")).select("component", F.col("r.node").alias("ring"))


def ring_residuals(faces: DataFrame, vertices: DataFrame, rings: int = 2, least: int = 6) -> DataFrame:
    """Height of each vertex over the robust quadratic of its k-ring, in the frame of its normal: vid, residual, scale."""
    import numpy as np
    import pandas as pd

    from ..session import ship
    from .fitting import irls, quadratic_design
    from .graph import rings as ring_join

    ship(faces.sparkSession)
    e = edges(faces).select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    near = ring_join(e, vertices.select(F.col("vid").alias("center")), rings)
    v = vertices.select("vid", "x", "y", "z")
    wide = near.join(v.withColumnRenamed("vid", "node"), "node").join(v.toDF("center", "cx", "cy", "cz"), "center").join(vertex_normals(faces, vertices).withColumnRenamed("vid", "center"), "center")
    kind = dict(vertices.dtypes)["vid"]

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        vid = g["center"].iloc[0]
        if len(g) < least:
            return pd.DataFrame({"vid": [vid], "residual": [None], "scale": [None]}).astype({"residual": float, "scale": float})
        n = g[["nx", "ny", "nz"]].iloc[0].to_numpy(float)
        side = np.eye(3)[int(np.argmin(np.abs(n)))]
        a = side - n * (side @ n)
        a /= np.linalg.norm(a)
        d = g[["x", "y", "z"]].to_numpy(float) - g[["cx", "cy", "cz"]].to_numpy(float)
        u, w, t = d @ a, d @ np.cross(n, a), d @ n
        q = quadratic_design(u, w)
        beta = irls(q, t, np.ones(len(t)), rounds=6)
        return pd.DataFrame({"vid": [vid], "residual": [-float(beta[5])], "scale": [max(1e-6, 1.4826 * float(np.median(np.abs(t - q @ beta))))]})

    return wide.groupBy("center").applyInPandas(fit, f"vid {kind}, residual double, scale double")


def despike(faces: DataFrame, vertices: DataFrame, limit: float = 3.0, share: float = 0.58, factor: float = 0.84, most: float = 1.0, rings: int = 2) -> DataFrame:
    """Vertices ``limit`` scales off their ring surface move back by ``factor`` of it, at most ``most``; rims and clusters of like outliers stay."""
    from .graph import cut

    r = cut(ring_residuals(faces, vertices, rings))
    out = r.select("vid", "residual", (F.abs("residual") >= limit * F.col("scale")).alias("off"))
    e = edges(faces)
    both = e.select(F.col("lo").alias("vid"), F.col("hi").alias("other")).unionByName(e.select(F.col("hi").alias("vid"), F.col("lo").alias("other")))
    like = both.join(out.toDF("other", "o_res", "o_off"), "other").join(out, "vid").groupBy("vid").agg(F.avg((F.coalesce("o_off", F.lit(False)) & (F.signum("o_res") == F.signum("residual"))).cast("int")).alias("like"))
    rim = boundary(faces).select(F.explode(F.array("lo", "hi")).alias("vid")).distinct()
    move = out.where("off").join(like.where(F.col("like") <= share), "vid").join(rim, "vid", "left_anti").select("vid", (F.signum("residual") * F.least(factor * F.abs("residual"), F.lit(most))).alias("m"))
    n = vertex_normals(faces, vertices)
    return vertices.join(n, "vid").join(move, "vid", "left").select("vid", *[(F.col(x) - F.coalesce("m", F.lit(0.0)) * F.col(f"n{x}")).alias(x) for x in "xyz"])


def guarded(original: DataFrame, moved: DataFrame, faces: DataFrame, most_extent: float = 0.01, rounds: int = 8) -> DataFrame:
    """The largest share of a move whose box grows or shrinks by at most ``most_extent`` of each axis; vertices of faces that
    turn over go back wholly."""
    lo, hi = 0.0, 1.0
    joined = original.join(moved.toDF("vid", "mx", "my", "mz"), "vid")
    at = lambda f: [(F.col(x) + f * (F.col(f"m{x}") - F.col(x))).alias(x) for x in "xyz"]
    box = lambda df: df.agg(*[(F.max(x) - F.min(x)).alias(x) for x in "xyz"]).first()
    first = box(original)
    fits = lambda f: all(abs(b - a) <= most_extent * max(a, 1e-12) for a, b in zip(first, box(joined.select("vid", *at(f))), strict=True))
    if fits(1.0):
        lo = 1.0
    else:
        for _ in range(rounds):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if fits(mid) else (lo, mid)
    new = joined.select("vid", *at(lo))
    before, after = face_geometry(faces, original), face_geometry(faces, new).select("fid", F.col("nx").alias("ax"), F.col("ny").alias("ay"), F.col("nz").alias("az"))
    flipped = before.join(after, "fid").where("nx * ax + ny * ay + nz * az < 0").select(F.explode(F.array("a", "b", "c")).alias("vid")).distinct()
    return new.join(flipped, "vid", "left_anti").unionByName(original.select("vid", "x", "y", "z").join(flipped, "vid", "left_semi"))


def triangle_distance(q, a, b, c):
    """Distance of each point to the triangle of its row, as arrays (n, 3)."""
    import numpy as np

    def segment(u, v):
        d = v - u
        t = np.clip(((q - u) * d).sum(1) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
        return np.linalg.norm(q - u - t[:, None] * d, axis=1)

    best = np.minimum(np.minimum(segment(a, b), segment(b, c)), segment(c, a))
    n = np.cross(b - a, c - a)
    size = np.maximum(np.linalg.norm(n, axis=1), 1e-300)
    inside = np.ones(len(q), bool)
    for u, v in ((a, b), (b, c), (c, a)):
        inside &= (np.cross(v - u, q - u) * n).sum(1) >= 0
    flat = np.abs(((q - a) * n).sum(1)) / size
    return np.where(inside & (size > 1e-300), np.minimum(best, flat), best)


LEAF, POINTS = 256, 64  # faces of a leaf, points of a block at least
PAIRS, MEASURED = 2_000_000, 65_536  # of chunks and faces, of points and faces, at a time
SLACK, SINE = 1e-11, 1e-3  # of the coordinates, for rounding; below this sine a triangle's normal decides nothing


class _Nearest:
    """The distance of each point of a block to the nearest of the faces that come by.

    Points lie in small chunks. A face is as far from a chunk as its plane and its box are, and from a point as its plane is, at least; only
    what these leave as near as something already known is measured.
    """

    def __init__(self, points):
        import numpy as np

        from . import near

        p = near.numbers(points, *"xyz")
        order = near.chunks(p, near.FEW)
        self.ends = np.r_[0, np.cumsum([len(i) for i in order])]
        order = np.concatenate(order)
        self.ids, self.p, self.seen = near._one(points.column("id")).take(near.pa.array(order)), p[:, order].T.copy(), 0
        self.middle = self.p.min(0) / 2 + self.p.max(0) / 2
        self.moved = self.p - self.middle
        self.lo, self.hi = np.minimum.reduceat(self.p, self.ends[:-1]), np.maximum.reduceat(self.p, self.ends[:-1])
        self.at = (self.lo / 2 + self.hi / 2) - self.middle
        self.wide = np.sqrt(((self.hi - self.lo) ** 2).sum(1)) / 2 * (1 + 1e-9)
        self.found, self.limit = np.full(len(p.T), np.inf), np.full(len(order), np.inf)
        self.most = np.full(len(self.lo), np.inf)  # of a chunk's limits
        self.size = float(np.abs(self.p).max())

    def add(self, batch):
        import numpy as np

        from . import near

        tri = near.numbers(batch, *(f"{k}{x}" for k in "abc" for x in "xyz")).T.reshape(-1, 3, 3)
        done = 0
        while done < len(tri):  # few at first, as long as nothing is known
            n = min(max(16, 3 * self.seen), max(64, PAIRS // len(self.most)))
            with np.errstate(all="ignore"):
                self._meet(tri[done : done + n])
            self.seen, done = self.seen + min(n, len(tri) - done), done + n

    def _meet(self, tri):
        import numpy as np

        a, e, f = tri[:, 0], tri[:, 1] - tri[:, 0], tri[:, 2] - tri[:, 0]
        n = np.cross(e, f)
        size = np.sqrt((n * n).sum(1))
        even = size > SINE * np.sqrt((e * e).sum(1) * (f * f).sum(1))
        n = np.where(even[:, None], n / np.where(even, size, 1.0)[:, None], 0.0)
        d = (n * (a - self.middle)).sum(1)
        slack = SLACK * (self.size + float(np.abs(tri).max()))
        low, high = tri.min(1), tri.max(1)
        open_ = np.flatnonzero(self.most > self.wide)
        if len(open_):  # a corner bounds the distance of all points of a chunk
            corner, at = tri.reshape(-1, 3) - self.middle, self.at[open_]
            d2 = (corner * corner).sum(1)[None] - 2 * (at @ corner.T)
            nearest = np.argmin(d2, 1)
            bound = np.sqrt(((corner[nearest] - at) ** 2).sum(1)) + self.wide[open_] + slack
            for s, b in zip(open_, bound, strict=True):
                part = self.limit[self.ends[s] : self.ends[s + 1]]
                np.fmin(part, b, out=part)
                self.most[s] = part.max()
        far = np.abs(self.at @ n.T - d) > (self.wide + self.most + slack)[:, None]
        reach = (self.most * (1 + 1e-9) + slack)[:, None]
        for x in range(3):
            far |= low[:, x] > self.hi[:, x, None] + reach
            far |= high[:, x] < self.lo[:, x, None] - reach
        rows, faces, waiting = [], [], 0
        for s in np.flatnonzero(~far.all(1)):
            some, i = np.flatnonzero(~far[s]), self.ends[s]
            off = self.moved[i : self.ends[s + 1]] @ n[some].T
            off -= d[some]
            np.abs(off, out=off)
            r, c = np.nonzero(~(off > (self.limit[i : self.ends[s + 1]] * (1 + 1e-9) + slack)[:, None]))
            rows.append(r + i)
            faces.append(some[c])
            waiting += len(r)
            if waiting > MEASURED:
                self._measure(tri, low, high, slack, np.concatenate(rows), np.concatenate(faces))
                rows, faces, waiting = [], [], 0
        if waiting:
            self._measure(tri, low, high, slack, np.concatenate(rows), np.concatenate(faces))
        np.fmin(self.limit, self.found, out=self.limit)
        self.most = np.maximum.reduceat(self.limit, self.ends[:-1])

    def _measure(self, tri, low, high, slack, rows, faces):
        import numpy as np

        reach = (self.limit[rows] * (1 + 1e-9) + slack)[:, None]
        keep = ~((low[faces] > self.p[rows] + reach) | (high[faces] < self.p[rows] - reach)).any(1)
        rows, faces = rows[keep], faces[keep]
        for i in range(0, len(rows), MEASURED):
            r, t = rows[i : i + MEASURED], tri[faces[i : i + MEASURED]]
            np.fmin.at(self.found, r, triangle_distance(self.p[r], t[:, 0], t[:, 1], t[:, 2]))

    def end(self):
        from .near import pa

        yield pa.RecordBatch.from_arrays([self.ids, pa.array(self.found)], names=["id", "distance"])


def point_to_mesh(points: DataFrame, faces: DataFrame, vertices: DataFrame, reach: float | None = None, id_: str = "id") -> DataFrame:
    """Exact distance of each point to the mesh, however far; with ``reach``, null beyond it. One row for each row of ``points``.

    Points go into blocks and faces into leaves of a tree, both in Morton order. The nearest corner of a near leaf bounds the distances of
    a block; faces whose box and plane are as near to the block as that come to its task, where small chunks of its points leave most of them out
    (``_Nearest``), so faces that span the whole cloud cost little too. Points with a null or non-finite coordinate have null, and so have all where no
    face has three finite corners.
    """
    from ..functions.scalar import is_finite
    from ..session import ship
    from . import boxes, near
    from .graph import cut

    ship(points.sparkSession)
    p = points.select(F.col(id_).alias("id"), *[F.col(x).cast("double").alias(x) for x in "xyz"])
    p = cut(p.withColumn("ok", is_finite("x") & is_finite("y") & is_finite("z")))
    right, rest = p.where("ok").drop("ok"), p.where("not coalesce(ok, false)").select("id", F.lit(None).cast("double").alias("distance"))
    nine = [f"{k}{x}" for k in "abc" for x in "xyz"]
    wide = corners(faces.select("fid", "a", "b", "c"), vertices.select("vid", *[F.col(x).cast("double").alias(x) for x in "xyz"]))
    wide = boxes.finite(wide, tuple(nine)).groupBy(*nine).agg(F.min("fid").alias("fid"))  # copies are one
    wide = wide.withColumns({f"{s}{x}": f(f"a{x}", f"b{x}", f"c{x}") for s, f in (("lo", F.least), ("hi", F.greatest)) for x in "xyz"})
    wide = boxes.in_blocks(wide, {x: F.col(f"lo{x}") / 2 + F.col(f"hi{x}") / 2 for x in "xyz"}, "fid", LEAF)
    wide = cut(wide.select(F.col("block").alias("node"), *nine, *boxes.SIDES))
    n = right.count()
    if not n or not wide.limit(1).count():
        return p.select(F.col("id").alias(id_), F.lit(None).cast("double").alias("distance"))
    levels = boxes.tree(boxes.around(wide, "node"), "node")
    dealt = cut(boxes.in_blocks(right, {x: F.col(x) for x in "xyz"}, "id", near.share(n, POINTS)))
    own = cut(dealt.groupBy("block").agg(*[f(x).alias(f"b_{s}{x}") for s, f in (("lo", F.min), ("hi", F.max)) for x in "xyz"]))
    middle = {x: F.col(f"b_lo{x}") / 2 + F.col(f"b_hi{x}") / 2 for x in "xyz"}
    norm = lambda parts: F.sqrt(sum((v * v for v in parts[1:]), parts[0] * parts[0]))
    half = norm([F.col(f"b_hi{x}") / 2 - F.col(f"b_lo{x}") / 2 for x in "xyz"])
    corner = F.least(*[norm([F.col(f"{k}{x}") - middle[x] for x in "xyz"]) for k in "abc"])
    bound = boxes.nearest_leaf(own, levels).join(own, "block").join(wide, "node").groupBy("block").agg(((F.min(corner) + F.first(half)) * (1 + 1e-9)).alias("most"))
    own = cut(own.join(bound, "block"))
    e, f = ({x: F.col(f"{k}{x}") - F.col(f"a{x}") for x in "xyz"} for k in "bc")
    normal = wide.withColumns({f"n{x}": e[y] * f[z] - e[z] * f[y] for x, y, z in ("xyz", "yzx", "zxy")})
    normal = normal.withColumn("_size", norm([F.col(f"n{x}") for x in "xyz"])).withColumn("_even", F.col("_size") > SINE * norm(list(e.values())) * norm(list(f.values())))
    normal = normal.withColumns({f"n{x}": F.when(F.col("_even"), F.col(f"n{x}") / F.col("_size")).otherwise(0.0) for x in "xyz"})
    off = F.abs(sum(((middle[x] - F.col(f"a{x}")) * F.col(f"n{x}") for x in "yz"), (middle["x"] - F.col("ax")) * F.col("nx")))
    slack = SLACK * F.greatest(*[F.abs(c) for c in (*boxes.SIDES, *(f"b_{c}" for c in boxes.SIDES))])
    pairs = cut(boxes.leaves_within(own, levels, "most").join(own, "block"))
    parts = max(int(p.sparkSession.conf.get("spark.sql.shuffle.partitions")), near.BLOCKS)
    met = normal.repartition(parts, "node").join(pairs.repartition(parts, "node"), "node")
    close = (boxes.gap2("b_", "") <= F.col("most") * F.col("most") * (1 + 1e-9)) & (F.isnan(off) | (off <= (half + F.col("most")) * (1 + 1e-9) + slack))
    zero = F.lit(0).cast("long").alias("_node")
    one = dealt.select("block", F.lit(0).alias("_kind"), zero, "id", *"xyz", *[F.lit(None).cast("double").alias(c) for c in nine])
    other = met.where(close).select("block", F.lit(1).alias("_kind"), zero, F.lit(None).cast(dict(p.dtypes)["id"]).alias("id"), *[F.lit(None).cast("double").alias(x) for x in "xyz"], *nine)
    rows = one.unionByName(other).repartition(min(2 * own.count(), near.TASKS), "block").sortWithinPartitions("block", "_kind")
    found = near.streamed(rows, _Nearest, f"id {dict(p.dtypes)['id']}, distance double")
    if reach is not None:
        found = found.withColumn("distance", F.when(F.col("distance") <= reach, F.col("distance")))
    return found.unionByName(rest).withColumnRenamed("id", id_)


def sample_surface(faces: DataFrame, vertices: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """About ``count`` points spread evenly over the area: fid, i, x, y, z."""
    from .sampling import uniform

    g = face_geometry(faces, vertices)
    whole = g.agg(F.sum("area").alias("s"))
    want = g.crossJoin(F.broadcast(whole)).select("fid", (count * F.col("area") / F.greatest("s", F.lit(1e-300))).alias("w"))  # one row
    n = F.floor(F.col("w") + uniform("fid", seed)).cast("int")
    dealt = want.withColumn("n", n).where("n > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    key = F.xxhash64("fid", "i")
    dealt = dealt.withColumn("key", key).withColumn("u", F.sqrt(uniform("key", seed + 1))).withColumn("v", uniform("key", seed + 2))
    wide = dealt.join(corners(faces, vertices), "fid")
    return wide.select("fid", "i", *[((1 - F.col("u")) * F.col(f"a{x}") + F.col("u") * (1 - F.col("v")) * F.col(f"b{x}") + F.col("u") * F.col("v") * F.col(f"c{x}")).alias(x) for x in "xyz"])


def fair(faces: DataFrame, vertices: DataFrame, original: DataFrame, spacing: float, strength: float = 0.5, start: float = 0.05, width: float = 0.2, noise: float = 1.0, step: float = 0.1, total: float = 0.5, rings: int = 2) -> DataFrame:
    """Vertices moved onto the quadratic of their rings where they stand off it by more than spacing and noise explain; the
    move fades in, is limited a step and in all, and rims stay."""
    from ..functions.scalar import clip, smoothstep
    from .graph import cut

    r = cut(ring_residuals(faces, vertices, rings))
    rim = boundary(faces).select(F.explode(F.array("lo", "hi")).alias("vid")).distinct()
    gate = smoothstep((F.abs("residual") - F.greatest(F.lit(start * spacing), noise * F.col("scale"))) / max(width * spacing, 1e-9))
    move = r.join(rim, "vid", "left_anti").select("vid", F.coalesce(clip(-strength * gate * F.col("residual"), -step * spacing, step * spacing), F.lit(0.0)).alias("m"))
    n = vertex_normals(faces, vertices)
    moved = vertices.join(n, "vid").join(move, "vid", "left").select("vid", *[(F.col(x) + F.coalesce("m", F.lit(0.0)) * F.col(f"n{x}")).alias(x) for x in "xyz"])
    far = moved.join(original.select("vid", *[F.col(x).alias(f"o{x}") for x in "xyz"]), "vid")
    size = F.sqrt(sum(((F.col(x) - F.col(f"o{x}")) ** 2 for x in "yz"), (F.col("x") - F.col("ox")) ** 2))
    keep = F.least(F.lit(1.0), total * spacing / F.greatest(size, F.lit(1e-12)))
    return far.select("vid", *[(F.col(f"o{x}") + keep * (F.col(x) - F.col(f"o{x}"))).alias(x) for x in "xyz"])


def scale_trend(faces: DataFrame, vertices: DataFrame, spacing: float, small: float = 3.0, large: float = 8.0, angle_deg: float = 30.0, start: float = 0.1, width: float = 0.3, strength: float = 0.5, step: float = 0.15, least: int = 8) -> DataFrame:
    """Vertices moved towards the quadratic of a large neighbourhood where it parts from a small one's; neighbours across an
    edge (by normal) don't count, and rims stay. Radii are in spacings."""
    import numpy as np
    import pandas as pd

    from ..functions.scalar import clip, smoothstep
    from ..session import ship
    from .fitting import irls, quadratic_design
    from .joins import radius_join

    ship(faces.sparkSession)
    v = vertices.join(vertex_normals(faces, vertices), "vid")
    near = radius_join(v, v, large * spacing, "vid", ("x", "y", "z"), carry=("x", "y", "z", "nx", "ny", "nz")).where("a_id <> b_id")
    near = near.where(F.col("a_nx") * F.col("b_nx") + F.col("a_ny") * F.col("b_ny") + F.col("a_nz") * F.col("b_nz") >= float(np.cos(np.radians(angle_deg))))
    kind = dict(vertices.dtypes)["vid"]

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        n = g[["a_nx", "a_ny", "a_nz"]].iloc[0].to_numpy(float)
        side = np.eye(3)[int(np.argmin(np.abs(n)))]
        a = side - n * (side @ n)
        a /= np.linalg.norm(a)
        d = g[["b_x", "b_y", "b_z"]].to_numpy(float) - g[["a_x", "a_y", "a_z"]].to_numpy(float)
        heights = []
        for radius in (small * spacing, large * spacing):
            q = d[g["distance"].to_numpy() <= radius]
            heights.append(float(irls(quadratic_design(q @ a, q @ np.cross(n, a)), q @ n, np.ones(len(q)), rounds=6)[5]) if len(q) >= least else None)
        return pd.DataFrame({"vid": [g["a_id"].iloc[0]], "s": [heights[0]], "l": [heights[1]]}).astype({"s": float, "l": float})

    made = near.groupBy("a_id").applyInPandas(fit, f"vid {kind}, s double, l double")
    rim = boundary(faces).select(F.explode(F.array("lo", "hi")).alias("vid")).distinct()
    gate = smoothstep((F.abs(F.col("l") - F.col("s")) - start * spacing) / max(width * spacing, 1e-9))
    move = made.where("not isnan(s) and not isnan(l)").join(rim, "vid", "left_anti").select("vid", clip(strength * gate * F.col("l"), -step * spacing, step * spacing).alias("m"))
    return v.join(move, "vid", "left").select("vid", *[(F.col(x) + F.coalesce("m", F.lit(0.0)) * F.col(f"n{x}")).alias(x) for x in "xyz"])


def edge_structure(faces: DataFrame, vertices: DataFrame, soft_deg: float = 22.0, hard_deg: float = 42.0, least_strength: float = 0.12, least_weight: float = 0.08, ring_strength: float = 0.35, rounds: int = 0, share: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """What a smoothing may do at each edge and vertex, fixed before it: edges (lo, hi, dihedral, weight, rim) and vertices (vid,
    dihedral, strength, rim).

    Dihedral angles (180 on a rim; the largest to the first face where an edge has more than two) are measured after ``rounds`` of
    Laplacian steps of ``share`` on vertices off the rim, so roughness doesn't pass for an edge. Weights and strengths fall smoothly from
    1 at ``soft_deg`` to their least at ``hard_deg``; a rim's are 0, and one step off the rim a strength is ``ring_strength`` at most.
    """
    from ..functions.scalar import smoothstep
    from .graph import cut

    rim = boundary(faces).select("lo", "hi")
    open_ = cut(rim.select(F.explode(F.array("lo", "hi")).alias("vid")).distinct())
    guide = vertices.select("vid", "x", "y", "z")
    for _ in range(rounds):
        step = laplacian(faces, guide).join(open_, "vid", "left_anti")
        guide = cut(guide.join(step, "vid", "left").select("vid", *[(F.col(c) + share * F.coalesce(f"l{c}", F.lit(0.0))).alias(c) for c in "xyz"]))
    n = face_geometry(faces, guide).select("fid", "nx", "ny", "nz")
    sides = half_edges(faces).select("lo", "hi", "fid").join(n, "fid").groupBy("lo", "hi").agg(F.array_sort(F.collect_list(F.struct("fid", "nx", "ny", "nz"))).alias("f"))  # the faces of one edge
    first = F.col("f")[0]
    cosines = F.transform(F.slice("f", 2, F.size("f")), lambda o: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), first["nx"] * o["nx"] + first["ny"] * o["ny"] + first["nz"] * o["nz"])))
    e = sides.select("lo", "hi", (F.size("f") == 1).alias("rim"), F.when(F.size("f") == 1, 180.0).otherwise(F.degrees(F.acos(F.array_min(cosines)))).alias("dihedral"))
    fade = lambda: smoothstep((F.col("dihedral") - soft_deg) / max(hard_deg - soft_deg, 1e-6))
    e = cut(e.withColumn("weight", F.when(F.col("rim"), 0.0).otherwise(1 - fade() * (1 - least_weight))))
    ends = e.select(F.explode(F.array("lo", "hi")).alias("vid"), "dihedral", "rim")
    v = vertices.select("vid").join(ends.groupBy("vid").agg(F.max("dihedral").alias("dihedral"), F.bool_or("rim").alias("rim")), "vid", "left").fillna({"dihedral": 0.0, "rim": False})
    both = e.select(F.col("lo").alias("vid"), F.col("hi").alias("o")).unionByName(e.select(F.col("hi").alias("vid"), F.col("lo").alias("o")))
    ring = both.join(open_.withColumnRenamed("vid", "o"), "o", "left_semi").select("vid").distinct().withColumn("ring", F.lit(True))
    strength = 1 - fade() * (1 - least_strength)
    v = v.join(ring, "vid", "left").withColumn("strength", F.when(F.col("rim"), 0.0).when(F.col("ring"), F.least(strength, F.lit(ring_strength))).otherwise(strength))
    return e.select("lo", "hi", "dihedral", "weight", "rim"), v.select("vid", "dihedral", "strength", "rim")
