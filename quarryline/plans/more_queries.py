"""Further queries over the star-schema tables: sources and sinks, scalars, meshes, surfaces and graphs, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import geometry, scalar
from ..operators import consensus, fitting, fusion, joins, mesh, surface, views
from ..operators.graph import cut, keep_touching
from ..sources import captures, files
from .queries import AXES, D2, EDGES, FACES, SIDES, SQL, C, _NRM, cloud, query, r, read, strip


def folder(spark, name: str) -> str:
    """A new place in the shared folder for what a query writes and reads again."""
    cut(spark.range(1))  # names the checkpoint folder where none is set
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


# --- sources and sinks


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def flat_csv_round_trip(spark, sf):
    path = folder(spark, "csv")
    files.write_flat_csv(read(spark, sf, "customer"), path, ["c_custkey", "c_name", "c_nationkey", "c_acctbal"])
    kinds = dict(read(spark, sf, "customer").dtypes)
    return files.read_csv(spark, path, ", ".join(f"{c} {kinds[c]}" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal")))


@query("SELECT n_nationkey, n_name, n_regionkey, CAST(-1 AS INT) AS quality FROM nation")
def json_round_trip(spark, sf):
    path = folder(spark, "json")
    n = read(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    n.write.json(path)
    kinds = dict(n.dtypes)
    schema = ", ".join(f"{c} {k}" for c, k in kinds.items())
    return files.with_defaults(spark.read.schema(schema).json(path), f"{schema}, quality int", {"quality": -1})


@query("SELECT DISTINCT 'S' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS session FROM supplier WHERE s_acctbal > 0")
def session_names(spark, sf):
    name = F.concat(F.lit("S"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0"))
    place = F.when(F.col("s_acctbal") <= 0, F.lit("/data/notes/x.txt")).otherwise(F.concat(F.lit("/data/obj/"), name, F.lit("/left/a_V001_A000.png")))
    return files.sessions(read(spark, sf, "supplier").select(place.alias("path")))


@query("SELECT c_custkey, coalesce(n, 0) AS n, coalesce(total, -1.0) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def optional_defaults(spark, sf):
    more = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("total"))
    return joins.optional(read(spark, sf, "customer").select("c_custkey"), more, ["c_custkey"], {"n": 0, "total": -1.0})


@query("SELECT l_orderkey, CAST(sum(CAST(l_tax > 0 AS INT)) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def finite_only(spark, sf):
    rows = read(spark, sf, "lineitem").withColumn("x", F.when(F.col("l_tax") > 0, F.col("l_tax")).when(F.col("l_linenumber") % 2 == 0, F.lit(float("nan"))).when(F.col("l_linenumber") % 3 == 0, F.lit(float("inf"))))
    return rows.groupBy("l_orderkey").agg(F.count_if(scalar.is_finite("x")).alias("n"))


# --- scalars and geometry


@query("SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - 24.5)/50, 6) AS un, round((l_linenumber - 3.5)/8, 6) AS vn, round(2.0*(l_quantity - 24.5)/50 - 3.0*(l_linenumber - 3.5)/8 + 7.5, 6) AS predicted FROM lineitem")
def pixel_plane(spark, sf):
    un, vn = scalar.centred_pixel("l_quantity", "l_linenumber", 50, 8)
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r(un).alias("un"), r(vn).alias("vn"), r(scalar.affine((2.0, -3.0, 7.5), un, vn)).alias("predicted"))


@query(f"SELECT vec_id, round(sqrt(pow((y-0.2)*0.8 - (z-0.3)*0.6, 2) + pow((x-0.1)*0.8, 2) + pow((x-0.1)*0.6, 2)), 6) AS distance FROM {C}")
def line_distance(spark, sf):
    return cloud(spark, sf).select("vec_id", r(geometry.point_to_line(AXES, (0.1, 0.2, 0.3), (0.0, 0.6, 0.8))).alias("distance"))


@query("""SELECT s_suppkey, '{"file": "local_path_omitted/' || s_name || '.ply", "n": ' || CAST(s_suppkey AS VARCHAR) || ', "note": "' || s_name || '"}' AS text FROM supplier""")
def portable_manifest(spark, sf):
    text = F.concat(F.when(F.col("s_suppkey") % 2 == 0, F.lit('{"file": "/home/a/b/')).otherwise(F.lit('{"file": "C:\\\\data\\\\')), "s_name", F.lit('.ply", "n": '), F.col("s_suppkey").cast("string"), F.lit(', "note": "'), "s_name", F.lit('"}'))
    return read(spark, sf, "supplier").select("s_suppkey", scalar.portable_paths(text).alias("text"))


@query("""SELECT o_orderkey, round(coalesce(least(greatest(CASE o_orderstatus WHEN 'O' THEN 1.0 WHEN 'F' THEN 0.82 ELSE 0.5 END * (0.5 + (o_custkey % 7)/10.0) * greatest(exp(-2*(o_orderkey % 9)/10.0), 0.55), 0.35), 1.0), 1.0), 6) AS weight FROM orders""")
def pose_quality(spark, sf):
    mode = F.when(F.col("o_orderstatus") == "O", "accepted").when(F.col("o_orderstatus") == "F", "warning").otherwise("rejected")
    return read(spark, sf, "orders").select("o_orderkey", r(scalar.consensus_weight(mode, 0.5 + (F.col("o_custkey") % 7) / 10.0, (F.col("o_orderkey") % 9) / 10.0)).alias("weight"))


@query(f"SELECT vec_id, round(x - 0.1, 6) AS x, round(z - 0.3, 6) AS y, round(0.2 - y, 6) AS z FROM {C}")
def canonical_frame(spark, sf):
    pose = geometry.poses_table(spark, {0: geometry.frame_with_axis((0.0, 0.0, 2.0), (0.1, 0.2, 0.3))})
    rows = cloud(spark, sf).select("vec_id", F.lit(0).alias("pose_index"), *AXES)
    return geometry.transform(rows, pose).select("vec_id", *[r(a).alias(a) for a in AXES])


# --- meshes

_RIM = f"(SELECT fid, count(*) AS rim FROM {SIDES} JOIN {EDGES} ON lo = least(p, q) AND hi = greatest(p, q) WHERE faces = 1 GROUP BY 1)"
_EVI = f"(SELECT f.fid, f.a, f.b, f.c, list_sort([a % 7 + 0.5, b % 7 + 0.5, c % 7 + 0.5])[2]::DOUBLE AS evidence, sqrt(nx*nx+ny*ny+nz*nz)/2 AS area, coalesce(rim, 0) AS rim FROM {FACES} f JOIN (SELECT fid, nx, ny, nz FROM {_NRM}) USING (fid) LEFT JOIN {_RIM} USING (fid))"
_NEAR = f"s AS (SELECT DISTINCT fid, least(p, q) AS lo, greatest(p, q) AS hi FROM {SIDES}), n AS (SELECT a.fid AS u, b.fid AS v FROM s a JOIN s b USING (lo, hi) WHERE a.fid <> b.fid), w(f, r) AS (SELECT fid, fid FROM {FACES} UNION SELECT w.f, n.v FROM w JOIN n ON n.u = w.r), k AS (SELECT f AS fid, min(r) AS component FROM w GROUP BY 1)"


def evidence(v):
    return v.select("vid", (F.col("vid") % 7 + 0.5).cast("double").alias("evidence"))


@query(f"WITH e AS {_EVI}, m AS (SELECT quantile_cont(area, 0.5) AS m FROM e) SELECT fid, round(1.0 + 2.0*evidence + least(area/greatest(m, 1e-12), 4.0) - 0.25*rim, 5) AS cost FROM e, m")
def orientation_costs(spark, sf):
    f, v = strip(spark, sf)
    return mesh.orientation_cost(mesh.face_evidence(f, v, evidence(v))).withColumn("cost", r("cost", 5))


@query(f"WITH RECURSIVE {_NEAR}, g AS (SELECT component, count(*) AS n, avg(evidence) AS e FROM k JOIN {_EVI} USING (fid) GROUP BY 1) SELECT fid, a, b, c FROM {FACES} JOIN k USING (fid) JOIN g USING (component) WHERE NOT (n < 4 AND e < 4.0)")
def strong_components(spark, sf):
    f, v = strip(spark, sf)
    return mesh.drop_weak_components(f, v, evidence(v), 4, 4.0).select("fid", "a", "b", "c")


_LAP = f"""(WITH b AS (SELECT lo AS v, hi AS o FROM {EDGES} UNION ALL SELECT hi, lo FROM {EDGES}), d AS (SELECT v, t.x-s.x AS x, t.y-s.y AS y, t.z-s.z AS z FROM b JOIN {C} s ON s.vec_id = v JOIN {C} t ON t.vec_id = o), w AS (SELECT *, 1/greatest(sqrt(x*x+y*y+z*z), 1e-12) AS w FROM d)
SELECT v AS vid, sum(w*x)/sum(w) AS lx, sum(w*y)/sum(w) AS ly, sum(w*z)/sum(w) AS lz FROM w GROUP BY 1)"""


@query(f"""WITH m AS (SELECT vec_id AS vid, x, y, z, 0.5*coalesce(lx, 0) AS lx, 0.5*coalesce(ly, 0) AS ly, 0.5*coalesce(lz, 0) AS lz FROM {C} LEFT JOIN {_LAP} ON vid = vec_id), s AS (SELECT *, least(1.0, 0.05/greatest(sqrt(lx*lx+ly*ly+lz*lz), 1e-12)) AS k FROM m),
t AS (SELECT *, least(1.0, 0.03/greatest(sqrt(lx*lx+ly*ly+lz*lz)*k, 1e-12)) AS j FROM s) SELECT vid, round(x + lx*k*j, 5) AS x, round(y + ly*k*j, 5) AS y, round(z + lz*k*j, 5) AS z FROM t""")
def smoothing_step(spark, sf):
    f, v = strip(spark, sf)
    return mesh.limited_step(f, v, v, 0.5, 0.05, 0.03).select("vid", *[r(a, 5).alias(a) for a in AXES])


_UNIT = f"(SELECT fid, s/2 AS area, nx/s AS x, ny/s AS y, nz/s AS z FROM (SELECT fid, nx, ny, nz, sqrt(nx*nx+ny*ny+nz*nz) AS s FROM {_NRM}))"
_PAIR = f"(SELECT a.fid AS u, b.fid AS v, CAST(a.p = b.p AS INT) AS flip FROM {SIDES} a JOIN {SIDES} b ON least(a.p, a.q) = least(b.p, b.q) AND greatest(a.p, a.q) = greatest(b.p, b.q) AND a.fid < b.fid JOIN {EDGES} ON lo = least(a.p, a.q) AND hi = greatest(a.p, a.q) AND faces = 2)"


@query(f"""WITH g AS {_UNIT}, p AS {_PAIR}, b AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p), n AS (SELECT b.u, o.area * exp(-0.5*pow(acos(least(greatest(i.x*o.x+i.y*o.y+i.z*o.z, -1.0), 1.0))/radians(25.0), 2)) AS w, o.x, o.y, o.z FROM b JOIN g i ON i.fid = b.u JOIN g o ON o.fid = b.v),
s AS (SELECT u, sum(w*x) AS x, sum(w*y) AS y, sum(w*z) AS z FROM n GROUP BY 1), m AS (SELECT fid, area*g.x + coalesce(s.x, 0) AS x, area*g.y + coalesce(s.y, 0) AS y, area*g.z + coalesce(s.z, 0) AS z FROM g LEFT JOIN s ON u = fid)
SELECT fid, round(x/sqrt(x*x+y*y+z*z), 4) AS nx, round(y/sqrt(x*x+y*y+z*z), 4) AS ny, round(z/sqrt(x*x+y*y+z*z), 4) AS nz FROM m""")
def smooth_face_normals(spark, sf):
    return mesh.smooth_normals(*strip(spark, sf), rounds=1).select("fid", *[r(c, 4).alias(c) for c in ("nx", "ny", "nz")])


_DIH = f"""(WITH g AS {_UNIT}, o AS (SELECT fid, least(p, q) AS lo, greatest(p, q) AS hi, min(fid) OVER (PARTITION BY least(p, q), greatest(p, q)) AS k FROM {SIDES}), d AS (SELECT lo, hi, count(*) AS n, max(CASE WHEN o.fid <> k THEN degrees(acos(greatest(-1.0, least(1.0, i.x*j.x+i.y*j.y+i.z*j.z)))) END) AS t FROM o JOIN g i ON i.fid = o.fid JOIN g j ON j.fid = o.k GROUP BY 1, 2)
SELECT lo, hi, n = 1 AS rim, CASE WHEN n = 1 THEN 180.0 ELSE t END AS dihedral, least(greatest((CASE WHEN n = 1 THEN 180.0 ELSE t END - 22.0)/20.0, 0.0), 1.0) AS s FROM d)"""


@query(f"SELECT lo, hi, rim, round(dihedral, 3) AS dihedral, round(CASE WHEN rim THEN 0.0 ELSE 1 - s*s*(3 - 2*s)*0.92 END, 4) AS weight FROM {_DIH}")
def feature_edges(spark, sf):
    return mesh.edge_structure(*strip(spark, sf))[0].select("lo", "hi", "rim", r("dihedral", 3).alias("dihedral"), r("weight", 4).alias("weight"))


@query(f"SELECT f.fid, a, b, c FROM {FACES} f LEFT JOIN {_RIM} USING (fid) WHERE rim IS NULL OR NOT (a % 11 = 0 OR b % 11 = 0 OR c % 11 = 0)")
def rim_retraction(spark, sf):
    f, v = strip(spark, sf)
    return mesh.retract_rim(f, v.where("vid % 11 = 0").select("vid"), 1).select("fid", "a", "b", "c")


@query(f"SELECT f.fid, f.fid % 4 = 0 OR f.fid % 6 = 0 AS inferred FROM {FACES} f")
def inferred_faces(spark, sf):
    f, v = strip(spark, sf)
    keys = mesh.face_key(f, v.withColumns({"x": F.col("vid").cast("double"), "y": F.lit(0.0), "z": F.lit(0.0)}))
    return mesh.inherit_flags(keys, keys.where("fid % 4 <> 0"), keys.where("fid % 6 = 0"))


@query(f"WITH v AS (SELECT vec_id, round(x, 1) AS x, round(y, 1) AS y FROM {C}), m AS (SELECT vec_id, min(vec_id) OVER (PARTITION BY x, y) AS k FROM v), f AS (SELECT fid, a.k AS a, b.k AS b, c.k AS c FROM {FACES} f JOIN m a ON a.vec_id = f.a JOIN m b ON b.vec_id = f.b JOIN m c ON c.vec_id = f.c), g AS (SELECT *, row_number() OVER (PARTITION BY list_sort([a, b, c]) ORDER BY fid) AS i FROM f WHERE a <> b AND b <> c AND a <> c) SELECT fid, a, b, c FROM g WHERE i = 1")
def merged_mesh(spark, sf):
    f, v = strip(spark, sf)
    return mesh.clean(f, v.select("vid", F.round("x", 1).alias("x"), F.round("y", 1).alias("y"), F.lit(0.0).alias("z")))[0].select("fid", "a", "b", "c")


# --- surfaces, regions and selection


@query("""WITH b AS (SELECT least(l_suppkey % 8, l_partkey % 8) AS a, greatest(l_suppkey % 8, l_partkey % 8) AS b, l_quantity AS j, l_discount * 100 AS g FROM lineitem WHERE l_suppkey % 8 <> l_partkey % 8), p AS (SELECT a, b, quantile_cont(j, 0.5) AS jump, quantile_cont(g, 0.5) AS gradient FROM b GROUP BY 1, 2)
SELECT a, b, round(jump, 6) AS jump, round(gradient, 6) AS gradient, CASE WHEN jump > 25 AND gradient < 5.5 THEN CASE WHEN a*3 % 8 < b*3 % 8 THEN a ELSE b END END AS blocked FROM p""")
def blocked_pairs(spark, sf):
    s, p = F.col("l_suppkey") % 8, F.col("l_partkey") % 8
    rows = read(spark, sf, "lineitem").where(s != p).select(F.least(s, p).alias("a"), F.greatest(s, p).alias("b"), F.col("l_quantity").alias("jump"), (F.col("l_discount") * 100).alias("gradient"))
    rows = rows.withColumns({"quality_a": F.col("a") * 3 % 8, "quality_b": F.col("b") * 3 % 8})
    return surface.inconsistent_pairs(rows, 25.0, 5.5).select("a", "b", r("jump").alias("jump"), r("gradient").alias("gradient"), "blocked")


@query("""WITH m AS (SELECT o_custkey % 6 AS region, o_orderkey AS u, o_custkey AS v FROM orders), k AS (SELECT c AS other, 1e-3*c AS a, 2e-3 AS b, CAST(c AS DOUBLE) AS c FROM (SELECT unnest(range(0, 6)) AS c)), l AS (SELECT r AS region, (r + d) % 6 AS other FROM (SELECT unnest(range(0, 6)) AS r), (SELECT unnest([1, 2, 3]) AS d)),
d AS (SELECT m.region, u, v, a*u + b*v + c AS d FROM m JOIN l USING (region) JOIN k USING (other)) SELECT region, u, v, round(quantile_cont(d, 0.5), 5) AS disparity FROM d GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND max(d) - min(d) <= 40""")
def gap_fill(spark, sf):
    missing = read(spark, sf, "orders").select((F.col("o_custkey") % 6).alias("region"), F.col("o_orderkey").alias("u"), F.col("o_custkey").alias("v"))
    models = spark.range(6).select(F.col("id").alias("region"), (0.001 * F.col("id")).alias("a"), F.lit(0.002).alias("b"), (1.0 * F.col("id")).alias("c"))
    links = spark.range(6).select(F.col("id").alias("region"), F.explode(F.array(*[(F.col("id") + d) % 6 for d in (1, 2, 3)])).alias("other"))
    return surface.fill_from_neighbors(missing, models, links, spread=40.0).withColumn("disparity", r("disparity", 5))


@query("""WITH t AS (SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS "F", count(*) FILTER (l_linestatus = 'O') AS "O", count(*) AS n, quantile_cont(l_quantity, 0.5) AS median, round(avg(l_quantity), 4) AS mean FROM lineitem GROUP BY 1)
SELECT l_returnflag, CASE WHEN "F" > 0 THEN "F" END AS "F", CASE WHEN "O" > 0 THEN "O" END AS "O", n, median, mean FROM t""")
def region_counts(spark, sf):
    t = surface.region_report(read(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity")
    return t.select("l_returnflag", "F", "O", "n", "median", r("mean", 4).alias("mean"))


_DIF = "(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity - 25 AS dl, l_discount*100 - 5 AS da, l_tax*100 - 4 AS db, l_extendedprice/10000 - 4 AS dgrad FROM lineitem)"
_SCL = f"""(WITH t AS (SELECT * FROM {_DIF} WHERE l_linenumber <= 3), m AS (SELECT quantile_cont(dl, 0.5) AS l, quantile_cont(da, 0.5) AS a, quantile_cont(db, 0.5) AS b, quantile_cont(dgrad, 0.5) AS g FROM t)
SELECT greatest(1.0, 1.4826*quantile_cont(abs(dl - l), 0.5)) AS dl, greatest(1.0, 1.4826*quantile_cont(abs(da - a), 0.5)) AS da, greatest(1.0, 1.4826*quantile_cont(abs(db - b), 0.5)) AS db, greatest(0.5, 1.4826*quantile_cont(abs(dgrad - g), 0.5)) AS dgrad FROM t, m)"""


def differences(spark, sf):
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") - 25).alias("dl"), (F.col("l_discount") * 100 - 5).alias("da"), (F.col("l_tax") * 100 - 4).alias("db"), (F.col("l_extendedprice") / 10000 - 4).alias("dgrad"))


def scales(spark, sf):
    return surface.noise_scales(differences(spark, sf), {"dl": 1.0, "da": 1.0, "db": 1.0, "dgrad": 0.5}, "l_linenumber <= 3")


@query(f"SELECT round(dl, 6) AS dl, round(da, 6) AS da, round(db, 6) AS db, round(dgrad, 6) AS dgrad FROM {_SCL}")
def noise_floors(spark, sf):
    return scales(spark, sf).select(*[r(c).alias(c) for c in ("dl", "da", "db", "dgrad")])


@query(f"""WITH d AS {_DIF}, z AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, d.dl AS raw, abs(d.dl)/s.dl AS zl, sqrt(pow(d.da/s.da, 2) + pow(d.db/s.db, 2)) AS c, abs(d.dgrad)/s.dgrad AS g FROM d, {_SCL} s)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(1.05*c + 0.42*zl + 0.52*g, 5) AS score, raw < 0 AND c < 1.5 AND g < 1.5 AS shadow FROM z""")
def visual_scores(spark, sf):
    return surface.visual_evidence(differences(spark, sf), scales(spark, sf)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r("score", 5).alias("score"), "shadow")


@query(f"""WITH e AS (SELECT vec_id, x, y, z, (vec_id*7 % 100)/100.0 AS c, 1 + vec_id % 4 AS s FROM {C}), t AS (SELECT unnest([0.2, 0.4, 0.6, 0.8]) AS t), h AS (SELECT t, avg(CAST(c >= t AS INT)) AS share FROM e, t WHERE s >= 2 GROUP BY 1), k AS (SELECT coalesce(max(t) FILTER (share >= 0.6), 0.2) AS k FROM h),
a AS (SELECT e.* FROM e, k WHERE s >= 2 AND c >= k) SELECT vec_id, CAST(CASE WHEN s < 2 THEN 0 WHEN c >= k THEN 3 WHEN EXISTS (SELECT 1 FROM a b WHERE sqrt({D2.replace('a.', 'e.')}) <= 0.1) THEN 2 ELSE 1 END AS INT) AS class FROM e, k""")
def hierarchy_classes(spark, sf):
    e = cloud(spark, sf).withColumns({"c": (F.col("vec_id") * 7 % 100) / 100.0, "s": 1 + F.col("vec_id") % 4})
    return surface.hierarchical_selection(e, [0.2, 0.4, 0.6, 0.8], "c", "s", 0.1, id_="vec_id").select("vec_id", "class")


@query(f"""WITH RECURSIVE n AS (SELECT a.vec_id AS u, b.vec_id AS v FROM {C} a JOIN {C} b ON {D2} <= 0.0036), core AS (SELECT u FROM n GROUP BY 1 HAVING count(*) >= 4), ce AS (SELECT n.u, n.v FROM n JOIN core x ON x.u = n.u JOIN core y ON y.u = n.v), w(i, r) AS (SELECT u, u FROM core UNION SELECT w.i, ce.v FROM w JOIN ce ON ce.u = w.r), k AS (SELECT i, min(r) AS k FROM w GROUP BY 1),
b AS (SELECT n.u, min(n.v) AS v FROM n JOIN core ON core.u = n.v WHERE n.u NOT IN (SELECT u FROM core) GROUP BY 1) SELECT vec_id, coalesce(k.k, q.k) AS cluster FROM embeddings LEFT JOIN k ON k.i = vec_id LEFT JOIN b ON b.u = vec_id LEFT JOIN k q ON q.i = b.v""")
def density_clusters(spark, sf):
    return surface.clusters(cloud(spark, sf), 0.06, 4, id_="vec_id").select("vec_id", "cluster")


_SIX = "(SELECT vec_id AS id, CAST(vec_id % 25 AS INT) AS pose, " + ", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS c{i}" for i in range(1, 7)) + " FROM embeddings)"


def _seen(first: int) -> str:
    off = "+".join(f"(a.c{i}-b.c{i})*(a.c{i}-b.c{i})" for i in range(first, first + 3))
    return f"(SELECT a.id, count(DISTINCT b.pose) AS n FROM e a JOIN e b ON {off} <= 0.01 AND least(abs(a.pose-b.pose), 25-abs(a.pose-b.pose)) BETWEEN 1 AND 3 GROUP BY 1)"


@query(f"""WITH e AS {_SIX}, t AS (SELECT e.id, pose, coalesce(s.n, 0) - coalesce(m.n, 0) AS x FROM e LEFT JOIN {_seen(1)} s ON s.id = e.id LEFT JOIN {_seen(4)} m ON m.id = e.id), i AS (SELECT *, row_number() OVER (PARTITION BY pose, x > 0 ORDER BY x DESC, id) AS i, count(*) OVER (PARTITION BY pose) AS n FROM t) SELECT id FROM i WHERE x <= 0 OR i > floor(0.2*n)""")
def static_points(spark, sf):
    e = read(spark, sf, "embeddings")
    at = lambda i: F.element_at("embedding", i).cast("double")
    pts = e.select(F.col("vec_id").alias("id"), F.expr("cast(vec_id % 25 as int)").alias("pose"), *[at(i + 1).alias(c) for i, c in enumerate(("cx", "cy", "cz"))], *[at(i + 4).alias(a) for i, a in enumerate(AXES)])
    return surface.static_hypothesis(pts, 25, 3, 0.1, 0.2).select("id")


@query("""WITH f AS (SELECT l_partkey, l_linenumber % 3 AS s, max(l_quantity) > 30 AS f FROM lineitem GROUP BY 1, 2), d AS (SELECT l_partkey FROM f GROUP BY 1 HAVING sum(CAST(f AS INT)) >= 2) SELECT l_partkey FROM d WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_tax >= 0.08)""")
def interior_domain(spark, sf):
    o = read(spark, sf, "lineitem").groupBy("l_partkey", (F.col("l_linenumber") % 3).alias("s")).agg((F.max("l_quantity") > 30).alias("f"))
    return joins.rows_not_in(consensus.majority(o, ["l_partkey"], "f", 3), read(spark, sf, "lineitem").where("l_tax >= 0.08"), ["l_partkey"])


@query(f"""WITH h AS (SELECT a.vec_id, abs(b.z - a.z) AS h, exp(-0.5*{D2}/0.0036)*exp(-0.5*pow((b.z - a.z)/0.03, 2))*(1 + b.vec_id % 3) AS w FROM {C} a JOIN {C} b ON a.vec_id <> b.vec_id AND {D2} <= 0.0144), g AS (SELECT vec_id, h, sum(w) AS w FROM h WHERE w > 0 GROUP BY 1, 2),
c AS (SELECT *, sum(w) OVER (PARTITION BY vec_id ORDER BY h ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY vec_id) AS t FROM g), m AS (SELECT vec_id, min(h) FILTER (round(c, 9) >= round(0.5*t, 9)) AS m FROM c GROUP BY 1) SELECT e.vec_id, round(m, 6) AS residual FROM embeddings e LEFT JOIN m USING (vec_id)""")
def local_residuals(spark, sf):
    c = cloud(spark, sf).withColumns({"nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.lit(1.0), "w": (1 + F.col("vec_id") % 3).cast("double")})
    return surface.local_residual(c, 0.12, "w", id_="vec_id").select("vec_id", r("residual").alias("residual"))


_CELL = "(SELECT CAST(l_quantity AS INT) AS u, CAST(round(l_discount*100) AS INT) AS v, max(l_extendedprice)/1000 AS d, max(1 - l_tax) AS c, CAST(min(l_suppkey) % 6 AS INT) AS s FROM lineitem GROUP BY 1, 2)"


@query(f"""WITH p AS {_CELL}, o AS (SELECT a.u, a.v, sum(b.c) AS w, sum(b.c*b.d) AS d, sum(b.c*b.d*b.d) AS q, count(*) AS n FROM p a JOIN p b ON abs(a.u-b.u) <= 2 AND abs(a.v-b.v) <= 2 AND NOT (a.u = b.u AND a.v = b.v) AND b.s IN (1, 2, 3) GROUP BY 1, 2)
SELECT p.u, p.v, s IN (1, 2, 3) AS eligible, round(CASE WHEN n >= 8 THEN o.d/w END, 4) AS local_mean, round(CASE WHEN n >= 8 THEN sqrt(greatest(q/w - (o.d/w)*(o.d/w), 0)) END, 3) AS local_scale FROM p LEFT JOIN o USING (u, v)""")
def local_box_statistics(spark, sf):
    p = read(spark, sf, "lineitem").groupBy(F.col("l_quantity").cast("int").alias("u"), F.round(F.col("l_discount") * 100).cast("int").alias("v")).agg((F.max("l_extendedprice") / 1000).alias("disparity"), F.max(1 - F.col("l_tax")).alias("confidence"), F.expr("cast(min(l_suppkey) % 6 as int)").alias("state"))
    rules = views.Rules(window=5)
    seen = views.observations(p.withColumns({"view": F.lit(0), "inside": F.lit(True), "usable": F.lit(True)}), rules)
    return views.local_statistics(seen, rules).select("u", "v", "eligible", r("local_mean", 4).alias("local_mean"), r("local_scale", 3).alias("local_scale"))


# --- fusion, verdicts and hysteresis


@query("""WITH m AS (SELECT l_partkey AS seed, l_linenumber AS pose, l_quantity AS h FROM lineitem), g AS (SELECT *, sum(s) OVER (PARTITION BY seed ORDER BY h, pose) AS layer FROM (SELECT *, CASE WHEN h - lag(h) OVER (PARTITION BY seed ORDER BY h, pose) > 2 THEN 1 ELSE 0 END AS s FROM m)),
p AS (SELECT seed, layer, pose, avg(h) AS h FROM g GROUP BY 1, 2, 3) SELECT seed, CAST(layer AS BIGINT) AS layer, round(avg(h), 6) AS height, count(*) AS poses FROM p GROUP BY 1, 2""")
def layer_votes(spark, sf):
    m = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("seed"), F.col("l_linenumber").alias("pose"), F.col("l_quantity").alias("height"))
    return fusion.resolve_layers(m, 2.0).select("seed", "layer", r("height").alias("height"), "poses")


@query("""WITH r AS (SELECT l_suppkey AS cell, l_linenumber AS pose, l_quantity - 25 AS r FROM lineitem), s AS (SELECT cell FROM r GROUP BY 1 HAVING count(DISTINCT pose) > 1), u AS (SELECT r.* FROM r JOIN s USING (cell)), k AS (SELECT pose FROM u GROUP BY 1 HAVING count(*) >= 3), t AS (SELECT u.* FROM u JOIN k USING (pose)),
g AS (SELECT cell, quantile_cont(-r, 0.5) AS g FROM t GROUP BY 1), b AS (SELECT pose, quantile_cont(r + g, 0.5) AS b, count(DISTINCT cell) AS cells FROM t JOIN g USING (cell) GROUP BY 1) SELECT pose, round(b - (SELECT quantile_cont(b, 0.5) FROM b), 6) AS bias, cells FROM b""")
def pose_bias_round(spark, sf):
    rows = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("cell"), F.col("l_linenumber").alias("pose"), (F.col("l_quantity") - 25).alias("r"))
    return fusion.pose_biases(rows, rounds=1).withColumn("bias", r("bias"))


@query("""WITH t AS (SELECT l_linenumber AS view, count(*) AS inside, count(CASE WHEN l_tax > 0.02 THEN 1 END) AS valid, count(CASE WHEN l_suppkey % 10 = 2 THEN 1 END) AS source_2, quantile_cont(CASE WHEN l_tax > 0.02 THEN l_extendedprice END, 0.5) AS m FROM lineitem GROUP BY 1)
SELECT view, inside, valid, source_2, round(m, 6) AS median_depth, round(valid/inside, 6) AS share, CASE WHEN m IS NULL THEN 'rejected' WHEN valid/inside < 0.2 OR valid/inside > 0.98 THEN 'warning' ELSE 'accepted' END AS verdict FROM t""")
def view_verdicts(spark, sf):
    rows = read(spark, sf, "lineitem").select(F.col("l_linenumber").alias("view"), (F.col("l_suppkey") % 10).alias("source"), F.when(F.col("l_tax") > 0.02, F.col("l_extendedprice")).alias("depth"))
    return views.view_report(rows).select("view", "inside", "valid", "source_2", r("median_depth").alias("median_depth"), r("share").alias("share"), "verdict")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 7 >= 3 AND s_suppkey % 5 <= 1 AND s_suppkey % 2 = 0 THEN 3 WHEN s_suppkey % 7 >= 3 AND s_acctbal > 3000 AND s_nationkey > 8 THEN 2 ELSE 0 END AS class FROM supplier")
def evidence_classes(spark, sf):
    k = F.col("s_suppkey")
    s = read(spark, sf, "supplier").withColumns({"heldout_ok": k % 3 == 0, "diversity": k % 7, "conflict_ratio": (k % 5) * 0.3, "layer_ok": k % 2 == 0, "poses": k % 7, "confidence": F.when(F.col("s_acctbal") > 3000, 0.9).otherwise(0.1), "agreement": F.when(F.col("s_nationkey") > 8, 0.9).otherwise(0.1)})
    return s.select("s_suppkey", surface.evidence_class(s).alias("class"))


@query("""WITH RECURSIVE c AS (SELECT c_custkey AS k, c_acctbal > 9000 AS strong FROM customer WHERE c_mktsegment <> 'BUILDING'), e AS (SELECT a.k AS u, b.k AS v FROM c a JOIN c b ON abs(a.k - b.k) = 1), w(i, r) AS (SELECT k, k FROM c UNION SELECT w.i, e.v FROM w JOIN e ON e.u = w.r) SELECT DISTINCT i AS c_custkey FROM w JOIN c ON c.k = w.r WHERE c.strong""")
def touching_weak(spark, sf):
    c = read(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'").select("c_custkey", "c_acctbal")
    weak = c.select("c_custkey")
    e = weak.select(F.col("c_custkey").alias("u"), (F.col("c_custkey") + 1).alias("v")).join(weak.withColumnRenamed("c_custkey", "v"), "v", "left_semi")
    return keep_touching(weak, e, c.where("c_acctbal > 9000").select("c_custkey"), "c_custkey")


@query("SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderpriority LIKE '1%' THEN 'rejected' WHEN o_orderpriority LIKE '2%' THEN 'accepted' END AS session_quality, TRUE AS depth_enabled FROM orders")
def advisory_quality(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    verdicts = o.select("o_orderpriority").distinct().withColumn("verdict", F.when(F.col("o_orderpriority").startswith("1"), "rejected").when(F.col("o_orderpriority").startswith("2"), "accepted")).where("verdict is not null")
    return captures.finalized(o, verdicts, "o_orderpriority")


# --- fits whose answer is known

_FIT = "(SELECT DISTINCT l_returnflag, CAST(l_quantity AS DOUBLE) AS x, round(l_discount*100) AS y FROM lineitem)"


@query(f"SELECT l_returnflag, round(-0.5/sqrt(1.3125), 6) AS nx, round(-0.25/sqrt(1.3125), 6) AS ny, round(1/sqrt(1.3125), 6) AS nz, round(3/sqrt(1.3125), 6) AS d, CAST(sum(CAST(x <= 45 AS INT)) AS BIGINT) AS inliers FROM {_FIT} GROUP BY 1")
def ransac_known_plane(spark, sf):
    rows = read(spark, sf, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("x"), F.round(F.col("l_discount") * 100).alias("y")).distinct()
    rows = rows.withColumns({"z": 0.5 * F.col("x") + 0.25 * F.col("y") + 3 + F.when(F.col("x") > 45, 2 * F.col("x") + F.col("y") * F.col("y")).otherwise(0.0), "i": F.col("x") * 100 + F.col("y")})
    p = fitting.plane_per_group(rows, ["l_returnflag"], ("x", "y", "z"), "i", 0.01)
    return p.select("l_returnflag", *[r(c).alias(c) for c in ("nx", "ny", "nz", "d")], "inliers")


@query(f"SELECT l_returnflag, 0.5 AS a, -0.25 AS b, 2.0 AS c, 1.0 AS d, -3.0 AS e, 7.0 AS f, count(*) >= 6 AS enough FROM {_FIT} GROUP BY 1".replace("0.5 AS", "0.5::DOUBLE AS").replace("-0.25 AS", "-0.25::DOUBLE AS").replace("2.0 AS", "2.0::DOUBLE AS").replace("1.0 AS", "1.0::DOUBLE AS").replace("-3.0 AS", "-3.0::DOUBLE AS").replace("7.0 AS", "7.0::DOUBLE AS"))
def irls_known_quadratic(spark, sf):
    rows = read(spark, sf, "lineitem").select("l_returnflag", (F.col("l_quantity") / 50).cast("double").alias("u"), (F.round(F.col("l_discount") * 100) / 10).alias("v")).distinct()
    u, v = F.col("u"), F.col("v")
    rows = rows.withColumns({"y": 0.5 * u * u - 0.25 * v * v + 2 * u * v + u - 3 * v + 7, "i": u * 1000 + v})
    return fitting.quadratic_per_group(rows, ["l_returnflag"], "u", "v", "y", "i").select("l_returnflag", *[(r(c, 5) + 0.0).alias(c) for c in "abcdef"], (F.col("rmse") < 1e-6).alias("enough"))


# --- SQL for queries that had none

SQL["pose_diversity"] = """WITH m AS (SELECT event_type, CAST(bit_or(CAST(1 AS BIGINT) << CAST(user_id % 25 AS INT)) AS BIGINT) AS mask FROM events GROUP BY 1), s AS (SELECT event_type, mask, CAST(unnest(range(0, 25)) AS INT) AS s FROM m),
g AS (SELECT event_type, list_reduce(list_prepend([s], list_transform(range(0, 25), lambda k: [CAST((s + k) % 25 AS INT)])), lambda kept, p: CASE WHEN (mask >> p[1]) & 1 = 1 AND len(list_filter(kept, lambda q: least(abs(q - p[1]), 25 - abs(q - p[1])) < 2)) = 0 THEN list_concat(kept, p) ELSE kept END) AS kept FROM s WHERE (mask >> s) & 1 = 1)
SELECT event_type, CAST(max(len(kept)) AS INT) AS diversity FROM g GROUP BY 1"""
SQL["boundary_loops"] = f"""WITH RECURSIVE b AS (SELECT lo, hi FROM {EDGES} WHERE faces = 1), n AS (SELECT lo AS u, hi AS v FROM b UNION SELECT hi, lo FROM b), w(i, r) AS (SELECT DISTINCT u, u FROM n UNION SELECT w.i, n.v FROM w JOIN n ON n.u = w.r), k AS (SELECT i AS vid, min(r) AS component FROM w GROUP BY 1),
e AS (SELECT component, count(*) AS edges, sum(sqrt({D2})) AS perimeter FROM b q JOIN k ON vid = lo JOIN {C} a ON a.vec_id = lo JOIN {C} b ON b.vec_id = hi GROUP BY 1), d AS (SELECT vid, count(*) AS g FROM (SELECT unnest([lo, hi]) AS vid FROM b) GROUP BY 1), g AS (SELECT component, count(*) AS vertices, max(g) AS degree, min(g) AS least FROM d JOIN k USING (vid) GROUP BY 1)
SELECT component, vertices, edges, round(perimeter, 6) AS perimeter, degree, degree = 2 AND least = 2 AS closed FROM e JOIN g USING (component)"""
SQL["orientation_parity"] = f"""WITH RECURSIVE p AS {_PAIR}, b AS (SELECT u, v, flip FROM p UNION SELECT v, u, flip FROM p), w(f, r, s) AS (SELECT fid, fid, 0 FROM {FACES} UNION SELECT w.f, b.v, (w.s + b.flip) % 2 FROM w JOIN b ON b.u = w.r), m AS (SELECT f, min(r) AS k FROM w GROUP BY 1)
SELECT w.f AS fid, CAST(CASE WHEN count(DISTINCT s) = 1 THEN min(s) END AS INT) AS label, count(DISTINCT s) = 2 AS conflict FROM w JOIN m ON m.f = w.f AND w.r = k GROUP BY 1"""
SQL["pca_normals"] = f"""WITH n AS (SELECT a.vec_id, any_value(a.x) AS px, any_value(a.y) AS py, any_value(a.z) AS pz, count(*) AS neighbors, covar_pop(b.x, b.x) AS xx, covar_pop(b.x, b.y) AS xy, covar_pop(b.x, b.z) AS xz, covar_pop(b.y, b.y) AS yy, covar_pop(b.y, b.z) AS yz, covar_pop(b.z, b.z) AS zz FROM {C} a JOIN {C} b ON {D2} <= 0.0225 GROUP BY 1),
q AS (SELECT *, (xx+yy+zz)/3 AS q FROM n), p AS (SELECT *, sqrt((pow(xx-q, 2) + pow(yy-q, 2) + pow(zz-q, 2) + 2*(xy*xy+xz*xz+yz*yz))/6) AS p FROM q WHERE neighbors >= 4),
e AS (SELECT *, q + 2*p*cos(acos(greatest(-1.0, least(1.0, ((xx-q)*((yy-q)*(zz-q)-yz*yz) - xy*(xy*(zz-q)-yz*xz) + xz*(xy*yz-(yy-q)*xz))/(2*p*p*p))))/3 + 2*pi()/3) AS l FROM p),
c AS (SELECT vec_id, px, py, pz, unnest([[xy*yz-xz*(yy-l), xz*xy-(xx-l)*yz, (xx-l)*(yy-l)-xy*xy], [xy*(zz-l)-xz*yz, xz*xz-(xx-l)*(zz-l), (xx-l)*yz-xy*xz], [(yy-l)*(zz-l)-yz*yz, yz*xz-xy*(zz-l), xy*yz-(yy-l)*xz]]) AS v FROM e),
b AS (SELECT vec_id, px, py, pz, max({{'n': v[1]*v[1]+v[2]*v[2]+v[3]*v[3], 'v': v}}) AS b FROM c GROUP BY ALL), u AS (SELECT vec_id, b.v[1]/sqrt(b.n) AS x, b.v[2]/sqrt(b.n) AS y, b.v[3]/sqrt(b.n) AS z, CASE WHEN -(px*b.v[1]+py*b.v[2]+pz*b.v[3]) < 0 THEN -1.0 ELSE 1.0 END AS s FROM b)
SELECT n.vec_id, round(s*u.x, 4) + 0.0 AS nx, round(s*u.y, 4) + 0.0 AS ny, round(s*u.z, 4) + 0.0 AS nz, neighbors FROM n LEFT JOIN u USING (vec_id)"""
