"""Queries of spanning forests, ordered loops, boxes, running campaigns and readiness."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import boxes, graph, heldout
from ..streaming import campaigns
from .queries import AXES, query, r, read

# --- graphs

_TRADE = "(SELECT least(c_nationkey, s_nationkey) AS u, greatest(c_nationkey, s_nationkey) AS v, min(l_extendedprice) AS w FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2)"


@query(f"""WITH RECURSIVE e AS (SELECT u, v, w, row_number() OVER (ORDER BY w, u, v) AS k FROM {_TRADE}), b AS (SELECT u AS p, v AS q, k FROM e UNION ALL SELECT v, u, k FROM e),
x(k, n) AS (SELECT k, u FROM e UNION SELECT x.k, b.q FROM x JOIN b ON b.p = x.n AND b.k < x.k) SELECT u, v, round(w, 2) AS w FROM e WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.k = e.k AND x.n = e.v)""")
def nation_forest(spark, sf):
    """The least spanning forest of nations that trade with each other: an edge stays if no path of lesser ones joins its ends."""
    trade = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey"), "l_extendedprice")
    trade = trade.join(read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), "o_orderkey").join(read(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey").join(read(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey")
    edges = trade.groupBy(F.col("c_nationkey").alias("u"), F.col("s_nationkey").alias("v")).agg(F.min("l_extendedprice").alias("w"))
    return graph.spanning_forest(edges).select("u", "v", r("w", 2).alias("w"))


@query("SELECT min(c_custkey) OVER (PARTITION BY c_nationkey) AS component, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS place, count(*) OVER (PARTITION BY c_nationkey) AS size, c_custkey AS node FROM customer")
def loop_order(spark, sf):
    """Customers of a nation as a closed loop of steps, and each one's place on it."""
    nation = Window.partitionBy("c_nationkey")
    c = read(spark, sf, "customer").select("c_custkey", "c_nationkey")
    steps = c.select(F.col("c_custkey").alias("p"), F.coalesce(F.lead("c_custkey").over(nation.orderBy("c_custkey")), F.min("c_custkey").over(nation)).alias("q"))
    return graph.loop_places(steps).select("component", F.col("place").cast("long").alias("place"), "size", "node")


# --- boxes of mixed sizes

_BOX = "(SELECT vec_id, " + ", ".join(f"least(CAST(embedding[{i}] AS DOUBLE), CAST(embedding[{i}] + embedding[{i + 3}] / 4 AS DOUBLE)) AS lo{x}, greatest(CAST(embedding[{i}] AS DOUBLE), CAST(embedding[{i}] + embedding[{i + 3}] / 4 AS DOUBLE)) AS hi{x}" for i, x in enumerate(AXES, 1)) + " FROM embeddings)"


@query(f"SELECT p.vec_id AS a, count(*) AS n FROM {_BOX} p JOIN {_BOX} q ON p.vec_id < q.vec_id AND " + " AND ".join(f"p.lo{x} <= q.hi{x} AND q.lo{x} <= p.hi{x}" for x in AXES) + " GROUP BY 1")
def meeting_boxes(spark, sf):
    e = read(spark, sf, "embeddings")
    at = lambda i: F.element_at("embedding", i)
    sides = {x: (at(i).cast("double"), (at(i) + (at(i + 3) / 4).cast("float")).cast("double")) for i, x in enumerate(AXES, 1)}
    b = e.select("vec_id", *[F.least(*s).alias(f"lo{x}") for x, s in sides.items()], *[F.greatest(*s).alias(f"hi{x}") for x, s in sides.items()])
    return boxes.meeting(b, "vec_id", 0.1).groupBy(F.col("pvec_id").alias("a")).agg(F.count("*").alias("n"))


# --- running campaigns

_SAID = "CASE event_type WHEN 'purchase' THEN '[ETAPA] ' || CAST(event_id AS VARCHAR) || ' | sale' WHEN 'view' THEN '[EN CURSO] seen' WHEN 'error' THEN '[RESUME] reutilizado' WHEN 'click' THEN '[PROGRESO] Paso 1 | k ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || ' | 3 s' ELSE 'hello' END"


@query(f"""WITH l AS (SELECT user_id, ts, event_type AS t, {_SAID} AS line, CAST(floor(value) AS BIGINT) AS k, event_id FROM events),
o AS (SELECT *, sum(CAST(t = 'purchase' AS INT)) OVER c AS opened, first_value(ts) OVER c AS start, lead(ts) OVER c AS later FROM l WINDOW c AS (PARTITION BY user_id ORDER BY ts, line)),
s AS (SELECT *, coalesce(max(CAST(t IN ('click', 'view') AS INT)) OVER (PARTITION BY user_id, opened ORDER BY ts, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS specific, max(CASE WHEN t = 'purchase' THEN CAST(event_id AS VARCHAR) || ' | sale' END) OVER (PARTITION BY user_id, opened) AS stage, CASE WHEN opened > 0 THEN min(ts) OVER (PARTITION BY user_id, opened) ELSE start END AS stage_at FROM o),
y AS (SELECT *, CASE WHEN t = 'purchase' THEN '{campaigns.OPENED}' WHEN t = 'click' THEN 'k ' || CAST(k AS VARCHAR) WHEN t = 'view' AND specific = 0 THEN 'seen' WHEN t = 'error' AND specific = 0 THEN 'reutilizado' END AS says FROM s),
p AS (SELECT *, last_value(says IGNORE NULLS) OVER (PARTITION BY user_id, opened ORDER BY ts, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM y),
c AS (SELECT *, says IS NOT NULL AND (t = 'purchase' OR was IS NULL OR says <> was) AS changed FROM p),
a AS (SELECT *, last_value(says IGNORE NULLS) OVER (PARTITION BY user_id, opened ORDER BY ts, line) AS activity, coalesce(max(CASE WHEN changed AND t <> 'error' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, line), start) AS since, coalesce(max(CASE WHEN changed AND t <> 'error' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start) AS earlier FROM c),
m AS (SELECT user_id, ts, CASE WHEN t = 'purchase' THEN 'stage' ELSE 'activity' END AS event, stage, activity, stage_at, earlier AS since, start FROM a WHERE changed
 UNION ALL SELECT user_id, ts + INTERVAL 1 DAY, 'silent', stage, activity, stage_at, since, start FROM a WHERE coalesce(later, (SELECT max(ts) FROM events) - INTERVAL 60 SECOND) > ts + INTERVAL 1 DAY)
SELECT user_id, ts, event, stage, activity, round(epoch_us(ts) / 1e6 - epoch_us(stage_at) / 1e6, 3) AS stage_s, round(epoch_us(ts) / 1e6 - epoch_us(since) / 1e6, 3) AS activity_s, round(epoch_us(ts) / 1e6 - epoch_us(start) / 1e6, 3) AS total_s FROM m""")
def campaign_progress(spark, sf):
    kind = F.col("event_type")
    text = F.when(kind == "purchase", F.concat(F.lit("[ETAPA] "), F.col("event_id").cast("string"), F.lit(" | sale"))).when(kind == "view", "[EN CURSO] seen").when(kind == "error", "[RESUME] reutilizado")
    text = text.when(kind == "click", F.concat(F.lit("[PROGRESO] Paso 1 | k "), F.floor("value").cast("string"), F.lit(" | 3 s"))).otherwise("hello")
    lines = read(spark, sf, "events").select("user_id", "ts", text.alias("line"))
    told = campaigns.progress(lines, "user_id", silence=86_400.0)
    return told.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event", "stage", "activity", *[r(c, 3).alias(c) for c in ("stage_s", "activity_s", "total_s")])


@query(f"""WITH t AS (SELECT user_id AS session, min(ts) AS ts, CAST(floor(arg_min(value, ts)) AS INT) AS views FROM events WHERE event_type = 'view' GROUP BY 1), k AS (SELECT user_id AS session, min(ts) AS ts, arg_min(value, ts) AS value FROM events WHERE event_type = 'click' GROUP BY 1),
j AS (SELECT t.*, k.session AS found, k.value FROM t LEFT JOIN k ON k.session = t.session AND k.ts >= t.ts AND k.ts <= t.ts + INTERVAL 2 DAY)
SELECT session, ts, views >= 10 AND found IS NOT NULL AND value >= 5 AS ready, CASE WHEN views < 10 THEN 'views' WHEN found IS NULL THEN 'closure' WHEN value < 5 THEN 'turn' END AS reason FROM j""")
def session_readiness(spark, sf):
    """First views as captures (complete from 10 on), first clicks as closures (right from 5 on)."""
    e = read(spark, sf, "events")
    views = F.floor("value")
    captures = e.where("event_type = 'view'").select(F.col("user_id").alias("session"), "ts", F.when(views >= 10, 25).otherwise(0).alias("views"))
    closures = e.where("event_type = 'click'").select(F.col("user_id").alias("session"), "ts", F.when(F.col("value") >= 5, campaigns.STEPS_PER_TURN).otherwise(0).alias("steps"), F.lit("1").alias("flag"))
    return campaigns.ready_sessions(captures, closures, within="2 days").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# --- fits whose answer is known


@query("""WITH d AS (SELECT DISTINCT l_returnflag AS seed, CAST(l_linenumber AS INT) AS pose, CAST(l_quantity AS INT) AS q, CAST(round(l_discount * 100) AS INT) AS k FROM lineitem), n AS (SELECT seed, pose, count(*) AS n FROM d GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY pose) - 1 AS i, count(*) OVER (PARTITION BY seed) AS m FROM n)
SELECT seed, count(*) AS tests, count_if(pose <> 1) AS passed_tests, count_if(pose <> 1) / count(*) AS pass_ratio FROM p WHERE i IN (0, CAST(round_even((m - 1) / 2, 0) AS INT), m - 1) GROUP BY 1""")
def held_out_known_surface(spark, sf):
    """A quadratic that line number 1 alone doesn't follow: that pose fails when left out, the others hold."""
    rows = read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("seed"), F.col("l_linenumber").cast("int").alias("pose"), (F.col("l_quantity") / 50).cast("double").alias("u"), (F.round(F.col("l_discount") * 100) / 10).alias("v")).distinct()
    u, v = F.col("u"), F.col("v")
    slope_u, slope_v = 0.3 + 0.4 * u, -0.2 + 0.6 * v
    size = F.sqrt(slope_u * slope_u + slope_v * slope_v + 1)
    rows = rows.withColumns({"z": 0.3 * u - 0.2 * v + 0.2 * u * u + 0.3 * v * v + F.when(F.col("pose") == 1, 5.0).otherwise(0.0), "w": F.when(F.col("pose") == 1, 1e-9).otherwise(1.0), "nx": -slope_u / size, "ny": -slope_v / size, "nz": 1 / size})
    axes = {"n": (0.0, 0.0, 1.0), "t": (1.0, 0.0, 0.0), "b": (0.0, 1.0, 0.0)}
    frames = rows.select("seed").distinct().select("seed", *[F.lit(x).alias(f"{a}{i}") for a, some in axes.items() for i, x in enumerate(some)])
    return heldout.cross_validated(rows, frames, 1.0, 1.0, 0.01, 0.9).select("seed", "tests", "passed_tests", "pass_ratio")
