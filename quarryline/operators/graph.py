"""Connected components, parity and rings over edge tables.

Components come from alternating large-star and small-star rounds: each is two joins on the edges alone, written with
``checkpoint()``; nothing but a row count and a checksum reaches the driver, and rounds grow with the logarithm of a
component's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint; the folder comes from spark.checkpoint.dir, or a temporary one on a single machine."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        import tempfile

        found = sc.getConf().get("spark.checkpoint.dir")
        if not found and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="quarryline-"))
    return df.checkpoint()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    side = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return side.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of one orderable type -> (node, root): each node of an edge with the least node it reaches; roots are left out.

    Loops and repeated edges change nothing; an edge with a null end is ignored; no edges, no rows.
    """
    edges = cut(edges.where(F.col("u") != F.col("v")).distinct())
    state = _state(edges)
    while state[0]:
        edges = cut(_small_star(_large_star(edges)))
        if (now := _state(edges)) == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def label_nodes(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """Every node with its component, the least node it reaches, itself included."""
    return nodes.select(node).join(components(edges).withColumnRenamed("node", node), node, "left").select(node, F.coalesce("root", node).alias("component"))


def is_connected(nodes: DataFrame, edges: DataFrame, node: str) -> bool:
    return label_nodes(nodes, edges, node).select("component").distinct().limit(2).count() <= 1


def keep_touching(weak: DataFrame, edges: DataFrame, strong: DataFrame, node: str) -> DataFrame:
    """Hysteresis: weak nodes whose component holds a strong node."""
    named = label_nodes(weak, edges, node)
    seeds = named.join(strong.select(node), node, "left_semi").select("component").distinct()
    return named.join(seeds, "component", "left_semi").select(node)


def parity(nodes: DataFrame, edges: DataFrame, node: str, flip: str = "flip") -> DataFrame:
    """Labels 0 or 1 such that ``edges(u, v, flip)`` with flip 1 join different labels; and whether the component conflicts.

    Each node is doubled into its two states; a component that joins both states of a node has no such labels.
    """
    state = lambda c, s: F.struct(F.col(c).alias("n"), s.alias("s"))
    doubled = edges.withColumn("s", F.explode(F.array(F.lit(0), F.lit(1)))).select(state("u", F.col("s")).alias("u"), state("v", (F.col("s") + F.col(flip)) % 2).alias("v"))
    both = nodes.select(node).withColumn("s", F.explode(F.array(F.lit(0), F.lit(1)))).select(F.struct(F.col(node).alias("n"), "s").alias("node"))
    named = both.join(components(doubled), "node", "left").select("node.n", "node.s", F.coalesce("root", "node").alias("root"))
    wide = named.groupBy("n").agg(F.min(F.when(F.col("s") == 0, F.col("root"))).alias("r0"), F.min(F.when(F.col("s") == 1, F.col("root"))).alias("r1"))
    conflict = F.col("r0") == F.col("r1")
    return wide.select(F.col("n").alias(node), F.when(conflict, None).otherwise((F.col("r0") > F.col("r1")).cast("int")).alias("label"), conflict.alias("conflict"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The least spanning forest of ``edges(u, v, w)``: u < v, w of its edges. Equal weights go by u, then v, so it is one forest.

    In each round every component takes its least edge to another one; the components that these make are contracted, and of edges
    between the same two the least stays. Components at least halve, so rounds grow with the logarithm of their number. Edges with a
    null end or a weight that is null or NaN are ignored, as are loops; of repeated edges the lightest counts.
    """
    least = edges.where((F.col("u") != F.col("v")) & F.col("w").isNotNull() & ~F.isnan(F.col("w").cast("double")))
    least = least.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("w").alias("w"))
    open_, forest = cut(least.select(F.struct("w", "u", "v").alias("e"), F.col("u").alias("cu"), F.col("v").alias("cv"))), None
    while open_.limit(1).count():
        both = open_.select(F.col("cu").alias("c"), "e", "cu", "cv").unionByName(open_.select(F.col("cv").alias("c"), "e", "cu", "cv"))
        chosen = cut(both.groupBy("c").agg(F.min(F.struct("e", "cu", "cv")).alias("m")).select("m.e", "m.cu", "m.cv").distinct())
        forest = chosen.select("e.u", "e.v", "e.w") if forest is None else forest.unionByName(chosen.select("e.u", "e.v", "e.w"))
        roots = cut(components(chosen.select(F.col("cu").alias("u"), F.col("cv").alias("v"))))
        for c in ("cu", "cv"):
            open_ = open_.join(roots.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
        ends = F.least("cu", "cv").alias("cu"), F.greatest("cu", "cv").alias("cv")
        open_ = cut(open_.where(F.col("cu") != F.col("cv")).groupBy(*ends).agg(F.min("e").alias("e")))
    return open_.select("e.u", "e.v", "e.w") if forest is None else forest


def loop_places(steps: DataFrame) -> DataFrame:
    """component, place, size and node of the closed loops of directed ``steps(p, q)``: from each loop's least node on, in step order.

    Components in which a node has no, or more than one, step in or out are no loop and left out. Places come from list ranking:
    each node knows a later one and how far it is, and doubles that each round, so a loop of any length takes the logarithm of
    it and is never one group.
    """
    steps = cut(steps.select("p", "q"))
    ends = steps.select(F.col("p").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(steps.select(F.col("q").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    degree = ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("in").alias("in"))
    named = label_nodes(degree.select("node"), steps.select(F.col("p").alias("u"), F.col("q").alias("v")), "node")
    simple = degree.join(named, "node").groupBy("component").agg(F.count("*").alias("size"), F.count_if((F.col("out") != 1) | (F.col("in") != 1)).alias("bad")).where("bad = 0").drop("bad")
    on = cut(steps.join(named.withColumnRenamed("node", "p"), "p").join(simple, "component"))
    # the last step, back to the least node, is cut
    at = cut(on.select("component", "size", F.col("p").alias("node"), F.when(F.col("q") != F.col("component"), F.col("q")).alias("next"), (F.col("q") != F.col("component")).cast("long").alias("far")))
    while at.where("next is not null").limit(1).count():
        later = at.select(F.col("node").alias("next"), F.col("next").alias("_next"), F.col("far").alias("_far"))
        at = cut(at.join(later, "next", "left").select("component", "size", "node", F.col("_next").alias("next"), (F.col("far") + F.coalesce("_far", F.lit(0))).alias("far")))
    return at.select("component", (F.col("size") - 1 - F.col("far")).alias("place"), "size", "node")


def rings(edges: DataFrame, centers: DataFrame, k: int) -> DataFrame:
    """Nodes at 1 to k steps from each center, the center left out: center, node, ring."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    seen = centers.select(F.col("center"), F.col("center").alias("node"), F.lit(0).alias("ring"))
    front = seen
    for ring in range(1, k + 1):
        step = front.join(both, front["node"] == both["u"]).select("center", F.col("v").alias("node")).distinct()
        front = cut(step.join(seen, ["center", "node"], "left_anti").withColumn("ring", F.lit(ring)))
        seen = seen.unionByName(front)
    return seen.where("ring > 0")
