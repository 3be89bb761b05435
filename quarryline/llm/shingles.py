"""Near-duplicates by exact Jaccard similarity of word shingles: 0.8 or more links two documents.

Candidates: SimHash links (simhash.py, four of 64 bits), and buckets of ``BANDS`` = 40 bands of ``ROWS`` = 5 min-hashes, in
which a pair of similarity s is missed with chance (1 - s^5)^40: 1.3e-7 at 0.8, less above, the same at any size. No
candidate links unverified: 9 * |a & b| >= 4 * (|a| + |b|) on the whole sets of 64-bit shingle hashes.

Equal sets are one node before any pair is looked at. Nodes of a bucket first meet one of them, in TURNS turns with a hub of
each bucket's and turn's own, so a bucket makes as many pairs as it has rows; what that leaves in different components of a
bucket then meets pair by pair within tasks, so each candidate pair is tested or already within one component.

Shingles are those of simhash.py (lower case, fewer words than a shingle make one); texts without words equal each other.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import arrow_column, encoded_texts, prepare, stored
from .simhash import fingerprint, keep_least, links

BANDS, ROWS, TURNS, HASHES = 40, 5, 2, 1 << 20
_BLOCK = 1 << 11
_RANDOM = np.random.default_rng(20)
_MULTIPLY, _ADD = _RANDOM.integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
_MULTIPLY |= np.uint64(1)
_MIX = _RANDOM.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)


def shingle_set(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(joined, seed)], np.uint64)
    starts = [0, *itertools.accumulate(len(p) + 1 for p in parts)]
    return np.unique(np.array([digest(joined[a : b - 1], seed) for a, b in zip(starts, starts[words:], strict=False)], np.uint64))


def name_of(found: np.ndarray) -> int:
    return int(np.array(xxhash.xxh64_intdigest(found.tobytes()), np.uint64).view(np.int64))


def bands(found: np.ndarray) -> np.ndarray:
    """The key of each band; each band has a key space of its own."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for lo in range(0, len(found), _BLOCK):
        np.minimum(least, (found[lo : lo + _BLOCK] * _MULTIPLY + _ADD).min(1), out=least)
    key = ((least.reshape(BANDS, ROWS) ^ (least.reshape(BANDS, ROWS) >> np.uint64(29))) * _MIX).sum(1, dtype=np.uint64)
    return (key ^ (key >> np.uint64(32))).view(np.int64)


def sketch(words: int):
    """A column function: text -> node (the name of its shingle set), size, fp (SimHash), bands."""

    def of(texts: pa.Array) -> pa.Array:
        encoded = encoded_texts(texts)
        sets = [shingle_set(x, words) for x in encoded]
        prints = np.array([fingerprint(x, words) for x in encoded], np.uint64).view(np.int64)
        keys = np.concatenate([np.zeros(0, np.int64), *map(bands, sets)])
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys))
        return pa.StructArray.from_arrays([pa.array([name_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(prints), rows], names=["node", "size", "fp", "bands"])

    return arrow_column("struct<node:long,size:int,fp:long,bands:array<long>>", repeats=False)(of)


def _sets(words: int):
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([{"node": name_of(s), "set": s.view(np.int64)} for s in (shingle_set(x, words) for x in encoded_texts(texts))], pa.struct([("node", pa.int64()), ("set", pa.list_(pa.int64()))]))

    return arrow_column("struct<node:long,set:array<long>>", repeats=False)(of)


def _near(a, b):
    """What similarity 0.8 asks of two sizes."""
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    one, two = (sets.select(F.col("node").alias(n), F.col("set").alias(f"set_{n}")) for n in "uv")
    both = pairs.join(one, "u").join(two, "v")
    return both.where(9 * F.size(F.array_intersect("set_u", "set_v")) >= 4 * (F.size("set_u") + F.size("set_v"))).select("u", "v")


def _simhash_pairs(nodes: DataFrame) -> DataFrame:
    """SimHash's links as pairs of nodes: each node with the least of its fingerprint, and those of linked fingerprints."""
    least = stored(nodes.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("n")), "prints")
    same = nodes.join(least, "fp").select(F.col("n.node").alias("u"), F.col("node").alias("v"), F.col("n.size").alias("su"), F.col("size").alias("sv"))
    found = links(least.select("fp"))
    a, b = (least.select(F.col("fp").alias(n), F.col("n").alias(f"n{n}")) for n in "uv")
    return same.unionByName(found.join(a, "u").join(b, "v").select(F.col("nu.node").alias("u"), F.col("nv.node").alias("v"), F.col("nu.size").alias("su"), F.col("nv.size").alias("sv")))


def _distinct(pairs: DataFrame) -> DataFrame:
    close = pairs.where(_near(F.col("su"), F.col("sv"))).where("u <> v")
    return close.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _hub_pairs(placed: DataFrame, turn: int) -> DataFrame:
    """Each bucket's nodes with one of them, which differs from bucket to bucket and turn to turn."""
    hub = placed.groupBy("band").agg(F.min_by(F.struct("node", "size", "root"), F.xxhash64("node", "band", F.lit(turn))).alias("hub"))
    met = placed.join(hub, "band").where("root <> hub.root")
    return met.select(F.col("hub.node").alias("u"), F.col("node").alias("v"), F.col("hub.size").alias("su"), F.col("size").alias("sv"))


def _compare(table: pa.Table) -> pa.Table:
    """The linked pairs of a group that are in different components; sides as in simhash.py."""
    node, root, side = (np.asarray(table[n].combine_chunks()) for n in ("node", "root", "side"))
    sets = table["set"].combine_chunks()
    size = np.asarray(sets.value_lengths()).astype(np.int64)
    at = np.r_[0, np.cumsum(size)]
    flat = np.unique(np.asarray(sets.flatten()), return_inverse=True)[1]
    names, which, counts = np.unique(root, return_inverse=True, return_counts=True)
    here, u, v = np.zeros(len(flat) + 1, bool), [], []
    for i in np.flatnonzero(which != counts.argmax()) if len(names) > 1 else ():
        own = flat[at[i] : at[i + 1]]
        here[own] = True
        common = np.r_[0, np.cumsum(here[flat])]
        here[own] = False
        hit = (9 * (common[at[1:]] - common[at[:-1]]) >= 4 * (size + size[i])) & (root != root[i]) & ((side == 0) | (side != side[i]))
        v.append(node[hit])
        u.append(np.full(len(v[-1]), node[i]))
    join = lambda x: pa.array(np.concatenate([np.zeros(0, np.int64), *x]))
    return pa.Table.from_arrays([join(u), join(v)], names=["u", "v"])


def _cross(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of all pairs of a bucket in different components; a bucket of more than HASHES shingles is cut into blocks that meet two by two."""
    sizes = placed.groupBy("band").agg(F.ceil(F.sum("size") / HASHES).cast("int").alias("blocks"))
    rows = placed.join(sizes, "band").withColumn("block", F.pmod(F.xxhash64("node"), F.greatest("blocks", F.lit(1))).cast("int"))
    rows = rows.select("band", "node", "root", "block", F.explode(F.sequence(F.lit(0), F.greatest("blocks", F.lit(1)) - 1)).alias("other"))
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    met = rows.select(F.xxhash64("band", F.least("block", "other"), F.greatest("block", "other")).alias("group"), side.alias("side"), "node", "root")
    return met.join(sets, "node").groupBy("group").applyInArrow(_compare, "u long, v long").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _placed(met: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of buckets with more than one component, with their component."""
    placed = met.join(components(edges), "node", "left").select("band", "node", "size", F.coalesce("root", "node").alias("root"))
    return placed.join(placed.groupBy("band").agg((F.min("root") != F.max("root")).alias("mixed")).where("mixed").select("band"), "band")


def near_duplicates(docs: DataFrame, words: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: key, node (of equal shingle sets), root (of its component), component_id (least key reachable, its own included)."""
    prepare(docs.sparkSession)
    rows = stored(docs.select(docs[key].alias(key), sketch(words)(docs[text]).alias("s")).select(key, "s.*"), "sketches")
    least = stored(rows.groupBy("node").agg(F.min(key).alias("least")), "least")
    nodes = rows.select("node", "size", "fp").distinct()
    keys = rows.dropDuplicates(["node"]).select("node", "size", F.explode("bands").alias("band"))
    met = stored(keys.join(keys.groupBy("band").count().where("count > 1").select("band"), "band"), "met")
    first = stored(_distinct(_hub_pairs(met.withColumn("root", F.col("node")), 0).unionByName(_simhash_pairs(nodes))), "tested")
    wanted = stored(first.select(F.col("u").alias("node")).unionByName(first.select(F.col("v").alias("node"))).unionByName(met.select("node")).distinct(), "wanted")
    named = least.join(wanted, "node").select(F.col("least").alias("\0least"))
    texts = docs.select(docs[key].alias("\0key"), docs[text].alias("\0text")).join(named, F.col("\0key").eqNullSafe(F.col("\0least")), "left_semi")
    sets = stored(texts.select(_sets(words)("\0text").alias("s")).select("s.*").join(wanted, "node", "left_semi").dropDuplicates(["node"]), "sets")
    tested, edges = first, stored(_verified(first, sets), "edges")
    for turn in range(1, TURNS):
        fresh = stored(_distinct(_hub_pairs(_placed(met, edges), turn)).join(tested, ["u", "v"], "left_anti"), "tested")
        tested, edges = tested.unionByName(fresh), edges.unionByName(stored(_verified(fresh, sets), "edges"))
    edges = edges.unionByName(stored(_cross(stored(_placed(met, edges), "placed"), sets), "edges"))
    rooted = least.join(components(edges), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    whole = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select(key, "node").join(rooted.join(whole, "root").select("node", "root", "component_id"), "node").select(key, "node", "root", "component_id")


def keep_one(docs: DataFrame, words: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each group: that of the least key. Rows without a key stay, as no key can name them."""
    return keep_least(docs, near_duplicates(docs, words, text, key), _sets(words)(docs[text])["node"], key)
