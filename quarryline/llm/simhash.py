"""SimHash near-duplicates with pigeonring filtering.

Fingerprints are 64 bits over word shingles; two link at ``TAU`` = 4 or fewer differing bits. The ring of ``SEGMENTS`` = 5
segments has the budget TAU / SEGMENTS for each: if two fingerprints link, some start exists from which every chain of l
consecutive segments differs in at most floor(l * TAU / SEGMENTS) bits, so in 0 bits of the first segment, 1 of two, 2 of
three, 3 of four and 4 of all (the strong form of the pigeonring principle). Hence rows meet in buckets by (start, first
segment), the chain budgets prune the pairs there, and only what is left has its full distance taken, which is the last budget.

Exact at every size, without caps: equal fingerprints are one row before any pair is looked at; a bucket of more than
``BUCKET`` rows is dealt anew by the chain's own budget (2 differing bits in the next two segments leave 2 of 4 quarters
equal, which gives 6 finer keys of 13 more bits); a bucket still larger is cut into blocks, and blocks meet two by two. A
task emits a spanning forest of its links, never all pairs of a group, and components are found over the forests.

Texts: null and word-less texts have fingerprint zero and link like any other; fewer words than a shingle make one
shingle; repeated shingles count as often as they occur. A null doc_id never names a component unless nothing else does.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import arrow_column, encoded_texts, prepare, stored

BITS, TAU, SEGMENTS, BUCKET = 64, 4, 5, 4096
_EDGES = [round(i * BITS / SEGMENTS) for i in range(SEGMENTS + 1)]
_BLOCK = 1 << 13


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """A bit is set if over half of the shingles' hashes set it."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return digest(joined, seed)
    sizes = [len(p) + 1 for p in parts]
    starts = [0, *itertools.accumulate(sizes)]
    counts, n = np.zeros(BITS, np.int64), len(parts) - words + 1
    for lo in range(0, n, _BLOCK):
        hi = min(n, lo + _BLOCK)
        hashes = [digest(joined[a : b - 1], seed) for a, b in zip(starts[lo:hi], starts[lo + words : hi + words], strict=True)]
        counts += np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def simhash(words: int = 4, seed: int = 42):
    """A column function: text -> its fingerprint as a signed long."""

    @arrow_column("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(x, words, seed) for x in encoded_texts(texts)], np.uint64).view(np.int64))

    return of


def _segment(i: int) -> tuple[int, int]:
    i %= SEGMENTS
    return _EDGES[i], _EDGES[i + 1] - _EDGES[i]


def _bits(fp, shift: int, width: int):
    return F.shiftrightunsigned(fp, shift).bitwiseAND((1 << width) - 1)


def _chain_masks() -> np.ndarray:
    out = np.zeros((SEGMENTS, SEGMENTS), np.uint64)
    for start in range(SEGMENTS):
        mask = 0
        for length in range(SEGMENTS):
            shift, width = _segment(start + length)
            mask |= ((1 << width) - 1) << shift
            out[start, length] = mask
    return out


MASKS = _chain_masks()
BUDGETS = [(i + 1) * TAU // SEGMENTS for i in range(SEGMENTS)]


def _first_keys(fp):
    """Start and first segment, of each of the ring's starts."""
    return F.array(*[F.struct(F.lit(i).alias("start"), _bits(fp, *_segment(i)).alias("key")) for i in range(SEGMENTS)])


def _fine_keys(fp, start, key):
    """For a start: the first segment, and two of four equal quarters of the next two segments."""
    whole = None
    for i in range(SEGMENTS):
        (a, wa), (b, wb) = _segment(i + 1), _segment(i + 2)
        cuts = [(a, wa // 2), (a + wa // 2, wa - wa // 2), (b, wb // 2), (b + wb // 2, wb - wb // 2)]
        keys = F.array(*[
            F.xxhash64(key, F.lit(m), _bits(fp, *cuts[x]), _bits(fp, *cuts[y])) for m, (x, y) in enumerate(itertools.combinations(range(4), 2))
        ])
        whole = F.when(start == i, keys) if whole is None else whole.when(start == i, keys)
    return whole


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row that each of n rows reaches over the pairs (a, b)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _forest(fp: np.ndarray, start: np.ndarray, group: np.ndarray, side: np.ndarray):
    """Linked pairs of rows of one group, as (row, least row of its tree); rows lie sorted by group.

    side: 0 pairs with any row; 1 and 2 pair only with each other (two blocks of one bucket).
    """
    n = len(fp)
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(n)
    for d in range(1, n):
        at = at[at + d < n]
        at = at[group[at] == group[at + d]]
        if not len(at):
            break
        x, s, near = fp[at] ^ fp[at + d], start[at], np.flatnonzero((side[at] == 0) | (side[at] != side[at + d]))
        for length in range(1, SEGMENTS):
            near = near[np.bitwise_count(x[near] & MASKS[s[near], length]) <= BUDGETS[length]]
        a, b = np.r_[a, at[near]], np.r_[b, at[near] + d]
        if len(a) > 4 * n + 1024:
            root = _roots(n, a, b)
            a = np.flatnonzero(root != np.arange(n))
            b = root[a]
    if not len(a):
        return a, b
    root = _roots(n, a, b)
    a = np.flatnonzero(root != np.arange(n))
    return a, root[a]


def _link(batches):
    """Rows sorted by bucket -> forest edges (u, v); a bucket that goes on in the next batch waits for it."""
    held = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            cols = [np.asarray(batch.column(i)) for i in range(4)]
            if held is not None:
                cols = [np.r_[h, c] for h, c in zip(held, cols, strict=True)]
        elif held is None:
            return
        else:
            cols = held
        start, key, side, fp = cols
        if not len(fp):
            continue
        change = np.flatnonzero((start[1:] != start[:-1]) | (key[1:] != key[:-1])) + 1
        cut = len(fp) if batch is None else int(change[-1]) if len(change) else 0
        held = None if batch is None else [c[cut:] for c in cols]
        if cut:
            group = np.zeros(cut, np.int64)
            group[change[change < cut]] = 1
            unsigned = fp[:cut].view(np.uint64)
            a, b = _forest(unsigned, start[:cut].astype(np.int64), np.cumsum(group), side[:cut])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["u", "v"])


def links(prints: DataFrame) -> DataFrame:
    """Distinct ``prints(fp)`` -> edges (u, v) whose components are those of all links."""
    fp = F.col("fp")
    first = prints.select("fp", F.explode(_first_keys(fp)).alias("k")).select("fp", "k.start", "k.key")
    many = first.groupBy("start", "key").count().where(F.col("count") > BUCKET).select("start", "key")
    fine = first.join(many, ["start", "key"], "left_semi").select("fp", "start", F.explode(_fine_keys(fp, F.col("start"), F.col("key"))).alias("key"))
    fine = stored(fine, "buckets")
    dense = fine.groupBy("start", "key").count().where(F.col("count") > BUCKET).select("start", "key", F.ceil(F.col("count") / BUCKET).cast("int").alias("blocks"))
    blocks = fine.join(dense, ["start", "key"]).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    blocks = blocks.select("fp", "start", "key", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = blocks.select(
        "start", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"),
        F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"), "fp",
    )
    plain = [x.select("start", "key", F.lit(0).alias("side"), "fp") for x in (first.join(many, ["start", "key"], "left_anti"), fine.join(dense, ["start", "key"], "left_anti"))]
    rows = plain[0].unionByName(plain[1]).unionByName(met)
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "start", "key").sortWithinPartitions("start", "key", "fp").mapInArrow(_link, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: key, fp (signed long), node (fp), root (of its component), component_id (least key reachable, its own included)."""
    prepare(docs.sparkSession)
    prints = stored(docs.select(docs[key].alias(key), simhash(words)(docs[text]).alias("fp")), "prints")
    least = prints.groupBy("fp").agg(F.min(key).alias("least")).checkpoint()
    found = components(links(least.select("fp")))
    rooted = least.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    whole = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(whole, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp").select(key, "fp", F.col("fp").alias("node"), "root", "component_id")


def keep_one(docs: DataFrame, words: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each group: that of the least key. Rows without a key stay, as no key can name them."""
    return keep_least(docs, near_duplicates(docs, words, text, key), simhash(words)(docs[text]), key)


def keep_least(docs: DataFrame, groups: DataFrame, name, key: str) -> DataFrame:
    """``docs`` with the document of the least key of each group; ``groups`` has key, node, root and component_id for each row.

    Rows of different texts may share a key: each is judged by the ``name`` of its text (a column of ``docs`` that equals node), and of
    a group's rows with the least key that of the least node stays, of several such rows the first by a hash of all columns.
    """
    near = stored(groups, "near")
    kept = near.where(F.col(key) == F.col("component_id")).groupBy(key, "root").agg(F.min("node").alias("node"))
    shared = stored(near.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(F.col(key).alias("\0key")), "shared")
    least = kept.select(F.col(key).alias("\0key"), F.col("node").alias("\0node")).distinct()
    if not shared.limit(1).count():
        out = docs.join(least.select("\0key"), docs[key] == F.col("\0key"), "left_semi")
    else:
        mine = docs[key] == F.col("\0key")
        alone = docs.join(shared, mine, "left_anti").join(least.select("\0key"), mine, "left_semi")
        named = docs.join(shared, mine, "left_semi").withColumn("\0name", name)
        first = Window.partitionBy(F.col(key), F.col("\0name")).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
        few = named.join(least, (named[key] == F.col("\0key")) & (named["\0name"] == F.col("\0node")), "left_semi").withColumn("\0n", F.row_number().over(first)).where(F.col("\0n") == 1)
        out = alone.unionByName(few.select(*[F.col(f"`{c}`") for c in docs.columns]))
    return out.unionByName(docs.where(docs[key].isNull())) if near.where(F.col(key).isNull()).limit(1).count() else out
