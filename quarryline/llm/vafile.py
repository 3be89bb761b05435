"""Exact top-k by inner product with a vector-approximation file.

Components become integers; each dimension's range is cut into 2^BITS cells of one width, and a vector's cells (a byte for
each dimension) are its approximation. For a query q and a vector in cells with middles m and radius r the inner product
lies within q.m - |q|.r and q.m + |q|.r, and a margin covers what floating point rounds. Blocks of approximations meet blocks of queries (every query has to meet every
vector; only cells move, not vectors); a block keeps what its own kth lower bound can't exclude, then the kth lower bound of
all blocks excludes more, and only for the rest are the exact vectors joined and read, in the order of their bounds, until
the kth score is above the next bound.

Equal vectors are one entry, so large groups of copies don't multiply. An entry keeps its 2k smallest ids, an id at most k times:
whichever id asks, k others are among them, or all that there are. Vectors that are null, empty, or hold a null or non-finite component take no part, nor do null ids; vectors of different
sizes have no inner product and don't meet. A query's own id is never its partner. Repeated query rows are answered once; repeated
candidate rows count each. Products are exact, by Python's integers where 64 bits could overflow; a component, or a score among
the best k, that no long can hold is an error (ValueError).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_column, prepare, stored

BITS, CHUNK, QUERIES, ROWS, SALT = 6, 8192, 16384, 1024, 16
LEAST, MOST = -(2**63), 2**63 - 1


def quantised(scale: int):
    """A column function: array<float> -> floor(scale * x) as little-endian int64, or null where it takes no part."""

    @arrow_column("binary")
    def of(vectors: pa.Array) -> pa.Array:
        flat, size = vectors.flatten(), pc.fill_null(pc.list_value_length(vectors), 0).to_numpy()
        ends = np.cumsum(size, dtype=np.int64)
        x = np.floor(flat.cast(pa.float64()).fill_null(np.nan).to_numpy() * scale)
        wrong = np.r_[0, np.cumsum(~np.isfinite(flat.cast(pa.float64()).fill_null(np.nan).to_numpy()))]
        right = (size > 0) & (wrong[ends] == wrong[ends - size])
        x = x[np.repeat(right, size)]
        if not ((x >= -(2.0**63)) & (x < 2.0**63)).all():
            raise ValueError("a component times the scale is beyond a long")
        data = x.astype("<i8")
        at = np.r_[0, np.cumsum(np.where(right, 8 * size, 0))].astype(np.int32)
        valid = np.packbits(right, bitorder="little")
        return pa.Array.from_buffers(pa.binary(), len(size), [pa.py_buffer(valid), pa.py_buffer(at), pa.py_buffer(data)])

    return of


def _matrix(column, kind: str) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products: by floats where these are exact, by 64-bit or else by Python's integers."""
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(v.astype(np.float64)).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q @ v.T if most < 2**62 else q.astype(object) @ v.astype(object).T


@arrow_column("struct<lo:array<long>,hi:array<long>>", repeats=False)
def _range(vectors: pa.Array) -> pa.Array:
    """Least and greatest components of a batch, in its first row."""
    x = _matrix(vectors, "<i8")
    return pa.array([{"lo": x.min(0).tolist(), "hi": x.max(0).tolist()}] + [None] * (len(x) - 1), pa.struct([("lo", pa.list_(pa.int64())), ("hi", pa.list_(pa.int64()))]))


def least_ids(ids: list[int], k: int) -> list[int]:
    """The 2k smallest ids, each at most k times."""
    ids = sorted(ids)
    return [x for i, x in enumerate(ids) if i < k or ids[i - k] != x][: 2 * k]


def _least(ids, k: int):
    every = F.array_sort(F.flatten(F.collect_list(ids)))
    return F.transform(F.array(every), lambda a: F.slice(F.filter(a, lambda x, i: (i < k) | (F.get(a, i - k) != x)), 1, 2 * k))[0]


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """rows(id, vector) -> (vector, dims, ids): each vector once with the ids that answers can need; hot vectors are salted."""

    def run(batches):
        for batch in batches:
            seen: dict = {}
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.setdefault(v, []).append(i)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([least_ids(x, k) for x in seen.values()], pa.list_(pa.int64()))], names=["vector", "ids"])

    some = rows.mapInArrow(run, "vector binary, ids array<long>")
    some = some.groupBy("vector", F.pmod(F.element_at("ids", 1), F.lit(SALT)).alias("salt")).agg(_least("ids", k).alias("ids"))
    return some.groupBy("vector").agg(_least("ids", k).alias("ids")).withColumn("dims", (F.length("vector") / 8).cast("int"))


def _cells(low: dict, width: dict):
    @arrow_column("binary")
    def of(vectors: pa.Array, dims: pa.Array) -> pa.Array:
        out = np.empty(len(vectors), object)
        sizes = dims.to_numpy()
        for d in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == d)
            above = _matrix(vectors.take(pa.array(rows)), "<u8") - low[d].view(np.uint64)  # modulo 2^64, so right for any two longs
            out[rows] = [c.tobytes() for c in (above // width[d]).astype(np.uint8)]
        return pa.array(out, pa.binary())

    return of


_FOUND = pa.schema([("query_id", pa.int64()), ("query", pa.int64()), ("entry", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])


def _scan(k: int, low: dict, width: dict):
    def run(cells: pa.Table, queries: pa.Table) -> pa.Table:
        if not cells.num_rows or not queries.num_rows:
            return _FOUND.empty_table()
        d = queries["dims"][0].as_py()
        wide, base = width[d].astype(np.float64), low[d].astype(np.float64)
        radius = (wide - 1) / 2
        middles = _matrix(cells["cells"], np.uint8) * wide + (base + radius)
        largest = np.abs(base) + wide * ((1 << BITS) + 1)
        entry, least, alone = (cells[c].to_numpy() for c in ("entry", "least", "alone"))
        names, ids, vectors = queries["query"].to_numpy(), queries["query_id"].to_numpy(), queries["vector"]
        out = []
        for lo in range(0, queries.num_rows, ROWS):
            own, q = ids[lo : lo + ROWS], _matrix(vectors[lo : lo + ROWS], "<i8").astype(np.float64)
            middle = q @ middles.T
            slack = np.abs(q) @ radius + np.abs(q) @ largest * ((d + 16) * 2.0**-51) + 1e-3  # rounding: less than d + 16 steps of 2^-52 each
            middle[(own[:, None] == least[None, :]) & alone[None, :]] = -np.inf
            top = min(k, middle.shape[1])
            edge = np.partition(middle, -top, axis=1)[:, -top] - slack
            keep_q, keep_c = np.nonzero((middle + slack[:, None] >= edge[:, None]) & np.isfinite(middle))
            kept = middle[keep_q, keep_c]
            out.append(pa.Table.from_arrays([pa.array(own[keep_q]), pa.array(names[lo : lo + ROWS][keep_q]), pa.array(entry[keep_c]), pa.array(kept - slack[keep_q]), pa.array(kept + slack[keep_q])], schema=_FOUND))
        return pa.concat_tables(out)

    return run


def _read(k: int, block: int = 32):
    schema = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(table: pa.Table, query: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        table = table.sort_by([("high", "descending")])
        own, high = table["query_id"][0].as_py(), table["high"].to_pylist()
        q = np.frombuffer(query["vector"][0].as_py(), "<i8")[None, :]
        vectors, ids, best = table["vector"], table["ids"].to_pylist(), []
        for lo in range(0, len(ids), block):
            if len(best) >= k and high[lo] < -best[k - 1][0]:
                break
            scores = _products(q, _matrix(vectors[lo : lo + block], "<i8"))[0].tolist()
            best += [(-s, i) for s, some in zip(scores, ids[lo : lo + block], strict=True) for i in some if i != own]
            best = sorted(best)[:k]
        if not all(LEAST <= -s <= MOST for s, _ in best):
            raise ValueError("an inner product is beyond a long")
        return pa.Table.from_arrays([pa.array([own] * len(best), pa.int64()), pa.array(range(1, len(best) + 1), pa.int32()), pa.array([i for _, i in best], pa.int64()), pa.array([-s for s, _ in best], pa.int64())], schema=schema)

    return run


def top_k(table: DataFrame, k: int = 5, every: int = 50, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best partners of each row whose key is divisible by ``every``; ties to smaller ids."""
    spark = table.sparkSession
    prepare(spark)
    rows = stored(table.select(table[key].cast("long").alias("id"), quantised(scale)(table[vector]).alias("vector")).where("id is not null and vector is not null"), "vectors")
    whole = stored(distinct_vectors(rows, k).withColumn("entry", F.monotonically_increasing_id()), "distinct")
    ranges = whole.groupBy("dims").agg(F.count("*").alias("n")).collect()  # a row for each vector size
    low, width = {}, {}
    for d in [r["dims"] for r in ranges]:
        found = whole.where(F.col("dims") == d).select(_range("vector").alias("r")).where("r is not null")
        lo_hi = found.select(F.posexplode(F.arrays_zip("r.lo", "r.hi")).alias("at", "c")).groupBy("at").agg(F.min("c.lo").alias("lo"), F.max("c.hi").alias("hi")).orderBy("at").collect()
        low[d] = np.array([r["lo"] for r in lo_hi], np.int64)
        width[d] = np.array([(r["hi"] - r["lo"]) // (1 << BITS) + 1 for r in lo_hi], np.uint64)
    n = sum(r["n"] for r in ranges)
    chunks = max(1, -(-n // CHUNK))
    queries = rows.where(F.pmod("id", F.lit(every)) == 0).select(F.col("id").alias("query_id"), F.xxhash64("id", "vector").alias("query"), (F.length("vector") / 8).cast("int").alias("dims"), "vector")
    queries = stored(queries.dropDuplicates(["query_id", "query"]), "queries")
    blocks = max(1, -(-queries.count() // QUERIES))
    cells = whole.select("entry", F.array_min("ids").alias("least"), "dims", (F.array_min("ids") == F.array_max("ids")).alias("alone"), _cells(low, width)("vector", "dims").alias("cells"))
    cells = cells.withColumn("chunk", F.pmod(F.xxhash64("entry"), F.lit(chunks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    by, name = ["dims", "chunk", "block"], ["query_id", "query"]
    found = stored(cells.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(_scan(k, low, width), "query_id long, query long, entry long, low double, high double"), "found")
    best = Window.partitionBy(*name).orderBy(F.desc("low"))
    edge = found.select(*name, "low").withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).groupBy(*name).agg(F.when(F.count("*") == k, F.min("low")).otherwise(F.lit(float("-inf"))).alias("edge"))
    left = found.join(edge, name).where(F.col("high") >= F.col("edge"))
    exact = left.join(whole.select("entry", "vector", "ids"), "entry")
    return exact.select(*name, "high", "vector", "ids").groupBy(*name).cogroup(queries.groupBy(*name)).applyInArrow(_read(k), "query_id long, rank int, vec_id long, score long")
