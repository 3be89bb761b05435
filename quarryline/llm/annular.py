"""Vector codes: each vector cut into parts, each part named by its codebook's nearest entry, found by annular norm pruning.

The entries of a codebook are sorted by norm. Whatever is within distance d of a part has a norm within d of the part's own, so
the distance to the entries next to it in norm bounds an annulus, whose ends a binary search finds; every entry of it, ends
included, is measured exactly, and entries outside can't be nearest. Ties go to the lower index.

Components become integers. The codebooks start as the parts of the ``entries`` smallest ids; a round assigns all parts and replaces
each entry by the floor of its parts' mean, whose sums Spark adds up. A codebook is ``entries`` parts, whatever the table's size, and
is all that reaches the driver or goes out to the tasks.

Vectors that are null, or hold a null or non-finite component, are dropped. Rows of a null id count like others and start
codebooks last; rows of one id do so in order of their components; repeated rows count each. Vectors of each length have codebooks
of their own (of ``LENGTHS`` lengths at most, else ValueError); where a length isn't a multiple of ``parts`` the first parts are one
longer, and an empty part is at distance 0 from entry 0. No rows, no rows. A component or an error that no long holds is an error.
Sums are exact up to 38 digits.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored

NEAR, PAIRS, LENGTHS = 8, 1 << 18, 256


class Codebook:
    """Entries of one part position, sorted by norm."""

    def __init__(self, entries: np.ndarray):
        norm = _norms(entries)
        self.entries, self.number = entries, np.argsort(norm, kind="stable")
        self.norm, self.sorted = norm[self.number], entries[self.number]

    def annulus(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the places, first and end, of the entries whose norm the best distance so far allows."""
        norm, k = _norms(x), len(self.norm)
        at = np.searchsorted(self.norm, norm)
        near = np.clip(at[:, None] + np.arange(-(NEAR // 2), NEAR - NEAR // 2), 0, k - 1)
        reach = np.sqrt(_squares(x[:, None, :] - self.sorted[near]).min(1).astype(np.float64))
        reach += (norm + reach + 1) * 1e-12  # what square roots round is far less
        return np.searchsorted(self.norm, norm - reach, "left"), np.searchsorted(self.norm, norm + reach, "right")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the nearest entry's index and squared distance."""
        if not len(x):
            return np.zeros(0, np.int64), np.zeros(0, x.dtype)
        lo, hi = self.annulus(x)
        index, error = np.empty(len(x), np.int64), np.empty(len(x), x.dtype)
        rows = max(1, PAIRS // len(self.norm))
        for a in range(0, len(x), rows):
            first, size = lo[a : a + rows], (hi - lo)[a : a + rows]
            begin = np.cumsum(size) - size
            place = np.arange(size.sum()) + np.repeat(first - begin, size)
            d = _squares(np.repeat(x[a : a + rows], size, axis=0) - self.sorted[place])
            least = np.minimum.reduceat(d, begin)
            index[a : a + rows] = np.minimum.reduceat(np.where(d == np.repeat(least, size), self.number[place], len(self.norm)), begin)
            error[a : a + rows] = least
        return index, error


def _squares(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(-1)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(_squares(x).astype(np.float64))


def _exact(x: np.ndarray, most: int) -> np.ndarray:
    """As 64-bit integers where no square overflows, else as Python's."""
    return x if 4 * most * most * max(1, x.shape[-1]) < 2**62 else x.astype(object)


def cuts(length: int, parts: int) -> list[int]:
    """Where the parts of a vector begin, with its end; equal parts where the length allows."""
    each, more = divmod(length, parts)
    return [i * each + min(i, more) for i in range(parts + 1)]


def _matrices(vectors: pa.Array):
    """(rows, matrix) for each length in a batch."""
    size, ends = (x.to_numpy() for x in (pc.list_value_length(vectors), vectors.offsets))
    flat = vectors.values.to_numpy()
    for length in np.unique(size).tolist():
        rows = np.flatnonzero(size == length)
        yield rows, flat[ends[rows][:, None] + np.arange(length)]


def _assigned(matrix: np.ndarray, books: dict, parts: int):
    """(part, values, indices, errors) of each part position."""
    own, at = books[matrix.shape[1]], cuts(matrix.shape[1], parts)
    for p in range(parts):
        entries = own[p]
        most = max(int(np.abs(m.astype(np.float64)).max(initial=0)) for m in (matrix, entries)) + 1
        x = matrix[:, at[p] : at[p + 1]]
        index, error = Codebook(_exact(entries, most)).nearest(_exact(x, most))
        yield p, x, index, error


_SUM = pa.schema([("length", pa.int32()), ("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("total", pa.decimal128(38, 0)), ("n", pa.int64())])
_SUMS = "length int, part int, entry int, place int, total decimal(38,0), n long"


def _sums(books: dict, parts: int):
    """Sums of what each entry names, for a task: a row for each entry and place."""

    def run(batches):
        total: dict = {}
        for batch in batches:
            for _, matrix in _matrices(batch.column(0)):
                for p, x, index, _ in _assigned(matrix, books, parts):
                    if not x.shape[1]:
                        continue
                    order = np.argsort(index, kind="stable")
                    used, first = np.unique(index[order], return_index=True)
                    n = np.diff(np.r_[first, len(order)])
                    # halves of 32 bits: their sums can't overflow in a batch
                    halves = [np.add.reduceat(half[order], first, axis=0) for half in (x >> 32, x & 0xFFFFFFFF)]
                    for i, e in enumerate(used.tolist()):
                        old = total.get((matrix.shape[1], p, e), (0, 0))
                        new = halves[0][i].astype(object) * 2**32 + halves[1][i].astype(object)
                        total[matrix.shape[1], p, e] = (old[0] + new, old[1] + int(n[i]))
        rows = [(length, p, e, i, Decimal(int(v)), n) for (length, p, e), (sums, n) in total.items() for i, v in enumerate(sums.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_SUM), _SUM, strict=True)], schema=_SUM)

    return run


def _codes(books: dict, parts: int, digest: str):
    def run(batches):
        for batch in batches:
            code, error = np.empty((batch.num_rows, parts), np.uint8), np.zeros(batch.num_rows, object)
            for rows, matrix in _matrices(batch.column(0)):
                for p, _, index, e in _assigned(matrix, books, parts):
                    code[rows, p] = index
                    error[rows] += e
            if (error >= 2**63).any():
                raise ValueError("a squared distance is beyond a long")
            names = [row.tobytes().hex() for row in code]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(names, pa.string()), pa.array(error.tolist(), pa.int64()), pa.array([digest] * len(names), pa.string())], names=["id", "label", "code", "error", "codebooks_sha256"])

    return run


def integers(vector, scale: int):
    """A column: floor(scale * x) of every component, or null where the vector takes no part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    inside = F.forall(vector, lambda x: F.abs(x.cast("double") * scale) < 2.0**63)
    wrong = F.raise_error(F.lit("a component times the scale is beyond a long")).cast("array<bigint>")
    return F.when(finite & inside, F.transform(vector, lambda x: F.floor(x.cast("double") * scale))).when(finite, wrong)


def _first(rows: DataFrame, entries: int) -> dict[int, np.ndarray]:
    """For each length the vectors of the smallest ids."""
    lengths = [r["n"] for r in rows.select(F.size("vector").alias("n")).distinct().limit(LENGTHS + 1).collect()]
    if len(lengths) > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} lengths")
    out = {}
    for n in lengths:
        some = rows.where(F.size("vector") == n).orderBy(F.asc_nulls_last("id"), "vector").limit(entries).select("vector").collect()
        out[n] = np.array([r["vector"] for r in some], np.int64).reshape(len(some), n)
    return out


def digest_of(books: dict) -> str:
    """SHA-256 of all final components in decimal, by length, part, entry and place."""
    return hashlib.sha256(",".join(str(v) for n in sorted(books) for book in books[n] for v in book.ravel().tolist()).encode()).hexdigest()


def trained(rows: DataFrame, parts: int, entries: int, rounds: int) -> dict[int, list[np.ndarray]]:
    """rows(vector, id, ...) -> for each length the entries of every part."""
    books = {n: [first[:, a:b] for a, b in pairwise(cuts(n, parts))] for n, first in _first(rows, entries).items()}
    for _ in range(rounds):
        sums = rows.select("vector").mapInArrow(_sums(books, parts), _SUMS).groupBy("length", "part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        new = {n: [b.copy() for b in own] for n, own in books.items()}
        for r in sums.collect():  # entries times components
            new[r["length"]][r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
        books = new
    return books


def compress(table: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, code, error, label_error, codebooks_sha256: a row for each row that takes part."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits")
    prepare(table.sparkSession)
    kept = table.select(integers(table[vector], scale).alias("vector"), table[key].alias("id"), table[label].alias("label")).where("vector is not null")
    kept = stored(kept, "vectors")
    books = trained(kept, parts, entries, rounds)
    types = dict(kept.dtypes)
    coded = kept.mapInArrow(_codes(books, parts, digest_of(books)), f"id {types['id']}, label {types['label']}, code string, error long, codebooks_sha256 string")
    coded = stored(coded, "codes")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(F.col("id").alias(key), "code", "error", "label_error", "codebooks_sha256")
