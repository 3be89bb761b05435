"""Repeated rows in top-k search, and vector codes against a direct version."""

import hashlib

import numpy as np
import pytest

from quarryline.llm import annular, queries, vafile

SF = "/root/testdata/sf0.001"


def best(rows, k, every):
    """Candidates are all rows of another id, each repeated row for itself."""
    out = []
    for own in {i for i, _ in rows if i % every == 0}:
        for q in {tuple(v) for i, v in rows if i == own}:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in rows if i != own)[:k]
            out += [(own, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("case", range(4))
def test_repeated_rows(spark, case):
    rng = np.random.default_rng(case)
    first = [3, 4, 0]
    rows = {
        0: [(0, first)] * 2 + [(i, rng.integers(-2, 3, 3).tolist()) for i in range(1, 9)],
        1: [(0, first)] * 6 + [(7, first)] + [(i, rng.integers(-2, 3, 3).tolist()) for i in range(8, 20)],
        2: [(int(i), [[3, 4, 0], [1, 1, 1], [0, 2, 2]][int(j)]) for i, j in rng.integers(0, [12, 3], (120, 2))],
        3: [(i % 7, first) for i in range(200)],
    }[case]
    df = spark.createDataFrame([(i, [x / 256 for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, vafile.top_k(df, every=5).collect())) == best(rows, 5, 5)


def test_ids_that_answers_need():
    rng = np.random.default_rng(5)
    for _ in range(200):
        ids = rng.integers(0, 6, rng.integers(1, 40)).tolist()
        kept = vafile.least_ids(vafile.least_ids(ids[::2], 3) + vafile.least_ids(ids[1::2], 3), 3)
        assert len(kept) <= 6
        assert all(sorted(x for x in ids if x != own)[:3] == [x for x in kept if x != own][:3] for own in range(-1, 7))


def coded(rows, parts=16, entries=64, rounds=2):
    """rows: (id, vector, label) -> (id, code, error, label_error, digest), by plain loops."""
    kept = [(i, [int(np.floor(256 * float(x))) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    if not kept:
        return []
    at = annular.cuts(len(kept[0][1]), parts)
    cut = [[v[a:b] for a, b in zip(at[:-1], at[1:], strict=True)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = [nearest(c[p], books[p])[1] for c in cut]
            for e in set(own):
                mine = [c[p] for c, o in zip(cut, own, strict=True) if o == e]
                books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    error = [sum(d for d, _ in f) for f in found]
    by: dict = {}
    for (_, _, g), e in zip(kept, error, strict=True):
        by[g] = by.get(g, 0) + e
    return sorted((i is None, i or 0, "".join(f"{x:02x}" for _, x in f), e, by[g], digest) for (i, _, g), f, e in zip(kept, found, error, strict=True))


def got(df, **options):
    return sorted((r["vec_id"] is None, r["vec_id"] or 0, r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in annular.compress(df, **options).collect())


def test_op13(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted((False, *r) for r in map(tuple, queries.op13_codes(spark, SF).collect())) == coded(rows)


def test_codes_odd(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist(), None if i % 3 else 1) for i in range(60)]
    rows += rows[:5] + [(None, [0.0] * 6, 2), (60, None, 1), (61, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (62, [float("nan")] * 6, 1), (63, [float("-inf")] * 6, 1), (64, rows[0][1], 7), (3, [9.0] * 6, 7)]
    df = spark.createDataFrame([(i, v, g, "x", 1) for i, v, g in rows], "vec_id long, embedding array<double>, label int, id string, code int")
    for parts in (3, 4, 8):  # whole, uneven and empty parts
        assert got(df, parts=parts, entries=9) == coded(rows, parts, 9)
    assert got(df.limit(4)) == coded(rows[:4])  # fewer rows than entries
    assert annular.compress(df.where("false")).count() == 0
    mixed = spark.createDataFrame([(1, [], 1), (2, [1.0, 2.0], 1), (3, [1.5, 2.0], 1), (4, [1.0], None)], "vec_id long, embedding array<float>, label int")
    assert [r[:4] for r in got(mixed, parts=2)] == [(False, 1, "0000", 0), (False, 2, "0000", 0), (False, 3, "0100", 0), (False, 4, "0000", 0)]


@pytest.mark.parametrize("size", [2.0**20, 2.0**40])
def test_codes_of_large_components(spark, size):
    rng = np.random.default_rng(2)
    few = spark.createDataFrame([(i, v, 0) for i, v in enumerate(np.floor(rng.normal(size=(30, 4)) * size).tolist())], "vec_id long, embedding array<double>, label int")
    rows = [(r[0], r[1], r[2]) for r in few.collect()]
    if size < 2**30:
        assert got(few, parts=2, entries=4) == coded(rows, 2, 4)
    else:
        with pytest.raises(Exception, match="a squared distance is beyond a long"):
            annular.compress(few, parts=2, entries=4).collect()


def test_components_beyond_a_long_are_named(spark):
    with pytest.raises(Exception, match="beyond a long"):
        annular.compress(spark.createDataFrame([(0, [1e300], 1)], "vec_id long, embedding array<double>, label int")).collect()


def test_annulus_holds_the_nearest_and_prunes():
    rng = np.random.default_rng(3)
    book = annular.Codebook(rng.integers(-300, 300, (64, 4)))
    x = rng.integers(-300, 300, (2000, 4))
    every = ((x[:, None, :] - book.entries) ** 2).sum(2)
    index, error = book.nearest(x)
    assert (index == every.argmin(1)).all() and (error == every.min(1)).all()
    lo, hi = book.annulus(x)
    assert ((lo < hi) & (0 <= lo) & (hi <= 64)).all()
    spread = [np.floor(rng.normal(size=(n, 4)) * 100 * 2.0 ** rng.integers(0, 8, (n, 1))).astype(np.int64) for n in (64, 2000)]
    lo, hi = annular.Codebook(spread[0]).annulus(spread[1])
    assert (hi - lo).mean() < 32  # norms that differ let most entries go
    ties = annular.Codebook(np.array([[3, 4], [5, 0], [0, 5], [0, -5], [5, 0]]))
    assert ties.nearest(np.array([[0, 0], [5, 0], [5, 1]]))[0].tolist() == [0, 1, 1]
