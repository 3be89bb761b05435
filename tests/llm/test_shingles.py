"""Near-duplicates by verified similarity against all pairs."""

import random

import numpy as np
import pyarrow.parquet as pq

from quarryline.llm import shingles, simhash

from .test_llm import LONG, ODD


def slow_components(rows, words):
    """doc_id -> least doc_id reachable over pairs of similarity 0.8 or more, by all pairs."""
    sets = {}
    for i, text in rows:
        p = (text or "").encode().lower().split()
        sets[i] = frozenset(b" ".join(p[j : j + words]) for j in range(max(1, len(p) - words + 1))) if p else frozenset()
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] == sets[b] or 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                low, high = sorted((root(a), root(b)))
                least[high] = low
    return {i: root(i) for i in ids}


def varied(seed=1):
    """Groups of copies with 0 to 30 of 300 words replaced, chained copies of copies, and unrelated texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = []
    for g in range(12):
        base = [word() for _ in range(300)]
        for c in range(8):
            text = list(base)
            for _ in range(rng.choice([0, 1, 3, 5, 6, 7, 8, 10, 30])):
                text[rng.randrange(300)] = word()
            if c % 3 == 2:
                base = text
            rows.append((1000 * g + c, " ".join(text)))
    return rows


def test_same_as_all_pairs(spark):
    rows = varied() + [(50_000 + i, t) for i, t in enumerate(ODD)] + [(60_000, LONG + " more"), (60_001, "one")]
    got = shingles.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == slow_components(rows, 5)


def test_crowded_buckets(spark, monkeypatch):
    """All texts in every bucket: the components stay those of verified pairs."""
    monkeypatch.setattr(shingles, "bands", lambda found: np.arange(40))
    monkeypatch.setattr(shingles, "HASHES", 4000)  # several blocks
    rows = varied(2)
    got = shingles.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), 5).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == slow_components(rows, 5)


def test_near_copies_go(spark):
    """Two words of 100 replaced: similarity over 0.8, more than four bits of SimHash."""
    words = [f"a{i}" for i in range(100)]
    other = [*words[:30], "x", *words[31:70], "y", *words[71:]]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (None, " ".join(words))], "doc_id long, text string")
    assert simhash.keep_one(df, 5).count() == 3
    assert sorted(r["doc_id"] or 0 for r in shingles.keep_one(df).collect()) == [0, 1]


def test_documents_of_the_tables(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(path).to_pylist()]
    got = shingles.near_duplicates(spark.read.parquet(path), 5).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == slow_components(rows, 5)
    assert shingles.near_duplicates(spark.read.parquet(path).where("false"), 5).count() == 0


def test_rows_of_one_key_are_judged_by_their_texts(spark):
    one, two, three = ("alpha beta gamma delta epsilon zeta eta", "quite other words stand in this second text", "third text with words that no other text has")
    rows = [(1, one, "a"), (1, two, "b"), (2, one, "c"), (1, two, "b"), (3, three, "d"), (3, three, "d"), (2, two, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for keep in (simhash.keep_one, shingles.keep_one):
        assert sorted(map(tuple, keep(df, 5).collect())) == [(1, one, "a"), (1, two, "b"), (3, three, "d")]
