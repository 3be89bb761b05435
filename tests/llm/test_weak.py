"""Weak supervision: statistics and verdicts against plain versions that go document by document."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.llm import queries, weak

SF = "/root/testdata/sf0.001"


def counted(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside)


def believed(votes):
    """Expectation-maximisation over single documents, by loops."""
    rules = len(votes[0])
    chance = [[list(weak.START[c]) for c in (0, 1)] for _ in range(rules)]
    prior = weak.PRIOR
    for _ in range(weak.ROUNDS):
        good = []
        for v in votes:
            a, b = 1 - prior, prior
            for r, x in enumerate(v):
                if x:
                    a, b = a * chance[r][0][x + 1], b * chance[r][1][x + 1]
            good.append(b / (a + b))
        docs = [sum(1 - g for g in good), sum(good)]
        for r in range(rules):
            for c in (0, 1):
                belief = 1 + weak.TRUST * docs[c]
                told = [belief * x for x in weak.START[c]]
                for v, g in zip(votes, good, strict=True):
                    told[v[r] + 1] += g if c else 1 - g
                chance[r][c] = [x / (docs[c] + belief) for x in told]
            for x, right in ((0, 0), (2, 1)):
                if chance[r][right][x] < chance[r][1 - right][x]:
                    chance[r][0][x] = chance[r][1][x] = (chance[r][0][x] + chance[r][1][x]) / 2
        prior = (docs[1] + (1 + weak.TRUST * len(votes)) * weak.PRIOR) / (1 + len(votes) + weak.TRUST * len(votes))
    return prior, chance, good


def test_op11(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    votes = {r["doc_id"]: tuple(r["votes"]) for r in weak.judge(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    _, _, good = believed([votes[k] for k in sorted(votes)])
    good = dict(zip(sorted(votes), good, strict=True))
    got = queries.op11_weak_rules(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        want = counted(texts[r["doc_id"]])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r["base_failed"] == failed and r["quality_probability"] == pytest.approx(good[r["doc_id"]], abs=1e-6)
        assert r["kept"] == (not failed and good[r["doc_id"]] >= 0.5)


def test_verdicts_agree_with_labels(spark):
    """The rules never see a label; on documents that pass the base they find the junk and leave the rest alone."""
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(SF.replace("0.001", "0.1") + "/labels.parquet").collect()}
    rows = [(labels.get(r["doc_id"]), r["kept"]) for r in queries.op11_weak_rules(spark, SF.replace("0.001", "0.1")).where("not base_failed").collect()]
    good, bad = ([k for q, k in rows if q == x] for x in (1, 0))
    assert sum(good) >= 0.998 * len(good) and sum(bad) <= 0.05 * len(bad)


def test_votes_are_learned():
    """A rule that votes at random is believed less than rules that agree with each other, and changes few verdicts."""
    rng = np.random.default_rng(0)
    n, good = 20_000, rng.random(20_000) < 0.8
    against, for_ = np.where(good, 0.003, 0.6)[:, None], np.where(good, 0.5, 0.2)[:, None]
    chance = rng.random((n, 4))
    votes = np.where(chance < against, -1, np.where(chance < against + for_, 1, 0))
    votes[:, 3] = rng.choice([-1, 1], n)
    patterns, inverse, each = np.unique((votes + 1) @ 3 ** np.arange(4), return_inverse=True, return_counts=True)
    model = weak.estimate(weak.votes_of(patterns, 4), each.astype(float))
    log = np.log(model.chance[:, 0, 0] / model.chance[:, 1, 0])
    assert (log[:3] > 2 * log[3]).all() and ((model.posterior(weak.votes_of(patterns, 4))[inverse] >= 0.5) == good).mean() > 0.96


def test_repeats_of_many_words():
    ids = np.array([0, 1, 2, 3, 0, 1, 2, 9, 9, 9, 9])
    assert weak.repeated_words(ids) == 10  # 0 1 2 twice; 9 9 9 twice, overlapping
    assert [weak.repeated_words(np.zeros(n, np.int64)) for n in range(6)] == [0, 0, 0, 0, 4, 5]
    long = np.r_[np.arange(1 << 21), [5, 6, 7]]
    assert weak.repeated_words(long) == 6


def test_odd(spark):
    rows = [(None, None), (1, ""), (2, " \t\n"), (3, "   x"), (4, "a b c " * 40_000), (5, "ok"), (5, "ok"), (6, "É" * 70_000), (7, "\n".join(["x y", "x y", " ", "x y "])), (None, "a # b")]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n_words int, votes string")
    got = [(r["doc_id"], *(r[c] for c in weak.STATISTICS[:5])) for r in weak.judge(df).collect()]
    assert sorted(got, key=str) == sorted([(i, *counted(t)) for i, t in rows], key=str)
    assert weak.judge(df.where("false")).count() == 0
    one = weak.judge(df, {"short": F.when(F.col("n_words") < 2, -1).otherwise(1)}).collect()
    assert {len(r["votes"]) for r in one} == {1}
    with pytest.raises(ValueError, match="rules"):
        weak.judge(df, {str(i): F.lit(0) for i in range(11)})
