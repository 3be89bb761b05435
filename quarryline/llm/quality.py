"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are of the whole text. Trees are complete binary trees of one depth, flattened into arrays [tree, node], and
rows go down all of them by numpy, level by level. Fitting takes at most ``SAMPLE`` labelled rows, chosen by a hash of the
key; several labels of one key count as their mean, rounded half up, and of several texts of one key the one of least hash is
learned from; null labels are left out. Without any learnable label
every score is 0.5. A null text counts as empty, and an empty text has a score like any other.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, encoded_texts, prepare

SAMPLE, BINS, DEPTH, TREES, RATE, L2, LEAST = 20_000, 64, 4, 80, 0.15, 1.0, 8
STATISTICS = ("bytes", "words", "word_size", "longest", "letters", "upper", "digits", "spaces", "stops", "marks", "symbols", "other", "distinct", "commonest", "doubled", "lines", "line_distinct", "pairs_distinct", "capital_words", "symbol_words", "high", "entropy")
_CLASS = np.zeros((256, 8), bool)
for _i in range(256):
    _c = chr(_i)
    _CLASS[_i] = [_i < 128 and _c.isalpha() or _i >= 192, _i < 128 and _c.isupper(), 48 <= _i < 58, _c in " \t\n\r", _c in ".!?", _c in ",;:'\"-()", _c in "#$%&*+/<=>@[\\]^_`{|}~", _i >= 128]


def statistics(text: bytes) -> list[float]:
    """The STATISTICS of one text; shares of nothing are 0."""
    n = len(text)
    if not n:
        return [0.0] * len(STATISTICS)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters, upper, digits, spaces, stops, marks, symbols, high = (hist @ _CLASS / n).tolist()
    share = hist[hist > 0] / n
    words, lines = text.split(), text.split(b"\n")
    k = max(1, len(words))
    seen = Counter(words)
    pairs = set(zip(words, words[1:], strict=False))
    tails = sum(1 for w in words if w[-1:] in b"#$%&*|~^+=@!")
    caps = sum(map(bytes.isupper, words))
    return [
        np.log1p(n), np.log1p(len(words)), (n - spaces * n) / k, np.log1p(max(map(len, words), default=0)), letters, upper, digits, spaces, stops, marks, symbols,
        1 - min(1.0, letters + digits + spaces + stops + marks + symbols), len(seen) / k, max(seen.values(), default=0) / k, sum(map(eq, words, words[1:])) / k, len(lines) / k,
        len(set(lines)) / len(lines), len(pairs) / k, caps / k, tails / k, high, float(-(share * np.log2(share)).sum()),
    ]


class Forest:
    """feature[tree, node], threshold[tree, node] of inner nodes, leaf[tree, leaf]."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray, base: float):
        self.feature, self.threshold, self.leaf, self.base = feature, threshold, leaf, base

    def score(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            right = x[rows, self.feature[trees, node]] > self.threshold[trees, node]
            node = 2 * node + 1 + right
        total = self.base + self.leaf[trees, node - self.feature.shape[1]].sum(1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Second-order boosting of the logistic loss over histograms of at most BINS bins."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    if not len(y) or y.min() == y.max():
        base = 0.0 if not len(y) else 4.0 if y[0] else -4.0
        return Forest(np.zeros((1, inner), np.int64), np.full((1, inner), np.inf), np.zeros((1, leaves)), base)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.array([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])
    base = float(np.log(y.mean() / (1 - y.mean())))
    total, trees = np.full(len(y), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            first, width = 2**depth - 1, 2**depth
            slot = node - first
            best = np.zeros(width)
            choice = np.full((width, 2), -1)
            for f in range(x.shape[1]):
                at = slot * BINS + binned[f]
                gs, hs, ns = (np.bincount(at, w, width * BINS).reshape(width, BINS).cumsum(1) for w in (g, h, np.ones_like(g)))
                gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                gain = gs**2 / (hs + L2) + (gt - gs) ** 2 / (ht - hs + L2) - gt**2 / (ht + L2)
                gain[(ns < LEAST) | (nt - ns < LEAST)] = -1
                gain[:, len(cuts[f]) :] = -1
                top = gain.argmax(1)
                value = gain[np.arange(width), top]
                better = value > best + 1e-9
                best[better] = value[better]
                choice[better] = np.c_[np.full(width, f), top][better]
            for s in np.flatnonzero(choice[:, 0] >= 0):
                feature[first + s], threshold[first + s] = choice[s, 0], cuts[choice[s, 0]][choice[s, 1]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        slot = node - inner
        leaf = -RATE * np.bincount(slot, g, leaves) / (np.bincount(slot, h, leaves) + L2)
        total += leaf[slot]
        trees.append((feature, threshold, leaf))
    return Forest(*map(np.array, zip(*trees, strict=True)), base)


@arrow_column("array<double>")
def text_statistics(texts: pa.Array) -> pa.Array:
    return pa.array([statistics(x) for x in encoded_texts(texts)], pa.list_(pa.float64()))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text", key: str = "doc_id", label: str = "quality") -> Forest:
    """Fit on at most ``sample`` rows of ``labels``, joined to their texts."""
    known = labels.where(labels[key].isNotNull() & labels[label].isNotNull()).groupBy(labels[key].alias("k")).agg(F.floor(F.avg(labels[label]) + 0.5).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64(F.col("k").cast("string"), F.lit("quality")), "k").limit(sample)
    rows = docs.select(docs[key].alias("k"), docs[text].alias("t")).join(F.broadcast(chosen), "k")  # ``sample`` rows at most
    rows = rows.select("k", "y", F.xxhash64("t").alias("h"), text_statistics("t").alias("x")).groupBy("k", "y").agg(F.min(F.struct("h", "x")).alias("m"))
    rows = rows.select("k", "y", "m.x").collect()
    rows.sort(key=lambda r: (r["k"], r["y"], r["x"]))
    return fit(np.array([r["x"] for r in rows]).reshape(-1, len(STATISTICS)), np.array([r["y"] for r in rows], float))


def score(forest: Forest, spark):
    """A column function: text -> score."""
    shared = spark.sparkContext.broadcast(forest)  # a few arrays of fixed size

    @arrow_column("double", repeats=False)
    def of(texts: pa.Array) -> pa.Array:
        x = np.array([statistics(t) for t in encoded_texts(texts)]).reshape(-1, len(STATISTICS))
        return pa.array(shared.value.score(x))

    return of


def classify(docs: DataFrame, learn_docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", name: str = "quality_score") -> DataFrame:
    """``docs`` with its score in a new column ``name``."""
    prepare(docs.sparkSession)
    return docs.withColumn(name, score(train(learn_docs, labels, text=text, key=key, label=label), docs.sparkSession)(docs[text]))
