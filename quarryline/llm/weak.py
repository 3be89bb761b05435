"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation says how far each is to be believed.

A rule is a column over the statistics of a whole text: 1 says good, -1 bad, 0 abstains, which says nothing. Documents that vote
alike are one pattern, so Spark counts patterns, of which there are 3 ** rules at most whatever the table's size, and the
estimation goes over patterns. It has two classes, and for each rule and class the chances of its votes, hence its accuracy. A
document is kept if the posterior chance of the good class is KEEP or more.

Votes alone can't say whether a vote that no other rule shares is right: junk of one kind is often seen by one rule, and then every
belief about that rule agrees with its votes. So the estimate is the most likely one under a stated belief (START), that a vote
against a document is seldom wrong, one for it says little, and most documents are good (PRIOR); the belief weighs TRUST times as
much as the documents themselves. A rule whose
votes turn out to point the wrong way says nothing.

Words are runs without ASCII white space. A null text counts as empty: all statistics are 0, rules that divide by nothing abstain.
Every row is judged, repeated rows and null keys each by their own text. No rows, no rows.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, encoded_texts, prepare, stored, struct_of

KEEP, TRUST, PRIOR, ROUNDS, RULES = 0.5, 1.0, 0.9, 500, 10
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_lower", "n_calls", "n_letters")
START = np.array([[0.3, 0.4, 0.3], [0.002, 0.598, 0.4]])  # of the bad and the good class: chances of the votes -1, 0, 1
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_LATER, _WIDE, _WHITE, _SYMBOLS = bytes(range(0x80, 0xC0)), bytes(range(0xC0, 0x100)), b" \t\n\x0b\x0c\r", b"#*$%&|<>"
_KIND = pa.schema([(name, pa.int64()) for name in STATISTICS])


def repeated_words(ids: np.ndarray) -> int:
    """How many places are in a window of three that is there twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    pairs = ids[:-1] * n + ids[1:]
    if n >= 1 << 21:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * n + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    first = order[np.r_[same, False] | np.r_[False, same]]
    inside = np.zeros(n, bool)
    for i in range(3):
        inside[first + i] = True
    return int(inside.sum())


def statistics(text: bytes) -> tuple[int, ...]:
    """The STATISTICS of one text."""
    size = len(text)
    of = lambda some: size - len(text.translate(None, some))
    words = text.split()
    seen: dict = {}
    ids = np.fromiter(map(seen.setdefault, words, count()), np.int64, len(words))
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    upper, lower, wide = of(_UPPER), of(_LOWER), of(_WIDE)
    return len(words), size - of(_LATER) - of(_WHITE), of(_SYMBOLS), len(lines) - len(set(lines)), repeated_words(ids), len(lines), len(seen), upper, lower, text.count(b"!"), upper + lower + wide


@arrow_column(f"struct<{','.join(f'{name}:long' for name in STATISTICS)}>", repeats=False)
def text_statistics(texts: pa.Array) -> pa.Array:
    rows = [statistics(t) for t in encoded_texts(texts)]
    return struct_of(_KIND, list(zip(*rows, strict=True)) if rows else [[]] * len(_KIND))


def vote(bad: Column, good: Column | None = None) -> Column:
    """-1, 1 or 0; a condition that is null isn't met."""
    against = F.when(bad, -1)
    return (against if good is None else against.when(good, 1)).otherwise(0)


def _share(part: str, of: Column | str) -> Column:
    of = F.col(of) if isinstance(of, str) else of
    return F.when(of > 0, F.col(part) / of)


def standard_rules() -> dict[str, Column]:
    """Votes that ask for no language. Few distinct words say something about texts of up to a thousand words only."""
    size, letters = _share("word_chars", "n_words"), _share("n_letters", "word_chars")
    return {
        "symbols": vote(_share("n_symbols", "n_words") > 0.1),
        "repeats": vote(_share("n_repeat_words", "n_words") > 0.35),
        "distinct": vote((_share("n_distinct", "n_words") < 0.35) & (F.col("n_words") <= 1000)),
        "lines": vote(_share("n_dup_lines", "n_lines") > 0.4),
        "upper": vote(_share("n_upper", F.col("n_upper") + F.col("n_lower")) > 0.35),
        "calls": vote(_share("n_calls", "n_words") > 0.3),
        "size": vote(size < 2.5, (size > 3.5) & (size < 8)),
        "letters": vote(letters < 0.5, letters > 0.8),
    }


class Model:
    """``prior``: the share of good documents; ``chance[rule, class, vote + 1]``, class 0 bad and 1 good."""

    def __init__(self, prior: float, chance: np.ndarray):
        self.prior, self.chance = prior, chance

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """votes[row, rule] -> the chance of the good class."""
        says = np.log(self.chance[:, 1]) - np.log(self.chance[:, 0])
        says[:, 1] = 0
        ratio = says[np.arange(votes.shape[1])[None, :], votes + 1].sum(1) + np.log(self.prior) - np.log1p(-self.prior)
        return 1 / (1 + np.exp(-np.clip(ratio, -700, 700)))

    @property
    def accuracy(self) -> np.ndarray:
        """Of each rule and class the share of right votes among those that it cast."""
        cast = self.chance[:, :, [0, 2]]
        return np.stack([cast[:, 0, 0], cast[:, 1, 1]], 1) / cast.sum(2)


def estimate(votes: np.ndarray, n: np.ndarray) -> Model:
    """Expectation-maximisation over patterns votes[row, rule], each of n documents, until nothing moves or ROUNDS."""
    cast = np.eye(3)[votes + 1]
    model = Model(PRIOR, np.repeat(START[None], votes.shape[1], 0))
    for _ in range(ROUNDS):
        good = model.posterior(votes)
        weight = np.stack([(1 - good) * n, good * n])
        docs = weight.sum(1)
        belief = 1 + TRUST * docs
        chance = (np.einsum("cp,prv->rcv", weight, cast) + belief[:, None] * START) / (docs + belief)[:, None]
        for v, right in ((0, 0), (2, 1)):  # a vote that is likelier in the wrong class says nothing
            wrong = chance[:, right, v] < chance[:, 1 - right, v]
            chance[wrong, :, v] = chance[wrong, :, v].mean(1, keepdims=True)
        total = docs.sum()
        prior = float((docs[1] + (1 + TRUST * total) * PRIOR) / (1 + total + TRUST * total))
        still = abs(prior - model.prior) + np.abs(chance - model.chance).max(initial=0) < 1e-9
        model = Model(prior, chance)
        if still:
            break
    return model


def pattern(votes: list[Column]) -> Column:
    """One number for all votes of a row."""
    return sum(((v + 1) * 3**i for i, v in enumerate(votes)), F.lit(0)).cast("int")


def votes_of(patterns: np.ndarray, rules: int) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(rules) % 3 - 1


def judge(docs: DataFrame, rules: dict[str, Column] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, STATISTICS, votes (array by rule), quality_probability. ``rules`` are columns over the STATISTICS, 10 at most (RULES)."""
    spark = docs.sparkSession
    prepare(spark)
    rules = rules or standard_rules()
    if len(rules) > RULES:
        raise ValueError(f"more than {RULES} rules")
    read = docs.select(docs[key].alias("key"), text_statistics(docs[text]).alias("s")).select("key", "s.*")
    voted = stored(read.withColumn("pattern", pattern(list(rules.values()))), "votes")
    counted = voted.groupBy("pattern").agg(F.count("*").alias("n")).collect()  # 3 ** rules rows at most
    patterns = np.array([r["pattern"] for r in counted], np.int64)
    votes = votes_of(patterns, len(rules))
    model = estimate(votes, np.array([r["n"] for r in counted], np.float64))
    told = spark.createDataFrame([(int(p), v, float(q)) for p, v, q in zip(patterns, votes.tolist(), model.posterior(votes), strict=True)], "pattern int, votes array<int>, quality_probability double")
    return voted.join(F.broadcast(told), "pattern").select(F.col("key").alias(key), *STATISTICS, "votes", "quality_probability")


def base_failed() -> Column:
    """Too few words, or too many in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def kept(probability: str = "quality_probability") -> Column:
    return ~base_failed() & (F.col(probability) >= KEEP)
