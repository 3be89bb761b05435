"""URL filter by rules on host and path, in DataFrame operations only.

A rule is a host and a path prefix with a verdict; it fits its host and all subdomains where the url's path starts with
its path, and the longest fitting rule decides. Listed canonical urls (host and path) are looked up by a blocked Bloom
filter: every url's (host suffix, path prefix) keys are hashed once, one 64-bit block is read, and only keys whose bits are
all set go on to an exact hash join, which removes the false positives. Path prefixes are tried only at lengths that some
rule has. Urls without a possible hit get the default verdict where they are read; only the others are shuffled. The Bloom
filter has at most ``MAX_BLOCKS`` blocks whatever the list's size, so it goes with the plan as one array that all rows share: past
that more keys reach the join, but the result is the same. The join is Spark's choice by the rules' size, so a long list is
shuffled, not broadcast.

A url that is null or has no ``://`` has an empty host and path and fits no rule. Equal urls are judged once. With no
rules every url gets the default verdict. Of rules with equal host and path the first verdict in sorted order counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BLOCKS, KEYS_PER_BLOCK, HASHES = 1 << 17, 8, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _bits(h: Column) -> Column:
    """HASHES bits of a block's word, from the low bits of a hash."""
    out = F.lit(0).cast("long")
    for i in range(HASHES):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int")))
    return out


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 6 * HASHES), F.lit(blocks)).cast("int")


def bloom_words(keys: DataFrame, blocks: int) -> list[int]:
    """The filter of ``keys(h)``: one long for each block, at most MAX_BLOCKS in all, so small enough for the driver."""
    words = [0] * blocks
    for r in keys.groupBy(_block(F.col("h"), blocks).alias("b")).agg(F.bit_or(_bits(F.col("h"))).alias("w")).collect():
        words[r["b"]] = r["w"]
    return words


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """``urls`` with new columns host, path, rule, verdict. ``rules``: host, path, verdict.

    Columns of these names in ``urls`` are replaced.
    """
    parts = rules.select(F.lower("host").alias("host"), "path", "verdict").where("host is not null and path is not null")
    parts = parts.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    keyed = parts.select(F.xxhash64("host", "path").alias("h"), F.length("path").alias("n"))
    n_rules = keyed.count()
    rest = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    whole = urls.select(*rest, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    if not n_rules:
        return whole.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    lengths = sorted(r["n"] for r in keyed.select("n").distinct().collect())
    blocks = min(MAX_BLOCKS, max(1, n_rules // KEYS_PER_BLOCK))
    words = F.lit(bloom_words(keyed, blocks))
    names = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path")), lambda n: F.col("path").substr(F.lit(1), n))
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("h"), p.alias("p"), F.xxhash64(h, p).alias("x")))))
    hits = F.filter(keys, lambda k: F.element_at(words, _block(k["x"], blocks) + 1).bitwiseAND(_bits(k["x"])) == _bits(k["x"]))
    possible = F.exists(keys, lambda k: F.element_at(words, _block(k["x"], blocks) + 1).bitwiseAND(_bits(k["x"])) == _bits(k["x"]))
    some = whole.where((F.col("host") != "") & possible)
    met = some.select("host", "path").distinct().select("host", "path", F.explode(hits).alias("k"))
    exact = met.join(parts.select(F.col("host").alias("rh"), F.col("path").alias("rp"), F.col("verdict").alias("rv")), (F.col("k.h") == F.col("rh")) & (F.col("k.p") == F.col("rp")))
    size = F.length("rh") + F.length("rp")
    best = exact.groupBy("host", "path").agg(F.max(F.struct(size.alias("n"), F.length("rh").alias("hn"), F.concat("rh", "rp").alias("rule"), "rv")).alias("best"))
    best = best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.rv").alias("found"))
    plain = whole.where(~((F.col("host") != "") & possible)).select("*", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("found"))
    judged = some.join(best, ["host", "path"], "left").select(*whole.columns, "rule", "found").unionByName(plain)
    return judged.select(*rest, "host", "path", "rule", F.coalesce("found", F.lit(default)).alias("verdict"))
