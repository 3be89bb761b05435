"""Every training-data operator against a brute-force version, a library or a round trip, and on odd input."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quarryline.llm import bpe, htmltext, langid, media, packing, quality, queries, simhash, tokenio, urlfilter, vafile
from .brute_html import clean
from quarryline.llm.pretokens import library_encoder, rows_of
from quarryline.llm.webp import choose, decode, encode

SF = "/root/testdata/sf0.001"
LONG = "word and more, " * 20000
ODD = [None, "", " ", "one", "a b c", "x" * 3000, "Tab\tand\r\nline", "  two  spaces ", "déjà vu — 日本語 text 123!", "same text here now", "same text here now", "\x00\x02 odd", "don't <|endoftext|> it's", LONG]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, queue string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeats, and extra columns whose names clash."""
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "a"][i % 2], None, 0.5, "k", "q") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, (None, "no id", None, None, None, None, None, None)], DOCS).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(df):
    return {r["doc_id"]: r["text"] or "" for r in df.collect()}


# --- op1


def slow_print(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", text.encode().lower())
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    counts = [0] * 64
    for s in shingles:
        for b in range(64):
            counts[b] += xxhash.xxh64_intdigest(s, 42) >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles)) if shingles else 0


def slow_components(prints):
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_query(spark, docs):
    got = queries.op1_simhash(spark, SF).collect()
    texts = texts_of(docs)
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: f"{slow_print(t):016x}" for i, t in texts.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == slow_components({r["doc_id"]: int(r["fingerprint"], 16) for r in got})


@pytest.mark.parametrize("bucket", [4096, 6])
def test_links_of_dense_groups(spark, bucket, monkeypatch):
    """Chains and dense groups; with tiny buckets all go through finer keys and blocks."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 6)]
    prints = {x ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for x in base for _ in range(30)} | {0, 2**64 - 1}
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in prints], "fp long")
    edges = {(r["u"], r["v"]) for r in simhash.links(df).collect()}
    unsigned = lambda x: x & (2**64 - 1)
    want = slow_components({x: x for x in prints})
    root = {x: x for x in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(unsigned(u)), find(unsigned(v))
        root[max(a, b)] = min(a, b)
        assert want[unsigned(u)] == want[unsigned(v)]
    assert {x: find(x) for x in prints} == want


def test_simhash_odd(spark, odd):
    near = simhash.near_duplicates(odd).collect()
    assert len(near) == len(ODD) + 1
    by = {r["doc_id"]: r for r in near}
    assert by[0]["fp"] == by[1]["fp"] == by[2]["fp"] == 0 and by[2]["component_id"] == 0
    assert by[10]["component_id"] == by[9]["component_id"] == 9
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 10").count() == 0 and kept.where("doc_id is null").count() == 1
    assert simhash.near_duplicates(odd.where("false")).count() == 0 and simhash.keep_one(odd.where("false")).count() == 0
    twice = odd.where("doc_id = 3").unionByName(odd.where("doc_id = 3"))
    assert simhash.keep_one(twice).count() == 1


# --- op2


def test_url_filter_rules_of_the_contract(spark, tmp_path):
    rows = [(1, "http://a.net/de/1"), (2, "http://www.example.net/de/7"), (3, "http://www.example.net/de/8x"), (4, "http://b.com/en/1"), (5, "http://example.com/en/7"), (6, "http://c.org/es/"), (7, "http://c.org/de/")]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in queries.op2_url_filter(spark, str(tmp_path)).collect()}
    assert got == {1: ("net/de/", "allow"), 2: ("net/de/", "allow"), 3: ("example.net/de/8", "block"), 4: ("com/en/", "block"), 5: ("example.com/en/7", "allow"), 6: ("org/es/", "block"), 7: (None, "allow")}


def test_url_filter_odd(spark):
    urls = [None, "", "no scheme/en/7", "HTTP://A.EXAMPLE.COM/en/7x?q", "http://example.com/en/", "https://com/en/1#f", "x://b.net", "x://b.net/de/", "http://notcom/en/", "a://u://example.com/en/7", "http://xexample.com/en/7"]
    rows = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)] * 2, "page_id long, url string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(rows, spark.createDataFrame(queries.RULES, "host string, path string, verdict string")).collect()}

    def slow(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host = m[1].translate(str.maketrans(urlfilter.UPPER, urlfilter.LOWER)) if m else ""
        path = m[2] if m else ""
        fits = [(len(h) + len(p), h + p, v) for h, p, v in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))

    assert got == {i: slow(u) for i, u in enumerate(urls)}
    assert urlfilter.judge(rows, spark.createDataFrame([], "host string, path string, verdict string")).where("verdict = 'allow'").count() == rows.count()
    assert urlfilter.judge(rows.where("false"), spark.createDataFrame(queries.RULES, "host string, path string, verdict string")).count() == 0


def test_bloom_has_no_false_negatives(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "MAX_BLOCKS", 2)
    rules = spark.range(500).select(F.concat(F.lit("h"), "id", F.lit(".org")).alias("host"), F.lit("/").alias("path"), F.lit("block").alias("verdict"))
    urls = spark.range(1000).select("id", F.concat(F.lit("http://www.h"), "id", F.lit(".org/x")).alias("url"))
    assert urlfilter.judge(urls, rules).where("verdict = 'block'").count() == 500


def test_long_list_of_rules(spark):
    """Forty thousand rules of several path lengths: every url is judged as a dictionary of the rules says."""
    rules = [(f"h{i}.org", "/" + "p" * (i % 4), "block" if i % 3 else "allow") for i in range(40_000)]
    urls = [f"https://{'www.' if i % 2 else ''}h{i}.{'org' if i % 5 else 'net'}/{'p' * (i % 6)}" for i in range(0, 50_000, 7)]
    got = urlfilter.judge(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"))
    by = {(h, p): v for h, p, v in rules}
    for r in got.collect():
        host = r["host"].removeprefix("www.")
        fits = [p for p in ("/ppp", "/pp", "/p", "/") if r["path"].startswith(p) and (host, p) in by]
        assert (r["rule"], r["verdict"]) == ((host + fits[0], by[host, fits[0]]) if fits else (None, "allow"))


def test_native_plan(spark):
    plan = queries.op2_url_filter(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- op3, op4


def test_quality_holds_out(spark):
    got = queries.op3_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 and 0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.95


def test_quality_odd(spark, odd):
    labels = spark.createDataFrame([(3, 1), (3, 1), (4, 0), (5, None), (None, 1)], "doc_id long, quality int")
    assert quality.classify(odd, odd, labels).where("quality_score between 0 and 1").count() == len(ODD) + 1
    none = quality.classify(odd, odd, labels.where("false"))
    assert {r["quality_score"] for r in none.collect()} == {0.5}
    assert quality.classify(odd.where("false"), odd, labels).count() == 0


def test_flat_trees_match_recursion():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    forest = quality.fit(x, ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float))

    def walk(t, row):
        node = 0
        for _ in range(quality.DEPTH):
            node = 2 * node + (2 if row[forest.feature[t, node]] > forest.threshold[t, node] else 1)
        return forest.leaf[t, node - forest.feature.shape[1]]

    total = forest.base + np.array([sum(walk(t, r) for t in range(len(forest.feature))) for r in x[:40]])
    assert np.allclose(forest.score(x[:40]), 1 / (1 + np.exp(-total)))
    assert np.mean((forest.score(x) > 0.5) == ((x[:, 0] > 0) ^ (x[:, 1] > 0))) > 0.95


def test_forward_sums_all_segmentations():
    v = langid.pieces(queries.vocabulary("piece_bpe_32k.model"))
    rng = np.random.default_rng(0)
    prob = rng.dirichlet(np.ones(v.n), 2).T
    place = {}
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    texts = sorted({sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))})
    place = {t: i for i, t in enumerate(texts)}

    def slow(word):
        if not word:
            return np.ones(2)
        total = np.zeros(2)
        for k in range(1, len(word) + 1):
            if word[:k] in place:
                total += prob[place[word[:k]]] * slow(word[k:])
            elif k == 1:
                total += langid.OUTSIDE * slow(word[1:])
        return total

    for word in ("the", "straße", "q\U0001f600z"):
        assert np.allclose(langid.word_scores([word], v, prob)[0], np.log(slow(langid.MARK + word)))


def test_long_words_are_summed_whole():
    v = langid.pieces(queries.vocabulary("piece_bpe_32k.model"))
    rng = np.random.default_rng(1)
    prob = rng.random((v.n, 3))
    prob /= prob.sum(0)
    words = ["".join(rng.choice(list("theanionré日本語zq"), n)) for n in (31, 32, 33, 48, 79, 200, 1, 24 * 40)] + ["x" * 5000]
    got = langid.word_scores(words, v, prob)
    for w, mine in zip(words, got, strict=True):
        word, scale = langid.MARK + w, np.zeros(3)
        spans, sums = v.spans([word]), [np.ones(3)]
        for end in range(1, len(word) + 1):
            ids = spans[end, 1 : min(end, v.longest) + 1, 0]
            new = sum((sums[-k] * prob[i] for k, i in enumerate(ids, 1) if i >= 0), np.zeros(3)) + (sums[-1] * langid.OUTSIDE if ids[0] < 0 else 0)
            scale += np.log(new)
            sums = [x / new for x in [*sums[-v.longest :], new]]
        assert np.allclose(mine, np.log(sums[-1]) + scale)


def test_langid_holds_out(spark):
    got = queries.op4_langid(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").where("held_out and lang is not null").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.98


def test_fit_and_prediction_lower_alike(spark):
    """Where Python's and Arrow's lower case differ, words learned are the words looked up."""
    texts = ["İSTANBUL ΟΔΟΣ Straße", " ǅ  İİ "]
    rows = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    seen = {r["word"] for r in langid.word_counts(rows, "text", "lang").collect()}
    assert seen == {langid.MARK + w for some in langid.words_of(langid.pa.array(texts)).to_pylist() for w in some if w}


def test_langid_odd(spark, odd):
    got = {r["doc_id"]: r["langid"] for r in langid.identify(odd, odd, queries.vocabulary("piece_bpe_32k.model")).collect()}
    assert got[0]["lang_pred"] == got[1]["lang_pred"] == "und" and got[0]["score"] == 0 and got[3]["lang_pred"] in ("en", "fr")
    none = langid.identify(odd, odd.where("false"), queries.vocabulary("piece_bpe_32k.model"))
    assert {r["langid"]["lang_pred"] for r in none.collect()} == {"und"}


# --- op5


def pictures():
    rng = np.random.default_rng(0)
    full, few = rng.integers(0, 2**32, (13, 17), dtype=np.uint32), rng.integers(0, 5, (20, 30)).astype(np.uint32) * 7919 + 0xFF000000
    yield full, {}
    yield full, {"transforms": (("green",),)}
    yield full, {"transforms": (("cross", 2, rng.integers(0, 2**24, (4, 5))),)}
    yield full, {"transforms": (("predictor", 2, np.arange(20).reshape(4, 5) % 14), ("cross", 3, rng.integers(0, 2**24, (2, 3))), ("green",))}
    for n in (1, 2, 4, 16, 17, 200):
        yield rng.integers(0, n, (20, 30)).astype(np.uint32) * 7919, {"transforms": (("palette",),), "cache_bits": 3, "copies": True}
    yield few, {"cache_bits": 5}
    yield few, {"copies": True}
    yield few, {"cache_bits": 4, "copies": True, "meta": 2}
    yield np.zeros((40, 40), np.uint32), {"copies": True}
    y, x = np.indices((70, 90))
    for k in (1, 50):  # smooth colours: predictors and cross-colour pay
        ramp = (3 * x + y + rng.integers(0, k, (70, 90))) & 255
        slow = (0xFF000000 | ramp << 16 | ((ramp * 2) & 255) << 8 | (ramp // 2 + y) & 255).astype(np.uint32)
        yield slow, choose(slow)
    for mode in range(14):
        yield full, {"transforms": (("predictor", 3, np.full((2, 3), mode)),)}
    yield rng.integers(0, 2**8, (100, 64)).astype(np.uint32) << 8, choose(rng.integers(0, 2**8, (100, 64)).astype(np.uint32) << 8)
    yield full[:1, :1], choose(full[:1, :1])
    yield np.tile(full, (9, 9)), choose(np.tile(full, (9, 9)))
    yield rng.integers(0, 2**32, (700, 300), dtype=np.uint32), {"cache_bits": 11, "copies": True}  # several blocks of bytes


@pytest.mark.parametrize("case", range(33))
def test_webp_round_trip(case):
    pixels, options = list(pictures())[case]
    assert (decode(encode(pixels, **options)) == pixels).all()


def test_webp_refuses():
    good = encode(np.zeros((4, 4), np.uint32))
    for bad in (b"", good[:24], b"RIFX" + good[4:]):
        with pytest.raises(ValueError):
            decode(bad)


def test_media_odd(spark, odd):
    got = {r["doc_id"]: r for r in media.read_features(media.store_texts(odd)).collect()}
    for i, t in enumerate(ODD):
        data = (t or "").encode()
        padded = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert got[9]["media_sha256"] == got[10]["media_sha256"] and got[9]["feature"] == got[10]["feature"]
    big = bytes(range(256)) * 8000
    assert media.from_pictures(media.to_pictures(big)[1], len(big))[0] == big


def test_features_that_stored_texts_use(spark):
    """What the encoder takes on the table's texts, and that the colour features are taken where they pay."""
    from quarryline.llm import webp

    used = {"copies": 0, "palette": 0, "none": 0}
    texts = [(r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [b"ab" * 900, b"tea " * 40]
    for t in texts:
        size, media_ = media.to_pictures(t)
        samples = np.frombuffer(t.ljust(size, b"\0"), np.uint8)
        kinds = [k for k, *_ in webp.choose((0xFF000000 | samples.astype(np.uint32) << 8).reshape(-1, 64))["transforms"]]
        copies = len(webp.repeats(samples)[0]) > 0
        used["copies"] += copies
        used["palette"] += "palette" in kinds
        used["none"] += not copies and not kinds
        assert len(media_) < max(400, 0.8 * size)
    assert used["copies"] > 0.8 * len(texts) and used["palette"] >= 2 and used["none"] < 0.2 * len(texts)
    y, x = np.indices((64, 64))
    ramp = (2 * x + 3 * y) & 255
    smooth = (0xFF000000 | ramp << 16 | (ramp // 2 + x) << 8 & 0xFF00 | ramp).astype(np.uint32)
    kinds = {k for k, *_ in webp.choose(smooth)["transforms"]}
    assert "predictor" in kinds and len(webp.encode(smooth, **webp.choose(smooth))) < 0.3 * smooth.nbytes
    noise = np.random.default_rng(0).integers(0, 128, (64, 64))
    tinted = (0xFF000000 | (noise * 3 // 4 + noise.T % 4) << 16 | noise << 8 | noise // 2).astype(np.uint32)
    assert "cross" in {k for k, *_ in webp.choose(tinted)["transforms"]}
    some = np.random.default_rng(1).integers(0, 2**24, 400)
    few = (0xFF000000 | some[np.random.default_rng(2).integers(0, 400, (90, 90))]).astype(np.uint32)
    assert webp.choose(few)["cache_bits"] or len(np.unique(few)) <= 256


# --- op6


def slow_top(rows, k, every):
    out = []
    for qi in {i for i, v in rows if i is not None and i % every == 0 and v is not None}:
        for q in [v for i, v in rows if i == qi][:1]:
            scored = sorted((-int(np.dot(q, v)), i) for i, v in rows if v is not None and i is not None and i != qi and len(v) == len(q))[:k]
            out += [(qi, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def test_top_k_query(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = [(r["vec_id"], np.floor(256 * np.array(r["embedding"], float)).astype(int)) for r in e]
    assert sorted(map(tuple, queries.op6_topk(spark, SF).collect())) == slow_top(rows, 5, 50)


def test_top_k_odd(spark, monkeypatch):
    monkeypatch.setattr(vafile, "CHUNK", 7)
    monkeypatch.setattr(vafile, "QUERIES", 2)
    rng = np.random.default_rng(0)
    vectors = [rng.normal(size=4).tolist() for _ in range(40)] + [[0.5, 0.5, 0.5, 0.5]] * 20 + [None, [], [1.0, None, 2.0, 3.0], [float("nan")] * 4, [float("inf")] * 4, [1.0, 2.0]]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)] + [(None, [1.0] * 4, "x"), (3, vectors[3], "x")], "vec_id long, embedding array<float>, score string")
    rows = [(r["vec_id"], np.floor(256 * np.array(r["embedding"], float)).astype(int)) for r in df.collect() if r["embedding"] and all(c is not None and np.isfinite(c) for c in r["embedding"])]
    assert sorted(map(tuple, vafile.top_k(df, every=10).collect())) == slow_top(rows, 5, 10)
    assert vafile.top_k(df.where("false")).count() == 0


@pytest.mark.parametrize("size", [2.0**23, 2.0**31, 2.0**45])
def test_topk_of_large_components_is_exact(spark, size):
    """Products past 2^53 and past 2^63, in one table with small vectors."""
    rng = np.random.default_rng(int(size) % 97)
    x = np.floor(rng.normal(size=(120, 6)) * size)
    x[::3] = np.floor(rng.normal(size=(40, 6)) * 4) / 4
    x[7] = x[8] = 0
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    whole = [[int(c * 256) for c in v] for v in x]
    scores = {i: sorted((-sum(a * b for a, b in zip(whole[i], whole[j], strict=True)), j) for j in range(120) if j != i)[:5] for i in range(0, 120, 10)}
    want = [(i, r, j, -s) for i, some in scores.items() for r, (s, j) in enumerate(some, 1)]
    if all(-(2**63) <= s < 2**63 for *_, s in want):
        assert sorted(map(tuple, vafile.top_k(df, every=10).collect())) == want
    else:
        with pytest.raises(Exception, match="an inner product is beyond a long"):
            vafile.top_k(df, every=10).collect()


def test_topk_names_components_beyond_a_long(spark):
    df = spark.createDataFrame([(0, [1e300]), (1, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="a component times the scale is beyond a long"):
        vafile.top_k(df).collect()
    df = spark.createDataFrame([(0, [9e6, 1.0]), (50, [2.0, 1.0]), (51, [-(2.0**55 - 8), 2.0**55 - 8])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, vafile.top_k(df, k=1).collect())) == [(0, 1, 50, 9 * 10**6 * 256 * 512 + 256 * 256), (50, 1, 0, 9 * 10**6 * 256 * 512 + 256 * 256)]


# --- op7

PAGE = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><header>Site</header><nav><ul><li><a href='/a'>A</a></ul></nav><div class=\"cookie-notice\">We use cookies</div><!-- c --><article><h1>Head &amp; more</h1><p><b>One<br>two<p>Three\n  four &lt;x&gt; &#233;</p><aside>side</aside><form><input>f</form><div class=ad>buy</div><div id='comments'><p>nice</p></div></article><footer>&copy; x</footer>"


def test_html_structure():
    kept = clean([htmltext.blocks_of(PAGE)])[0]
    assert kept == ["Head & more", "One two", "Three four <x> é"]
    assert htmltext.blocks_of("") == [] and clean([[]]) == [[]]
    assert clean([htmltext.blocks_of("<p>a<p>b &am c")])[0] == ["a", "b &am c"]


def test_html_marks():
    text = lambda page: clean([htmltext.blocks_of(page)])[0]
    assert text("<article><p>a <span class='ad'>buy</span> b <a class='nav-link'>c</a><p hidden>no<article class='comment'><p>nice</article></article>") == ["a b c"]
    assert text("<div class=ad>buy<article><h1>T</h1><p>x") == ["T", "x"]
    assert text("<main><section class='related'>r</section><p>x</p><button>go</button><table><tr><td>1<td>2</table></main>") == ["x", "1", "2"]
    assert text("<div class='post-comments'>c</div><div class='post main'>x</div><div role=banner>b</div>") == ["x"]
    assert text("<article><header><h1>T</h1></header><p>x<footer>f</footer><figure><figcaption>cap</figcaption></figure></article>") == ["T", "x", "cap"]


def test_suffix_array_removes_repeats_of_unmarked_blocks():
    boiler = " ".join(f"w{i}" for i in range(30))
    pages = [f"<div>{boiler}</div><div>own text of page {i} that no other page has at all in this host {i}</div>" for i in range(4)]
    assert all(len(k) == 1 and k[0].startswith("own text") for k in clean([htmltext.blocks_of(p) for p in pages]))
    copies = [f"<article><p>{boiler}</p></article>"] * 3
    assert clean([htmltext.blocks_of(p) for p in copies]) == [[boiler]] * 3


def random_pages(n: int, seed: int) -> list[str]:
    """Pages of a few passages in every zone, with words of their own in between."""
    rng = np.random.default_rng(seed)
    passages = [" ".join(rng.choice(list("abcdefgh"), rng.integers(10, 40))) for _ in range(6)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.integers(0, 5)):
            text = " ".join([*(f"own{i}" for _ in range(rng.integers(0, 3))), passages[rng.integers(6)], *(f"own{i}x{k}" for k in range(rng.integers(0, 20)))])
            parts.append((f"<div>{text}</div>", f"<article><p>{text}</article>", f"<nav>{text}</nav>")[rng.choice(3, p=(0.6, 0.15, 0.25))])
        out.append("".join(parts))
    return out


def by_spark(spark, pages, hosts=None):
    rows = [(i, f"http://{hosts[i] if hosts else 'h'}/{i}", p) for i, p in enumerate(pages)]
    got = {r["page_id"]: r["text"] for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    return [got[i] for i in range(len(pages))]


@pytest.mark.parametrize("part,known", [(20_000, 1 << 22), (3, 1)])
def test_repeats_of_a_host_match_brute_force(spark, monkeypatch, part, known):
    monkeypatch.setattr(htmltext, "PART", part)
    monkeypatch.setattr(htmltext, "KNOWN", known)
    monkeypatch.setattr(htmltext, "TASK", 40)
    pages = random_pages(60, 1) + random_pages(60, 1)[:5]
    hosts = ["a" if i % 3 else "b" for i in range(len(pages))]
    got = by_spark(spark, pages, hosts)
    for h in "ab":
        some = [i for i in range(len(pages)) if hosts[i] == h]
        want = clean([htmltext.blocks_of(pages[i]) for i in some])
        assert [got[i] for i in some] == ["\n".join(x) for x in want]
    assert got != ["\n".join(t for z, t in b if z == htmltext._wanted(b)) for b in map(htmltext.blocks_of, pages)]


def test_repeats_are_found_on_two_pages_of_a_large_host(spark):
    rng = np.random.default_rng(5)
    pages = ["<div>" + " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, 4000)) + "</div>" for _ in range(60)]  # over 3 MB
    run = " ".join(f"r{i}" for i in range(400))
    for i in (7, 51):
        pages[i] += f"<div>{run}</div>"
    got = by_spark(spark, pages)
    assert not any("r17 " in x for x in got) and all(len(x.split()) == 4000 for x in got)


def test_raw_elements_end_at_their_own_tag_only():
    text = lambda page: clean([htmltext.blocks_of(page)])[0]
    for raw in ("<script>for(i=0;i<n;i++){x()}</script>", "<script>if(a<b && s==\"it's\")</script>", "<style>a>b{content:'<x'}</style>", "<script>'</p><b>'</SCRIPT >", "<textarea><p>no</textarea>", "<svg><text>no</text></svg>"):
        assert text(f"{raw}<article>{raw}<p>Hello world{raw}</p></article>") == ["Hello world"]
    assert text("<p>a<script>b<p>c") == ["a"] and text("<p>a<svg>b<p>c") == ["a b".replace(" ", ""), "c"]


def test_html_odd(spark):
    rows = spark.createDataFrame([(1, None, None, "z"), (2, "http://a.b/c", "", "z"), (3, "http://a.b/c", PAGE, "z"), (3, "http://a.b/c", PAGE, "z"), (None, "x", "<p>hi", "z"), (5, "y", "<p>" + LONG, "z")], "page_id long, url string, html string, host string")
    got = htmltext.main_text(rows).collect()
    assert len(got) == 6 and {r["text"] for r in got if r["page_id"] in (1, 2)} == {""}
    assert {r["n_chars"] for r in got if r["page_id"] == 5} == {len(LONG.strip())}
    assert htmltext.main_text(rows.where("false")).count() == 0


# --- op8, op9, op10


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.vocabulary("byte_bpe_50k.tiktoken"), "rb"))}  # noqa: SIM115
    return tiktoken.Encoding("own", pat_str=queries.pattern(), mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_encoders_match(reference):
    rng = np.random.default_rng(0)
    texts = [t or "" for t in ODD] + ["".join(rng.choice(list("abc  \n\té1.!'sSé -"), 60)) for _ in range(400)] + ["ab" * 900, "a" * 2500, "é" * 1500, " \n x", "x\n", "a\u00a0b \u3000c"]
    own, lib = bpe.codec(queries.vocabulary("byte_bpe_50k.tiktoken"), queries.pattern()), library_encoder(queries.vocabulary("byte_bpe_50k.json"))
    for t, a, b in zip(texts, rows_of(*own.encode_chunks(pa.array(texts))), rows_of(*lib(pa.array(texts))), strict=True):
        want = reference(t)
        assert a.tolist() == want and b.tolist() == want and own.decode(a) == t.encode()


def test_cache_starts_anew(reference, monkeypatch):
    from quarryline.llm import chunkcache, pretokens

    monkeypatch.setattr(chunkcache, "CACHE_CHUNKS", 50)
    lib = pretokens.library_encoder.__wrapped__(queries.vocabulary("byte_bpe_50k.json"))
    for k in range(20):
        texts = [f"word{k}x{i} and the rest, of it." for i in range(12)]
        assert [x.tolist() for x in rows_of(*lib(pa.array(texts)))] == [reference(t) for t in texts]


def test_cache_tells_clashing_hashes_apart(reference, monkeypatch):
    from quarryline.llm import chunkcache, pretokens

    monkeypatch.setattr(chunkcache, "_MIX", np.zeros_like(chunkcache._MIX))
    lib = pretokens.library_encoder.__wrapped__(queries.vocabulary("byte_bpe_50k.json"))
    for k in range(3):
        texts = [f"word{k}x{i} and the rest, of it. {'long' * 20}" for i in range(12)]
        assert [x.tolist() for x in rows_of(*lib(pa.array(texts)))] == [reference(t) for t in texts]


def test_bpe_odd(spark, odd, reference):
    got = {r["doc_id"]: r for r in bpe.encode_documents(odd, queries.vocabulary("byte_bpe_50k.tiktoken"), queries.pattern()).collect()}
    for i, t in enumerate(ODD):
        ids = reference(t or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_token_files_odd(spark, odd, reference):
    files = tokenio.write_tokens(odd, queries.vocabulary("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in tokenio.read_tokens(files).collect()}
    at = 0
    for i in [None, *range(len(ODD))]:
        ids = np.array([*reference("no id" if i is None else ODD[i] or ""), 0], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert tokenio.read_tokens(tokenio.write_tokens(odd.where("false"), queries.vocabulary("byte_bpe_50k.json"))).count() == 0


def test_token_files_are_read_selectively(spark):
    """Encodings, page indexes and ranges of the files, and that a range of ids opens few of them."""
    import pyarrow.parquet as pq

    texts = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string"), F.repeat(F.lit(" and more"), 20)).alias("text"))
    files = tokenio.write_tokens(texts, queries.vocabulary("byte_bpe_50k.json"))
    found = []
    for path in files.inputFiles():
        meta = pq.ParquetFile(path.removeprefix("file://")).metadata
        for g in range(meta.num_row_groups):
            cols = {c.path_in_schema.split(".")[0]: c for c in (meta.row_group(g).column(i) for i in range(meta.num_columns))}
            assert "DELTA_BINARY_PACKED" in cols["key"].encodings and "RLE_DICTIONARY" in cols["ids"].encodings
            assert cols["key"].has_column_index and cols["key"].has_offset_index
            found.append((cols["key"].statistics.min, cols["key"].statistics.max))
    found.sort()
    assert len(found) > 1 and all(a[1] < b[0] for a, b in zip(found, found[1:], strict=False))
    some = files.where("key between 100 and 120").select("key", "ids")
    assert [r["key"] for r in some.orderBy("key").collect()] == list(range(100, 121))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(key), GreaterThanOrEqual(key,100), LessThanOrEqual(key,120)]" in plan and "n_tokens" not in plan


def packed_right(pieces, want):
    by: dict = {}
    for p in pieces:
        by.setdefault(p["doc_id"], []).append(p)
    assert set(by) == set(want)
    for i, some in by.items():
        at = 0
        for p in sorted(some, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(want[i])
            assert p["ids_crc32"] == zlib.crc32(want[i][at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(want[i])
    windows: dict = {}
    for p in pieces:
        windows.setdefault(p["sequence_id"], []).append(p)
    for some in windows.values():
        at = 0
        for p in sorted(some, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
    return windows


def test_packing_odd(spark, odd, reference):
    want = {i: np.array([*reference("no id" if i is None else ODD[i] or ""), 0], "<u4") for i in [None, *range(len(ODD))]}
    packed_right(packing.pack(odd, queries.vocabulary("byte_bpe_50k.json")).collect(), want)
    packed_right(packing.pack(odd, queries.vocabulary("byte_bpe_50k.json"), windows=4).collect(), want)
    packed_right(packing.pack(odd, queries.vocabulary("byte_bpe_50k.json"), windows=4, targets={"a": 0.9, "\0null": 0.1}).collect(), want)
    assert packing.pack(odd.where("false"), queries.vocabulary("byte_bpe_50k.json")).count() == 0


def test_packing_of_many_sources_and_text_keys(spark, reference):
    """A queue for each document, a key that is no number, and sums that are joined instead of broadcast."""
    rng = np.random.default_rng(2)
    texts = {f"doc-{i}": " ".join(rng.choice(["alpha", "beta", "gamma"], rng.integers(0, 60))) for i in range(300)}
    df = spark.createDataFrame([(k, t, k) for k, t in texts.items()], "doc_id string, text string, source string").repartition(5)
    want = {k: np.array([*reference(t), 0], "<u4") for k, t in texts.items()}
    few = packing.SMALL
    try:
        packing.SMALL = 0
        windows = packed_right(packing.pack(df, queries.vocabulary("byte_bpe_50k.json"), windows=2).collect(), want)
        packed_right(packing.pack(df, queries.vocabulary("byte_bpe_50k.json"), windows=2, targets={"doc-1": 1.0, "none": 2.0}).collect(), want)
    finally:
        packing.SMALL = few
    assert len(windows) <= sum(map(len, want.values())) / 1024 * 1.5 + 2
    files = tokenio.read_tokens(tokenio.write_tokens(df, queries.vocabulary("byte_bpe_50k.json"))).collect()
    at = 0
    for r in sorted(files, key=lambda r: r["doc_id"]):
        assert r["start"] == at and r["ids_crc32"] == zlib.crc32(want[r["doc_id"]].tobytes())
        at += r["n_tokens"]


def test_packing_keeps_proportions(spark, docs, reference):
    want = {i: np.array([*reference(t), 0], "<u4") for i, t in texts_of(docs).items()}
    pieces = packing.pack(docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "big").otherwise("small")), queries.vocabulary("byte_bpe_50k.json"), windows=32).collect()
    windows = packed_right(pieces, want)
    total = sum(map(len, want.values()))
    assert len(windows) <= total / 1024 + 32
    share = sum(len(want[i]) for i in want if i % 3 == 0) / total
    for some in windows.values():
        if sum(p["length"] for p in some) == 1024:
            assert abs(sum(p["length"] for p in some if p["doc_id"] % 3 == 0) / 1024 - share) < 0.15


def test_pipeline(spark, reference):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == docs.columns, name
    rows = {r["doc_id"]: np.array([*reference(r["text"] or ""), 0], "<u4") for r in kept.collect()}
    assert 0 < len(rows) < docs.count()
    packed_right(corpus_pipeline.run(spark, sf).collect(), rows)


def test_pipeline_odd(spark, tmp_path, reference):
    """Nulls in every column, empty and very long texts, ties, repeated rows and keys, clashing extra columns, and no rows at all."""
    import corpus_pipeline

    whole = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(1000 + i, t, [None, "en", "fr"][i % 3], [None, "a"][i % 2]) for i, t in enumerate(ODD)]
    rows += [(None, "no key, but a text with words", "en", None), (None, None, None, None), (2000, "one text of a shared key stands here", "en", "s"), (2000, "quite another text of that same key", "en", "s"), (2000, "quite another text of that same key", "en", "s")]
    extra = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast(whole.schema["n_chars"].dataType))
    clash = {"langid": F.lit("x"), "quality_score": F.lit(1), "node": F.lit(2), "key": F.lit(3), "queue": F.lit("q"), "component_id": F.lit(4)}
    docs = whole.unionByName(extra.select(*whole.columns)).withColumns(clash)
    sf = str(tmp_path)
    docs.repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{sf}/labels.parquet")
    kept = spark.read.parquet(f"{sf}/documents.parquet")
    before = {tuple(r) for r in kept.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == docs.columns, name
    some = [tuple(r) for r in kept.collect()]
    assert set(some) <= before and some
    ids = {r[0] for r in some}
    assert not ids & {1000, 1001, 1002}  # null, empty and white texts have no language
    tokens = sum(len(reference(r["text"] or "")) + 1 for r in kept.collect())
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert sum(p["length"] for p in pieces) == tokens and {p["doc_id"] for p in pieces} == ids
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, empty, sf)
        assert empty.columns == docs.columns and empty.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, empty, sf).count() == 0
