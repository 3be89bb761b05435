"""The registered queries without SQL on a whole table, against plain versions that go text by text."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarryline.llm import langid, quality, queries

from .brute_html import clean, zones_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def ids(texts):
    tok = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    return {k: np.array(tok.encode(t, add_special_tokens=False).ids, "<u4") for k, t in texts.items()}


def held(key) -> bool:
    return zlib.crc32(str(key).encode()) % 3 == 1


def test_op3(spark, texts):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    forest = quality.train(docs, labels.where(langid.not_held_out(F.col("doc_id"))))

    def slow(text):
        x, total = quality.statistics(text.encode()), forest.base
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(x[feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))

    got = queries.op3_quality(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        want = slow(texts[r["doc_id"]])
        assert r["held_out"] == held(r["doc_id"]) and r["score"] == pytest.approx(want, abs=1e-9) and r["predicted"] == int(r["score"] >= 0.5)


def test_op4(spark, texts):
    path = queries.vocabulary("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    langs, prob = langid.train(docs.where(langid.not_held_out(F.col("doc_id"))), path)
    v = langid.pieces(path)
    number = {int(h): int(i) for h, i in zip(v.hashes, v.ids, strict=True)}
    known: dict = {}

    def slow(word):
        if word not in known:
            marked, sums = langid.MARK + word, [np.ones(len(langs))]
            for end in range(1, len(marked) + 1):
                new = np.zeros(len(langs))
                for n in range(1, min(end, v.longest) + 1):
                    i = number.get(v._hash(marked[end - n : end]))
                    new += sums[end - n] * (prob[i] if i is not None else langid.OUTSIDE if n == 1 else 0)
                sums.append(new)
            known[word] = np.log(sums[-1])
        return known[word]

    for r in queries.op4_langid(spark, SF).collect():
        text = texts[r["doc_id"]].lower()
        assert r["held_out"] == held(r["doc_id"])
        if not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        if any(len(w) > 31 for w in text.split()):
            continue  # these underflow here; test_long_words_are_summed_whole has them
        total = sum(map(slow, text.split()))
        assert r["lang_pred"] == langs[int(total.argmax())] and r["score"] == pytest.approx(1 / np.exp(total - total.max()).sum(), abs=1e-6)


def test_op5(spark, texts):
    for r in queries.op5_media(spark, SF).collect():
        data = texts[r["doc_id"]].encode()
        padded = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))


def test_op7(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    hosts: dict = {}
    for p in pages:
        hosts.setdefault((p["url"] or "").partition("://")[2].partition("/")[0].lower(), []).append(p)
    want = {}
    for some in hosts.values():
        for p, blocks in zip(some, clean([zones_of(p["html"] or "") for p in some]), strict=True):
            want[p["page_id"]] = "\n".join(blocks)
    got = queries.op7_html(spark, SF).collect()
    assert {r["page_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)


def test_op8(spark, texts, ids):
    for r in queries.op8_bpe(spark, SF).collect():
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids[r["doc_id"]]), hashlib.sha256(ids[r["doc_id"]].tobytes()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())


def test_op9(spark, ids):
    got = {r["doc_id"]: r for r in queries.op9_tokens(spark, SF).collect()}
    at = 0
    for k in sorted(ids):
        whole = np.r_[ids[k], np.uint32(0)].astype("<u4")
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (at, len(whole), zlib.crc32(whole.tobytes()))
        at += len(whole)


def test_op10(spark, ids):
    pieces, windows = {}, {}
    for r in queries.op10_packing(spark, SF).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
        windows.setdefault(r["sequence_id"], []).append(r)
    assert set(pieces) == set(ids)
    for k, some in pieces.items():
        whole, at = np.r_[ids[k], np.uint32(0)].astype("<u4"), 0
        for r in sorted(some, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(whole) and r["ids_crc32"] == zlib.crc32(whole[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(whole)
    for some in windows.values():
        at = 0
        for r in sorted(some, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    total = sum(len(x) + 1 for x in ids.values())
    assert len(windows) == -(-total // 1024) or len(windows) <= total // 1024 + 2
