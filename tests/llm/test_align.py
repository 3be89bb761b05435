"""Cross-tokenizer alignment against a version that walks the bytes of one document at a time."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quarryline.llm import align, queries
from quarryline.llm.pretokens import _byte_letters

SF = "/root/testdata/sf0.001"
A, B = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def slow():
    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    byte = {chr(c): i for i, c in enumerate(_byte_letters().tolist())}

    def spans(tokens):
        out, at = [], 0
        for i, raw in tokens:
            out.append((i, at, at + len(raw)))
            at += len(raw)
        return out

    def one(text):
        if not text:
            return None
        a = [(i, bytes(byte[c] for c in tok.id_to_token(i))) for i in tok.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)]
        want = (" " + text).encode()
        if b"".join(r for _, r in a) != want or b"".join(r for _, r in b) != want:
            return None
        a, b = spans(a), spans(b)
        links, j = [], 0
        for i, lo, hi in a:
            while j and b[j - 1][2] > lo:
                j -= 1
            while j < len(b) and b[j][2] <= lo:
                j += 1
            k = j
            while k < len(b) and b[k][1] < hi:
                links.append((i, b[k][0]))
                k += 1
        cuts = sorted({hi for *_, hi in a} & {hi for *_, hi in b})
        groups, x, y = [], 0, 0
        for c in cuts:
            left, right = [], []
            while x < len(a) and a[x][2] <= c:
                left.append(str(a[x][0]))
                x += 1
            while y < len(b) and b[y][2] <= c:
                right.append(str(b[y][0]))
                y += 1
            groups.append(",".join(left) + "|" + ",".join(right))
        return len(a), len(b), groups, links

    def all_(rows):
        found = [(k, one(t)) for k, t in rows]
        count = Counter(p for _, f in found if f for p in set(f[3]))
        best = defaultdict(int)
        for (a, _), n in count.items():
            best[a] = max(best[a], n)
        return sorted(
            ((k, f[0], f[1], len(f[2]), len(f[3]), sum(count[p] == best[p[0]] for p in f[3]), sum(count[p] for p in f[3]), hashlib.sha256(";".join(f[2]).encode()).hexdigest()) if f else (k, 0, 0, 0, 0, 0, 0, "") for k, f in found),
            key=str,
        )

    return all_


def rows_of(df):
    return sorted(((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in df.collect()), key=str)


def test_op12(spark, slow):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(queries.op12_align(spark, SF)) == slow(docs)


ODD = [None, "", " ", "\n", "a", " a", "a ", "a  b", "a\nb", "a\n\nb", "\na", "tab\tx", "café ﬁne", "▁", "a▁b", "<s> </s> <unk> <0x41>", "<|endoftext|> x", "\x00\x02z", "日本語のテキスト。", "🙂🙃 ok 👩‍👩‍👧", "é", "x" * 3000, "a.b, c!? (d)", "don't we'll 1234567", "　x​", "same text here", "same text here"]


def test_odd(spark, slow, monkeypatch):
    monkeypatch.setattr(align, "CHUNKS", 20)
    rows = [*enumerate(ODD), (None, "word " * 500), (3, "again a"), (4, "word ," * 20_000)]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, n_a int, block string")
    assert rows_of(align.align(df, A, B)) == slow(rows)
    assert rows_of(align.align(df.repartition(9), A, B)) == slow(rows)
    assert align.align(df.where("false"), A, B).count() == 0
    text_keys = spark.createDataFrame([("k1", "one two"), ("k2", None)], "doc_id string, text string")
    assert [r["doc_id"] for r in align.align(text_keys, A, B).orderBy("doc_id").collect()] == ["k1", "k2"]


def test_chunks_give_the_same_as_whole_texts():
    cut, whole = align.Pair(A, B), align.Pair(A, B)
    whole.chunked = False
    texts = [t for t in ODD if t] + ["The quick (brown) fox; isn't it?\nYes - 12.5% of \"them\" www.site.com e.g. this."]
    for x, y in zip(cut(align.pa.array(texts)), whole(align.pa.array(texts)), strict=True):
        assert (x[0] == y[0]).all() and (x[1] == y[1]).all()


def test_overlaps():
    a, b, begins = align.overlaps(np.array([2, 1, 3, 1]), np.array([1, 2, 2, 1, 1]))
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 1), (2, 2), (2, 3), (3, 4)]
    assert begins.tolist() == [True, False, False, True, False, True]
    assert [len(x) for x in align.overlaps(np.zeros(0, int), np.zeros(0, int))] == [0, 0, 0]
