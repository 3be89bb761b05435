"""Alignment of two tokenizers' tokens over the same bytes, by byte-owner arrays.

np.repeat writes the number of the owning token over every byte of a batch, once for tokenizer A and once for B. Where either owner
changes a new A-B overlap (a link) begins; where both change at once the tokens are cut into groups. All documents of a batch
are one array, as a document's end is a change of both.

How often the corpus links a pair of ids is a count of documents. A batch of texts is a block, with a list of its distinct pairs;
these lists are summed up by pair, and each block asks for its own pairs' counts by a join, so a hot pair has a row for each
block, not for each link, and nothing of the corpus has to fit in one place. Blocks are stored; a block's texts are tokenised once.

Texts are cut at single spaces and line feeds, where no token of either kind reaches over, and distinct chunks are encoded by both
libraries and kept in a bounded cache (chunkcache.py); texts with other white space go whole, and so do all texts if a piece of B
holds a line feed or a space after another character.

Null and empty texts, and texts that either tokenizer's bytes don't give back, have no tokens: counts 0 and '' for the digest.
Repeated rows count each, as documents of their own; keys keep their type and may be null. No rows, no rows.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunkcache import ChunkCache, gather
from .common import claim, prepare, stored
from .pretokens import _ODD, HEAD, _byte_letters, library_encoder

CHUNKS = 500_000
BLOCK = "id {}, block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, at binary, times binary, pairs binary, docs binary"
RESULT = "id {}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_COMMA, _BAR, _SEMICOLON = b",|;"


class Pair:
    """Both tokenizers, and what they make of a batch of texts. A's ids are of " " + text; B adds its space itself."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = library_encoder(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = {chr(c): bytes([i]) for i, c in enumerate(_byte_letters().tolist())}
        entries = Tokenizer.from_file(a_path).get_vocab()
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for token, i in entries.items():
            self.a_bytes[i] = b"".join(letters.get(c, c.encode()) for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.chunked = not any("\n" in p or "▁" in p.lstrip("▁") for p in pieces)
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.cache = ChunkCache(np.uint32, self._made, CHUNKS)
        self.cache.pin(["\n"], *self._rows([("\n", self.a.encode_whole("\n").tolist(), self.b.encode("\n")[1:])]))

    def _row(self, want: str, a: list[int], b: list[int]) -> list[int]:
        """How many ids are A's, twice, odd if the bytes of either differ; A's ids; B's ids."""
        raw = want.encode()
        wrong = b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw
        return [2 * len(a) + wrong, *a, *b]

    def _rows(self, made: list[tuple[str, list[int], list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        rows = [self._row(*x) for x in made]
        return np.array([i for row in rows for i in row], np.uint32), np.array(list(map(len, rows)), np.int64)

    def _made(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        flat, size = self.a._encoded_chunks(chunks)
        ids, ends = flat.tolist(), np.cumsum(size).tolist()
        texts = chunks.to_pylist()
        heads = [t[0] == HEAD for t in texts]
        pieces = self.b.encode([f"\n{t[1:]}" if h else t for t, h in zip(texts, heads, strict=True)], num_threads=1)
        return self._rows([(t[1:] if h else f" {t}", ids[lo:hi], p[2:] if h else p) for t, h, lo, hi, p in zip(texts, heads, [0, *ends[:-1]], ends, pieces, strict=True)])

    def __call__(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and for B the ids of all texts, one after another, and how many each text has; texts without tokens have none."""
        texts = pc.fill_null(texts, "")
        n, empty = len(texts), pc.equal(texts, "").to_numpy(zero_copy_only=False)
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False) if self.chunked else ~empty
        plain, whole = np.flatnonzero(~odd & ~empty), np.flatnonzero(odd & ~empty)
        flat, of = np.zeros(0, np.uint32), np.zeros(0, np.int64)  # rows as _row says, and the text of each
        size = np.zeros(0, np.int64)
        if len(plain):
            cut = pc.split_pattern(pc.replace_substring(texts.take(pa.array(plain)), "\n", f" \n {HEAD}"), " ")
            codes = cut.flatten().dictionary_encode()
            flat, size = self.cache.take(codes.dictionary, codes.indices.to_numpy())
            of = np.repeat(plain, np.diff(cut.offsets.to_numpy()))
        if len(whole):
            more = self._rows([(f" {t}", self.a.encode_whole(f" {t}").tolist(), self.b.encode(t)) for t in texts.take(pa.array(whole)).to_pylist()])
            flat, size, of = np.r_[flat, more[0]], np.r_[size, more[1]], np.r_[of, whole]
            order = np.argsort(of, kind="stable")
            first = (np.cumsum(size) - size)[order]
            of, size = of[order], size[order]
            flat = gather(flat, first, size)
        first = np.cumsum(size) - size
        head = flat[first].astype(np.int64)
        right = np.bincount(of, head % 2, n)[of] == 0
        first, size, of, n_a = first[right], size[right], of[right], head[right] // 2
        return [(gather(flat, lo, k), np.bincount(of, k, n).astype(np.int64)) for lo, k in ((first + 1, n_a), (first + 1 + n_a, size - 1 - n_a))]


@functools.cache
def pair_of(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def overlaps(a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From the bytes of each token: the A token and the B token of every link, in order, and which links begin a group."""
    a, b = (np.repeat(np.arange(len(x), dtype=np.int32), x) for x in (a_size, b_size))
    a_new, b_new = (np.r_[True, x[1:] != x[:-1]] for x in (a, b))
    at = np.flatnonzero(a_new | b_new) if len(a) else np.zeros(0, np.int64)
    return a[at], b[at], (a_new & b_new)[at] if len(a) else np.zeros(0, bool)


@functools.cache
def _decimals(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The decimal digits of all numbers below n, each with a comma; where each begins and its size."""
    texts = [b"%d," % i for i in range(n)]
    size = np.array(list(map(len, texts)), np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size


def group_digests(a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, ends: np.ndarray) -> list[str]:
    """SHA-256 of each document's groups as text. a_group, b_group: the group of every token, over all; ends: groups up to each document's end."""
    order = np.argsort(np.r_[2 * a_group, 2 * b_group + 1], kind="stable")
    ids, place = np.r_[a, b][order].astype(np.int64), np.r_[2 * a_group, 2 * b_group + 1][order]
    data, first, size = _decimals(1 << 17 if not len(ids) or ids.max() < 1 << 17 else int(ids.max()) + 1)
    text = gather(data, first[ids], size[ids])
    upto = np.cumsum(size[ids])
    last = np.flatnonzero(np.r_[place[1:] != place[:-1], True]) if len(place) else np.zeros(0, np.int64)
    text[upto[last] - 1] = np.where(place[last] % 2, _SEMICOLON, _BAR)
    at = np.r_[0, upto][np.searchsorted(place, 2 * np.r_[0, ends])]
    return [hashlib.sha256(text[lo : hi - 1]).hexdigest() if hi > lo else "" for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _blocks(a_path: str, b_path: str):
    names = [x.split()[0] for x in BLOCK.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.string()] + [pa.binary()] * 4

    def run(batches):
        claim("aligned", pair_of.cache_clear)
        pair, part = pair_of(a_path, b_path), TaskContext.get().partitionId()
        wide = len(pair.b_bytes)
        for number, batch in enumerate(batches):
            rows = batch.num_rows
            (a, n_a), (b, n_b) = pair(batch.column(1))
            link_a, link_b, begins = overlaps(pair.a_size[a], pair.b_size[b])
            group = np.cumsum(begins) - 1  # of each link
            a_group, b_group = (group[np.flatnonzero(np.r_[True, x[1:] != x[:-1]])] if len(x) else group for x in (link_a, link_b))
            doc = np.repeat(np.arange(rows), n_a)[link_a]
            n_links, n_groups = np.bincount(doc, minlength=rows), np.bincount(doc[begins], minlength=rows)
            digests = group_digests(a, b, a_group, b_group, np.cumsum(n_groups))
            pairs, index = np.unique(a[link_a].astype(np.int64) * wide + b[link_b], return_inverse=True)
            own, times = np.unique(doc * max(1, len(pairs)) + index, return_counts=True)
            held, at = np.divmod(own, max(1, len(pairs)))
            edge = np.searchsorted(held, np.arange(rows + 1)).tolist()
            at, times = at.astype("<i4"), times.astype("<i4")
            block = np.full(rows + 1, (part << 32) + number)
            columns = [
                *(np.r_[x, 0] for x in (n_a, n_b, n_groups, n_links)), [*digests, None],
                [at[lo:hi].tobytes() for lo, hi in zip(edge[:-1], edge[1:], strict=True)] + [None], [times[lo:hi].tobytes() for lo, hi in zip(edge[:-1], edge[1:], strict=True)] + [None],
                [None] * rows + [pairs.astype("<i8").tobytes()], [None] * rows + [np.bincount(at, minlength=len(pairs)).astype("<i8").tobytes()],
            ]
            ids = pa.concat_arrays([batch.column(0), pa.nulls(1, batch.column(0).type)])
            yield pa.RecordBatch.from_arrays([ids, pa.array(block), *(pa.array(c, k) for c, k in zip(columns, kinds[1:], strict=True))], names=names)

    return run


def _listed(batches):
    """A row for each pair of a block."""
    for batch in batches:
        for block, pairs, docs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            keys = np.frombuffer(pairs, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block)), pa.array(np.arange(len(keys), dtype=np.int32)), pa.array(keys), pa.array(np.frombuffer(docs, "<i8"))], names=["block", "place", "pair", "docs"])


def _told(rows: pa.Table, counts: pa.Table) -> pa.Table:
    """A block's documents with what its pairs' counts say."""
    n, best = np.zeros(counts.num_rows, np.int64), np.zeros(counts.num_rows, np.int64)
    place = counts["place"].to_numpy()
    n[place], best[place] = counts["n"].to_numpy(), counts["best"].to_numpy()
    sums = []
    for at, times in zip(rows["at"].to_pylist(), rows["times"].to_pylist(), strict=True):
        at, times = np.frombuffer(at, "<i4"), np.frombuffer(times, "<i4").astype(np.int64)
        sums.append((int(best[at] @ times), int(n[at] @ times)))
    new = [pa.array([s[i] for s in sums], pa.int64()) for i in (0, 1)]
    return pa.Table.from_arrays([rows["id"], *(rows[c] for c in ("n_a", "n_b", "n_groups", "n_links")), *new, rows["groups_sha256"]], names=[x.split()[0] for x in RESULT.split(", ")])


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each row of ``docs``: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best: links whose pair is in as many documents as any pair of its A id; count_sum: over all links, the documents that hold the pair.
    """
    import sentencepiece

    prepare(docs.sparkSession)
    kind = dict(docs.select(docs[key].alias("id")).dtypes)["id"]
    blocks = stored(docs.select(docs[key].alias("id"), docs[text].alias("text")).mapInArrow(_blocks(a_path, b_path), BLOCK.format(kind)), "aligned", compression="zstd")
    listed = blocks.where("pairs is not null").select("block", "pairs", "docs").mapInArrow(_listed, "block long, place int, pair long, docs long")
    wide = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    counted = stored(listed.groupBy("pair").agg(F.sum("docs").alias("n")).withColumn("a", F.expr(f"pair div {wide}")), "pairs")
    most = counted.groupBy("a").agg(F.max("n").alias("most"))  # a row for each id of A at most
    counts = counted.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    asked = listed.select("block", "place", "pair").join(counts, "pair").select("block", "place", "n", "best")
    rows = blocks.where("pairs is null").select("id", "block", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "at", "times")
    told = rows.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_told, RESULT.format(kind))
    return told.withColumnRenamed("id", key)
