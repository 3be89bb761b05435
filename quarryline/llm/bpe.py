"""Byte-level BPE over length-bucketed padded numpy matrices.

Every row of a matrix is one pretoken (a match of the pattern). Each round every live row merges its leftmost
pair of minimum rank; pairs are looked up in an open-addressed hash table, and finished rows leave the matrix
(compaction). Rows longer than ``WIDE`` bytes run through a linked list and a heap with the same table and
the same order of merges, so a long run without spaces costs n log n.

Nulls count as empty texts; an empty text has no ids and decodes to no bytes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame

from .common import arrow_column, claim, prepare, struct_of
from .pretokens import ChunkEncoder, rows_of

WIDE = 1024
NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class ByteBPE:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.vocab = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.vocab[rank] = token
        self.split = regex.compile(pattern).findall
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self._fill(np.fromiter(pairs, np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))
        self.encode_chunks = ChunkEncoder(self._encode_array, lambda text: self.encode_texts([text])[0])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(len(keys)).bit_length() + 1)
        size = 1 << self.bits
        self.keys, self.values, self.probes = np.full(size, 2**64 - 1, np.uint64), np.full(size, NONE, np.int32), 0
        at = self._slot(keys)
        while len(keys):
            self.probes += 1
            free = np.flatnonzero(self.keys[at] == np.uint64(2**64 - 1))
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.values[at[won]] = keys[won], values[won]
            rest = np.ones(len(keys), bool)
            rest[won] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & (size - 1)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's concatenation, or NONE."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at, mask = self._slot(keys), (1 << self.bits) - 1
        out, todo = np.full(len(keys), NONE, np.int32), np.arange(len(keys))
        for _ in range(self.probes):
            found = self.keys[at]
            hit = found == keys
            out[todo[hit]] = self.values[at[hit]]
            on = ~hit & (found != np.uint64(2**64 - 1))
            if not on.any():
                break
            todo, keys, at = todo[on], keys[on], (at[on] + 1) & mask
        return out

    def encode_pretokens(self, words: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(words)
        sizes = np.array([len(w) for w in words])
        buckets: dict[int, list[int]] = {}
        for i, n in enumerate(sizes.tolist()):
            if n == 0:
                out[i] = np.zeros(0, np.int32)
            elif n > WIDE:
                out[i] = self._long(words[i])
            else:
                buckets.setdefault(max(4, 1 << (n - 1).bit_length()), []).append(i)
        for width, rows in buckets.items():
            step = max(1, (1 << 20) // width)
            for lo in range(0, len(rows), step):
                some = rows[lo : lo + step]
                for i, ids in zip(some, self._matrix([words[i] for i in some], width), strict=True):
                    out[i] = ids
        return out

    def _matrix(self, words: list[bytes], width: int) -> list[np.ndarray]:
        n = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        ids = self.single[raw]
        inside = np.arange(width)[None, :] < n[:, None]
        ids = np.where(inside, ids, -1).astype(np.int32)
        both = inside[:, 1:]
        ranks = np.full((len(words), width - 1), NONE, np.int32)
        ranks[both] = self.merged(ids[:, :-1][both], ids[:, 1:][both])
        done: list = [None] * len(words)
        row = np.arange(len(words))
        while len(row):
            at = ranks.argmin(1)
            lowest = ranks[np.arange(len(row)), at]
            stop = lowest == NONE
            if stop.any():
                for r in np.flatnonzero(stop):
                    done[row[r]] = ids[r, : n[r]].copy()
                go = ~stop
                row, ids, ranks, n, at, lowest = row[go], ids[go], ranks[go], n[go], at[go], lowest[go]
                if not len(row):
                    break
                most = int(n.max())
                if most < ids.shape[1]:
                    ids, ranks = ids[:, :most].copy(), ranks[:, : max(1, most - 1)].copy()
            each, w = np.arange(len(row)), ids.shape[1]
            col = np.arange(w - 1)[None, :]
            shifted = ids[:, 1:]
            ids[:, :-1] = np.where(col > at[:, None], shifted, ids[:, :-1])
            ids[:, -1] = -1
            ids[each, at] = lowest
            if w > 2:
                ranks[:, :-1] = np.where(col[:, :-1] > at[:, None], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NONE
            n = n - 1
            for j in (at - 1, at):
                ok = (j >= 0) & (j + 1 < n)
                ranks[each[ok], j[ok]] = self.merged(ids[each[ok], j[ok]], ids[each[ok], j[ok] + 1])
                if j is at:
                    gone = ~ok & (at < ranks.shape[1])
                    ranks[each[gone], at[gone]] = NONE
        return done

    def _long(self, word: bytes) -> np.ndarray:
        ids = self.single[np.frombuffer(word, np.uint8)]
        n = len(ids)
        first = self.merged(ids[:-1], ids[1:])
        heap = [(int(r), i) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        ids, after, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        lookup = functools.lru_cache(65536)(lambda a, b: int(self.merged(np.array([a]), np.array([b]))[0]))
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or lookup(ids[i], ids[j]) != rank:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := lookup(rank, ids[after[i]])) != NONE:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := lookup(ids[before[i]], rank)) != NONE:
                heapq.heappush(heap, (r, before[i]))
        return np.array([x for x in ids if x >= 0], np.int32)


    def encode_texts(self, some: list[str]) -> list[np.ndarray]:
        split = [self.split(c) for c in some]
        distinct = list({w for parts in split for w in parts})
        known = {"": np.zeros(0, np.int32)} | dict(zip(distinct, self.encode_pretokens([w.encode() for w in distinct]), strict=True))
        return [np.concatenate([known[w] for w in parts]).astype(np.uint32) if len(parts) != 1 else known[parts[0]].astype(np.uint32) for parts in map(lambda p: p or [""], split)]

    def _encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = self.encode_texts(texts.to_pylist())
        return np.concatenate(ids), np.array([len(x) for x in ids])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids.tolist()))


@functools.cache
def codec(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


_DIGEST = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def bpe_digest(path: str, pattern: str):
    """A column function: text -> struct<n_tokens, ids_sha256, decoded_sha256>."""

    @arrow_column("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: pa.Array) -> pa.Array:
        claim("bpe", codec.cache_clear)
        bpe = codec(path, pattern)
        ids = rows_of(*bpe.encode_chunks(texts))
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return struct_of(_DIGEST, [[len(x) for x in ids], [sha(x) for x in ids], [sha(bpe.decode(x)) for x in ids]])

    return digest


def bpe_encode(path: str, pattern: str):
    """A column function: text -> array<int> of token ids."""

    @arrow_column("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        flat, ends = codec(path, pattern).encode_chunks(texts)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(flat.astype(np.int32)))

    return encode


def bpe_decode(path: str, pattern: str):
    """A column function: array<int> -> the bytes these ids stand for."""

    @arrow_column("binary")
    def decode(ids: pa.Array) -> pa.Array:
        bpe = codec(path, pattern)
        return pa.array([bpe.decode(np.array(x or [], np.int64)) for x in ids.to_pylist()], pa.binary())

    return decode


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: key, n_tokens, ids_sha256, decoded_sha256. No shuffle; other columns aren't read."""
    prepare(docs.sparkSession)
    made: Column = bpe_digest(path, pattern)(docs[text])
    return docs.select(docs[key].alias(key), made.alias("made")).select(key, "made.*")
