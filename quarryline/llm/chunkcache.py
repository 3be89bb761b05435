"""What was made of a text chunk, by chunk: a cache on arrays.

Chunks are found by a sorted array of 64-bit hashes and their bytes compared, so a clash of hashes costs time, never results.
Chunks of more than ``CACHE_BYTES`` aren't kept. Past ``CACHE_CHUNKS`` chunks only those asked for again since the last renewal
stay (or, if these are more than half, those of the batch at hand), so a worker's memory has a bound: about 50 bytes a chunk
with four ids.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

CACHE_CHUNKS, CACHE_BYTES = 1_500_000, 48


def gather(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """data[first[i] : first[i] + size[i]] for every i, one after another."""
    upto = np.cumsum(size)
    kind = np.int32 if len(data) < 2**31 and (not len(upto) or upto[-1] < 2**31) else np.int64
    return data[np.repeat((first - upto + size).astype(kind), size) + np.arange(upto[-1] if len(upto) else 0, dtype=kind)]


class Rows:
    """Rows of varying length, one after another in arrays that double."""

    def __init__(self, kind: type):
        self.data, self.at, self.n = np.zeros(1 << 16, kind), np.zeros(1 << 14, np.int64), 0

    def add(self, flat: np.ndarray, size: np.ndarray) -> None:
        used, upto = int(self.at[self.n]), self.n + len(size)
        if used + len(flat) > len(self.data):
            self.data = np.r_[self.data[:used], np.zeros(max(used, len(flat)), self.data.dtype)]
        if upto >= len(self.at):
            self.at = np.r_[self.at[: self.n + 1], np.zeros(upto, np.int64)]
        self.data[used : used + len(flat)] = flat
        self.at[self.n + 1 : upto + 1] = used + np.cumsum(size)
        self.n = upto

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = self.at[rows]
        size = self.at[rows + 1] - first
        return gather(self.data, first, size), size


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and where each begins, with the end of the last."""
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


_MIX = np.random.default_rng(7).integers(0, 2**64, (CACHE_BYTES, 256), np.uint64)  # a number for each byte at each place


class ChunkCache:
    """``make`` takes an array of distinct chunks, none empty, and returns what it makes of all, one after another, and how many each has."""

    def __init__(self, kind: type, make: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], most: int | None = None):
        self.kind, self.make, self.most, self.pinned = kind, make, most, 0
        self.text, self.made = Rows(np.uint8), Rows(kind)
        self.hashes, self.number, self.again = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, bool)

    def pin(self, chunks: list[str], flat: np.ndarray, size: np.ndarray) -> None:
        """Chunks that stay, known from the start."""
        self._keep(*bytes_of(pa.array(chunks)), flat, size)
        self.pinned = len(chunks)

    def _keep(self, raw: np.ndarray, at: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        """Add chunks of new hashes."""
        hashes, first = self._hash(raw, at), self.text.n
        self.text.add(raw, np.diff(at))
        self.made.add(flat, size)
        order = np.argsort(hashes)
        place = np.searchsorted(self.hashes, hashes[order])
        self.hashes = np.insert(self.hashes, place, hashes[order])
        self.number = np.insert(self.number, place, (first + order).astype(np.int32))
        self.again = np.r_[self.again, np.zeros(len(hashes), bool)]

    def _renew(self, stay: np.ndarray) -> None:
        """Only these chunks (by number, ascending) remain."""
        text, ids = self.text.take(stay), self.made.take(stay)
        self.text, self.made = Rows(np.uint8), Rows(self.kind)
        self.hashes, self.number, self.again = self.hashes[:0], self.number[:0], self.again[:0]
        self._keep(text[0], np.r_[0, np.cumsum(text[1])], *ids)

    def _hash(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        place = np.arange(len(raw)) - np.repeat(at[:-1], np.diff(at))
        return np.add.reduceat(_MIX[place, raw], at[:-1]) if len(raw) else np.zeros(len(at) - 1, np.uint64)

    def take(self, found: pa.Array, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What was made of found[which], one after another, and how many each has; ``found`` are distinct chunks, none of them empty."""
        rows, stay = self._known(found)
        out = self.made.take(rows[which])
        self.made.n = stay
        return out

    def _known(self, found: pa.Array) -> tuple[np.ndarray, int]:
        """Rows of ``self.made`` for these chunks, and how many rows stay; the others go after the batch."""
        raw, at = bytes_of(found)
        size = np.diff(at)
        short = np.flatnonzero(size <= CACHE_BYTES)
        flat = raw if len(short) == len(size) else gather(raw, at[short], size[short])
        begin = np.r_[0, np.cumsum(size[short])]
        hashes = self._hash(flat, begin)
        order = np.argsort(hashes)  # a search in order stays in the processor's caches
        place = np.empty(len(hashes), np.int64)
        place[order] = np.minimum(np.searchsorted(self.hashes, hashes[order]), max(0, len(self.hashes) - 1))
        taken = self.hashes[place] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        row = self.number[place[taken]].astype(np.int64)
        n, begun = size[short][taken], begin[:-1][taken]
        alike = self.text.at[row + 1] - self.text.at[row] == n
        differ = gather(flat, begun[alike], n[alike]) != gather(self.text.data, self.text.at[row][alike], n[alike])
        if differ.any():
            alike[np.flatnonzero(alike)[np.add.reduceat(differ, np.cumsum(n[alike]) - n[alike]) > 0]] = False
        out = np.full(len(size), -1, np.int64)
        out[short[taken][alike]] = row[alike]
        self.again[row[alike]] = True
        fresh = np.zeros(len(size), bool)
        fresh[short[np.unique(hashes, return_index=True)[1]]] = True
        fresh[short[taken]] = False
        new, other = np.flatnonzero(fresh), np.flatnonzero((out < 0) & ~fresh)
        most = self.most or CACHE_CHUNKS
        if self.text.n + len(new) > most:
            stay = np.flatnonzero(self.again)
            stay = np.union1d(stay if len(stay) <= most // 2 else out[out >= 0], np.arange(self.pinned))
            known = out >= 0
            out[known] = np.searchsorted(stay, out[known])
            self._renew(stay)
        order = np.r_[new, other]
        if len(order):
            ids, each = self.make(found.take(pa.array(order)))
            upto = int(each[: len(new)].sum())
            out[order] = self.text.n + np.arange(len(order))
            self._keep(gather(raw, at[new], size[new]), np.r_[0, np.cumsum(size[new])], ids[:upto], each[: len(new)])
            stays = self.made.n
            self.made.add(ids[upto:], each[len(new) :])
            return out, stays
        return out, self.made.n
