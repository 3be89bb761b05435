"""Media columns: payloads stored as lossless WebP, read back into pixel arrays, with features of what was read.

A payload is padded by bytes 0 to a positive multiple of 64. Its bytes are the green samples of grey pixels, in rows of 64 or a
multiple; the last row's unused end is 0. A payload of more than ``PICTURE`` bytes goes on in further pictures, one file after
another, so neither size has a limit of its own and memory follows one picture. Null counts as empty. The encoder chooses the
features of the format that a picture is written with (webp.py).
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_column, encoded_texts, prepare, struct_of
from .webp import LARGEST, choose, decode, encode

UNIT, PICTURE, OPAQUE = 64, 1 << 24, 0xFF000000
_STORED = pa.schema([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("media", pa.binary())])
_READ = pa.schema([("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def to_pictures(data: bytes) -> tuple[int, bytes]:
    """(size of the padded payload, the WebP files)."""
    size = max(UNIT, -(-len(data) // UNIT) * UNIT)
    payload, files = np.frombuffer(data.ljust(size, b"\0"), np.uint8), []
    for lo in range(0, size, PICTURE):
        some = payload[lo : lo + PICTURE]
        width = UNIT * -(-len(some) // (UNIT * LARGEST))
        pixels = np.full(-(-len(some) // width) * width, OPAQUE, np.uint32)
        pixels[: len(some)] |= some.astype(np.uint32) << 8
        pixels = pixels.reshape(-1, width)
        files.append(encode(pixels, **choose(pixels)))
    return size, b"".join(files)


def from_pictures(media: bytes, size: int) -> tuple[bytes, list[np.ndarray]]:
    """(the padded payload, the samples of each picture) of stored pictures."""
    pictures, at = [], 0
    while at < len(media):
        end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        pictures.append((decode(media[at:end]) >> 8).astype(np.uint8))
        at = end
    return b"".join(p.tobytes() for p in pictures)[:size], pictures


def features(pictures: list[np.ndarray]) -> str:
    """Of all pictures: their first one's shape and their number, mean and deviation in 1/16 steps, distinct samples, entropy in
    1/256 bit, and of the first a difference hash: 8 rows of 9 equal parts, a bit for each part that is brighter than the next."""
    counts = sum(np.bincount(p.ravel(), minlength=256) for p in pictures)
    n, level = int(counts.sum()), np.arange(256)
    total, square, there = int(counts @ level), int(counts @ level**2), counts[counts > 0]
    spread = int(16 * np.sqrt(max(square / n - (total / n) ** 2, 0)))
    entropy = int(256 * (there * np.log2(n / there)).sum() / n)
    first = pictures[0].astype(np.int64)
    rows, columns = (np.linspace(0, k, parts + 1).astype(np.int64)[:-1] for k, parts in zip(first.shape, (8, 9), strict=True))
    sums = np.add.reduceat(np.add.reduceat(first, rows, 0), columns, 1)
    wide = np.diff(np.r_[columns, first.shape[1]])
    brighter = sums[:, :-1] * wide[1:] > sums[:, 1:] * wide[:-1]
    return f"{first.shape[1]}x{first.shape[0]}*{len(pictures)}:{16 * total // n}/{spread}/{len(there)}/{entropy}:{np.packbits(brighter).tobytes().hex()}"


@arrow_column("n_bytes long, payload_bytes long, media binary", repeats=False)
def store(texts: pa.Array) -> pa.Array:
    data = encoded_texts(texts)
    made = [to_pictures(x) for x in data]
    return struct_of(_STORED, [[len(x) for x in data], [m[0] for m in made], [m[1] for m in made]])


@arrow_column("payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", repeats=False)
def read_back(media: pa.Array, sizes: pa.Array) -> pa.Array:
    rows = []
    for file, size in zip(media.to_pylist(), sizes.to_pylist(), strict=True):
        payload, pictures = from_pictures(file, size)
        rows.append((hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(file), hashlib.sha256(file).hexdigest(), features(pictures)))
    return struct_of(_READ, list(zip(*rows, strict=True)) if rows else [[]] * len(_READ))


def store_texts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, payload_bytes, media: a WebP file for each row, or several one after another."""
    prepare(docs.sparkSession)
    return docs.select(docs[key].alias(key), store(docs[text]).alias("m")).select(key, "m.*")


def read_features(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """What is read back from the files of ``store_texts``, without the files themselves."""
    return stored.select(key, "n_bytes", "payload_bytes", read_back("media", "payload_bytes").alias("r")).select(key, "n_bytes", "payload_bytes", "r.*")
