"""Token ids in Parquet list columns.

Documents are dealt by ranges of their id and sorted, so files and row groups follow the id and the page index
lets a reader skip to a range of ids; ``ids`` is dictionary-encoded, keys and counts are delta-encoded
(Parquet v2). Every document ends with the end id. A file's running token count is stored with each row, and the
global start is that count plus the tokens of all lower files, of which there is one sum for each file.

Null texts count as empty; rows with one key keep together, in order of their text; null keys come first; the key keeps its type.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_column, claim, prepare, stored
from .pretokens import library_encoder, with_end

FILES = 1 << 20
FILE = "key {}, file int, in_file long, n_tokens long, ids array<int>"
LAYOUT = {
    "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": str(32 << 20), "parquet.page.size": str(256 << 10), "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true", "parquet.enable.dictionary#key": "false", "parquet.enable.dictionary#in_file": "false", "parquet.enable.dictionary#n_tokens": "false", "compression": "zstd", "parquet.compression.codec.zstd.level": "1",
}

def _tokenised(path: str, end_id: int):
    def run(batches):
        claim("library", library_encoder.cache_clear)
        encode, file, total = library_encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            flat, ends = with_end(*encode(batch.column(1)), end_id)
            n = np.diff(ends, prepend=0)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(flat.view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), file, np.int32)), pa.array(total + ends - n), pa.array(n), lists], names=[x.split()[0] for x in FILE.split(", ")])
            total += int(n.sum())

    return run


def write_tokens(docs: DataFrame, path: str, end_id: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode ``docs`` into sorted token files in the shared folder; returns the frame that reads them (FILE)."""
    spark = docs.sparkSession
    prepare(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    rows = rows.repartitionByRange(parts, "key").sortWithinPartitions("key", "text")
    return stored(rows.mapInArrow(_tokenised(path, end_id), FILE.format(dict(docs.dtypes)[key])), "tokens", **LAYOUT)


@arrow_column("long")
def list_crc32(lists: pa.Array) -> pa.Array:
    """CRC-32 of each list as little-endian uint32."""
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<i4", copy=False)
    return pa.array([zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.int64())


def read_tokens(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """From the files: key, start (ids of all documents before it), n_tokens, ids_crc32."""
    sums = files.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    if sums.count() <= FILES:
        before = F.broadcast(before)  # one row for each file
    placed = files.join(before, "file")
    return placed.select(F.col("key").alias(key), (F.col("base") + F.col("in_file")).alias("start"), "n_tokens", list_crc32("ids").alias("ids_crc32"))
