"""What several operators of this package share: durable intermediate tables and Arrow helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

BATCH_BYTES = "4m"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset (tests, one machine) a new temporary one."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quarryline-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def prepare(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder, workers can import this package, and Arrow batches are bounded by bytes.

    The bound stays set in the session, since frames run after the call that made them.
    """
    shared_dir(spark)
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


_paths: list[str] = []


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table into the shared folder and read it again: lineage ends here and nothing runs twice.

    The table outlives the call, since the returned frame reads it; it goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _paths.append(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], spark: SparkSession, name: str) -> DataFrame:
    """``make()``'s rows as a stored table; the tables that it stored on the way are deleted as soon as it is written."""
    first = len(_paths)
    out = stored(make(), name)
    for path in _paths[first:-1]:
        _remove(spark, path)
    del _paths[first:-1]
    return out


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone: nothing is left to ask
        return


_held: list = [None, None]


def claim(name: str, free) -> None:
    """In a worker: ``name`` now holds the caches. Workers serve one operator after another, and the one before frees its own."""
    if _held[0] != name:
        if _held[1]:
            _held[1]()
        _held[:] = [name, free]


def encoded_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def struct_of(schema: pa.Schema, columns: list) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], fields=list(schema))


def arrow_column(kind: str, repeats: bool = True):
    """A decorator: a function of Arrow arrays becomes a column function. It needs a session only when it is called.

    repeats=False marks it as not to be run twice, so the optimiser doesn't copy it into a filter.
    """

    def wrap(function):
        def call(*columns):
            udf = F.arrow_udf(function, kind)
            return (udf if repeats else udf.asNondeterministic())(*columns)

        return call

    return wrap
