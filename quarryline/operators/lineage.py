"""Content hashes, manifests, drift of recorded files, and reuse of stages by signature."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def content_hash(column) -> Column:
    return F.sha2(column, 256)


def manifest(df: DataFrame, path: str, content: str) -> DataFrame:
    return df.select(F.col(path).alias("path"), F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("bigint").alias("size_bytes"))


def file_manifest(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def digest_of(entries: DataFrame, by: list[str]) -> DataFrame:
    """One digest of each group's (path, sha256, size) entries, whatever their order and number.

    Entries' hashes are added up as four numbers of 64 bits, which needs no list of them anywhere; the digest is the sums' hash. It
    tells changes apart, not forgeries.
    """
    one = entries.select(*by, F.sha2(F.concat_ws("|", "path", "sha256", F.col("size_bytes").cast("string")), 256).alias("h"))
    lane = lambda i: F.sum(F.conv(F.substring("h", 16 * i + 1, 16), 16, 10).cast("decimal(38,0)")).cast("string")
    return one.groupBy(*by).agg(F.sha2(F.concat_ws(",", *map(lane, range(4))), 256).alias("digest"), F.count("*").alias("entries"))


def drift(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """State of every recorded path now: missing, size_changed, content_changed or same."""
    now = current.select("path", F.col("sha256").alias("_h"), F.col("size_bytes").alias("_s"), F.lit(True).alias("_here"))
    state = F.when(F.col("_here").isNull(), "missing").when(F.coalesce(F.col("_s") != F.col("size_bytes"), F.lit(True)), "size_changed").when(F.coalesce(F.col("_h") != F.col("sha256"), F.lit(True)), "content_changed").otherwise("same")
    return recorded.join(now, "path", "left").select("path", state.alias("state"))


def signature(inputs: dict, parameters: dict, version: str) -> str:
    """SHA-256 of canonical JSON of what a stage depends on."""
    return hashlib.sha256(json.dumps({"inputs": inputs, "parameters": parameters, "version": version}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def compact(spark: SparkSession, folder: str, keep: list[str], dry_run: bool = True) -> list[tuple[str, int]]:
    """(path, bytes) of files of a finished campaign that match none of the ``keep`` patterns; deleted unless ``dry_run``.

    Goes through Hadoop's file system, so it reaches any store that Spark does.
    """
    import re

    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files, out = fs.listFiles(top, True), []
    while files.hasNext():
        f = files.next()
        path = f.getPath().toString()
        if not any(re.search(k, path) for k in keep):
            out.append((path, f.getLen()))
            if not dry_run:
                fs.delete(f.getPath(), False)
    return out


def freeze(spark: SparkSession, sources: dict[str, str], folder: str) -> DataFrame:
    """Copies of named files or folders under ``folder`` and the manifest (resource, path, sha256, size_bytes) that ``drift`` checks later."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    out = None
    for name, source in sorted(sources.items()):
        target = f"{folder}/{name}"
        jvm.org.apache.hadoop.fs.FileUtil.copy(path(source).getFileSystem(conf), path(source), path(target).getFileSystem(conf), path(target), False, conf)
        part = file_manifest(spark, target).select(F.lit(name).alias("resource"), "path", "sha256", "size_bytes")
        out = part if out is None else out.unionByName(part)
    return out


def without_self(entries: DataFrame, current: DataFrame, manifest_path: str) -> DataFrame:
    """A manifest without the entry of its own file, if all other entries hold; else an error."""
    rest = entries.where(F.col("path") != manifest_path)
    if drift(rest, current).where("state <> 'same'").limit(1).count():
        raise ValueError("the manifest's files have changed")
    return rest


def promote(spark: SparkSession, candidate: str, active: str, records: str, stamp: str) -> str:
    """Make ``candidate`` the active file: the old one is kept under ``records``, the new one copied beside and renamed into place."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path, util = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.hadoop.fs.FileUtil
    fs = path(active).getFileSystem(conf)
    backup = f"{records}/{stamp}-{active.rsplit('/', 1)[-1]}"
    if fs.exists(path(active)):
        fs.mkdirs(path(records))
        util.copy(fs, path(active), fs, path(backup), False, conf)
    fresh = path(f"{active}.{stamp}.new")
    util.copy(path(candidate).getFileSystem(conf), path(candidate), fs, fresh, False, conf)
    if fs.exists(path(active)):
        fs.delete(path(active), False)
    if not fs.rename(fresh, path(active)):
        raise OSError(f"{active} could not be put in place; the old file is {backup}")
    return backup
