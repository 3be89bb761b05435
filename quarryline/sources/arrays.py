"""NPY, NPZ, PLY, OBJ and matrix-YAML files as tables, through Spark's binary file source, so any store that Spark reads will do."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

_PLY = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    ship(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """path, shape and one row for each element: index (row-major) and value."""

    def run(batches):
        for b in batches:
            for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a = np.load(io.BytesIO(c), allow_pickle=False)
                flat = a.astype(np.float64).ravel()
                for lo in range(0, len(flat), 65536):
                    part = flat[lo : lo + 65536]
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(part)), pa.array([list(a.shape)] * len(part), pa.list_(pa.int64())), pa.array(np.arange(lo, lo + len(part))), pa.array(part)], names=["path", "shape", "index", "value"])

    return _files(spark, path, "*.npy").mapInArrow(run, "path string, shape array<long>, index long, value double")


def read_npz(spark: SparkSession, path: str, schema: str, defaults: dict | None = None) -> DataFrame:
    """Struct-of-arrays archives as rows: path, row_id and the columns of ``schema`` (DDL); a missing or misfitting member takes its default or null.

    The first column of the schema that is present decides the number of rows.
    """
    names = [c.strip().split()[0] for c in schema.split(",")]
    spark_schema = spark.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in spark_schema.fields]
    defaults = defaults or {}

    def run(batches):
        for b in batches:
            for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with np.load(io.BytesIO(c), allow_pickle=False) as z:
                    n = next((len(z[k]) for k in names if k in z.files and z[k].ndim), 0)
                    cols = []
                    for k, kind in zip(names, kinds, strict=True):
                        v = z[k] if k in z.files and z[k].ndim and len(z[k]) == n else None
                        if v is None:
                            cols.append(pa.array([defaults.get(k)] * n, kind))
                        elif v.ndim > 1:
                            cols.append(pa.array(v.reshape(n, -1).tolist(), kind))
                        else:
                            cols.append(pa.array(v).cast(kind))
                for lo in range(0, n, 65536):
                    m = min(65536, n - lo)
                    yield pa.RecordBatch.from_arrays([pa.array([p] * m), pa.array(np.arange(lo, lo + m)), *[x.slice(lo, m) for x in cols]], names=["path", "row_id", *names])

    return _files(spark, path, "*.npz").mapInArrow(run, f"path string, row_id long, {schema}")


def ply_header(data: bytes) -> tuple[str, list, int]:
    """(format, [(element, count, [(name, type, list's count type or None)])], where the body starts)."""
    if not data.startswith(b"ply"):
        raise ValueError("not a PLY file")
    end = data.index(b"end_header")
    body = data.index(b"\n", end) + 1
    form, elements = "", []
    for line in data[:end].decode("ascii").splitlines()[1:]:
        t = line.split()
        if not t or t[0] in ("comment", "obj_info"):
            continue
        if t[0] == "format":
            form = t[1]
        elif t[0] == "element":
            elements.append((t[1], int(t[2]), []))
        elif t[0] == "property":
            elements[-1][2].append((t[4], _PLY[t[3]], _PLY[t[2]]) if t[1] == "list" else (t[2], _PLY[t[1]], None))
    return form, elements, body


def parse_ply(data: bytes) -> dict[str, dict[str, list]]:
    form, elements, at = ply_header(data)
    out: dict[str, dict[str, list]] = {}
    words = iter(data[at:].split()) if form == "ascii" else None
    order = ">" if form == "binary_big_endian" else "<"
    for name, n, props in elements:
        cols: dict[str, list] = {p[0]: [] for p in props}
        if words is None and all(p[2] is None for p in props):
            rows = np.frombuffer(data, np.dtype([(p[0], order + p[1]) for p in props]), n, at)
            at += rows.nbytes
            cols = {p[0]: rows[p[0]].tolist() for p in props}
        else:
            for _ in range(n):
                for key, kind, count in props:
                    number = float if kind[0] == "f" else int
                    if words is not None:
                        cols[key].append(number(next(words)) if count is None else [number(next(words)) for _ in range(int(next(words)))])
                        continue
                    k = 1
                    if count is not None:
                        k = int(np.frombuffer(data, order + count, 1, at)[0])
                        at += np.dtype(count).itemsize
                    v = np.frombuffer(data, order + kind, k, at).tolist()
                    at += k * np.dtype(kind).itemsize
                    cols[key].append(v if count is not None else v[0])
        out[name] = cols
    return out


def read_ply_vertices(spark: SparkSession, path: str) -> DataFrame:
    """path, vid, x, y, z, normals and colours (null where the file has none)."""
    names = ("x", "y", "z", "nx", "ny", "nz", "red", "green", "blue")

    def run(batches):
        for b in batches:
            for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = parse_ply(c).get("vertex", {})
                n = len(v.get("x", []))
                yield pa.RecordBatch.from_arrays([pa.array([p] * n), pa.array(np.arange(n)), *[pa.array(list(map(float, v[k])) if k in v else [None] * n, pa.float64()) for k in names]], names=["path", "vid", *names])

    return _files(spark, path, "*.ply").mapInArrow(run, "path string, vid long, " + ", ".join(f"{k} double" for k in names))


def read_ply_faces(spark: SparkSession, path: str) -> DataFrame:
    """path, fid, ring: the corners of each face; ``mesh.fan`` makes triangles of them."""

    def run(batches):
        for b in batches:
            for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f = parse_ply(c).get("face", {})
                rings = next((v for k, v in f.items() if k in ("vertex_indices", "vertex_index")), [])
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(rings)), pa.array(np.arange(len(rings))), pa.array(rings, pa.list_(pa.int64()))], names=["path", "fid", "ring"])

    return _files(spark, path, "*.ply").mapInArrow(run, "path string, fid long, ring array<long>")


def matrix_yaml(text: str, key: str) -> np.ndarray:
    """One matrix node of a storage YAML with rows, cols and data."""
    import yaml

    lines = [x for x in text.splitlines() if not x.startswith("%")]
    node = yaml.safe_load("\n".join(lines).replace("!!opencv-matrix", ""))[key]
    return np.array(node["data"], float).reshape(node["rows"], node["cols"])


def write_ply(vertices: DataFrame, path: str) -> None:
    """One ASCII PLY text: a header, then points in vid order. The order needs one file, so this is for one object's cloud."""
    n = vertices.count()
    rows = vertices.select("vid", F.format_string("%.6f %.6f %.6f", "x", "y", "z").alias("value"))
    head = ["ply", "format ascii 1.0", f"element vertex {n}", "property float x", "property float y", "property float z", "end_header"]
    first = vertices.sparkSession.createDataFrame([(i - len(head), h) for i, h in enumerate(head)], "vid long, value string")
    first.unionByName(rows).orderBy("vid").coalesce(1).select("value").write.text(path)


def obj_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """kind, n, value: OBJ lines with 1-based corners and 9 decimals, to be written in order of (kind, n)."""
    v = vertices.select(F.lit(0).alias("kind"), F.col("vid").alias("n"), F.format_string("v %.9f %.9f %.9f", "x", "y", "z").alias("value"))
    f = faces.select(F.lit(1).alias("kind"), F.col("fid").alias("n"), F.format_string("f %d %d %d", F.col("a") + 1, F.col("b") + 1, F.col("c") + 1).alias("value"))
    return v.unionByName(f)


def write_obj(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    obj_lines(vertices, faces).orderBy("kind", "n").coalesce(1).select("value").write.text(path)


def for_blender(vertices: DataFrame) -> DataFrame:
    """(x, -z, y) in metres from millimetres."""
    return vertices.withColumns({"x": F.col("x") * 0.001, "y": -F.col("z") * 0.001, "z": F.col("y") * 0.001})


MATERIAL = ("newmtl neutral", "Ka 0.2 0.2 0.2", "Kd 0.8 0.8 0.8", "Ks 0.0 0.0 0.0", "d 1.0", "illum 1")


def write_mtl(spark: SparkSession, path: str) -> None:
    """A neutral material beside an OBJ."""
    spark.createDataFrame(list(enumerate(MATERIAL)), "n int, value string").coalesce(1).orderBy("n").select("value").write.text(path)
