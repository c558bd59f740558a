"""PLY meshes: ASCII or little-endian binary files, one bounded artefact and one row of input each."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Codes of the format's types (fixed values of the format).
TYPES = {
    "char": "i1", "uchar": "u1", "short": "<i2", "ushort": "<u2", "int": "<i4", "uint": "<u4", "float": "<f4", "double": "<f8",
    "int8": "i1", "uint8": "u1", "int16": "<i2", "uint16": "<u2", "int32": "<i4", "uint32": "<u4", "float32": "<f4", "float64": "<f8",
}


def _parse(data: bytes) -> dict[str, list[dict]]:
    """Rows of each element, lists as Python lists."""
    import numpy as np

    head, _, body = data.partition(b"end_header")
    lines = head.decode("ascii").split("\n")
    if not lines or lines[0].strip() != "ply":
        raise ValueError("not a PLY file")
    body = body[body.index(b"\n") + 1 :]
    binary, elements = False, []
    for line in (x.split() for x in lines[1:]):
        if line[:1] == ["format"]:
            if line[1] not in ("ascii", "binary_little_endian"):
                raise ValueError(f"not read: {line[1]}")
            binary = line[1] != "ascii"
        elif line[:1] == ["element"]:
            elements.append((line[1], int(line[2]), []))
        elif line[:1] == ["property"]:
            elements[-1][2].append((line[-1], line[2:4] if line[1] == "list" else line[1]))
    out, at, tokens = {}, 0, iter(body.split()) if not binary else None

    def take(kind: str):
        nonlocal at
        if tokens is not None:
            return (float if "f" in TYPES[kind] else int)(next(tokens))
        t = np.dtype(TYPES[kind])
        value = np.frombuffer(body, t, 1, at)[0].item()
        at += t.itemsize
        return value

    for name, n, properties in elements:
        flat = all(isinstance(k, str) for _, k in properties)
        if binary and flat:
            t = np.dtype([(p, TYPES[k]) for p, k in properties])
            rows = np.frombuffer(body, t, n, at)
            at += t.itemsize * n
            out[name] = [dict(zip(t.names, r.item())) for r in rows]
        else:
            out[name] = [{p: take(k) if isinstance(k, str) else [take(k[1]) for _ in range(take(k[0]))] for p, k in properties} for _ in range(n)]
    return out


def read_ply(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """vertices (file, vid from 0, x, y, z and r, g, b in 0 to 1 where there are colours) and faces (file, fid from 0, v0..v2;
    polygons as fans)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def vertices(batches):
        import pyarrow as pa

        names = ("file", "vid", "x", "y", "z", "r", "g", "b")
        for batch in batches:
            for file, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows = _parse(data).get("vertex", [])
                colour = [tuple(r[c] / 255 if c in r else None for c in ("red", "green", "blue")) for r in rows]
                columns = [[file] * len(rows), list(range(len(rows))), *([float(r[a]) for r in rows] for a in "xyz"), *([c[i] for c in colour] for i in range(3))]
                types = [pa.string(), pa.int64(), *[pa.float64()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], list(names))

    def faces(batches):
        import pyarrow as pa

        for batch in batches:
            for file, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                polygons = [next(v for v in r.values() if isinstance(v, list)) for r in _parse(data).get("face", [])]
                tris = [(p[0], p[i], p[i + 1]) for p in polygons for i in range(1, len(p) - 1)]
                columns = [[file] * len(tris), list(range(len(tris))), *([t[i] for t in tris] for i in range(3))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), *[pa.int64()] * 4])], ["file", "fid", "v0", "v1", "v2"])

    return (
        files.mapInArrow(vertices, "file string, vid long, x double, y double, z double, r double, g double, b double"),
        files.mapInArrow(faces, "file string, fid long, v0 long, v1 long, v2 long"),
    )


def ply_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """part, id, text of an ASCII file; vertices are numbered densely from 0."""
    n, m = vertices.agg(F.count("*").alias("n")), faces.agg(F.count("*").alias("m"))
    head = n.crossJoin(m).select(F.posexplode(F.array(
        F.lit("ply"), F.lit("format ascii 1.0"), F.concat(F.lit("element vertex "), "n"), F.lit("property double x"), F.lit("property double y"), F.lit("property double z"),
        F.concat(F.lit("element face "), "m"), F.lit("property list uchar int vertex_indices"), F.lit("end_header"))).alias("id", "text"))
    v = vertices.select(F.lit(1).alias("part"), F.col("vid").alias("id"), F.format_string("%.6f %.6f %.6f", "x", "y", "z").alias("text"))
    f = faces.select(F.lit(2).alias("part"), F.col("fid").alias("id"), F.concat_ws(" ", F.lit("3"), "v0", "v1", "v2").alias("text"))
    return head.select(F.lit(0).alias("part"), F.col("id").cast("long").alias("id"), "text").unionByName(v).unionByName(f)


def write_ply(lines: DataFrame, path: str) -> None:
    """One text file in a folder, in the one order the format has."""
    lines.repartitionByRange(1, "part", "id").sortWithinPartitions("part", "id").select("text").write.mode("overwrite").text(os.fspath(path))
