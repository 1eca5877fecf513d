"""Landmark and mesh files as DataFrames."""

from __future__ import annotations

import base64
import re
import struct
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g

MARKUPS = "markups array<struct<coordinateSystem: string, controlPoints: array<struct<label: string, description: string, position: array<double>>>>>"
MESH_SUFFIXES = ("ply", "stl", "vtk", "vtp", "obj")


def files(spark: SparkSession, folder: str, suffixes: tuple[str, ...]) -> DataFrame:
    """(key, path) of a folder's files with these suffixes; contents are not read."""
    name = F.regexp_extract("path", "[^/]*$", 0)
    listed = spark.read.format("binaryFile").load(folder).select("path")
    return listed.where(F.lower(name).rlike(rf"\.({'|'.join(suffixes)})$")).select(g.normalise_key(name).alias("key"), "path")


def read_markups(spark: SparkSession, path: str) -> DataFrame:
    """Control points of the first markup of each JSON file, in RAS, with their index."""
    rows = spark.read.schema(MARKUPS).option("multiLine", True).json(path).withColumn("path", F.input_file_name())
    first = F.get("markups", F.lit(0))
    rows = rows.select("path", first["coordinateSystem"].alias("system"), F.posexplode(first["controlPoints"]).alias("pidx", "point"))
    p = tuple(F.get("point.position", F.lit(k)) for k in range(3))
    key = g.normalise_key(F.url_decode(F.regexp_extract("path", "[^/]*$", 0)))
    return rows.select(key.alias("key"), "pidx", *(c.alias(n) for c, n in zip(g.to_ras(p, F.coalesce("system", F.lit(""))), "xyz", strict=True)), "point.label", "point.description")


def read_fcsv(spark: SparkSession, path: str) -> DataFrame:
    """Points of FCSV files in RAS, numbered in file order; rows that do not parse are left out."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                text, n = content.decode("utf-8", "replace"), 0
                system = re.search(r"(?im)^#\s*CoordinateSystem\s*=\s*(\S+)", text)
                for line in text.splitlines():
                    fields = line.split(",")
                    if line.startswith("#") or len(fields) < 4:
                        continue
                    try:
                        x, y, z = map(float, fields[1:4])
                    except ValueError:
                        continue
                    out.append((path, system[1] if system else "", n, x, y, z, fields[11] if len(fields) > 11 else None))
                    n += 1
            yield pd.DataFrame(out, columns=["path", "system", "pidx", "x", "y", "z", "label"])

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, system string, pidx int, x double, y double, z double, label string")
    return rows.select(g.normalise_key(F.regexp_extract("path", "[^/]*$", 0)).alias("key"), "pidx", *(c.alias(n) for c, n in zip(g.to_ras(g.vector(), F.col("system")), "xyz", strict=True)), "label")


def _ply(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    head, _, body = data.partition(b"end_header")
    body = body[body.index(b"\n") + 1 :]
    lines = head.decode("ascii", "replace").split("\n")
    kind = next(line.split()[1] for line in lines if line.startswith("format"))
    counts = {x.split()[1]: int(x.split()[2]) for x in lines if x.startswith("element")}
    if kind == "ascii":
        rows = body.decode().split("\n")
        v = np.array([r.split()[:3] for r in rows[: counts["vertex"]]], float).reshape(-1, 3)
        polygons = [list(map(int, r.split()[1:])) for r in rows[counts["vertex"] : counts["vertex"] + counts.get("face", 0)]]
        return v, _fan(polygons)
    order = "<" if "little" in kind else ">"
    types = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}
    fields, element, lists = [], None, None
    for line in lines:
        w = line.split()
        if w[:1] == ["element"]:
            element = w[1]
        elif w[:1] == ["property"] and element == "vertex":
            fields.append((w[2], order + types[w[1]]))
        elif w[:2] == ["property", "list"] and element == "face":
            lists = (np.dtype(order + types[w[2]]), np.dtype(order + types[w[3]]))
    rows = np.frombuffer(body, np.dtype(fields), counts["vertex"])
    at, polygons = rows.nbytes, []
    for _ in range(counts.get("face", 0)):
        n = int(np.frombuffer(body, lists[0], 1, at)[0])
        at += lists[0].itemsize
        polygons.append(np.frombuffer(body, lists[1], n, at).tolist())
        at += n * lists[1].itemsize
    return np.stack([rows["x"], rows["y"], rows["z"]], 1).astype(float), _fan(polygons)


def _fan(polygons: list[list[int]]) -> np.ndarray:
    return np.array([(p[0], p[k], p[k + 1]) for p in polygons for k in range(1, len(p) - 1)], np.int64).reshape(-1, 3)


def _obj(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    v, polygons = [], []
    for line in data.decode("utf-8", "replace").splitlines():
        w = line.split()
        if w[:1] == ["v"]:
            v.append([float(x) for x in w[1:4]])
        elif w[:1] == ["f"]:
            at = [int(x.split("/")[0]) for x in w[1:]]
            polygons.append([k - 1 if k > 0 else len(v) + k for k in at])
    return np.array(v, float).reshape(-1, 3), _fan(polygons)


def _stl(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = struct.unpack_from("<I", data, 80)[0] if len(data) >= 84 else -1
    if len(data) == 84 + 50 * n:
        tri = np.frombuffer(data, np.dtype([("n", "<f4", 3), ("p", "<f4", (3, 3)), ("a", "<u2")]), n, 84)["p"].reshape(-1, 3).astype(float)
    else:
        tri = np.array(re.findall(rb"vertex\s+(\S+)\s+(\S+)\s+(\S+)", data), dtype="S32").astype(float).reshape(-1, 3)
    v, at = np.unique(tri, axis=0, return_inverse=True)
    return v, at.reshape(-1, 3)


def _vtk(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    words = data.decode("ascii", "replace").split()
    at = words.index("POINTS")
    n = int(words[at + 1])
    v = np.array(words[at + 3 : at + 3 + 3 * n], float).reshape(-1, 3)
    polygons = []
    if "POLYGONS" in words:
        k = words.index("POLYGONS")
        count, k = int(words[k + 1]), k + 3
        for _ in range(count):
            size = int(words[k])
            polygons.append([int(x) for x in words[k + 1 : k + 1 + size]])
            k += 1 + size
    return v, _fan(polygons)


_VTP_TYPES = {"Float32": "f4", "Float64": "f8", "Int8": "i1", "UInt8": "u1", "Int16": "i2", "UInt16": "u2", "Int32": "i4", "UInt32": "u4", "Int64": "i8", "UInt64": "u8"}


def _vtp(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """XML PolyData with its arrays as text, base64 or appended, stored or deflated."""
    raw = re.search(rb"<AppendedData[^>]*encoding=\"(raw|base64)\"[^>]*>\s*_", data)
    tail = data[raw.end() :] if raw else b""
    if raw:
        data = data[: raw.start()] + b"</VTKFile>"
    root = ET.fromstring(data)
    order = "<" if root.get("byte_order", "LittleEndian") == "LittleEndian" else ">"
    head = np.dtype(order + _VTP_TYPES[root.get("header_type", "UInt32")])
    packed = root.get("compressor") is not None

    def plain(source: bytes, coded: bool) -> bytes:
        """Bytes behind a header: one size, or block counts and sizes if deflated."""
        take = lambda n: base64.b64decode(source[: -(-n // 3) * 4])[:n] if coded else source[:n]
        if not packed:
            n = int(np.frombuffer(take(head.itemsize), head)[0])
            return take(head.itemsize + n)[head.itemsize :]
        blocks = int(np.frombuffer(take(head.itemsize), head)[0])
        lead = (3 + blocks) * head.itemsize
        sizes = np.frombuffer(take(lead), head)[3:].astype(int)
        skip = -(-lead // 3) * 4 if coded else lead  # the header is coded by itself
        body = base64.b64decode(source[skip : skip + -(-int(sizes.sum()) // 3) * 4]) if coded else source[skip : skip + int(sizes.sum())]
        cuts = np.concatenate(([0], np.cumsum(sizes)))
        return b"".join(zlib.decompress(body[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True))

    def values(node) -> np.ndarray:
        if node is None:
            return np.zeros(0)
        kind = np.dtype(order + _VTP_TYPES[node.get("type")])
        if node.get("format") == "ascii":
            return np.array((node.text or "").split(), kind.newbyteorder("="))
        if node.get("format") == "appended":
            return np.frombuffer(plain(tail[int(node.get("offset")) :], raw[1] == b"base64"), kind)
        return np.frombuffer(plain("".join((node.text or "").split()).encode(), True), kind)

    v, polygons = [], []
    for piece in root.iter("Piece"):
        points = values(piece.find("Points/DataArray")).astype(float).reshape(-1, 3)
        link, ends = (values(piece.find(f"Polys/DataArray[@Name='{n}']")).astype(int).tolist() for n in ("connectivity", "offsets"))
        at = sum(map(len, v))
        polygons += [[at + k for k in link[a:b]] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []
        v.append(points)
    return np.concatenate(v) if v else np.zeros((0, 3)), _fan(polygons)


PARSERS = {"ply": _ply, "obj": _obj, "stl": _stl, "vtk": _vtk, "vtp": _vtp}


def parse_meshes(spark: SparkSession, path: str) -> DataFrame:
    """(key, path, v, f, error) of each PLY, OBJ, STL, ASCII VTK and VTP file, read once: positions
    and corners of all vertices and triangles (polygons as fans) as arrays, or why it cannot be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    v, f = PARSERS[path.rpartition(".")[2].lower()](content)
                    if len(f) and not (0 <= f.min() and f.max() < len(v)):
                        raise ValueError("a face has a corner that is not there")
                    got = [np.asarray(v, float).ravel(), np.asarray(f, np.int64).ravel(), None]
                except (ValueError, KeyError, IndexError, StopIteration, AttributeError, TypeError, UnicodeDecodeError, struct.error, zlib.error, ET.ParseError) as e:
                    got = [None, None, f"{type(e).__name__}: {e}"]
                yield pd.DataFrame([[path, *got]], columns=["path", "v", "f", "error"])

    found = spark.read.format("binaryFile").load(path).where(F.lower("path").rlike(rf"\.({'|'.join(MESH_SUFFIXES)})$")).select("path", "content")
    rows = found.mapInPandas(run, "path string, v array<double>, f array<long>, error string")
    return rows.select(g.normalise_key(F.regexp_extract("path", "[^/]*$", 0)).alias("key"), "path", "v", "f", "error")


def exploded(meshes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, vid, x, y, z) and (key, fid, a, b, c) of :func:`parse_meshes`, without files that have an error."""

    def rows(of: str, number: str, names: str) -> DataFrame:
        at = F.sequence(F.lit(0), (F.size(of) / 3).cast("int") - 1)
        triples = F.transform(at, lambda i: F.struct(*(F.get(of, i * 3 + k).alias(n) for k, n in enumerate(names))))
        some = meshes.where(F.size(of) > 0).select("key", F.posexplode(triples).alias("n", "row"))
        return some.select("key", F.col("n").cast("long").alias(number), "row.*")

    return rows("v", "vid", "xyz"), rows("f", "fid", "abc")


def read_meshes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(key, vid, x, y, z) and (key, fid, a, b, c) of the meshes of a folder; files that cannot
    be read are left out. To read them once for both, keep :func:`parse_meshes` and explode that."""
    return exploded(parse_meshes(spark, path))


def json_attribute(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with the whole number at ``name`` of a JSON object column, as ``value``."""
    return rows.withColumn("value", F.from_json(column, f"`{name}` bigint")[name])
