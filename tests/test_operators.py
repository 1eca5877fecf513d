"""Operators and readers by what must hold of their results."""

import base64
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapelake.functions import geometry as g
from shapelake.operators import kernels, mesh, neighbors, points, registration, segmentation, shape_model
from shapelake.sources import readers, store

POINTS = "specimen_id long, pidx int, x double, y double, z double"


def turn(rng):
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    return q * np.sign(np.linalg.det(q))


def frame(spark, shapes):
    return spark.createDataFrame([(s, p, *map(float, xyz)) for s, shape in shapes.items() for p, xyz in enumerate(shape)], POINTS)


def arrays(df):
    got = df.toPandas().sort_values(["specimen_id", "pidx"])
    return {s: part[["x", "y", "z"]].to_numpy() for s, part in got.groupby("specimen_id")}


@pytest.fixture(scope="module")
def posed():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(30, 3)) * [3, 1.5, 0.6]
    poses = {k: (rng.uniform(0.5, 2), turn(rng), rng.normal(size=3)) for k in range(6)}
    return base, {k: s * base @ r.T + t for k, (s, r, t) in poses.items()}


def test_alignment_recovers_poses(spark, posed):
    base, shapes = posed
    template = frame(spark, {0: base})
    for shape in arrays(registration.align(frame(spark, shapes), template)).values():
        assert shape == pytest.approx(base, abs=1e-9)
    rigid = arrays(registration.align(frame(spark, shapes), template, scaling=False))
    assert all(np.linalg.norm(rigid[k] - rigid[k].mean(0)) == pytest.approx(np.linalg.norm(shapes[k] - shapes[k].mean(0))) for k in shapes)


def test_procrustes_mean_of_copies_is_the_shape(spark, posed):
    base, shapes = posed
    mean = registration.procrustes_mean(frame(spark, shapes)).toPandas().sort_values("pidx")[["x", "y", "z"]].to_numpy()
    s, r, t = kernels.similarity_fit(mean, base)
    assert s * mean @ r.T + t == pytest.approx(base, abs=1e-6)


def test_spline_interpolates_and_smooth_warps_hold_constraints(spark, posed):
    base, shapes = posed
    rng = np.random.default_rng(1)
    targets = base[:12] + rng.normal(size=(12, 3)) * 0.1
    to = frame(spark, {0: targets})
    warped = arrays(registration.tps_warp(frame(spark, shapes), to))
    assert all(w[:12] == pytest.approx(targets, abs=1e-6) for w in warped.values())
    faces = spark.createDataFrame([(k, k, k + 1, k + 2) for k in range(28)], "fid int, a int, b int, c int")
    hard = arrays(registration.biharmonic_warp(frame(spark, shapes), to, faces))
    assert all(w[:12] == pytest.approx(targets, abs=1e-9) for w in hard.values())


def test_few_landmarks_give_an_affine_spline():
    p = np.array([[0.0, 0, 0], [1, 0, 0], [0, 1, 0]])
    w, a = kernels.tps_fit(p, p + 1)
    assert kernels.tps_apply(p, p, w, a) == pytest.approx(p + 1)


@pytest.mark.parametrize("method", ["icp", "cpd"])
def test_registration_without_correspondence(spark, method):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 3)) * [3, 1.5, 0.6]
    shapes = {}
    for k in range(3):
        a = 0.15 * (k + 1)
        r = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])
        shapes[k] = (base @ r.T + 0.1)[rng.permutation(40)]
    diagonal = np.linalg.norm(np.ptp(base, axis=0))
    for row in registration.register(frame(spark, shapes), frame(spark, {0: base}), method).collect():
        assert row.error is None and row.rmse < 0.05 * diagonal


def test_batch_transfer_reports_errors_and_goes_on(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(25, 3)) * [3, 1.5, 0.6]
    shapes = {1: base + 0.2, 2: np.full((25, 3), np.nan)}
    got = registration.transfer(frame(spark, shapes), frame(spark, {0: base}), frame(spark, {0: base[:5]})).collect()
    good = np.array([[r.x, r.y, r.z] for r in sorted((r for r in got if r.specimen_id == 1), key=lambda r: r.pidx)])
    assert good == pytest.approx(base[:5] + 0.2, abs=0.05)
    assert [r.specimen_id for r in got if r.error] == [2]
    with pytest.raises(ValueError, match="unknown"):
        registration.register(frame(spark, shapes), frame(spark, {0: base}), "magic")


def test_samples_of_a_target_count(spark):
    rng = np.random.default_rng(23)
    cloud = rng.normal(size=(5_000, 3)) * [3, 1.2, 0.35]
    cloud[:, 2] += 0.08 * cloud[:, 0] ** 2
    shapes = frame(spark, {1: cloud, 2: cloud[:30], 3: np.zeros((200, 3))})
    got = registration.target_count_sample(shapes, 100).groupBy("specimen_id").agg(F.countDistinct("pidx").alias("n"), F.count("pidx").alias("m")).collect()
    assert {r.specimen_id: (r.n, r.m) for r in got} == {1: (100, 100), 2: (30, 30), 3: (100, 100)}
    first, again = (sorted(map(tuple, registration.farthest(shapes.where("specimen_id = 1"), 50).collect())) for _ in range(2))
    assert first == again and len(first) == 50


def test_neighbours_equal_brute_force_in_blocks(spark):
    rng = np.random.default_rng(4)
    cloud = rng.integers(0, 4, (60, 3)).astype(float)  # many ties
    p = frame(spark, {1: cloud, 2: cloud[:3], 3: cloud[:1]})
    got = {}
    for r in neighbors.k_nearest(p, p, 4, same=True, block=7).collect():
        got.setdefault((r.specimen_id, r.qidx), []).append((r["rank"], r.tidx, r.d2))
    for i in range(60):
        d = ((cloud - cloud[i]) ** 2).sum(1)
        want = sorted((d[j], j) for j in range(60) if j != i)[:4]
        assert [(t, v) for _, t, v in sorted(got[1, i])] == [(j, v) for v, j in want]
    assert len(got[2, 0]) == 2 and (3, 0) not in got


def test_model_of_shapes(spark, tmp_path):
    rng = np.random.default_rng(5)
    base, move = rng.normal(size=(7, 3)), rng.normal(size=(2, 7, 3))
    shapes = {k: base + b[0] * move[0] + b[1] * move[1] for k, b in enumerate(rng.normal(size=(40, 2)))}
    mean, modes, eig = shape_model.build(frame(spark, shapes))
    values = np.array([r.v for r in eig.orderBy("mode").collect()])
    table = modes.toPandas().sort_values(["mode", "pidx"])[["x", "y", "z"]].to_numpy().reshape(len(values), 21)
    assert len(values) == 2
    assert table @ table.T == pytest.approx(np.eye(2), abs=1e-8)
    assert values.sum() == pytest.approx(shape_model.total_variance(frame(spark, shapes)).first()[0])
    shape_model.validate(mean, modes, eig)
    store.save_model(mean, modes, eig, str(tmp_path), "m")
    loaded = store.load_model(spark, str(tmp_path), "m")
    assert loaded[1].count() == modes.count()
    assert store.wide_modes(modes).count() == 21
    none = shape_model.build(frame(spark, {1: base}))
    assert none[1].count() == 0 and none[2].count() == 0


def test_mesh_repair(spark):
    v = spark.createDataFrame([(1, k, float(k), 0.0 if k != 4 else float("nan"), 1.0) for k in range(200)], "specimen_id long, vid long, x double, y double, z double")
    f = spark.createDataFrame([(1, k, k, k + 1, k + 2) for k in range(198)], "specimen_id long, fid long, a long, b long, c long")
    kept, faces = mesh.repair(v, f)
    assert kept.count() == 199 and faces.count() == 195
    assert faces.agg(F.max("c")).first()[0] == 198 and kept.agg(F.max("vid")).first()[0] == 198
    with pytest.raises(ValueError, match="finite"):
        mesh.repair(v, f, most=0.001)
    with pytest.raises(ValueError, match="finite"):
        points.require_finite(v)


def test_curvature_of_a_sphere(spark):
    n = 24
    u, w = np.meshgrid(np.linspace(0.3, np.pi - 0.3, n), np.linspace(0, 2 * np.pi, n, endpoint=False), indexing="ij")
    xyz = 2 * np.stack([np.sin(u) * np.cos(w), np.sin(u) * np.sin(w), np.cos(u)], -1).reshape(-1, 3)
    faces, k = [], 0
    for i in range(n - 1):
        for j in range(n):
            a, b, c, d = i * n + j, i * n + (j + 1) % n, (i + 1) * n + j, (i + 1) * n + (j + 1) % n
            faces += [(k, a, c, b), (k + 1, b, c, d)]
            k += 2
    v = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(xyz)], "specimen_id long, vid long, x double, y double, z double")
    got = mesh.curvature(v, spark.createDataFrame(faces, "fid long, a long, b long, c long")).where(f"vid >= {8 * n} AND vid < {16 * n}").toPandas()
    assert got["mean_curvature"].median() == pytest.approx(0.5, rel=0.05)
    assert got["gauss_curvature"].median() == pytest.approx(0.25, rel=0.05)


def test_markups_files(spark, tmp_path):
    marks = {"markups": [{"coordinateSystem": "LPS", "controlPoints": [{"label": "a", "position": [1, 2, 3]}, {"label": "b", "position": [4, 5, 6]}]}]}
    (tmp_path / "Mouse_1.mrk.json").write_text(json.dumps(marks, indent=1))
    got = sorted(map(tuple, readers.read_markups(spark, str(tmp_path)).select("key", "pidx", "x", "y", "z", "label").collect()))
    assert got == [("mouse_1", 0, -1.0, -2.0, 3.0, "a"), ("mouse_1", 1, -4.0, -5.0, 6.0, "b")]
    other = tmp_path / "fcsv"
    other.mkdir()
    (other / "X.fcsv").write_text("# Markups\n# CoordinateSystem = RAS\nid,1,2,3\nbad,a,b,c\nid,4,5,6\n")
    assert sorted(map(tuple, readers.read_fcsv(spark, str(other)).select("key", "pidx", "x", "y", "z").collect())) == [("x", 0, 1.0, 2.0, 3.0), ("x", 1, 4.0, 5.0, 6.0)]
    written = str(tmp_path / "out")
    store.write_markups(frame(spark, {5: np.arange(6.0).reshape(2, 3)}), written)
    assert readers.read_markups(spark, written).count() in (1, 2)
    assert readers.files(spark, str(tmp_path), ("json",)).first().key == "mouse_1"


def test_mesh_files(spark, tmp_path):
    v, f = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)], [(0, 1, 2), (0, 2, 3)]
    (tmp_path / "a.ply").write_text("ply\nformat ascii 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nelement face 2\nproperty list uchar int vertex_indices\nend_header\n" + "\n".join(" ".join(map(str, p)) for p in v) + "\n" + "\n".join("3 " + " ".join(map(str, p)) for p in f) + "\n")
    head = b"ply\nformat binary_little_endian 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nelement face 2\nproperty list uchar int vertex_indices\nend_header\n"
    (tmp_path / "b.ply").write_bytes(head + b"".join(struct.pack("<3f", *p) for p in v) + b"".join(struct.pack("<B3i", 3, *p) for p in f))
    (tmp_path / "c.obj").write_text("\n".join("v " + " ".join(map(str, p)) for p in v) + "\nf 1/1 2/1 3/1\nf -4 -2 -1\n")
    (tmp_path / "d.stl").write_bytes(b"\0" * 80 + struct.pack("<I", 2) + b"".join(struct.pack("<12fH", 0, 0, 0, *v[a], *v[b], *v[c], 0) for a, b, c in f))
    (tmp_path / "e.vtk").write_text("# vtk DataFile Version 3.0\nx\nASCII\nDATASET POLYDATA\nPOINTS 4 float\n" + "\n".join(" ".join(map(str, p)) for p in v) + "\nPOLYGONS 1 5\n4 0 1 2 3\n")
    link, ends = np.array([0, 1, 2, 3], "<i8"), np.array([4], "<i8")
    arrays_of = [("Float32", "", np.array(v, "<f4")), ("Int64", "connectivity", link), ("Int64", "offsets", ends)]

    def vtp(form, packed, coded):
        parts, tail = [], b""
        for kind, name, values in arrays_of:
            body = values.tobytes()
            block = zlib.compress(body)
            lead = struct.pack("<4I", 1, len(body), 0, len(block)) if packed else struct.pack("<I", len(body))
            whole = (base64.b64encode(lead) + base64.b64encode(block) if packed else base64.b64encode(lead + body)) if coded else lead + (block if packed else body)
            text = " ".join(map(str, values.ravel())) if form == "ascii" else whole.decode() if form == "binary" else ""
            parts.append(f'<DataArray type="{kind}" Name="{name}" format="{form}" offset="{len(tail)}">{text}</DataArray>')
            tail += whole if form == "appended" else b""
        end = b'<AppendedData encoding="' + (b"base64" if coded else b"raw") + b'">_' + tail + b"</AppendedData></VTKFile>" if form == "appended" else b"</VTKFile>"
        extra = ' compressor="vtkZLibDataCompressor"' if packed else ""
        return f'<VTKFile type="PolyData" byte_order="LittleEndian" header_type="UInt32"{extra}><PolyData><Piece><Points>{parts[0]}</Points><Polys>{parts[1]}{parts[2]}</Polys></Piece></PolyData>'.encode() + end

    for name, how in {"f": ("ascii", False, True), "g": ("binary", False, True), "h": ("binary", True, True), "i": ("appended", True, False), "j": ("appended", False, True)}.items():
        (tmp_path / f"{name}.vtp").write_bytes(vtp(*how))
    vs, fs = readers.read_meshes(spark, str(tmp_path))
    tri = mesh.non_degenerate(vs.withColumnRenamed("key", "specimen_id"), fs.withColumnRenamed("key", "specimen_id"))
    assert {r.specimen_id: r["count"] for r in tri.groupBy("specimen_id").count().collect()} == dict.fromkeys("abcdefghij", 2)


def test_names_and_transforms(spark):
    names = ["mouse_atlas", "Mouse Atlas 2026", "", ".", "..", "../atlas", "atlas/model", "atlas\\model", "CON", "con.x", "name.", None]
    got = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string").select("k", g.safe_name(F.col("n")).alias("ok"))
    assert [r.ok for r in got.orderBy("k").collect()] == [True, True] + [False] * 10
    rng = np.random.default_rng(6)
    r, p = turn(rng), rng.normal(size=(4, 3))
    moved = arrays(points.transform(frame(spark, {1: p}), g.similarity_matrix(r.tolist(), 1.2, [1.0, 2.0, 3.0])))[1]
    assert moved == pytest.approx(1.2 * p @ r.T + [1, 2, 3])
