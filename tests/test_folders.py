"""Model folders by their names, paired imports and meshes that cannot be read."""

import json

import numpy as np
import pytest

from shapelake.sources import folders, readers


def markup(path, n, shift=0.0):
    points = [{"label": f"p{i}", "position": [i + shift, 1.0, 2.0]} for i in range(n)]
    path.write_text(json.dumps({"markups": [{"coordinateSystem": "RAS", "controlPoints": points}]}))


def fcsv(path, n):
    path.write_text("# Markups fiducial file\n# CoordinateSystem = RAS\n" + "".join(f"m{i},{i},{i + 1},{i + 2},0\n" for i in range(n)) + "short,1\n")


def archive(path, n, k=2):
    np.savez(path, mean_shape=np.arange(n * 3.0).reshape(n, 3), modes=np.arange(n * 3.0 * k).reshape(n, 3, k), eigenvalues=np.r_[np.arange(1.0, k), 0.0])


PLY = "ply\nformat ascii 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nelement face 2\nproperty list uchar int vertex_indices\nend_header\n0 0 0\n1 0 0\n0 1 0\n0 0 0\n3 0 1 2\n3 3 1 2\n"


def folder(root, name, *, marks=(), mesh="b.ply", ssm="ssm_model.npz", size=5, manifest=None):
    at = root / name
    at.mkdir()
    if mesh:
        (at / mesh).write_text(PLY)
    if ssm:
        archive(at / ssm, size)
    for n, count in marks:
        (fcsv if n.endswith("fcsv") else markup)(at / n, count)
    if manifest is not None:
        (at / "manifest.json").write_text(json.dumps({"files": manifest}))
    return at


@pytest.fixture(scope="module")
def models(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("models")
    folder(root, "said", marks=[("one.json", 5), ("two.json", 3)], manifest={"model": "b.ply", "dense": "one.json", "sparse": "two.json", "ssm": "ssm_model.npz"})
    folder(root, "silent", marks=[("one.json", 5)], manifest={"model": "b.ply", "dense": "one.json"})  # the model's own name
    folder(root, "hints", marks=[("a_sparse.json", 9), ("z_Dense.fcsv", 5)])
    folder(root, "counts", marks=[("a.json", 3), ("b.fcsv", 5), ("c.json", 4)])
    folder(root, "half_hint", marks=[("my_sparse.json", 9), ("other.json", 5)], size=7)  # one hint is none
    folder(root, "swap", marks=[("dense.json", 3), ("sparse.json", 5)])
    folder(root, "neither", marks=[("dense.json", 3), ("sparse.json", 4)])
    folder(root, "alone", marks=[("only.fcsv", 5)], ssm="other.npz", mesh="z.STL")
    folder(root, "no_mesh", marks=[("only.json", 5)], mesh=None)
    folder(root, "no_marks")
    folder(root, "torn", marks=[("only.json", 5)], ssm=None)
    (root / "torn" / "ssm_model.npz").write_bytes(b"not an archive")
    folder(root, "gone", marks=[("one.json", 5)], ssm=None, manifest={"model": "b.ply", "dense": "one.json"})
    (root / "notes").mkdir()
    (root / "notes" / "readme.txt").write_text("nothing here")
    return folders.load_models(spark, str(root))


def test_parts_go_by_manifest_hints_counts_and_size(models):
    short = lambda p: p and p.rpartition("/")[2]
    got = {short(r.model): (short(r.mesh), short(r.ssm), short(r.dense), short(r.sparse), r.swapped) for r in models.parts.collect()}
    own = ("b.ply", "ssm_model.npz")
    assert got == {
        "said": (*own, "one.json", "two.json", False),
        "silent": (*own, "one.json", None, False),
        "hints": (*own, "z_Dense.fcsv", "a_sparse.json", False),
        "counts": (*own, "b.fcsv", "c.json", False),
        "half_hint": (*own, "my_sparse.json", "other.json", False),
        "swap": (*own, "sparse.json", "dense.json", True),
        "neither": (*own, "dense.json", "sparse.json", False),
        "alone": ("z.STL", "other.npz", "only.fcsv", None, False),
        "no_mesh": (None, "ssm_model.npz", "only.json", None, False),
        "no_marks": (*own, None, None, False),
        "torn": (*own, "only.json", None, False),
        "gone": (*own, "one.json", None, False),
    }
    errors = {short(r.model): r.error for r in models.parts.where("error IS NOT NULL").collect()}
    assert errors.keys() == {"no_mesh", "no_marks", "torn", "gone"}
    assert errors["no_mesh"] == "missing: mesh" and errors["no_marks"] == "missing: dense" and "not there" in errors["gone"]


def test_whole_models_load_with_eigenvalues_above_the_floor(models):
    ids = {r.model.rpartition("/")[2]: r.model for r in models.parts.where("error IS NULL").collect()}
    mean = models.mean.toPandas()
    assert set(mean["model"]) == set(ids.values()) and len(mean) == 7 * 5 + 7
    one = mean[mean["model"] == ids["swap"]].sort_values("pidx")[["x", "y", "z"]].to_numpy()
    assert (one == np.arange(15.0).reshape(5, 3)).all()
    modes = models.modes.toPandas().query("model == @ids['swap']").sort_values(["mode", "pidx"])[["x", "y", "z"]].to_numpy()
    assert (modes.reshape(2, 5, 3) == np.moveaxis(np.arange(30.0).reshape(5, 3, 2), 2, 0)).all()
    values = {(r.model, r["mode"]): r.v for r in models.eigenvalues.collect()}
    assert values[ids["swap"], 0] == 1.0 and values[ids["swap"], 1] == 1e-10


def test_pairs_are_imported_with_clean_meshes(spark, tmp_path):
    meshes, marks = tmp_path / "meshes", tmp_path / "marks"
    meshes.mkdir(), marks.mkdir()
    for name in ("A.ply", "b.ply", "c.ply"):
        (meshes / name).write_text(PLY)
    (meshes / "bad.ply").write_text(PLY.replace("3 3 1 2", "3 9 1 2"))
    for name, n in (("a.mrk.json", 3), ("bad.mrk.json", 2), ("d.mrk.json", 1)):
        markup(marks / name, n)
    fcsv(marks / "b.fcsv", 4)
    v, f, m = folders.import_pairs(spark, str(meshes), str(marks))
    assert {(r.specimen_id, r["count"]) for r in m.groupBy("specimen_id").count().collect()} >= {("a", 3), ("b", 4)}
    assert {(r.specimen_id, r["count"]) for r in v.groupBy("specimen_id").count().collect()} == {("a", 3), ("b", 3)}  # two vertices were one
    assert f.count() == 2
    errors = {r.key: r.error for r in readers.parse_meshes(spark, str(meshes)).collect()}
    assert errors["a"] is None and "corner" in errors["bad"]
