"""Column expressions for points, triangles, transforms and curvature."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def vector(prefix: str = "", names: str = "xyz") -> Vector:
    return tuple(F.col(f"{prefix}{n}") for n in names)


def minus(a: Vector, b: Vector) -> Vector:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def distance2(a: Vector, b: Vector) -> Column:
    return dot(minus(a, b), minus(a, b))


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def finite(value: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def all_finite(values: Vector) -> Column:
    return finite(values[0]) & finite(values[1]) & finite(values[2])


def apply_matrix(p: Vector, m: list[list[float]]) -> Vector:
    """A 4 x 4 transform in column convention: [p 1] times the transpose."""
    return tuple(p[0] * row[0] + p[1] * row[1] + p[2] * row[2] + row[3] for row in m[:3])


def similarity_matrix(rotation: list[list[float]], scale: float, shift: list[float]) -> list[list[float]]:
    """4 x 4 matrix of p -> scale * R p + shift."""
    return [[scale * r for r in row] + [t] for row, t in zip(rotation, shift, strict=True)] + [[0.0, 0.0, 0.0, 1.0]]


def to_ras(p: Vector, system: Column) -> Vector:
    """LPS (or code 0) coordinates with x and y negated; all others count as RAS."""
    flip = F.upper(F.trim(system)).isin("LPS", "0")
    return (F.when(flip, -p[0]).otherwise(p[0]), F.when(flip, -p[1]).otherwise(p[1]), p[2])


def principal_curvatures(mean: Column, gauss: Column) -> tuple[Column, Column]:
    """H +- sqrt(max(H^2 - K, 0)), the larger in absolute value first."""
    root = F.sqrt(F.greatest(mean * mean - gauss, F.lit(0.0)))
    a, b = mean + root, mean - root
    first = F.abs(a) >= F.abs(b)
    return F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)


def shape_index(k1: Column, k2: Column) -> Column:
    return F.lit(2.0) / F.pi() * F.atan2(k1 + k2, k1 - k2 + F.lit(1e-12))


def curvedness(k1: Column, k2: Column) -> Column:
    return F.sqrt((k1 * k1 + k2 * k2) / 2)


def triangle_normal(a: Vector, b: Vector, c: Vector) -> tuple[Vector, Column]:
    """Unit normal (norm plus 1e-12) and area of a triangle."""
    n = cross(minus(b, a), minus(c, a))
    size = norm(n)
    return tuple(v / (size + F.lit(1e-12)) for v in n), size / 2


def barycentric(p: Vector, a: Vector, b: Vector, c: Vector) -> Vector:
    """Weights of the corners; (1, 0, 0) for a degenerate triangle."""
    u, v, w = minus(b, a), minus(c, a), minus(p, a)
    uu, uv, vv, wu, wv = dot(u, u), dot(u, v), dot(v, v), dot(w, u), dot(w, v)
    below = uu * vv - uv * uv
    flat = F.abs(below) <= F.lit(1e-12)
    beta = F.when(flat, F.lit(0.0)).otherwise((vv * wu - uv * wv) / below)
    gamma = F.when(flat, F.lit(0.0)).otherwise((uu * wv - uv * wu) / below)
    return (1 - beta - gamma, beta, gamma)


def normalise_key(name: Column) -> Column:
    """File name as a specimen's key: lower case, without markups suffixes and one mesh suffix."""
    bare = F.regexp_replace(F.lower(name), r"(\.(json|mrk|fcsv))+$", "")
    return F.regexp_replace(bare, r"\.(ply|stl|vtp|vtk|obj)$", "")


def safe_name(name: Column) -> Column:
    """Whether a library of this name can be a folder on any system."""
    # Device names that a common file system reserves.
    devices = ["CON", "PRN", "AUX", "NUL", *(f"{d}{k}" for d in ("COM", "LPT") for k in range(1, 10))]
    stem = F.upper(F.regexp_extract(name, r"^([^.]*)", 1))
    return F.coalesce((F.trim(name) != "") & ~name.rlike(r"""[\x00-\x1f<>:"/\\|?*]""") & ~name.rlike(r"[. ]$") & ~stem.isin(devices), F.lit(False))
