"""Geometry as Column expressions on struct<x,y,z:double> points and array<double> matrices."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def vec(x, y, z) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.col(v) if isinstance(v, str) else F.lit(float(v))
    return F.struct(as_col(x).cast("double").alias("x"), as_col(y).cast("double").alias("y"), as_col(z).cast("double").alias("z"))


def let(x: Column, f) -> Column:
    """f(x) with x worked out once: an expression that stands in another many times would multiply."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _each(a: Column, b: Column, f) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda p: F.struct(*(f(p["a"][k], p["b"][k]).alias(k) for k in "xyz")))


def add(a: Column, b: Column) -> Column:
    return _each(a, b, lambda p, q: p + q)


def sub(a: Column, b: Column) -> Column:
    return _each(a, b, lambda p, q: p - q)


def scale(a: Column, s: Column | float) -> Column:
    s = s if isinstance(s, Column) else F.lit(float(s))
    return let(F.struct(a.alias("a"), s.alias("s")), lambda p: F.struct(*((p["a"][k] * p["s"]).alias(k) for k in "xyz")))


def opposite(a: Column) -> Column:
    return scale(a, -1.0)


def dot(a: Column, b: Column) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda p: sum((p["a"][k] * p["b"][k] for k in "yz"), p["a"]["x"] * p["b"]["x"]))


def cross(a: Column, b: Column) -> Column:
    part = lambda p, i, j: p["a"][i] * p["b"][j] - p["a"][j] * p["b"][i]
    return let(F.struct(a.alias("a"), b.alias("b")), lambda p: vec(part(p, "y", "z"), part(p, "z", "x"), part(p, "x", "y")))


def outer(a: Column, b: Column) -> Column:
    return F.array(*(a[i] * b[j] for i in "xyz" for j in "xyz"))


def length_squared(a: Column) -> Column:
    return let(a, lambda v: sum((v[k] * v[k] for k in "yz"), v["x"] * v["x"]))


def length(a: Column) -> Column:
    return F.sqrt(length_squared(a))


def normalized(a: Column) -> Column:
    """Null parts for the zero vector."""
    return let(a, lambda v: let(length(v), lambda n: F.struct(*(F.try_divide(v[k], n).alias(k) for k in "xyz"))))


def distance_squared(a: Column, b: Column) -> Column:
    return length_squared(sub(a, b))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(distance_squared(a, b))


def _acos(x: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))


def planar_angle2(a: Column, b: Column) -> Column:
    """Angle between two vectors in radians; null for a zero vector."""
    return let(F.struct(a.alias("a"), b.alias("b")), lambda p: _acos(F.try_divide(dot(p["a"], p["b"]), length(p["a"]) * length(p["b"]))))


def planar_angle3(a: Column, b: Column, c: Column) -> Column:
    """Angle a-b-c."""
    return planar_angle2(sub(a, b), sub(c, b))


def dihedral_angle4(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Signed dihedral a-b-c-d in radians."""
    bonds = F.struct(sub(b, a).alias("p"), sub(c, b).alias("q"), sub(d, c).alias("r"))
    normals = lambda v: F.struct(cross(v["p"], v["q"]).alias("m"), cross(v["q"], v["r"]).alias("n"), v["q"].alias("q"))
    return let(bonds, lambda v: let(normals(v), lambda w: F.atan2(F.try_divide(dot(cross(w["m"], w["n"]), w["q"]), length(w["q"])), dot(w["m"], w["n"]))))


def random_versor(seed: int) -> Column:
    return normalized(vec(*(F.randn(seed + i) for i in range(3))))


def random_point_nearby(center: Column, radius: float, seed: int) -> Column:
    return add(center, scale(random_versor(seed), radius))


# --- 3 x 3 matrices, row by row -------------------------------------------------------------


def matrix(values) -> Column:
    return F.array(*(v if isinstance(v, Column) else F.lit(float(v)) for v in np.ravel(np.array(values, dtype=object))))


def identity() -> Column:
    return matrix([1.0 if i == j else 0.0 for i in range(3) for j in range(3)])


def from_columns(a: Column, b: Column, c: Column) -> Column:
    return F.array(*(v[k] for k in "xyz" for v in (a, b, c)))


def from_rows(a: Column, b: Column, c: Column) -> Column:
    return F.array(*(v[k] for v in (a, b, c) for k in "xyz"))


def _m(m: Column, i: int, j: int) -> Column:
    return F.get(m, F.lit(3 * i + j))


def mat_vec(m: Column, v: Column) -> Column:
    return vec(*(_m(m, i, 0) * v["x"] + _m(m, i, 1) * v["y"] + _m(m, i, 2) * v["z"] for i in range(3)))


def mat_mat(a: Column, b: Column) -> Column:
    return F.array(*(sum((_m(a, i, k) * _m(b, k, j) for k in range(3)), F.lit(0.0)) for i in range(3) for j in range(3)))


def mat_add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def mat_sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def transpose(m: Column) -> Column:
    return F.array(*(_m(m, j, i) for i in range(3) for j in range(3)))


def _minor(m: Column, i: int, j: int) -> Column:
    r, c = [k for k in range(3) if k != i], [k for k in range(3) if k != j]
    return _m(m, r[0], c[0]) * _m(m, r[1], c[1]) - _m(m, r[0], c[1]) * _m(m, r[1], c[0])


def det(m: Column) -> Column:
    return sum((((-1) ** j) * _m(m, 0, j) * _minor(m, 0, j) for j in range(3)), F.lit(0.0))


def inverse(m: Column) -> Column:
    """The matrix itself where it is singular."""
    d = det(m)
    return F.when(d != 0, F.array(*(F.try_divide(((-1) ** (i + j)) * _minor(m, j, i), d) for i in range(3) for j in range(3)))).otherwise(m)


# --- rigid motions: struct<r:array<double>,t:vec> -------------------------------------------


def rototranslation(r: Column, t: Column) -> Column:
    return F.struct(r.alias("r"), t.alias("t"))


def apply(rt: Column, v: Column) -> Column:
    return add(mat_vec(rt["r"], v), rt["t"])


def apply_inverse(rt: Column, v: Column) -> Column:
    return mat_vec(inverse(rt["r"]), sub(v, rt["t"]))


def around_axis(start: tuple, end: tuple, angle: float) -> Column:
    """Rotation about the axis from start to end; the axis is a parameter, so the matrix is constant."""
    a, b = np.array(start, float), np.array(end, float)
    u = (b - a) / np.linalg.norm(b - a)
    k = np.array([[0, -u[2], u[1]], [u[2], 0, -u[0]], [-u[1], u[0], 0]])
    r = np.eye(3) + math.sin(angle) * k + (1 - math.cos(angle)) * k @ k
    return rototranslation(matrix(r), vec(*(a - r @ a)))


def frame_by_three(a: Column, b: Column, c: Column) -> Column:
    """Local frame at b: z along b to c less b to a, x across it in the plane, y normal to both."""
    arms = F.struct(normalized(sub(a, b)).alias("a"), normalized(sub(c, b)).alias("c"))
    axes = lambda v: F.struct(normalized(add(v["c"], v["a"])).alias("x"), normalized(sub(v["c"], v["a"])).alias("z"))
    turn = let(arms, lambda v: let(axes(v), lambda w: from_columns(w["x"], cross(w["z"], w["x"]), w["z"])))
    return rototranslation(turn, b)


# --- molecules ------------------------------------------------------------------------------


def place_atom(a: Column, b: Column, c: Column, r: Column | float, planar: Column | float, dihedral: Column | float) -> Column:
    """The point at distance r from c, planar angle b-c-d and dihedral a-b-c-d, in radians."""
    r, planar, dihedral = (v if isinstance(v, Column) else F.lit(float(v)) for v in (r, planar, dihedral))
    along, across = r * F.cos(F.lit(math.pi) - planar), r * F.sin(F.lit(math.pi) - planar)
    place = lambda u, n: add(scale(u, along), add(scale(cross(n, u), across * F.cos(dihedral)), scale(n, across * F.sin(dihedral))))
    return add(c, let(normalized(sub(c, b)), lambda u: let(normalized(cross(sub(b, a), u)), lambda n: place(u, n))))


def peptide_hydrogen(prev_c: Column, n: Column, ca: Column) -> Column:
    """Amide hydrogen 1.0 from n, away from the bisector of its two bonds."""
    inward = add(normalized(sub(prev_c, n)), normalized(sub(ca, n)))
    return sub(n, normalized(inward))


def dssp_energy(n: Column, h: Column, c: Column, o: Column) -> Column:
    """Electrostatic energy of an N-H...O=C pair in kcal/mol."""
    inv = lambda p, q: F.try_divide(F.lit(1.0), distance(p, q))
    return 0.42 * 0.2 * 332.0 * (inv(n, o) + inv(c, h) - inv(o, h) - inv(n, c))
