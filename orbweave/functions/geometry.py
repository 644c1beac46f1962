"""Three-dimensional geometry as expression levels: eigenvectors, pair features, distances, Morton codes, colours."""

from __future__ import annotations

import math

from .steps import Levels

PI = repr(math.pi)


def dot(a: str, b: str, axes: str = "xyz") -> str:
    return "(" + " + ".join(f"{a}{k} * {b}{k}" for k in axes) + ")"


def clamp(x: str, lo: str, hi: str) -> str:
    return f"least(greatest({x}, {lo}), {hi})"


#: Eigenvalues l1 >= l2 >= l3 of the symmetric matrix c11 .. c33, by the trigonometric form, and the unit eigenvector
#: (ex, ey, ez) of l3: the largest cross product of two rows of C - l3 I.  Where l2 and l3 agree to
#: about 1e-6 of l1 (points on a line, or alike in all directions) there is no such direction, and it is +Z.
SYMMETRIC_EIGEN: Levels = [
    {"_q": "(c11 + c22 + c33) / 3e0", "_o": "c12 * c12 + c13 * c13 + c23 * c23"},
    {"_p": "sqrt(((c11 - _q) * (c11 - _q) + (c22 - _q) * (c22 - _q) + (c33 - _q) * (c33 - _q) + 2e0 * _o) / 6e0)"},
    {
        "_b11": "(c11 - _q) / nullif(_p, 0e0)", "_b22": "(c22 - _q) / nullif(_p, 0e0)", "_b33": "(c33 - _q) / nullif(_p, 0e0)",
        "_b12": "c12 / nullif(_p, 0e0)", "_b13": "c13 / nullif(_p, 0e0)", "_b23": "c23 / nullif(_p, 0e0)",
    },
    {"_r": "coalesce((_b11 * (_b22 * _b33 - _b23 * _b23) - _b12 * (_b12 * _b33 - _b23 * _b13) + _b13 * (_b12 * _b23 - _b22 * _b13)) / 2e0, 1e0)"},
    {"_phi": "acos(least(greatest(_r, -1e0), 1e0)) / 3e0"},
    {"l1": "_q + 2e0 * _p * cos(_phi)", "l3": f"_q + 2e0 * _p * cos(_phi + {2 * math.pi / 3!r})"},
    {"l2": "3e0 * _q - l1 - l3", "_m11": "c11 - l3", "_m22": "c22 - l3", "_m33": "c33 - l3"},
    {
        "_ax": "c12 * c23 - c13 * _m22", "_ay": "c13 * c12 - _m11 * c23", "_az": "_m11 * _m22 - c12 * c12",
        "_dx": "c12 * _m33 - c13 * c23", "_dy": "c13 * c13 - _m11 * _m33", "_dz": "_m11 * c23 - c12 * c13",
        "_gx": "_m22 * _m33 - c23 * c23", "_gy": "c23 * c13 - c12 * _m33", "_gz": "c12 * c23 - _m22 * c13",
    },
    {"_na": "_ax * _ax + _ay * _ay + _az * _az", "_nd": "_dx * _dx + _dy * _dy + _dz * _dz", "_ng": "_gx * _gx + _gy * _gy + _gz * _gz"},
    {"_top": "CASE WHEN greatest(_na, _nd, _ng) > 1e-12 * l1 * l1 * l1 * l1 THEN greatest(_na, _nd, _ng) ELSE 0e0 END"},
    {
        f"e{k}": f"CASE WHEN _top <= 0e0 THEN {'1e0' if k == 'z' else '0e0'} WHEN _na >= _top THEN _a{k} WHEN _nd >= _top THEN _d{k} ELSE _g{k} END / CASE WHEN _top <= 0e0 THEN 1e0 ELSE sqrt(_top) END"
        for k in "xyz"
    },
]
#: Covariance of x, y, z about the mean (population), for a group.
COVARIANCE = {
    "n": "count(*)", "mx": "avg(x)", "my": "avg(y)", "mz": "avg(z)",
    "c11": "covar_pop(x, x)", "c12": "covar_pop(x, y)", "c13": "covar_pop(x, z)", "c22": "covar_pop(y, y)", "c23": "covar_pop(y, z)", "c33": "covar_pop(z, z)",
}
#: The eigenvector turned so that its product with the group's mean is not positive.
TOWARD_ORIGIN: Levels = [{"_s": "CASE WHEN mx * ex + my * ey + mz * ez > 0e0 THEN -1e0 ELSE 1e0 END"}, {"nx": "_s * ex", "ny": "_s * ey", "nz": "_s * ez"}]

BINS = 11
#: Of an ordered pair (ax.., anx..) and (bx.., bnx..): three angular features; null where a length is zero.  Sines
#: within 1e-12 of zero are zero, so that noise doesn't choose between -pi and pi.
PAIR_FEATURES: Levels = [
    {"_ux": "bx - ax", "_uy": "by - ay", "_uz": "bz - az"},
    {"_vx": "_uy * anz - _uz * any_", "_vy": "_uz * anx - _ux * anz", "_vz": "_ux * any_ - _uy * anx"},
    {
        "_v": "sqrt(_vx * _vx + _vy * _vy + _vz * _vz)", "_u": "sqrt(_ux * _ux + _uy * _uy + _uz * _uz)",
        "_dist": "anx * _ux + any_ * _uy + anz * _uz", "_cos": "anx * bnx + any_ * bny + anz * bnz", "_un2": "_ux * bnx + _uy * bny + _uz * bnz",
    },
    {"_y": "CASE WHEN abs(_un2 - _dist * _cos) < 1e-12 THEN 0e0 ELSE _un2 - _dist * _cos END", "_w": "_cos * _v"},
    {"f1": "atan2(_y, _w)", "f2": "(_vx * bnx + _vy * bny + _vz * bnz) / nullif(_v, 0e0)", "f3": "_dist / nullif(_u, 0e0)"},
]


def bin_of(value: str, bins: int) -> str:
    """Truncation to a bin, clamped; a null value falls into bin 0."""
    return f"CAST(coalesce(least(greatest(floor({value}), 0e0), {bins - 1}e0), 0e0) AS INT)"


PAIR_BINS: Levels = [{"b1": bin_of(f"{BINS}e0 * (f1 / {PI} + 1e0) * 0.5e0", BINS), "b2": bin_of(f"{BINS}e0 * (f2 + 1e0) * 0.5e0", BINS), "b3": bin_of(f"{BINS}e0 * (f3 + 1e0) * 0.5e0", BINS)}]


def spread3(v: str, spark: bool) -> str:
    """A 21-bit number with two free bits after each of its bits."""
    out = f"({v} & 2097151)"
    # fixed masks of the usual bit spreading
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        left = f"shiftleft({out}, {shift})" if spark else f"(({out} & {(1 << (62 - shift)) - 1}) << {shift})"
        out = f"(({out} | {left}) & {mask})"
    return out


def morton(x: str, y: str, z: str, spark: bool = True) -> str:
    """The code with x's bits lowest."""
    left = (lambda v, k: f"shiftleft({v}, {k})") if spark else (lambda v, k: f"({v} << {k})")
    return f"({spread3(x, spark)} | {left(spread3(y, spark), 1)} | {left(spread3(z, spark), 2)})"


def colour(index: str, channel: int) -> str:
    """A channel of a colour whose hue moves by the golden ratio."""
    return f"0.55e0 + 0.4e0 * cos({2 * math.pi!r} * ({index} * 0.618033988749895e0 + {channel}e0 / 3e0))"


def metric(kind: str, a: str, b: str) -> str:
    """Distances of array columns or, for the circle and rotations, of angle and quaternion columns."""
    pairs = f"zip_with({a}, {b}, (p, q) -> {{}})"
    add = "aggregate({}, 0e0, (s, v) -> s + v)"
    if kind in ("l2", "l2_simple"):
        return add.format(pairs.format("(CAST(p AS DOUBLE) - CAST(q AS DOUBLE)) * (CAST(p AS DOUBLE) - CAST(q AS DOUBLE))"))
    if kind == "l1":
        return add.format(pairs.format("abs(CAST(p AS DOUBLE) - CAST(q AS DOUBLE))"))
    if kind == "so2":
        return f"abs(CASE WHEN {b} - {a} > {PI} THEN {b} - {a} - {2 * math.pi!r} WHEN {b} - {a} < -{PI} THEN {b} - {a} + {2 * math.pi!r} ELSE {b} - {a} END)"
    if kind == "so3":
        return metric("l2", a, b)
    raise ValueError(f"unknown metric {kind}")
