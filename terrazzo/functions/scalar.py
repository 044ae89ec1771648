"""Column functions: rounding, colour conversion and energies."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

GAMMA_BITS, MATRIX_BITS, DOUBLING = 13, 16, 1
#: Linear RGB to normalised XYZ, times 2**16.
XYZ = ((28440, 24656, 12442), (13938, 46868, 4730), (1164, 7175, 57202))


def clamp(x: Column, lo: Column | float, hi: Column | float) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.least(F.greatest(x, as_col(lo)), as_col(hi))


def ceil_int(n: str, d: str) -> Column:
    return F.expr(f"({n} + {d} - 1) div {d}")


def round_int(n: str, d: str) -> Column:
    return F.expr(f"({n} + ({d} div 2)) div {d}")


def gamma_table() -> list[int]:
    """Linear light of each 8-bit sRGB level, in units of 2**-13, cut off."""
    v = np.arange(256) / 255.0
    linear = np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)
    return (linear * (1 << GAMMA_BITS)).astype(int).tolist()


def lightness_table() -> list[int]:
    """The cube-root-like response for each linear level from 0 to 2**13, rounded to the same unit."""
    v = (np.arange((1 << GAMMA_BITS) + 1) / np.float32(1 << GAMMA_BITS)).astype(np.float32)
    f = np.where(v > np.float32(0.008856), v.astype(np.float64) ** np.float64(np.float32(0.333333)), 7.787 * v.astype(np.float64) + 0.137931)
    return np.floor(f * (1 << GAMMA_BITS) + 0.5).astype(int).tolist()


def rgb_to_lab_float(r: str, g: str, b: str) -> tuple[Column, Column, Column]:
    """CIELAB of 8-bit sRGB in real numbers: L within 0 and 100, a and b around 0."""
    def level(c: str) -> Column:
        v = F.col(c) / 255.0
        return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    def response(v: Column) -> Column:
        return F.when(v > 0.008856, F.pow(v, F.lit(1.0 / 3.0))).otherwise(7.787 * v + 16.0 / 116.0)

    linear = [level(c) for c in (r, g, b)]
    x, y, z = (response(sum((F.lit(k / (1 << MATRIX_BITS)) * v for k, v in zip(row[1:], linear[1:], strict=True)), F.lit(row[0] / (1 << MATRIX_BITS)) * linear[0])) for row in XYZ)
    return 116.0 * y - 16.0, 500.0 * (x - y), 200.0 * (y - z)


def rgb_to_lab(r: str, g: str, b: str, shift: int = DOUBLING) -> tuple[Column, Column, Column]:
    """Quantised CIELAB of 8-bit sRGB: 2L, 2a + 128 and 2b + 128 (with shift 1), each within 0 and 255."""
    # One text literal a table, which the optimiser folds into an array, in the place of thousands of literals.
    gamma, response = (F.split(F.lit(",".join(map(str, t))), ",").cast("array<int>") for t in (gamma_table(), lightness_table()))
    linear = [F.get(gamma, F.col(c).cast("int")) for c in (r, g, b)]
    f = []
    for row in XYZ:
        total = sum((F.lit(k) * v for k, v in zip(row[1:], linear[1:], strict=True)), F.lit(row[0]) * linear[0])
        f.append(F.get(response, F.shiftright(total, MATRIX_BITS)))
    one = 1 << GAMMA_BITS
    down = GAMMA_BITS - shift
    light = F.shiftright(116 * f[1] - 16 * one, down)
    a = F.shiftright(500 * (f[0] - f[1]) + 128 * one, down) - ((128 << shift) - 128)
    bb = F.shiftright(200 * (f[1] - f[2]) + 128 * one, down) - ((128 << shift) - 128)
    return tuple(clamp(x, 0, 255).cast("int") for x in (light, a, bb))


def _squares(a: str, b: str, fields: tuple[str, ...], scale: float) -> Column:
    total = F.lit(0.0)
    for f in fields:
        d = (F.col(f"{a}.{f}") - F.col(f"{b}.{f}")) / scale
        total = total + d * d
    return total


def spatial_energy(a: str, b: str, p) -> Column:
    """Pairwise energy of two nodes of a frame (struct columns a and b); the caller leaves out a node with itself."""
    colour, place = ("c0", "c1", "c2"), ("y", "x")
    near = F.exp(-0.5 * _squares(a, b, colour, p.spatial_srgb) - 0.5 * _squares(a, b, place, p.spatial_sxy)) * p.spatial_w
    return near + F.exp(-0.5 * _squares(a, b, place, p.spatial_smooth_sxy)) * p.spatial_smooth_w


def temporal_energy(a: str, b: str, p) -> Column:
    """Pairwise energy of a node and itself in another frame."""
    return F.exp(-0.5 * _squares(a, b, ("c0", "c1", "c2"), p.temporal_srgb)) * p.temporal_w


def log_loss(p: Column) -> Column:
    """-ln p, with infinity for 0, where Spark's own logarithm is null."""
    return F.when(p <= 0, F.lit(math.inf)).otherwise(-F.log(p))
