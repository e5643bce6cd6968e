"""Numerical codes of places and shapes, as array expressions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WAVELENGTHS = [10.0 * 100.0 ** (k / 15) for k in range(16)]
RADII = [0.5 * 100.0 ** (k / 7) for k in range(8)]
FREQUENCIES = [(r * math.cos(m * math.pi / 16), r * math.sin(m * math.pi / 16)) for r in RADII for m in range(16)]
QUIET = 1e-7


def relative_code(dx: Column, dy: Column, wavelengths: list[float] = WAVELENGTHS) -> Column:
    """Of each wavelength the sine and cosine of the phase along x, then along y; 64 numbers."""
    phase = lambda d, w: d * (2 * math.pi / w)
    return F.array(*(f(phase(d, w)) for w in wavelengths for d in (dx, dy) for f in (F.sin, F.cos)))


def sinc(x: Column) -> Column:
    """sin(pi x) / (pi x), 1 at 0."""
    return F.when(F.abs(x) < 1e-12, 1.0).otherwise(F.sin(x * math.pi) / (x * math.pi))


def segment_transform(xa: Column, ya: Column, xb: Column, yb: Column, frequencies: list[tuple[float, float]] = FREQUENCIES) -> Column:
    """Fourier transform of a segment's length measure, as an array of (re, im) at each frequency."""
    dx, dy = xb - xa, yb - ya
    mx, my, length = (xa + xb) / 2, (ya + yb) / 2, F.hypot(xb - xa, yb - ya)
    waves = F.array(*(F.struct(F.lit(u).alias("u"), F.lit(v).alias("v")) for u, v in frequencies))

    def at(w: Column) -> Column:
        turn = (w["u"] * mx + w["v"] * my) * (-2 * math.pi)
        size = length * sinc(w["u"] * dx + w["v"] * dy)
        return F.struct((size * F.cos(turn)).alias("re"), (size * F.sin(turn)).alias("im"))

    return F.transform(waves, at)


def rounded(v: np.ndarray, places: int = 6) -> np.ndarray:
    """To so many decimals, halves away from 0; never -0."""
    t = v * 10.0**places
    t += np.copysign(0.5, t)
    np.trunc(t, out=t)
    t /= 10.0**places
    t += 0.0
    return t


def sinc_of(x: np.ndarray) -> np.ndarray:
    """``sinc`` of an array."""
    small = np.abs(x) < 1e-12
    x = np.where(small, 1.0, x * math.pi)
    return np.where(small, 1.0, np.sin(x) / x)


def lists(rows: np.ndarray, known: np.ndarray | None = None) -> pa.Array:
    """The rows of an array as lists, null where they aren't known."""
    bounds = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
    return pa.ListArray.from_arrays(bounds, pa.array(np.ascontiguousarray(rows).reshape(-1)), mask=None if known is None or known.all() else pa.array(~known))


def segment_fourier(xa: Column, ya: Column, xb: Column, yb: Column, frequencies: list[tuple[float, float]] = FREQUENCIES, places: int | None = None) -> Column:
    """struct(re, im): ``segment_transform`` at all frequencies as two arrays, rounded to ``places``. Worked out on arrays of a
    batch: as native array functions, whose bodies are interpreted, it took over a millisecond a segment."""
    u, v = np.array(frequencies).T

    @F.arrow_udf("re array<double>, im array<double>")
    def run(*ends: pa.Array) -> pa.Array:
        ax, ay, bx, by = (c.to_numpy(zero_copy_only=False)[:, None] for c in ends)
        known = ~np.isnan(ax + ay + bx + by)[:, 0]
        re, im = (np.empty((len(ax), len(u))) for _ in "ri")
        for k in range(0, len(ax), 1024):
            x0, y0, x1, y1 = (c[k : k + 1024] for c in (ax, ay, bx, by))
            size = np.hypot(x1 - x0, y1 - y0) * sinc_of(u * (x1 - x0) + v * (y1 - y0))
            turn = (u * ((x0 + x1) / 2) + v * ((y0 + y1) / 2)) * (-2 * math.pi)
            for out, part in ((re, np.cos), (im, np.sin)):
                found = size * part(turn)
                out[k : k + 1024] = found if places is None else rounded(found, places)
        return pa.StructArray.from_arrays([lists(re, known), lists(im, known)], ["re", "im"])

    return run(*(c.cast("double") for c in (xa, ya, xb, yb)))


def magnitude(values: Column) -> Column:
    """ln(1 + |z|) of (re, im) values."""
    return F.transform(values, lambda z: F.log1p(F.hypot(z["re"], z["im"])))


def phase(values: Column) -> Column:
    """Cosines, then sines, of the phases of (re, im) values; a value of magnitude up to QUIET has phase 0."""
    angle = F.transform(values, lambda z: F.when(F.hypot(z["re"], z["im"]) <= QUIET, 0.0).otherwise(F.atan2(z["im"], z["re"])))
    return F.concat(F.transform(angle, F.cos), F.transform(angle, F.sin))


def intrinsic(value: Column, representative: Column, scale: float = 500.0) -> Column:
    """A coordinate as seen from its object's representative point, in units of a window's side."""
    return (value - representative) / scale


def standardized(value: Column, mean: Column, std: Column) -> Column:
    return (value - mean) / F.when(std == 0, 1.0).otherwise(std)


def close(a: Column, b: Column, tolerance: float = QUIET) -> Column:
    """Whether numbers differ by no more than the tolerance; null is close to null alone."""
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= tolerance)


def all_close(a: Column, b: Column, tolerance: float = QUIET) -> Column:
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: close(x, y, tolerance)), lambda x: x)


def masked(values: Column, mask: Column) -> Column:
    """The values, 0 where the mask is false."""
    return F.zip_with(values, mask, lambda v, m: F.when(m, v).otherwise(F.lit(0.0)))
