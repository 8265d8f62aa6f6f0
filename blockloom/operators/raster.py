"""Rasters as array<int> columns, row by row: narrow native expressions, nothing is shuffled.

``w`` and ``h`` are an image's sides; places beyond an edge take the edge's value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantised(values: str | Column) -> Column:
    """Floats as pixels: floor(256 v) + 128, within 0..255."""
    return F.transform(values, lambda e: F.least(F.greatest(F.floor(e.cast("double") * 256).cast("int") + 128, F.lit(0)), F.lit(255)))


def rotated(pixels: Column, n: int, by: int) -> Column:
    return F.concat(F.slice(pixels, by + 1, n - by), F.slice(pixels, 1, by))


def each(w: int, h: int, value: Callable[[Column, Column], Column]) -> Column:
    """A raster of value(x, y)."""
    return F.transform(F.sequence(F.lit(0), F.lit(w * h - 1)), lambda i: value((i % w).cast("int"), F.floor(i / w).cast("int")))


def at(pixels: Column, x: Column, y: Column, w: int, h: int) -> Column:
    inside = lambda c, n: F.least(F.greatest(c, F.lit(0)), F.lit(n - 1))
    return F.element_at(pixels, inside(y, h) * w + inside(x, w) + 1)


def clip(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0)), F.lit(255))


def shift(v: Column, bits: int) -> Column:
    return F.shiftright(v, bits)


# ---- colour, a pixel at a time --------------------------------------------------------------


def reversible_yuv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return shift(r + 2 * g + b, 2), r - g, b - g


def reversible_rgb(y: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    g = y - shift(u + v, 2)
    return u + g, g, v + g


def _rounded(c: Column) -> Column:
    return shift(c + 2048, 12)


def ycbcr(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Studio-range luma and chroma, matrices scaled by 4096."""
    return _rounded(1052 * r + 2065 * g + 401 * b) + 16, _rounded(-607 * r - 1192 * g + 1799 * b) + 128, _rounded(1799 * r - 1506 * g - 293 * b) + 128


def ycbcr_rgb(y: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    y, u, v = 4769 * (y - 16), u - 128, v - 128
    return clip(_rounded(y + 6537 * v)), clip(_rounded(y - 1605 * u - 3330 * v)), clip(_rounded(y + 8263 * u))


def ysbsr(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return _rounded(2646 * r + 2818 * g + 2728 * b), _rounded(-4096 * r + 868 * g + 3228 * b), _rounded(-1319 * r + 4096 * g - 2777 * b)


def linear4096(c: Column) -> Column:
    """A channel without its gamma, scaled by 4096."""
    x = c / 255.0
    return F.round(4096 * F.when(x > 0.04045, F.pow((x + 0.055) / 1.055, 2.4)).otherwise(x / 12.92)).cast("int")


def xyz(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    r, g, b = map(linear4096, (r, g, b))
    return _rounded(1689 * r + 1465 * g + 739 * b), _rounded(871 * r + 2929 * g + 296 * b), _rounded(79 * r + 488 * g + 3892 * b)


def contrast(c: Column, percent: int) -> Column:
    """A channel scaled by the square of ``percent`` (0..1000) over 100, at most 255."""
    return F.least(shift((percent * 256 // 100) ** 2 * c.cast("long"), 16), F.lit(255)).cast("int")


# ---- neighbourhoods -------------------------------------------------------------------------


def sobel(p: Column, w: int, h: int) -> Column:
    """(|gx| + |gy|) / 2, at most 255; borders take the nearest inner place's value."""

    def value(x: Column, y: Column) -> Column:
        x, y = F.least(F.greatest(x, F.lit(1)), F.lit(w - 2)), F.least(F.greatest(y, F.lit(1)), F.lit(h - 2))
        v = lambda dx, dy: at(p, x + dx, y + dy, w, h)
        gx = v(1, -1) + 2 * v(1, 0) + v(1, 1) - v(-1, -1) - 2 * v(-1, 0) - v(-1, 1)
        gy = v(-1, 1) + 2 * v(0, 1) + v(1, 1) - v(-1, -1) - 2 * v(0, -1) - v(1, -1)
        return F.least(shift(F.abs(gx) + F.abs(gy), 1), F.lit(255))

    return each(w, h, value)


def blur_rows(p: Column, w: int, h: int, radius: int) -> Column:
    """One pass along rows: the mean of 2 * radius + 1 places, truncated."""
    return each(w, h, lambda x, y: F.floor(sum((at(p, x + d, y, w, h) for d in range(-radius + 1, radius + 1)), at(p, x - radius, y, w, h)) / (2 * radius + 1)).cast("int"))


def blur_columns(p: Column, w: int, h: int, radius: int) -> Column:
    return each(w, h, lambda x, y: F.floor(sum((at(p, x, y + d, w, h) for d in range(-radius + 1, radius + 1)), at(p, x, y - radius, w, h)) / (2 * radius + 1)).cast("int"))


def decimate(p: Column, w: int, h: int, n: int) -> Column:
    """Keeps one place in ``n`` along both sides."""
    return each(w // n, h // n, lambda x, y: at(p, x * n, y * n, w, h))


def bilinear_down(p: Column, w: int, h: int, n: int) -> Column:
    """Means of n by n places, rounded; n is 2 or 4."""
    cells = [(dx, dy) for dy in range(n) for dx in range(n)]
    bits = 2 * (n.bit_length() - 1)
    return each(w // n, h // n, lambda x, y: shift(sum((at(p, x * n + dx, y * n + dy, w, h) for dx, dy in cells[1:]), at(p, x * n, y * n, w, h)) + (1 << bits) // 2, bits))


# ---- transforms of square blocks ------------------------------------------------------------

#: The weights of the integer cosine transform of 8 places.
DCT8 = [
    [64, 64, 64, 64, 64, 64, 64, 64],
    [89, 75, 50, 18, -18, -50, -75, -89],
    [83, 36, -36, -83, -83, -36, 36, 83],
    [75, -18, -89, -50, 50, 89, 18, -75],
    [64, -64, -64, 64, 64, -64, -64, 64],
    [50, -89, 18, 75, -75, -18, 89, -50],
    [36, -83, 83, -36, -36, 83, -83, 36],
    [18, -50, 75, -89, 89, -75, 50, -18],
]


def hadamard(n: int) -> list[list[int]]:
    """Natural order: the sign is the parity of the common bits of row and column."""
    return [[-1 if (u & x).bit_count() & 1 else 1 for x in range(n)] for u in range(n)]


def transformed(p: Column, weights: list[list[int]], bits: int = 0) -> Column:
    """weights * block * weights^T, the sum of all products rounded and shifted right by ``bits``."""
    n = len(weights)
    table = F.array(*(F.lit(w) for row in weights for w in row))
    half = (1 << bits) >> 1
    along = each(n, n, lambda u, y: _dot(n, lambda k: F.element_at(table, u * n + k + 1) * F.element_at(p, y * n + k + 1)))

    def down(first: Column) -> Column:
        return each(n, n, lambda u, v: shift(_dot(n, lambda k: F.element_at(table, v * n + k + 1) * F.element_at(first, k * n + u + 1)) + half, bits))

    return F.element_at(F.transform(F.array(along), down), 1)


def _dot(n: int, term: Callable[[int], Column]) -> Column:
    return sum((term(k) for k in range(1, n)), term(0))


# ---- scans ----------------------------------------------------------------------------------


def hilbert(dim: int) -> list[int]:
    """Places of a dim by dim square along the Hilbert curve from the top left; dim is a power of two."""
    out = []
    for d in range(dim * dim):
        x = y = 0
        t, s = d, 1
        while s < dim:
            rx = 1 & (t // 2)
            ry = 1 & (t ^ rx)
            if not ry:
                if rx:
                    x, y = s - 1 - x, s - 1 - y
                x, y = y, x
            x, y = x + s * rx, y + s * ry
            t //= 4
            s *= 2
        if dim.bit_length() % 2:  # the first step goes along the row at every size
            x, y = y, x
        out.append(y * dim + x)
    return out if dim < 2 or out[1] == 1 else [(p % dim) * dim + p // dim for p in out]


def scan(kind: str, dim: int) -> list[int]:
    """Places in the order of a horizontal, vertical, zigzag or mixed (row and column in turn) scan."""
    if kind == "h":
        return list(range(dim * dim))
    if kind == "v":
        return [y * dim + x for x in range(dim) for y in range(dim)]
    if kind == "zigzag":
        cells = [(x, y) for y in range(dim) for x in range(dim)]
        return [y * dim + x for x, y in sorted(cells, key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 == 0 else c[1]))]
    if kind == "hv":
        out = []
        for k in range(dim):
            out += [k * dim + x for x in range(k, dim)] + [y * dim + k for y in range(k + 1, dim)]
        return out
    raise ValueError(f"no scan {kind}")


def along(p: Column, order: list[int]) -> Column:
    return F.transform(F.array(*map(F.lit, order)), lambda i: F.element_at(p, i + 1))


def energy(p: Column) -> Column:
    """The sum of squared steps along a scan."""
    n = F.size(p)
    steps = F.zip_with(F.slice(p, F.lit(2), n - 1), F.slice(p, F.lit(1), n - 1), lambda a, b: (a - b) * (a - b))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)


# ---- measures -------------------------------------------------------------------------------


def squared_error(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda s, x: s + x)


def absolute_error(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0).cast("long"), lambda s, x: s + x)


def psnr1024(error: Column, n: int) -> Column:
    """The peak signal-to-noise ratio in decibels, times 1024; 0 stands for no error."""
    return F.when(error == 0, F.lit(0)).otherwise(F.round(10240 * F.log10(65025.0 * n / error))).cast("long")


def variance(total: Column, squares: Column, n: Column) -> Column:
    """Integer variance: (squares - total * total / n) / n, divisions truncated."""
    return F.floor((squares - F.floor(total * total / n)) / n).cast("long")
