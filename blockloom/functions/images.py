"""Filters, transforms, resampling, prediction and quality of whole images: numpy on int arrays (height, width), free of Spark.

Colour images are three such arrays. Places beyond an edge take the edge's value, unless said otherwise.
"""

from __future__ import annotations

import heapq

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

Image = np.ndarray


def padded(a: Image, by: int) -> Image:
    return np.pad(a, by, mode="edge")


def clip(a: np.ndarray) -> Image:
    return np.clip(a, 0, 255).astype(np.int64)


# ---- filters ----------------------------------------------------------------------------------


def convolved(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """A separable filter of odd length along rows, then columns."""
    r = len(kernel) // 2
    along = sliding_window_view(np.pad(a, ((0, 0), (r, r)), mode="edge"), len(kernel), axis=1) @ kernel
    return sliding_window_view(np.pad(along, ((r, r), (0, 0)), mode="edge"), len(kernel), axis=0) @ kernel


def gaussian(a: Image, sigma16: int) -> Image:
    """Blur by a Gaussian of sigma16 / 16 (0 copies; 1/2 at least)."""
    if not sigma16:
        return a.copy()
    sigma = max(sigma16 / 16, 0.5)
    x = np.arange(-int(4 * sigma + 1), int(4 * sigma + 1) + 1)
    k = np.exp(-(x**2) / (2 * sigma**2))
    return clip(np.rint(convolved(a, k / k.sum())))


def bilateral(a: Image, sigma_space: float, sigma_value: float) -> Image:
    """Means over a window of twice the larger sigma, weighed by distance and by difference in value."""
    r = int(2 * max(sigma_space, 1))
    p = padded(a, r).astype(float)
    total, weight = np.zeros(a.shape), np.zeros(a.shape)
    h, w = a.shape
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            v = p[r + dy : r + dy + h, r + dx : r + dx + w]
            k = np.exp(-(dx * dx + dy * dy) / (2 * sigma_space**2) - (v - a) ** 2 / (2 * sigma_value**2))
            total += k * v
            weight += k
    return clip(np.rint(total / weight))


def fast_bilateral(a: Image, sigma_space: float, sigma_value: float, levels: int = 16) -> Image:
    """The same by blurring one weighted image a grey level and interpolating between levels: time does not depend on the window."""
    x = np.arange(-int(2 * max(sigma_space, 1)), int(2 * max(sigma_space, 1)) + 1)
    k = np.exp(-(x**2) / (2 * sigma_space**2))
    at = np.linspace(0, 255, levels)
    stack = []
    for level in at:
        weight = np.exp(-((a - level) ** 2) / (2 * sigma_value**2))
        below = convolved(weight, k)
        stack.append(np.where(below > 1e-12, convolved(weight * a, k) / np.maximum(below, 1e-12), a))
    pos = a / 255 * (levels - 1)
    low = np.minimum(pos.astype(int), levels - 2)
    part = pos - low
    stack = np.stack(stack)
    y, z = np.indices(a.shape)
    return clip(np.rint((1 - part) * stack[low, y, z] + part * stack[low + 1, y, z]))


def sobel(a: Image) -> Image:
    p = a
    gx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    gy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    return padded(np.minimum((np.abs(gx) + np.abs(gy)) >> 1, 255), 1)


def clustered(rgb: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """k-means over place and colour: distance 2 dx^2 + 2 dy^2 + colour distance; the earlier centre wins ties.

    Centres start on an even grid; it ends when none moves. Gives the labels and the centres (x, y, r, g, b).
    """
    _, h, w = rgb.shape
    y, x = np.indices((h, w))
    points = np.stack([x, y, *rgb]).reshape(5, -1).T.astype(np.int64)
    centres = points[np.linspace(0, len(points) - 1, k).astype(int)]
    scale = np.array([2, 2, 1, 1, 1])
    labels = np.zeros(len(points), np.int64)
    for _ in range(rounds):
        labels = np.argmin(((points[:, None] - centres[None]) ** 2 * scale).sum(axis=2), axis=1)
        count = np.bincount(labels, minlength=k)
        sums = np.stack([np.bincount(labels, points[:, i], k) for i in range(5)], axis=1).astype(np.int64)
        moved = np.where(count[:, None] > 0, sums // np.maximum(count, 1)[:, None], centres)
        if (moved == centres).all():
            break
        centres = moved
    return labels.reshape(h, w), centres


def lit(a: Image, x: int, y: int, radius: int, power: int) -> Image:
    """A spot of light: values grow by ``power`` percent at its middle, falling off in a straight line to the radius; bumps turn it."""
    gy, gx = np.gradient(a.astype(float))
    yy, xx = np.indices(a.shape)
    distance = np.hypot(xx + gx - x, yy + gy - y)
    return clip(a * np.maximum(0, 1 - distance / radius) * power / 100)


def rain_drop(a: Image, amplitude: float, length: float, phase: float) -> Image:
    """Waves from the middle move pixels along the radius; values between pixels are interpolated."""
    h, w = a.shape
    y, x = np.indices((h, w)).astype(float)
    dx, dy = x - w // 2, y - h // 2
    d = np.maximum(np.hypot(dx, dy), 1e-9)
    move = amplitude * np.sin(d / length * 2 * np.pi - phase)
    return sampled(a, x + dx / d * move, y + dy / d * move)


def sampled(a: Image, x: np.ndarray, y: np.ndarray) -> Image:
    h, w = a.shape
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.minimum(x.astype(int), w - 2), np.minimum(y.astype(int), h - 2)
    fx, fy = x - x0, y - y0
    top = a[y0, x0] * (1 - fx) + a[y0, x0 + 1] * fx
    low = a[y0 + 1, x0] * (1 - fx) + a[y0 + 1, x0 + 1] * fx
    return clip(np.rint(top * (1 - fy) + low * fy))


# ---- seams --------------------------------------------------------------------------------------


def seam_costs(a: Image) -> Image:
    """Edge strength, with strong edges dearer and faint ones free."""
    c = sobel(a)
    c = c + (c * c >> 8)
    return np.where(c < 5, 0, c)


def seams(a: Image, n: int) -> list[tuple[int, list[int]]]:
    """The cheapest ``n`` of the seams from spread starts at the top, which don't cross: (cost, column by row)."""
    cost = seam_costs(a)
    h, w = a.shape
    taken = np.zeros((h, w), bool)
    found = []
    for start in sorted(range(w), key=lambda s: (s * 7919) % w):
        path, total, col = [], 0, start
        for row in range(h):
            near = [c for c in (col - 1, col, col + 1) if 0 <= c < w and not taken[row, c]] if row else ([col] if not taken[0, col] else [])
            # A step to the side may not cross a seam that steps the other way there.
            near = [c for c in near if not row or c == col or not (taken[row - 1, c] and taken[row, col])]
            if not near:
                break
            col = min(near, key=lambda c: (cost[row, c], abs(c - col), c))
            path.append(col)
            total += int(cost[row, col])
        else:
            taken[np.arange(h), path] = True
            found.append((total, path))
    return heapq.nsmallest(n, found)


def carved(a: Image, n: int) -> Image:
    """``n`` columns fewer, or more where it is negative: the cheapest seams go, or double."""
    if not n:
        return a.copy()
    drop = n > 0
    chosen = seams(a, abs(n))
    if len(chosen) < abs(n):
        raise ValueError("the image has not so many seams")
    out = []
    for row in range(a.shape[0]):
        columns = sorted(p[row] for _, p in chosen)
        out.append(np.delete(a[row], columns) if drop else np.insert(a[row], columns, a[row, columns]))
    return np.stack(out)


def in_tiles(a: Image, run, tiles: int, halo: int, rows: bool = True) -> Image:
    """A filter on strips of rows (or columns) with ``halo`` places of their neighbours, put together again."""
    a = a if rows else a.T
    edges = np.linspace(0, len(a), tiles + 1).astype(int)
    out = []
    for low, high in zip(edges, edges[1:]):
        first, last = max(0, low - halo), min(len(a), high + halo)
        strip = run(a[first:last] if rows else a[first:last].T)
        strip = strip if rows else strip.T
        out.append(strip[low - first : len(strip) - (last - high)])
    done = np.concatenate(out)
    return done if rows else done.T


# ---- block transforms -----------------------------------------------------------------------------

#: Odd rows of the integer cosine transforms of 16 and 32 places (half a row; the rest mirrors it).
ODD16 = [90, 87, 80, 70, 57, 43, 25, 9]
ODD32 = [90, 90, 88, 85, 82, 78, 73, 67, 61, 54, 46, 38, 31, 22, 13, 4]
ODD8, ODD4, EVEN = [89, 75, 50, 18], [83, 36], 64


def dct_matrix(n: int) -> np.ndarray:
    """Integer weights: the k-th place of row u has the size that belongs to the angle u (2 k + 1) pi / 2 n."""
    size = {32: 0, 0: EVEN, 16: EVEN}  # by the angle in 1/128 of a turn, to a quarter turn
    for m, odd in ((32, ODD32), (16, ODD16), (8, ODD8), (4, ODD4)):
        size |= {(2 * i + 1) * 32 // m: v for i, v in enumerate(odd)}
    out = np.zeros((n, n), np.int64)
    for u in range(n):
        for k in range(n):
            angle = u * (2 * k + 1) * 32 // n % 128
            angle = min(angle, 128 - angle)
            out[u, k] = size[angle] if angle <= 32 else -size[64 - angle]
    return out


def dct(block: Image, n: int, bits: int) -> Image:
    m = dct_matrix(n)
    return (m @ block @ m.T + (1 << bits >> 1)) >> bits


def inverse_dct(coded: Image, n: int, bits: int) -> Image:
    m = dct_matrix(n)
    return (m.T @ coded @ m + (1 << bits >> 1)) >> bits


def dct_round_trip(block: Image, n: int) -> Image:
    """Forward and back. A row's squared length is n * 64**2, so both ways together take 24 + 2 log n bits away."""
    log = n.bit_length() - 1
    forward = log + 3
    return inverse_dct(dct(block, n, forward), n, 24 + 2 * log - forward)


def wht(block: Image) -> Image:
    """Walsh-Hadamard, natural order, unscaled."""
    n = len(block)
    m = np.array([[-1 if (u & x).bit_count() & 1 else 1 for x in range(n)] for u in range(n)])
    return m @ block @ m


def inverse_wht(coded: Image) -> Image:
    n = len(coded)
    return wht(coded) >> 2 * (n.bit_length() - 1)


# ---- wavelets ---------------------------------------------------------------------------------------

#: Lifting steps of the CDF 9/7 wavelet and its scale.
LIFT = (-1.586134342, -0.05298011854, 0.8829110762, 0.4435068522)
SCALE = 1.149604398


def _lift(x: np.ndarray, at: int, by: float) -> None:
    """Adds to every second row from ``at`` its neighbours times ``by``; the end mirrors."""
    n = len(x)
    i = np.arange(at, n, 2)
    left, right = np.abs(i - 1), np.where(i + 1 < n, i + 1, i - 1)
    x[i] += by * (x[left] + x[right])


def _wave(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    for k, by in enumerate(LIFT):
        _lift(x, 1 - k % 2, by)
    return np.concatenate([x[::2] * SCALE, x[1::2] / SCALE])


def _unwave(x: np.ndarray) -> np.ndarray:
    half = (len(x) + 1) // 2
    y = np.empty_like(x, dtype=float)
    y[::2], y[1::2] = x[:half] / SCALE, x[half:] * SCALE
    for k in range(3, -1, -1):
        _lift(y, 1 - k % 2, -LIFT[k])
    return y


def dwt(a: np.ndarray, levels: int) -> np.ndarray:
    """Columns, then rows, ``levels`` times on the low band; the low band stands top left."""
    out = a.astype(float)
    h, w = a.shape
    if h >> levels < 8 or w >> levels < 8 or h % (1 << levels) or w % (1 << levels):
        raise ValueError("each side must be a multiple of 2**levels, with 8 places left")
    for i in range(levels):
        part = out[: h >> i, : w >> i]
        out[: h >> i, : w >> i] = _wave(_wave(part).T).T
    return out


def inverse_dwt(a: np.ndarray, levels: int) -> np.ndarray:
    out = a.astype(float)
    h, w = a.shape
    for i in range(levels - 1, -1, -1):
        out[: h >> i, : w >> i] = _unwave(_unwave(out[: h >> i, : w >> i].T).T)
    return out


def bands(h: int, w: int, levels: int) -> list[tuple[str, int, np.ndarray]]:
    """(name, level, places) of each band, coarse first; HL goes down columns, LH along rows, HH along diagonals."""
    grid = np.arange(h * w).reshape(h, w)
    out = [("LL", levels, grid[: h >> levels, : w >> levels].ravel())]
    for level in range(levels, 0, -1):
        y, x = h >> level, w >> level
        out.append(("HL", level, grid[:y, x : 2 * x].T.ravel()))
        out.append(("LH", level, grid[y : 2 * y, :x].ravel()))
        square = grid[y : 2 * y, x : 2 * x]
        out.append(("HH", level, np.concatenate([np.fliplr(square).diagonal(k) for k in range(x - 1, -y, -1)])))
    return out


#: Contrast sensitivity in 1/32 by level, finest last: luma, then chroma.
WEIGHTS = {"luma": [32, 31, 28, 23, 16, 9], "chroma": [32, 28, 21, 13, 7, 3]}


def band_coded(coded: np.ndarray, levels: int, steps: list[int], channel: str = "luma") -> np.ndarray:
    """Coefficients weighed by sensitivity, over each level's step, truncated; a leaf below a coarse zero in HL, LH or HH of two levels is zero."""
    h, w = coded.shape
    out = np.zeros(h * w, np.int64)
    flat = coded.ravel()
    for _, level, at in bands(h, w, levels):
        weight = WEIGHTS[channel][min(levels - level, 5)]
        out[at] = np.trunc(flat[at] * weight / 32 / steps[levels - level]).astype(np.int64)
    return out.reshape(h, w)


def band_decoded(coded: np.ndarray, levels: int, steps: list[int], channel: str = "luma") -> np.ndarray:
    h, w = coded.shape
    out = np.zeros(h * w)
    flat = coded.ravel()
    for _, level, at in bands(h, w, levels):
        out[at] = flat[at] * steps[levels - level] * 32 / WEIGHTS[channel][min(levels - level, 5)]
    return out.reshape(h, w)


# ---- resampling ---------------------------------------------------------------------------------------


def _taps_up(a: np.ndarray, taps: list[int]) -> np.ndarray:
    """Doubles rows: each stays, and between two comes the weighed mean of neighbours (taps over 128)."""
    r = len(taps) // 2
    p = np.pad(a, ((r - 1, r), (0, 0)), mode="edge")
    between = sum(t * p[i : i + len(a)] for i, t in enumerate(taps))
    out = np.empty((2 * len(a), a.shape[1]), np.int64)
    out[::2], out[1::2] = a, np.clip((between + 64) >> 7, 0, 255)
    return out


#: Weights over 128 of interpolation between two places.
TAPS = {"bilinear": [64, 64], "four": [-8, 72, 72, -8], "six": [4, -16, 76, 76, -16, 4]}


def upsampled(a: Image, kind: str, times: int = 2) -> Image:
    """Twice or four times as large, by rows and then columns."""
    for _ in range(times.bit_length() - 1):
        a = _taps_up(_taps_up(a, TAPS[kind]).T, TAPS[kind]).T
    return a


def six_tap_down(a: Image) -> Image:
    """Half as large: low-passed by six places over 128, then every second place."""
    taps = [-6, 10, 60, 60, 10, -6]

    def half(x: np.ndarray) -> np.ndarray:
        p = np.pad(x, ((2, 3), (0, 0)), mode="edge")
        return np.clip((sum(t * p[i : i + len(x)] for i, t in enumerate(taps)) + 64) >> 7, 0, 255)[::2]

    return half(half(a).T).T


# ---- prediction ---------------------------------------------------------------------------------------

MODES = ("horizontal", "vertical", "dc", "average", "median", "diagonal", "bilinear", "reference")


def predicted(above: np.ndarray, left: np.ndarray, corner: int, n: int) -> dict[str, np.ndarray]:
    """A block of n by n from the row above (2 n places), the column at its left and the corner between."""
    y, x = np.indices((n, n))
    up, side = above[:n], left[:n]
    return {
        "horizontal": np.repeat(side[:, None], n, 1), "vertical": np.repeat(up[None], n, 0), "dc": np.full((n, n), (up.sum() + side.sum() + n) // (2 * n)),
        "average": (up[None] + side[:, None]) >> 1, "median": np.median(np.stack([np.repeat(up[None], n, 0), np.repeat(side[:, None], n, 1), up[None] + side[:, None] - corner]), axis=0).astype(np.int64),
        "diagonal": above[np.minimum(x + y + 1, 2 * n - 1)],
        "bilinear": ((n - x - 1) * side[:, None] + (x + 1) * up[-1] + (n - y - 1) * up[None] + (y + 1) * side[-1] + n) // (2 * n),
    }


def best_prediction(a: Image, y: int, x: int, n: int, search: int = 0) -> tuple[str, int, np.ndarray]:
    """The mode of least absolute difference (the earlier on ties), that difference, and the residue.

    With ``search``, the REFERENCE mode tries whole blocks already coded, up to so many places up and left.
    """
    h, w = a.shape
    block = a[y : y + n, x : x + n]
    row = a[y - 1] if y else np.zeros(w, a.dtype)
    above = np.concatenate([row[x : x + 2 * n], np.full(2 * n, row[min(w, x + 2 * n) - 1])])[: 2 * n]
    left = a[y : y + n, x - 1] if x else np.zeros(n, a.dtype)
    corner = int(a[y - 1, x - 1]) if x and y else 0
    tried = predicted(above, left, corner, n)
    tried = {m: tried[m] for m in MODES[:-1]}
    best = min(((int(np.abs(block - p).sum()), MODES.index(m)) for m, p in tried.items()))
    chosen = tried[MODES[best[1]]]
    for yy in range(max(0, y - search), y - n + 1):
        for xx in range(max(0, x - search), min(w - n, x + search) + 1):
            p = a[yy : yy + n, xx : xx + n]
            sad = int(np.abs(block - p).sum())
            if sad < best[0]:
                best, chosen = (sad, len(MODES) - 1), p
    return MODES[best[1]], best[0], block - chosen


def quad_nodes(a: Image, count: int, least: int = 2) -> list[tuple[int, int, int, int]]:
    """(x, y, side, variance) of ``count`` nodes at least: the one of highest variance splits in four, until there are so many or all are small."""

    def node(x: int, y: int, side: int) -> tuple:
        p = a[y : y + side, x : x + side].astype(np.int64)
        n = p.size
        return (-int((int((p * p).sum()) - int(p.sum()) ** 2 // n) // n), x, y, side)

    heap, done = [node(0, 0, len(a))], []
    while heap and len(heap) + len(done) < count:
        v, x, y, side = heapq.heappop(heap)
        if side <= least:
            done.append((v, x, y, side))
            continue
        for dy in (0, side // 2):
            for dx in (0, side // 2):
                heapq.heappush(heap, node(x + dx, y + dy, side // 2))
    return sorted((x, y, side, -v) for v, x, y, side in heap + done)


# ---- quality ------------------------------------------------------------------------------------------

#: The default window of structural similarity.
WINDOW = np.array([2, 9, 23, 32, 23, 9, 2])


def ssim1024(a: Image, b: Image) -> int:
    """Mean structural similarity times 1024."""
    k = WINDOW / WINDOW.sum()
    ma, mb = convolved(a, k), convolved(b, k)
    va, vb, cov = convolved(a * a, k) - ma * ma, convolved(b * b, k) - mb * mb, convolved(a * b, k) - ma * mb
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return int(round(1024 * float(np.mean((2 * ma * mb + c1) * (2 * cov + c2) / ((ma**2 + mb**2 + c1) * (va + vb + c2))))))


def psnr1024(a: Image, b: Image) -> int:
    e = float(np.mean((a - b) ** 2))
    return 0 if e == 0 else int(round(10240 * np.log10(65025 / e)))


def psnr_hvs1024(a: Image, b: Image) -> int:
    """The same over cosine coefficients of 8 by 8 at every seventh place, weighed by sensitivity, less what contrast masks; 0 for no error."""
    u = np.arange(8)
    c = np.cos((2 * u[None] + 1) * u[:, None] * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)[:, None]
    weight = 1 / (1 + 0.25 * (u[:, None] + u[None])) ** 2
    total = n = 0
    for y in range(0, a.shape[0] - 7, 7):
        for x in range(0, a.shape[1] - 7, 7):
            p, q = (c @ m[y : y + 8, x : x + 8] @ c.T for m in (a, b))
            masked = max(float((z**2 * weight).sum() - z[0, 0] ** 2 * weight[0, 0]) for z in (p, q))
            limit = np.sqrt(masked * 0.01) / 32
            d = np.abs(p - q)
            d[1:, :], d[0, 1:] = np.maximum(d[1:, :] - limit, 0), np.maximum(d[0, 1:] - limit, 0)
            total += float((d**2 * weight).sum())
            n += 64
    return 0 if total == 0 else int(round(10240 * np.log10(65025 * n / total)))
