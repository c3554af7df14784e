"""Forensic features of images: spectra, block transforms, residuals, wavelets, colours and degradation of selected patches.

All patches of an image are one array (patches, height, width), so that each feature is computed for all of them at once.
Images are float arrays of height x width x 3 in 0..255 (features.as_rgb). What isn't finite counts as 0.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame

from .features import as_rgb, block_dct, corr, luma, moments, robust_scale

EPS = 1e-8
# Frequencies (cycles per pixel, across and down) at which resampling leaves peaks, and shifts by which it copies a spectrum.
PEAKS = ((1 / 2, 0), (0, 1 / 2), (1 / 2, 1 / 2), (1 / 4, 0), (0, 1 / 4), (1 / 4, 1 / 4), (1 / 4, 1 / 2), (1 / 2, 1 / 4), (1 / 8, 0), (0, 1 / 8), (1 / 8, 1 / 8), (1 / 3, 0), (0, 1 / 3), (1 / 3, 1 / 3), (1 / 6, 0), (0, 1 / 6))
SHIFTS = ((1 / 2, 0), (0, 1 / 2), (1 / 2, 1 / 2), (1 / 4, 0), (0, 1 / 4), (1 / 4, 1 / 4), (1 / 3, 0), (0, 1 / 3))
# Edges of frequency bands, sizes of histograms and windows.
BANDS = (0, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5)
RINGS, SECTORS, WELCH, STEPS, LAGS = 64, 36, 128, 16, 8
# High-pass filters, the filter of a mosaic's neighbours, and the scaling filter of eight taps.
FILTERS = {
    "first": np.array([[-1, 1]]) * 1.0,
    "second": np.array([[1, -2, 1]]) * 1.0,
    "square": np.array([[-1, 2, -1], [2, -4, 2], [-1, 2, -1]]) / 4,
    "five": np.array([[-1, 2, -2, 2, -1], [2, -6, 8, -6, 2], [-2, 8, -12, 8, -2], [2, -6, 8, -6, 2], [-1, 2, -2, 2, -1]]) / 12,
}
MOSAIC = np.array([[1, 2, 1], [2, 0, 2], [1, 2, 1]]) / 4
SCALING = np.array([0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385, -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278])
#: Families and how many numbers each gives for a patch; "global" and "patch_meta" come besides.
WIDTHS = {"spectral": 134, "dct": 244, "residual": 767, "wavelet": 100, "color": 30}
GLOBAL, META = 16, 4


def filtered(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Convolution over the last two axes with edges mirrored (the edge itself twice). A kernel of even size reaches back."""
    kh, kw = kernel.shape
    up, left = (kh - 1) // 2, (kw - 1) // 2
    # the flipped kernel looks as far back as the kernel reaches ahead
    pads = [(0, 0)] * (x.ndim - 2) + [(kh - 1 - up, up), (kw - 1 - left, left)]
    padded, out = np.pad(x, pads, mode="symmetric"), 0.0
    for (i, j), k in np.ndenumerate(kernel[::-1, ::-1]):
        if k:
            out = out + k * padded[..., i : i + x.shape[-2], j : j + x.shape[-1]]
    return out


def zigzag(size: int = 8) -> list[int]:
    """The order of a block's coefficients, diagonal by diagonal, each in the other direction than the one before."""
    cells = [(i, j) for i in range(size) for j in range(size)]
    return [i * size + j for i, j in sorted(cells, key=lambda c: (sum(c), c[0] if sum(c) % 2 else -c[0]))]


# patches ----------------------------------------------------------------------------------------------------------------
def select_patches(rgb: np.ndarray, patch: int = 256, rich: int = 4, poor: int = 4, align: int = 16, overlap: float = 0.35) -> list[tuple[int, int, int, int]]:
    """(y, x, size, is_rich) of the patches with least texture, then of those with most.

    Origins lie on a grid of align pixels; patches that are mostly clipped are left out, and those of one kind overlap by no
    more than that share. Images with too few places repeat them.
    """
    size = max(64, min(patch, min(rgb.shape[:2]) // align * align))
    short = [max(0, size - n) for n in rgb.shape[:2]]
    rgb = np.pad(rgb, ((0, short[0]), (0, short[1]), (0, 0)), mode="reflect") if any(short) else rgb
    grey = luma(rgb)[::2, ::2]
    texture = sum(np.abs(np.diff(grey, axis=a, prepend=np.take(grey, [0], a))) for a in (0, 1))
    step = max(align, size // 2 // (2 * align) * align)
    places = [np.arange(0, (n - size) // 2 + 1, step) for n in rgb.shape[:2]]
    mean = lambda x: sliding_window_view(x, (size // 2, size // 2))[np.ix_(*places)].mean((2, 3))
    score, clipped = mean(texture), mean(((grey <= 2) | (grey >= 253)) * 1.0)
    usable = clipped < 0.4 if (clipped < 0.4).any() else np.ones_like(clipped, bool)
    order = sorted((float(score[i, j]), 2 * int(places[0][i]), 2 * int(places[1][j])) for i, j in zip(*np.nonzero(usable), strict=True))

    def spread(found: list, most: int, kind: int) -> list[tuple[int, int, int, int]]:
        kept: list[tuple[int, int, int, int]] = []
        for _, y, x in found:
            shared = [max(0, size - abs(y - b)) * max(0, size - abs(x - a)) for b, a, _, _ in kept]
            if len(kept) < most and max(shared, default=0) <= overlap * size * size:
                kept.append((y, x, size, kind))
        return kept

    chosen = spread(sorted(order, key=lambda c: c[0]), poor, 0) + spread(order[::-1], rich, 1) or [(0, 0, size, 1)]
    return [chosen[i % len(chosen)] for i in range(rich + poor)]


def cut_out(rgb: np.ndarray, places: list[tuple[int, int, int, int]]) -> np.ndarray:
    """(patches, size, size, 3); what lies beyond the image is mirrored."""
    size = places[0][2]
    need = [max(0, max(p[a] for p in places) + size - n) for a, n in enumerate(rgb.shape[:2])]
    whole = np.pad(rgb, ((0, need[0]), (0, need[1]), (0, 0)), mode="reflect")
    return np.stack([whole[y : y + size, x : x + size] for y, x, _, _ in places])


# spectral ---------------------------------------------------------------------------------------------------------------
@lru_cache(maxsize=8)
def _plane(n: int) -> dict[str, np.ndarray]:
    """What is known of each cell of a centred spectrum of n x n."""
    f = np.fft.fftshift(np.fft.fftfreq(n))
    radius, angle = np.hypot(f[:, None], f[None, :]), np.arctan2(f[:, None], f[None, :]) % np.pi
    at = lambda x: np.clip(np.rint(np.array(x) * n).astype(int) + n // 2, 0, n - 1)
    ring = (radius > 0.15) & (radius <= 0.5)
    return {
        "radius": radius,
        "bin": np.where(radius > 0.5, RINGS, np.minimum((2 * radius * RINGS).astype(int), RINGS - 1)),
        "sector": np.where(ring, np.minimum((angle / np.pi * SECTORS).astype(int), SECTORS - 1), SECTORS),
        "ring": ring,
        "peaks": np.stack([at([v for _, v in PEAKS]), at([u for u, _ in PEAKS])], 1),
        "window": np.outer(np.hanning(n), np.hanning(n)),
    }


def _means(x: np.ndarray, label: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Means of (patches, cells) by label, and how many cells have it; labels from count on don't count."""
    sizes = np.bincount(label.ravel(), minlength=count + 1)[:count]
    return np.stack([np.bincount(label.ravel(), row.ravel(), count + 1)[:count] for row in x]) / np.maximum(sizes, 1), sizes


def periodogram(grey: np.ndarray, n: int = WELCH) -> np.ndarray:
    """The mean power spectrum of half-overlapping windows of each patch, centred."""
    n = min(n, *grey.shape[1:])
    tiles = sliding_window_view(grey, (n, n), axis=(1, 2))[:, :: max(1, n // 2), :: max(1, n // 2)]
    tiles = (tiles - tiles.mean((-2, -1), keepdims=True)) * _plane(n)["window"]
    return np.fft.fftshift((np.abs(np.fft.fft2(tiles)) ** 2).mean((1, 2)), axes=(1, 2))


def spectral(grey: np.ndarray) -> np.ndarray:
    """Power law of the spectrum and what deviates from it: by radius, direction, peak, copy and band."""
    power = np.log(periodogram(grey) + EPS)
    n = power.shape[-1]
    plane = _plane(n)
    ring = plane["ring"]
    power = power - power[:, ring].mean(1)[:, None, None]
    profile, sizes = _means(power, plane["bin"], RINGS)
    bins = np.arange(RINGS)
    profile = np.stack([np.interp(bins, bins[sizes > 0], p[sizes > 0]) for p in profile])
    slope, level = np.polyfit(np.log(bins[3:] / RINGS / 2), profile[:, 3:].T, 1)
    law = np.log(np.maximum(bins, 0.5) / RINGS / 2)[None, :] * slope[:, None] + level[:, None]
    usual = np.stack([np.interp(plane["radius"], bins / RINGS / 2, p) for p in profile])
    rest = power - usual
    noise = robust_scale(rest[:, ring]) + EPS
    around = sliding_window_view(np.pad(rest, ((0, 0), (3, 3), (3, 3)), mode="reflect"), (7, 7), axis=(1, 2))[:, plane["peaks"][:, 0], plane["peaks"][:, 1]]
    peaks = (around[..., 2:5, 2:5].max((-2, -1)) - np.median(around, axis=(-2, -1))) / noise[:, None]

    def copied(u: float, v: float) -> np.ndarray:
        by = (int(round(v * n)), int(round(u * n)))
        both = ring & np.roll(ring, by, (0, 1))
        return corr(rest[:, both], np.roll(rest * ring, by, (1, 2))[:, both]) if both.sum() > 64 else np.zeros(len(rest))

    bands = [(plane["radius"] > a) & (plane["radius"] <= b) for a, b in zip(BANDS, BANDS[1:], strict=False)]
    return np.concatenate([slope[:, None], level[:, None], profile - law, _means(rest, plane["sector"], SECTORS)[0], peaks, np.stack([copied(*s) for s in SHIFTS], 1), np.stack([rest[:, b].mean(1) if b.any() else np.zeros(len(rest)) for b in bands], 1), noise[:, None], (np.percentile(rest, 99.5, axis=(1, 2)) / noise)[:, None]], 1)


# block transform --------------------------------------------------------------------------------------------------------
def lattice(coefficients: np.ndarray, most: int = 2048) -> np.ndarray:
    """(frequencies, steps): how well the first alternating coefficients of (blocks, 64) lie on a lattice of steps 1, 2, ..."""
    c = coefficients[:: max(1, len(coefficients) // most) if len(coefficients) > most else 1, zigzag()[1:11]]
    return np.abs(np.exp(2j * np.pi * c[:, :, None] / np.arange(1, STEPS + 1)).mean(0))


def phases(grey: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean steps between neighbours, across and down, by their place in blocks of 8, relative to their mean."""
    across = np.stack([np.abs(np.diff(grey, axis=1))[:, i::8].mean() for i in range(8)])
    down = np.stack([np.abs(np.diff(grey, axis=0))[i::8].mean() for i in range(8)])
    return across / (across.mean() + EPS), down / (down.mean() + EPS)


def dct(grey: np.ndarray) -> np.ndarray:
    """Statistics of the coefficients of blocks of 8 x 8, the steps they are rounded to, and the edges between blocks."""

    def one(g: np.ndarray) -> np.ndarray:
        c = block_dct(g - 128).reshape(-1, 64)
        size, fit = np.log1p(np.abs(c)), lattice(c)
        return np.concatenate([size.mean(0), size.std(0), (np.abs(c) < 0.5).mean(0), fit.argmax(1) + 1.0, fit.max(1), fit.mean(0), *phases(g)])

    return np.stack([one(g) for g in grey])


# residuals --------------------------------------------------------------------------------------------------------------
def triples(symbols: np.ndarray, count: int = 5) -> np.ndarray:
    """Shares of the triples of neighbouring symbols, across and down together."""
    codes = [sliding_window_view(symbols, 3, axis=a).reshape(-1, 3) @ (count ** np.arange(3)[::-1]) for a in (1, 0)]
    return np.bincount(np.concatenate(codes), minlength=count**3) / (sum(map(len, codes)) + EPS)


def autocorrelation(x: np.ndarray, lags: int = LAGS) -> np.ndarray:
    """Cyclic autocorrelation of patches at lags 0.. down, and 0.. and then -lags.. across, relative to lag 0."""
    f = np.fft.rfft2(x - x.mean((1, 2), keepdims=True))
    a = np.fft.irfft2(np.abs(f) ** 2, s=x.shape[1:])
    a = a / (a[:, :1, :1] + EPS)
    return a[:, :lags][:, :, np.r_[0:lags, -lags:0]].reshape(len(x), -1)


def residual(rgb: np.ndarray) -> np.ndarray:
    """What high-pass filters leave: co-occurrences, noise levels, periodicity, shape."""
    grey, out = luma(rgb), []
    for kernel in FILTERS.values():
        rest = filtered(grey, kernel)
        level = robust_scale(rest.reshape(len(rest), -1))
        symbols = np.clip(np.rint(rest / level[:, None, None]), -2, 2).astype(int) + 2
        out += [np.stack([triples(s) for s in symbols]), np.log1p(level)[:, None]]
    last = rest / (level[:, None, None] + EPS)
    envelope = np.abs(last)
    box = np.full((1, 9), 1 / 9)
    out += [autocorrelation(last), autocorrelation(envelope - filtered(filtered(envelope, box), box.T)), moments(np.clip(last, -8, 8).reshape(len(last), -1))]
    noise = [robust_scale(filtered(rgb[..., c], FILTERS["square"]).reshape(len(rgb), -1)) for c in range(3)]
    return np.concatenate([*out, np.log1p(np.stack(noise, 1))], 1)


# wavelets ---------------------------------------------------------------------------------------------------------------
def wavelet_step(x: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The coarse half and the three details (down, across, both) of the last two axes, cyclic."""
    high = (SCALING * (-1.0) ** np.arange(8))[::-1]

    def halves(a: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
        n = a.shape[axis] // 2 * 2
        taps = np.take(np.take(a, range(n), axis), (2 * np.arange(n // 2)[:, None] + np.arange(8) - 3) % max(1, n), axis)
        axis = axis % a.ndim
        return tuple(np.tensordot(taps, f, ([axis + 1], [0])) for f in (SCALING, high))

    low, across = halves(x, -1)
    coarse, down = halves(low, -2)
    return coarse, (down, *halves(across, -2))


def surprise(detail: np.ndarray, others: list[np.ndarray], parent: np.ndarray | None) -> np.ndarray:
    """Moments of what a linear prediction of log sizes leaves: from neighbours, the other details and the coarser level."""
    size = lambda x: np.log(np.abs(x) + 1)
    own = size(detail)
    given = [np.roll(own, by, axis) for axis in (0, 1) for by in (1, -1)] + [size(o) for o in others]
    if parent is not None:
        wide = np.kron(size(parent), np.ones((2, 2)))[: own.shape[0], : own.shape[1]]
        given += [wide] * (wide.shape == own.shape)
    every = max(1, own.size // 8192)
    x = np.stack([*[g.ravel()[::every] for g in given], np.ones(len(own.ravel()[::every]))], 1)
    y = own.ravel()[::every]
    normal = x.T @ x
    normal += np.eye(len(normal)) * 1e-6 * (np.trace(normal) / len(normal) + EPS)  # columns that coincide stay solvable
    return moments(y - x @ np.linalg.solve(normal, x.T @ y))


def wavelet(rgb: np.ndarray, levels: int = 3) -> np.ndarray:
    """Shape, level and predictability of details at each scale, their correlation, the decay of energy, and the channels' shares of it."""
    details, coarse = [], luma(rgb)
    for _ in range(levels):
        coarse, found = wavelet_step(coarse)
        details.append(found)
    flat = lambda x: x.reshape(len(x), -1)
    out = []
    for level, found in enumerate(details):
        for i, d in enumerate(found):
            scale = robust_scale(flat(d))
            others = [o for j, o in enumerate(found) if j != i]
            above = details[level + 1][i] if level + 1 < levels else [None] * len(rgb)
            out += [moments(flat(d) / scale[:, None]), np.log1p(scale)[:, None], np.stack([surprise(d[p], [o[p] for o in others], above[p]) for p in range(len(rgb))])]
        sizes = [np.abs(flat(d)) for d in found]
        out.append(np.stack([corr(sizes[0], sizes[1]), corr(sizes[0], sizes[2]), corr(sizes[1], sizes[2])], 1))
    energy = np.stack([np.abs(np.concatenate([flat(d) for d in found], 1)).mean(1) for found in details], 1)
    channels = np.stack([sum(np.abs(flat(d)).mean(1) for d in wavelet_step(rgb[..., c])[1]) for c in range(3)], 1)
    return np.concatenate([*out, np.log1p(energy), np.log((energy[:, :-1] + EPS) / (energy[:, 1:] + EPS)), np.log1p(channels), channels[:, [0, 2]] / (channels[:, 1:2] + EPS)], 1)


# colours ----------------------------------------------------------------------------------------------------------------
def color(rgb: np.ndarray) -> np.ndarray:
    """Energy of a mosaic's lattice, correlation of channels, opponent colours, clipping, spread."""
    planes = np.moveaxis(rgb, -1, 0)
    rest = planes - filtered(planes, MOSAIC)
    flat = lambda x: x.reshape(len(x), -1)
    lattices = np.stack([rest[..., i::2, j::2].var((-2, -1)) for i in (0, 1) for j in (0, 1)], -1)
    lattices = lattices / (lattices.sum(-1, keepdims=True) + EPS)
    out = [np.concatenate([own, (own.max(-1) / (own.min(-1) + EPS))[:, None]], 1) for own in lattices]
    out.append(np.stack([corr(flat(rest[a]), flat(rest[b])) for a, b in ((0, 1), (1, 2), (0, 2))], 1))
    detail = lambda x: np.abs(filtered(x, FILTERS["square"])).mean((-2, -1))
    grey = detail(luma(rgb)) + EPS
    red, green, blue = planes
    out.append(np.stack([np.log1p(grey), detail(red - green) / grey, detail(blue - (red + green) / 2) / grey], 1))
    return np.concatenate([*out, (planes >= 253).mean((-2, -1)).T, (planes <= 2).mean((-2, -1)).T, planes.std((-2, -1)).T / 64], 1)


def degradation(rgb: np.ndarray) -> np.ndarray:
    """How an image was degraded: noise, blur, blocks, quantisation, size, exposure. Costly parts see an aligned window in its middle."""
    grey = luma(rgb)
    h, w = grey.shape
    side = max(64, min(384, min(h, w) // 16 * 16))
    y, x = (max(0, (n - side) // 2 // 16 * 16) for n in (h, w))
    g = grey[y : y + side, x : x + side]
    details = wavelet_step(g)[1]
    steps = sum(np.abs(np.diff(g, axis=a)).mean() for a in (0, 1))
    c = block_dct(g - 128).reshape(-1, 64)
    fit = lattice(c)
    block = np.mean([p[7] for p in phases(g)])
    logs = np.log1p([robust_scale(details[2].reshape(1, -1))[0], filtered(g, FILTERS["square"]).var(), steps])
    return np.array([*logs, sum(np.abs(d).mean() for d in details) / (steps + EPS), block, np.log1p(np.median(fit.argmax(1) + 1)), fit.max(1).mean(), (np.abs(c[:, zigzag()[1:11]]) < 0.5).mean(), np.log(h) / 8, np.log(w) / 8, w / (h + EPS), np.log1p(h * w) / 16, grey.mean() / 255, grey.std() / 64, (grey >= 253).mean(), (grey <= 2).mean()])


# the whole --------------------------------------------------------------------------------------------------------------
def extract(img: np.ndarray, families: tuple[str, ...] = tuple(WIDTHS), **options) -> dict[str, np.ndarray]:
    """Family -> (patches, width) numbers, "global" of the image and "patch_meta" (is_rich, relative place, log size)."""
    rgb = as_rgb(img).astype(np.float64)
    places = select_patches(rgb, **options)
    patches = cut_out(rgb, places)
    made = {"spectral": lambda: spectral(luma(patches)), "dct": lambda: dct(luma(patches)), "residual": lambda: residual(patches), "wavelet": lambda: wavelet(patches), "color": lambda: color(patches)}
    out = {f: made[f]() for f in families}
    h, w = rgb.shape[:2]
    out["global"] = degradation(rgb)
    out["patch_meta"] = np.array([(kind, y / max(h - size, 1), x / max(w - size, 1), np.log(size) / 8) for y, x, size, kind in places])
    return {k: np.nan_to_num(v.astype(np.float32), nan=0.0, posinf=0.0, neginf=0.0) for k, v in out.items()}


def raw_pixels(content: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(content, np.uint8).reshape(height, width, 3)


def extract_with_valid(images: DataFrame, families: tuple[str, ...] = tuple(WIDTHS), decode=raw_pixels, patches: int = 8) -> DataFrame:
    """path, valid, error and an array of numbers for each family, "global" and "patch_meta" of rows (path, content, width, height).

    An image whose features fail is a row of zeros with valid false and the reason; nothing ends the job. decode gives the
    pixels of a content, raw bytes unless another one is named.
    """
    sizes = {**{f: patches * WIDTHS[f] for f in families}, "global": GLOBAL, "patch_meta": patches * META}

    def run(batches):
        for batch in batches:
            rows = []
            for path, content, width, height in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "width", "height")), strict=True):
                try:
                    found = extract(decode(content, width, height), families, rich=patches // 2, poor=patches - patches // 2)
                    rows.append({"path": path, "valid": True, "error": None} | {k: found[k].ravel() for k in sizes})
                except Exception as e:  # a failure is a row
                    rows.append({"path": path, "valid": False, "error": f"{type(e).__name__}: {e}"} | {k: np.zeros(n, np.float32) for k, n in sizes.items()})
            columns = {"path": pa.string(), "valid": pa.bool_(), "error": pa.string(), **dict.fromkeys(sizes, pa.list_(pa.float32()))}
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in columns.items()], names=list(columns))

    schema = "path string, valid boolean, error string, " + ", ".join(f"`{k}` array<float>" for k in sizes)
    return images.select("path", "content", "width", "height").mapInArrow(run, schema)
