"""Pixels of one image as a numpy array, height x width (grey) or height x width x 3 (RGB), eight bits a value.

Pictures are prepared at most at their own size, one at a time, so memory is bounded by the largest picture."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from . import lexicons as L


def as_array(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """The image of raw rows; a fourth channel (opacity) is left out. Sizes that do not fit are a ValueError."""
    if width <= 0 or height <= 0 or channels not in (1, 3, 4) or len(data) != width * height * channels:
        raise ValueError(f"{len(data)} bytes are no {width}x{height} image of {channels} channels")
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return a[:, :, 0] if channels == 1 else a[:, :, :3]


def rgb(a: np.ndarray) -> np.ndarray:
    return np.repeat(a[:, :, None], 3, axis=2) if a.ndim == 2 else a


def luma(a: np.ndarray) -> np.ndarray:
    """Grey values by the usual weights of red, green and blue (299, 587, 114 of 1000)."""
    if a.ndim == 2:
        return a
    return ((a.astype(np.uint32) @ np.array([299, 587, 114], np.uint32) + 500) // 1000).astype(np.uint8)


def grey_share(a: np.ndarray) -> float:
    """The share of pixels whose red and blue are close to their green, together less than 10 away."""
    c = rgb(a).astype(np.int16)
    return float(np.mean(np.abs(c[:, :, [0, 2]] - c[:, :, [1]]).sum(axis=2) < 10))


def saturation(a: np.ndarray) -> float:
    """The mean of (largest - smallest) / largest channel; black pixels count 0."""
    c = rgb(a)
    top = c.max(axis=2).astype(np.float64)
    return float(np.mean((top - c.min(axis=2)) / np.maximum(top, 1)))


def stretch(a: np.ndarray) -> np.ndarray:
    """Values spread over 0 to 255; a flat image stays."""
    low, high = int(a.min()), int(a.max())
    return a if low == high else ((a.astype(np.float64) - low) / (high - low) * 255).astype(np.uint8)


def even_out(grey: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited adaptive equalisation: clipped histograms of tiles, their curves interpolated between centres."""
    h, w = grey.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    full = np.pad(grey, ((0, th * tiles - h), (0, tw * tiles - w)), mode="edge")
    cut = full.reshape(tiles, th, tiles, tw).transpose(0, 2, 1, 3).reshape(tiles * tiles, th * tw)
    counts = np.stack([np.bincount(t, minlength=256) for t in cut]).astype(np.float64)
    limit = max(clip * th * tw / 256, 1)
    over = np.maximum(counts - limit, 0).sum(axis=1, keepdims=True)
    curve = np.cumsum(np.minimum(counts, limit) + over / 256, axis=1) * (255 / (th * tw))
    curve = curve.reshape(tiles, tiles, 256)

    def between(n: int, size: int):
        at = np.clip((np.arange(n) + 0.5) / size - 0.5, 0, tiles - 1)
        first = np.minimum(at.astype(int), tiles - 2)
        return first, at - first

    (y, fy), (x, fx) = between(h, th), between(w, tw)
    y, fy, x, fx = y[:, None], fy[:, None], x[None], fx[None]
    top = curve[y, x, grey] * (1 - fx) + curve[y, x + 1, grey] * fx
    low = curve[y + 1, x, grey] * (1 - fx) + curve[y + 1, x + 1, grey] * fx
    return np.clip(np.rint(top * (1 - fy) + low * fy), 0, 255).astype(np.uint8)


def local_contrast(a: np.ndarray) -> np.ndarray:
    """even_out for brightness; colours move with it, so their differences stay."""
    if a.ndim == 2:
        return even_out(a)
    grey = luma(a)
    return np.clip(a.astype(np.int16) + (even_out(grey).astype(np.int16) - grey)[:, :, None], 0, 255).astype(np.uint8)


def median(a: np.ndarray) -> np.ndarray:
    """The median of three by three neighbours, edges repeated."""
    p = np.pad(a, ((1, 1), (1, 1)) + ((0, 0),) * (a.ndim - 2), mode="edge")
    h, w = a.shape[:2]
    near = np.stack([p[i : i + h, j : j + w] for i in range(3) for j in range(3)])
    return np.partition(near, 4, axis=0)[4]


def contrast(a: np.ndarray, factor: float = 1.3) -> np.ndarray:
    """Distances from the mean brightness times factor."""
    mean = int(luma(a).mean() + 0.5)
    return np.clip(mean + (a.astype(np.float64) - mean) * factor, 0, 255).astype(np.uint8)


def fit(a: np.ndarray, side: int) -> np.ndarray:
    """No side longer than `side`: means over the areas that one new pixel covers. Smaller images stay."""
    h, w = a.shape[:2]
    scale = max(h, w) / side
    if scale <= 1:
        return a

    def pool(x: np.ndarray, axis: int) -> np.ndarray:
        n = x.shape[axis]
        m = max(1, round(n / scale))
        starts = np.arange(m) * n // m
        sums = np.add.reduceat(x, starts, axis=axis)
        sizes = np.diff(np.append(starts, n))
        return sums / sizes.reshape([-1 if i == axis else 1 for i in range(x.ndim)])

    return np.rint(pool(pool(a.astype(np.float64), 0), 1)).astype(np.uint8)


def edge_share(grey: np.ndarray, low: int = 50, high: int = 150) -> float:
    """The share of pixels on edges: ridges of the Sobel gradient over low that hang together with one over high."""
    p = np.pad(grey.astype(np.int32), 1, mode="edge")
    rows = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    cols = p[:-2] + 2 * p[1:-1] + p[2:]
    dy, dx = rows[2:] - rows[:-2], cols[:, 2:] - cols[:, :-2]
    size = np.abs(dx) + np.abs(dy)
    m = np.pad(size, 1)
    h, w = grey.shape
    side = lambda i, j: m[1 + i : 1 + i + h, 1 + j : 1 + j + w]
    slope = np.tan(np.pi / 8)
    flat, steep = np.abs(dy) < slope * np.abs(dx), np.abs(dx) < slope * np.abs(dy)
    same = (dx >= 0) == (dy >= 0)
    before = np.where(flat, side(0, -1), np.where(steep, side(-1, 0), np.where(same, side(-1, -1), side(-1, 1))))
    after = np.where(flat, side(0, 1), np.where(steep, side(1, 0), np.where(same, side(1, 1), side(1, -1))))
    ridge = (size > low) & (size > before) & (size >= after)
    found = ridge & (size > high)
    while True:
        wide = np.pad(found, 1)
        grown = ridge & np.logical_or.reduce([wide[i : i + h, j : j + w] for i in range(3) for j in range(3)])
        if (grown == found).all():
            return float(found.mean())
        found = grown


def prepare(a: np.ndarray, kind: str, steps=L.PREPARATION, side: int = 1024) -> np.ndarray:
    """The image as its modality wants it; unknown ones are taken for clinical photographs."""
    todo = steps.get(kind, steps["clinical"])
    for name, step in (("normalize", stretch), ("clahe", local_contrast), ("denoise", median), ("enhance_contrast", contrast)):
        if name in todo:
            a = step(a)
    return fit(a, side)


def statistics(a: np.ndarray) -> dict[str, float]:
    """What the rules of images.pixel_findings ask for, percentages and means."""
    grey = luma(a)
    red, green, blue = (rgb(a)[:, :, i] for i in range(3))
    purple = (red > 80) & (red < 200) & (blue > 80) & (blue < 220) & (green < 150)
    part = lambda x: float(np.mean(x) * 100)
    return {
        "over180": part(grey > 180), "over200": part(grey > 200), "under30": part(grey < 30), "purple": part(purple),
        "sharpness": edge_share(grey), "mean": float(grey.mean()), "std": float(grey.std()),
    }


def png(a: np.ndarray) -> bytes:
    """A lossless file of the image, the one format that needs no library."""
    h, w = a.shape[:2]
    part = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), a.reshape(h, -1)], axis=1)
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if a.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines.tobytes(), 6)) + part(b"IEND", b"")
