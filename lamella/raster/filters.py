"""Stencils, resizing and shifting of 2-D arrays."""

from __future__ import annotations

import numpy as np


def gaussian(img: np.ndarray, size: int, sigma: float = 0.0) -> np.ndarray:
    """Blur with a separable kernel; borders are mirrored without repeating the edge. ``sigma`` 0: chosen by the size."""
    sigma = sigma or 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    half = size // 2
    k = np.exp(-((np.arange(size) - half) ** 2) / (2 * sigma * sigma))
    k /= k.sum()
    out = img.astype(np.float64)
    for axis in (0, 1):
        pad = [(half, half) if a == axis else (0, 0) for a in range(out.ndim)]
        wide = np.pad(out, pad, mode="reflect" if out.shape[axis] > half else "edge")
        out = sum(w * np.take(wide, np.arange(i, i + img.shape[axis]), axis) for i, w in enumerate(k))
    return out


def laplacian(img: np.ndarray) -> np.ndarray:
    """Sum of the four neighbours minus four times the value; mirrored borders."""
    w = np.pad(img.astype(np.int64), 1, mode="reflect")
    return w[:-2, 1:-1] + w[2:, 1:-1] + w[1:-1, :-2] + w[1:-1, 2:] - 4 * w[1:-1, 1:-1]


def sobel(img: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients along x and y."""
    w = np.pad(img.astype(np.float64), 1, mode="edge")
    smooth_y = w[:-2] + 2 * w[1:-1] + w[2:]
    smooth_x = w[:, :-2] + 2 * w[:, 1:-1] + w[:, 2:]
    return smooth_y[:, 2:] - smooth_y[:, :-2], smooth_x[2:] - smooth_x[:-2]


def _overlap(n_in: int, n_out: int) -> np.ndarray:
    """How much of each input cell an output cell covers, as shares of the output cell."""
    edges = np.linspace(0, n_in, n_out + 1)
    low, high = edges[:-1, None], edges[1:, None]
    cells = np.arange(n_in)[None, :]
    return np.clip(np.minimum(high, cells + 1) - np.maximum(low, cells), 0, None) * (n_out / n_in)


def resize_area(img: np.ndarray, size: int) -> np.ndarray:
    """Resized to ``size`` x ``size`` by area when shrinking, linearly between cell centres when growing."""
    out = img.astype(np.float64)
    for axis in (0, 1):
        n = img.shape[axis]
        if n >= size:
            weights = _overlap(n, size)
        else:
            at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
            low = np.minimum(at.astype(int), max(0, n - 2))
            weights = np.zeros((size, n))
            weights[np.arange(size), low] = 1 - (at - low)
            weights[np.arange(size), np.minimum(low + 1, n - 1)] += at - low
        out = np.moveaxis(np.tensordot(weights, out, (1, axis)), 0, axis)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def center_square(img: np.ndarray) -> np.ndarray:
    """The image in the middle of a black square."""
    h, w = img.shape[:2]
    side = max(h, w)
    out = np.zeros((side, side, *img.shape[2:]), img.dtype)
    y, x = (side - h) // 2, (side - w) // 2
    out[y : y + h, x : x + w] = img
    return out


def crop_circle(img: np.ndarray, x: float, y: float, r: float, size: int = 256, margin: float = 1.08) -> np.ndarray:
    """The square around a circle with a margin, filled up with black where the image ends, at a fixed size."""
    reach = int(np.rint(r * margin))
    h, w = img.shape[:2]
    part = img[max(0, int(y) - reach) : min(h, int(y) + reach), max(0, int(x) - reach) : min(w, int(x) + reach)]
    return resize_area(center_square(part), size)


def translate(img: np.ndarray, dx: float, dy: float) -> np.ndarray:
    """Shifted by (dx, dy), bilinear, black outside."""
    h, w = img.shape[:2]
    y, x = np.arange(h) - dy, np.arange(w) - dx
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = y - y0, x - x0
    if img.ndim == 3:
        fy, fx = fy[:, None], fx[:, None]

    def take(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        ok = ((rows >= 0) & (rows < h))[:, None] & ((cols >= 0) & (cols < w))[None, :]
        out = img[np.clip(rows, 0, h - 1)][:, np.clip(cols, 0, w - 1)].astype(np.float64)
        out[~ok] = 0
        return out

    fy = fy[:, None]
    top = take(y0, x0) * (1 - fx) + take(y0, x0 + 1) * fx
    low = take(y0 + 1, x0) * (1 - fx) + take(y0 + 1, x0 + 1) * fx
    out = top * (1 - fy) + low * fy
    return np.clip(np.rint(out), 0, 255).astype(np.uint8) if img.dtype == np.uint8 else out


def phase_shift(reference: np.ndarray, moving: np.ndarray) -> tuple[float, float, float]:
    """How far ``moving`` is from ``reference`` (dx, dy) by phase correlation, and the peak's share of the energy.

    The place of the peak is the centroid of the 5 x 5 cells around it.
    """
    a, b = np.fft.rfft2(reference.astype(np.float64)), np.fft.rfft2(moving.astype(np.float64))
    cross = b * np.conj(a)
    size = np.abs(cross)
    surface = np.fft.irfft2(np.where(size > 1e-12, cross / np.where(size > 1e-12, size, 1), 0), s=reference.shape)
    h, w = surface.shape
    py, px = np.unravel_index(int(np.argmax(surface)), surface.shape)
    oy, ox = np.mgrid[-2:3, -2:3]
    part = np.clip(surface[(py + oy) % h, (px + ox) % w], 0, None)
    total = part.sum()
    if total <= 0:
        return 0.0, 0.0, 0.0
    y, x = py + (part * oy).sum() / total, px + (part * ox).sum() / total
    y, x = (y - h if y > h / 2 else y), (x - w if x > w / 2 else x)
    return float(x), float(y), float(total)


#: Mean and spread of the channels (red, green, blue) for which public image encoders are trained.
CHANNEL_MEAN, CHANNEL_SPREAD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def encoder_input(bgr: np.ndarray, short: int = 256, side: int = 224) -> np.ndarray:
    """What an image encoder is given: the short side resized, the middle cut out, channels first in RGB order and standardised."""
    h, w = bgr.shape[:2]
    scale = short / min(h, w)
    size = max(short, round(h * scale)), max(short, round(w * scale))
    y, x = ((np.arange(n) + 0.5) * m / n - 0.5 for n, m in zip(size, (h, w)))
    y0, x0 = np.clip(np.floor(y).astype(int), 0, h - 1), np.clip(np.floor(x).astype(int), 0, w - 1)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = np.clip(y - y0, 0, 1)[:, None, None], np.clip(x - x0, 0, 1)[:, None]
    img = bgr[..., ::-1].astype(np.float64) / 255
    out = (img[y0][:, x0] * (1 - fx) + img[y0][:, x1] * fx) * (1 - fy) + (img[y1][:, x0] * (1 - fx) + img[y1][:, x1] * fx) * fy
    top, left = (size[0] - side) // 2, (size[1] - side) // 2
    out = (out[top : top + side, left : left + side] - CHANNEL_MEAN) / CHANNEL_SPREAD
    return np.ascontiguousarray(np.moveaxis(out, -1, 0).astype(np.float32))
