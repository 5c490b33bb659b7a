"""Colour conversions of 8-bit images in blue-green-red order, as whole-array arithmetic."""

from __future__ import annotations

import numpy as np


def gray(bgr: np.ndarray) -> np.ndarray:
    """Luma with the usual weights, in 14-bit fixed point, rounded."""
    b, g, r = (bgr[..., i].astype(np.int64) for i in range(3))
    return ((b * 1868 + g * 9617 + r * 4899 + (1 << 13)) >> 14).astype(np.uint8)


def hsv(bgr: np.ndarray) -> np.ndarray:
    """Hue in half degrees (0 to 179), saturation and value (0 to 255)."""
    x = bgr.astype(np.float64)
    b, g, r = x[..., 0], x[..., 1], x[..., 2]
    v, low = x.max(-1), x.min(-1)
    span = v - low
    safe = np.where(span > 0, span, 1)
    h = np.select([span == 0, v == r, v == g], [0.0, (g - b) / safe, 2 + (b - r) / safe], 4 + (r - g) / safe)
    h = np.rint(h * 30) % 180
    s = np.where(v > 0, np.rint(255 * span / np.where(v > 0, v, 1)), 0)
    return np.stack([h, s, v], -1).astype(np.uint8)


def lab(bgr: np.ndarray) -> np.ndarray:
    """CIE L*a*b* for sRGB primaries and D65 white, scaled to bytes: L by 255/100, a and b with 128 added."""
    x = bgr[..., ::-1].astype(np.float64) / 255
    linear = np.where(x > 0.04045, ((x + 0.055) / 1.055) ** 2.4, x / 12.92)
    to_xyz = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
    t = linear @ to_xyz.T / np.array([0.950456, 1.0, 1.088754])
    f = np.where(t > (6 / 29) ** 3, np.cbrt(t), t * (29 / 6) ** 2 / 3 + 4 / 29)
    out = np.stack([(116 * f[..., 1] - 16) * 255 / 100, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], -1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def three_channels(pixels: np.ndarray) -> np.ndarray:
    """Gray, gray with alpha or colour with alpha as blue-green-red."""
    if pixels.ndim == 2:
        pixels = pixels[..., None]
    if pixels.shape[-1] in (1, 2):
        return np.repeat(pixels[..., :1], 3, -1)
    return np.ascontiguousarray(pixels[..., :3])


def heat_colors(level: np.ndarray) -> np.ndarray:
    """A rainbow-like map of bytes to blue-green-red, from its published polynomial fit."""
    x = level.astype(np.float64) / 255
    powers = np.stack([x**i for i in range(6)], -1)
    red = powers @ [0.13572138, 4.61539260, -42.66032258, 132.13108234, -152.94239396, 59.28637943]
    green = powers @ [0.09140261, 2.19418839, 4.84296658, -14.18503333, 4.27729857, 2.82956604]
    blue = powers @ [0.10667330, 12.64194608, -60.58204836, 110.36276771, -89.90310912, 27.34824973]
    return np.clip(np.rint(np.stack([blue, green, red], -1) * 255), 0, 255).astype(np.uint8)
