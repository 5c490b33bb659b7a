"""Plates in images: finding them, their features and quality, comparing a pair. Pure functions over arrays."""

from __future__ import annotations

import numpy as np

from lamella.raster import color, filters, shapes

PLATE = 256
#: Thresholds of the response mask; a profile may bring its own.
SATURATION, VALUE, LEAST_AREA = 50, 38, 18
#: The 18 numbers of a plate in the order of the model's vector.
FEATURES = (
    "response_area_fraction",
    "component_count",
    "largest_component_fraction",
    "largest_eccentricity",
    "largest_solidity",
    "largest_perimeter_px",
    "largest_elongation",
    "skeleton_length_px",
    "branch_pixels",
    "endpoint_pixels",
    "response_centroid_x_norm",
    "response_centroid_y_norm",
    "hue_mean",
    "hue_std",
    "saturation_mean",
    "value_mean",
    "lab_a_mean",
    "lab_b_mean",
)
COUNTS = ("component_count", "skeleton_length_px", "branch_pixels", "endpoint_pixels")


def response_mask(hsv: np.ndarray, saturation: int = SATURATION, value: int = VALUE) -> np.ndarray:
    """Pixels within the disk that respond, opened and closed."""
    active = shapes.disk(*hsv.shape[:2]) & (hsv[..., 1] > saturation) & (hsv[..., 2] > value)
    return shapes.closed(shapes.opened(active))


def accepted(score: tuple[float, float, float, float], contrast: float = 100, ring: float = 170, dark: float = 0.75) -> bool:
    """Whether a circle's score (means inside and around, contrast, share of dark pixels) is that of a plate."""
    return score[2] > contrast and score[3] > dark and score[1] > ring


def find_plates(bgr: np.ndarray) -> list[tuple[int, int, int, tuple[float, float, float, float]]]:
    """Circles that look like plates, in reading order, with their scores."""
    gray = color.gray(bgr)
    side = min(gray.shape)
    low = max(15, int(0.06 * side))
    high = max(low + 2, int(0.48 * side))
    found = []
    for x, y, r in shapes.hough_circles(filters.gaussian(gray, 7, 1.5), low, high):
        score = shapes.circle_score(gray, x, y, r)
        if score and accepted(score):
            found.append((x, y, r, score))
    found.sort(key=lambda c: -c[3][2])
    kept = shapes.suppress_overlaps([c[:3] for c in found])
    return sorted((found[i] for i in kept), key=lambda c: (c[1], c[0]))


def extract(bgr: np.ndarray) -> tuple[str, list[np.ndarray]]:
    """How plates were taken from an image, and the plates: the circles found, or the whole image."""
    circles = find_plates(bgr)
    if circles:
        return "detected_circles", [filters.crop_circle(bgr, x, y, r, PLATE) for x, y, r, _ in circles]
    return "whole_image_fallback", [filters.resize_area(filters.center_square(bgr), PLATE)]


def _moments(values: np.ndarray) -> tuple[float, float]:
    return (float(values.mean()), float(values.std())) if len(values) else (0.0, 0.0)


def features(bgr: np.ndarray, saturation: int = SATURATION, value: int = VALUE) -> tuple[dict[str, float], np.ndarray]:
    """The numbers of a plate and its response mask; components of few pixels are left out."""
    hsv, lab = color.hsv(bgr), color.lab(bgr)
    mask = shapes.without_small(response_mask(hsv, saturation, value), LEAST_AREA)
    labels = shapes.components(mask)
    area = np.bincount(labels.ravel(), minlength=2)[1:]
    inside = int(shapes.disk(*mask.shape).sum())
    total = int(mask.sum())
    largest = labels == int(np.argmax(area)) + 1 if total else np.zeros_like(mask)
    own = shapes.shape_properties(largest)
    thin = shapes.skeleton(mask)
    branches, ends = shapes.branch_and_end_points(thin)
    y, x = np.nonzero(mask)
    h, w = mask.shape
    hue, sat, val = (hsv[..., i][mask].astype(np.float64) for i in range(3))
    numbers = (
        total / max(inside, 1),
        float(np.count_nonzero(area)),
        own["area"] / max(inside, 1),
        own["eccentricity"],
        own["solidity"],
        own["perimeter"],
        own["elongation"],
        float(thin.sum()),
        float(branches),
        float(ends),
        float(x.mean() / w) if total else 0.0,
        float(y.mean() / h) if total else 0.0,
        *_moments(hue),
        _moments(sat)[0],
        _moments(val)[0],
        _moments(lab[..., 1][mask].astype(np.float64))[0],
        _moments(lab[..., 2][mask].astype(np.float64))[0],
    )
    return dict(zip(FEATURES, numbers)), mask


def quality(bgr: np.ndarray) -> dict[str, float]:
    """Sharpness of the whole plate; clipping and range within its disk."""
    gray, hsv = color.gray(bgr), color.hsv(bgr)
    d = shapes.disk(*gray.shape)
    g, s = gray[d], hsv[..., 1][d]
    p5, p95 = np.percentile(g, [5, 95])
    return dict(
        laplacian_variance=float(filters.laplacian(gray).var()),
        dark_clip_fraction=float((g <= 3).mean()),
        bright_clip_fraction=float((g >= 252).mean()),
        saturation_clip_fraction=float((s >= 252).mean()),
        gray_dynamic_range_p95_p5=float(p95 - p5),
    )


def register(left: np.ndarray, right: np.ndarray, sign: float = 1.0) -> tuple[np.ndarray, float, float, float]:
    """The right plate shifted towards the left one, with the shift and the response. ``sign`` is the direction of the shift."""
    a, b = (filters.gaussian(color.gray(p), 5) for p in (left, right))
    dx, dy, response = filters.phase_shift(a, b)
    return filters.translate(right, sign * dx, sign * dy), dx, dy, response


def compare(left: np.ndarray, right: np.ndarray, sign: float = 1.0) -> tuple[dict, dict[str, np.ndarray]]:
    """The record of a pair and its pictures: the aligned right plate, the difference as heat, and the panel of all."""
    aligned, dx, dy, response = register(left, right, sign)
    hl, hr = color.hsv(left), color.hsv(aligned)
    disk = shapes.disk(*hl.shape[:2])
    a, b = response_mask(hl) & disk, response_mask(hr) & disk
    both, either, one = a & b, a | b, a ^ b
    n = max(int(disk.sum()), 1)
    d = np.abs(hl[..., 0].astype(np.int16) - hr[..., 0].astype(np.int16))
    d = np.minimum(d, 180 - d).astype(np.float64)
    common = d[both]
    hue = float(common.mean()) if len(common) else None
    jaccard, xor = int(both.sum()) / max(int(either.sum()), 1), int(one.sum()) / n
    left_area, right_area = int(a.sum()) / n, int(b.sum()) / n
    score = 0.45 * xor + 0.25 * abs(left_area - right_area) + 0.20 * (1 - jaccard) + 0.10 * (hue or 0.0) / 90
    level = np.clip(np.where(both, 0.65 * d / 90, 0) + 0.35 * one, 0, 1) * disk
    heat = color.heat_colors((level * 255).astype(np.uint8))
    mask = np.repeat((one * np.uint8(255))[..., None], 3, -1)
    record = dict(
        dx=dx,
        dy=dy,
        response=response,
        left_response_area_fraction=left_area,
        right_response_area_fraction=right_area,
        absolute_area_fraction_delta=abs(left_area - right_area),
        response_jaccard_similarity=jaccard,
        response_xor_fraction=xor,
        mean_common_response_hue_distance=hue,
        p90_common_response_hue_distance=float(np.percentile(common, 90)) if len(common) else None,
        reference_asymmetry_score_0_1=float(np.clip(score, 0, 1)),
    )
    return record, dict(right_aligned=aligned, difference=heat, panel=np.concatenate([left, aligned, mask, heat], 1))
