import colorsys
import zlib
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lamella.raster import color, filters, grids, plates, png, shapes

masks = st.integers(0, 2**36 - 1).map(lambda v: np.array([(v >> i) & 1 for i in range(36)], bool).reshape(6, 6))


def flat(bgr, size=64):
    return np.full((size, size, 3), bgr, np.uint8)


def disk_plate(radius=60, bgr=(0, 200, 0), at=(128, 128), size=256):
    img = np.zeros((size, size, 3), np.uint8)
    y, x = np.mgrid[:size, :size]
    img[(y - at[0]) ** 2 + (x - at[1]) ** 2 <= radius**2] = bgr
    return img


@pytest.mark.parametrize("bgr", [(0, 0, 0), (255, 255, 255), (10, 200, 30), (200, 10, 30), (30, 10, 200), (90, 90, 90)])
def test_hsv_and_gray(bgr):
    b, g, r = (v / 255 for v in bgr)
    h, s, v = colorsys.rgb_to_hsv(r, g, b)
    got = color.hsv(flat(bgr))[0, 0].astype(int)
    assert abs(got[0] - h * 180) <= 1 and abs(got[1] - s * 255) <= 1 and got[2] == round(v * 255)
    assert abs(int(color.gray(flat(bgr))[0, 0]) - (0.114 * bgr[0] + 0.587 * bgr[1] + 0.299 * bgr[2])) <= 1


def test_lab():
    assert color.lab(flat((255, 255, 255)))[0, 0].tolist() == [255, 128, 128]
    assert color.lab(flat((0, 0, 0)))[0, 0].tolist() == [0, 128, 128]
    red = color.lab(flat((0, 0, 255)))[0, 0].astype(int)
    assert np.abs(red - [136, 208, 195]).max() <= 1


def test_channels():
    assert color.three_channels(np.zeros((2, 3), np.uint8)).shape == (2, 3, 3)
    assert color.three_channels(np.zeros((2, 3, 1), np.uint8)).shape == (2, 3, 3)
    assert color.three_channels(np.zeros((2, 3, 4), np.uint8)).shape == (2, 3, 3)


def slow_erode(m):
    h, w = m.shape
    near = lambda y, x: [m[a, b] for a in range(max(0, y - 1), min(h, y + 2)) for b in range(max(0, x - 1), min(w, x + 2))]
    return np.array([[all(near(y, x)) for x in range(w)] for y in range(h)])


@settings(max_examples=100, deadline=None)
@given(masks)
def test_morphology(m):
    assert (shapes.erode(m) == slow_erode(m)).all()
    assert (shapes.dilate(m) == ~slow_erode(~m)).all()
    o, c = shapes.opened(m), shapes.closed(m)
    assert (shapes.opened(o) == o).all() and (shapes.closed(c) == c).all()
    assert not (o & ~m).any() and not (m & ~c).any()
    assert (grids.eroded(m[None])[0] == shapes.erode(m)).all()


def slow_components(m):
    out, n = np.zeros(m.shape, int), 0
    for y, x in product(range(m.shape[0]), range(m.shape[1])):
        if m[y, x] and not out[y, x]:
            n += 1
            stack = [(y, x)]
            while stack:
                a, b = stack.pop()
                if 0 <= a < m.shape[0] and 0 <= b < m.shape[1] and m[a, b] and not out[a, b]:
                    out[a, b] = n
                    stack += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return out


@settings(max_examples=200, deadline=None)
@given(masks)
def test_components(m):
    assert (shapes.components(m) == slow_components(m)).all()


@settings(max_examples=100, deadline=None)
@given(masks)
def test_skeleton_keeps_components(m):
    thin = shapes.skeleton(m)
    assert not (thin & ~m).any()
    labels = shapes.components(m)
    # blocks of four pixels vanish by the published rules; everything larger stays in one piece or more
    for n in range(1, labels.max() + 1):
        if (labels == n).sum() > 4:
            assert thin[labels == n].any()


def test_without_small():
    m = np.zeros((10, 10), bool)
    m[:4, :4] = True
    m[6:, 6:9] = True
    assert shapes.without_small(m, 13).sum() == 16
    assert shapes.without_small(np.zeros((4, 4), bool)).sum() == 0


def test_shape_properties():
    y, x = np.mgrid[:101, :101]
    round_ = shapes.shape_properties((y - 50) ** 2 + (x - 50) ** 2 <= 40**2)
    assert round_["elongation"] == pytest.approx(1, abs=0.01) and round_["solidity"] > 0.97
    assert round_["perimeter"] == pytest.approx(2 * np.pi * 40, rel=0.06)
    bar = np.zeros((101, 101), bool)
    bar[48:53, 10:90] = True
    p = shapes.shape_properties(bar)
    assert p["elongation"] == pytest.approx(80 / 5, rel=0.01) and p["eccentricity"] > 0.99 and p["solidity"] == 1
    cross = bar | bar.T
    assert shapes.shape_properties(cross)["solidity"] < 0.5
    assert shapes.shape_properties(np.zeros((3, 3), bool))["area"] == 0


def test_branches_and_ends():
    cross = np.zeros((21, 21), bool)
    cross[10, 2:19] = cross[2:19, 10] = True
    branches, ends = shapes.branch_and_end_points(cross)
    assert ends == 4 and branches >= 1
    line = np.zeros((5, 9), bool)
    line[2, 1:8] = True
    assert shapes.branch_and_end_points(line) == (0, 2)


def test_filters():
    img = np.random.default_rng(0).integers(0, 256, (20, 30)).astype(np.uint8)
    assert filters.gaussian(flat(7)[..., 0], 7, 1.5).round(6).min() == 7
    assert (filters.laplacian(flat(9)[..., 0]) == 0).all()
    assert (filters.translate(img, 3, -2)[:-2, 3:] == img[2:, :-3]).all()
    assert (filters.translate(img, 3, -2)[-2:] == 0).all()
    assert (filters.resize_area(img, 20)[:, 0] >= 0).all()
    small = filters.resize_area(np.kron(np.arange(16).reshape(4, 4), np.ones((3, 3))).astype(np.uint8), 4)
    assert (small == np.arange(16).reshape(4, 4)).all()
    assert filters.resize_area(flat(9, 8), 32).tolist() == flat(9, 32).tolist()
    assert filters.center_square(np.ones((2, 4), np.uint8)).tolist() == [[0] * 4, [1] * 4, [1] * 4, [0] * 4]


@pytest.mark.parametrize("dx,dy", [(0, 0), (5, 0), (-3, 7), (12, -9)])
def test_phase_shift(dx, dy):
    rng = np.random.default_rng(1)
    img = filters.gaussian(rng.integers(0, 256, (128, 128)), 5)
    x, y, response = filters.phase_shift(img, np.roll(img, (dy, dx), (0, 1)))
    assert abs(x - dx) < 0.5 and abs(y - dy) < 0.5 and response > 0.3


def test_features_of_a_disk():
    numbers, mask = plates.features(disk_plate())
    inside = shapes.disk(256, 256).sum()
    assert numbers["component_count"] == 1
    assert numbers["response_area_fraction"] == pytest.approx(np.pi * 60**2 / inside, rel=0.01)
    assert numbers["hue_mean"] == 60 and numbers["hue_std"] == 0
    assert numbers["response_centroid_x_norm"] == pytest.approx(0.5, abs=0.01)
    assert mask.sum() > 0


def test_features_of_nothing():
    numbers, mask = plates.features(np.zeros((256, 256, 3), np.uint8))
    assert not mask.any() and all(v == 0 for v in numbers.values())
    q = plates.quality(np.zeros((256, 256, 3), np.uint8))
    assert q["dark_clip_fraction"] == 1 and q["laplacian_variance"] == 0


def test_compare():
    a = disk_plate()
    record, pictures = plates.compare(a, a)
    assert record["response_jaccard_similarity"] == 1 and record["response_xor_fraction"] == 0 and record["reference_asymmetry_score_0_1"] == 0
    assert pictures["panel"].shape == (256, 1024, 3)
    empty = np.zeros((256, 256, 3), np.uint8)
    record, _ = plates.compare(empty, empty)
    assert record["response_jaccard_similarity"] == 0 and record["reference_asymmetry_score_0_1"] == pytest.approx(0.2)
    assert record["mean_common_response_hue_distance"] is None
    moved, _ = plates.compare(a, disk_plate(at=(128, 140)), sign=-1)
    assert moved["dx"] == pytest.approx(12, abs=0.5) and moved["response_jaccard_similarity"] > 0.95


def test_ten_plates_are_found_in_reading_order():
    img = np.full((500, 1200, 3), 255, np.uint8)
    y, x = np.mgrid[:500, :1200]
    centres = [(cx, cy) for cy in (130, 370) for cx in (120, 360, 600, 840, 1080)]
    for cx, cy in centres:
        img[(y - cy) ** 2 + (x - cx) ** 2 <= 70**2] = 30
    found = plates.find_plates(img)
    assert len(found) == 10
    rows = [sorted(found[:5]), sorted(found[5:])]
    for (cx, cy), (fx, fy, r, _) in zip(centres, rows[0] + rows[1]):
        assert abs(fx - cx) <= 3 and abs(fy - cy) <= 3 and abs(r - 70) <= 3
    assert plates.extract(np.zeros((80, 60, 3), np.uint8))[0] == "whole_image_fallback"


def test_overlaps():
    circles = [(0, 0, 10), (1, 0, 10), (30, 0, 10), (31, 0, 10), (15, 0, 10)]
    assert shapes.suppress_overlaps(circles) == [0, 2, 4]


def test_png():
    img = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    data = png.encode(img)
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    body = data[data.index(b"IDAT") + 4 : data.index(b"IEND") - 8]
    raw = zlib.decompress(body)
    assert raw[1:4] == bytes(img[0, 0, ::-1])


def test_heat_colors():
    m = color.heat_colors(np.arange(256, dtype=np.uint8))
    assert m.shape == (256, 3) and m[128, 1] > 200 and m[250, 2] > m[250, 0]


def test_every_circle_is_found():
    """Many small circles beside a large one: none is lost to a bound on the places that are tried."""
    img = np.full((700, 900), 255, np.uint8)
    yy, xx = np.mgrid[:700, :900]
    want = [(200, 350, 150)] + [(450 + 90 * i, 80 + 90 * j, 30) for i in range(5) for j in range(6)]
    for x, y, r in want:
        img[(xx - x) ** 2 + (yy - y) ** 2 <= r * r] = 40
    got = shapes.hough_circles(filters.gaussian(img, 7, 1.5), 25, 170)
    for x, y, r in want:
        assert any(abs(a - x) <= 2 and abs(b - y) <= 2 and abs(c - r) <= 2 for a, b, c in got), (x, y, r)


@pytest.mark.parametrize("noise", [5, 15, 30])
def test_circles_in_noise(noise):
    rng = np.random.default_rng(noise)
    img = np.full((300, 400), 230.0)
    yy, xx = np.mgrid[:300, :400]
    want = [(90, 100, 50), (270, 160, 60)]
    for x, y, r in want:
        img[(xx - x) ** 2 + (yy - y) ** 2 <= r * r] = 50
    img = np.clip(img + rng.normal(0, noise, img.shape), 0, 255).astype(np.uint8)
    got = shapes.hough_circles(filters.gaussian(img, 7, 1.5), 18, 144)
    for x, y, r in want:
        assert any(abs(a - x) <= 3 and abs(b - y) <= 3 and abs(c - r) <= 3 for a, b, c in got)


def test_encoder_input():
    flat = np.full((300, 500, 3), (255, 0, 0), np.uint8)  # blue
    out = filters.encoder_input(flat)
    assert out.shape == (3, 224, 224) and out.dtype == np.float32
    assert np.allclose(out[:, 0, 0], [(v - m) / s for v, m, s in zip((0, 0, 1), filters.CHANNEL_MEAN, filters.CHANNEL_SPREAD)], atol=1e-6)
    ramp = np.repeat(np.linspace(0, 255, 512).astype(np.uint8)[None, :, None], 256, 0).repeat(3, 2)
    row = filters.encoder_input(ramp)[0, 100]
    assert (np.diff(row) >= -1e-6).all() and abs(row.mean() * 0.229 + 0.485 - 0.5) < 0.01
