"""NumPy kernels on one image (gray or RGB arrays), for Arrow functions on the executors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

Box = tuple[int, int, int, int]
TRANSFORMS = {"none": lambda a: a, "h": np.fliplr, "v": np.flipud, "rot180": lambda a: np.rot90(a, 2), "rot90": np.rot90, "rot270": lambda a: np.rot90(a, 3)}


def gray(image: np.ndarray) -> np.ndarray:
    """Luma of an RGB image (ITU-R 601, 16-bit weights), as uint8."""
    if image.ndim == 2:
        return image
    r, g, b = (image[..., k].astype(np.uint32) for k in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16).astype(np.uint8)


def content_box(image: np.ndarray, threshold: int = 248) -> Box | None:
    ys, xs = np.nonzero(image < threshold)
    return (int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1) if len(xs) else None


@dataclass(frozen=True)
class Cut:
    """How a mask is cut into stretches along its first axis, of n places with m across.

    mean: places of the moving mean, (at least, n over); over: threshold, (at least, share of m); gap: what is
    bridged, (at least, n over); length: (at least, n times, over).
    """

    mean: tuple[int, int]
    over: tuple[float, float]
    gap: tuple[int, int]
    length: tuple[int, float, float]


# The cuts, by what they find.
NEVER = 1 << 30
PANEL_ROWS = Cut((9, 80), (20, 0.028), (8, 80), (40, 1, 22))
PANEL_COLUMNS = Cut((9, 120), (10, 0.12), (10, 90), (65, 1, 16))
BLOT_ROWS = Cut((5, NEVER), (30, 0.35), (10, NEVER), (35, 0.25, 1))
BLOT_COLUMNS = Cut((5, NEVER), (25, 0.45), (10, NEVER), (55, 0.35, 1))
LINES = Cut((1, NEVER), (12, 0.62), (1, NEVER), (2, 0, 1))
LANES = Cut((5, NEVER), (2, 0.08), (2, NEVER), (3, 0, 1))


def moving_sum(values: np.ndarray, w: int) -> np.ndarray:
    """Sums over w places around each, nothing beyond the ends; an even w reaches one further back."""
    total, at = np.concatenate([[0], np.cumsum(values)]), np.arange(len(values))
    return total[np.minimum(len(values), at + (w + 1) // 2)] - total[np.maximum(0, at - w // 2)]


def stretches(mask: np.ndarray, cut: Cut) -> list[tuple[int, int]]:
    """Where the mask is dense along its first axis."""
    n, m = mask.shape
    w = max(cut.mean[0], n // cut.mean[1])
    return islands(moving_sum(mask.sum(1), w), w * max(cut.over[0], m * cut.over[1]), max(cut.gap[0], n // cut.gap[1]), max(cut.length[0], int(n * cut.length[1] / cut.length[2])))


def fields(mask: np.ndarray, rows: Cut, columns: Cut, longest: bool = False) -> Iterator[Box]:
    """The dense fields of a mask: stretches of rows, cut into stretches of columns; longest: only the first longest of each."""
    only = lambda spans: [max(spans, key=lambda s: s[1] - s[0])] if longest and spans else spans
    for top, bottom in only(stretches(mask, rows)):
        for left, right in only(stretches(mask[top:bottom].T, columns)):
            yield left, top, right, bottom


def padded(b: Box, x: int, y: int, shape: tuple[int, ...]) -> Box:
    """Grown by x and y on both sides, within the image."""
    return max(0, b[0] - x), max(0, b[1] - y), min(shape[1], b[2] + x), min(shape[0], b[3] + y)


def islands(values: np.ndarray, threshold: float, merge_gap: int, min_length: int) -> list[tuple[int, int]]:
    edges = np.diff(np.concatenate([[0], (values > threshold).astype(np.int8), [0]]))
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(begins):
        return []
    apart = begins[1:] - ends[:-1] > merge_gap
    spans = zip(begins[np.concatenate([[True], apart])], ends[np.concatenate([apart, [True]])])
    return [(int(a), int(b)) for a, b in spans if b - a >= min_length]


def top_left(b: Box) -> tuple[int, int]:
    return b[1], b[0]


def big_enough(b: Box) -> bool:
    w, h = b[2] - b[0], b[3] - b[1]
    return w >= 80 and h >= 70 and w * h >= 9000


def panels_by_projection(image: np.ndarray) -> list[Box]:
    found = (padded(b, 6, 6, image.shape) for b in fields(image < 247, PANEL_ROWS, PANEL_COLUMNS))
    return sorted(filter(big_enough, found), key=top_left)


def components(mask: np.ndarray, least: int) -> list[tuple[tuple[int, int, int, int], int]]:
    """Box and pixel count of 4-connected components of `least` pixels or more, in scan order: runs of rows, united where they overlap."""
    runs: list[tuple[int, int, int]] = []
    parent: list[int] = []

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    above: list[int] = []
    for y, row in enumerate(mask):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        here, at = [], 0
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            k = len(runs)
            runs.append((y, a, b))
            parent.append(k)
            here.append(k)
            while at < len(above) and runs[above[at]][2] <= a:
                at += 1
            j = at
            while j < len(above) and runs[above[j]][1] < b:
                p, q = find(k), find(above[j])
                parent[max(p, q)] = min(p, q)
                j += 1
        above = here
    boxes: dict[int, list[int]] = {}
    for k, (y, a, b) in enumerate(runs):
        o = boxes.setdefault(find(k), [a, y, b, y + 1, 0])
        o[:] = [min(o[0], a), o[1], max(o[2], b), y + 1, o[4] + b - a]
    return [((x0, y0, x1, y1), n) for x0, y0, x1, y1, n in boxes.values() if n >= least]


def dilate(mask: np.ndarray, size: int) -> np.ndarray:
    """Maximum over a size x size square, separably, by prefix sums."""
    out = mask
    for axis in (0, 1):
        sums = np.cumsum(np.insert(out.astype(np.int32), 0, 0, axis), axis)
        n = out.shape[axis]
        low, high = np.clip(np.arange(n) - size // 2, 0, n), np.clip(np.arange(n) + size // 2 + 1, 0, n)
        out = np.take(sums, high, axis) > np.take(sums, low, axis)
    return out


def merge_boxes(boxes: list[Box], pad: int = 8) -> list[Box]:
    """Boxes that overlap or touch within the pad become one, until none do."""
    out: list[Box] = []
    for b in boxes:
        while hit := next((o for o in out if o[0] <= b[2] + pad and b[0] <= o[2] + pad and o[1] <= b[3] + pad and b[1] <= o[3] + pad), None):
            out.remove(hit)
            b = (min(b[0], hit[0]), min(b[1], hit[1]), max(b[2], hit[2]), max(b[3], hit[3]))
        out.append(b)
    return sorted(out, key=top_left)


def panels_by_components(image: np.ndarray) -> list[Box]:
    grown = (padded(b, 10, 10, image.shape) for b, _ in components(dilate(image < 247, 31), 500))
    return merge_boxes([b for b in grown if big_enough(b)])


def reading_order(boxes: list[Box]) -> list[Box]:
    """Row by row, each from left to right. A box joins the first row whose mean centre is nearer than 35 or 0.45 of the row's tallest box."""
    rows: list[list[Box]] = []
    middle = lambda b: (b[1] + b[3]) / 2
    for b in sorted(boxes, key=top_left):
        fits = (r for r in rows if abs(middle(b) - sum(map(middle, r)) / len(r)) < max(35, 0.45 * max(x[3] - x[1] for x in r)))
        if (row := next(fits, None)) is None:
            rows.append(row := [])
        row.append(b)
    return [b for r in rows for b in sorted(r, key=lambda b: b[0])]


def panels(image: np.ndarray, most: int = 26) -> list[Box]:
    """Panels of a figure in reading order, by projection, or by components where that finds fewer than two."""
    found = panels_by_projection(image)
    return reading_order(found if len(found) >= 2 else panels_by_components(image))[:most]


def blot_region(image: np.ndarray) -> Box | None:
    """The field of midtones that a blot is, if it is wide and high enough."""
    h, w = image.shape
    found = next(fields((image >= 170) & (image <= 248), BLOT_ROWS, BLOT_COLUMNS, longest=True), None)
    return found if found and found[2] - found[0] >= 0.35 * w and found[3] - found[1] >= 0.25 * h else None


def blot_rows(image: np.ndarray, region: Box | None = None) -> list[float]:
    """Row centres of a blot, each 12 or more from the last kept one."""
    region = region or blot_region(image)
    out: list[float] = []
    if region:
        x0, y0, x1, y1 = region
        for center in (y0 + (a + b) / 2 for a, b in stretches(image[y0:y1, x0:x1] < 235, LINES)):
            if not out or center >= out[-1] + 12:
                out.append(center)
    return out


def panel_features(rgb: np.ndarray) -> tuple[str, float, float]:
    """Category, colourfulness (mean spread over channels) and the share of rows with wide dark bands."""
    g = gray(rgb)
    color = 0.0
    if rgb.ndim == 3:
        x = rgb.astype(float)
        color = float(np.sqrt(np.maximum(0, (x * x).mean(2) - x.mean(2) ** 2)).mean())
    dark = np.count_nonzero(g < 230, axis=1)
    blot = min(g.shape) > 90 and blot_region(g) is not None
    return "blot" if blot else "other", color, float(np.mean(dark > max(18, 0.22 * g.shape[1])))


# Kinds of strip candidates - least spread and share of dark pixels (under 190), what that share adds to the rank, whether size counts.
STRIPS = {"window": (5.0, 0.015, 0.0, False), "band": (6.0, 0.035, 20.0, True), "lane": (5.0, 0.025, 22.0, True)}


def windows(region: Box, shape: tuple[int, ...]) -> Iterator[Box]:
    """Windows over the whole width of a blot, sliding down."""
    x0, y0, x1, y1 = region
    size = int(np.clip(int((y1 - y0) / 7), 14, 30))
    for top in range(y0, max(y0 + 1, y1 - size + 1), max(5, size // 3)):
        yield padded((x0, top, x1, min(y1, top + size)), 2, 1, shape)


def bands(image: np.ndarray, region: Box) -> Iterator[Box]:
    """Dark components of the size of a band."""
    x0, y0, x1, y1 = region
    for (a, b, c, d), n in components(dilate(image[y0:y1, x0:x1] < 205, 3), 5):
        if 4 <= c - a <= 0.38 * (x1 - x0) and 2 <= d - b <= 22 and n <= 500:
            yield padded((x0 + a, y0 + b, x0 + c, y0 + d), 7, 5, image.shape)


def lanes(image: np.ndarray, region: Box, centers: list[float], min_width: int, min_height: int) -> Iterator[Box]:
    """Boxes around the lanes of each row, where a row has dark columns away from its ends."""
    x0, y0, x1, y1 = region
    reach = int(np.clip(int((y1 - y0) / 16), 9, 15))
    for center in centers:
        top, bottom = max(y0, round(center - reach)), min(y1, round(center + reach))
        if bottom - top < min_height:
            continue
        mask = image[top:bottom, x0:x1] < 205
        mask = mask & (np.count_nonzero(mask, axis=1) <= max(12, 0.58 * mask.shape[1]))[:, None]
        for a, b in stretches(mask.T, LANES):
            if a > 5 and b < x1 - x0 - 5:
                width, middle, at = max(min_width, min(36, b - a + 14)), x0 + (a + b) // 2, round(center)
                yield max(0, middle - width // 2), max(0, at - min_height // 2 - 3), min(image.shape[1], middle + (width + 1) // 2), min(image.shape[0], at + min_height // 2 + 4)


def strip_candidates(image: np.ndarray, min_width: int = 18, min_height: int = 12) -> Iterator[tuple[str, Box, float, float]]:
    """Kind, box, spread and share of dark pixels of everything that may be a strip of a blot."""
    if not (region := blot_region(image)):
        return
    found = {"window": windows(region, image.shape), "band": bands(image, region), "lane": lanes(image, region, blot_rows(image, region), min_width, min_height)}
    for kind, boxes in found.items():
        for b in boxes:
            crop = image[b[1] : b[3], b[0] : b[2]]
            yield kind, b, float(crop.std()), float((crop < 190).mean())


def autocontrast(image: np.ndarray, cutoff: float = 1.0) -> np.ndarray:
    """Stretched so that after cutting off a percentage at both ends the darkest is 0 and the lightest 255."""
    counts = np.bincount(image.reshape(-1), minlength=256)
    cut = int(image.size * cutoff // 100)
    low = int(np.searchsorted(np.cumsum(counts), cut, side="right"))
    high = 255 - int(np.searchsorted(np.cumsum(counts[::-1]), cut, side="right"))
    if high <= low:
        return image
    return np.clip((np.arange(256) - low) * (255.0 / (high - low)), 0, 255).astype(np.uint8)[image]


def resize(image: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Bicubic (a = -0.5), with the kernel widened when shrinking; size: width, height."""
    out = image.astype(float)
    for axis, n in ((1, size[0]), (0, size[1])):
        m = out.shape[axis]
        scale = m / n
        wide = max(1.0, scale)
        centers = (np.arange(n) + 0.5) * scale
        x = np.abs((np.arange(m)[None, :] + 0.5 - centers[:, None]) / wide)
        k = np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0))
        out = np.moveaxis(np.tensordot(k / k.sum(1, keepdims=True), out, (1, axis)), 0, axis)
        out = np.clip(np.floor(out + 0.5), 0, 255)
    return out


def standardized(image: np.ndarray) -> np.ndarray:
    out = image.astype(float) - image.mean()
    s = out.std()
    return out if s < 1e-6 else out / s


def descriptor(image: np.ndarray, size: tuple[int, int], transform: str = "none", pad: int | None = 2) -> np.ndarray:
    """The comparable form of a crop: trimmed to its content (pad None: not), turned, stretched, resized, standardised."""
    g = gray(image)
    if pad is not None and (b := content_box(g)):
        g = g[max(0, b[1] - pad) : b[3] + pad, max(0, b[0] - pad) : b[2] + pad]
    return standardized(resize(autocontrast(np.ascontiguousarray(TRANSFORMS[transform](g))), size))


def ncc(a: np.ndarray, b: np.ndarray) -> float:
    if a.shape != b.shape:
        raise ValueError("the arrays must have the same shape")
    norm = float(np.sqrt((a * a).sum() * (b * b).sum()))
    return 0.0 if norm < 1e-9 else float((a * b).sum() / norm)


def best_orientation(a: np.ndarray, turned: dict[str, np.ndarray]) -> tuple[float, str]:
    """The best score over orientations of b, the first on ties."""
    scores = {k: ncc(a, v) for k, v in turned.items()}
    name = max(scores, key=scores.get)
    return scores[name], name
