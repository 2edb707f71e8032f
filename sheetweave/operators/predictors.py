"""Predictors that need no model: shapes, strokes and text regions from the ink of a tile, in numpy."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

Found = list[tuple[tuple[float, float, float, float], str, float]]


def grey(image: np.ndarray) -> np.ndarray:
    return (image[:, :, :3] @ np.array([0.114, 0.587, 0.299])).round().astype(np.uint8)


def ink(image: np.ndarray) -> np.ndarray:
    """Dark pixels: those below the level that parts the histogram best (Otsu, 1979). An even tile has none."""
    g = grey(image)
    n = np.bincount(g.ravel(), minlength=256).astype(float)
    below, mass = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = np.where((below > 0) & (above > 0), below * above * (mass / below - (mass[-1] - mass) / above) ** 2, 0.0)
    return g <= int(apart.argmax()) if apart.max() > 0 else np.zeros(g.shape, bool)


def spread(mask: np.ndarray, w: int, h: int) -> np.ndarray:
    """Dilation by a w x h box."""
    out = mask
    for size, axis in ((w, 1), (h, 0)):
        shifted = [np.roll(np.pad(out, [(0, 0), (size, size)] if axis else [(size, size), (0, 0)]), d, axis) for d in range(-(size // 2), size - size // 2)]
        out = np.logical_or.reduce(shifted)
        out = out[:, size:-size] if axis else out[size:-size]
    return out


def shrink(mask: np.ndarray, w: int, h: int) -> np.ndarray:
    """Erosion by a w x h box; beyond the edge counts as set."""
    return ~spread(~mask, w, h)


def components(mask: np.ndarray) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """(x, y, w, h, pixels within that box) of each set of touching pixels, corners included.

    Runs of a row are united with those they touch in the row above, so the work follows the runs, not the pixels."""
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    parent = np.arange(len(row))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(row, np.arange(mask.shape[0] + 1))
    for r in range(1, mask.shape[0]):
        a, a_end, b, b_end = first[r - 1], first[r], first[r], first[r + 1]
        while a < a_end and b < b_end:
            if start[a] <= end[b] and start[b] <= end[a]:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
            if end[a] < end[b]:
                a += 1
            else:
                b += 1
    roots = np.array([root(i) for i in range(len(row))], np.int64)
    order = np.argsort(roots, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(roots[order])) + 1) if len(order) else []:
        x, y = int(start[part].min()), int(row[part].min())
        w, h = int(end[part].max()) - x, int(row[part].max()) - y + 1
        own = np.zeros((h, w), bool)
        for i in part:
            own[row[i] - y, start[i] - x : end[i] - x] = True
        yield x, y, w, h, own


def _filled(own: np.ndarray) -> int:
    """Pixels of a shape with its holes: all that lie between its first and last pixel of both their row and their column."""
    between = lambda m, axis: np.logical_or.accumulate(m, axis) & np.flip(np.logical_or.accumulate(np.flip(m, axis), axis), axis)
    return int((between(own, 0) & between(own, 1)).sum())


class ShapeDetector:
    """Large closed shapes as components; a shape's score grows with how much of its box it fills."""

    version = "shapes:1"

    def __call__(self, image: np.ndarray, least: float) -> Found:
        tile, out = image.shape[0] * image.shape[1], []
        closed = shrink(spread(ink(image), 9, 9), 9, 9)
        for x, y, w, h, own in components(closed):
            box = w * h
            fill = _filled(own) / box
            score = min(0.99, 0.4 + 0.5 * fill)
            if 0.004 * tile <= box <= 0.6 * tile and min(w, h) >= 24 and fill >= 0.15 and score >= least:
                out.append(((x, y, w, h), "component", score))
        return out


class StrokeDetector:
    """Thin straight strokes as line candidates, the longest first.

    A stroke is a connected piece of thin ink that stays within `width` pixels of the line through its ends."""

    version = "strokes:1"

    def __init__(self, shortest: int = 60, most: int = 150, width: float = 3.0):
        self.shortest, self.most, self.width = shortest, most, width

    def __call__(self, image: np.ndarray, least: float) -> Found:
        dark = ink(image)
        thin = dark & ~spread(shrink(dark, 5, 5), 5, 5)
        found = []
        for x, y, w, h, own in components(thin):
            if max(w, h) < self.shortest:
                continue
            ys, xs = np.nonzero(own)
            axis = xs if w >= h else ys
            i, j = int(axis.argmin()), int(axis.argmax())
            dx, dy = float(xs[j] - xs[i]), float(ys[j] - ys[i])
            n = math.hypot(dx, dy)
            if n >= self.shortest and np.abs(dx * (ys - ys[i]) - dy * (xs - xs[i])).max() / n <= self.width:
                found.append((n, (float(x + xs[i]), float(y + ys[i]), float(x + xs[j]), float(y + ys[j]))))
        diagonal = math.hypot(*image.shape[:2])
        scored = [(points, "line_candidate", round(min(0.95, 0.3 + n / diagonal), 3)) for n, points in sorted(found, key=lambda f: -f[0])[: self.most]]
        return [f for f in scored if f[2] >= least]


#: A line of text: how high and how dense it may be, its width in heights (fixed values); how far apart its letters may stand.
LINE_HIGH, LINE_DENSE, LINE_WIDE = (6, 90), (0.08, 0.7), 25
LETTER_GAP = 9


def text_regions(image: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes that can hold a line of text. Letters are pieces of ink no larger than a line is high; from left to right each joins
    the line that ends next to it and shares half of the lower one's height, or begins one. Boxes have a margin of 4 and 1."""
    dark, lines = ink(image), []
    for x, y, w, h in sorted(c[:4] for c in components(dark) if max(c[2:4]) <= LINE_HIGH[1]):
        beside = [n for n in lines if x - n[2] <= LETTER_GAP and 2 * (min(y + h, n[3]) - max(y, n[1])) >= min(h, n[3] - n[1])]
        line = max(beside, key=lambda n: n[2], default=None)
        if line is None:
            lines.append([x, y, x + w, y + h])
        else:
            line[:] = line[0], min(line[1], y), max(line[2], x + w), max(line[3], y + h)
    out = []
    for x, y, x2, y2 in lines:
        x, y, x2, y2 = max(0, x - 4), max(0, y - 1), min(dark.shape[1], x2 + 4), min(dark.shape[0], y2 + 1)
        if LINE_HIGH[0] <= y2 - y <= LINE_HIGH[1] and LINE_HIGH[0] <= x2 - x <= LINE_WIDE * (y2 - y) and LINE_DENSE[0] <= dark[y:y2, x:x2].mean() <= LINE_DENSE[1]:
            out.append((x, y, x2 - x, y2 - y))
    return out


class RegionReader:
    """Texts from a reader of crops (images, in groups of `group`) -> texts; regions are padded by 3 pixels. Readings without
    a letter or digit go. Crops carry no confidence of their own, so each reading has `prior`."""

    def __init__(self, read, version: str, prior: float = 0.9, group: int = 8):
        self.read, self.version, self.prior, self.group = read, version, prior, group

    def __call__(self, image: np.ndarray, least: float) -> Found:
        regions = text_regions(image) if self.prior >= least else []
        out = []
        for i in range(0, len(regions), self.group):
            part = regions[i : i + self.group]
            texts = self.read([image[max(0, y - 3) : y + h + 3, max(0, x - 3) : x + w + 3] for x, y, w, h in part])
            out += [(box, t.strip(), self.prior) for box, t in zip(part, texts) if any(c.isalnum() for c in t)]
        return out


class NoReader:
    """Reads nothing: the choice where no reader is at hand."""

    version = "none"

    def __call__(self, image: np.ndarray, least: float) -> Found:
        return []
