"""Scalar geometry as Column expressions. Boxes are (x, y, w, h), segments (x1, y1, x2, y2), all tuples of Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9
Quad = tuple[Column, Column, Column, Column]


def quad(prefix: str = "g") -> Quad:
    """The four columns <prefix>0 .. <prefix>3."""
    return tuple(F.col(f"{prefix}{i}") for i in range(4))


def corners(b: Quad) -> Quad:
    return b[0], b[1], b[0] + b[2], b[1] + b[3]


def from_corners(c: Quad) -> Quad:
    return c[0], c[1], c[2] - c[0], c[3] - c[1]


def area(b: Quad) -> Column:
    return F.greatest(F.lit(0.0), b[2]) * F.greatest(F.lit(0.0), b[3])


def overlaps(a: Quad, b: Quad) -> Column:
    """Strict overlap; boxes that only touch do not overlap."""
    ax, ay, ax2, ay2 = corners(a)
    bx, by, bx2, by2 = corners(b)
    return (F.least(ax2, bx2) > F.greatest(ax, bx)) & (F.least(ay2, by2) > F.greatest(ay, by))


def intersection(a: Quad, b: Quad) -> Quad:
    """The shared box; meaningful only where overlaps(a, b)."""
    ax, ay, ax2, ay2 = corners(a)
    bx, by, bx2, by2 = corners(b)
    return from_corners((F.greatest(ax, bx), F.greatest(ay, by), F.least(ax2, bx2), F.least(ay2, by2)))


def iou(a: Quad, b: Quad) -> Column:
    shared = F.when(overlaps(a, b), area(intersection(a, b))).otherwise(F.lit(0.0))
    return shared / (area(a) + area(b) - shared + F.lit(EPS))


def segment_box(s: Quad) -> Quad:
    return from_corners((F.least(s[0], s[2]), F.least(s[1], s[3]), F.greatest(s[0], s[2]), F.greatest(s[1], s[3])))


def distance(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def length(s: Quad) -> Column:
    return distance(s[2] - s[0], s[3] - s[1])


def angle(s: Quad) -> Column:
    """Undirected angle in degrees, 0 to 180."""
    return F.pmod(F.degrees(F.atan2(s[3] - s[1], s[2] - s[0])), F.lit(180.0))


def angle_difference(a: Column, b: Column) -> Column:
    d = F.abs(a - b) % 180.0
    return F.least(d, 180.0 - d)


def line_distance(px: Column, py: Column, s: Quad) -> Column:
    """Distance to the infinite line through s, by the cross product from its start; to that start where s has no length."""
    qx, qy, n = px - s[0], py - s[1], length(s)
    return F.when(n < EPS, distance(qx, qy)).otherwise(F.abs((s[2] - s[0]) * qy - (s[3] - s[1]) * qx) / n)


def nearest_share(px: Column, py: Column, s: Quad) -> Column:
    """Where on a segment the point nearest to (px, py) lies, as a share of its length."""
    dx, dy = s[2] - s[0], s[3] - s[1]
    squared = dx * dx + dy * dy
    return F.when(squared < EPS, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - s[0]) * dx + (py - s[1]) * dy) / squared)))


def share_distance(px: Column, py: Column, s: Quad, t: Column) -> Column:
    """Distance to the point at a share of a segment's length."""
    dx, dy = s[2] - s[0], s[3] - s[1]
    return distance(px - (s[0] + t * dx), py - (s[1] + t * dy))


def point_segment_distance(px: Column, py: Column, s: Quad) -> Column:
    return share_distance(px, py, s, nearest_share(px, py, s))


def end_points(a: Quad, b: Quad) -> list[tuple[Column, Column, Quad]]:
    """Each end of two segments, with the other segment."""
    return [(a[0], a[1], b), (a[2], a[3], b), (b[0], b[1], a), (b[2], b[3], a)]


def segment_gap(a: Quad, b: Quad) -> Column:
    """Least distance of an endpoint of one segment to the other; segments that cross without an endpoint near do not count as 0."""
    return F.least(*[point_segment_distance(*e) for e in end_points(a, b)])


def clip_range(s: Quad, rect: Quad) -> tuple[Column, Column, Column]:
    """(is anything left, from, to): where a segment enters and leaves a box, edges included, as shares of its length."""
    x0, y0, x3, y3 = corners(rect)
    dx, dy = s[2] - s[0], s[3] - s[1]

    def bounds(start: Column, d: Column, lo: Column, hi: Column) -> tuple[Column, Column, Column]:
        flat = F.abs(d) < 1e-12
        a, b = (lo - start) / d, (hi - start) / d
        inside = ~flat | ((start >= lo) & (start <= hi))
        return F.when(flat, F.lit(0.0)).otherwise(F.least(a, b)), F.when(flat, F.lit(1.0)).otherwise(F.greatest(a, b)), inside

    ax, bx, okx = bounds(s[0], dx, x0, x3)
    ay, by, oky = bounds(s[1], dy, y0, y3)
    t0, t1 = F.greatest(F.lit(0.0), ax, ay), F.least(F.lit(1.0), bx, by)
    return okx & oky & (t0 <= t1), t0, t1


def stretch(s: Quad, t0: Column, t1: Column) -> Quad:
    """The part of a segment between two shares of its length."""
    dx, dy = s[2] - s[0], s[3] - s[1]
    return s[0] + t0 * dx, s[1] + t0 * dy, s[0] + t1 * dx, s[1] + t1 * dy


def clip(s: Quad, rect: Quad) -> tuple[Column, Quad]:
    """(is anything left, the part of a segment within a box, edges included)."""
    ok, t0, t1 = clip_range(s, rect)
    return ok, stretch(s, t0, t1)


def segment_to_box(s: Quad, pad: float = 4.0) -> Quad:
    b = segment_box(s)
    return b[0] - pad, b[1] - pad, b[2] + 2 * pad, b[3] + 2 * pad


def box_to_segment(b: Quad, pad: float = 4.0, up: Column | None = None) -> Quad:
    """The line a padded box stands for: level or upright where one side is three times the other, else a diagonal."""
    x, y, w, h = b
    cx, cy = x + w / 2, y + h / 2
    thin_x, thin_y = w < 2 * pad, h < 2 * pad
    x1, x2 = F.when(thin_x, cx).otherwise(x + pad), F.when(thin_x, cx).otherwise(x + w - pad)
    y1, y2 = F.when(thin_y, cy).otherwise(y + pad), F.when(thin_y, cy).otherwise(y + h - pad)
    level, upright, up = w >= 3 * h, h >= 3 * w, F.lit(False) if up is None else up
    pick = lambda a, b_, c, d: F.when(level, a).when(upright, b_).when(up, c).otherwise(d)
    return pick(x1, cx, x1, x1), pick(cy, y1, y2, y1), pick(x2, cx, x2, x2), pick(cy, y2, y1, y2)


def to_canvas(x: Column, y: Column, t) -> tuple[Column, Column]:
    """A point of the original page on the canvas. t: Column struct or names -> Column with orig_h, rotated, scale, pad_x, pad_y."""
    px, py = F.when(t["rotated"], t["orig_h"] - 1 - y).otherwise(x), F.when(t["rotated"], x).otherwise(y)
    return px * t["scale"] + t["pad_x"], py * t["scale"] + t["pad_y"]


def to_original(x: Column, y: Column, t) -> tuple[Column, Column]:
    px, py = (x - t["pad_x"]) / t["scale"], (y - t["pad_y"]) / t["scale"]
    return F.when(t["rotated"], py).otherwise(px), F.when(t["rotated"], t["orig_h"] - 1 - px).otherwise(py)


def moved_box(b: Quad, t, move) -> Quad:
    """A box through to_canvas or to_original: the box around its moved corners."""
    x1, y1, x2, y2 = corners(b)
    p, q = move(x1, y1, t), move(x2, y2, t)
    return from_corners((F.least(p[0], q[0]), F.least(p[1], q[1]), F.greatest(p[0], q[0]), F.greatest(p[1], q[1])))
