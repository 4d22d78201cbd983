"""Box, line, polygon and direction expressions. All are Column -> Column and stay in generated code where they can."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9
#: Sectors of 45 degrees, counter-clockwise from the right; image y grows downwards.
DIRECTIONS = ("RIGHT", "UP_RIGHT", "UP", "UP_LEFT", "LEFT", "DOWN_LEFT", "DOWN", "DOWN_RIGHT")
RIDER_VEHICLES = ("bicycle", "motorcycle")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    """The four corner columns x1, y1, x2, y2 with a prefix."""
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def bbox_center(b) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def to_pixels(x: Column, y: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Normalised coordinates to pixels of a frame."""
    return x * (width - 1), y * (height - 1)


def distance(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def bbox_area_normalized(b, width: Column, height: Column) -> Column:
    return F.try_divide((b[2] - b[0]) * (b[3] - b[1]), (width * height).cast("double"))


def size_bin(area: Column) -> Column:
    """SMALL below 0.01, MEDIUM below 0.09, else LARGE, of the frame's area."""
    return F.when(area < 0.01, "SMALL_LT_0.01").when(area < 0.09, "MEDIUM_0.01_TO_LT_0.09").otherwise("LARGE_GE_0.09")


def bbox_gap(p, q) -> Column:
    """Euclidean gap between two boxes in pixels, 0 where they meet."""
    return distance(F.greatest(p[0] - q[2], q[0] - p[2], F.lit(0.0)), F.greatest(p[1] - q[3], q[1] - p[3], F.lit(0.0)))


def _overlap(p, q) -> Column:
    return F.greatest(F.lit(0.0), F.least(p[2], q[2]) - F.greatest(p[0], q[0])) * F.greatest(F.lit(0.0), F.least(p[3], q[3]) - F.greatest(p[1], q[1]))


def _area(b) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def overlap_smaller(p, q) -> Column:
    """Intersection by the smaller box's area; 0 if that has none."""
    smaller = F.least(_area(p), _area(q))
    return F.when(smaller > 0, F.try_divide(_overlap(p, q), smaller)).otherwise(0.0)


def box_iou(p, q) -> Column:
    common = _overlap(p, q)
    return F.coalesce(F.try_divide(common, _area(p) + _area(q) - common), F.lit(0.0))


def rider_overlap(person, vehicle, vehicle_class: Column, ratio: Column) -> Column:
    """A person who probably rides the two-wheeler: enough overlap, or feet inside its box."""
    foot_x, foot_y = (person[0] + person[2]) / 2, person[3]
    standing = foot_x.between(vehicle[0], vehicle[2]) & foot_y.between(vehicle[1], vehicle[3])
    return vehicle_class.isin(*RIDER_VEHICLES) & ((overlap_smaller(person, vehicle) >= ratio) | standing)


def cross_product(o, e, p) -> Column:
    return (e[0] - o[0]) * (p[1] - o[1]) - (e[1] - o[1]) * (p[0] - o[0])


def crossing_side(previous, current, start, end) -> Column:
    """A_TO_B, B_TO_A, or null when the two points aren't strictly on different sides."""
    before, now = cross_product(start, end, previous), cross_product(start, end, current)
    return F.when((before > EPSILON) & (now < -EPSILON), "A_TO_B").when((before < -EPSILON) & (now > EPSILON), "B_TO_A")


def segments_intersect(a, b, c, d) -> Column:
    """Finite segments a-b and c-d meet; segments on one line don't."""
    first, second = (cross_product(a, b, c), cross_product(a, b, d)), (cross_product(c, d, a), cross_product(c, d, b))
    straight = F.greatest(*[F.abs(x) for x in (*first, *second)]) <= EPSILON
    return (first[0] * first[1] <= EPSILON) & (second[0] * second[1] <= EPSILON) & ~straight


def point_in_polygon(x: Column, y: Column, points: Column) -> Column:
    """Inside a polygon or on its edge. ``points`` is an array of (x, y) structs.

    Vertices and point are taken in single precision. The bounding box is tested first;
    an edge is crossed if exactly one end is above the point, to its right.
    """
    single = lambda c: c.cast("float").cast("double")
    px, py = single(x), single(y)
    following = F.concat(F.slice(points, 2, F.size(points) - 1), F.slice(points, 1, 1))

    def edge(a: Column, b: Column) -> Column:
        ax, ay, bx, by = single(a["x"]), single(a["y"]), single(b["x"]), single(b["y"])
        turn = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
        on = (turn == 0) & px.between(F.least(ax, bx), F.greatest(ax, bx)) & py.between(F.least(ay, by), F.greatest(ay, by))
        hit = ((ay > py) != (by > py)) & (px < F.coalesce(F.try_divide((bx - ax) * (py - ay), by - ay), F.lit(0.0)) + ax)
        return F.when(on, 1 << 20).when(hit, 1).otherwise(0)

    total = F.aggregate(F.zip_with(points, following, edge), F.lit(0), lambda a, v: a + v)
    return (total >= (1 << 20)) | (total % 2 == 1)


def direction8(dx: Column, dy: Column, minimum: float) -> Column:
    """STATIONARY below the minimum displacement, else the nearest of eight directions."""
    sector = F.pmod(F.rint(F.degrees(F.atan2(-dy, dx)) / 45.0).cast("int"), F.lit(8))
    return F.when(distance(dx, dy) < minimum, "STATIONARY").otherwise(F.element_at(F.array(*map(F.lit, DIRECTIONS)), sector + 1))


def hamming64(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit fingerprints."""
    return F.bit_count(a.bitwiseXOR(b))


def hex64(c: Column) -> Column:
    """16 hexadecimal digits to a signed 64-bit number, from two halves."""
    half = lambda start: F.conv(F.substring(c, start, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def in_ranges(frame: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether a frame is in any of a few inclusive ranges."""
    out = F.lit(False)
    for lo, hi in ranges:
        out = out | frame.between(lo, hi)
    return out
