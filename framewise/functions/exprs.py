"""Column expressions shared by the operators. All are built-in functions, so they stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi
#: Spellings of a rotation direction.
DIRECTION_NAMES = {"cw": "CW", "clockwise": "CW", "ccw": "CCW", "counterclockwise": "CCW", "anticlockwise": "CCW"}
#: Spellings of true.
TRUE_WORDS = ("true", "1", "1.0", "y", "yes")


def finite(x: Column) -> Column:
    """NaN and infinities as null; comparisons and aggregates would otherwise treat NaN as the largest value."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def wrap_rad(x: Column) -> Column:
    """An angle in [-pi, pi)."""
    return F.pmod(x + F.lit(math.pi), F.lit(TWO_PI)) - F.lit(math.pi)


def turn(delta: Column) -> Column:
    """An angle difference in (-pi, pi]."""
    return F.atan2(F.sin(delta), F.cos(delta))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.when(b != 0, b)


def mean_known(*xs: Column) -> Column:
    """Mean of the values that aren't null; null if none is known."""
    n = sum((F.when(x.isNotNull(), 1).otherwise(0) for x in xs), F.lit(0))
    total = sum((F.coalesce(x, F.lit(0.0)) for x in xs), F.lit(0.0))
    return total / F.when(n > 0, n)


def positive(x: Column) -> Column:
    return F.when(x > 0, x)


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0))))


def same_sign(*xs: Column) -> Column:
    """All signs equal and none zero; null counts as no."""
    first = F.signum(xs[0])
    told = first != 0
    for x in xs[1:]:
        told = told & (F.signum(x) == first)
    return F.coalesce(told, F.lit(False))


def overlap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Frames shared by two inclusive intervals."""
    return F.greatest(F.lit(0), F.least(a2, b2) - F.greatest(a1, b1) + 1)


def span_iou(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """IoU of inclusive intervals."""
    shared = overlap(a1, a2, b1, b2)
    return shared / (a2 - a1 + b2 - b1 + 2 - shared)


def temporal_iou(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """IoU of half-open intervals; 0 for an empty union."""
    shared = F.greatest(F.lit(0), F.least(a2, b2) - F.greatest(a1, b1))
    return F.coalesce(ratio(shared, F.greatest(a2, b2) - F.least(a1, b1)), F.lit(0.0))


def inside_polygon(x: Column, y: Column, vertices: list[tuple[float, float]]) -> Column:
    """Even-odd rule over literal vertices. A point on an edge whose half-open height range [low, high) it is in
    counts as crossed only if the edge lies strictly to its right."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(vertices, vertices[1:] + vertices[:1], strict=True):
        if y1 == y2:
            continue
        spans = (y >= F.lit(float(min(y1, y2)))) & (y < F.lit(float(max(y1, y2))))
        at = F.lit(float(x1)) + (y - F.lit(float(y1))) * F.lit((x2 - x1) / (y2 - y1))
        crossings = crossings + F.when(spans & (x < at), 1).otherwise(0)
    return (crossings % 2) == 1


def segment_crossing(h1: tuple, h2: tuple, t1: tuple, t2: tuple, tolerance: float = 1e-9) -> tuple[Column, Column]:
    """Where the segments h1-h2 and t1-t2 cross, as (x, y); null if a point is missing, a segment has no length,
    they are parallel up to ``tolerance``, or they don't meet. Ends count as met."""
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = ((finite(x), finite(y)) for x, y in (h1, h2, t1, t2))
    ux, uy, vx, vy, wx, wy = bx - ax, by - ay, dx - cx, dy - cy, cx - ax, cy - ay
    area = ux * vy - uy * vx
    scale = F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy)
    sound = F.when((scale > 0) & (F.abs(area) > F.lit(tolerance) * scale), area)
    p, q = (wx * vy - wy * vx) / sound, (wx * uy - wy * ux) / sound
    meets = p.between(-tolerance, 1 + tolerance) & q.between(-tolerance, 1 + tolerance)
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))
    return F.when(meets, ax + part * ux), F.when(meets, ay + part * uy)


def hms(seconds: Column) -> Column:
    """Whole seconds as HH:MM:SS."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)


def stamp(frame: Column, fps: float = 30.0) -> Column:
    """The time of a frame as HH:MM:SS.mmm; halves of a millisecond round to even."""
    ms = F.bround(frame.cast("double") / F.lit(fps) * 1000).cast("long")
    return F.format_string("%s.%03d", hms(F.floor(ms / 1000)), ms % 1000)


def buffered(start: Column, end: Column, buffer: Column, count: Column) -> Column:
    """(start, end) of a span with ``buffer`` frames more on both sides, clipped to the video; raises if the span isn't
    inside it or the buffer is negative."""
    sound = (start >= 0) & (start <= end) & (end < count) & (buffer >= 0)
    low = F.when(sound, F.greatest(F.lit(0).cast("long"), start - buffer)).otherwise(F.raise_error(F.lit("invalid span or buffer")).cast("long"))
    return F.struct(low.alias("start"), F.least(count - 1, end + buffer).alias("end"))


def seconds_of(text: Column) -> Column:
    """h:m:s, m:s or s, with a fraction, as seconds."""
    parts = F.reverse(F.split(F.trim(text), ":"))
    return F.aggregate(F.transform(parts, lambda p, k: p.cast("double") * F.pow(F.lit(60.0), k)), F.lit(0.0), lambda a, b: a + b)


def letters_only(text: Column) -> Column:
    """Header form: small letters only."""
    return F.regexp_replace(F.lower(text), "[^a-z]", "")


def direction(text: Column) -> Column:
    """CW, CCW or null."""
    names = F.create_map(*[F.lit(x) for pair in DIRECTION_NAMES.items() for x in pair])
    return names[letters_only(text)]


def truth(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def leading_digits(text: Column) -> Column:
    return F.regexp_extract(text, r"^\d+", 0)


def whole_frame(x: Column) -> Column:
    """A frame number as bigint; raises if it isn't a whole number of at least 0. Null stays null."""
    value = x.cast("double")
    wrong = value.isNull() | (value != F.floor(value)) | (value < 0)
    return F.when(x.isNull(), F.lit(None).cast("long")).when(wrong, F.raise_error(F.concat(F.lit("not a frame number: "), x.cast("string"))).cast("long")).otherwise(value.cast("long"))
