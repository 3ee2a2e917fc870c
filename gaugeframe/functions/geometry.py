"""Box algebra.  A box is a struct<x, y, w, h> of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def rect(b: Column) -> tuple[Column, Column, Column, Column]:
    return b.x, b.y, b.x + b.w, b.y + b.h


def touch(a, b) -> Column:
    """Whether two rectangles meet; edges count."""
    return (a[2] >= b[0]) & (b[2] >= a[0]) & (a[3] >= b[1]) & (b[3] >= a[1])


def inflate(b: Column, ratio: float):
    """The rectangle grown along its reading axis, and less across it."""
    base = F.least(b.w, b.h) * ratio
    tall, along, across = b.h >= b.w, F.greatest(base, F.lit(3.0)), F.greatest(base * 0.4, F.lit(3.0))
    mx, my = F.when(tall, across).otherwise(along), F.when(tall, along).otherwise(across)
    return b.x - mx, b.y - my, b.x + b.w + mx, b.y + b.h + my


def axis(b: Column) -> Column:
    return F.when(b.h >= b.w * 1.35, "vertical").when(b.w >= b.h * 1.35, "horizontal").otherwise("square")


def is_vertical(b: Column) -> Column:
    return b.h > 1.35 * b.w


def axis_gap(a: Column, b: Column, on: Column) -> Column:
    """Distance along the axis, 0 where they overlap; any axis but vertical is x."""
    v = on == "vertical"
    a0, a1, b0, b1 = (F.when(v, p).otherwise(q) for p, q in ((a.y, a.x), (a.y + a.h, a.x + a.w), (b.y, b.x), (b.y + b.h, b.x + b.w)))
    return F.greatest(F.lit(0.0), b0 - a1, a0 - b1)


def should_merge(a: Column, b: Column, ratio: float) -> Column:
    p, q = axis(a), axis(b)
    crossing = (p != q) & (p != "square") & (q != "square")
    far = (p == q) & (p != "square") & (axis_gap(a, b, p) > F.least(a.w, a.h, b.w, b.h) * 1.65)
    return F.when(crossing, touch(rect(a), rect(b))).when(far, False).otherwise(touch(inflate(a, ratio), inflate(b, ratio)))


def union_size(a: Column, b: Column) -> tuple[Column, Column]:
    return F.greatest(a.x + a.w, b.x + b.w) - F.least(a.x, b.x), F.greatest(a.y + a.h, b.y + b.h) - F.least(a.y, b.y)


def within_caps(a: Column, b: Column, width: float, height: float) -> Column:
    """A pair's union must fit the caps; without a picture's size there are none."""
    if not (width and height):
        return F.lit(True)
    w, h = union_size(a, b)
    return (w <= 0.34 * width) & (h <= 0.42 * height)


def overlap_area(a: Column, b: Column) -> Column:
    w = F.least(a.x + a.w, b.x + b.w) - F.greatest(a.x, b.x)
    h = F.least(a.y + a.h, b.y + b.h) - F.greatest(a.y, b.y)
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def overlap_fraction(a: Column, b: Column) -> Column:
    """Of the smaller box; areas are 1 at least."""
    return overlap_area(a, b) / F.least(F.greatest(a.w * a.h, F.lit(1.0)), F.greatest(b.w * b.h, F.lit(1.0)))


def perpendicular_overlap(a: Column, b: Column, on: Column) -> Column:
    """Overlap across the axis as a share of the shorter span."""
    v = on == "vertical"
    a0, n, b0, m = (F.when(v, p).otherwise(q) for p, q in ((a.x, a.y), (a.w, a.h), (b.x, b.y), (b.w, b.h)))
    return F.greatest(F.least(a0 + n, b0 + m) - F.greatest(a0, b0), F.lit(0.0)) / F.greatest(F.least(n, m), F.lit(1.0))


def box(x, y, w, h) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("w"), h.cast("double").alias("h"))


def unrotate(b: Column, width: Column, height: Column) -> Column:
    """A box of the picture turned clockwise, in the picture as it was; a degenerate result gives the box back."""
    clamp = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), top)
    x0, x1 = clamp(b.y, width), clamp(b.y + b.h, width)
    y0, y1 = clamp(height - (b.x + b.w), height), clamp(height - b.x, height)
    out = box(F.round(x0, 1), F.round(y0, 1), F.round(x1 - x0, 1), F.round(y1 - y0, 1))
    return F.when((x1 - x0 >= 1) & (y1 - y0 >= 1), out).otherwise(b)


def unrotate_pass(b: Column, height: Column) -> Column:
    return box(b.y, height - (b.x + b.w), b.h, b.w)


def upscale_factor(w: Column, h: Column, target: float = 280.0) -> Column:
    return F.least(F.lit(12.0), F.greatest(F.lit(1.0), target / F.greatest(w, h)))


def value_box(drawn: Column, r: Column, scale: Column, pad: float = 20.0) -> Column:
    return box(drawn.x + (r.x - pad) / scale, drawn.y + (r.y - pad) / scale, r.w / scale, r.h / scale)


def out_of_bounds(drawn: Column, b: Column, scale: Column) -> Column:
    slack = F.greatest(F.lit(4.0), 20.0 / scale)
    bad = F.lit(False)
    for c in (b.x, b.y, b.w, b.h):
        bad = bad | c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return bad | (b.x < drawn.x - slack) | (b.y < drawn.y - slack) | (b.x + b.w > drawn.x + drawn.w + slack) | (b.y + b.h > drawn.y + drawn.h + slack)


def box_of_points(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return box(F.least(x0, x1), F.least(y0, y1), F.abs(x1 - x0), F.abs(y1 - y0))


def crop_rect(b: Column, width: Column, height: Column, margin: int = 6) -> Column:
    x0, y0 = F.greatest((b.x - margin).cast("int"), F.lit(0)), F.greatest((b.y - margin).cast("int"), F.lit(0))
    x1, y1 = F.least((b.x + b.w + margin).cast("int"), width), F.least((b.y + b.h + margin).cast("int"), height)
    return box(x0, y0, x1 - x0, y1 - y0)


def grown_right(b: Column, limit: Column, width: Column) -> Column:
    """x1 of an incomplete angle's larger crop; null where it grows by under 8."""
    x0 = F.greatest(b.x.cast("int"), F.lit(0))
    x1 = F.least(b.x + b.w + F.greatest(b.w, F.lit(50.0)), F.coalesce(limit, width), width).cast("int")
    return F.when(x1 - x0 >= b.w + 8, x1)


def plausible_box(w: Column, h: Column, ink: Column, page_w: Column, page_h: Column) -> Column:
    """Whether a proposed box may hold a dimension: neither a speck nor much of the page, neither empty nor filled in."""
    short, long, area = F.least(w, h), F.greatest(w, h), w * h
    fill, aspect = ink / F.greatest(area, F.lit(1.0)), w / F.greatest(h, F.lit(1.0))
    sized = (short >= 7) & (area >= 90) & (w < 0.48 * page_w) & (h < 0.48 * page_h) & (long <= 0.36 * F.greatest(page_w, page_h))
    solid = ((fill > 0.72) & (short > 18)) | ((area > 2200) & (aspect > 0.4) & (aspect < 2.5) & (fill > 0.14))
    return sized & (fill >= 0.055) & ~solid


def text_box_plausible(t: Column, u: Column) -> Column:
    """Whether a text's tight box lies in its cluster's box ``u`` well enough."""
    inter = overlap_area(t, u)
    ta, ua = F.greatest(t.w * t.h, F.lit(1.0)), F.greatest(u.w * u.h, F.lit(1.0))
    dwarf = (ta < 0.15 * ua) & (u.h > u.w * 1.3)
    return (inter > 0) & (inter / ta >= 0.45) & (inter / ua >= 0.08) & ~dwarf


def text_box(b: Column, image: Column, prep: Column, oriented: Column, vertical: Column, pad: float = 36.0) -> Column:
    """The union ``b`` of a reading's words, in pixels of the image as received; null if under one pixel.
    image, prep, oriented: structs of w and h, as received, padded and enlarged, and turned."""

    def within(q: Column, size: Column) -> Column:
        x0, x1 = (F.greatest(F.lit(0.0), F.least(v, size.w)) for v in (q.x, q.x + q.w))
        y0, y1 = (F.greatest(F.lit(0.0), F.least(v, size.h)) for v in (q.y, q.y + q.h))
        return F.when((x1 - x0 >= 1) & (y1 - y0 >= 1), box(x0, y0, x1 - x0, y1 - y0))

    def outer(t: Column) -> Column:
        sx, sy = prep.w / F.greatest(image.w + 2 * pad, F.lit(1.0)), prep.h / F.greatest(image.h + 2 * pad, F.lit(1.0))
        return let(box(t.x / sx - pad, t.y / sy - pad, t.w / sx, t.h / sy), lambda q: within(q, image))

    def turned(t: Column) -> Column:
        return F.when(t.isNotNull(), F.when(vertical, unrotate(t, prep.w, prep.h)).otherwise(t))

    inner = let(b, lambda q: within(box(q.x - pad, q.y - pad, q.w, q.h), oriented))
    return let(let(let(inner, turned), outer), lambda t: F.when(t.isNotNull(), box(*[F.round(t[c], 1) for c in "xywh"])))


def symbol_zone(w: Column, h: Column, turned: Column) -> Column:
    """The strip of a crop where its leading symbol stands; ``turned``: the crop is a vertical one turned clockwise."""
    tall = h > 1.35 * w
    strip = F.greatest(F.lit(14), F.when(tall, h * 0.32).otherwise(w * 0.28).cast("int")).cast("double")
    beside = box(F.when(turned, w - strip).otherwise(0.0), F.lit(0.0), strip, h)
    return F.when(tall, box(F.lit(0.0), h - strip, w, strip)).otherwise(beside)


def variants(w: Column, h: Column) -> Column:
    """Names of the pictures that a crop is read from: both turns of a vertical one, by each filter."""
    turns = F.when(h > 1.35 * w, F.array(F.lit("cw"), F.lit("ccw"))).otherwise(F.array(F.lit("h")))
    filters = F.array(*[F.lit(x) for x in ("clahe", "sharp", "cad")])
    return F.flatten(F.transform(turns, lambda t: F.transform(filters, lambda f: F.concat(t, F.lit("_"), f))))


def drawn_crop(b: Column, scale: Column, pad: int = 20) -> Column:
    """What a drawn box cuts from the page, in whole pixels: source box, and the padded crop's size."""
    whole = lambda v, least: F.greatest(F.lit(least), F.floor(v * scale + 0.5)).cast("double")
    w, h = whole(b.w, 1), whole(b.h, 1)
    return F.struct(whole(b.x, 0).alias("x"), whole(b.y, 0).alias("y"), w.alias("w"), h.alias("h"), (w + 2 * pad).alias("crop_w"), (h + 2 * pad).alias("crop_h"))


def drawn_enough(b: Column, least: float = 8.0) -> Column:
    return (b.w >= least) & (b.h >= least)


def balloon(b: Column, scale: Column) -> Column:
    return F.struct((b.x + b.w / 2).alias("x"), (b.y - 28.0 / scale).alias("y"), (14.0 / scale).alias("radius"))


def bounding(points: Column) -> Column:
    """Bounding box of an array of [x, y] points, or of four numbers x0 y0 x1 y1 in one array each."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))
