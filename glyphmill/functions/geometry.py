"""Box geometry as column expressions. A box is four integer columns x, y, w, h; x2 = x + w and y2 = y + h are open ends."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Preprocess


@dataclass(frozen=True)
class Box:
    x: Column
    y: Column
    w: Column
    h: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*(F.col(prefix + n) for n in "xywh"))

    @property
    def x2(self) -> Column:
        return self.x + self.w

    @property
    def y2(self) -> Column:
        return self.y + self.h

    @property
    def area(self) -> Column:
        return self.w * self.h

    @property
    def cx(self) -> Column:
        return self.x + self.w / F.lit(2.0)

    @property
    def cy(self) -> Column:
        return self.y + self.h / F.lit(2.0)

    @property
    def aspect(self) -> Column:
        return F.when(self.h == 0, F.lit(0.0)).otherwise(self.w.cast("double") / self.h)

    def columns(self, prefix: str = "") -> list[Column]:
        return [c.alias(prefix + n) for n, c in zip("xywh", (self.x, self.y, self.w, self.h), strict=True)]


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def intersection(a: Box, b: Box) -> Column:
    dx = F.least(a.x2, b.x2) - F.greatest(a.x, b.x)
    dy = F.least(a.y2, b.y2) - F.greatest(a.y, b.y)
    return F.greatest(dx, F.lit(0)) * F.greatest(dy, F.lit(0))


def iou(a: Box, b: Box) -> Column:
    i = intersection(a, b)
    return ratio(i, a.area + b.area - i)


def coverage_of(a: Box, b: Box) -> Column:
    """The part of b that a covers."""
    return ratio(intersection(a, b), b.area)


def vertical_overlap(a: Box, b: Box) -> Column:
    dy = F.least(a.y2, b.y2) - F.greatest(a.y, b.y)
    return F.when(dy <= 0, F.lit(0.0)).otherwise(ratio(dy, F.least(a.h, b.h)))


def scaled(a: Box, factor: Column) -> Box:
    """Rounded half to even; sides are at least 1."""
    r = lambda c: F.bround(c * factor).cast("int")
    return Box(r(a.x), r(a.y), F.greatest(F.lit(1), r(a.w)), F.greatest(F.lit(1), r(a.h)))


def union(a: Box, b: Box) -> Box:
    x, y = F.least(a.x, b.x), F.least(a.y, b.y)
    return Box(x, y, F.greatest(a.x2, b.x2) - x, F.greatest(a.y2, b.y2) - y)


def union_of(prefix: str = "") -> list[Column]:
    """The enclosing box as aggregates."""
    b = Box.of(prefix)
    return [F.min(b.x).alias("x"), F.min(b.y).alias("y"), (F.max(b.x2) - F.min(b.x)).alias("w"), (F.max(b.y2) - F.min(b.y)).alias("h")]


def from_points(xs: Column, ys: Column) -> Box:
    """The rounded box around points, given as two arrays; sides are at least 1."""
    low, high = (lambda c: F.bround(F.array_min(c)).cast("int")), (lambda c: F.bround(F.array_max(c)).cast("int"))
    return Box(low(xs), low(ys), F.greatest(F.lit(1), high(xs) - low(xs)), F.greatest(F.lit(1), high(ys) - low(ys)))


def from_corners(corners: Column, truncate: bool = False) -> Column:
    """[x0, y0, x1, y1] as [x, y, w, h]; null unless there are four and the box isn't empty."""
    at = lambda i: (F.element_at(corners, i + 1) if truncate else F.bround(F.element_at(corners, i + 1))).cast("int")
    return F.when((F.size(corners) == 4) & (at(2) > at(0)) & (at(3) > at(1)), F.array(at(0), at(1), at(2) - at(0), at(3) - at(1)))


def compute_scale(h: Column, w: Column, settings: Preprocess) -> Column:
    long = F.greatest(h, w)
    up = F.when(long < settings.min_side, F.lit(float(settings.min_side)) / long).otherwise(F.lit(1.0)) if settings.upscale else F.lit(1.0)
    return F.when(long > settings.max_side, F.lit(float(settings.max_side)) / long).otherwise(up)


def resized(side: Column, scale: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(side * scale).cast("int"))


def interpolation(scale: Column) -> Column:
    return F.when(scale < 1, "area").when(scale > 1, "cubic").otherwise("none")


def odd(n: Column) -> Column:
    return F.when(n % 2 == 1, n).otherwise(n + 1)


def kernel_size(long: Column, least: int = 31) -> Column:
    return odd(F.greatest(F.lit(least), F.floor(long / F.lit(50)).cast("int")))


def dpi_bucket(dpi: Column) -> Column:
    return F.when(dpi < 100, "<100").when(dpi < 150, "100-149").when(dpi < 250, "150-249").otherwise(">=250")


def let(value: Column, f) -> Column:
    """f of a value that is evaluated once: the optimizer copies a column's expression to each of its uses, but not into a lambda's variable."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def kept(value: Column) -> Column:
    """Fields of a struct as columns, for a select; rows where it is null drop out. A filter and fields apart would work the struct out for each."""
    return F.inline(F.filter(F.array(value), lambda v: v.isNotNull()))


def homography_box(a: Box, m: list[Column], width: Column, height: Column) -> Column:
    """The enclosing box of the four mapped corners, clipped to the page, as struct<x, y, w, h>; null where less than
    a pixel or less than 0.4 of it is left. m: nine columns, row by row."""
    def at(x: Column, y: Column) -> tuple[Column, Column]:
        z = m[6] * x + m[7] * y + m[8]
        return (m[0] * x + m[1] * y + m[2]) / z, (m[3] * x + m[4] * y + m[5]) / z

    corners = [at(x, y) for x, y in ((a.x, a.y), (a.x2, a.y), (a.x2, a.y2), (a.x, a.y2))]
    ends = F.struct(*(f(*(c[k] for c in corners)).alias(n) for n, f, k in (("x0", F.least, 0), ("x1", F.greatest, 0), ("y0", F.least, 1), ("y1", F.greatest, 1))))
    return let(ends, lambda e: _clipped(e["x0"], e["x1"], e["y0"], e["y1"], width, height))


def _clipped(x0: Column, x1: Column, y0: Column, y1: Column, width: Column, height: Column) -> Column:
    cx0, cy0 = F.greatest(F.lit(0.0), x0), F.greatest(F.lit(0.0), y0)
    cx1, cy1 = F.least(width.cast("double"), x1), F.least(height.cast("double"), y1)
    cw, ch = cx1 - cx0, cy1 - cy0
    r = lambda c: F.bround(c).cast("int")
    left = cw * ch >= F.lit(0.4) * F.greatest(F.lit(1.0), (x1 - x0) * (y1 - y0))
    return F.when((cw >= 1) & (ch >= 1) & left, F.struct(r(cx0).alias("x"), r(cy0).alias("y"), r(cw).alias("w"), r(ch).alias("h")))


def effective_dpi(dpi: Column, scale: Column) -> Column:
    """Resolution of a page that was scaled after rendering."""
    return F.bround(dpi * scale).cast("int")
