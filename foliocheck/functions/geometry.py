"""Box arithmetic on flat xmin/ymin/xmax/ymax columns, 0..1000 from the top left."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from foliocheck import constants as C

SIDES = ["xmin", "ymin", "xmax", "ymax"]


def finite(*cols: Column) -> Column:
    ok = [c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))) for c in cols]
    return F.coalesce(reduce(lambda a, b: a & b, ok), F.lit(False))


def box_cols() -> list[Column]:
    return [F.col(s) for s in SIDES]


def clamp(xmin: Column, ymin: Column, xmax: Column, ymax: Column, limit: float = 1000.0) -> Column:
    """The box inside the page, or null when it is not finite or has no area left."""
    def cut(low: Column, v: Column) -> Column:
        return F.greatest(low, F.least(F.lit(limit), v))

    def inside(r: Column) -> Column:
        x0, y0 = cut(F.lit(0.0), r["x0"]), cut(F.lit(0.0), r["y0"])
        x1, y1 = cut(x0, r["x1"]), cut(y0, r["y1"])
        box = F.struct(x0.alias("xmin"), y0.alias("ymin"), x1.alias("xmax"), y1.alias("ymax"))
        return F.when(finite(r["x0"], r["y0"], r["x1"], r["y1"]) & (x1 > x0) & (y1 > y0), box)
    # Bound once, so long corner expressions are not repeated for every side.
    corners = F.array(F.struct(xmin.alias("x0"), ymin.alias("y0"), xmax.alias("x1"), ymax.alias("y1")))
    return F.get(F.transform(corners, inside), F.lit(0))


def clamp_compiled(xmin: Column, ymin: Column, xmax: Column, ymax: Column, limit: float = 1000.0) -> Column:
    """`clamp` without a lambda, for a projection over many rows: it is compiled, and its repeated parts are computed once."""
    def cut(low: Column, v: Column) -> Column:
        return F.greatest(low, F.least(F.lit(limit), v))
    x0, y0 = cut(F.lit(0.0), xmin), cut(F.lit(0.0), ymin)
    x1, y1 = cut(x0, xmax), cut(y0, ymax)
    box = F.struct(x0.alias("xmin"), y0.alias("ymin"), x1.alias("xmax"), y1.alias("ymax"))
    return F.when(finite(xmin, ymin, xmax, ymax) & (x1 > x0) & (y1 > y0), box)


def clamp_model_box(numbers: Column) -> Column:
    """[ymin, xmin, ymax, xmax] of a model: the page when incomplete, inverted sides widened."""
    # A missing number counts as 0, one that is not a number is left out.
    nums = F.filter(F.transform(numbers, lambda v: F.coalesce(v, F.lit(0.0))), lambda v: ~F.isnan(v))
    full = F.coalesce(F.size(nums) >= 4, F.lit(False))

    def side(i: int, default: float) -> Column:
        return F.least(F.lit(1000.0), F.greatest(F.lit(0.0), F.when(full, F.get(nums, F.lit(i))).otherwise(default)))
    y0, x0, y1, x1 = side(0, 0.0), side(1, 0.0), side(2, 1000.0), side(3, 1000.0)
    y1 = F.when(y1 <= y0, F.least(F.lit(1000.0), y0 + 30)).otherwise(y1)
    x1 = F.when(x1 <= x0, F.least(F.lit(1000.0), x0 + 40)).otherwise(x1)
    return F.struct(x0.alias("xmin"), y0.alias("ymin"), x1.alias("xmax"), y1.alias("ymax"))


def usable(prefix: str = "") -> Column:
    """A measured box that can identify an occurrence: finite, with area, not page-wide."""
    x0, y0, x1, y1 = [F.col(prefix + s) for s in SIDES]
    w, h = x1 - x0, y1 - y0
    return (F.coalesce(F.col(prefix + "box_source").isin(C.MEASURED_SOURCES), F.lit(False)) & finite(x0, y0, x1, y1)
            & (w > 0) & (h > 0) & (w * h <= C.MAX_BOX_AREA))


def overlap(a: list[Column], b: list[Column]) -> Column:
    """Shared area of two boxes given as [xmin, ymin, xmax, ymax]."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def area(b: list[Column]) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def location_phrase(measured: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    cx, cy = (xmin + xmax) / 2, (ymin + ymax) / 2
    return F.when(measured & finite(xmin, ymin, xmax, ymax), F.concat(
        F.when(cx < 500, "left").otherwise("right"), F.lit(" side, "),
        F.when(cy < 330, "upper").when(cy > 660, "lower").otherwise("middle"), F.lit(" part of the page"))
    ).otherwise("no measured place; look for it on the page")
