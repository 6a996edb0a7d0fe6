"""Points and boxes (arrays x0, y0, x1, y1 of doubles)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 0.14


def unit(v: Column, size: Column, digits: int) -> Column:
    """v / size, kept in 0 to 1 and rounded."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v.cast("double") / size.cast("double"))), digits)


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])


def centre(b: Column) -> Column:
    return F.struct(((b[0] + b[2]) / 2).alias("x"), ((b[1] + b[3]) / 2).alias("y"))


def contains(b: Column, x: Column, y: Column) -> Column:
    return (b[0] <= x) & (x <= b[2]) & (b[1] <= y) & (y <= b[3])


def squared(x: Column, y: Column, u: Column, v: Column) -> Column:
    return (x - u) * (x - u) + (y - v) * (y - v)


def within(x: Column, y: Column, u: Column, v: Column, radius: float = RADIUS, form: str = "squared") -> Column:
    """Distance at most `radius`. The two forms differ in the last bit at the boundary."""
    return squared(x, y, u, v) <= radius * radius if form == "squared" else F.hypot(x - u, y - v) <= radius


def location_token(axis: str, v: Column, grid: int) -> Column:
    return F.concat(F.lit(f"<loc_{axis}_"), F.greatest(F.lit(0), F.least(F.lit(grid - 1), F.bround(v * grid).cast("int"))).cast("string"), F.lit(">"))


def coordinate(axis: str, c: Column, grid: int = 1000) -> Column:
    """A number, a numeric string or a location token as a coordinate, else null."""
    text = c.cast("string")
    k = F.regexp_extract(text, rf"<loc_{axis}_(\d+)>", 1).try_cast("int")
    return F.when(k.isNotNull(), F.when(k < grid, (k + 0.5) / grid)).otherwise(F.trim(text).try_cast("double"))


def tap_point(a: Column) -> Column:
    """The point of a tap whose coordinates are numbers or numeric strings, else null."""
    x, y = (F.trim(a[k].cast("string")).try_cast("double") for k in "xy")
    return F.when((a["action"] == "tap") & x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))
