"""Points in boxes where a screen's boxes are rows of a table, however many: the rule of `elements.element_at` as equi-joins on grid cells.

A box lies in cells of about its own shape: at level n a cell's side is 2**-n, and in each direction a box goes to the finest level whose cells are at least as large as its
side, so to at most four cells, and wide flat boxes meet only points at their height. A point looks for boxes in its one cell of each pair of levels that is in use. Candidates meet the exact test right in the join, and the best of each
point is combined before it is shuffled, so no point's boxes are ever held together. Points multiply in explodes that the planner does not count, so joins
with them are hinted to shuffle: it would broadcast them.

Boxes take part in strata by rank (the one to press, then the smallest, then the least box_id), each _GROWTH times the one before: what a stratum finds is better than all that the next ones hold, so its points are done, and
no stratum is read once no point is left. Points of one place are one. So work follows the points and not all pairs of points and boxes, where boxes lie thickly.

Points in no box look for the nearest centre under a distance: first in the cell around them and its neighbours (of a grid of a quarter of the distance), then, where the nearest found
could still be beaten, in the rings around those.

Boxes whose sides are null or not finite hold nothing and are near nothing; a point without coordinates gets null. Rows of one (screen, box_id) are boxes of equal rank.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..llm import shared
from .elements import NEAR

#: Levels in use: cells from 4 down to 2**-12 on a side. Larger boxes lie in more than four cells of the first level.
FIRST, LAST = -2, 12
_PART = 4
#: Boxes of the first stratum at most, how the strata grow, and rows of the sample that says where they end.
FEW, _GROWTH, _SAMPLE = 2_000_000, 4, 20_000


def _cell(v: Column, level: Column) -> Column:
    return F.floor(v * F.pow(F.lit(2.0), level.cast("double")))


def with_cells(boxes: DataFrame) -> DataFrame:
    """Each box once for every cell it lies in: adds level and across (of the width, of the height), cx, cy."""
    b = F.col("bbox")
    fit = lambda side: F.greatest(F.lit(FIRST), F.least(F.lit(LAST), F.floor(-F.log2(F.greatest(side, F.lit(2.0**-LAST)))))).cast("int")
    rows = boxes.withColumns({"level": fit(b[2] - b[0]), "across": fit(b[3] - b[1])})
    side = lambda a, z, level: F.sequence(_cell(a, F.col(level)), _cell(z, F.col(level)))
    return rows.withColumn("cx", F.explode(side(b[0], b[2], "level"))).withColumn("cy", F.explode(side(b[1], b[3], "across")))


def sound(bbox: Column) -> Column:
    """Four finite sides in order; nothing can be in any other box."""
    finite = lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False))
    return (F.size(bbox) >= 4) & finite(bbox[0]) & finite(bbox[1]) & finite(bbox[2]) & finite(bbox[3])


def _held(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The boxes that can hold a point, with their rank (p, a, box_id)."""
    rows = boxes.where(sound(F.col("bbox")) & (F.col("bbox")[0] <= F.col("bbox")[2]) & (F.col("bbox")[1] <= F.col("bbox")[3]))
    return rows.select(*keys, "box_id", "bbox", F.when(F.coalesce("pressable", F.lit(False)), 0).otherwise(1).alias("p"), geometry.area(F.col("bbox")).alias("a"))


def _strata(held: DataFrame) -> list[DataFrame]:
    """The boxes by rank. Ends are read off a sample: they say how much a stratum holds, and nothing else."""
    n = held.count()
    if n <= FEW:
        return [held]
    rank = F.struct("p", "a", "box_id")
    sample = sorted(tuple(r) for r in held.select("p", "a", "box_id").sample(min(1.0, _SAMPLE / n), seed=7).where("box_id IS NOT NULL").collect())
    ends, share = [], 1.0
    while n * share > FEW and sample:
        share /= _GROWTH
        ends.insert(0, F.struct(*[F.lit(v).alias(c) for c, v in zip(("p", "a", "box_id"), sample[int(len(sample) * share)])]))
    cuts = [None, *ends, None]
    inside = lambda lo, hi: functools.reduce(lambda x, y: x & y, [c for c in (lo is not None and rank >= lo, hi is not None and rank < hi) if c is not False])
    return [held.where(inside(lo, hi)) for lo, hi in zip(cuts, cuts[1:])] if ends else [held]


def _inside(places: DataFrame, held: DataFrame, keys: list[str], place: list[str], few: bool) -> DataFrame:
    """The best box that holds a place: place, box_id. `few`: boxes that share no cell with a place are left out before they are shuffled."""
    held = with_cells(held)
    levels = held.select("level", "across").distinct()  # 225 rows at most
    seen = places.crossJoin(F.broadcast(levels)).withColumns({"cx": _cell(F.col("x"), F.col("level")), "cy": _cell(F.col("y"), F.col("across"))})
    if few:
        area = f"{shared.OWN}area"
        cell = F.xxhash64(*keys, "level", "across", "cx", "cy").alias(area)
        held = shared.may_contain(held.select("*", cell), area, shared.settle(seen.select(cell).distinct(), "areas")).drop(area)
    met = seen.hint("merge").join(held.hint("merge"), [*keys, "level", "across", "cx", "cy"]).where(geometry.contains(F.col("bbox"), F.col("x"), F.col("y")))
    return met.groupBy(*place).agg(F.min(F.struct("p", "a", "box_id")).alias("b")).select(*place, F.col("b.box_id").alias("box_id"))


def _placed(points: DataFrame, keys: list[str]) -> DataFrame:
    """The places of the points, each once."""
    return shared.settle(points.where("x IS NOT NULL AND y IS NOT NULL").select(*keys, "x", "y").distinct(), "places")


def _held_places(places: DataFrame, boxes: DataFrame, keys: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """What the strata find (keys, x, y, box_id), one settled table each, and the places that are in no box; `places` is discarded."""
    place, found = [*keys, "x", "y"], []
    for stratum in _strata(_held(boxes, keys)):
        found.append(shared.settle(_inside(places, stratum, keys, place, bool(found)), "inside"))
        rest = shared.settle(places.hint("merge").join(found[-1].select(*place), place, "left_anti"), "places")
        shared.discard(places)
        places = rest
        if places.isEmpty():
            break
    return found, places


def boxes_at(points: DataFrame, boxes: DataFrame, keys: list[str], point_id: str = "point_id") -> DataFrame:
    """point_id and the box a point means (its box_id, for points in a box only): of those that contain it the one to press, then the smallest, then the least box_id.

    `points`: keys, point_id, x, y. `boxes`: keys, box_id, bbox, pressable.
    """
    found, rest = _held_places(_placed(points, keys), boxes, keys)
    shared.discard(rest)
    return points.hint("merge").join(functools.reduce(DataFrame.union, found), [*keys, "x", "y"]).select(*keys, point_id, "box_id")


def _nearest(points: DataFrame, centres: DataFrame, keys: list[str], point_id: str, near: float, rings: list[int]) -> DataFrame:
    """The nearest centre under `near` in some rings of cells around each point: keys, point_id, d, box_id."""
    steps = [(i, j) for r in rings for i in range(-r, r + 1) for j in range(-r, r + 1) if max(abs(i), abs(j)) == r]
    around = F.explode(F.array(*[F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i, j in steps]))
    seen = points.select(*keys, point_id, "x", "y", around.alias("c")).select(*keys, point_id, "x", "y", "c.cx", "c.cy")
    d = F.sqrt(geometry.squared(F.col("mx"), F.col("my"), F.col("x"), F.col("y")))
    return seen.hint("merge").join(centres.hint("merge"), [*keys, "cx", "cy"]).withColumn("d", d).where(F.col("d") < near).groupBy(*keys, point_id).agg(F.min(F.struct("d", "box_id")).alias("b")).select(*keys, point_id, "b.d", "b.box_id")


def nearest_centres(points: DataFrame, boxes: DataFrame, keys: list[str], point_id: str = "point_id", near: float = NEAR) -> DataFrame:
    """point_id and the box whose centre is nearest, closer than `near`; ties to the least box_id."""
    cell = lambda v: F.floor(F.col(v) * (_PART / near))
    mid = geometry.centre(F.col("bbox"))
    centres = boxes.where(sound(F.col("bbox"))).select(*keys, "box_id", mid["x"].alias("mx"), mid["y"].alias("my")).withColumns({"cx": cell("mx"), "cy": cell("my")})
    asked = points.where("x IS NOT NULL AND y IS NOT NULL").select(*keys, point_id, "x", "y").withColumns({"cx": cell("x"), "cy": cell("y")})
    # centres in no wide cell (larger than the distance) at or beside a point's are near none
    wide, area = (lambda v: F.floor(F.col(v) / (1.25 * near))), f"{shared.OWN}area"
    beside = F.explode(F.array(*[F.struct((wide("x") + i).alias("gx"), (wide("y") + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    areas = shared.settle(asked.select(*keys, beside.alias("g")).select(F.xxhash64(*keys, "g.gx", "g.gy").alias(area)).distinct(), "areas")
    centres = shared.may_contain(centres.withColumn(area, F.xxhash64(*keys, wide("mx"), wide("my"))), area, areas).drop(area)
    first = _nearest(asked, centres, keys, point_id, near, [0, 1])
    # what lies outside the first two rings is a whole cell away at least
    open_ = asked.hint("merge").join(first.where(F.col("d") < near / _PART).select(*keys, point_id), [*keys, point_id], "left_anti")
    more = _nearest(open_, centres, keys, point_id, near, list(range(2, _PART + 2)))
    return first.unionByName(more).groupBy(*keys, point_id).agg(F.min(F.struct("d", "box_id")).alias("b")).select(*keys, point_id, F.col("b.box_id").alias("box_id"))


def meant_boxes(points: DataFrame, boxes: DataFrame, keys: list[str], point_id: str = "point_id", near: float = NEAR) -> DataFrame:
    """Every point with the box it means (box_id, else null): `boxes_at`, else `nearest_centres`. (keys, point_id) is unique."""
    found, rest = _held_places(_placed(points, keys), boxes, keys)
    place = [*keys, "x", "y"]
    if not rest.isEmpty():
        which = f"{shared.OWN}place"
        asked = rest.withColumn(which, F.struct("x", "y"))
        nearest = nearest_centres(asked, boxes, keys, which, near)
        found.append(shared.settle(nearest.select(*keys, f"{which}.x", f"{which}.y", "box_id"), "nearest"))
    shared.discard(rest)
    return points.hint("merge").join(functools.reduce(DataFrame.union, found), place, "left").select(*keys, point_id, "x", "y", "box_id")
