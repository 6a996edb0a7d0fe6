"""The match predicates: one factory, five modes. Every predicate is true or false, never null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.actions import scroll_normalised
from ..functions.text import or_empty, strip

MODES = ("coordinate", "restratified", "native", "mark", "element")
ALWAYS = ("navigate_back", "navigate_home", "wait", "done")


def kind(a: Column) -> Column:
    return F.lower(strip(or_empty(a["action"])))


def match(pred: Column, gt: Column, mode: str, xy: Column | None = None, at: Column | None = None, radius: float = geometry.RADIUS) -> Column:
    """Whether a prediction matches.

    coordinate: exact types; taps by parsed coordinates, squared distance; a long press by type alone; scrolls by equality.
    restratified: exact types; taps and long presses by hypot; scrolls stripped and lower-cased; unknown types never.
    native, mark: lower-cased types; presses by the prediction's resolved point `at` (struct x, y) against `xy` (struct x, y); native folds scroll variants.
    element: as native, but presses by element id.
    """
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    if mode in ("native", "element"):
        pred = scroll_normalised(pred)
    loose = mode in ("native", "mark", "element")
    p, g = (F.lower(or_empty(pred["action"])), F.lower(or_empty(gt["action"]))) if loose else (pred["action"], gt["action"])
    same = (p == g) & (p != "") if loose else p == g
    plain = lambda k: strip(or_empty(pred[k])) == strip(or_empty(gt[k]))
    folded = lambda k: F.lower(strip(or_empty(pred[k]))) == F.lower(strip(or_empty(gt[k])))
    if mode == "coordinate":
        u, v = xy or gt, at or pred
        tap, press = geometry.within(v["x"], v["y"], u["x"], u["y"], radius), F.lit(True)
        scroll, other = pred["direction"].eqNullSafe(gt["direction"]), F.lit(True)
    elif mode == "restratified":
        tap = press = geometry.within(pred["x"], pred["y"], gt["x"], gt["y"], radius, "hypot")
        scroll, other = folded("direction"), g.isin(*ALWAYS)
    else:
        if mode == "element":
            tap = press = pred["element_id"] == gt["element_id"]
        elif xy is None or at is None:
            raise ValueError(f"mode {mode} needs the points xy and at")
        else:
            tap = press = geometry.within(at["x"], at["y"], xy["x"], xy["y"], radius)
        scroll, other = F.lower(or_empty(pred["direction"])) == F.lower(or_empty(gt["direction"])), F.lit(True)
    rule = F.when(g == "tap", tap).when(g == "long_press", press).when(g == "scroll", scroll).when(g == "type", plain("text")).when(g == "open_app", folded("app_name")).otherwise(other)
    return F.coalesce(pred.isNotNull() & gt.isNotNull() & same & rule, F.lit(False))
