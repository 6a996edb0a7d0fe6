"""On-screen elements: row-local array expressions, so no element is ever shuffled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.text import or_empty, strip

MOST = 40
NEAR = 0.04
COLOURS = 8


def some(c: Column) -> Column:
    return F.coalesce(F.length(strip(or_empty(c))) > 0, F.lit(False))


def useful_nodes(nodes: Column, w: Column, h: Column) -> Column:
    """Visible nodes one can act on or read, with a box on the screen, as compact nodes with boxes in 0 to 1."""
    flag = lambda c: F.coalesce(c, F.lit(False))

    def keep(n: Column) -> Column:
        b = n["bounds"]
        speaks = flag(n["is_clickable"]) | flag(n["is_long_clickable"]) | flag(n["is_editable"]) | some(n["text"]) | some(n["content_description"])
        on = (b["right"] > b["left"]) & (b["bottom"] > b["top"]) & (b["right"] > 0) & (b["bottom"] > 0) & (b["left"] < w) & (b["top"] < h)
        return flag(n["is_visible_to_user"]) & speaks & flag(on)

    cut = lambda c, n: F.substring(strip(or_empty(c)), 1, n)

    def project(n: Column) -> Column:
        b = n["bounds"]
        return F.struct(
            n["unique_id"].cast("int").alias("id"),
            F.array(geometry.unit(b["left"], w, 4), geometry.unit(b["top"], h, 4), geometry.unit(b["right"], w, 4), geometry.unit(b["bottom"], h, 4)).alias("bbox"),
            cut(n["text"], 80).alias("text"),
            cut(n["content_description"], 80).alias("content_description"),
            F.substring(F.substring_index(or_empty(n["view_id_resource_name"]), "/", -1), 1, 60).alias("view_id_resource_name"),
            F.substring_index(or_empty(n["class_name"]), ".", -1).alias("class_name"),
            flag(n["is_clickable"]).alias("is_clickable"),
            flag(n["is_long_clickable"]).alias("is_long_clickable"),
            flag(n["is_editable"]).alias("is_editable"),
            F.coalesce(n["depth"], F.lit(0)).alias("depth"),
        )

    return F.transform(F.filter(F.coalesce(nodes, F.array()), keep), project)


def large_enough(nodes: Column, w: Column, h: Column, least: int = 16) -> Column:
    return F.filter(nodes, lambda n: ((n["bbox"][2] - n["bbox"][0]) * w >= least) & ((n["bbox"][3] - n["bbox"][1]) * h >= least))


def priority(n: Column) -> Column:
    """0: one can click it; 1: edit; 2: read; 3: the rest."""
    read = (or_empty(n["text"]) != "") | (or_empty(n["content_description"]) != "")
    return F.when(n["is_clickable"], 0).when(n["is_editable"], 1).when(read, 2).otherwise(3)


def _first(nodes: Column, key, most: int) -> Column:
    keyed = F.array_sort(F.transform(nodes, lambda n, i: F.struct(*[k.alias(f"k{j}") for j, k in enumerate(key(n))], i.alias("i"))))
    return F.transform(F.slice(keyed, 1, most), lambda k: F.get(nodes, k["i"]))


def ranked(nodes: Column, most: int = MOST) -> Column:
    """The first `most` by priority, depth and area; equal ones keep their order. An element's id is its place, from 1."""
    return _first(nodes, lambda n: (priority(n), F.coalesce(n["depth"], F.lit(0)), geometry.area(n["bbox"])), most)


def ranked_without_size(nodes: Column, most: int = MOST) -> Column:
    """The order for rows without screen sizes: what can be pressed, then area."""
    return _first(nodes, lambda n: (F.when(F.coalesce(n["is_clickable"], F.lit(False)), 0).otherwise(1), geometry.area(n["bbox"])), most)


def short_label(n: Column) -> Column:
    """The first of text, description and id that is not blank, 24 characters of it; else the class; else ?."""
    pick = [F.when(some(n[k]), F.substring(strip(n[k]), 1, 24)) for k in ("text", "content_description", "view_id_resource_name")]
    last = F.substring_index(or_empty(n["class_name"]), ".", -1)
    return F.coalesce(*pick, F.nullif(last, F.lit("")), F.lit("?"))


def elements(nodes: Column) -> Column:
    """Ordered nodes as elements (id from 1, bbox, label)."""
    return F.transform(nodes, lambda n, i: F.struct((i + 1).cast("int").alias("id"), n["bbox"].alias("bbox"), short_label(n).alias("label")))


def marks(nodes: Column) -> Column:
    """Ordered nodes as marks: elements with their centres and a colour's number."""
    mid = lambda n: geometry.centre(n["bbox"])
    return F.transform(nodes, lambda n, i: F.struct((i + 1).cast("int").alias("id"), n["bbox"].alias("bbox"), mid(n)["x"].alias("cx"), mid(n)["y"].alias("cy"), short_label(n).alias("label"), (i % COLOURS).cast("int").alias("colour")))


def element_at(nodes: Column, x: Column, y: Column, near: float = NEAR) -> Column:
    """The place (from 0) of the node a tap means: of those that contain it the one to press, then the smallest, then the first; else the nearest centre under `near`; else null."""
    inside = F.filter(F.transform(nodes, lambda n, i: F.struct(F.when(F.coalesce(n["is_clickable"], F.lit(False)) | F.coalesce(n["is_long_clickable"], F.lit(False)), 0).otherwise(1).alias("p"), geometry.area(n["bbox"]).alias("a"), i.alias("i"), geometry.contains(n["bbox"], x, y).alias("in"))), lambda k: k["in"])
    mid = lambda n: geometry.centre(n["bbox"])
    close = F.filter(F.transform(nodes, lambda n, i: F.struct(F.sqrt(geometry.squared(mid(n)["x"], mid(n)["y"], x, y)).alias("d"), i.alias("i"))), lambda k: k["d"] < near)
    return F.coalesce(F.array_min(inside)["i"], F.array_min(close)["i"])


def by_id(items: Column, wanted: Column) -> Column:
    return F.get(F.filter(items, lambda e: e["id"] == wanted), F.lit(0))


def resolved(items: Column, wanted: Column) -> Column:
    """The centre of the first item with an id, else null."""
    found = by_id(items, wanted)
    return F.when(found.isNotNull(), geometry.centre(found["bbox"]))


def reachable(items: Column, x: Column, y: Column) -> Column:
    """Whether any item's box holds a point."""
    return F.coalesce(F.exists(items, lambda e: geometry.contains(e["bbox"], x, y)), F.lit(False))
