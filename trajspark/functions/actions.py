"""Actions: a nullable struct of action, x, y, element_id, mark, text, app_name and direction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry
from .text import json_object, or_empty, quoted

FIELDS = {"action": "string", "x": "double", "y": "double", "element_id": "int", "mark": "int", "text": "string", "app_name": "string", "direction": "string"}
# The action types of the second schema.
TYPES_V2 = ("tap", "long_press", "scroll", "type", "open_app", "navigate_back", "navigate_home", "wait")
# Fixed value: the scroll variants that are folded.
DIRECTION = r"(?i)^scroll[\s_\-]*(up|down|left|right)$"


def action(**fields: Column) -> Column:
    return F.named_struct(*[x for k, t in FIELDS.items() for x in (F.lit(k), fields.get(k, F.lit(None)).cast(t))])


def with_fields(a: Column, **fields: Column) -> Column:
    return action(**({k: a[k] for k in FIELDS} | fields))


def _kind(raw: Column) -> Column:
    return F.trim(F.lower(or_empty(raw["action_type"])))


def from_mirror(raw: Column, w: Column, h: Column) -> Column:
    """Actions of mirrored episodes. Coordinates stay absent unless both are given; unknown types pass through."""
    kind, xy = _kind(raw), raw["x"].isNotNull() & raw["y"].isNotNull() & (w > 0) & (h > 0)
    type_ = F.when(kind == "click", "tap").when(kind == "input_text", "type").otherwise(kind)
    return action(
        action=type_,
        x=F.when((type_ == "tap") & (kind == "click") & xy, geometry.unit(raw["x"], w, 6)),
        y=F.when((type_ == "tap") & (kind == "click") & xy, geometry.unit(raw["y"], h, 6)),
        text=F.when(kind == "input_text", or_empty(raw["text"])),
        app_name=F.when(kind == "open_app", or_empty(raw["app_name"])),
        direction=F.when(kind == "scroll", F.coalesce(F.nullif(raw["direction"], F.lit("")), F.lit("down"))),
    )


def from_binary(raw: Column, w: Column, h: Column) -> Column:
    """Actions of binary episodes: presses become taps, a press without coordinates or an empty type becomes wait."""
    kind = _kind(raw)
    press, swipe, typed = kind.isin("click", "tap", "long_press"), kind.isin("scroll", "swipe"), kind.isin("input_text", "type")
    lost = press & (raw["x"].isNull() | raw["y"].isNull())
    one = lambda size: F.greatest(size, F.lit(1))
    return action(
        action=F.when(lost | (kind == ""), "wait").when(press, "tap").when(swipe, "scroll").when(typed, "type").otherwise(kind),
        x=F.when(press & ~lost, geometry.unit(raw["x"], one(w), 4)),
        y=F.when(press & ~lost, geometry.unit(raw["y"], one(h), 4)),
        text=F.when(typed, raw["text"]),
        app_name=F.when(kind == "open_app", raw["app_name"]),
        direction=F.when(swipe, F.nullif(F.lower(raw["direction"]), F.lit(""))),
    )


def args_json(a: Column) -> Column:
    number = lambda k: a[k].cast("string")
    return json_object([("x", number("x")), ("y", number("y")), ("element_id", number("element_id")), ("mark", number("mark")), ("text", quoted(a["text"])), ("app_name", quoted(a["app_name"])), ("direction", quoted(a["direction"]))])


def to_json_v1(a: Column) -> Column:
    """{"action": ..., arguments} on one line."""
    inner = F.regexp_extract(args_json(a), r"(?s)^\{(.*)\}$", 1)
    return F.concat(F.lit('{"action": '), quoted(a["action"]), F.when(inner == "", "").otherwise(F.concat(F.lit(", "), inner)), F.lit("}"))


def to_json_v2(a: Column) -> Column:
    """{"action_type": ..., "action_args": {...}}; a missing or unknown type is an error."""
    good = F.coalesce(a["action"].isin(*TYPES_V2), F.lit(False))
    out = F.concat(F.lit('{"action_type": '), quoted(a["action"]), F.lit(', "action_args": '), args_json(a), F.lit("}"))
    return F.when(good, out).otherwise(F.raise_error(F.concat(F.lit("unknown action type "), F.coalesce(a["action"], F.lit("null")))).cast("string"))


def from_json_text(text: Column) -> Column:
    """Either schema as the flat struct; null where the text is no JSON object. Arguments override, and an unknown key is dropped."""
    ok = F.when(F.try_parse_json(text).isNotNull(), text)
    two = F.get_json_object(ok, "$.action_type").isNotNull() & F.get_json_object(ok, "$.action_args").isNotNull()

    def pick(k: str) -> Column:
        flat, nested = F.get_json_object(ok, f"$.{k}"), F.get_json_object(ok, f"$.action_args.{k}")
        return F.when(two, nested).otherwise(flat)

    named = F.when(two, F.get_json_object(ok, "$.action_type")).otherwise(F.coalesce(F.get_json_object(ok, "$.action"), F.get_json_object(ok, "$.action_type")))
    # a number that is no integer is cut, as in element ids like 7.9
    fields = {k: pick(k).try_cast("double").try_cast("int") if t == "int" else pick(k).try_cast(t) for k, t in FIELDS.items() if k != "action"}
    return F.when(ok.isNotNull() & F.startswith(F.trim(ok), F.lit("{")), action(action=F.when(two, F.coalesce(pick("action"), named)).otherwise(named), **fields))


def without_point(a: Column) -> Column:
    """No coordinates on anything but taps."""
    tap = a["action"] == "tap"
    return with_fields(a, x=F.when(tap, a["x"]), y=F.when(tap, a["y"]))


def scroll_normalised(a: Column) -> Column:
    """`scroll down`, `scroll_up` and the like as a scroll with a direction; a direction that is given stays."""
    way = F.regexp_extract(F.trim(or_empty(a["action"])), DIRECTION, 1)
    return F.when(
        way != "", with_fields(a, action=F.lit("scroll"), direction=F.coalesce(F.nullif(a["direction"], F.lit("")), F.lower(way)))
    ).otherwise(with_fields(a))
