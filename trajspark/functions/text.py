"""Strings, JSON in strings, labels and prompts."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Prompt texts that rows are matched with byte for byte.
SCHEMA_V1 = (
    "Below is a list of UI elements visible on screen, numbered.\n"
    "Output a single JSON action.\n"
    'For tap/long_press: {"action":"tap","element_id":<int>}\n'
    "For type: also include text. For scroll: include direction. "
    "For navigate_back/navigate_home/wait/done: no element_id."
)
SCHEMA_V2 = (
    "Below is a list of UI elements visible on screen, numbered.\n"
    'Output a single JSON action with two keys: "action_type" (string) and "action_args" (object).\n'
    'For tap/long_press: {"action_type":"tap","action_args":{"element_id":<int>}}\n'
    'For type: action_args includes "text". For scroll: action_args includes "direction". '
    'For open_app: action_args includes "app_name". '
    "For navigate_back/navigate_home/wait: action_args is the empty object {}."
)
ANCHOR = "Below is a list of UI elements visible on screen, numbered."
MARKS = (
    "The screenshot shows numbered marks on every clickable element. Output a JSON action.\n"
    'For tap/long_press: include {"mark": <int>} from the list.\n'
    "For type: also include text. For scroll: include direction. For navigate_back/navigate_home/wait/done: no mark.\n"
    "Output the action and nothing else."
)
COORDINATES = (
    "You are an Android UI agent. Look at the screenshot and the user's goal, then output the next action as a single JSON object on one line and nothing else. "
    "Use exactly one of these schemas:\n"
    '  {"action": "tap", "x": <0..1>, "y": <0..1>}\n'
    '  {"action": "type", "text": "<string>"}\n'
    '  {"action": "open_app", "app_name": "<string>"}\n'
    '  {"action": "scroll", "direction": "up|down|left|right"}\n'
    '  {"action": "navigate_back"}\n'
    '  {"action": "navigate_home"}\n'
    '  {"action": "wait"}\n'
    '  {"action": "done"}\n'
    "Coordinates are normalized to [0, 1]. Output JSON only.\n\nGoal: "
)
NO_PRIOR = "<none>"


def strip(c: Column) -> Column:
    """Without white space at either end (trim() takes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def decoded(c: Column) -> Column:
    """Bytes as UTF-8, with U+FFFD for what is none."""
    return F.call_function("make_valid_utf8", c.cast("string"))


def coordinate_prompt(goal: Column, grid: int | None = None) -> Column:
    """The coordinate instruction; with `grid`, its variant for location tokens."""
    prefix = COORDINATES
    if grid:
        prefix = prefix.replace('"x": <0..1>, "y": <0..1>}', f'"x": "<loc_x_K>", "y": "<loc_y_K>"}} where K is 0..{grid - 1}').replace("Coordinates are normalized to [0, 1]. ", "")
    return F.concat(F.lit(prefix), goal)


def legend(elements: Column) -> Column:
    """A line for each element (id, label)."""
    return F.array_join(F.transform(elements, lambda e: F.concat(F.lit("  "), e["id"].cast("string"), F.lit(": "), e["label"])), "\n")


def element_prompt(task: Column, elements: Column) -> Column:
    return F.concat(F.lit("Task: "), task, F.lit(f"\n\n{SCHEMA_V1}\n\nElements:\n"), legend(elements))


def mark_prompt(task: Column, marks: Column) -> Column:
    return F.concat(F.lit("Task: "), task, F.lit(f"\n\n{MARKS}\n\nAvailable marks:\n"), legend(marks))


def schema_replaced(prompt: Column) -> Column:
    """The v1 schema block as the v2 one, wherever it stands; a prompt without it is an error."""
    return F.when(F.contains(prompt, F.lit(SCHEMA_V1)), F.replace(prompt, F.lit(SCHEMA_V1), F.lit(SCHEMA_V2))).otherwise(F.raise_error(F.lit("the prompt lacks the v1 schema block")).cast("string"))


def prior_inserted(prompt: Column, prior: Column) -> Column:
    """`Previous action: ...` before the first schema block, after a blank line, else after a line end; else an error."""
    def put(lead: str) -> Column:
        at = F.instr(prompt, lead + ANCHOR)
        return F.when(at > 0, F.concat(F.substring(prompt, F.lit(1), at - 1 + len(lead)), F.lit("Previous action: "), prior, F.lit("\n\n"), F.substring(prompt, at + len(lead), F.length(prompt))))

    return F.coalesce(put("\n\n"), put("\n"), F.raise_error(F.lit("the prompt lacks the schema anchor")).cast("string"))


def message_text(messages: Column, role: str) -> Column:
    """The first text part of the first message of a role; an error if there is none."""
    parts = F.flatten(F.transform(F.filter(messages, lambda m: m["role"] == role), lambda m: F.filter(m["content"], lambda c: c["type"] == "text")))
    return F.coalesce(F.get(parts, F.lit(0))["text"], F.raise_error(F.lit(f"no text of role {role}")).cast("string"))


def messages(user: Column, assistant: Column) -> Column:
    part = lambda c: F.array(F.struct(F.lit("text").alias("type"), c.alias("text")))
    return F.array(F.struct(F.lit("user").alias("role"), part(user).alias("content")), F.struct(F.lit("assistant").alias("role"), part(assistant).alias("content")))


def quoted(c: Column) -> Column:
    """A JSON string, null for null: quotes, backslashes and control characters escaped, everything else kept."""
    return F.when(c.isNotNull(), F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1))


def json_object(pairs: list[tuple[str, Column]]) -> Column:
    """One-line JSON with a space after each colon and comma; pairs whose value is null are left out."""
    items = F.filter(F.array(*[F.concat(F.lit(f'"{k}": '), v) for k, v in pairs]), lambda x: x.isNotNull())
    return F.concat(F.lit("{"), F.array_join(items, ", "), F.lit("}"))


def first_json_flat(text: Column) -> Column:
    """The shortest {...}, if it is a JSON object with an `action`; else null. Nested objects are cut, and so fail."""
    found = F.regexp_extract(text, r"(?s)\{.*?\}", 0)
    return F.when(F.get_json_object(F.when(F.try_parse_json(found).isNotNull(), found), "$.action").isNotNull(), found)


# Fixed value: the fences that are cut off, so that the same texts give the same objects.
_fence = re.compile(r"^```(?:json)?\s*|\s*```$", re.MULTILINE)


def balanced_object(text: str | None) -> str | None:
    """The first balanced {...} that is a non-empty JSON object, by a scan that counts braces: a stray } makes the depth negative."""
    if text is None:
        return None
    depth, opened, body = 0, None, _fence.sub("", text.strip())
    for m in re.finditer(r"[{}]", body):
        if m.group() == "{":
            opened = m.start() if depth == 0 else opened
            depth += 1
            continue
        depth -= 1
        if depth == 0 and opened is not None:
            try:
                value = json.loads(body[opened : m.end()])
            except ValueError:
                opened = None
                continue
            return body[opened : m.end()] if isinstance(value, dict) and value else None
    return None


def first_json_balanced(text: Column) -> Column:
    """balanced_object() of each row, in Arrow batches; no built-in expression counts braces and tests JSON."""
    @F.pandas_udf("string")
    def scan(s: pd.Series) -> pd.Series:
        return s.map(balanced_object)

    return scan(text)


def file_name(episode: Column, step: Column) -> Column:
    """Zero-padded, not cut."""
    return F.format_string("%05d_%02d.png", episode.cast("long"), step.cast("long"))


def cluster(task: Column) -> Column:
    """The first one or two CamelCase words, else Other."""
    return F.coalesce(F.nullif(F.regexp_extract(task, r"^([A-Z][a-z]+(?:[A-Z][a-z]+)?)", 1), F.lit("")), F.lit("Other"))


def place_values(number: Column) -> Column:
    """The place value of each digit of a decimal string: 1, 0.1, 0.01 for 0.29."""
    whole = F.length(F.substring_index(number, ".", 1))
    digits = F.length(F.replace(number, F.lit("."), F.lit("")))
    return F.transform(F.sequence(F.lit(0), digits - 1), lambda i: F.round(F.pow(F.lit(10.0), whole - 1 - i), 10))


def bar(n: Column, most: Column, width: int = 40) -> Column:
    return F.repeat(F.lit("#"), F.when(most > 0, F.floor(n * width / most)).otherwise(0).cast("int"))


_BLOCK = 256


def _let(value: Column, f) -> Column:
    """f(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def sums_before(numbers: Column) -> Column:
    """For each number of an array what those before it add up to, block by block, so the work follows the length."""
    add = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / _BLOCK).cast("int")), lambda i: F.slice(numbers, i * _BLOCK + 1, _BLOCK))
    inner = lambda block, base: F.transform(block, lambda x, j: base + add(F.slice(block, F.lit(1), j)))
    every = lambda b: _let(F.transform(b, add), lambda sums: F.flatten(F.transform(b, lambda block, i: _let(add(F.slice(sums, F.lit(1), i)), lambda base: inner(block, base)))))
    return F.when(F.size(numbers) > 0, _let(blocks, every)).when(numbers.isNotNull(), F.array().cast("array<int>"))


def digit_runs(text: Column, pattern: str = "[0-9]+") -> Column:
    """The longest runs of digits (or other matches of a pattern): an array of (start from 1, digits)."""
    between = F.split(text, pattern, -1)
    steps = F.filter(F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), between, lambda m, g: F.struct(m.alias("m"), F.length(g).alias("gap"))), lambda x: x["m"].isNotNull())
    starts = lambda s: sums_before(F.transform(s, lambda x: x["gap"] + F.length(x["m"])))
    return _let(steps, lambda s: F.zip_with(s, starts(s), lambda x, before: F.struct((before + x["gap"] + 1).alias("start"), x["m"].alias("digits"))))


# How the two coordinates of a target stand in its JSON.
_X, _Y = r'"x":\s*(-?\d*\.?\d+)', r'"y":\s*(-?\d*\.?\d+)'


def coordinate_places(target: Column) -> Column:
    """Where the digits of a tap's coordinates stand in its target text: (tap, found, x, y, x_at, y_at, x_places, y_places), null unless the text is the JSON of a tap with both coordinates in 0 to 1.

    The last two runs of digits and points have to hold the digits of x and y; `found` says whether they do, and the rest is null where they don't. Positions are from 1.
    """
    json = F.try_parse_json(target)
    tap = F.try_variant_get(json, "$.action", "string") == "tap"
    number = lambda p: F.regexp_extract(target, p, 1)
    x, y = number(_X), number(_Y)
    inside = lambda v: v.try_cast("double").between(0.0, 1.0)
    some = F.filter(digit_runs(target, "[0-9.]+"), lambda r: r["digits"].rlike("[0-9]"))
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    at = lambda r: F.transform(digit_runs(r["digits"], "[0-9]"), lambda d: (r["start"] + d["start"] - 1).cast("int"))

    def placed(runs: Column) -> Column:
        a, b = F.get(runs, F.size(runs) - 2), F.get(runs, F.size(runs) - 1)
        found = F.coalesce((F.size(runs) >= 2) & (digits(a["digits"]) == digits(x)) & (digits(b["digits"]) == digits(y)), F.lit(False))
        if_found = lambda c: F.when(found, c)
        return F.struct(found.alias("found"), x.try_cast("double").alias("x"), y.try_cast("double").alias("y"), if_found(at(a)).alias("x_at"), if_found(at(b)).alias("y_at"), if_found(place_values(F.ltrim(x, F.lit("-")))).alias("x_places"), if_found(place_values(F.ltrim(y, F.lit("-")))).alias("y_places"))

    return F.when(F.coalesce(tap & inside(x) & inside(y), F.lit(False)), _let(some, placed))


def png_size(data: Column) -> Column:
    """Width and height in a PNG's header (bytes, or base64 text through unbase64), null for anything else."""
    number = lambda i: F.conv(F.hex(F.substring(data, i, 4)), 16, 10).cast("int")
    return F.when(F.hex(F.substring(data, 1, 8)) == "89504E470D0A1A0A", F.struct(number(17).alias("w"), number(21).alias("h")))
