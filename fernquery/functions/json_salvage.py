"""JSON out of model replies: the first object, a salvage of key-value pairs, or a fenced block."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: how a key and its value look when an object is read loosely.
PAIR = re.compile(r'"?([A-Za-z_]\w*)"?\s*:\s*("(?:[^"\\]|\\.)*"|\{[^{}]*\}|\[[^\],]*|[^,{}\[\]\n]+)')


def first_object(text: str) -> dict | None:
    """The text from the first brace to the one that closes it, read as JSON; null where that fails."""
    start = text.find("{")
    depth = 0
    for at in range(start, len(text)) if start >= 0 else ():
        depth += {"{": 1, "}": -1}.get(text[at], 0)
        if depth == 0:
            try:
                found = json.loads(text[start : at + 1].replace("\n", ""))
            except ValueError:
                return None
            return found if isinstance(found, dict) else None
    return None


def scalar(text: str):
    """A value as it is written: number, truth value, null, nested pairs, else text."""
    text = text.strip().strip(",")
    low = text.lower()
    if low in ("true", "false", "null", "none"):
        return {"true": True, "false": False}.get(low)
    if text.startswith("{"):
        return pairs(text[1:-1])
    if text.startswith("["):
        return text[1:].strip().strip("\"'")
    try:
        return float(text) if "." in text else int(text)
    except ValueError:
        return text.strip("\"'")


def pairs(text: str) -> dict:
    """Key-value pairs found loosely; an array is cut at its first comma."""
    return {m[1]: scalar(m[2]) for m in PAIR.finditer(text)}


def reply_object(text: str | None) -> dict:
    """The first object, else what pairs can be salvaged."""
    return first_object(text or "") or pairs(text or "")


def loose_json(text: str | None):
    """X11: the fenced block, else all, else the first part that reads as JSON; None is null and trailing commas go."""
    text = text or ""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    for part in ([fenced[1]] if fenced else []) + [text]:
        part = re.sub(r",\s*([}\]])", r"\1", part.replace("None", "null")).strip()
        for at in [0, *(m.start() for m in re.finditer(r"[\[{]", part))]:
            try:
                return json.JSONDecoder().raw_decode(part, at)[0]
            except ValueError:
                continue
    return {}


def toc_items(value) -> list[dict]:
    """The list of items in a reply: a list, a wrapper's first list, or a single item."""
    if isinstance(value, dict):
        value = next((v for v in value.values() if isinstance(v, list)), [value] if "title" in value else [])
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []


def _column(fn, x: Column) -> Column:
    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([json.dumps(fn(t), sort_keys=True, ensure_ascii=False) for t in texts.to_pylist()], pa.string())

    return run(x)


def salvaged(x: Column) -> Column:
    """X10 as JSON text."""
    return _column(reply_object, x)


def loosely_read(x: Column) -> Column:
    """X11 as JSON text."""
    return _column(loose_json, x)


def read_toc(x: Column) -> Column:
    """X11 and X37 as JSON text."""
    return _column(lambda t: toc_items(loose_json(t)), x)
