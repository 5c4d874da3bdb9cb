"""Scalar functions over text, as column expressions.

"""

from __future__ import annotations

import html
import re
from collections.abc import Collection

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns that results depend on.
PLACEHOLDER_TYPES = ("", "unknown", "unk", "n/a", "na", "none", "null", "未知")
PLACEHOLDER_DESCRIPTIONS = ("", "unknown", "n/a", "none", "null")
DEFAULT_TITLE = "Section Chunk"
TRUTHY = ("1", "true", "yes", "y")
ARROWS = ("->", "→", "=>", "-")
PAIR_SEPARATORS = r"[\n;；]+"
LEADERS, SPACED_LEADERS = r"\.{5,}", r"(?:\. ){5,}\.?"
BROKEN_DELIMITERS = ("|>", "｜>")
TERM_SEPARATORS = r"[\n,;，；]+"
CONTROL = r"[\x00-\x1F\x7F-\x{9F}]"
SEARCH_TOKEN = r"[A-Za-z0-9_]+|[一-鿿]"
NUMBER = r"^[-+]?[0-9]*\.?[0-9]+$"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space, of any script, at either end."""
    return F.regexp_replace(col(x), r"(?U)^\s+|\s+\z", "")


def prefixed_md5(x: Column, prefix: str) -> Column:
    """Prefix and md5 of the text."""
    return F.concat(F.lit(prefix), F.md5(x))


def args_hash(*parts: Column) -> Column:
    """md5 of the arguments' JSON."""
    return F.md5(F.to_json(F.struct(*[p.alias(f"a{i}") for i, p in enumerate(parts)])))


def drop_controls(x: Column) -> Column:
    return F.regexp_replace(x, CONTROL, "")


def unescape_html(x: Column, only: Collection[str] | None = None) -> Column:
    """HTML entities resolved; there is no built-in function for it.

    Those that no semicolon ends are resolved too, where HTML allows it. With ``only``, names such
    as ``amp`` or ``#39``, just these are, and only where a semicolon ends them.
    """
    closed = None if only is None else "&(?:" + "|".join(map(re.escape, only)) + ");"

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        resolved = html.unescape if closed is None else lambda t: re.sub(closed, lambda m: html.unescape(m[0]), t)
        return pa.array([None if t is None else resolved(t) for t in texts.to_pylist()], pa.string())

    return run(x)


def unescape_each(x: Column) -> Column:
    """HTML entities resolved in each text of an array."""

    @F.arrow_udf("array<string>")
    def run(lists: pa.Array) -> pa.Array:
        return pa.array([None if r is None else [t if t is None or "&" not in t else html.unescape(t) for t in r] for r in lists.to_pylist()], pa.list_(pa.string()))

    return run(x)


def clean(x: Column, entities: bool | Collection[str] = True) -> Column:
    """Strip, resolve HTML entities (all, none, or just those named), delete control characters, line ends included."""
    x = strip(x)
    if entities:
        x = unescape_html(x, None if entities is True else entities)
    return drop_controls(x)


def let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once per row and named once in the plan."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _peel(x: Column) -> Column:
    """Without one layer of quotes around it."""
    return F.regexp_replace(x, r"""(?s)^(?:"(.*)"|'(.*)')\z""", "$1$2")


def normalise_field(x: Column, entities: bool = True) -> Column:
    """Clean, peel up to two layers of quotes, then one dangling quote at either end.

    Inside a function over arrays, where no Python can run, ``entities`` must be False;
    ``unescape_each`` resolves them beforehand.
    """
    two = let(_peel(strip(clean(x, entities))), lambda y: _peel(strip(y)))
    tail = let(strip(two), lambda y: F.regexp_replace(y, r"""(?s)^(?:([^"].*)"|([^'].*)'|["'])\z""", "$1$2"))
    head = let(strip(tail), lambda y: F.regexp_replace(y, r"""(?s)^(?:"(.*[^"])|'(.*[^']))\z""", "$1$2"))
    return clean(head, entities)


def split_markers(x: Column, markers: list[str]) -> Column:
    """Split at any of the literal markers, strip, drop blanks (later positions move up)."""
    pattern = "|".join(re.escape(m) for m in markers)
    return F.filter(F.transform(F.split(x, pattern), strip), lambda p: p != "")


def is_number(x: Column) -> Column:
    """Sign, digits, optional point; no exponent, no trailing point."""
    return F.coalesce(x.rlike(NUMBER), F.lit(False))


def enclosed(x: Column) -> Column:
    """Numbers bare, anything else in double quotes with its own outer quotes removed."""
    bare = F.regexp_replace(strip(F.coalesce(x, F.lit(""))), r'^"+|"+\z', "")
    return F.when(is_number(bare), bare).otherwise(F.concat(F.lit('"'), bare, F.lit('"')))


def unfenced(x: Column) -> Column:
    """What stands in a ```json fence, or all of it."""
    inner = F.regexp_extract(x, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.when(inner != "", inner).otherwise(strip(x))


def search_tokens(x: Column) -> Column:
    """Lower-cased Latin words and numbers, and single CJK characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(SEARCH_TOKEN), 0)


def level_id(name: Column, level: Column) -> Column:
    """Node id of a name at a level."""
    return F.concat(name, F.lit("::level::"), level.cast("string"))


def level_of(node_id: Column) -> Column:
    return F.regexp_extract(node_id, r"(?s)^.*::level::(-?[0-9]+)\z", 1).try_cast("int")


def name_of(node_id: Column) -> Column:
    return F.regexp_replace(node_id, r"(?s)::level::(?!.*::level::).*\z", "")


def section_key(doc: Column, section: Column) -> Column:
    """Document and section, unless the section has the document's prefix already."""
    return F.when(F.startswith(section, F.concat(doc, F.lit("-"))), section).otherwise(F.concat(doc, F.lit("-"), section))


def section_list(x: Column, separator: str | None = None) -> Column:
    """A JSON list, or a single text, as a list without blanks; a ``separator`` cuts a text that is no list."""
    one = F.array(x) if separator is None else F.split(F.coalesce(x, F.lit("")), re.escape(separator))
    return F.filter(F.transform(F.coalesce(F.from_json(x, "array<string>"), one), strip), lambda s: s.isNotNull() & (s != ""))


def query_terms(x: Column) -> Column:
    """Terms between line ends, commas and semicolons, of either width."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), TERM_SEPARATORS), strip), lambda t: t != "")


def relation_ends(x: Column) -> Column:
    """(head, tail) around the first arrow marker found, tried in order; null where there is none, or nothing on one side of it."""
    none = F.lit(None).cast("struct<head:string,tail:string>")
    out = none
    for arrow in reversed(ARROWS):
        at = F.locate(arrow, x)
        pair = F.struct(strip(x.substr(F.lit(1), at - 1)).alias("head"), strip(x.substr(at + len(arrow), F.length(x))).alias("tail"))
        out = F.when(at > 0, pair).otherwise(out)
    return F.when((out["head"] != "") & (out["tail"] != ""), out).otherwise(none)


def relation_pairs(x: Column) -> Column:
    """The (head, tail) pairs of a text with several, one per line or between semicolons of either width."""
    parts = F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), PAIR_SEPARATORS), strip), lambda r: r != "")
    return F.filter(F.transform(parts, relation_ends), lambda p: p.isNotNull())


def entity_type(x: Column, unknown: str = "unknown") -> Column:
    """Lower-cased; placeholders become ``unknown``."""
    low = F.lower(strip(F.coalesce(x, F.lit(""))))
    return F.when(low.isin(*PLACEHOLDER_TYPES), unknown).otherwise(low)


def squeezed(x: Column) -> Column:
    """Lower-cased, without any white space."""
    return F.regexp_replace(F.lower(x), r"\s+", "")


def dot_leaders(x: Column) -> Column:
    """Five or more dots, adjoining or spaced, become a colon."""
    return F.regexp_replace(F.regexp_replace(x, LEADERS, ": "), SPACED_LEADERS, ": ")


def page_tag(x: Column) -> Column:
    """The number in a page tag such as <physical_index_12>, or a plain number."""
    return F.regexp_extract(F.coalesce(x, F.lit("")), r"(?:physical_index_|^\s*)([0-9]+)", 1).try_cast("int")


def without_page_tags(x: Column) -> Column:
    """The text without its page tags."""
    return F.regexp_replace(x, r"</?physical_index_[0-9]+>", "")


def without_first_page(x: Column) -> Column:
    """The text without what stands from its first page tag up to the end of the next; a text with fewer than two stays."""
    span = F.regexp_extract(x, r"(?s)<physical_index_[0-9]+>.*?<physical_index_[0-9]+>", 0)
    start = F.instr(x, span)
    return F.when(span == "", x).otherwise(F.concat(x.substr(F.lit(1), start - 1), x.substr(start + F.length(span), F.length(x))))


def page_tags(x: Column) -> Column:
    """All page numbers that a tagged text names, in order."""
    return F.transform(F.regexp_extract_all(x, F.lit(r"physical_index_([0-9]+)"), 1), lambda n: n.cast("int"))


def chunk_title(x: Column, most: int = 80, default: str = DEFAULT_TITLE) -> Column:
    """The first line without leading digits and signs, cut to ``most`` characters; ``default`` where nothing is left, and for null."""
    line = strip(F.regexp_replace(strip(F.substring_index(strip(F.coalesce(x, F.lit(""))), "\n", 1)), r"(?U)^[\d\W_]+", ""))
    return F.substring(F.when(line == "", default).otherwise(line), 1, most)


def file_name(x: Column) -> Column:
    """Without characters that file systems refuse."""
    return F.regexp_replace(x, r"[/\\:*?\"<>|\x00]", "-")


def truthy(x: Column) -> Column:
    """F9."""
    return F.lower(strip(F.coalesce(x, F.lit("")))).isin(*TRUTHY)


def safe_int(x: Column, default: int = 0) -> Column:
    """X35."""
    return F.coalesce(x.try_cast("int"), F.lit(default))


def safe_double(x: Column, default: float = 0.0) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(default))


def structure_key(x: Column) -> Column:
    """Sort key of a dotted number; parts that are no numbers come last."""
    return F.transform(F.split(x, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(1_000_000_000)))


def graph_level(level: Column) -> Column:
    """Structural from level 1 on, content below."""
    return F.when(level >= 1, "structural").otherwise("content")


def messages(*texts: Column) -> Column:
    """Alternating user and assistant messages."""
    return F.array(*[F.struct(F.lit("user" if i % 2 == 0 else "assistant").alias("role"), t.alias("content")) for i, t in enumerate(texts)])
