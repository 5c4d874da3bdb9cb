"""Extraction records: parsing of model replies, checks, retries and continuations."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernquery.functions.text import BROKEN_DELIMITERS, PLACEHOLDER_TYPES, clean, is_number, normalise_field, split_markers, strip, unescape_each

# The delimiters of the record format.
TUPLE, RECORD, COMPLETE = "<|>", "##", "<|COMPLETE|>"
MAX_TRIES = 3


def records(replies: DataFrame, reply_col: str = "response", key_col: str = "source_id") -> DataFrame:
    """M1: ``(key, ord, fields)``: what stands in the first parentheses of each record, on one line, cut at the delimiter, blanks dropped."""
    rows = replies.select(key_col, F.posexplode(split_markers(F.coalesce(F.col(reply_col), F.lit("")), [RECORD, COMPLETE])).alias("ord", "r"))
    inner = F.regexp_extract("r", r"(?d)\((.*)\)", 1)
    return rows.select(key_col, "ord", inner.alias("inner")).filter("inner <> ''").select(key_col, "ord", split_markers(F.col("inner"), [TUPLE]).alias("fields")).withColumn("clean", normalised_fields(F.col("fields")))


def normalised_fields(fields: Column) -> Column:
    """X4 for each of an array's texts; entities are resolved before and after, as for a single text."""
    once = F.transform(unescape_each(fields), lambda x: normalise_field(x, entities=False))
    return F.transform(unescape_each(once), lambda x: clean(x, entities=False))


def _field(n: int) -> Column:
    return F.get("clean", F.lit(n))


def entities(parsed: DataFrame, key_col: str = "source_id") -> DataFrame:
    """M2: entity records of three fields or more, with a name.

    Names are upper case, types lower case. Of three fields, the last may hold type and
    description around a broken delimiter; if it doesn't, the type is unknown.
    """
    rows = parsed.filter((F.size("fields") >= 3) & (F.lower(_field(0)) == "entity")).select(key_col, "ord", F.upper(_field(1)).alias("entity_name"), _field(2).alias("third"), F.when(F.size("fields") >= 4, _field(3)).alias("fourth"))
    kind, told = F.lit("unknown"), F.col("third")
    for mark in reversed(BROKEN_DELIMITERS):
        at = F.locate(mark, F.col("third"))
        left, right = normalise_field(F.col("third").substr(F.lit(1), at - 1), entities=False), normalise_field(F.col("third").substr(at + len(mark), F.length("third")), entities=False)
        found = (at > 0) & (left != "") & (right != "")
        kind, told = F.when(found, F.lower(left)).otherwise(kind), F.when(found, right).otherwise(told)
    whole = F.col("fourth").isNotNull()
    out = rows.filter(strip("entity_name") != "").select(key_col, "ord", "entity_name", F.when(whole, F.lower("third")).otherwise(kind).alias("entity_type"), F.when(whole, F.col("fourth")).otherwise(told).alias("description"))
    return out.withColumn("entity_type", F.when(strip("entity_type") == "", "unknown").otherwise(F.col("entity_type")))


def relations(parsed: DataFrame, key_col: str = "source_id") -> DataFrame:
    """M3: relation records of five fields or more; the weight is the last field if it is a bare number, else 1."""
    rows = parsed.filter((F.size("fields") >= 5) & (F.lower(_field(0)) == "relationship"))
    last = F.element_at("fields", -1)
    return rows.select(key_col, "ord", F.upper(_field(1)).alias("src"), F.upper(_field(2)).alias("dst"), F.when(is_number(last), last.cast("double")).otherwise(1.0).alias("weight"), _field(3).alias("description"))


def parse_failed(reply: Column, n_parsed: Column) -> Column:
    """nothing was parsed from a reply that is blank or looks like records or JSON."""
    low = F.lower(F.coalesce(reply, F.lit("")))
    signs = F.lit(False)
    for s in ("```", "{", "[", "entity", "relationship"):
        signs = signs | F.contains(low, F.lit(s))
    return (n_parsed == 0) & ((strip(low) == "") | signs | (F.contains(low, F.lit(TUPLE)) & (F.contains(low, F.lit("(")) | F.contains(low, F.lit(")")))))


def flag_missing(found: DataFrame, section: Column) -> DataFrame:
    """entities without a section are set apart by ``quarantined``, those without a type by ``untyped``, instead of stopping the run."""
    return found.withColumns({"untyped": F.lower(strip("entity_type")).isin(*PLACEHOLDER_TYPES), "quarantined": F.coalesce(strip(section), F.lit("")) == ""})


def complete_all(prompts: DataFrame, make: Callable[[], Callable[[list[str]], list[str]]], accept: Callable[[str], bool] | None = None, tries: int = MAX_TRIES, *, key_col: str = "source_id", prompt_col: str = "prompt", batch: int = 32) -> DataFrame:
    """``(key, response, tries)`` from a model; ``make()`` opens one client per task.

    A reply that ``accept`` refuses is asked for again, ``tries`` times in all; the last
    is kept.
    """

    def run(batches):
        ask = make()
        for b in batches:
            keys, texts = b[0].to_pylist(), b[1].to_pylist()
            for at in range(0, len(keys), batch):
                replies, counts, open_ = [""] * len(keys[at : at + batch]), [0] * len(keys[at : at + batch]), list(range(len(keys[at : at + batch])))
                for _ in range(tries):
                    for i, reply in zip(open_, ask([texts[at + i] for i in open_])):
                        replies[i], counts[i] = reply, counts[i] + 1
                    open_ = [i for i in open_ if accept is not None and not accept(replies[i])]
                    if not open_:
                        break
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + batch], pa.string()), pa.array(replies, pa.string()), pa.array(counts, pa.int32())], names=["key", "response", "tries"])

    return prompts.select(F.col(key_col).cast("string"), prompt_col).mapInArrow(run, f"{key_col} string, response string, tries int")


def glean_all(prompts: DataFrame, make: Callable[[], Callable[[list[str]], list[str]]], rounds: int, more: str, check: str, *, key_col: str = "source_id", prompt_col: str = "prompt") -> DataFrame:
    """M6: the first reply and, as long as the model says yes to ``check``, up to ``rounds`` continuations. It is asked before each."""

    def run(batches):
        ask = make()

        def wanted(history: str) -> bool:
            return ask([history + "\n" + check])[0].strip().strip('"').strip("'").lower() == "yes"

        for b in batches:
            out = []
            for prompt in b[1].to_pylist():
                text = ask([prompt])[0]
                history = prompt + "\n" + text
                for _ in range(rounds):
                    if not wanted(history):
                        break
                    reply = ask([history + "\n" + more])[0]
                    history += "\n" + more + "\n" + reply
                    text += reply
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(b[0].to_pylist(), pa.string()), pa.array(out, pa.string())], names=["key", "response"])

    return prompts.select(F.col(key_col).cast("string"), prompt_col).mapInArrow(run, f"{key_col} string, response string")
