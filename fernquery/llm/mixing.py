"""Mixing sources to target weights by weighted fair queueing.

Within each source the documents stand in a shuffled order that depends only on
their ids and texts' sizes. A document's virtual finish time is the source's words
up to and including it, divided by the source's target; a source whose target
exceeds its size is queued again, up to ``max_repeats`` times in all. As in fair
queueing over packets, a long document is queued in packets of at most 64 words, so
that sources keep close to their targets whatever their documents' lengths. All
packets are then ordered by finish time and the order is cut where the total budget
is reached; the document at the cut is taken in part.

The running sums are made in blocks: words per (source, block of the shuffled
order) first, then within the blocks, so a source that holds a third of all rows is
spread over many tasks. The cut is found the same way, over blocks of finish times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernquery.llm.common import SPACE, stored

#: Bits of the shuffled order that number its blocks.
BLOCK_BITS = 12
#: Words of a packet: the grain at which sources take turns.
PACKET = 64
#: Ranges of finish times into which the queue is divided, and how often the one with the cut is divided again.
RANGES, LEVELS = 1024, 3


def word_count(text) -> F.Column:
    """Number of runs of characters other than white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE[1:]}+")), F.lit(0)).cast("long")


def targets(sizes: dict, weights: list[float], share: float, max_repeats: int) -> dict:
    """Words wanted of each source: ``share`` of all words, dealt by weight.

    Sources are ranked by code point, null last; weights repeat along the ranks. A
    target stops at ``max_repeats`` times its source's size and the excess is dealt
    again by weight among the others until none is above.
    """
    ranked = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(ranked)}
    budget, out, free = share * sum(sizes.values()), {}, [s for s in ranked if sizes[s] > 0]
    out = {s: 0.0 for s in ranked}
    while free:
        left = budget - sum(out[s] for s in ranked if s not in free)
        total = sum(weight[s] for s in free)
        want = {s: left * weight[s] / total for s in free}
        above = [s for s in free if want[s] > max_repeats * sizes[s]]
        if not above:
            return out | want
        for s in above:
            out[s] = float(max_repeats * sizes[s])
        free = [s for s in free if s not in above]
    return out


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, max_repeats: int = 3, seed: int = 7) -> DataFrame:
    """How much of each document the mix takes.

    Returns one row per input row: id, ``source``, ``size`` (words), ``source_size``,
    ``target`` of its source and ``taken``, the words that the mix takes of it, repeats
    counted: up to ``max_repeats`` times its size. Null and empty texts have size 0 and are never taken.
    A null source is a source of its own, ranked last. Repeated rows are documents
    each; their order among themselves does not show in the result. An empty table gives an empty result.

    What reaches the driver is one row per source.
    """
    text = F.col(text_col)
    rows = stored(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), word_count(text).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), text).alias("draw")), "mix_rows")
    rows = rows.withColumn("block", F.shiftrightunsigned("draw", 64 - BLOCK_BITS).cast("int"))
    sizes = {r["_source"]: r["n"] for r in rows.groupBy("_source").agg(F.sum("size").alias("n")).collect()}
    target = targets(sizes, list(weights), share, max_repeats)
    budget = round(sum(target.values()))
    spark = docs.sparkSession
    plan = spark.createDataFrame([(s, int(sizes[s]), float(target[s])) for s in sizes], "_source string, source_size long, target double")

    per_block = rows.groupBy("_source", "block").agg(F.sum("size").alias("n"))
    before = per_block.select("_source", "block", (F.sum("n").over(Window.partitionBy("_source").orderBy("block")) - F.col("n")).alias("before"))
    inner = Window.partitionBy("_source", "block").orderBy("draw", "_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("inner", F.sum("size").over(inner))
    same = lambda a, b: a["_source"].eqNullSafe(b["_source"])
    placed = summed.join(before, same(summed, before) & (summed["block"] == before["block"])).select(summed["_id"], summed["_source"], summed["size"], summed["draw"], (F.col("inner") + F.col("before")).alias("end"))
    placed = placed.join(F.broadcast(plan), same(placed, plan)).select("_id", placed["_source"], "size", "draw", "end", "source_size", "target")
    placed = stored(placed, "mix_placed")

    taken = _taken(placed, budget, max_repeats)
    out = placed.join(taken, placed["_id"].eqNullSafe(taken["c_id"]) & (placed["draw"] == taken["c_draw"]) & (placed["end"] == taken["c_end"]), "left")
    return out.select(F.col("_id").alias(id_col), F.col("_source").alias("source"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def packets(placed: DataFrame, max_repeats: int) -> DataFrame:
    """The queue: each document's words in packets of at most PACKET words, with finish times."""
    rounds = F.least(F.lit(max_repeats), F.ceil(F.col("target") / F.col("source_size"))).cast("int")
    queue = placed.filter("size > 0 and target > 0").select("_id", "draw", "size", "end", "source_size", "target", F.explode(F.sequence(F.lit(0), rounds - 1)).alias("round"))
    queue = queue.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(PACKET).cast("long"))).alias("at"))
    words = F.least(F.lit(PACKET).cast("long"), F.col("size") - F.col("at"))
    finish = (F.col("round") * F.col("source_size") + F.col("end") - F.col("size") + F.col("at") + words) / F.col("target")
    return queue.select("_id", "draw", "end", "round", "at", words.alias("words"), finish.alias("finish"))


def _taken(placed: DataFrame, budget: int, max_repeats: int) -> DataFrame:
    """Words taken of each document that is taken at all: the first ``budget`` words of the queue in order of finish time.

    The order is cut by ranges: words per range of finish times give the range in
    which the budget is reached, that range is divided again, and what is left of
    it, a few packets, is sorted.
    """
    queue, low, high, before = packets(placed, max_repeats), 0.0, 2.0, 0
    for _ in range(LEVELS):
        width = (high - low) / RANGES
        inside = queue.filter((F.col("finish") >= low) & (F.col("finish") < high))
        ranges = inside.groupBy(F.floor((F.col("finish") - low) / width).cast("int").alias("slot")).agg(F.sum("words").alias("n"))
        run = ranges.select("slot", (F.lit(before) + F.sum("n").over(Window.orderBy("slot"))).alias("upto"), "n")
        edge = run.filter(F.col("upto") > budget).orderBy("slot").limit(1).first()
        if edge is None:
            break
        low, high, before = low + edge["slot"] * width, low + (edge["slot"] + 1) * width, edge["upto"] - edge["n"]
    whole = queue.filter(F.col("finish") < low)
    order = Window.orderBy("finish", "draw", "_id", "end", "round", "at").rowsBetween(Window.unboundedPreceding, 0)
    border = queue.filter((F.col("finish") >= low) & (F.col("finish") < high)).withColumn("upto", F.lit(before) + F.sum("words").over(order))
    border = border.withColumn("words", F.least("words", F.lit(budget) - F.col("upto") + F.col("words"))).filter("words > 0").drop("upto")
    chosen = whole.unionByName(border)
    return chosen.groupBy(F.col("_id").alias("c_id"), F.col("draw").alias("c_draw"), F.col("end").alias("c_end")).agg(F.sum("words").alias("taken"))
