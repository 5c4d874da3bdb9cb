"""Exact set-similarity join of whole texts: every pair with a Jaccard similarity of ``least`` or more is linked.

Each text is the set of its shingles' hashes. All sets are sorted in one order, the
shingles that a sample finds in many texts last. Two sets with a similarity of t share
one of the first ``n - ceil(t n) + 1`` shingles of each, so only texts that meet in such
a prefix are compared. The sample decides the order alone, and so the cost: any order
gives the same pairs.

A group of near copies would give pairs by the square of its size. So texts are compared,
in rounds, with one leader of their size for each shingle, drawn anew in each round, as long
as that links components that were apart; a round has no more pairs than prefixes have
shingles. Only then are the pairs looked for that are left between components that
are still apart, and of those only the ones whose parity signatures allow the similarity: a
shingle that one set alone has flips one bit, so sets whose signatures differ in more bits than
their sizes allow shingles to differ cannot be similar. No link between components is lost.

Of the pairs that a round compares, too, those whose signatures do not allow the similarity
are left out before whole sets are fetched. Long sets have a second, wider signature for that,
as nearly every bit of the first is drawn at random there.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernquery.llm.common import components, drop_stored, stored

#: Texts of the sample, about; shingles of it that are put last, at most, and the sampled texts that hold one at least.
SAMPLE, MAX_COMMON, LEAST_HELD = 20_000, 200_000, 3
#: Texts in candidate pairs up to which they are broadcast.
MAX_COMPARED = 500_000
#: 64-bit words of a signature, and of the second one of sets of more than LONG shingles.
SIGNATURE, WIDE, LONG = 16, 256, 1024
#: Of the pairs that a round compares, the share that must be links for another round to follow.
WORTH = 0.1


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles, A-Z lower-cased; a text of fewer words is one shingle."""
    words = text.lower().split() if text else []
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams), dtype=np.uint64))


def signature(hashes: np.ndarray, words: int = SIGNATURE) -> np.ndarray:
    """Parity of how many hashes fall on each of 64 * words places."""
    odd = np.bincount((hashes >> np.uint64(32)).astype(np.int64) % (64 * words), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def shingles(text: Column, shingle: int) -> Column:
    @F.arrow_udf("array<bigint>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t, shingle).view(np.int64) for t in texts.cast(pa.binary()).to_pylist()], pa.list_(pa.int64()))

    return run(text)


def _common(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, sampled texts that hold them) of the shingles that go last."""
    every = max(1, texts.count() // SAMPLE)
    sample = texts.filter(F.pmod("part", F.lit(every)) == 0).select("part", shingles(F.col("text"), shingle).alias("s")).groupBy("part").agg(F.min("s").alias("s"))
    often = sample.select(F.explode("s").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_HELD)
    rows = often.orderBy(F.desc("n"), "k").limit(MAX_COMMON).toPandas()
    k = rows["k"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(k)
    return k[order], rows["n"].to_numpy(np.int64)[order]


def _prefixes(texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """``(part, n, bits, wide, keys)``: size and signatures of each distinct text's set (wide is null for short ones), and its prefix in the common order."""
    shared = texts.sparkSession.sparkContext.broadcast(_common(texts, shingle))

    @F.arrow_udf("struct<n:bigint,bits:array<bigint>,wide:array<bigint>,keys:array<bigint>>")
    def run(batch: pa.Array) -> pa.Array:
        often, held = shared.value
        sizes, bits, wide, keys = [], [], [], []
        for t in batch.cast(pa.binary()).to_pylist():
            s = shingle_set(t, shingle)
            at = np.minimum(np.searchsorted(often, s), max(0, len(often) - 1))
            rank = np.where(often[at] == s, held[at], 0) if len(often) else np.zeros(len(s), np.int64)
            most = len(s) - int(np.ceil(least * len(s) - 1e-9)) + 1
            sizes.append(len(s))
            bits.append(signature(s))
            wide.append(signature(s, WIDE) if len(s) > LONG else None)
            keys.append(s[np.lexsort((s, rank))][:most].view(np.int64))
        lists = (pa.array(x, pa.list_(pa.int64())) for x in (bits, wide, keys))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), *lists], ["n", "bits", "wide", "keys"])

    return texts.select("part", run(F.col("text")).alias("p")).groupBy("part").agg(F.min("p").alias("p")).select("part", "p.n", "p.bits", "p.wide", "p.keys")


def _allowed(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs ``(a, b)`` whose sizes and signatures allow the similarity."""
    signed = sets.select("part", F.struct("n", "bits", "wide").alias("s"))
    both = pairs.join(signed.toDF("a", "sa"), "a").join(signed.toDF("b", "sb"), "b")

    def near(bits: str) -> Column:
        flips = F.aggregate(F.zip_with(f"sa.{bits}", f"sb.{bits}", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), add)
        return flips * (1 + least) <= (1 - least) * (F.col("sa.n") + F.col("sb.n")) + 1e-6

    return both.filter(near("bits") & F.coalesce(near("wide"), F.lit(True))).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs ``(a, b)`` whose whole sets are similar."""
    met = stored(pairs.select(F.explode(F.array("a", "b")).alias("part")).distinct(), "similar_met")
    if met.count() <= MAX_COMPARED:
        met = F.broadcast(met)
    sets = stored(texts.join(met, "part").select("part", shingles(F.col("text"), shingle).alias("s")).groupBy("part").agg(F.min("s").alias("s")), "similar_sets")
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").withColumn("n", F.size(F.array_intersect("sa", "sb")))
    out = stored(both.filter(F.col("n") >= least * (F.size("sa") + F.size("sb") - F.col("n"))).select("a", "b"), "similar_links")
    drop_stored(sets)
    return out


def similar_links(texts: DataFrame, shingle: int, least: float, known: DataFrame | None = None) -> DataFrame:
    """Links ``(a, b)`` between texts of ``texts(part, text)`` that join the same components as all pairs with a similarity of ``least`` would.

    ``part`` identifies a text; rows may repeat. A null or empty text, or one of fewer words than a shingle
    has, is one shingle. ``least`` is above 0. With ``known(a, b)``, links found before, only links between components
    that these leave apart are looked for and returned.
    """
    sets = stored(_prefixes(texts, shingle, least), "prefixes")
    posted = sets.select("part", "n", F.posexplode("keys").alias("pos", "key"))
    met = posted.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1").select("key")
    held = stored(posted.join(met, "key"), "postings")

    def able(a: str, b: str) -> Column:
        """What the sizes, and the places of the first shingle that both have, leave possible."""
        n, m, i, j = (F.col(x) for x in (f"{a}.n", f"{b}.n", f"{a}.pos", f"{b}.pos"))
        return F.least(n - i, m - j) * (1 + least) >= least * (n + m) - 1e-6

    def differing(a: str, b: str) -> Column:
        """Bits in which the signatures differ."""
        return reduce(add, (F.bit_count(F.col(f"{a}.bits")[k].bitwiseXOR(F.col(f"{b}.bits")[k])) for k in range(SIGNATURE)))

    def rooted(found: list[DataFrame]) -> DataFrame:
        """The postings with the components of their texts so far."""
        roots = stored(components(reduce(DataFrame.unionByName, found).toDF("u", "v")).withColumnRenamed("node", "part"), "similar_roots")
        few = F.broadcast(roots) if roots.count() <= MAX_COMPARED else roots
        return held.join(few, "part", "left").withColumn("root", F.coalesce("root", "part"))

    known = [] if known is None else [known]
    found, left, k = [], rooted(known) if known else held.withColumn("root", F.col("part")), 0
    while True:
        size = F.floor(F.log(F.col("n").cast("double")) / float(-np.log(min(least, 0.99))) + 0.5 * (k % 2))
        led = left.withColumn("size", size)
        drawn = F.min(F.struct(F.xxhash64("key", "part", F.lit(k)).alias("drawn"), "part", "root", "n", "pos")).alias("l")
        first = led.groupBy("key", "size").agg(drawn).select("key", "size", "l.*")
        pairs = led.alias("x").join(first.alias("y"), ["key", "size"]).filter((F.col("x.root") != F.col("y.root")) & able("x", "y"))
        pairs = stored(pairs.select(F.least("x.part", "y.part").alias("a"), F.greatest("x.part", "y.part").alias("b")).distinct(), "led_pairs")
        compared = pairs.count()
        able_pairs = stored(_allowed(pairs, sets, least), "able_pairs")
        found.append(_verified(able_pairs, texts, shingle, least))
        drop_stored(pairs)
        drop_stored(able_pairs)
        linked = found[-1].count()
        if linked:
            left = rooted(known + found)
        if linked <= WORTH * compared:
            break
        k += 1
    mixed = left.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    signed = stored(left.join(mixed, "key").join(sets.select("part", "bits"), "part"), "signed_postings")
    near = differing("x", "y") * (1 + least) <= (1 - least) * (F.col("x.n") + F.col("y.n")) + 1e-6
    pairs = signed.alias("x").join(signed.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.part") < F.col("y.part")) & (F.col("x.root") != F.col("y.root")) & able("x", "y") & near)
    rest = stored(pairs.select(F.col("x.part").alias("a"), F.col("y.part").alias("b")).distinct(), "rest_pairs")
    drop_stored(signed)
    drop_stored(held)
    able_pairs = stored(_allowed(rest, sets, least), "able_pairs")
    drop_stored(sets)
    found.append(_verified(able_pairs, texts, shingle, least))
    return reduce(DataFrame.unionByName, found)
