"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits. It is cut into segments; of two fingerprints that
differ in at most ``max_bits`` bits, some segment differs in at most
``max_bits // segments`` bits. Each fingerprint therefore enumerates the small
Hamming ball of each of its segments, fetches the fingerprints stored under those
values, and the complete distance decides.

Only distinct fingerprints are compared, so copies cost one row in the index
however many there are. A pair is probed from one side (the one that has 0 in the
highest differing bit of the segment) and reported by the first segment that can
find it, so it appears once without a distinct.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernquery.llm.common import components, joined, stored
from fernquery.llm.set_similarity import shingles, similar_links

#: Hashes whose bits are counted together; bytes of text that are cut into words together.
_CHUNK, _WINDOW = 1 << 15, 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")
#: Fingerprints in candidate pairs, or rows to be left out, up to which they are broadcast.
MAX_COMPARED = 500_000


def _grams(text: bytes, shingle: int) -> Iterator[list[bytes]]:
    """The shingles of a text, some windows of words at a time; of fewer words, the whole sequence."""
    words, whole, at = [], True, 0
    while at < len(text):
        gap = _GAP.search(text, at + _WINDOW)
        stop = gap.start() if gap else len(text)
        words += text[at:stop].lower().split()
        at = stop
        if len(words) >= shingle:
            yield list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
            words, whole = words[len(words) - shingle + 1 :], False
    if whole and words:
        yield [b" ".join(words)]


def simhash(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text, as an unsigned number; 0 where it has no word."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for grams in _grams(text or b"", shingle):
        n += len(grams)
        hashes = np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), dtype="<u8", count=len(grams))
        for at in range(0, len(hashes), _CHUNK):
            part = hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprint(text: Column, shingle: int = 3, seed: int = 42) -> Column:
    """SimHash of whole texts as a signed 64-bit column; null and empty texts give 0."""

    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        out = [simhash(t, shingle, seed) for t in texts.cast(pa.binary()).to_pylist()]
        return pa.array(np.array(out, dtype=np.uint64).view(np.int64))

    return run(text)


def _segments(count: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment."""
    cuts = [64 * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _ball(width: int, radius: int) -> list[tuple[int, int]]:
    """(mask, its highest bit) of every change of at most ``radius`` bits."""
    return [(sum(1 << b for b in bits), 1 << max(bits) if bits else 0) for r in range(radius + 1) for bits in combinations(range(width), r)]


def near_pairs(prints: DataFrame, max_bits: int = 2, segments: int = 2, leaders: bool = False) -> DataFrame:
    """All pairs ``(a, b)``, once each, of distinct fingerprints ``fp`` within ``max_bits`` bits.

    ``prints`` must hold each ``fp`` once. Equal fingerprints are not a pair. Where
    ``prints`` has a column ``root``, pairs of equal roots are left out. With ``leaders``,
    only pairs with the smallest fingerprint of a table entry are found, no more of them
    than there are probes.
    """
    rooted = "root" in prints.columns
    prints = prints.select("fp", *(["root"] if rooted else [F.lit(None).cast("long").alias("root")]))
    radius = max_bits // segments
    cut = _segments(segments)

    def value(fp: Column, k: int) -> Column:
        first, width = cut[k]
        return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))

    def key(v: Column, k: int) -> Column:
        return v.bitwiseOR(F.lit(k << 56).cast("long"))

    stored_side = prints.select(F.col("fp").alias("b"), F.col("root").alias("root_b"), F.explode(F.array(*(key(value(F.col("fp"), k), k) for k in range(segments)))).alias("key"))
    probes = None
    for k in range(segments):
        ball = F.explode(F.array(*(F.struct(F.lit(m).cast("long").alias("m"), F.lit(t).cast("long").alias("t")) for m, t in _ball(cut[k][1], radius))))
        v = value(F.col("a"), k)
        part = prints.select(F.col("fp").alias("a"), F.col("root").alias("root_a"), ball.alias("c")).filter(v.bitwiseAND(F.col("c.t")) == 0)
        part = part.select("a", "root_a", F.lit(k).alias("k"), (F.col("c.m") == 0).alias("same"), key(v.bitwiseXOR(F.col("c.m")), k).alias("key"))
        probes = part if probes is None else probes.unionByName(part)
    if leaders:
        first = stored_side.groupBy("key").agg(F.min("b").alias("b"))
        led = probes.join(first, "key").filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
        return led.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if rooted:
        probes = probes.join(stored_side, (probes["key"] == stored_side["key"]) & (F.col("root_a") != F.col("root_b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).drop(stored_side["key"])
    else:
        probes = probes.join(stored_side, "key")
    found = probes.filter((~F.col("same") | (F.col("a") < F.col("b"))) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
    first = F.lit(None)
    for k in reversed(range(segments)):
        near = F.bit_count(value(F.col("a"), k).bitwiseXOR(value(F.col("b"), k))) <= radius
        first = F.when(near, F.lit(k)).otherwise(first)
    return found.filter(F.col("k") == first).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _similar(pairs: DataFrame, groups: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, least: float) -> DataFrame:
    """The pairs whose representatives' texts have a Jaccard similarity of ``least`` or more over ``shingle``-word shingles."""

    pairs = stored(pairs, "candidate_pairs")
    met = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(groups, "fp").select("fp", F.col("low").alias("m_id"), F.col("low_part").alias("m_part"))
    met = stored(met, "compared")
    if met.count() <= MAX_COMPARED:
        met = F.broadcast(met)
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col), F.col(text_col).isNull()).alias("_part"), F.col(text_col).alias("_text"))
    rows = rows.join(met, F.col("_id").eqNullSafe(F.col("m_id")) & (F.col("_part") == F.col("m_part")))
    sets = stored(rows.select("fp", shingles(F.col("_text"), shingle).alias("s")).groupBy("fp").agg(F.min("s").alias("s")), "shingle_sets")
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").withColumn("n", F.size(F.array_intersect("sa", "sb")))
    return both.filter(F.col("n") >= least * (F.size("sa") + F.size("sb") - F.col("n"))).select("a", "b")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int | None = 2, segments: int = 2, similarity: float | None = None, check_words: int = 5, farther: bool = False) -> DataFrame:
    """One row per document: ``(id, fingerprint, component_id)``.

    Texts are compared whole, A-Z lower-cased, by the SimHash of their
    ``shingle``-word shingles. component_id is the smallest id reachable over
    links of at most ``max_bits`` bits, the document itself included.

    Null and empty texts have fingerprint 0 and are linked by it like any other.
    Repeated rows stay repeated. A null id never becomes a component_id unless the
    component has no other. With ``similarity``, links between different fingerprints
    also need that Jaccard similarity over ``check_words``-word shingles. With ``farther``, texts with
    that similarity are linked too where their fingerprints are further apart: the index links first, and
    a join over all texts finds what it leaves apart. Without ``max_bits`` (None), that join finds all.
    Columns besides the two named are not looked at.
    """
    found = _classes(docs, id_col, text_col, shingle, max_bits, segments, similarity, check_words, farther)
    return found.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _links(groups: DataFrame, docs: DataFrame, id_col: str, text_col: str, max_bits: int, segments: int, similarity: float | None, check_words: int) -> DataFrame:
    """Links that join the same components as all pairs within ``max_bits`` bits would.

    Up to two bits, a fingerprint has so few neighbours that all pairs are taken. Beyond,
    a group of near copies would give pairs by the square of its size: fingerprints
    are first linked to the leaders of their table entries, and then only the pairs between
    components that are still apart are looked for. No link between components is lost.
    """

    def checked(pairs: DataFrame) -> DataFrame:
        return pairs if similarity is None else _similar(pairs, groups, docs, id_col, text_col, check_words, similarity)

    if max_bits <= 2:
        return checked(near_pairs(groups.select("fp"), max_bits, segments))
    led = stored(checked(near_pairs(groups.select("fp"), max_bits, segments, leaders=True)), "led")
    roots = components(led.toDF("u", "v"))
    apart = stored(groups.select("fp").join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "apart")
    return led.unionByName(checked(near_pairs(apart, max_bits, segments)))


def _led_and_similar(prints: DataFrame, groups: DataFrame, docs: DataFrame, id_col: str, text_col: str, max_bits: int, segments: int, similarity: float, check_words: int) -> DataFrame:
    """Links that join the same components as all similar texts would: first those of the index, then the rest.

    Fingerprints are linked to the leaders of their table entries, where the texts are as similar as
    they must be; there are no more such pairs than probes. Pairs that are still apart, within ``max_bits`` bits or not,
    are the join's, so none needs to be enumerated here by the square of a group.
    """
    led = stored(_similar(near_pairs(groups.select("fp"), max_bits, segments, leaders=True), groups, docs, id_col, text_col, check_words, similarity), "led")
    part = groups.select("fp", "low_part")
    known = stored(led.join(part.toDF("a", "part_a"), "a").join(part.toDF("b", "part_b"), "b").select(F.col("part_a").alias("a"), F.col("part_b").alias("b")), "known_links")
    return led.union(_similar_prints(prints, docs, text_col, similarity, check_words, known))


def _similar_prints(prints: DataFrame, docs: DataFrame, text_col: str, similarity: float, check_words: int, known: DataFrame | None = None) -> DataFrame:
    """Links between the fingerprints of all texts that are similar, not of representatives alone; without those that ``known(a, b)`` links of texts join."""
    texts = docs.select(F.xxhash64(F.col(text_col), F.col(text_col).isNull()).alias("part"), F.col(text_col).alias("text"))
    own = prints.select("part", "fp").distinct()
    links = similar_links(texts, check_words, similarity, known).join(own.toDF("a", "fp_a"), "a").join(own.toDF("b", "fp_b"), "b")
    return links.filter("fp_a <> fp_b").select("fp_a", "fp_b")


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int | None, segments: int, similarity: float | None, check_words: int, farther: bool) -> DataFrame:
    """``(_id, part, fp, root, component_id)`` of every row; part tells apart texts that share an id."""
    prints = stored(docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col), F.col(text_col).isNull()).alias("part"), fingerprint(F.col(text_col), shingle).alias("fp")), "prints")
    groups = stored(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("low"), F.coalesce(F.min_by("part", "_id"), F.min("part")).alias("low_part")), "print_groups")
    if max_bits is None:
        links = _similar_prints(prints, docs, text_col, similarity, check_words)
    elif farther:
        links = _led_and_similar(prints, groups, docs, id_col, text_col, max_bits, segments, similarity, check_words)
    else:
        links = _links(groups, docs, id_col, text_col, max_bits, segments, similarity, check_words)
    roots = components(links.toDF("u", "v"))
    rooted = stored(groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root")), "rooted")
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("n"))
    found = joined(rooted.select("fp", "root"), lows.select("root", "component_id"), "root", lows.select("root", "n"))
    return joined(prints, stored(found, "component_ids"), "fp", rooted.select("fp", "n"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int | None = 2, segments: int = 2, similarity: float | None = None, check_words: int = 5, farther: bool = False) -> DataFrame:
    """The documents with one of each near-duplicate component kept, whole rows; parameters as in ``near_duplicates``.

    The row with the component's smallest id stays (null is larger than any), of texts that share
    that id the one with the smallest hash; of rows that repeat its id and text, the one whose
    columns come first as JSON text.
    """
    found = _classes(docs, id_col, text_col, shingle, max_bits, segments, similarity, check_words, farther).select("root", F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), "part").alias("row"))
    found = stored(found, "classes")
    first = found.groupBy("root").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    several = joined(found, first.select("root", "first"), "root", first.select("root", "n"))
    gone = several.filter("row <> first").select("row.id", "row.part", F.lit(True).alias("gone")).distinct()
    again = several.filter("row = first").groupBy("row").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("row.id", "row.part", F.lit(False).alias("gone"))
    marks = stored(gone.unionByName(again).toDF("_m_id", "_m_part", "_gone"), "gone")
    if marks.count() <= MAX_COMPARED:
        marks = F.broadcast(marks)
    part = F.xxhash64(docs[text_col], docs[text_col].isNull())
    left = docs.join(marks, docs[id_col].eqNullSafe(marks["_m_id"]) & (part == marks["_m_part"]), "left")
    columns = [docs[c] for c in docs.columns]
    repeated = left.filter(~marks["_gone"]).select(marks["_m_id"].alias("id"), marks["_m_part"].alias("part"), F.struct(*columns).alias("row"))
    one = repeated.groupBy("id", "part").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return left.filter(marks["_gone"].isNull()).select(*columns).unionByName(one)
