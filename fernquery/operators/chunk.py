"""Chunking: windows of tokens or characters, lines, and packing by separators or paragraphs.

Tokens are runs of non-space characters with the white space after them, so that joined
tokens give the text again; any expression that gives an array of such tokens can stand
in for ``tokens``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernquery.functions.text import prefixed_md5, strip

#: Sizes in tokens.
SIZE, OVERLAP = 1200, 100


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(strip(F.coalesce(text, F.lit(""))), F.lit(r"\S+\s*"), 0)


def token_windows(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ord, tokens, content, chunk_id)``, windows of ``size`` tokens, every ``size - overlap``.

    The last window may lie wholly within the one before. The count is the window's, before
    its content is stripped. A document without tokens has no chunk. No shuffle.
    """
    step = size - overlap
    rows = docs.select(F.col(id_col), tokens(F.col(text_col)).alias("t")).filter(F.size("t") > 0)
    cut = rows.select(id_col, F.posexplode(F.transform(F.sequence(F.lit(1), F.size("t"), F.lit(step)), lambda s: F.slice("t", s, size))).alias("ord", "w"))
    content = strip(F.array_join("w", ""))
    return cut.select(id_col, "ord", F.size("w").alias("tokens"), content.alias("content"), prefixed_md5(content, "chunk-").alias("chunk_id"))


def leaf_windows(leaves: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``leaves(doc_id, section_id, path, text)`` whole where they fit, else in windows, blanks dropped, counts of the stripped text."""
    step = size - overlap
    rows = leaves.withColumn("t", tokens(F.col("text")))
    starts = F.when(F.size("t") <= size, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.size("t"), F.lit(step)))
    cut = rows.filter(F.size("t") > 0).select("doc_id", "section_id", "path", F.posexplode(F.transform(starts, lambda s: strip(F.array_join(F.slice("t", s, size), "")))).alias("sub_ord", "content"), F.size(starts).alias("sub_total"))
    kept = cut.filter("content <> ''").withColumn("tokens", F.size(tokens(F.col("content"))))
    key = F.concat_ws("|", F.col("doc_id").cast("string"), "path", "section_id", F.col("sub_ord").cast("string"))
    return kept.withColumn("chunk_id", prefixed_md5(key, "chunk-"))


def last_of_equal(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Chunks of equal content are one; the last document's stays."""
    return chunks.groupBy("chunk_id").agg(F.max(F.struct(F.col(id_col), F.col("ord"), F.col("tokens"))).alias("m")).select("chunk_id", f"m.{id_col}", "m.ord", "m.tokens")


def char_pieces(docs: DataFrame, size: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of ``size`` characters."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(size))
    return docs.filter(F.length(text) > 0).select(id_col, F.posexplode(F.transform(starts, lambda s: text.substr(s, F.lit(size)))).alias("ord", "piece"))


def lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, line_no, line, offset)``; the offset is the line's place in the text, in characters.

    Ids are keys: a document's lines are summed up in one window.
    """
    split = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    order = Window.partitionBy(id_col).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = docs.select(id_col, F.posexplode(split).alias("line_no", "line"))
    return rows.withColumn("offset", F.coalesce(F.sum(F.length("line") + 1).over(order), F.lit(0)))


def line_context(docs: DataFrame, reach: int = 2, marker: str = ">> ", *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each line with ``reach`` lines on either side, the line itself marked."""
    split = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    rows = docs.select(id_col, split.alias("all"))

    def around(i: Column) -> Column:
        start = F.greatest(i + 1 - reach, F.lit(1))
        return F.array_join(F.concat(F.slice("all", start, i + 1 - start), F.array(F.concat(F.lit(marker), F.get("all", i))), F.slice("all", i + 2, reach)), "\n")

    return rows.select(id_col, F.posexplode(F.transform(F.sequence(F.lit(0), F.size("all") - 1), around)).alias("line_no", "context"))


def pack_pieces(texts: pa.Array, cut, size: int) -> list:
    out = []
    for t in texts.to_pylist():
        packed: list[list] = []
        for piece, n in cut(t or ""):
            if packed and packed[-1][1] + n <= size:
                packed[-1][0] += piece
                packed[-1][1] += n
            else:
                packed.append([piece, n])
        out.append([{"piece": p, "tokens": n} for p, n in packed])
    return out


def _count(text: str) -> int:
    return len(text.split())


def separator_chunks(text: Column, size: int = SIZE, overlap: int = 0, separators: tuple[str, ...] = ("\n\n", "\n", ". ", "。", "! ", "? ", "！", "？")) -> Column:
    """Text cut after separators, pieces packed up to ``size`` words; a longer piece is cut by words.

    With ``overlap``, a chunk begins with the last words of the one before, and is cut to ``size`` again.
    """
    import re

    pattern = re.compile("|".join(map(re.escape, separators)))

    def cut(text: str):
        at = 0
        for stop in [m.end() for m in pattern.finditer(text)] + [len(text)]:
            piece = text[at:stop]
            at = stop
            words = re.findall(r"\S+\s*|^\s+", piece)
            for k in range(0, len(words), size):
                part = "".join(words[k : k + size])
                yield part, _count(part)

    @F.arrow_udf("array<struct<piece:string,tokens:int>>")
    def run(texts: pa.Array) -> pa.Array:
        packed = pack_pieces(texts, cut, size)
        if overlap:
            for chunks in packed:
                plain = [re.findall(r"\S+\s*|^\s+", c["piece"]) for c in chunks]
                for k in range(1, len(chunks)):
                    words = (plain[k - 1][-overlap:] + plain[k])[:size]
                    chunks[k] = {"piece": "".join(words), "tokens": len(words)}
        return pa.array(packed, pa.list_(pa.struct([("piece", pa.string()), ("tokens", pa.int32())])))

    return run(text)


def paragraph_chunks(text: Column, size: int = SIZE, least_chars: int = 800) -> Column:
    """Paragraphs, between blank lines, stripped and packed up to ``size`` words, a blank line between them.

    One that is longer is cut by characters in proportion, ``least_chars`` at least; its
    parts are chunks of their own, stripped. A text without words has no chunk.
    """
    import re

    between = re.compile(r"\n\s*\n")

    def cut(text: str):
        held, size_held = [], 0
        for paragraph in filter(None, map(str.strip, between.split(text.strip()))):
            n = _count(paragraph)
            if held and (n > size or size_held + n > size):
                yield "\n\n".join(held), size_held
                held, size_held = [], 0
            if n > size:
                width = max(least_chars, int(len(paragraph) * (size / n)))
                for part in filter(None, (paragraph[k : k + width].strip() for k in range(0, len(paragraph), width))):
                    yield part, _count(part)
            else:
                held, size_held = [*held, paragraph], size_held + n
        if held:
            yield "\n\n".join(held), size_held

    @F.arrow_udf("array<struct<piece:string,tokens:int>>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([[{"piece": p, "tokens": n} for p, n in cut(t or "")] for t in texts.to_pylist()], pa.list_(pa.struct([("piece", pa.string()), ("tokens", pa.int32())])))

    return run(text)
