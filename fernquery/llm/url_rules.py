"""URL filtering by association rules over URL tokens.

FP-growth mines, from labelled URLs, the token combinations that go with a blocked
label. Rules below a confidence or support are pruned, as are rules that a shorter
rule already covers. The rest are stored as an inverted index from token to rules: a
URL is blocked if it holds all tokens of some rule. Listed rules of host and path come
first. Everything is DataFrame code; FP-growth is Spark's own, on the JVM.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernquery.llm.common import ascii_lower, stored

#: Fixed value: the item that stands for a blocked label.
BLOCKED = "label=block"
MIN_SUPPORT, MIN_CONFIDENCE = 0.004, 0.7
#: Entries of the index up to which it is broadcast.
MAX_INDEX = 500_000


def host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or end; A-Z lower-cased; '' where there is none."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL: labels of the host, segments of the path, suffix and keys of the query. Digits become one sign."""
    named = lambda kind, parts: F.transform(parts, lambda x: F.concat(F.lit(kind), x))
    plain = F.regexp_replace(F.coalesce(url, F.lit("")), "[0-9]+", "0")
    query = F.regexp_extract(plain, r"(?s)\?([^#]*)", 1)
    suffix = F.regexp_extract(path(plain), r"\.([A-Za-z0-9]{1,8})$", 1)
    parts = F.concat(named("h:", F.split(host(plain), r"\.")), named("p:", F.split(path(plain), "/")), named("q:", F.transform(F.split(query, "[&;]"), lambda x: F.substring_index(x, "=", 1))), named("s:", F.array(suffix)))
    return F.array_distinct(F.filter(parts, lambda x: F.length(x) > 2))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules ``(rule, terms)`` from ``labelled(items, blocked)``.

    A rule's terms occur together in at least ``min_support`` of the labelled URLs, and
    at least ``min_confidence`` of the URLs with them are blocked; rules have any number of terms. Without labelled
    URLs of either kind there are no rules.
    """
    spark = labelled.sparkSession
    kinds = {r["blocked"] for r in labelled.select("blocked").distinct().collect()}
    if True not in kinds:
        return spark.createDataFrame([], "rule long, terms array<string>")
    baskets = labelled.select(F.when(F.col("blocked"), F.array_append("items", F.lit(BLOCKED))).otherwise(F.col("items")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.filter(F.get("consequent", F.lit(0)) == BLOCKED)
    found = stored(found.select(F.sort_array("antecedent").alias("terms")).withColumn("rule", F.xxhash64("terms")), "url_rules")
    # A rule that holds a shorter one says nothing more. The shorter is looked up by its rarest term alone.
    index = found.select("rule", "terms", F.explode("terms").alias("term"))
    often = index.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    rarest = index.join(often, "term").groupBy(F.col("rule").alias("short")).agg(F.min(F.struct("n", "term"))["term"].alias("term"), F.first("terms").alias("part"))
    longer = (F.size("part") < F.size("terms")) & (F.size(F.array_except("part", "terms")) == 0)
    inside = index.join(rarest, "term").filter(longer).select("rule").distinct()
    return found.join(inside, "rule", "left_anti")


def listed(url: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest of the listed ``(verdict, host, path)`` rules that fits, as a struct ``(rule, verdict)``, or null.

    A rule fits its host and all its subdomains, if the URL's path starts with the rule's.
    """
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    h, p = host(url), path(url)
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((h == rule_host) | F.endswith(h, F.lit("." + rule_host))) & F.startswith(p, F.lit(rule_path))
        best = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def judge(pages: DataFrame, labels: DataFrame, *, id_col: str = "page_id", url_col: str = "url", label_id_col: str = "doc_id", blocked: Column | None = None, rules: list[tuple[str, str, str]] = (), min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """One row per page: id, host, path, ``rule`` (the listed rule that decides, else null), ``mined`` (a mined rule fits), verdict.

    ``blocked`` says of a label row whether it asks for blocking (by default, toxic or
    of low quality). Labels are matched to pages by id; a page without one is not
    learnt from. A null URL, or one without ``://``, has an empty host and path, no
    host tokens, and is allowed unless a rule says otherwise. Repeated rows get equal
    rows each. Other columns are not looked at.
    """
    blocked = (F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0) if blocked is None else blocked
    rows = pages.select(F.col(id_col).alias("_id"), F.xxhash64(url_col, F.col(url_col).isNull()).alias("_part"), F.col(url_col).alias("_url"))
    marked = labels.select(F.col(label_id_col).alias("l_id"), blocked.alias("blocked"))
    mined = stored(mine(rows.join(marked, F.col("_id") == F.col("l_id")).select(tokens(F.col("_url")).alias("items"), "blocked"), min_support, min_confidence), "mined")
    index = mined.select("rule", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    small = F.broadcast(index) if index.count() <= MAX_INDEX else index
    met = rows.select("_id", "_part", F.explode(tokens(F.col("_url"))).alias("term")).join(small, "term").distinct()
    met = met.groupBy("_id", "_part", "rule", "n").agg(F.count(F.lit(1)).alias("m")).filter("m = n").select(F.col("_id").alias("m_id"), F.col("_part").alias("m_part")).distinct().withColumn("mined", F.lit(True))
    out = rows.join(met, F.col("_id").eqNullSafe(F.col("m_id")) & (F.col("_part") == F.col("m_part")), "left")
    out = out.select(F.col("_id").alias(id_col), host(F.col("_url")).alias("host"), path(F.col("_url")).alias("path"), listed(F.col("_url"), list(rules)).alias("best"), F.coalesce("mined", F.lit(False)).alias("mined"))
    return out.select(id_col, "host", "path", F.col("best.rule").alias("rule"), "mined", F.coalesce(F.col("best.verdict"), F.when(F.col("mined"), "block").otherwise("allow")).alias("verdict"))
