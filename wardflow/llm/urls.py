"""URL filter: hand-written host rules first, then association rules mined from labelled URLs.

Spark's FP-growth mines combinations of URL tokens together with the label. A
combination with the label, divided by the same one without it, is a rule's
confidence; rules stay that have the support and the confidence asked for, and
whose confidence, at the lower end of its error, still lies above the share of
unwanted URLs by a factor, without those that a shorter one already covers.
Matching goes through an inverted index: a rule is filed under its rarest token,
URLs look up their tokens, and the whole antecedent is then checked. A URL's
verdict depends on the URL alone, so each distinct URL is matched once.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.llm.common import checkpoint, table

UNWANTED = "label:unwanted"
#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased (else empty)."""
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end (else empty)."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; both null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, host labels, path parts and query parts, digits read as ``0``."""
    url = F.coalesce(url, F.lit(""))
    plain = F.regexp_replace(F.translate(url, UPPER, LOWER), "[0-9]+", "0")
    query = F.regexp_extract(plain, "[?]([^#]*)", 1)
    parts = [("s:", F.array(F.regexp_extract(plain, "^([^:/?#]*)://", 1))), ("h:", F.split(host_of(plain), "[.:@-]+")),
             ("p:", F.split(path_of(plain), "[/._-]+")), ("q:", F.split(query, "[&;]"))]

    def marked(kind: str, items: Column) -> Column:
        return F.transform(F.filter(items, lambda t: t != ""), lambda t: F.concat(F.lit(kind), t))

    return F.array_distinct(F.concat(*[marked(kind, items) for kind, items in parts]))


def least_share(hits: Column, n: Column, z: float) -> Column:
    """Lower end of the Wilson interval, ``z`` standard errors wide, of the share ``hits / n``."""
    p = hits / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def mine_rules(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.6, min_count: int = 10,
               min_lift: float = 1.5, z: float = 3.0) -> DataFrame:
    """Rules (antecedent, confidence, support, anchor) for unwanted URLs from rows (``url``, ``unwanted``).

    A rule holds in ``min_support`` of the rows and in ``min_count`` rows, is right
    in ``min_confidence`` of those with its tokens, and ``z`` standard errors below
    its confidence it is still ``min_lift`` times as often right as any URL is unwanted.
    """
    items = F.when(F.col("unwanted"), F.array_append("tokens", UNWANTED)).otherwise(F.col("tokens"))
    baskets = checkpoint(labelled.filter("url IS NOT NULL AND unwanted IS NOT NULL")
                         .select(tokens_of(F.col("url")).alias("tokens"), "unwanted").select(items.alias("items")))
    schema = "antecedent array<string>, confidence double, support double, anchor string"
    n = baskets.count()
    if not n:
        return labelled.sparkSession.createDataFrame([], schema)
    sets = checkpoint(FPGrowth(itemsCol="items", minSupport=max(min_support, min_count / n)).fit(baskets)
                      .freqItemsets.select(F.array_sort("items").alias("items"), "freq"))
    share = sets.filter(F.size("items") == 1).filter(F.col("items")[0] == UNWANTED).first()
    if share is None:  # too few unwanted URLs for any rule
        return labelled.sparkSession.createDataFrame([], schema)
    wanted = F.array_contains("items", UNWANTED)
    both = sets.filter(wanted & (F.size("items") > 1)).select(F.array_remove("items", UNWANTED).alias("antecedent"), F.col("freq").alias("hits"))
    alone = sets.filter(~wanted).select(F.col("items").alias("antecedent"), F.col("freq").cast("double").alias("n"))
    confidence = F.col("hits") / F.col("n")
    rules = checkpoint(both.join(alone, "antecedent").filter(
        (confidence >= min_confidence) & (least_share(F.col("hits"), F.col("n"), z) >= min_lift * share["freq"] / n)).select(
        "antecedent", confidence.alias("confidence"), (F.col("hits") / n).alias("support")))
    shorter = rules.select(F.col("antecedent").alias("part"))
    covered = (rules.select("antecedent", F.explode("antecedent").alias("t"))
               .select("antecedent", F.array_remove("antecedent", F.col("t")).alias("part"))
               .join(shorter, "part").select("antecedent").distinct())
    kept = rules.join(covered, "antecedent", "left_anti")
    single = sets.filter("size(items) = 1").select(F.col("items")[0].alias("t"), "freq")
    anchors = (kept.select("antecedent", F.explode("antecedent").alias("t")).join(single, "t")
               .groupBy("antecedent").agg(F.min(F.struct("freq", "t")).alias("x")).select("antecedent", F.col("x.t").alias("anchor")))
    return checkpoint(kept.join(anchors, "antecedent").select("antecedent", "confidence", "support", "anchor"))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (url, confidence) of the distinct URLs that a rule matches, with the highest confidence."""
    tokens = urls.select(tokens_of(F.col("url")).alias("tokens"), "url")
    looked_up = tokens.select("url", "tokens", F.explode("tokens").alias("anchor")).join(rules, "anchor")
    hit = F.size(F.array_intersect("tokens", "antecedent")) == F.size("antecedent")
    return looked_up.filter(hit).groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge_urls(pages: DataFrame, labelled: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """Adds ``host``, ``path``, ``rule``, ``verdict`` and ``confidence`` (of the mined rule that blocks, else null).

    The longest fitting rule decides; else a URL is blocked if a mined rule
    matches it, and allowed otherwise. A null URL, or one without ``://``, has
    an empty host and path. Repeated rows are each judged; without labels
    nothing is mined; input columns named like a result are replaced.
    """
    results = ["host", "path", "rule", "verdict", "confidence"]
    text = F.col(f"`{url}`").cast("string")
    base = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c not in results or c == url], text.alias("__url"),
                        host_of(text).alias("__host"), path_of(text).alias("__path"))
    matched = match_rules(base.select(F.col("__url").alias("url")).filter("url IS NOT NULL").distinct(), mine_rules(labelled))
    name, verdict = rule_of(F.col("__host"), F.col("__path"), rules)
    both = base.join(matched.select(F.col("url").alias("__url"), F.col("confidence").alias("__c")), "__url", "left")
    keep = [F.col(f"`{c}`") for c in pages.columns if c not in results]
    return both.select(*keep, F.col("__host").alias("host"), F.col("__path").alias("path"), name.alias("rule"),
                       F.coalesce(verdict, F.when(F.col("__c").isNotNull(), "block").otherwise("allow")).alias("verdict"),
                       F.when(verdict.isNull(), F.col("__c")).alias("confidence"))


def labelled_by_rules(pages: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """Rows (url, unwanted) of all URLs: unwanted are those that the host rules block.

    What the rules leave open counts as wanted, so a token is not suspect merely
    because the rules speak of nothing else that has it.
    """
    text = F.col(f"`{url}`").cast("string")
    _, verdict = rule_of(host_of(text), path_of(text), rules)
    return pages.filter(text.isNotNull()).select(text.alias("url"), F.coalesce(verdict == "block", F.lit(False)).alias("unwanted"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = judge_urls(pages, labelled_by_rules(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict", "confidence")
