"""URL verdicts: given rules first, then mined association rules.

Given rules (host, path, verdict) hold for their host and all its subdomains.
Their verdicts label pages; Spark's FP-growth mines the labelled pages, all of
them, for combinations of URL tokens that go with a verdict, and support and
confidence prune them. Pages that no given rule fits are decided by the mined
rules: an inverted index from each rule's rarest token finds the rules whose
tokens a URL holds, and the most confident one decides. Everything runs as
DataFrame expressions and Spark ML on the JVM.

What is mined is bounded by support alone: tokens and combinations on fewer
than ``support`` of the labelled pages can't reach it, tokens on over
1 - ``support`` of them say nothing that the rest of a rule doesn't. A rule
goes if one with a token less has the same verdict and no less confidence.

Defined results: a null URL or one without ``://`` has empty host and path and
no tokens, so it is allowed; null and repeated page_ids are rows like others;
an empty table, or one without labelled pages, has no mined rules; extra
columns are not read; equally long given rules are decided by the rule's text,
equally confident mined ones by support, then by verdict; very long URLs are
matched whole.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct (size, rule, verdict), or null."""
    fits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for h, p, v in rules
    ]
    return F.array_max(F.array(*fits))


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct words of host (h:) and path (p:); a run of digits is one token."""

    def words(text: Column, kind: str) -> Column:
        found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}]+|[\p{N}]+"), F.lit(0))
        return F.transform(found, lambda w: F.concat(F.lit(kind), F.when(w.rlike(r"^\p{N}"), F.lit("#")).otherwise(w)))

    return F.array_distinct(F.concat(words(host, "h:"), words(path, "p:")))


_INDEX = "map<string, array<struct<confidence: double, support: double, verdict: string, need: array<string>>>>"


def mine(labelled: DataFrame, support: float, confidence: float) -> list[tuple]:
    """(confidence, support, tokens, verdict) of the pruned rules, a rule's
    rarest token first. ``labelled``: tokens and verdict of each labelled page.
    The rules are the model: their number depends on ``support``, not on the
    number of pages."""
    from pyspark.ml.fpm import FPGrowth

    total = labelled.count()
    if not total:
        return []
    counts = labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    kept = counts.filter((F.col("n") >= support * total) & (F.col("n") <= (1 - support) * total)).collect()  # at most tokens a page / support
    if not kept:
        return []
    rarity = {r["token"]: r["n"] for r in kept}
    known = F.array(*map(F.lit, sorted(rarity)))
    baskets = labelled.select(F.concat(F.array_intersect("tokens", known), F.array(F.concat(F.lit("="), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    mined = model.associationRules.filter(F.element_at("consequent", 1).startswith("=") & ~F.exists("antecedent", lambda t: t.startswith("=")))
    mined = mined.select("confidence", "support", F.array_sort("antecedent").alias("need"), F.substring(F.element_at("consequent", 1), 2, 10).alias("verdict"))
    shorter = F.transform("need", lambda t: F.array_except("need", F.array(t)))
    each = mined.select("need", "verdict", "confidence", F.explode(shorter).alias("less"))
    general = mined.select(F.col("need").alias("less"), "verdict", F.col("confidence").alias("before"))
    redundant = each.join(general, ["less", "verdict"]).filter("before >= confidence").select("need", "verdict").distinct()
    best = mined.join(redundant, ["need", "verdict"], "left_anti").collect()
    return sorted((r["confidence"], r["support"], sorted(r["need"], key=lambda t: (rarity[t], t)), r["verdict"]) for r in best)


def mined_verdict(tokens: Column, rules: list[tuple]) -> Column:
    """The best mined rule whose tokens are all there; null if none is. The index
    goes in as one literal, so the plan doesn't grow with the rules."""
    if not rules:
        return F.lit(None).cast("string")
    index: dict[str, list[dict]] = {}
    for c, s, need, v in rules:
        index.setdefault(need[0], []).append({"confidence": c, "support": s, "verdict": v, "need": need})
    table = F.from_json(F.lit(json.dumps(index)), _INDEX)
    found = F.flatten(F.filter(F.transform(tokens, lambda t: F.try_element_at(table, t)), lambda p: p.isNotNull()))
    fit = F.filter(found, lambda p: F.size(F.array_except(p["need"], tokens)) == 0)
    return F.array_max(F.transform(fit, lambda p: F.struct(p["confidence"], p["support"], p["verdict"].alias("verdict"))))["verdict"]


def judge(pages: DataFrame, rules=RULES, support: float = 0.01, confidence: float = 0.8) -> DataFrame:
    scratch = Scratch(pages.sparkSession)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    cut = pages.select("page_id", host.alias("host"), path.alias("path"))
    cut = scratch.table(cut, "urls")
    ruled = cut.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("fit"), tokens_of(F.col("host"), F.col("path")).alias("tokens"))
    mined = mine(ruled.filter("fit is not null").select("tokens", F.col("fit.verdict").alias("verdict")), support, confidence)
    return ruled.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", mined_verdict(F.col("tokens"), mined), F.lit("allow")).alias("verdict"))
