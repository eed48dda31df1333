"""Ranks over all rows, percentiles, evaluation metrics and gates (Q14-Q23)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Cases a category needs, and thresholds of the gates (fixed values).
QUALITY = {"schema_compliance": 1.0, "evidence_hit_rate": 0.85, "top_5_recall": 0.90, "symbol_top_3_recall": 0.95, "mrr": 0.75, "profile_correctness": 0.90, "warning_quality": 0.85, "blocked_security_contract": 1.0}
PERFORMANCE = {"serve_startup": ("seconds", 10.0), "init_reuse_baseline": ("seconds", 60.0), "docs_search": ("seconds", 2.0), "code_resolve": ("seconds", 1.5), "workspace_view": ("seconds", 2.0), "kb_search": ("seconds", 3.0), "evidence_bundle": ("seconds", 3.0), "incremental_index_100_files": ("seconds", 600.0), "serve_resident_memory": ("bytes", 4.0 * (1 << 30))}
STABILITY = {"soak_unhandled_exceptions": ("lte", 0.0), "mixed_query_success_rate": ("gte", 0.99), "index_recovery_contract": ("gte", 1.0), "migration_idempotence": ("gte", 1.0), "partial_ready_query_contract": ("gte", 1.0), "readonly_query_non_blocking": ("gte", 1.0)}
MOST_DROP, MOST_SLOWER = 0.05, 1.20


def exact_sum(value: Column) -> Column:
    """The sum of doubles, added up as decimals of ten places: sums that are equal
    stay equal, whatever order the rows come in. What is no such number is added as it is."""
    exact = value.try_cast("decimal(28,10)")
    odd = F.sum(F.when(exact.isNull(), value))
    return F.coalesce(F.sum(exact).cast("double") + F.coalesce(odd, F.lit(0.0)), odd)


def rank_all(rows: DataFrame, by: list[str], tie: str, parts: int | None = None, groups: list[str] | None = None) -> DataFrame:
    """``rank`` over all rows (of each of ``groups``), highest first, without one task for all of them.

    Rows are dealt by ranges of the sort key, counted by range, and numbered within
    each; the ranges' counts are few and added up in a small window. There are as
    many ranges as the session's shuffles have partitions, unless ``parts`` says otherwise.
    """
    groups = groups or []
    order = [*[F.desc(c) for c in by], F.col(tie)]
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(parts, *groups, *order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy(*groups, "_part").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*groups).orderBy("_part")
    base = counts.withColumn("_base", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = dealt.withColumn("_at", F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(*order)))
    return numbered.join(base.drop("_n"), [*groups, "_part"]).withColumn("rank", F.col("_at") + F.col("_base")).drop("_part", "_at", "_base")


def percentiles(rows: DataFrame, groups: list[str], value: str, quantiles: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """(groups, n, q, nearest, linear): exact percentiles by nearest rank (Q15) and by
    linear interpolation (Q16). Values are counted first and ranked over sorted
    ranges, so a group of very many values is no single task."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(counted.repartitionByRange(parts, *groups, "_v").withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy(*groups, "_part").agg(F.sum("_c").alias("_s"))
    base = sums.withColumn("_base", F.coalesce(F.sum("_s").over(Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = sums.groupBy(*groups).agg(F.sum("_s").alias("n"))
    inside = F.sum("_c").over(Window.partitionBy(*groups, "_part").orderBy("_v"))
    ranked = dealt.withColumn("_in", inside).join(base.drop("_s"), [*groups, "_part"]).withColumn("_to", F.col("_in") + F.col("_base")).withColumn("_from", F.col("_to") - F.col("_c"))
    ranked = ranked.join(total, groups) if groups else ranked.withColumn("one", F.lit(1)).join(total.withColumn("one", F.lit(1)), "one")
    asked = ranked.withColumn("q", F.explode(F.array(*map(F.lit, quantiles))))
    at = F.greatest(F.lit(0), F.ceil(F.round(F.col("n") * F.col("q"), 9)) - 1)
    place = (F.col("n") - 1) * F.col("q")
    low, high = F.floor(place), F.least(F.floor(place) + 1, F.col("n") - 1)
    here = lambda i: (F.col("_from") <= i) & (i < F.col("_to"))
    picked = asked.filter(here(at) | here(low) | here(high))
    pick = lambda i: F.max(F.when(here(i), F.col("_v")))
    out = picked.groupBy(*groups, "n", "q").agg(pick(at).alias("nearest"), pick(low).alias("_l"), pick(high).alias("_h"))
    return out.select(*groups, "n", "q", "nearest", (F.col("_l") + (F.col("_h") - F.col("_l")) * ((F.col("n") - 1) * F.col("q") - F.floor((F.col("n") - 1) * F.col("q")))).alias("linear"))


def first_relevant(items: DataFrame, expected: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, first): the first rank at which an item's text holds an expected
    locator, in any case and with either slash; null: none (Q19)."""
    plain = lambda c: F.replace(F.lower(F.trim(c)), F.lit("\\"), F.lit("/"))
    wanted = expected.select(case, F.lower(F.trim("locator")).alias("_l")).filter("_l <> ''")
    hit = items.join(wanted, case).filter(F.contains(plain(F.col("text")), F.col("_l"))).groupBy(case).agg(F.min("rank").alias("first"))
    return items.select(case).unionByName(expected.select(case)).distinct().join(hit, case, "left")


def rate(flag: str) -> Column:
    """The share of true ones among those that are known; none known: 0 (Q14)."""
    return F.round(F.coalesce(F.avg(F.col(flag).cast("double")), F.lit(0.0)), 6)


def quality_metrics(cases: DataFrame, security_ok: bool = True) -> DataFrame:
    """(metric, actual, threshold, passed, eligible) of observed cases (Q14, Q20)."""
    flags = {"schema_compliance": "schema_compliant", "evidence_hit_rate": "evidence_hit", "top_5_recall": "top_5_hit", "symbol_top_3_recall": "symbol_top_3_hit", "profile_correctness": "profile_correct", "warning_quality": "warning_quality_ok"}
    aggregates = [F.struct(F.lit(m).alias("metric"), rate(c).alias("actual"), F.count(c).alias("eligible")) for m, c in flags.items()]
    aggregates.append(F.struct(F.lit("mrr").alias("metric"), F.round(F.coalesce(F.avg("reciprocal_rank"), F.lit(0.0)), 6).alias("actual"), F.count("reciprocal_rank").alias("eligible")))
    aggregates.append(F.struct(F.lit("blocked_security_contract").alias("metric"), F.lit(float(security_ok)).alias("actual"), F.lit(1).cast("long").alias("eligible")))
    rows = cases.agg(F.array(*aggregates).alias("m")).select(F.explode("m").alias("m")).select("m.*")
    return gate(rows, {k: ("gte", v) for k, v in QUALITY.items()})


def gate(metrics: DataFrame, thresholds: dict[str, tuple[str, float]]) -> DataFrame:
    """Metrics (metric, actual) against thresholds, at least or at most; one that is missing fails (Q20)."""
    table = metrics.sparkSession.createDataFrame([(m, d, float(t)) for m, (d, t) in thresholds.items()], "metric string, direction string, threshold double")
    ok = F.when(F.col("direction") == "lte", F.col("actual") <= F.col("threshold")).otherwise(F.col("actual") >= F.col("threshold"))
    return table.join(metrics, "metric", "left").withColumn("passed", F.coalesce(ok, F.lit(False)))


def performance_gate(probes: DataFrame) -> DataFrame:
    """Probes (metric, unit, actual: their p95) against the gates; the unit must agree (Q20)."""
    table = probes.sparkSession.createDataFrame([(m, u, t) for m, (u, t) in PERFORMANCE.items()], "metric string, wanted_unit string, threshold double")
    ok = (F.col("unit") == F.col("wanted_unit")) & (F.col("actual") <= F.col("threshold"))
    return table.join(probes, "metric", "left").withColumn("passed", F.coalesce(ok, F.lit(False)))


def reproducible(pairs: DataFrame) -> DataFrame:
    """Checks (check, first, second) that must be equal (Q20)."""
    return pairs.withColumn("passed", F.col("first").eqNullSafe(F.col("second")))


def rate_regression(before: DataFrame, after: DataFrame, key: str = "category", most: float = MOST_DROP) -> DataFrame:
    """(key, baseline, current, delta, failure): rates that fell by more than ``most`` or are missing (Q21)."""
    both = before.select(key, F.col("rate").alias("baseline")).join(after.select(key, F.col("rate").alias("current")), key, "full")
    drop = F.round(F.col("baseline") - F.col("current"), 9)
    failure = F.when(F.col("baseline").isNull() | F.col("current").isNull(), "category_evidence_available").when(drop > most, "category_evidence_regression")
    return both.select(key, "baseline", "current", F.round(F.col("current") - F.col("baseline"), 6).alias("delta"), failure.alias("failure"))


def speed_regression(before: DataFrame, after: DataFrame, key: str = "probe_id", most: float = MOST_SLOWER, exempt: tuple[str, ...] = ()) -> DataFrame:
    """(key, baseline, current, ratio, failure, warning): p95s over ``most`` times the old ones (Q21)."""
    both = before.select(key, F.col("p95").alias("baseline")).join(after.select(key, F.col("p95").alias("current")), key, "full")
    ratio = F.when(F.col("baseline") <= 0, 1.0).otherwise(F.col("current") / F.col("baseline"))
    slow = ratio > most
    spared = F.col(key).isin(*exempt) if exempt else F.lit(False)
    failure = F.when(F.col("baseline").isNull() | F.col("current").isNull(), "performance_probe_available").when(slow & ~spared, "performance_regression")
    return both.select(key, "baseline", "current", F.round(ratio, 6).alias("ratio"), failure.alias("failure"), F.when(slow & spared, "performance_regression_exempted").alias("warning"))


def summarize(samples: DataFrame, scenario: list[str], value: str) -> DataFrame:
    """(scenario, n, min, p50, p95, mean, max), percentiles by linear interpolation (Q17)."""
    plain = samples.groupBy(*scenario).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    p = percentiles(samples, scenario, value, (0.5, 0.95)).groupBy(*scenario).agg(F.max(F.when(F.col("q") == 0.5, F.col("linear"))).alias("p50"), F.max(F.when(F.col("q") == 0.95, F.col("linear"))).alias("p95"))
    return plain.join(p, scenario)


def against_reference(summaries: DataFrame, family: list[str], reference: Column) -> DataFrame:
    """Adds speed-up and memory multiple over the family's reference scenario and
    risk flags (Q17). Summaries have p50, rss_p95 and failed, blocked, warnings counts."""
    base = summaries.filter(reference).select(*family, F.col("p50").alias("_p50"), F.col("rss_p95").alias("_rss"), F.col("scenario").alias("reference"))
    rows = summaries.join(base, family, "left")
    speed, memory = F.when(F.col("_p50") > 0, F.col("_p50") / F.col("p50")), F.when(F.col("_rss") > 0, F.col("rss_p95") / F.col("_rss"))
    flags = F.filter(F.array(
        F.when(F.col("blocked") > 0, "blocked_result"), F.when(F.col("failed") > 0, "failed_result"), F.when(memory > 2.0, "memory_gt_2x_reference"),
        F.when((F.col("scenario") != F.col("reference")) & (speed < 1.0), "slower_than_reference"), F.when(F.col("warnings") > 0, "warnings_present"),
    ), lambda x: x.isNotNull())
    return rows.withColumns({"speedup": speed, "memory_multiple": memory, "risks": flags}).drop("_p50", "_rss")


def recommend(summaries: DataFrame, family: list[str], pressure: list[str]) -> DataFrame:
    """Of each family the scenario of least pressure within 5 % of the fastest,
    those of hard risks left out (Q17)."""
    hard = F.array(*map(F.lit, ("failed_result", "blocked_result", "validate_failed", "sqlite_lock_warning", "vector_write_warning", "memory_gt_2x_reference", "readonly_probe_error")))
    fit = summaries.filter(~F.arrays_overlap("risks", hard))
    near = fit.join(fit.groupBy(*family).agg(F.min("p50").alias("_fastest")), family).filter(F.col("p50") <= F.col("_fastest") * 1.05)
    return near.groupBy(*family).agg(F.min_by("scenario", F.struct(*pressure, "p50", "scenario")).alias("scenario"))


def coverage(cases: DataFrame, minimums: DataFrame, key: str = "category") -> DataFrame:
    """(key, required, actual, gap) of counted cases against minimums (Q18)."""
    got = cases.groupBy(key).agg(F.count("*").alias("actual"))
    actual = F.coalesce("actual", F.lit(0).cast("long"))
    return minimums.join(got, key, "left").select(key, "required", actual.alias("actual"), F.greatest(F.col("required") - actual, F.lit(0).cast("long")).alias("gap"))


def positive_ints(raw: Column) -> Column:
    """A comma-separated list of positive integers without repeats (Q23); null if it
    holds anything else, or nothing."""
    items = F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: x != "")
    ints = F.transform(items, lambda x: x.try_cast("bigint"))
    ok = (F.size(items) > 0) & ~F.exists(ints, lambda x: x.isNull() | (x <= 0))
    return F.when(ok, F.array_distinct(ints))


def conflicting_verdicts(correct: Column, wrong: Column) -> Column:
    """Evidence that feedback names both right and wrong (Q23)."""
    return F.array_sort(F.array_intersect(correct, wrong))


def feedback_drafts(feedback: DataFrame) -> DataFrame:
    """Drafts of evaluation cases from feedback (query, rating, right, wrong) (Q22):
    only what is consistent and names evidence; low ratings are blocking."""
    clear = feedback.filter((F.size("right") > 0) & (F.size(F.array_intersect("right", "wrong")) == 0))
    case = F.concat(F.lit("draft:"), F.substring(F.sha2(F.trim("query"), 256), 1, 16))
    return clear.groupBy(case.alias("case_id"), F.trim("query").alias("query")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("right")))).alias("expected_evidence"), F.when(F.min("rating") <= 2, "P0").otherwise("P1").alias("priority"))
