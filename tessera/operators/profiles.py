"""Profiles: discovery, resolution, conditioned relations, states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.conditions import compile_condition
from ..parsers import build
from .lineage import cut, settled
from .store import newest_first

STATUS = {"candidate": 0, "stale": 1, "invalid": 2}
RELATIONS = {"enabled": "enabled_by", "disabled": "disabled_by", "unknown": "unknown_by"}


def snapshot_id(inventory_hash: Column, repo_hash: Column, project: Column, baseline: Column | None = None) -> Column:
    """A snapshot's id from what it holds: inventory, repositories, project, baseline."""
    revision = F.sha2(F.concat_ws("|", inventory_hash, repo_hash), 256)
    return F.concat(F.lit("snapshot:"), F.substring(F.sha2(F.concat_ws("|", project, revision, F.coalesce(baseline if baseline is not None else F.lit(None).cast("string"), F.lit("-"))), 256), 1, 20))


def repo_manifest_hash(repos: DataFrame) -> DataFrame:
    """One row: a digest of (relative_path, commit, dirty) rows in order of paths."""
    row = F.to_json(F.struct("relative_path", "commit", "dirty"), {"ignoreNullFields": "false"})
    ordered = F.array_sort(F.collect_list(F.struct("relative_path", row.alias("row"))))
    return repos.agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["row"]), "\n"), 256).alias("repo_hash"))


def profile_clues(settings: DataFrame, path: str = "path") -> DataFrame:
    """(path, app, board, features) of configuration files' settings (macro, value,
    value_type, enabled) (I11); a file's settings are one bounded list."""
    return build.clues(settings, path)


def match_defconfigs(dotconfigs: DataFrame, defconfigs: DataFrame) -> DataFrame:
    """(path, defconfig, score): the defconfig each .config fits best: 6 for its board,
    4 for its app, 3 for the id they derive; ties go to the first path (I21). Only
    pairs that share one of these meet."""
    ident = lambda p: F.concat_ws("-", F.col(f"{p}app"), F.col(f"{p}board"))
    side = lambda df, p: df.select(F.col("path").alias(f"{p}path"), F.col("app").alias(f"{p}app"), F.col("board").alias(f"{p}board"))
    a, b = side(dotconfigs, "a_"), side(defconfigs, "b_")
    keys = lambda p: F.explode(F.filter(F.array(F.concat(F.lit("b:"), f"{p}board"), F.concat(F.lit("a:"), f"{p}app")), lambda x: x.isNotNull())).alias("k")
    pairs = a.select("*", keys("a_")).join(b.select("*", keys("b_")), "k").drop("k").distinct()
    score = F.when(F.col("a_board") == F.col("b_board"), 6).otherwise(0) + F.when(F.col("a_app") == F.col("b_app"), 4).otherwise(0) + F.when(ident("a_") == ident("b_"), 3).otherwise(0)
    best = newest_first(pairs.withColumn("score", score), ["a_path"], F.desc("score"), F.col("b_path"))
    return dotconfigs.select("path").join(best.select(F.col("a_path").alias("path"), F.col("b_path").alias("defconfig"), "score"), "path", "left")


def candidate_class(app: Column, board: Column, has_dotconfig: Column, warnings: Column) -> Column:
    """(status, confidence) of a profile candidate."""
    both, some = app.isNotNull() & board.isNotNull(), app.isNotNull() | board.isNotNull()
    status = F.when(both, "candidate").when(some, "stale").otherwise("invalid")
    full = F.when(warnings, 0.88).otherwise(0.93)
    part = F.when(warnings, 0.72).otherwise(0.76)
    confidence = F.when(both & has_dotconfig, full).when(both, part).when(some, F.when(has_dotconfig, 0.60).otherwise(0.55)).otherwise(0.30)
    return F.struct(status.alias("status"), confidence.alias("confidence"))


def order_candidates(candidates: DataFrame) -> DataFrame:
    """Adds ``place``: by priority, status, relevance, time, then names."""
    status = F.create_map(*[F.lit(x) for k, v in STATUS.items() for x in (k, v)])
    order = [F.coalesce("priority", F.lit(10_000)), F.coalesce(F.try_element_at(status, "status"), F.lit(99)), F.desc("relevance"), F.desc(F.coalesce("mtime", F.lit(0.0))), F.col("profile_id"), F.coalesce("dotconfig_path", F.lit("")), F.coalesce("defconfig_path", F.lit(""))]
    return candidates.withColumn("place", F.row_number().over(Window.partitionBy("snapshot_id").orderBy(*order)))


def resolve_profiles(requests: DataFrame, candidates: DataFrame, baseline_default: str | None = None) -> DataFrame:
    """(request_id, status, profile_id, source, confidence) of requests (request_id,
    snapshot_id, requested) (I21): a named profile needs exactly one candidate of its
    name, ``auto`` exactly one eligible one, else the baseline's default, else it
    stays unresolved."""
    asked = requests.withColumn("named", F.when(~F.coalesce("requested", F.lit("auto")).isin("auto", "current", ""), F.col("requested")))
    counts = candidates.groupBy("snapshot_id", "profile_id").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))
    explicit = asked.join(counts.select("snapshot_id", F.col("profile_id").alias("named"), "n", F.col("confidence").alias("c_named")), ["snapshot_id", "named"], "left")
    eligible = candidates.filter("auto_eligible").groupBy("snapshot_id").agg(F.count("*").alias("n_auto"), F.first("profile_id").alias("p_auto"), F.first("confidence").alias("c_auto"), F.first("source").alias("s_auto"))
    fallback = counts.filter((F.col("profile_id") == F.lit(baseline_default)) & (F.col("n") == 1)).select("snapshot_id", F.col("profile_id").alias("p_base"), F.col("confidence").alias("c_base"))
    rows = explicit.join(eligible, "snapshot_id", "left").join(fallback, "snapshot_id", "left")
    by_name, one, many = F.col("named").isNotNull(), F.col("n_auto") == 1, F.col("n_auto") > 1
    base = F.col("p_base").isNotNull()
    none = F.lit(None)
    status = F.when(by_name, F.when(F.col("n") == 1, "resolved").otherwise("invalid")).when(one, "resolved").when(many, "multiple_candidates").when(base, "resolved").otherwise("unresolved")
    profile = F.when(by_name, F.when(F.col("n") == 1, F.col("named"))).when(one, F.col("p_auto")).when(many, none).when(base, F.col("p_base"))
    source = F.when(by_name, F.when(F.col("n") == 1, "explicit")).when(one, F.col("s_auto")).when(many, none).when(base, "baseline_default")
    confidence = F.when(by_name, F.when(F.col("n") == 1, F.greatest("c_named", F.lit(0.99)))).when(one, F.col("c_auto")).when(many, none).when(base, F.greatest("c_base", F.lit(0.75)))
    return rows.select("request_id", status.alias("status"), profile.alias("profile_id"), source.alias("source"), confidence.alias("confidence"))


# --- conditioned relations (I22, I23) ------------------------------------------------------------------


def macro_truth(value: Column, enabled: Column) -> Column:
    """Whether a macro holds: off is false, so is a value that says no; not set is null."""
    bare = F.lower(F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), "^[\"']+|[\"']+$", ""))
    return F.when(~enabled, False).when(enabled, (bare == "") | ~bare.isin("0", "false", "n", "off", "no"))


def effective_conditions(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(entity_id, expr, macros, targets, inherited, confidence): conditions of an
    entity's own guards and of the files that define it, joined by ``&&`` (I22).
    Parents of symbols are files, so one join reaches all."""
    kinds = entities.filter("entity_type <> 'Directory'").select("entity_id", "entity_type", "name")
    names = entities.select(F.col("entity_id").alias("dst_entity_id"), F.col("name").alias("dst_name"))
    guard = relations.filter("relation_type = 'guarded_by_macro'").join(kinds.select(F.col("entity_id").alias("src_entity_id")), "src_entity_id", "left_semi").join(names, "dst_entity_id", "left")
    said = F.from_json(F.get_json_object("metadata", "$.condition_macros"), "array<string>")
    macros = F.when(F.size(said) > 0, said).otherwise(F.array("dst_name"))
    trust = F.get_json_object("metadata", "$.confidence").cast("double")
    each = guard.select("src_entity_id", "dst_entity_id", "relation_id", F.get_json_object("metadata", "$.condition_expr").alias("expr"), macros.alias("macros"), trust.alias("trust"))
    own = each.groupBy(F.col("src_entity_id").alias("entity_id"), "expr").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("macros")))).alias("macros"), F.array_sort(F.collect_set(F.struct(F.col("dst_entity_id").alias("dst")))).alias("targets"), F.coalesce(F.min("trust"), F.lit(0.88)).alias("confidence"))
    own = own.withColumn("expr", F.coalesce("expr", F.array_join("macros", " && ")))
    parent = relations.filter("relation_type = 'defines'").join(entities.filter("entity_type = 'File'").select(F.col("entity_id").alias("src_entity_id")), "src_entity_id", "left_semi").join(entities.filter("entity_type not in ('File', 'Module', 'Directory')").select(F.col("entity_id").alias("dst_entity_id")), "dst_entity_id", "left_semi")
    down = parent.select(F.col("src_entity_id").alias("entity_id"), F.col("dst_entity_id").alias("child")).join(own, "entity_id").select(F.col("child").alias("entity_id"), "expr", "macros", "targets", "confidence", F.lit(0).alias("own"))
    rows = down.unionByName(own.withColumn("own", F.lit(1)))
    ordered = F.array_sort(F.collect_set(F.struct("own", "expr")))
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    exprs = F.array_distinct(F.transform(ordered, lambda x: x["expr"]))
    return rows.groupBy("entity_id").agg(F.array_join(exprs, " && ").alias("expr"), flat("macros").alias("macros"), flat("targets").alias("targets"), (F.min("own") == 0).alias("inherited"), F.min("confidence").alias("confidence"))


def evaluate(conditions: DataFrame, settings: DataFrame, block: int = 256) -> DataFrame:
    """(expr, profile_id, holds): distinct conditions under every profile's settings
    (profile_id, macro, value, enabled); null: unknown (I23).

    Distinct conditions are few beside entities; they are compiled to columns over
    a map of each profile's macros, a block at a time.
    """
    held = settings.withColumn("truth", macro_truth(F.col("value"), F.col("enabled")))
    maps = cut(held.groupBy("profile_id").agg(F.map_from_entries(F.collect_list(F.struct("macro", "truth"))).alias("truth"), F.map_from_entries(F.collect_list(F.struct("macro", "value"))).alias("value")))
    exprs = [r[0] for r in conditions.select("expr").distinct().orderBy("expr").collect()]
    out = None
    for at in range(0, len(exprs), block):
        some = exprs[at : at + block]
        each = F.array(*[F.struct(F.lit(e).alias("expr"), compile_condition(e, None, lambda m: F.try_element_at("truth", F.lit(m)), lambda m: F.try_element_at("value", F.lit(m))).alias("holds")) for e in some])
        part = maps.select("profile_id", F.explode(each).alias("e")).select("e.expr", "profile_id", "e.holds")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else maps.select(F.lit("").alias("expr"), "profile_id", F.lit(None).cast("boolean").alias("holds")).limit(0)


def conditioned_relations(entities: DataFrame, relations: DataFrame, settings: DataFrame, trust: DataFrame | None = None) -> DataFrame:
    """(relation_id, relation_type, src_entity_id, dst_entity_id, profile_id, expr,
    confidence): what each profile's settings make of each entity's conditions (I22).

    Evaluated once for each distinct condition and profile; entities then join
    their condition's outcome. Confidence is the lesser of profile and condition, at
    most .91 if inherited, .65 if unknown, .95 for modules. What is read of the
    tables is read many times, so it is worked out once.
    """
    entities = settled(entities.select("entity_id", "entity_type", "name"))
    relations = settled(relations.filter("relation_type in ('guarded_by_macro', 'defines')").select("relation_id", "relation_type", "src_entity_id", "dst_entity_id", "metadata"))
    conditions = settled(effective_conditions(entities, relations).join(entities.select("entity_id", "entity_type"), "entity_id"))
    rows = conditions.join(evaluate(conditions, settings), "expr")
    status = F.when(F.col("holds").isNull(), "unknown").when(F.col("holds"), "enabled").otherwise("disabled")
    if trust is not None:
        rows = rows.join(trust.select("profile_id", F.col("confidence").alias("p_trust")), "profile_id", "left")
    base = F.least("confidence", F.coalesce("p_trust", F.lit(1.0)) if trust is not None else F.lit(1.0))
    capped = F.least(base, F.when(F.col("inherited"), 0.91).otherwise(1.0), F.when(F.col("holds").isNull(), 0.65).otherwise(1.0), F.when(F.col("entity_type") == "Module", 0.95).otherwise(1.0))
    kind = F.create_map(*[F.lit(x) for k, v in RELATIONS.items() for x in (k, v)])[status]
    each = rows.select("*", F.explode("targets").alias("t"))
    rid = F.concat_ws(":", F.lit("relation:profile"), "profile_id", "entity_id", "t.dst")
    return each.select(rid.alias("relation_id"), kind.alias("relation_type"), F.col("entity_id").alias("src_entity_id"), F.col("t.dst").alias("dst_entity_id"), "profile_id", "expr", "macros", F.round(capped, 2).alias("confidence"))


def entity_states(relations: DataFrame, entities: DataFrame, profiles: DataFrame) -> DataFrame:
    """(entity_id, profile_id, status, confidence, expr, relation_ids) of stated
    entities in every profile (I24): unknown before disabled before enabled; no
    relation at all: not_applicable."""
    kinds = {v: k for k, v in RELATIONS.items()}
    rank = F.when(F.col("relation_type") == "unknown_by", 3).when(F.col("relation_type") == "disabled_by", 2).otherwise(1)
    rows = relations.filter(F.col("relation_type").isin(*kinds)).withColumn("rank", rank)
    once = rows.groupBy(F.col("src_entity_id").alias("entity_id"), "profile_id").agg(F.max("rank").alias("rank"), F.min("confidence").alias("confidence"), F.array_join(F.array_sort(F.collect_set("expr")), " && ").alias("expr"), F.array_sort(F.collect_set("relation_id")).alias("relation_ids"))
    every = entities.select("entity_id").distinct().withColumn("one", F.lit(1)).join(F.broadcast(profiles.select("profile_id").distinct().withColumn("one", F.lit(1))), "one").drop("one")
    status = F.when(F.col("rank") == 3, "unknown").when(F.col("rank") == 2, "disabled").when(F.col("rank") == 1, "enabled").otherwise("not_applicable")
    return every.join(once, ["entity_id", "profile_id"], "left").select("entity_id", "profile_id", status.alias("status"), "confidence", "expr", "relation_ids")


def latest_profiles(profiles: DataFrame, order: str = "profile_record_id") -> DataFrame:
    """One record a profile id, the last."""
    return newest_first(profiles, ["profile_id"], F.desc(order))


def rebuild_plan(before: DataFrame, after: DataFrame) -> DataFrame:
    """(profile_id, change): added, changed, removed, unchanged by config hash."""
    from .layers import diff

    return diff(latest_profiles(before), latest_profiles(after), ["profile_id"], "config_hash")
