"""Fusing ranked lists, reranking, evidence and statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .store import Store

#: Authority levels (fixed values); what isn't listed counts as unknown.
AUTHORITY = {"source_doc": 1.0, "api_doc": 0.95, "widget_doc": 0.92, "workspace_code": 0.82, "source_code": 0.80, "workspace_map": 0.68, "derived": 0.40, "synthetic": 0.28, "unknown": 0.20}
CODE_INTENTS = ("code_exact", "code_concept", "call_trace", "runtime_flow", "profile_diff", "workspace_nav", "evidence_lookup")
DOC_INTENTS = ("api_lookup", "widget_lookup", "product_context", "project_context", "unknown")
GRAPH_INTENTS = ("call_trace", "runtime_flow", "workspace_nav", "profile_diff")
SOURCES = {"baseline": 1, "merged": 2, "overlay": 3, "derived": 4}
MOST_EVIDENCE, EXCERPT = 20, 220


def authority(level: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in AUTHORITY.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(level))), F.lit(AUTHORITY["unknown"]))


def profile_match(candidate: Column, requested: Column) -> Column:
    """1 for the requested profile, .45 for rows of all; without a request .8, or .6 for rows of all (H4)."""
    c, r = F.lower(F.trim(candidate)), F.lower(F.trim(requested))
    return F.when(r.isin("", "auto", "all"), F.when(c == "all", 0.6).otherwise(0.8)).when(c == r, 1.0).when(c == "all", 0.45).otherwise(0.0)


def freshness(when: Column, clock: Column) -> Column:
    """Age in buckets of 7, 30, 90 and 365 days; what can't be read or is older: 0 (H5)."""
    at = F.try_to_timestamp(when) if not isinstance(when, str) else F.try_to_timestamp(F.col(when))
    age = F.greatest(F.lit(0.0), F.unix_micros(clock) - F.unix_micros(at)) / 86_400e6
    return F.when(at.isNull(), 0.0).when(age <= 7, 1.0).when(age <= 30, 0.8).when(age <= 90, 0.55).when(age <= 365, 0.25).otherwise(0.0)


def fuse(lists: DataFrame, k: int = 60) -> DataFrame:
    """Candidates of all retrievers as one row a (query_id, candidate_id) (H1, H2).

    ``lists`` has retriever, place (the retriever's order), weight, rank and the
    candidate's columns. Lists without weight are left out. Of several: first
    non-null title, path and scope, longest snippet, first profile that isn't
    ``all``, greatest score and proximity, least depth, best authority, newest
    time, highest source; lists are joined without repeats, in order.
    """
    rows = lists.filter("weight > 0")
    order = F.struct("place", "rank")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    text = lambda c: F.min_by(c, F.when(F.nullif(c, F.lit("")).isNotNull(), order)).alias(c)
    joined = lambda c: F.array_distinct(F.filter(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "rank", c))), lambda x: F.coalesce(x[c], F.array().cast("array<string>")))), lambda x: x != "")).alias(c)
    profile = F.coalesce(F.min_by("profile_id", F.when(F.col("profile_id") != "all", order)), F.lit("all"))
    back = F.struct((-F.col("place")).alias("p"), (-F.col("rank")).alias("r"))
    source = F.create_map(*[F.lit(x) for a, b in SOURCES.items() for x in (a, b)])
    seen = F.try_to_timestamp(F.col("freshness_ts"))
    signals = F.array_sort(F.collect_list(F.struct("place", "rank", "retriever", F.round("weight", 6).alias("weight"), F.round("raw_score", 6).alias("raw_score"), F.round(F.col("weight") / (k + F.col("rank")), 6).alias("rrf_score"))))
    return rows.groupBy("query_id", "candidate_id").agg(
        first("object_type"), text("title"), text("relative_path"), text("source_scope"),
        F.max_by("snippet", F.when(F.col("snippet").isNotNull(), F.struct(F.length("snippet").alias("n"), back.alias("b")))).alias("snippet"),
        profile.alias("profile_id"), F.max("raw_score").alias("raw_score"), F.min("graph_depth").alias("graph_depth"), F.max("graph_proximity").alias("graph_proximity"),
        F.max_by("authority_level", F.struct(authority(F.col("authority_level")).alias("a"), back.alias("b"))).alias("authority_level"),
        # Of equally new times the later list's form stays.
        F.max_by("freshness_ts", F.when(seen.isNotNull(), F.struct(seen.alias("t"), order.alias("o")))).alias("freshness_ts"),
        F.max_by("source_index", F.when(F.col("source_index").isNotNull(), F.struct(F.try_element_at(source, "source_index").alias("s"), back.alias("b")))).alias("source_index"),
        joined("module_names"), joined("evidence_keys"), joined("match_reasons"),
        F.transform(signals, lambda s: F.struct(s["retriever"].alias("retriever"), s["rank"].alias("rank"), s["weight"].alias("weight"), s["raw_score"].alias("raw_score"), s["rrf_score"].alias("rrf_score"))).alias("signals"),
        F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 6).alias("fused"),
    )


def intent_bonus(intent: Column, retrievers: Column, proximity: Column) -> Column:
    """.10 for a symbol hit on code intents, .08 for a vector hit on document intents,
    .08 of the proximity on graph intents (H6)."""
    code = F.when(intent.isin(*CODE_INTENTS) & F.array_contains(retrievers, "symbol"), 0.10).otherwise(0.0)
    doc = F.when(intent.isin(*DOC_INTENTS) & F.array_contains(retrievers, "vector"), 0.08).otherwise(0.0)
    return code + doc + F.when(intent.isin(*GRAPH_INTENTS), 0.08 * proximity).otherwise(0.0)


def rerank_score(fused: Column, authority_score: Column, profile: Column, fresh: Column, proximity: Column, lists: Column, bonus: Column) -> Column:
    """The fused score times one plus weighted evidence (H3)."""
    coverage = F.least(F.lit(1.0), lists / 3.0)
    return F.round(fused * (1 + 0.20 * authority_score + 0.15 * profile + 0.15 * fresh + 0.15 * proximity + 0.05 * coverage + bonus), 6)


def rerank(fused: DataFrame, clock: Column, requested_profile: Column | str = "all", mode: str = "lightweight") -> DataFrame:
    """Ranks candidates of (query_id, intent, ...) (H3-H7). ``none`` passes the fused
    score on; ``cross_encoder`` is the lightweight mode."""
    if mode not in ("none", "lightweight", "cross_encoder"):
        raise ValueError(f"unknown rerank mode {mode!r}")
    if mode == "none":
        w = Window.partitionBy("query_id").orderBy(F.desc("fused"), "candidate_id")
        return fused.withColumn("score", F.round("fused", 6)).withColumn("rank", F.row_number().over(w))
    requested = F.lit(requested_profile) if isinstance(requested_profile, str) else requested_profile
    proximity = F.greatest(F.coalesce("graph_proximity", F.lit(0.0)), F.coalesce(1 / (F.col("graph_depth") + 1), F.lit(0.0)))
    retrievers = F.transform("signals", lambda s: s["retriever"])
    score = rerank_score(F.col("fused"), authority(F.col("authority_level")), profile_match(F.col("profile_id"), requested), freshness(F.col("freshness_ts"), clock), proximity, F.size("signals"), intent_bonus(F.col("intent"), retrievers, proximity))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("fused"), "candidate_id")
    return fused.withColumn("score", score).withColumn("rank", F.row_number().over(w))


# --- evidence ---------------------------------------------------------------------------------


def evidence_type(path: Column, object_type: Column) -> Column:
    """What kind of evidence a path is."""
    low = F.lower(path)
    config = low.endswith(".config") | low.endswith("defconfig")
    kinds = F.when(object_type == "relation", "graph").when(object_type.isin("layer", "feature", "workspace"), "workspace").when(object_type == "profile", "profile")
    return F.when(config, "config").when(low.startswith("knowledge-sources/"), "doc").otherwise(F.coalesce(kinds, F.lit("code")))


def authority_level(path: Column, named: Column, fallback: Column | None = None) -> Column:
    """The level a row names, else the fallback, else one by its path."""
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    by_path = F.when(path.startswith("knowledge-sources/"), "source_doc").when(path.endswith(".config") | path.endswith("defconfig"), "profile_config").otherwise("workspace_code")
    return F.coalesce(given(named), *([] if fallback is None else [given(fallback)]), by_path)


def final_excerpt(text: Column, limit: int = EXCERPT) -> Column:
    """White space collapsed, cut, secrets out, cut again if that made it longer (H15); nothing: null."""
    return F.nullif(tx.excerpt(tx.redact(tx.excerpt(text, limit)), limit), F.lit(""))


def references(store: Store) -> DataFrame:
    """Evidence as it is shown: path, lines, excerpt, type, authority, content hash."""
    rows = store.evidence()
    chunks = store.physical("chunk").select("chunk_id", F.col("text").alias("c_text"), F.col("start_line").alias("c_start"), F.col("end_line").alias("c_end"), F.col("content_hash").alias("c_hash"))
    files = store.physical("file").select("file_id", "relative_path", F.col("content_hash").alias("f_hash"))
    entities = store.physical("entity").select(F.col("entity_id").alias("object_id"), F.lit("entity").alias("object_type"), F.col("start_line").alias("e_start"), F.col("end_line").alias("e_end"))
    rows = rows.join(chunks, "chunk_id", "left").join(files, "file_id", "left").join(entities, ["object_type", "object_id"], "left")
    own = lambda k: F.get_json_object("metadata", f"$.{k}")
    path = F.coalesce(F.nullif(F.trim(own("path")), F.lit("")), "relative_path", "citation_label")
    shown = final_excerpt(F.coalesce("excerpt", "c_text"))
    return rows.select(
        "evidence_id", "object_id", "object_type", "chunk_id", "file_id", "source_index", path.alias("path"), evidence_type(path, F.col("object_type")).alias("type"),
        F.coalesce("start_line", "c_start", "e_start").alias("start_line"), F.coalesce("end_line", "c_end", "e_end").alias("end_line"),
        authority_level(path, own("authority_level")).alias("authority_level"), shown.alias("excerpt"), F.coalesce(own("content_hash"), "c_hash", "f_hash", F.sha2(shown, 256)).alias("content_hash"),
    ).filter("path is not null")


def bundle(store: Store, ranked: DataFrame, most: int = MOST_EVIDENCE) -> DataFrame:
    """(query_id, place, evidence_id, type, path, ..., score, candidates, retrievers):
    evidence of ranked candidates (H13).

    A candidate's keys are looked up as evidence, chunk, object and file ids, in
    that order; equal (type, path, lines) are one, at the place of the first, with
    the best score and all candidates; the ``most`` first are kept.
    """
    shown = references(store)
    by = [F.struct(F.lit(p).alias("bucket"), F.col(c).alias("id")) for p, c in enumerate(("evidence_id", "chunk_id", "object_id", "file_id"))]
    index = shown.withColumn("by", F.explode(F.array(*by))).filter("by.id is not null").select(F.col("by.id").alias("key"), F.col("by.bucket").alias("bucket"), *shown.columns)
    keys = ranked.select("query_id", "candidate_id", F.col("rank").alias("c_rank"), F.round("score", 6).alias("score"), F.transform("signals", lambda s: s["retriever"]).alias("retrievers"), F.posexplode("evidence_keys").alias("k", "key"))
    hits = keys.join(index, "key")
    order = F.struct("c_rank", "k", "bucket", "evidence_id")
    key = ["query_id", "type", "path", "start_line", "end_line"]
    firsts = F.struct("evidence_id", "authority_level", "excerpt", "content_hash", "source_index", "object_type", "object_id")
    out = hits.groupBy(*key).agg(F.min(order).alias("order"), F.min_by(firsts, order).alias("e"), F.max("score").alias("score"), F.array_sort(F.collect_set("candidate_id")).alias("candidates"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("retrievers")))).alias("retrievers"))
    out = out.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("order"))).filter(F.col("place") <= most)
    return out.select("query_id", "place", "type", "path", "start_line", "end_line", "e.*", "score", "candidates", "retrievers")


def entity_evidence(store: Store, entities: DataFrame, most: int = MOST_EVIDENCE) -> DataFrame:
    """Evidence of each entity (entity_id), the ``most`` first (H14); an entity
    without any is its own evidence, by its path."""
    shown = references(store)
    hits = entities.select("entity_id").distinct().join(shown.filter("object_type = 'entity'"), F.col("entity_id") == F.col("object_id"))
    own = hits.groupBy("entity_id", "type", "path", "start_line", "end_line").agg(F.min("evidence_id").alias("evidence_id"))
    rest = entities.select("entity_id").distinct().join(own.select("entity_id").distinct(), "entity_id", "left_anti").join(store.physical("entity").select("entity_id", "path", "start_line", "end_line"), "entity_id")
    rest = rest.select("entity_id", evidence_type(F.col("path"), F.lit("entity")).alias("type"), "path", "start_line", "end_line", F.concat(F.lit("entity:"), "entity_id").alias("evidence_id"))
    w = Window.partitionBy("entity_id").orderBy("evidence_id")
    return own.unionByName(rest).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


# --- results ----------------------------------------------------------------------------------


def result_confidence(confidence: Column) -> Column:
    return F.round(F.least(F.lit(1.0), 0.85 * confidence + 0.15), 6)


def result_status(found: Column, confidence: Column, warnings: Column) -> Column:
    """ok, zero_result, low_confidence or partial_ready."""
    low = (confidence < 0.50) | F.array_contains(warnings, "router.low_confidence") | F.array_contains(warnings, "retrieval.low_confidence")
    return F.when(F.array_contains(warnings, "index.partial_ready"), "partial_ready").when(found == 0, "zero_result").when(low, "low_confidence").otherwise("ok")


def suggestions(query: Column) -> Column:
    """What to ask next when nothing is found (H20; fixed texts)."""
    base = F.trim(query)
    return F.array(*[F.concat(base, F.lit(x)) for x in (" 所在模块是什么？", " 请限定 profile_id 或 doc_type 后重试。", " 的相关证据有哪些？")])


def distinct_warnings(codes: Column) -> Column:
    """One warning a code, the first."""
    return F.array_distinct(codes)


def filter_items(rows: DataFrame, text: str, key: str, limit: int) -> DataFrame:
    """Items some field of which holds ``text``, whatever its case; the ``limit`` first by key."""
    every = F.lower(F.to_json(F.struct("*")))
    wanted = F.lower(F.trim(F.lit(text)))
    return rows.filter(F.contains(every, wanted)).orderBy(key).limit(limit)


# --- profiles -----------------------------------------------------------------------------------


def macro_diff(left: DataFrame, right: DataFrame, most: int = 12) -> DataFrame:
    """Macros (macro, value, enabled, value_type) that two profiles set differently,
    the ``most`` first by name (H18): null-safe, over a full outer join."""
    side = lambda df, p: df.select("macro", F.struct("value", "enabled", "value_type").alias(p))
    both = side(left, "a").join(side(right, "b"), "macro", "full").filter(F.col("macro").rlike("^CONFIG_[A-Z0-9_]+$"))
    differs = ~(F.col("a.value").eqNullSafe(F.col("b.value")) & F.col("a.enabled").eqNullSafe(F.col("b.enabled")) & F.col("a.value_type").eqNullSafe(F.col("b.value_type")))
    rows = both.filter(differs).orderBy("macro").limit(most)
    return rows.select("macro", display(F.col("a")).alias("left_value"), display(F.col("b")).alias("right_value"))


def display(setting: Column) -> Column:
    """A macro's value as it is shown; not set at all: missing."""
    value = F.nullif(F.trim(setting["value"]), F.lit(""))
    return F.when(setting.isNull(), "missing").otherwise(F.coalesce(value, F.when(setting["enabled"], "y"), F.when(~setting["enabled"], "n"), F.lit("unknown")))


def target_status(shown: Column, some_unknown: Column) -> Column:
    """enabled, disabled, unknown or not_applicable from a display value."""
    said = F.when(shown.isin("y", "1", "true", "True"), "enabled").when(shown.isin("n", "0", "false", "False"), "disabled").when(shown == "unknown", "unknown")
    return F.coalesce(said, F.when(some_unknown, "unknown").otherwise("not_applicable"))


def config_impact(profile: Column, macros: DataFrame, relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(profile_id, modules, files, symbols, unknown): what the relations of ``macros``
    (macro) to a profile touch (H18)."""
    hit = relations.filter(F.col("relation_type").isin("enabled_by", "disabled_by", "unknown_by") & (F.col("profile_id") == profile)).join(macros.select("macro").distinct(), "macro", "left_semi")
    rows = hit.join(entities.select(F.col("logical_id").alias("src_entity_id"), "entity_type", "name", "path"), "src_entity_id")
    names = lambda when, c: F.array_sort(F.collect_set(F.when(when, F.col(c))))
    kind = F.col("entity_type")
    return rows.groupBy("profile_id").agg(names(kind == "Module", "name").alias("modules"), names(kind == "File", "path").alias("files"), names(~kind.isin("Module", "File"), "name").alias("symbols"), F.bool_or(F.col("relation_type") == "unknown_by").alias("unknown"))
