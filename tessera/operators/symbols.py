"""Symbols: candidates of a name among entities, and which of them is meant (Y)."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as tx
from .fulltext import module_names, search_store
from .lineage import settled
from .store import Store

#: Types that a request for a kind of entity means, and their order in ties (fixed values).
TYPES = {
    "auto": ("Function", "Macro", "Type", "File", "Module", "Directory"), "symbol": ("Function", "Macro", "Type"), "function": ("Function",), "macro": ("Macro",),
    "type": ("Type",), "file": ("File",), "module": ("Module",), "directory": ("Directory",),
}
LEAST_RATIO, LEAST_MATCHES, LEAST_MENTIONS = 0.72, 24, 24


def types_of(kind: str | None) -> tuple[str, ...]:
    """Entity types of a request; what isn't known means all."""
    return TYPES.get((kind or "auto").strip().lower(), TYPES["auto"])


def exact_score(query: Column) -> Column:
    """The rung of the ladder on which the query equals an entity's name, qualified
    name, relative path, file name or path; null: none (Y2)."""
    rungs = (("name", 1.0), ("qualified_name", 0.99), ("relative_path", 0.98), (F.element_at(F.split("relative_path", "/"), -1), 0.97), ("path", 0.96))
    return F.coalesce(*[F.when(query == tx.exact_form(F.col(c) if isinstance(c, str) else c), score) for c, score in rungs])


def alias_score(exact: Column, lookup: Column) -> Column:
    """.94 if some alias equals the query in exact or lookup form."""
    return F.when(F.exists("aliases", lambda a: (exact == tx.exact_form(a)) | (lookup == tx.lookup_form(a))), 0.94)


@F.pandas_udf(DoubleType())
def _ratio(query: pd.Series, targets: pd.Series) -> pd.Series:
    matcher = SequenceMatcher(None)
    out = []
    for q, several in zip(query, targets, strict=True):
        best = 0.0
        for t in several:
            matcher.set_seqs(q, t)
            if matcher.real_quick_ratio() > best and matcher.quick_ratio() > best:
                best = max(best, matcher.ratio())
        out.append(best)
    return pd.Series(out, dtype="float64")


def similarity(query: Column, targets: Column) -> Column:
    """The best of token overlap, containment (.88) and matching ratio over lookup
    forms (Y4). The ratio, which has no built-in form, is worked out only where the
    others stay below .88 and lengths leave room for ``LEAST_RATIO``."""
    words = F.array_distinct(F.split(query, " "))

    def overlap(t: Column) -> Column:
        other = F.array_distinct(F.split(t, " "))
        return F.size(F.array_intersect(words, other)) / F.greatest(F.size(words), F.size(other))

    score = lambda t: F.when(t == query, 1.0).otherwise(F.greatest(overlap(t), F.when((F.instr(t, query) > 0) | (F.instr(query, t) > 0), 0.88).otherwise(0.0)))
    native = F.coalesce(F.array_max(F.transform(targets, score)), F.lit(0.0))
    room = F.filter(targets, lambda t: 2 * F.least(F.length(t), F.length(query)) >= LEAST_RATIO * (F.length(t) + F.length(query)))
    ratio = F.when((native < 1.0) & (F.size(room) > 0), _ratio(query, room)).otherwise(0.0)
    return F.when(query == "", 0.0).otherwise(F.greatest(native, ratio))


def fuzzy_score(ratio: Column, fts_rank: Column) -> Column:
    """Null without a match: neither a ratio of ``LEAST_RATIO`` nor a full-text rank."""
    by_ratio = F.when(ratio >= LEAST_RATIO, 0.72 + F.least(F.lit(0.18), 0.18 * ratio))
    by_rank = 0.70 + 0.12 / fts_rank
    return F.greatest(by_ratio, by_rank)


def terms_of_entities(entities: DataFrame) -> DataFrame:
    """(term, entity): exact and lookup forms of names, qualified names and aliases."""
    names = F.concat(F.array("name", "qualified_name"), F.col("aliases"))
    forms = F.array_distinct(F.concat(F.transform(names, tx.exact_form), F.transform(names, tx.lookup_form)))
    return entities.select("logical_id", F.explode(forms).alias("term")).filter("term <> ''").distinct()


def doc_mentions(store: Store, entities: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    """(query_id, logical_id, mention_paths): source documents found for a query
    whose symbol lists name an entity (Y5)."""
    found = search_store(store, "chunk_fts", queries, max(6 * top_k, LEAST_MENTIONS)).select("query_id", "rank", F.col("object_id").alias("chunk_id"))
    none = F.array().cast("array<string>")
    lists = [tx.metadata_list(F.col("metadata"), k) for k in ("code_symbols", "symbol_names", "symbols")]
    named = F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists], none)
    chunks = store.physical("chunk").select("chunk_id", "file_id", named.alias("symbols"))
    files = store.scoped("file").filter("source_id <> 'workspace'").select("file_id", "relative_path")
    said = found.join(chunks, "chunk_id").join(files, "file_id").select("query_id", "rank", "relative_path", F.explode("symbols").alias("symbol"))
    said = said.select("query_id", "rank", "relative_path", F.explode(F.array_distinct(F.array(tx.exact_form(F.col("symbol")), tx.lookup_form(F.col("symbol"))))).alias("term"))
    hit = said.join(terms_of_entities(entities), "term").groupBy("query_id", "logical_id", "relative_path").agg(F.min("rank").alias("rank"))
    paths = F.transform(F.array_sort(F.collect_list(F.struct("rank", "relative_path"))), lambda x: x["relative_path"])
    return hit.groupBy("query_id", "logical_id").agg(paths.alias("mention_paths"))


def evidence_ids(store: Store) -> DataFrame:
    """(logical_id, evidence_ids) of entities."""
    rows = store.evidence().filter("object_type = 'entity'")
    return rows.groupBy(F.col("object_id").alias("logical_id")).agg(F.array_sort(F.collect_list("evidence_id")).alias("evidence_ids"))


def disambiguation(modules: Column) -> Column:
    """Type, path or qualified name, first module, profile."""
    module = F.when(F.size(modules) > 0, F.concat(F.lit("module="), modules[0]))
    profile = F.when(F.col("profile_id") != "all", F.concat(F.lit("profile="), "profile_id"))
    return F.concat_ws(" | ", "entity_type", F.coalesce(F.nullif("relative_path", F.lit("")), "qualified_name"), module, profile)


def candidates(store: Store, queries: DataFrame, top_k: int = 5, entity_type: str | None = None, mentions: bool = True) -> DataFrame:
    """The ``top_k`` candidates of each query (query_id, query), best first.

    Queries are a stated set and meet all entities in a broadcast of checked size,
    where all pairs are scored and only those with a score go on; pairs that full
    text or documents name join by their ids. The score is the best of exact, alias
    and fuzzy, raised by document mentions; ``total`` counts all candidates.
    """
    kinds = types_of(entity_type)
    files = store.scoped("file").select("file_id", "relative_path")
    entities = store.logical("entity").filter(F.col("entity_type").isin(*kinds)).join(files, "file_id", "left")
    entities = entities.withColumn("aliases", tx.metadata_list(F.col("metadata"), "aliases"))
    asked = queries.select("query_id", tx.exact_form(F.col("query")).alias("q_exact"), tx.lookup_form(F.col("query")).alias("q_lookup"), "query")
    words = asked.select("query_id", F.coalesce(F.nullif("q_lookup", F.lit("")), "query").alias("query"))
    ranks = search_store(store, "entity_fts", words, max(4 * top_k, LEAST_MATCHES)).select("query_id", "logical_id", F.col("rank").alias("fts_rank"))
    forms = F.concat(F.array("name", "qualified_name", "path"), F.when(F.col("relative_path").isNotNull(), F.array("relative_path")).otherwise(F.array().cast("array<string>")), F.col("aliases"))
    entities = entities.withColumn("targets", F.array_distinct(F.filter(F.transform(forms, tx.lookup_form), lambda t: t != "")))
    n = asked.count()
    if n > 4096:
        raise ValueError("queries go in blocks of at most 4,096")
    if mentions:
        named = ranks.join(doc_mentions(store, entities, words, top_k), ["query_id", "logical_id"], "full")
    else:
        named = ranks.withColumn("mention_paths", F.lit(None).cast("array<string>"))
    named = settled(named)
    own = {"exact": exact_score(F.col("q_exact")), "alias": alias_score(F.col("q_exact"), F.col("q_lookup")), "ratio": similarity(F.col("q_lookup"), F.col("targets"))}
    pairs = entities.withColumn("one", F.lit(1)).join(F.broadcast(asked.withColumn("one", F.lit(1))), "one").drop("one").withColumns(own)
    pairs = pairs.filter(F.col("exact").isNotNull() | F.col("alias").isNotNull() | (F.col("ratio") >= LEAST_RATIO)).join(named.select("query_id", "logical_id"), ["query_id", "logical_id"], "left_anti")
    pairs = pairs.unionByName(named.join(entities, "logical_id").join(asked, "query_id").withColumns(own), allowMissingColumns=True)
    pairs = pairs.withColumn("fuzzy", fuzzy_score(F.col("ratio"), F.col("fts_rank")))
    base, said = F.greatest("exact", "alias", "fuzzy"), F.coalesce(F.size("mention_paths") > 0, F.lit(False))
    score = F.when(base.isNull() & said, 0.62).otherwise(base + F.when(said, 0.10).otherwise(0.0))
    kinds_of_match = F.filter(F.array(*[F.when(F.col(k).isNotNull(), F.lit(k)) for k in ("exact", "alias", "fuzzy")], F.when(said, "doc_mention")), lambda x: x.isNotNull())
    found = pairs.withColumns({"score": F.round(score, 6), "match_kinds": kinds_of_match}).filter("score is not null")
    found = settled(found.select("query_id", "logical_id", "file_id", "entity_type", "name", "qualified_name", "path", "relative_path", "profile_id", "source_index", "score", "match_kinds", "mention_paths"))
    priority = F.array_position(F.array(*map(F.lit, TYPES["auto"])), F.col("entity_type"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), priority, "name", F.coalesce("relative_path", "path"), "logical_id")
    # The count is an aggregate of its own, so that the limit can cut groups before they are whole.
    totals = found.groupBy("query_id").agg(F.count("*").alias("total"))
    best = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)
    best = best.join(module_names(store), "file_id", "left").join(evidence_ids(store), "logical_id", "left").join(totals, "query_id")
    modules = F.coalesce("modules", F.array().cast("array<string>"))
    shown = ["query_id", "rank", "logical_id", "entity_type", "name", "qualified_name", "relative_path", "profile_id", "source_index", "score", "match_kinds", "total", "mention_paths"]
    return best.select(*shown, disambiguation(modules).alias("disambiguation"), F.coalesce("evidence_ids", F.array().cast("array<string>")).alias("evidence_ids"))


def resolve_status(keys: DataFrame, found: DataFrame, lead: float = 0.15) -> DataFrame:
    """(key, status, selected) from candidates (key, id, score, exact) (Y9): none is
    zero_result; one, or one exact match, or an exact best one that leads by
    ``lead`` is resolved; else multi_result. Two maxima and counts, no lists."""
    order = F.struct("score", F.col("exact").alias("e"), "id")
    best = found.groupBy("key").agg(F.count("*").alias("n"), F.count_if("exact").alias("n_exact"), F.max_by(F.struct("id", "score", "exact"), order).alias("top"), F.max_by("id", F.when(F.col("exact"), F.col("score"))).alias("exact_id"))
    second = found.join(best.select("key", F.col("top.id").alias("top_id")), "key").filter(~F.col("id").eqNullSafe(F.col("top_id"))).groupBy("key").agg(F.max("score").alias("second"))
    rows = keys.join(best, "key", "left").join(second, "key", "left")
    ahead = F.col("top.exact") & (F.round(F.col("top.score") - F.col("second"), 9) >= lead)
    status = F.when(F.col("n").isNull(), "zero_result").when((F.col("n") == 1) | (F.col("n_exact") == 1) | ahead, "resolved").otherwise("multi_result")
    chosen = F.when(F.col("n") == 1, F.col("top.id")).when(F.col("n_exact") == 1, F.col("exact_id")).when(ahead, F.col("top.id"))
    return rows.select("key", status.alias("status"), chosen.alias("selected"))
