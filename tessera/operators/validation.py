"""Checks of a store and comparisons of collections (Q1-Q9)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .layers import resolve
from .store import Store

SEVERITY = {"info": 0, "caution": 1, "degraded": 2, "blocked": 3}


def _issues(rows: DataFrame, code: str, severity: str, kind: Column | str, key: Column) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return rows.select(F.lit(code).alias("check_code"), F.lit(severity).alias("severity"), F.concat_ws(":", kind, key).alias("object"))


def missing_index_rows(store: Store, index: dict[str, DataFrame] | None = None) -> DataFrame:
    """Live chunks and entities without a full-text row in their own layer (Q1)."""
    out = []
    for kind, table in (("chunk", "chunk_fts"), ("entity", "entity_fts")):
        for layer in ("overlay", "baseline"):
            rows = (index[layer] if index else store.index_rows(layer)).filter(F.col("index_name") == table).select("object_id").distinct()
            live = store.logical(kind).filter(F.col("source_index") == layer).select(F.col(f"{kind}_id").alias("object_id"))
            out.append(_issues(live.join(rows, "object_id", "left_anti"), "storage.fts_metadata_mismatch", "degraded", kind, F.col("object_id")))
    return reduce(DataFrame.unionByName, out)


def vector_mismatches(refs: DataFrame, rows: DataFrame) -> DataFrame:
    """References without a vector, vectors without a reference, and pairs that
    disagree in one of seven fields (Q2)."""
    fields = ("object_type", "object_id", "chunk_id", "embedding_model_version", "content_hash", "source_scope", "profile_id")
    side = lambda df, p: df.select("vector_ref_id", F.struct(*fields).alias(p))
    both = side(refs, "a").join(side(rows, "b"), "vector_ref_id", "full")
    code = F.when(F.col("b").isNull(), "storage.vector_ref_missing").when(F.col("a").isNull(), "storage.vector_payload_orphan").when(~F.col("a").eqNullSafe(F.col("b")), "storage.vector_ref_payload_mismatch")
    wrong = F.filter(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), f) for f in fields]), lambda x: x.isNotNull())
    fields_of = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), wrong).otherwise(F.array().cast("array<string>"))
    return both.select(code.alias("check_code"), F.lit("degraded").alias("severity"), F.concat_ws(":", F.lit("vector_ref"), "vector_ref_id").alias("object"), fields_of.alias("fields")).filter("check_code is not null")


def dangling_evidence(store: Store) -> DataFrame:
    """Evidence of missing files, chunks or entities (Q3)."""
    rows = store.evidence()
    files = rows.join(store.physical("file").select("file_id"), "file_id", "left_anti")
    chunks = rows.filter("chunk_id is not null").join(store.logical("chunk").select(F.col("logical_id").alias("chunk_id")), "chunk_id", "left_anti")
    entities = rows.filter("object_type = 'entity'").join(store.logical("entity").select(F.col("logical_id").alias("object_id")), "object_id", "left_anti")
    parts = [(files, "file", "file_id"), (chunks, "chunk", "chunk_id"), (entities, "entity", "object_id")]
    out = [r.select(F.lit("storage.dangling_evidence").alias("check_code"), F.lit("degraded").alias("severity"), F.concat_ws(":", F.lit("evidence"), "evidence_id").alias("object"), F.concat_ws(":", F.lit(k), c).alias("target")) for r, k, c in parts]
    return reduce(DataFrame.unionByName, out)


def tombstone_leaks(store: Store) -> DataFrame:
    """Objects that an active tombstone names and a view still shows (Q5)."""
    shown = [store.logical(k).select(F.lit(k).alias("object_type"), F.col("logical_id").alias("object_id")) for k in ("chunk", "entity")]
    shown += [df.select(F.lit(k).alias("object_type"), F.col(f"{k}_id").alias("object_id")) for k, df in (("relation", store.relations()), ("evidence", store.evidence()), ("vector_ref", store.vector_refs()))]
    visible = reduce(DataFrame.unionByName, shown).distinct()
    gone = store.overlay["tombstone"].filter(F.col("active") & (F.col("snapshot_id") == store.scope.snapshot_id)).select("object_type", "object_id").distinct()
    return _issues(gone.join(visible, ["object_type", "object_id"]), "storage.tombstone_leak", "blocked", F.col("object_type"), F.col("object_id"))


def replacement_loops(replacements: DataFrame) -> DataFrame:
    """(object_type, old_id, hops): active replacements that lead into a loop (Q6).

    A chain that stops before it would visit an object again ends on one that is
    itself replaced; ``resolve`` finds all ends in logarithmically many joins.
    """
    place = lambda c: F.struct("object_type", F.col(c).alias("id"))
    active = replacements.filter("active")
    last = active.groupBy("object_type", "old_object_id").agg(F.max_by("new_object_id", "replacement_id").alias("new_object_id"))
    pairs = last.select(place("old_object_id").alias("old_id"), place("new_object_id").alias("new_id"))
    ends = resolve(pairs)
    return ends.join(pairs.select(F.col("old_id").alias("final_id")), "final_id", "left_semi").select(F.col("old_id.object_type").alias("object_type"), F.col("old_id.id").alias("old_id"), "hops")


def stale_leases(locks: DataFrame, clock: Column) -> DataFrame:
    """Leases (lock_id, expires_at) that have run out but are still there (Q7)."""
    gone = locks.filter(F.to_timestamp("expires_at") <= clock)
    return _issues(gone, "storage.overlay_lock_stale", "caution", "job_lock", F.col("lock_id"))


def version_issues(found: DataFrame, expected: str) -> DataFrame:
    """Stores (target, version) that are missing (null) or of another version (Q8)."""
    missing = _issues(found.filter("version is null"), "storage.schema_missing", "degraded", "store", F.col("target"))
    return missing.unionByName(_issues(found.filter(F.col("version") != expected), "storage.schema_mismatch", "blocked", "store", F.col("target")))


def report_status(issues: DataFrame) -> DataFrame:
    """One row: blocked, degraded or ok, by the worst severity (Q8)."""
    worst = F.max(F.create_map(*[F.lit(x) for k, v in SEVERITY.items() for x in (k, v)])[F.col("severity")])
    return issues.agg(F.when(worst == 3, "blocked").when(worst == 2, "degraded").otherwise("ok").alias("status"), F.count("*").alias("issues"))


def compare_collections(left: DataFrame, right: DataFrame, key: str, sample: int = 10) -> DataFrame:
    """One row: counts, order-free digests and samples of ids that only one side has
    or that differ (Q9). Rows meet by id in a full outer join; digests are sums of
    row hashes, so no side is gathered."""
    columns = sorted(c for c in left.columns if c != key)
    if sorted(c for c in right.columns if c != key) != columns:
        raise ValueError("both collections need the same columns")
    side = lambda df, p: df.select(F.col(key), F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256).alias(p))
    both = side(left, "a").join(side(right, "b"), key, "full")
    kind = F.when(F.col("b").isNull(), "left").when(F.col("a").isNull(), "right").when(F.col("a") != F.col("b"), "changed")
    rows = both.withColumn("kind", kind)
    digest = lambda c: F.lower(F.hex(F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.conv(F.substring(F.sha2(F.concat_ws(":", key, c), 256), 1, 12), 16, 10).cast("bigint"))), F.lit(0))))
    counts = rows.agg(F.count("a").alias("left_count"), F.count("b").alias("right_count"), (F.count("kind") == 0).alias("equal"), digest("a").alias("left_digest"), digest("b").alias("right_digest"))
    for name, k in (("left_only", "left"), ("right_only", "right"), ("changed", "changed")):
        some = rows.filter(F.col("kind") == k).orderBy(key).limit(sample).agg(F.array_sort(F.collect_list(F.col(key))).alias(name))
        counts = counts.withColumn("one", F.lit(1)).join(some.withColumn("one", F.lit(1)), "one").drop("one")
    return counts
