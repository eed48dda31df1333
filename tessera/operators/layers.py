"""Baseline and overlay tables, scopes, tombstones and replacements (A13-A15, B, C)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settled


def in_scope(profile: str = "all", source: str = "all", profile_col: str = "profile_id", source_col: str = "source_scope") -> Column:
    """``all`` filters nothing when asked for, and is visible to every scope in a row."""
    out = F.lit(True)
    for asked, c in ((profile, profile_col), (source, source_col)):
        if asked != "all":
            out = out & F.col(c).isin(asked, "all")
    return out


def merge(layers: list[DataFrame], keys: list[str], order: list | None = None) -> DataFrame:
    """Rows of all layers, for each key the one of the first layer."""
    every = None
    for rank, layer in enumerate(layers):
        layer = layer.withColumn("layer_rank", F.lit(rank))
        every = layer if every is None else every.unionByName(layer)
    w = Window.partitionBy(*keys).orderBy("layer_rank", *(order or []))
    return every.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed upsert as a new version: changed rows, and base rows of other keys (B1)."""
    return changes.unionByName(base.join(changes.select(*keys).distinct(), keys, "left_anti"))


def live(rows: DataFrame, tombstones: DataFrame, key: str, ids: tuple[str, str] = ("object_id", "baseline_id")) -> DataFrame:
    """Rows that no active tombstone names by object or by baseline id."""
    gone = tombstones.filter("active").select(F.explode(F.array(*ids)).alias(key)).filter(F.col(key).isNotNull()).distinct()
    return rows.join(gone, key, "left_anti")


def best_replacement(replacements: DataFrame) -> DataFrame:
    """One replacement of each object: the newest, then the greatest id."""
    w = Window.partitionBy("old_id").orderBy(F.desc("created_at"), F.desc("replacement_id"))
    return replacements.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def resolve(pairs: DataFrame, most: int | None = None) -> DataFrame:
    """(old_id, final_id, hops): replacement chains followed to their end.

    Pointer jumping: each round doubles the reach, so rounds grow with the
    logarithm of the longest chain; each round ends its lineage, else plans would
    double with it. While a chain is unfinished some row of it finishes in each
    round, so a round that finishes none leaves only rows that lead to loops.
    These stop before the first object they would visit again. Chains of any
    length are followed; if ``most`` is given, one of more hops is an error.
    """
    now, before = pairs.select("old_id", F.col("new_id").alias("final_id"), F.lit(1).alias("hops")), None
    for _ in range(64):
        step = now.select(F.col("old_id").alias("final_id"), F.col("final_id").alias("_next"), F.col("hops").alias("_more"))
        go = F.col("_next").isNotNull()
        joined = now.join(step, "final_id", "left")
        now = settled(joined.select("old_id", F.when(go, F.col("_next")).otherwise(F.col("final_id")).alias("final_id"), (F.col("hops") + F.when(go, F.col("_more")).otherwise(0)).alias("hops"), go.alias("_moved")))
        moved = now.filter("_moved").count()
        ended = now.filter("not _moved").drop("_moved")
        if not moved:
            break
        if moved == before:
            ended = ended.unionByName(_around(pairs.join(now.filter("_moved").select("old_id"), "old_id", "left_semi"), moved))
            break
        now, before = now.drop("_moved"), moved
    else:
        raise RuntimeError("replacement chains did not end in 64 rounds")
    if most is not None and ended.filter(F.col("hops") > most).limit(1).count():
        raise ValueError(f"a replacement chain has more than {most} hops")
    return ended


def _around(pairs: DataFrame, total: int) -> DataFrame:
    """``resolve`` for ``total`` replacements that all lead to loops.

    Where the objects that are reached get no fewer over as many steps again, each
    is on a loop; where no row's least object gets less in such a round, every loop
    has been seen whole. So rounds grow with the longest loop and way to one.
    """
    now, before = pairs.select("old_id", F.col("new_id").alias("far"), F.col("old_id").alias("least")), None
    for _ in range((total - 1).bit_length()):
        step = now.select(F.col("old_id").alias("far"), F.col("far").alias("_far"), F.col("least").alias("_least"))
        now = settled(now.join(step, "far").select("old_id", F.col("_far").alias("far"), F.least("least", "_least").alias("least"), (F.col("_least") < F.col("least")).alias("_less")))
        reached, less = now.agg(F.count_distinct("far"), F.count_if("_less")).first()
        if reached == before and not less:
            break
        before = reached
    # What is reached now is all that is on a loop.
    on = now.select(F.col("far").alias("old_id")).distinct()
    ring = settled(pairs.join(on, "old_id", "left_semi").join(now.select("old_id", "least"), "old_id"))
    sizes = ring.groupBy("least").agg(F.count("*").cast("int").alias("_size"))
    stops = ring.join(sizes, "least").select(F.col("new_id").alias("_entry"), F.col("old_id").alias("final_id"), F.col("_size"))
    entries = ring.select("old_id", F.col("old_id").alias("_entry"), F.lit(0).alias("_hops"))
    tails = resolve(pairs.join(on, "old_id", "left_anti")).select("old_id", F.col("final_id").alias("_entry"), F.col("hops").alias("_hops"))
    return entries.unionByName(tails).join(stops, "_entry").select("old_id", "final_id", (F.col("_hops") + F.col("_size") - 1).alias("hops"))


def redirect_edges(edges: DataFrame, nodes: DataFrame, moved: DataFrame) -> DataFrame:
    """Relations with endpoints redirected, both ends live."""
    for end in ("src", "dst"):
        to = moved.select(F.col("old_id").alias(end), F.col("final_id").alias("_to"))
        edges = edges.join(to, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
        edges = edges.join(nodes.select(F.col("node").alias(end)), end, "left_semi")
    return edges


def cascade(parents: DataFrame, children: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """Tombstones of parents' ids and of their children: (type, table, id, parent column)."""
    out = parents.select(F.lit("file").alias("object_type"), F.col("id").cast("string").alias("object_id"))
    for kind, table, key, parent in children:
        hit = table.join(parents.select(F.col("id").alias(parent)), parent, "left_semi")
        out = out.union(hit.select(F.lit(kind).alias("object_type"), F.col(key).cast("string").alias("object_id")))
    return out.distinct()


def newest(rows: DataFrame, keys: list[str], order: list[Column], keep: int) -> DataFrame:
    """The first ``keep`` rows of each key (B16 retention, top-k of a group)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= keep).drop("_n")


def diff(old: DataFrame, new: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """(keys, change): added, removed, changed or unchanged."""
    a, b = old.select(*keys, F.col(digest).alias("_a"), F.lit(1).alias("_in_old")), new.select(*keys, F.col(digest).alias("_b"), F.lit(1).alias("_in_new"))
    change = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("changed")
    return a.join(b, keys, "full").select(*keys, change.alias("change"))


def inventory_hash(rows: DataFrame, keys: list[str], row: Column) -> DataFrame:
    """Order-free digest of all rows of each key (A10).

    Row digests meet in 4096 buckets by their first three digits, so a key of
    very many rows is spread; a bucket's digest covers its sorted rows, a key's
    digest its buckets in order.
    """
    hashed = rows.select(*keys, F.md5(row).alias("_h"))
    buckets = hashed.groupBy(*keys, F.substring("_h", 1, 3).alias("_b")).agg(F.md5(F.array_join(F.array_sort(F.collect_list("_h")), "")).alias("_d"))
    ordered = F.array_sort(F.collect_list(F.struct("_b", "_d")))
    return buckets.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["_d"]), ""), 256).alias("inventory"))
