"""Graph expansion over typed relations (G)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut

SYNTHETIC = ("belongs_to_layer", "implements_feature")
#: Relations that an intent follows (fixed values).
BY_INTENT = {
    "code_exact": ("contains", "defines", "belongs_to_module"),
    "code_concept": ("contains", "defines", "belongs_to_module", "belongs_to_layer"),
    "call_trace": ("calls", "contains", "defines", "guarded_by_macro"),
    "runtime_flow": (
        "calls", "guarded_by_macro", "belongs_to_layer", "implements_feature", "creates_task", "runs_in_context", "posts_to_queue", "waits_on_queue", "waits_on_semaphore",
        "signals_semaphore", "waits_on_event", "signals_event", "creates_timer", "starts_timer", "triggers", "mapped_to_vector", "reports_fault",
    ),
    "profile_diff": ("guarded_by_macro", "enabled_by", "disabled_by", "unknown_by"),
    "api_lookup": ("defines", "implements_feature"),
    "widget_lookup": ("implements_feature", "belongs_to_layer"),
    "workspace_nav": ("contains", "belongs_to_layer", "implements_feature"),
    "product_context": ("implements_feature", "belongs_to_layer"),
    "project_context": ("implements_feature",),
    "evidence_lookup": ("contains", "defines", "implements_feature"),
    "unknown": ("contains", "defines", "belongs_to_layer", "implements_feature"),
}
DEEP = ("call_trace", "runtime_flow", "workspace_nav", "profile_diff")


def relation_types(intent: str) -> tuple[str, ...]:
    """What an intent follows."""
    return BY_INTENT[intent]


def depth_of(intent: str) -> int:
    return 2 if intent in DEEP else 1


def seeds_of(candidates: DataFrame, selected: str | None = None) -> DataFrame:
    """(node): a query's three best symbols, else the client's selection."""
    best = candidates.filter("rank <= 3").select(F.col("logical_id").alias("node")).distinct()
    if selected is None or not selected.strip():
        return best
    other = candidates.sparkSession.createDataFrame([(selected.strip(), 1)], "node string, one int")
    some = candidates.limit(1).select(F.lit(1).alias("one"))
    return best.unionByName(other.join(some, "one", "left_anti").select("node"))


def expand(edges: DataFrame, seeds: DataFrame, depth: int, types: tuple[str, ...] | None = None, live: DataFrame | None = None) -> DataFrame:
    """(node, depth): undirected breadth-first distances up to ``depth`` (G1), over
    relations of ``types`` (none at all if that is empty) between live nodes.

    One join a hop; a node keeps its least depth. Each hop ends its lineage, as
    the next one reads it twice.
    """
    if types is not None:
        edges = edges.filter(F.col("relation_type").isin(*types)) if types else edges.limit(0)
    if live is not None:
        known = live.select("node").distinct()
        seeds = seeds.join(known, "node", "left_semi")
        for end in ("src", "dst"):
            edges = edges.join(known.withColumnRenamed("node", end), end, "left_semi")
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = seeds.select("node", F.lit(0).alias("depth")).distinct()
    for hop in range(1, depth + 1):
        front = seen.filter(F.col("depth") == hop - 1).select(F.col("node").alias("src"))
        reached = both.join(front, "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        seen = seen.union(reached.select("node", F.lit(hop).alias("depth"))).groupBy("node").agg(F.min("depth").alias("depth"))
        seen = cut(seen)
    return seen


def dangling(edges: DataFrame, live: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """Relations that a traversal skips, as an end is no live node."""
    if types is not None:
        edges = edges.filter(F.col("relation_type").isin(*types)) if types else edges.limit(0)
    return orphans(edges, live)


def traversed(edges: DataFrame, reached: DataFrame, depth: int | None = None, types: tuple[str, ...] | None = None) -> DataFrame:
    """Relations that a search up to ``depth`` crosses; their depth is the greater
    endpoint's (G2). Two nodes of the last hop are not expanded, so a relation
    between them is not crossed; without ``depth`` it counts."""
    if types is not None:
        edges = edges.filter(F.col("relation_type").isin(*types)) if types else edges.limit(0)
    a = reached.select(F.col("node").alias("src"), F.col("depth").alias("a"))
    b = reached.select(F.col("node").alias("dst"), F.col("depth").alias("b"))
    out = edges.join(a, "src").join(b, "dst")
    if depth is not None:
        out = out.filter(F.least("a", "b") < depth)
    return out.select("src", "dst", "relation_type", F.greatest("a", "b").alias("depth"))


def projected(members: DataFrame, reached: DataFrame, depth: int, kind: str) -> tuple[DataFrame, DataFrame]:
    """Synthetic nodes and relations of layers or features (G3): ``members`` is
    (item, node); an item is one hop beyond its nearest member, if that is allowed."""
    hit = members.join(reached, "node").filter(F.col("depth") + 1 <= depth).distinct()
    nodes = hit.groupBy(F.col("item").alias("node")).agg((F.min("depth") + 1).alias("depth"), F.array_sort(F.collect_set("node")).alias("members"))
    name = F.concat_ws(":", F.lit("synthetic"), F.lit(kind), "node", "item")
    edges = hit.select(name.alias("relation_id"), F.col("node").alias("src"), F.col("item").alias("dst"), F.lit(kind).alias("relation_type"), (F.col("depth") + 1).alias("depth"))
    return nodes, edges


def orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations an endpoint of which is no live node."""
    known = nodes.select("node").distinct()
    src = edges.join(known.select(F.col("node").alias("src")), "src", "left_anti").select("src", "dst", "relation_type")
    dst = edges.join(known.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst", "relation_type")
    return src.union(dst).distinct()
