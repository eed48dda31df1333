"""The flagship plan: full-text retrieval over several indexes, fused."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fulltext, layers
from .registry import QUERIES, SQL, read
from . import log_queries, parse_queries, registry_more, store_queries  # noqa: F401  register their queries


def hybrid_search(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """For each benchmark item its documents, by two full-text indexes (whole
    texts, and first lines as titles) fused by weighted reciprocal ranks; the
    ``k`` best of each."""
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    titles = docs.select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))
    body = fulltext.search(docs, "doc_id", "text", items, "item_id", "text").withColumn("w", F.lit(0.6))
    title = fulltext.search(titles, "doc_id", "title", items, "item_id", "text").withColumn("w", F.lit(0.4))
    fused = fulltext.fuse(body.unionByName(title), ["item_id", "doc_id"], "w")
    return layers.newest(fused, ["item_id"], [F.desc("score"), F.col("doc_id")], k)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
