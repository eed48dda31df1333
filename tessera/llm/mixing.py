"""A mix of sources by weight, of whole documents that are taken up to twice.

A document's size is its number of words. Sources in the order of their code
points, null last, have the weights 3, 1, 2, 3, ... and share ``TOTAL`` times
all words; a source's target is at most ``REPEATS`` times its own words, and
what that leaves over goes to the others by weight, until none is above.

A source's budget is met by counts alone: documents are counted by exact size,
and the sums of a source's sizes are the sums of (size x count). Of all
but ``TABLE`` words every size first gives the same share of its documents,
rounded down; the longest fill what is left until ``TABLE`` words or fewer
remain; a bounded knapsack over the counts that are left then finds the sum that
is nearest to them (the lower of two as near). A source is its distinct sizes here, never its documents. Last, of
each (source, size) so many documents are selected by a seeded hash, in buckets
of about ``BUCKET`` documents, so that a size which a third of all documents
share is many tasks.

Defined results: a null text has no words; empty texts have size 0 and are
taken 0 words; a null source is a source; null and repeated doc_ids are
documents of their own (of equal ones with equal sizes, any is taken); ties of
the hash go by doc_id; very long texts are counted a slice at a time, and one
that is longer than what its source still needs is left out; an empty table
gives no row; no other columns are read, and none of docs' names matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Weights in turn, words of the mix for one of the corpus, uses of a document (contract).
WEIGHTS, TOTAL, REPEATS = (3, 1, 2), 1.5, 2
#: Sums of the knapsack's table, documents that one task selects from at once.
TABLE, BUCKET = 1 << 17, 1 << 16
SEED = 42


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size) of each document."""

    def run(batches):
        for batch in batches:
            n = [sum(map(len, common.word_slices(x))) if x else 0 for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "size"])

    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, size bigint")


def numbered(scratch: common.Scratch, rows: DataFrame, *order) -> DataFrame:
    """Adds ``place`` from 0 in ``order``: ranges are sorted by themselves and start after those before them."""
    ranged = scratch.table(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a range
    starts = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(starts, "_part").select(*rows.columns, (F.col("_before") + within - 1).alias("place"))


def targets(scratch: common.Scratch, sources: DataFrame, weights=WEIGHTS, total: float = TOTAL, repeats: int = REPEATS) -> DataFrame:
    """(source, place, source_size, target). The level of a unit of weight rises
    until nothing more is above its limit; a round is one aggregate."""
    placed = numbered(scratch, sources, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    placed = scratch.table(placed.withColumns({"weight": weight, "limit": repeats * F.col("source_size").cast("double")}), "sources")
    level, whole = -1.0, None
    while True:
        full = F.col("limit") <= level * F.col("weight")
        words, rest, full_words = placed.agg(F.sum("source_size"), F.sum(F.when(~full, F.col("weight"))), F.sum(F.when(full, F.col("limit")))).first()
        whole = total * (words or 0) if whole is None else whole
        after = (whole - (full_words or 0.0)) / rest if rest else level
        if after <= level:
            return placed.select("source", "place", "source_size", F.least("limit", F.lit(level) * F.col("weight")).alias("target"))
        level = after


def fit(lengths: list[int], counts: list[int], budget: int, table: int = TABLE) -> list[int]:
    """How many of each length to take, so that the sum is near ``budget``."""
    every = sum(a * b for a, b in zip(lengths, counts, strict=True))
    budget = min(max(budget, 0), every)
    if budget == every:
        return list(counts)
    take = [n * max(0, budget - table) // every for n in counts]
    left = budget - sum(a * b for a, b in zip(lengths, take, strict=True))
    by_length = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in by_length:
        if left <= table:
            break
        k = min(counts[i] - take[i], left // lengths[i], -(-(left - table) // lengths[i]))
        take[i] += k
        left -= k * lengths[i]
    rest = [(i, counts[i] - take[i]) for i in by_length if counts[i] > take[i]]
    if not left or not rest:
        return take
    if left > table:  # each that is left is longer than what is missing: one more, or none
        i = rest[-1][0]
        take[i] += lengths[i] < 2 * left
        return take
    # The nearest sum may also lie above, by less than the longest document.
    top = left + min(lengths[rest[0][0]], table)
    reached, by = np.zeros(top + 1, bool), np.full(top + 1, -1, "i4")
    reached[0], items = True, []
    for i, n in rest:
        n, part = min(n, top // lengths[i]), 1
        while n and not reached[left]:
            k = min(part, n)
            n, part, w = n - k, 2 * part, k * lengths[i]
            new = np.flatnonzero(reached[: top + 1 - w] & ~reached[w:]) + w
            reached[new], by[new] = True, len(items)
            items.append((i, k, w))
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - left))])
    while at:
        i, k, w = items[by[at]]
        take[i] += k
        at -= w
    return take


def mix(docs: DataFrame, seed: int = SEED, weights=WEIGHTS, total: float = TOTAL, repeats: int = REPEATS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, uses), a row a document:
    ``uses`` is how often the mix has it, ``taken`` the words of that."""
    scratch = common.Scratch(docs.sparkSession)
    common.tune(docs.sparkSession)
    rows = scratch.table(sizes(docs), "document-sizes")
    sources = scratch.table(targets(scratch, rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, total, repeats), "targets")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    counted = rows.groupBy("source", "size").agg(F.count("*").alias("n"))
    counted = counted.join(sources, same(counted, sources)).select("place", "source_size", "target", "size", "n")
    # Uses that all documents have, and words that some of them add.
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    counted = counted.withColumn("base", base).withColumn("more", F.round(F.col("target") - F.col("base") * F.col("source_size")).cast("long"))

    def choose(group):
        some = group[group["size"] > 0].sort_values("size")
        take = fit(some["size"].tolist(), some["n"].tolist(), int(group["more"].iloc[0]))
        out = group[["place", "size", "n", "base", "source_size", "target"]].copy()
        return out.assign(take=out["size"].map(dict(zip(some["size"], take, strict=True))).fillna(0).astype("int64"))

    quotas = counted.groupBy("place").applyInPandas(choose, "place bigint, size bigint, n bigint, base int, source_size bigint, target double, take bigint")
    quotas = scratch.table(quotas, "quotas")

    drawn = rows.join(sources.select("source", "place"), same(rows, sources)).select("doc_id", rows["source"], "place", "size")
    drawn = drawn.join(quotas, ["place", "size"])
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 24)  # 40 bits
    drawn = drawn.withColumn("draw", draw).withColumn("bucket", F.shiftright(F.col("draw") * F.ceil(F.col("n") / BUCKET), 40))
    drawn = scratch.table(drawn, "drawn")
    held = drawn.groupBy("place", "size", "bucket").agg(F.count("*").alias("held"))
    before = F.sum("held").over(Window.partitionBy("place", "size").orderBy("bucket")) - F.col("held")
    held = held.select("place", "size", "bucket", before.alias("before"))
    order = F.row_number().over(Window.partitionBy("place", "size", "bucket").orderBy("draw", "doc_id"))
    chosen = drawn.join(held, ["place", "size", "bucket"]).withColumn("chosen", (F.col("before") + order <= F.col("take")).cast("int"))
    uses = F.col("base") + F.col("chosen")
    return chosen.select("doc_id", "size", "source_size", "target", (F.col("size") * uses).alias("taken"), "source", uses.alias("uses"))


def write_out(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself: each of ``docs`` as often as ``mixed`` uses it. doc_id must be
    unique; texts are joined by it once, after all is decided."""
    uses = mixed.filter("uses > 0").select(F.col("doc_id").alias("key"), "uses")
    rows = common.whole(docs, key=F.col("doc_id")).join(uses, "key")
    return rows.select(F.explode(F.array_repeat("row", F.col("uses").cast("int"))).alias("row")).select("row.*")
