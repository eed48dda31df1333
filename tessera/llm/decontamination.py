"""Benchmark decontamination: item-sized windows against benchmark items.

Words are lower-cased runs of letters and digits; shingles are five words (a
text of fewer words is one shingle). A window has its item's number of words
and starts where a shingle of the document lines up with the same shingle of
the item: a window that shares none has similarity 0. Each window's SimHash is
compared with the item's by multi-index blocks: ``radius`` + 1 blocks, so all
fingerprints within the radius share one; the exact multiset Jaccard
similarity of the shingles then decides. DataFrame functions only.

Scale: documents are read once and never shuffled; only lined-up windows are.
The benchmark is broadcast in blocks of at most ``BLOCK`` shingles (a checked
size); a larger benchmark takes more passes, not a larger broadcast.

Defined results: null or empty texts and items without words match nothing;
null doc_ids are kept as such; repeated rows give one row a (doc_id, item_id);
a document shorter than an item is one window; ties take the first window;
extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import Scratch

BLOCK = 1_000_000
SIMILARITY, RADIUS, SHINGLE = 0.8, 20, 5


def with_shingles(df: DataFrame, name: str, k: int = SHINGLE) -> DataFrame:
    """Adds hashes of all shingles of ``text`` in order, repeats included; no
    words: empty. Words are a column of their own, since an expression inside a
    lambda would be evaluated again for every shingle."""
    words = F.col("_words")
    found = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, k)))
    return df.withColumn("_words", found).withColumn(name, F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(each)).drop("_words", "text")


def simhash(hashes: Column) -> Column:
    """64 bits, each 1 where over half of the hashes have it."""
    ones = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.aggregate(hashes, F.lit(0), lambda a, h: a + F.getbit(h, b).cast("int")))
    bits = F.transform(ones, lambda n, b: F.when(2 * n > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))


def blocks(fingerprint: Column, radius: int) -> Column:
    """The ``radius`` + 1 blocks of a fingerprint, each marked with its place."""
    edges = [round(k * 64 / (radius + 1)) for k in range(radius + 2)]
    return F.array(*[F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("bigint")) + F.lit(k << 40).cast("bigint") for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two multisets of hashes."""
    both = F.aggregate(F.array_distinct(b), F.lit(0), lambda n, x: n + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))
    return both / (F.size(a) + F.size(b) - both)


def matches(docs: DataFrame, items: DataFrame, at_least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, start_word, similarity): the best window of each item in a document."""
    own = with_shingles(items.select("item_id", "text"), "own")
    items = Scratch(docs.sparkSession).table(own.withColumn("print", simhash(F.col("own"))), "items").filter(F.size("own") > 0)
    total = items.agg(F.coalesce(F.sum(F.size("own")), F.lit(0))).first()[0]
    passes = total // BLOCK + 1
    held = with_shingles(docs.select("doc_id", "text"), "all")
    # The outer form: the other one makes the optimizer push a filter on `all` under the words.
    every = held.select("doc_id", "all", F.posexplode_outer("all").alias("p", "shingle"))
    found = [_found(every, items.filter(F.pmod(F.xxhash64("item_id", "own"), F.lit(passes)) == k), at_least, radius) for k in range(passes)]
    best = reduce(DataFrame.union, found).groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("start"))).alias("best"))
    return best.select("doc_id", "item_id", (-F.col("best.start")).alias("start_word"), F.col("best.similarity").alias("similarity"))


def _found(every: DataFrame, items: DataFrame, at_least: float, radius: int) -> DataFrame:
    seeds = items.select("item_id", F.size("own").alias("size"), F.posexplode("own").alias("q", "shingle"))
    hits = every.join(F.broadcast(seeds), "shingle")
    start = F.greatest(F.lit(0), F.least(F.col("p") - F.col("q"), F.size("all") - F.col("size")))
    lined = hits.select("doc_id", "item_id", start.alias("start"), F.slice("all", start + 1, F.col("size")).alias("window"))
    lined = lined.groupBy("doc_id", "item_id", "start", F.xxhash64("window").alias("same")).agg(F.first("window").alias("window"))
    lined = lined.withColumn("seen", simhash(F.col("window")))
    both = lined.join(F.broadcast(items), "item_id").filter(F.arrays_overlap(blocks(F.col("seen"), radius), blocks(F.col("print"), radius)))
    both = both.filter(F.bit_count(F.col("seen").bitwiseXOR(F.col("print"))) <= radius)
    return both.withColumn("similarity", similarity(F.col("window"), F.col("own"))).filter(F.col("similarity") >= at_least).select("doc_id", "item_id", "start", "similarity")


def clean(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """Documents without a window of any item."""
    dirty = matches(docs, items, **how).select(F.col("doc_id").alias("dirty")).distinct()
    return common.whole(docs, own=F.col("doc_id")).join(dirty, F.col("own").eqNullSafe(F.col("dirty")), "left_anti").select("row.*")
