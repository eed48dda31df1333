"""Source divergence audit: how far the words of each source are from another's.

Terms are runs of letters A-Z (lower-cased) and of signs beyond ASCII. A
language keeps the terms of at least three of its documents. For a group (a
language and source, or the language as a whole) a term with n occurrences has
the share p = 1 + floor(10^9 (n + 1) / (N + V)), N the sum of n over the V kept
terms; f(p, q) = floor((p - q)^2 / q) says how far p is from q. All of it is
integers.

Most terms of a language miss in most sources, and a share for n = 0 is the
same for all of them. The sum over all terms for a pair (a, b) therefore starts
at V f(a0, b0), as if no term occurred in either. An inverted index (a term's
sources with their shares) then corrects it: a term in a alone changes it by
f(p, b0) - f(a0, b0), which depends on its count only, so a source's terms are
first counted by share; a term in both adds f(p, q) - f(p, b0) - f(a0, q) +
f(a0, b0), summed in the tasks before it moves. No term of zero counts is met.

Defined results: null text, lang and source are empty texts; a text without
terms still makes its group known, which then has pairs and no terms of its
own; a language without kept terms has pairs of value 0; repeated rows count as
documents each; ties of value go by the item's bytes; very long texts are cut
into words a slice at a time; an empty table gives no row; other columns are
not read. A language's sources are numbered in one window and paired: every
pair is a row of the result, so their number is bounded by what can be written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Documents a kept term occurs in, ranks of terms that are returned (contract).
LEAST_DOCS, TERMS = 3, 200
UNIT = 1_000_000_000
#: A-Z to a-z; what isn't a letter of ASCII or beyond it to a space.
TABLE = bytes(c if c > 127 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Words or counts a task holds before it gives them on, pairs it works out at once.
HELD, CELLS = 1 << 20, 1 << 20
_LOW = np.int64(0xFFFFFFFF)


class Numbers(dict):
    """Numbers what is asked for, in the order it is first seen."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


def summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and each one's sums."""
    if not len(key):
        return key, *values
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[at], *(np.add.reduceat(v[order], at) for v in values)


def count_terms(batches):
    """(lang, source, term, n, docs) of the rows, and a row of the term '' for
    each group, combined as far as the task's memory goes."""
    terms, groups, parts = Numbers(), Numbers(), []

    def merged():
        return summed(*(np.concatenate(x) for x in zip(*parts, strict=True))) if parts else (np.empty(0, "i8"),) * 3

    def flush():
        key, n, docs = merged()
        names = list(groups)
        langs, sources = (pa.array([x[k] for x in names] or [""], pa.string()) for k in (0, 1))
        word = pa.array([*terms, b""], pa.binary()).view(pa.string())
        own, at = key >> 32, key & _LOW
        own, at = np.r_[own, np.arange(len(names))], np.r_[at, np.full(len(names), len(terms))]
        zero = np.zeros(len(names), "i8")
        n, docs = np.r_[n, zero], np.r_[docs, zero]
        for k in range(0, len(own), 1 << 16):
            cut = slice(k, k + (1 << 16))
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(own[cut])), sources.take(pa.array(own[cut])), word.take(pa.array(at[cut])), pa.array(n[cut]), pa.array(docs[cut])], ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        found, own = [], []
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            group = groups[lang, source]
            if text:
                found.append(np.concatenate([np.fromiter(map(terms.__getitem__, w), "i8", len(w)) for w in common.word_slices(text.translate(TABLE))]))
                own.append(group)
        if found:
            doc = np.repeat(np.arange(len(found)), [len(x) for x in found])
            pair, n = np.unique(doc << 32 | np.concatenate(found), return_counts=True)
            parts.append(summed(np.array(own, "i8")[pair >> 32] << 32 | pair & _LOW, n, np.ones_like(n)))
        if len(terms) > HELD or sum(len(x[0]) for x in parts) > 4 * HELD:
            parts = [merged()]
            if len(terms) > HELD or len(parts[0][0]) > HELD:
                yield from flush()
                terms, groups, parts = Numbers(), Numbers(), []
    yield from flush()


def share(n: Column, size: Column) -> Column:
    """1 + floor(10^9 (n + 1) / size), exact; the product is a long where it can be."""
    return F.when(n < 9_000_000_000, F.call_function("div", F.lit(UNIT).cast("long") * (n + 1), size)).otherwise(F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)"), size.cast("decimal(19,0)"))) + 1


def far(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def both(batches):
    """(lang, a, b, value): corrections of pairs of sources that share terms, from
    rows (lang, posting), summed as far as the task's memory goes."""
    held: dict[str, list] = {}

    def f(p, q):
        return (p - q) ** 2 // q

    def flush():
        for lang, parts in held.items():
            key, value = summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            key, value = key[value != 0], value[value != 0]
            for k in range(0, len(key), 1 << 16):
                cut = slice(k, k + (1 << 16))
                n = len(key[cut])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(key[cut] >> 32), pa.array(key[cut] & _LOW), pa.array(value[cut])], ["lang", "a", "b", "value"])
        held.clear()

    def add(lang, a, b):
        """Of (source, share, share of zero) as columns of a and rows of b."""
        (ga, pa_, za), (gb, pb, zb) = ([x[:, :, None] for x in a], [x[:, None, :] for x in b])
        value = f(pa_, pb) - f(pa_, zb) - f(za, pb) + f(za, zb)
        key = np.broadcast_to(ga << 32 | gb, value.shape)
        keep = np.broadcast_to(ga != gb, value.shape)
        held.setdefault(lang, []).append(summed(key[keep], value[keep]))

    for batch in batches:
        langs, lists = np.array(batch.column(0).to_pylist(), object), batch.column(1)
        at, fields = lists.offsets.to_numpy(), [lists.values.field(k).to_numpy() for k in range(3)]
        sizes = np.diff(at)
        for lang in set(langs.tolist()):
            for k in np.unique(sizes[langs == lang]):
                rows = at[:-1][(langs == lang) & (sizes == k)]
                step, wide = max(1, CELLS // int(k) ** 2), max(1, CELLS // int(k))
                for r in range(0, len(rows), step):
                    place = rows[r : r + step, None] + np.arange(k)
                    one = [x[place] for x in fields]
                    for c in range(0, int(k), wide):  # of very many sources some at a time
                        add(lang, [x[:, c : c + wide] for x in one], one)
                if sum(len(x[0]) for parts in held.values() for x in parts) > 2 * HELD:
                    yield from flush()
    yield from flush()


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, terms: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has every other source
    of the language, part ``term`` the terms that the group uses more than its
    language does, the first ``terms`` of them."""
    spark, scratch = docs.sparkSession, common.Scratch(docs.sparkSession)
    common.tune(spark)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))
    counted = rows.mapInArrow(count_terms, "lang string, source string, term string, n bigint, docs bigint")
    counted = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    counted = counted.withColumns({"lang_n": F.sum("n").over(of_term), "lang_docs": F.sum("docs").over(of_term), "first": (F.col("source") == F.min("source").over(of_term)).cast("long")})
    counted = counted.filter((F.col("lang_docs") >= least_docs) | (F.col("term") == "")).withColumn("first", F.when(F.col("term") == "", 0).otherwise(F.col("first")))
    counted = scratch.table(counted.drop("docs", "lang_docs"), "term-counts")

    of_lang = Window.partitionBy("lang")
    groups = counted.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.sum("first").alias("first"))
    groups = groups.withColumns({"v": F.sum("first").over(of_lang), "lang_size": F.sum("size").over(of_lang), "id": F.row_number().over(of_lang.orderBy("source")).cast("long")})
    groups = groups.select("lang", "source", "id", "v", (F.col("size") + F.col("v")).alias("size"), (F.col("lang_size") + F.col("v")).alias("lang_size"))
    groups = scratch.table(groups.withColumn("zero", F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("size")))), "term-groups")

    held = counted.filter("term <> ''").join(groups, ["lang", "source"])
    held = held.select("lang", "source", "term", "id", "zero", share(F.col("n"), F.col("size")).alias("p"), share(F.col("lang_n"), F.col("lang_size")).alias("q"))
    ranked = held.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), far(F.col("p"), F.col("q")).alias("value"))
    by_group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = ranked.withColumn("rank", F.row_number().over(by_group)).filter(F.col("rank") <= terms)

    # Pairs: the start, what terms of one side change, what terms of both change.
    side = lambda x: groups.select("lang", F.col("id").alias(x), F.col("zero").alias(f"{x}0"), "v")
    wide = lambda c: c.cast("decimal(38,0)").alias("value")
    start = side("a").join(side("b").drop("v"), "lang").filter("a <> b")
    start = start.select("lang", "a", "b", wide(F.when(F.col("v") > 0, F.col("v").cast("decimal(19,0)") * far(F.col("a0"), F.col("b0")).cast("decimal(19,0)")).otherwise(F.lit(0))))
    shares = held.groupBy("lang", "id", "zero", "p").agg(F.count("*").cast("decimal(19,0)").alias("n"))
    own = {}
    for x, y in (("a", "b"), ("b", "a")):
        met = shares.select("lang", F.col("id").alias(x), F.col("zero").alias(f"{x}0"), "p", "n").join(side(y).drop("v"), "lang").filter("a <> b")
        change = (far(F.col("p"), F.col("b0")) if x == "a" else far(F.col("a0"), F.col("p"))) - far(F.col("a0"), F.col("b0"))
        own[x] = met.filter(change != 0).select("lang", "a", "b", wide(F.col("n") * change.cast("decimal(19,0)")))
    posting = held.groupBy("lang", "term").agg(F.collect_list(F.struct("id", "p", "zero")).alias("posting")).filter(F.size("posting") > 1)
    shared = posting.select("lang", "posting").mapInArrow(both, "lang string, a bigint, b bigint, value bigint")
    pairs = start.unionByName(own["a"]).unionByName(own["b"]).unionByName(shared.withColumn("value", F.col("value").cast("decimal(38,0)")))
    pairs = pairs.groupBy("lang", "a", "b").agg(F.sum("value").cast("long").alias("value"))
    name = lambda x, c: groups.select("lang", F.col("id").alias(x), F.col("source").alias(c))
    pairs = pairs.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(by_group))
    return pairs.unionByName(ranked)
