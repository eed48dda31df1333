"""A stored inverted index: posting blocks by term, kept in step with its rows.

Documents are numbered when they are written: a range of up to ``RANGE`` of them,
and a slot in it. A term's postings in one range are one row, a block: slots,
frequencies, lengths of documents and places of the word (of one document after
the other, as many as its frequency says), with the block's greatest frequency and shortest document. Blocks lie in folders by the term's hash and are sorted by term, so a
search reads the blocks of its terms only.

As ranges cut all terms alike, blocks of a range meet by an equi-join. A query's
blocks bound what any document of a range can score, without a posting being
read: the ranges with the highest bounds are worked out first, and of the rest
only those whose bound reaches the k-th score found.

A change is one commit: new documents in ranges of their own with their blocks,
marks on the rows of documents that they replace, and for those documents'
terms rows that take their number off the term's. Scores are BM25 over the
whole index as it is at that moment, and equal those of ``fulltext.match``.

Defined results: null texts are empty; a key that ``rows`` repeat is indexed once a
row; a query without words finds nothing; ties of score go by key.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from ..functions.text import tokens
from ..sources.commits import Conflict, Log, State, added
from .fulltext import K1, B, top_of_block, units
from .lineage import settled

#: Documents of a range, folders of terms, ranges of a query that are worked out first.
RANGE, FOLDERS, FIRST = 4096, 64, 4
#: Words up to which a search names its words to the scan, beside their folders.
NAMED = 256
BLOCK = ("term", "range", "n", "top_tf", "short", "slots", "tfs", "lengths", "places")
BLOCKS = "term string, range long, n int, top_tf int, short int, slots array<int>, tfs array<int>, lengths array<int>, places array<int>"


def folder_of(term: Column, folders: int = FOLDERS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(folders)).cast("int")


def _line(columns: Column) -> Column:
    """All words in order; an empty word ends a column, so that no phrase crosses it."""
    words = F.transform(columns, lambda c: tokens(F.coalesce(c, F.lit(""))))
    return F.flatten(F.transform(words, lambda w: F.concat(w, F.array(F.lit("")))))


def _range_blocks(docs: pa.Table) -> pa.Table:
    """The blocks of one range from its documents (range, slot, line) in order of slots."""
    lines = docs["line"].combine_chunks()
    sizes = lines.value_lengths().to_numpy(zero_copy_only=False)
    words = lines.flatten().dictionary_encode()
    code, names = words.indices.to_numpy(zero_copy_only=False), words.dictionary
    doc = np.repeat(np.arange(len(lines), dtype="i4"), sizes)
    place = (np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype("i4")
    said = np.flatnonzero(code != pc.index(names, "").as_py())
    length = np.bincount(doc[said], minlength=len(lines)).astype("i4")
    order = said[np.argsort(code[said], kind="stable")]  # by word, then document, then place
    code, doc, place = code[order], doc[order], place[order]
    new = np.r_[True, (code[1:] != code[:-1])] if len(code) else np.zeros(0, bool)
    entry = np.flatnonzero(new | np.r_[True, doc[1:] != doc[:-1]]) if len(code) else np.zeros(0, "i8")
    tf = np.diff(np.r_[entry, len(code)]).astype("i4")
    block = np.flatnonzero(new[entry])
    ends, spots = np.r_[block, len(entry)], np.r_[np.flatnonzero(new), len(code)]
    slots, lengths = docs["slot"].to_numpy().astype("i4")[doc[entry]], length[doc[entry]]
    lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int32()))
    top, short = (np.maximum.reduceat(tf, block), np.minimum.reduceat(lengths, block)) if len(block) else (tf, lengths)
    columns = [names.take(pa.array(code[entry[block]])), pa.array(np.full(len(block), docs["range"][0].as_py()), pa.int64()), *(pa.array(x, pa.int32()) for x in (np.diff(ends), top, short))]
    return pa.table([*columns, lists(ends, slots), lists(ends, tf), lists(ends, lengths), lists(spots, place)], list(BLOCK))


def part_score(tf: Column, length: Column, mean: Column) -> Column:
    """What one of a unit's times adds to a document's score, but for its weight."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


class TextIndex:
    """Documents (``key``, a list of texts ``columns``) below ``root``."""

    def __init__(self, spark: SparkSession, root: str, key: str = "object_id", size: int = RANGE, folders: int = FOLDERS):
        self.spark, self.log, self.key, self.size, self.folders = spark, Log(spark, root), key, size, folders

    # -- writing ------------------------------------------------------------------

    def _numbered(self, rows: DataFrame, first: int) -> DataFrame:
        """Adds ``range`` and ``slot``: rows are numbered in the order of tasks, from range
        ``first`` on. No text moves for it; words are cut where they are used."""
        spread = settled(rows.withColumn("_id", F.monotonically_increasing_id()), compression="zstd")
        # The task's number and, below it, the row's in its task.
        spread = spread.withColumns({"_part": F.shiftright("_id", 33), "_n": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id")
        counts = spread.groupBy("_part").agg(F.count("*").alias("_rows"))  # a row a task
        starts = counts.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"))
        at = F.col("_before") + F.col("_n")
        return spread.join(F.broadcast(starts), "_part").withColumns({"range": first + F.floor(at / self.size), "slot": (at % self.size).cast("int")}).drop("_part", "_before", "_n")

    def _blocks(self, numbered: DataFrame) -> DataFrame:
        """Blocks of documents (range, slot, columns): the task that holds a range cuts its
        texts into words and makes its blocks whole, so that no posting moves."""
        near = numbered.select("range", "slot", "columns").repartition("range").sortWithinPartitions("range", "slot")
        return near.select("range", "slot", _line(F.col("columns")).alias("line")).groupBy("range").applyInArrow(_range_blocks, BLOCKS)

    def _less(self, old: DataFrame) -> DataFrame:
        """Rows that take documents (range, terms) off their terms' numbers."""
        none = lambda kind: F.array().cast(kind)
        n = old.select("range", F.explode("terms").alias("term")).groupBy("term", "range").agg((-F.count("*")).cast("int").alias("n"))
        return n.select("term", "range", "n", F.lit(0).alias("top_tf"), F.lit(0).alias("short"), *[none("array<int>").alias(c) for c in BLOCK[5:8]], none("array<int>").alias("places"))

    def _apply(self, state: State, keys: DataFrame, rows: DataFrame | None) -> int | None:
        """One commit on top of ``state``: the documents of ``keys`` go, ``rows`` come. None: another came first."""
        tables, sums, blocks, lists = {}, {"docs": 0, "length": 0, "ranges": 0}, None, {}
        if rows is not None:
            numbered = self._numbered(rows.select(self.key, "columns"), state.sums.get("ranges", 0))
            said = numbered.select(self.key, "range", "slot", F.filter(_line(F.col("columns")), lambda w: w != "").alias("words"))
            docs = said.select(self.key, "range", "slot", F.size("words").alias("length"), F.array_distinct("words").alias("terms"))
            parts = self.log._write(docs, "docs")
            n, length, last = self.log._load(parts, docs.schema).agg(F.count("*"), F.sum("length"), F.max("range")).first()
            if n:
                sums = {"docs": n, "length": length, "ranges": last + 1 - state.sums.get("ranges", 0)}
                tables["docs"] = parts
                blocks = self._blocks(numbered)
        held = state.of("docs")
        if held:
            old = settled(self.log._scan(state, held, "docs").join(keys.select(self.key).distinct(), self.key, "left_semi").select("range", "slot", "length", "terms"))
            n, length = old.agg(F.count("*"), F.sum("length")).first()
            if n:
                sums = added(sums, {"docs": -n, "length": -length})
                blocks = self._less(old) if blocks is None else blocks.unionByName(self._less(old))
                lists = self.log._mark(state, held, keys, [self.key], "docs")
                tables["gone"] = self.log._write(old.select("range", "slot"), "gone")
        if not tables:
            return state.version
        blocks = blocks.withColumn("folder", folder_of(F.col("term"), self.folders))
        tables["blocks"] = self.log._write(blocks, "blocks", "folder", ("term", "range"), near=True)
        schemas = {"blocks": blocks.schema} | {t: (docs.schema if t == "docs" else old.select("range", "slot").schema) for t in tables if t != "blocks"}

        def change(now: State) -> State:
            if now.version != state.version:
                raise Conflict("the index has changed")
            new = self.log._new(now, [p for parts in tables.values() for p in parts])
            return replace(now, parts=self.log._marked(now.parts, lists) + new, schemas=self.log._schema(now, schemas), sums=added(now.sums, sums))

        try:
            return self.log._commit(change)
        except Conflict:
            return None

    def _until_first(self, keys: DataFrame, rows: DataFrame | None, tries: int = 5) -> int:
        for _ in range(tries):
            version = self._apply(self.log.state(), keys, rows)
            if version is not None:
                return version
        raise Conflict(f"{tries} commits of others came before this one")

    def write(self, rows: DataFrame) -> int:
        """Indexes ``rows``, in place of what the index holds of their keys (delete, then
        insert); returns the version. If another writer commits meanwhile, all is tried again."""
        return self._until_first(rows, rows)

    def delete(self, keys: DataFrame) -> int:
        """Takes documents out; returns the version."""
        return self._until_first(keys, None)

    # -- searching ----------------------------------------------------------------

    def blocks(self, state: State, words: DataFrame) -> DataFrame:
        """Blocks of ``words`` (word): the folders that can hold them are read, and of
        few words only the row groups that may."""
        folders = {r[0] for r in words.select(folder_of(F.col("word"), self.folders)).distinct().collect()}  # at most all folders
        parts = state.of("blocks", folders)
        if not parts:
            return self.log._scan(state, [], "blocks").select(*BLOCK)
        found = self.log._scan(state, parts, "blocks").select(*BLOCK)
        few = [r[0] for r in words.select("word").distinct().limit(NAMED + 1).collect()]
        if len(few) <= NAMED:
            found = found.filter(F.col("term").isin(few))
        return found.join(words.select(F.col("word").alias("term")).distinct(), "term", "left_semi")

    def _phrases(self, asked: DataFrame, found: DataFrame) -> DataFrame:
        """Blocks of phrases, made from their words' places: a range's blocks meet all
        phrases in one task, so that a frequent word's places move once and not once for
        each phrase that holds it; the places of the last word that all others lead up to
        count."""
        phrases = asked.filter(F.size("words") > 1).select("unit", "words").distinct()
        live = found.filter("n > 0").select("range", "term", "slots", "tfs", "lengths", "places")
        each = phrases.join(live.select(F.col("range").alias("_at")).distinct()).select("unit", "words", F.col("_at").alias("range"))
        schema = "unit string, range long, n int, top_tf int, short int, slots array<int>, tfs array<int>, lengths array<int>"
        names = [x.split()[0] for x in schema.split(", ")]

        def meet(some: pa.Table, held: pa.Table) -> pa.Table:
            out = {c: [] for c in names}
            if len(some) and len(held):
                rank = held["range"][0].as_py()
                held = held.combine_chunks()
                slots, tfs, lengths, places = (held[c].chunk(0) for c in ("slots", "tfs", "lengths", "places"))
                ends, far = slots.offsets.to_numpy(), np.r_[0, np.cumsum(tfs.values.to_numpy(), dtype="i8")]
                slot, place = slots.values.to_numpy().astype("i8"), places.values.to_numpy().astype("i8")
                length = np.zeros(int(slot.max(initial=0)) + 1, "i4")
                length[slot] = lengths.values.to_numpy()
                at = {t: k for k, t in enumerate(held["term"].to_pylist())}
                # Places of all documents in a row, each document's from ``start`` on.
                own_slot = np.repeat(slot, np.diff(far))
                last = np.zeros(len(length), "i8")
                np.maximum.at(last, own_slot, place)
                start = np.r_[0, np.cumsum(last + 2)]
                every = start[own_slot] + place

                def spots_of(k: int) -> np.ndarray:
                    return every[far[ends[k]] : far[ends[k + 1]]]

                mark = np.zeros(start[-1], bool)
                words = sorted(zip(some["words"].to_pylist(), some["unit"].to_pylist(), strict=True), key=lambda x: x[0][-1])
                for ws, unit in words:
                    if any(w not in at for w in ws):
                        continue
                    hit = spots_of(at[ws[0]])
                    for w in ws[1:]:
                        own = spots_of(at[w])
                        mark[own] = True
                        hit = hit[mark[hit + 1]] + 1
                        mark[own] = False
                        if not len(hit):
                            break
                    if len(hit):
                        docs, tf = np.unique(np.searchsorted(start, hit, "right") - 1, return_counts=True)
                        for c, v in zip(names, (unit, rank, len(docs), tf.max(), length[docs].min(), docs, tf, length[docs]), strict=True):
                            out[c].append(v)
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.list_(pa.int32())] * 3)
            return pa.table([pa.array(out[c], k) for c, k in zip(names, kinds, strict=True)], names)

        return each.groupBy("range").cogroup(live.groupBy("range")).applyInArrow(meet, schema)

    def search(self, queries: DataFrame, query_key: str, query_text: str, k: int, asked: DataFrame | None = None) -> DataFrame:
        """(query, key, bm25, rank) of the ``k`` best documents that hold all of a query's units."""
        state, key = self.log.state(), self.key
        if "docs" not in state.schemas:
            raise FileNotFoundError(f"no index below {self.log.root}")
        asked = settled(units(queries, query_key, query_text) if asked is None else asked)
        total, mean = float(state.sums["docs"]), F.lit(state.sums["length"] / max(1, state.sums["docs"]))
        words = asked.select(F.explode("words").alias("word")).distinct()
        found = settled(self.blocks(state, words))
        single = asked.filter(F.size("words") == 1).select("unit").distinct()
        held = found.drop("places").withColumnRenamed("term", "unit").join(single, "unit", "left_semi")
        gone = self.log._scan(state, state.of("gone"), "gone") if "gone" in state.schemas else None
        spoken = self._phrases(asked, found)
        if gone is not None:  # phrases have no numbers of their own to take gone documents off
            entry = spoken.select("unit", "range", F.explode(F.arrays_zip("slots", "tfs", "lengths")).alias("x")).select("unit", "range", F.col("x.slots").alias("slot"))
            less = entry.join(gone, ["range", "slot"], "left_semi").groupBy("unit", "range").agg((-F.count("*")).cast("int").alias("n"))
            empty = [F.array().cast("array<int>").alias(c) for c in BLOCK[5:8]]
            spoken = spoken.unionByName(less.select("unit", "range", "n", F.lit(0).alias("top_tf"), F.lit(0).alias("short"), *empty))
        held = settled(held.select(spoken.columns).unionByName(spoken))
        df = held.groupBy("unit").agg(F.sum("n").cast("double").alias("df"))
        idf = F.ln((total - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = F.col("times") * F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
        need = F.count("*").over(Window.partitionBy(query_key))
        asked = asked.select(query_key, "unit", "times", need.alias("need")).join(df, "unit").select(query_key, "unit", "need", weight.alias("weight"))
        live = held.filter("n > 0")
        bound = F.sum(F.col("weight") * part_score(F.col("top_tf"), F.col("short"), mean))
        ranges = asked.join(live.select("unit", "range", "top_tf", "short"), "unit").groupBy(query_key, "range").agg(bound.alias("bound"), F.count("*").alias("hit"), F.first("need").alias("need"))
        order = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("bound"), "range"))
        ranges = settled(ranges.filter("hit = need").withColumn("turn", order))
        ranked = Window.partitionBy(query_key).orderBy("bm25", "range", "slot")

        lists = live.select(F.col("range").alias("range"), "unit", "slots", "tfs", "lengths")
        if gone is not None:  # documents that are gone, under no unit
            lists = lists.unionByName(gone.groupBy("range").agg(F.array_sort(F.collect_set("slot")).alias("slots")).select("range", F.lit(None).cast("string").alias("unit"), "slots", F.col("slots").alias("tfs"), F.col("slots").alias("lengths")))
        kind = asked.schema[query_key].dataType
        schema = StructType([StructField(query_key, kind), StructField("range", LongType()), StructField("slot", IntegerType()), StructField("bm25", DoubleType())])
        across = state.sums["length"] / max(1, state.sums["docs"])

        def meet(some: pa.Table, held: pa.Table) -> pa.Table:
            found, own, live_docs = [], {}, None
            if len(some) and len(held):
                held = held.combine_chunks()
                slots, tfs, lengths = (held[c].chunk(0) for c in ("slots", "tfs", "lengths"))
                ends, slot = slots.offsets.to_numpy(), slots.values.to_numpy().astype("i8")
                tf, length = tfs.values.to_numpy().astype("f8"), lengths.values.to_numpy()
                by = tf + K1 * (1 - B + B * length / across)
                live_docs = np.ones(int(slot.max(initial=0)) + 1, bool)
                for k, unit in enumerate(held["unit"].to_pylist()):
                    i = slice(ends[k], ends[k + 1])
                    if unit is None:
                        live_docs[slot[i]] = False
                    else:
                        own[unit] = (slot[i], tf[i], by[i])
                found = list(top_of_block(some, own, live_docs, k_best, ties=True))
            q, s, r = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0))
            at = pa.array(q, pa.int64())
            return pa.table([some["query"].take(at), some["range"].take(at), pa.array(s, pa.int32()), pa.array(r)], schema.names)

        k_best = k

        def scored(some: DataFrame) -> DataFrame:
            """The k best documents of a range, and those equal to the last: a range's
            blocks meet its queries in one task, so what moves is blocks and best rows."""
            met = asked.join(some.select(query_key, "range"), query_key).select(F.col(query_key).alias("query"), "range", "unit", "weight", "need")
            return met.groupBy("range").cogroup(lists.groupBy("range")).applyInArrow(meet, schema)

        first = settled(scored(ranges.filter(F.col("turn") <= FIRST)))
        # The k-th score so far; scores are rounded, so what reaches it but for rounding counts.
        least = first.withColumn("r", F.row_number().over(ranked)).filter(F.col("r") == k).select(query_key, (-F.col("bm25") - 1e-6).alias("least"))
        rest = ranges.filter(F.col("turn") > FIRST).join(least, query_key, "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least")))
        every = first.unionByName(scored(rest))
        # Ties at the k-th score go by key, so all of them fetch theirs.
        ties = Window.partitionBy(query_key).orderBy("bm25")
        every = every.withColumn("r", F.rank().over(ties)).filter(F.col("r") <= k).drop("r")
        docs = self.log._scan(state, state.of("docs"), "docs").select(key, "range", "slot")
        last = F.row_number().over(Window.partitionBy(query_key).orderBy("bm25", key))
        return every.join(docs, ["range", "slot"]).select(query_key, key, "bm25").withColumn("rank", last).filter(F.col("rank") <= k)
