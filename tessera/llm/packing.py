"""Best-fit-decreasing packing of token sequences.

Lengths are whole numbers up to the sequence size, so all that best fit
decreasing decides depends on how many pieces there are of each length: a
table of at most ``size`` rows however large the corpus is. The driver packs
that table: a segment tree over the remaining capacities that open bins have
finds the tightest fitting one in O(log size) steps, and bins of equal
remainder are kept as runs of bin numbers and filled a run at a time, exactly
as piece-by-piece best fit would fill them. The outcome, a list of runs
(length, ranks, bins, offset), is looked up by every piece's rank in its length.

The plan's size: a length opens at most one run and splits at most one, so
there are never over 2 x size live runs, and a plan has at most 2 x size^2
entries (tens of thousands in practice); it does not grow with the corpus.

Defined results: a null or empty text is a piece with the end id alone; null
and repeated doc_ids are packed as separate documents; an empty table gives no
row; extra columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .encoding import encoder

PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, tie bigint"


class SegmentTree:
    """Which remaining capacities some open bin has; ``tightest(x)`` is the
    least of them that is x or more."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.some = bytearray(2 * self.width)

    def mark(self, capacity: int, has: bool) -> None:
        k = self.width + capacity
        self.some[k] = has
        while k > 1:
            k //= 2
            self.some[k] = self.some[2 * k] | self.some[2 * k + 1]

    def tightest(self, least: int) -> int | None:
        k = self.width + least
        if self.some[k]:
            return least
        while k > 1:
            if not k & 1 and self.some[k + 1]:
                k += 1
                while k < self.width:
                    k = 2 * k if self.some[2 * k] else 2 * k + 1
                return k - self.width
            k //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], size: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, first bin, offset, pieces a bin) and the number of bins.

    ``counts``: pieces of each length from 1 to ``size``.
    """
    tree, open_runs, plan, bins = SegmentTree(size), [deque() for _ in range(size + 1)], [], 0

    def put(capacity: int, first: int, n: int) -> None:
        if capacity:
            if not open_runs[capacity]:
                tree.mark(capacity, True)
            open_runs[capacity].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = tree.tightest(length)
            fresh = capacity is None
            if fresh:
                capacity = size
                fits = size // length
                first, n = bins, -(-left // fits)
                bins += n
            else:
                first, n = open_runs[capacity].popleft()
                if not open_runs[capacity]:
                    tree.mark(capacity, False)
            fits = capacity // length
            full = min(n, left // fits)
            offset = size - capacity
            if full:
                plan.append((length, rank, first, offset, fits))
                put(capacity - fits * length, first, full)
                rank += full * fits
                left -= full * fits
            if full < n and left:  # under `fits` pieces are left, for one more bin
                plan.append((length, rank, first + full, offset, fits))
                put(capacity - left * length, first + full, 1)
                full += 1
                left = 0
            if full < n and not fresh:
                if not open_runs[capacity]:
                    tree.mark(capacity, True)
                open_runs[capacity].appendleft((first + full, n - full))
    return plan, bins


def pieces(docs: DataFrame, vocabulary: str, end_id: int, size: int, split: str = "word") -> DataFrame:
    """Documents as pieces of at most ``size`` ids, with their CRCs."""
    common.tune(docs.sparkSession)
    end = struct.pack("<I", end_id)

    def run(batches):
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            ties = batch.column(2).to_pylist()
            for at in range(0, len(ids), 64):
                for k, raw in enumerate(encoder(vocabulary, split).encode(batch.column(1)[at : at + 64].to_pylist()), at):
                    raw += end
                    for j in range(0, len(raw), 4 * size):
                        part = raw[j : j + 4 * size]
                        out.append((ids[k], j // (4 * size), j // 4, len(part) // 4, zlib.crc32(part), ties[k]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), *[pa.int64()] * 4), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "tie"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.withColumn("tie", F.xxhash64("doc_id", "text")).mapInArrow(run, PIECE)


def pack(parts: DataFrame, size: int, rows_a_bucket: int = 20_000) -> DataFrame:
    """Adds sequence_id and offset to ``parts`` (a written table).

    A length that very many pieces share is ranked in buckets by the row's
    hash, so no task gets all pieces of one length.
    """
    total = parts.agg(F.count("*")).first()[0]
    buckets = total // rows_a_bucket + 1
    parts = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "tie"), F.lit(buckets)))
    by_bucket = parts.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    base = by_bucket.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    counts = {r["length"]: r["n"] for r in by_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `size` rows at most
    plan, _ = best_fit_decreasing(counts, size)
    plan.sort()
    ranked = parts.withColumn("place", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "tie")) - 1)
    ranked = ranked.join(base.select("length", "bucket", "base"), ["length", "bucket"]).withColumn("rank", F.col("place") + F.coalesce("base", F.lit(0)))
    wide = max(counts.values(), default=0) + 1
    if wide >= 2**62 // (size + 1):
        raise ValueError("too many pieces of one length for 64-bit ranks")
    table = np.array(plan, "i8").reshape(-1, 5)
    held = parts.sparkSession.sparkContext.broadcast((table[:, 0] * wide + table[:, 1], table))

    def run(frames):
        keys, table = held.value
        for f in frames:
            if not len(f):
                continue
            length, rank = f["length"].to_numpy("i8"), f["rank"].to_numpy("i8")
            row = table[np.searchsorted(keys, length * wide + rank, "right") - 1]
            nth = rank - row[:, 1]
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "piece": f["piece"], "start": f["start"], "length": length, "ids_crc32": f["ids_crc32"], "sequence_id": row[:, 2] + nth // row[:, 4], "offset": row[:, 3] + nth % row[:, 4] * length})

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def best_fit_pack(docs: DataFrame, vocabulary: str, end_id: int = 1, size: int = 4096, split: str = "word") -> DataFrame:
    """One row a piece with its sequence and its place there. Texts are encoded
    once; what is shuffled is a few numbers a piece."""
    scratch = common.Scratch(docs.sparkSession)
    return pack(scratch.table(pieces(docs, vocabulary, end_id, size, split), "pieces"), size)
