"""Exact removal of repeated byte strings by collection Burrows-Wheeler transforms.

A string of ``length`` bytes has one anchor: its ``GRAM``-byte substring of
least hash. Runs of starts with one anchor form a super-string; equal strings
have equal anchors at equal offsets, so only super-strings whose anchor occurs
twice are looked at, and offsets are cut into chunks of ``CHUNK``: the strings of
a chunk share a core, so a piece (bytes before the core, the core as a single
symbol, bytes after it) has at most 2 x CHUNK - 1 symbols and its strings are
exactly its substrings of CHUNK symbols. Equal pieces are merged with their
number of occurrences; a core under which only one piece is left needs no order.

Pieces are indexed column by column: each round inserts one symbol of every
piece of a collection, updating the collection's BWT and capped longest common
prefixes through sequential external files of the task. Neighbours with CHUNK
common symbols are equal strings; a run of them that stands for two or more
occurrences is repeated. Symbols are bytes and core digests (128 bits); anchors
and super-string hashes only choose what is compared.

Defined results: a null text is empty; texts under ``length`` bytes lose
nothing; null and repeated doc_ids are separate documents (equal rows repeat
each other); an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import Scratch

LENGTH, GRAM, CHUNK = 400, 128, 39
#: Starts of a text taken at a time, and pieces in one collection.
SEGMENT, COLLECTION = 1 << 20, 8192
_BASE, _END = 0x9E3779B97F4A7C15 | 1, 0xFFFF


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base & (2**64 - 1)))
    out[0] = 1
    return np.cumprod(out, dtype="u8")


_TABLES: dict[str, np.ndarray] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def super_strings(raw: bytes, length: int = LENGTH, gram: int = GRAM):
    """(anchor hash, first start, starts, anchor's place - first start) in order."""
    for at in range(0, len(raw) - length + 1, SEGMENT):
        part = np.frombuffer(raw, "u1")[at : at + SEGMENT + length - 1]
        if "up" not in _TABLES or len(_TABLES["up"]) < len(part) + 1:
            size = max(1 << 17, len(part) + 1)
            _TABLES["up"], _TABLES["down"] = _powers(size, _BASE), _powers(size, pow(_BASE, -1, 2**64))
        n = len(part) - gram + 1
        sums = np.zeros(len(part) + 1, "u8")
        np.cumsum((part.astype("u8") + np.uint64(1)) * _TABLES["up"][: len(part)], out=sums[1:])
        h = _mix((sums[gram:] - sums[:-gram]) * _TABLES["down"][:n])
        # Least hash of each window of grams, the last of equals: minima of prefixes and suffixes of blocks.
        wide = length - gram + 1
        places = -(-n // wide) * wide
        filled = np.full(places, np.uint64(2**64 - 1))
        filled[:n] = h
        blocks = filled.reshape(-1, wide)
        left = np.minimum.accumulate(blocks, axis=1).ravel()
        right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = n - wide + 1
        least = np.minimum(right[:starts], left[wide - 1 : wide - 1 + starts])
        # Equal hashes in one window (repeats within it): the last place that holds the least.
        anchor = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        for a, b in zip(anchor.tolist(), [*anchor[1:].tolist(), starts], strict=True):
            hits = a + np.flatnonzero(h[a : b - 1 + wide] == least[a])
            if len(hits) == 1:
                yield int(least[a]), at + a, b - a, int(hits[0]) - a
                continue
            s = a
            while s < b:
                q = int(hits[np.searchsorted(hits, s + wide, "left") - 1])
                # the anchor stays the last one until the next hit enters the window
                k = np.searchsorted(hits, q, "right")
                e = min(b, int(hits[k]) - wide + 1) if k < len(hits) else b
                yield int(least[a]), at + s, e - s, q - s
                s = e


def pieces(raw: bytes, first: int, n: int, rel: int, length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK):
    """(core digest, bytes before, bytes after, first start) of a super-string's chunks."""
    q = first + rel
    for c in range((rel - n + 1) // chunk, rel // chunk + 1):
        low, high = c * chunk, min(c * chunk + chunk - 1, length - gram)
        start, last = q - min(high, rel), q - max(low, rel - n + 1)
        a, b = q - low, q - high + length
        core = hashlib.blake2b(raw[a:b], digest_size=15).digest() + bytes([high - low + 1])
        yield core, raw[start:a], raw[b : last + length], start


class ColumnwiseIndex:
    """BWT, common prefixes (capped) and suffix places of a collection, built by
    inserting one symbol of each string a round, last symbols first.

    State is kept in files that each round reads once in order and replaces by
    new ones (overwriting a file in place would wait for the disk).
    """

    _KINDS = {"bwt": "u2", "lcp": "u1", "string": "i4", "size": "u1"}

    def __init__(self, strings: np.ndarray, sizes: np.ndarray, cap: int, folder: str):
        """``strings``: symbols below 65535, right-aligned in rows."""
        self.strings, self.sizes, self.cap, self.folder = strings, sizes, cap, folder
        self.width, self.written = strings.shape[1], 0
        m = len(strings)
        last = np.where(sizes > 0, strings[:, -1], _END) if self.width else np.full(m, _END)
        self._write(last.astype("u2"), np.zeros(m, "u1"), np.arange(m, dtype="i4"), np.zeros(m, "u1"))
        for length in range(1, int(sizes.max(initial=0)) + 1):
            self._round(length, m)

    def _write(self, *arrays: np.ndarray) -> None:
        self.written += 1
        for (name, kind), x in zip(self._KINDS.items(), arrays, strict=True):
            x.astype(kind, copy=False).tofile(f"{self.folder}/{name}-{self.written}")
            if self.written > 1:
                os.unlink(f"{self.folder}/{name}-{self.written - 1}")

    def read(self) -> tuple[np.ndarray, ...]:
        return tuple(np.fromfile(f"{self.folder}/{name}-{self.written}", kind) for name, kind in self._KINDS.items())

    def _round(self, length: int, m: int) -> None:
        bwt, lcp, string, size = self.read()
        live = np.flatnonzero(bwt != _END)
        order = live[np.argsort(bwt[live], kind="stable")]  # suffix m + t continues the one at order[t]
        new = size[order] == length - 1
        out_string, symbol = string[order], bwt[order]
        out_size = size[order] + np.uint8(1)
        out_bwt, out_lcp = np.empty(len(order), "u2"), np.empty(len(order), "u1")
        out_bwt[~new], out_lcp[~new] = bwt[m:], lcp[m:]
        own = out_string[new]
        more = self.sizes[own] > length
        out_bwt[new] = np.where(more, self.strings[own, np.maximum(self.width - length - 1, 0)], _END)
        # Prefixes change at new suffixes and right behind them.
        at = np.flatnonzero(new | np.r_[False, new[:-1]])
        before = np.maximum(at - 1, 0)
        same = (at > 0) & (symbol[at] == symbol[before])
        value = np.zeros(len(at), "u1")
        joined = same & (order[before] + 1 == order[at])
        value[joined] = np.minimum(lcp[order[at[joined]]] + 1, self.cap)
        apart = np.flatnonzero(same & ~joined)
        value[apart] = self._common(out_string[at[apart]], out_size[at[apart]], out_string[before[apart]], out_size[before[apart]])
        out_lcp[at] = value
        self._write(np.r_[bwt[:m], out_bwt], np.r_[lcp[:m], out_lcp], np.r_[string[:m], out_string], np.r_[size[:m], out_size])

    def _common(self, s: np.ndarray, a: np.ndarray, t: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(s), "u1")
        a, b = a.astype("i4"), b.astype("i4")
        most, live = np.minimum(np.minimum(a, b), self.cap), np.arange(len(s))
        for k in range(self.cap):
            live = live[most[live] > k]
            live = live[self.strings[s[live], self.width - a[live] + k] == self.strings[t[live], self.width - b[live] + k]]
            if not len(live):
                break
            out[live] = k + 1
        return out


def repeated(cores: list[bytes], lefts: list[bytes], rights: list[bytes], weights: np.ndarray) -> list[np.ndarray]:
    """For each piece, which of its strings occur twice or more among all."""
    out: list[np.ndarray] = [np.empty(0, bool)] * len(cores)
    spans = np.array([c[-1] for c in cores])
    for span in np.unique(spans).tolist():
        some = np.flatnonzero(spans == span)
        sizes = np.array([len(lefts[i]) + 1 + len(rights[i]) for i in some])
        rank = {c: k for k, c in enumerate(dict.fromkeys(cores[i] for i in some))}
        strings = np.zeros((len(some), int(sizes.max())), "u2")
        for row, i in zip(strings, some.tolist(), strict=True):
            n, left = len(lefts[i]) + 1 + len(rights[i]), len(lefts[i])
            own = row[len(row) - n :]
            own[:left] = np.frombuffer(lefts[i], "u1")
            own[left] = 256 + rank[cores[i]]
            own[left + 1 :] = np.frombuffer(rights[i], "u1")
        with tempfile.TemporaryDirectory(prefix="bwt-") as folder:
            _, lcp, string, size = ColumnwiseIndex(strings, sizes, span, folder).read()
        runs = np.flatnonzero(lcp < span)
        total = np.add.reduceat(weights[some][string] * (size >= span), runs)
        twice = np.repeat(total >= 2, np.diff(np.r_[runs, len(lcp)])) & (size >= span)
        for k, i in enumerate(some.tolist()):
            out[i] = np.zeros(sizes[k] - span + 1, bool)
        place = sizes[string[twice]] - size[twice]
        for k, p in zip(string[twice].tolist(), place.tolist(), strict=True):
            out[some[k]][p] = True
    return out


def _hashed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("raw"), F.unhex(F.md5(text)).alias("digest"))


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    names = ["anchor", "content", "digest", "doc_id", "first", "n", "rel", "copies"]

    def run(batches):
        for batch in batches:
            seen: dict[bytes, list] = {}
            for doc, raw, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if len(raw) >= length:
                    seen.setdefault(digest, [doc, raw, 0])[2] += 1
            rows = []
            for digest, (doc, raw, copies) in seen.items():
                for h, first, n, rel in super_strings(raw, length):
                    content = hashlib.blake2b(raw[first : first + n + length - 1], digest_size=8, key=rel.to_bytes(4, "little")).digest()
                    rows.append((h - 2**64 if h >> 63 else h, int.from_bytes(content, "little", signed=True), digest, doc, first, n, rel, copies))
                if len(rows) > 50_000:
                    yield _batch(rows, names, kinds)
                    rows = []
            if rows:
                yield _batch(rows, names, kinds)

    return docs.select("doc_id", "raw", "digest").mapInArrow(run, "anchor bigint, content bigint, digest binary, doc_id bigint, first bigint, n int, rel int, copies bigint")


def _cut(docs: DataFrame, reps: DataFrame, length: int) -> DataFrame:
    """Pieces of the representative super-strings, out of their texts."""
    wanted = reps.groupBy("digest", "doc_id").agg(F.collect_list(F.struct("anchor", "content", "copies", "first", "n", "rel")).alias("parts"))
    wanted = wanted.select(F.col("digest").alias("d"), F.col("doc_id").alias("i"), "parts")
    joined = docs.join(wanted, (docs["digest"] == F.col("d")) & docs["doc_id"].eqNullSafe(F.col("i"))).dropDuplicates(["d", "i"]).select("raw", "parts")
    kinds = [pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    names = ["core", "before", "after", "copies", "anchor", "content", "shift"]

    def run(batches):
        for batch in batches:
            rows = []
            for raw, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for p in parts:
                    for core, left, right, start in pieces(raw, p["first"], p["n"], p["rel"], length):
                        rows.append((core, left, right, p["copies"], p["anchor"], p["content"], start - p["first"]))
                if len(rows) > 20_000:
                    yield _batch(rows, names, kinds)
                    rows = []
            if rows:
                yield _batch(rows, names, kinds)

    return joined.mapInArrow(run, "core binary, before binary, after binary, copies bigint, anchor bigint, content bigint, shift int")


def _index(merged: DataFrame) -> DataFrame:
    """Which strings of each merged piece are repeated, as 0/1 bytes; none: no row."""

    def run(batches):
        for batch in common.groups(batches, 1):
            starts = common.starts_of(batch, 1)
            sizes = np.diff(np.r_[starts, batch.num_rows])
            weight = batch.column(3).to_numpy()
            rows = []
            # One piece alone under its core equals only itself: its occurrences decide.
            for i in starts[(sizes == 1) & (weight[starts] >= 2)].tolist():
                core, left, right = (batch.column(j)[i].as_py() for j in range(3))
                rows.append((core, left, right, b"\x01" * (len(left) + 2 + len(right) - core[-1])))
            several = np.flatnonzero(np.repeat(sizes > 1, sizes))
            cuts = np.searchsorted(np.cumsum(sizes[sizes > 1]), np.arange(COLLECTION, len(several) + COLLECTION, COLLECTION))
            ends = np.unique(np.r_[np.cumsum(sizes[sizes > 1])[np.minimum(cuts, (sizes > 1).sum() - 1)], len(several)]) if len(several) else []
            at = 0
            for end in [int(e) for e in ends]:
                some = batch.take(pa.array(several[at:end]))
                c, left, right = (some.column(j).to_pylist() for j in range(3))
                flags = repeated(c, left, right, some.column(3).to_numpy())
                rows += [(c[i], left[i], right[i], f.astype("u1").tobytes()) for i, f in enumerate(flags) if f.any()]
                at = end
            if rows:
                yield _batch(rows, ["core", "before", "after", "flags"], [pa.binary()] * 4)

    dealt = merged.select("core", "before", "after", "weight").repartition("core").sortWithinPartitions("core")
    return dealt.mapInArrow(run, "core binary, before binary, after binary, flags binary")


def covered(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(digest, runs): repeated starts of each distinct text that has some."""
    spark = docs.sparkSession
    common.tune(spark)
    scratch = Scratch(spark)
    hashed = _hashed(docs)
    every = scratch.table(_anchors(hashed, length), "anchors")
    # A table of its own, so that both sides of the join are plain exchanges and Spark can split a hot anchor.
    twice = scratch.table(every.groupBy("anchor").agg(F.sum("copies").alias("all")).filter("all > 1").select("anchor"), "twice")
    some = scratch.table(every.join(twice, "anchor", "left_semi"), "repeated")
    scratch.drop("anchors", "twice")
    common.release(spark)
    reps = some.groupBy("anchor", "content").agg(F.sum("copies").alias("copies"), F.min(F.struct("digest", "doc_id", "first", "n", "rel")).alias("r"))
    reps = reps.select("anchor", "content", "copies", "r.*")
    cut = scratch.table(_cut(hashed, reps, length), "pieces")
    common.release(spark)
    merged = cut.groupBy("core", "before", "after").agg(F.sum("copies").alias("weight"))
    found = scratch.table(_index(merged), "flags")
    common.release(spark)
    told = cut.join(found, ["core", "before", "after"]).groupBy("anchor", "content").agg(F.collect_list(F.struct("shift", "flags")).alias("flags"))
    told = scratch.table(told, "told")
    scratch.drop("pieces", "flags")
    common.release(spark)
    members = some.select("anchor", "content", "digest", "first").distinct()
    runs = members.join(told, ["anchor", "content"]).select("digest", F.explode("flags").alias("f"), "first")
    runs = runs.groupBy("digest").agg(F.collect_list(F.struct((F.col("first") + F.col("f.shift")).alias("at"), F.col("f.flags").alias("flags"))).alias("runs"))
    out = scratch.table(runs, "runs")
    scratch.drop("repeated", "told")
    common.release(spark)
    return out


def _starts(runs: pa.ListArray) -> list[np.ndarray]:
    """Repeated starts of each row of ``runs``, in order and once each."""
    flat, sizes = runs.flatten(), pc.fill_null(pc.list_value_length(runs), 0).to_numpy()
    at, flags = (flat.field(k) for k in ("at", "flags"))
    lengths = pc.binary_length(flags).to_numpy(zero_copy_only=False).astype("i8")
    hit = np.flatnonzero(np.frombuffer(b"".join(flags.to_pylist()), "u1"))
    run = np.repeat(np.arange(len(flat)), lengths)[hit]
    starts = at.to_numpy()[run] + hit - (np.cumsum(lengths) - lengths)[run]
    edges = np.searchsorted(np.repeat(np.arange(len(runs)), sizes)[run], np.arange(len(runs) + 1))
    return [np.unique(starts[a:b]) if b > a else starts[a:b] for a, b in itertools.pairwise(edges.tolist())]


def _spans(at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed spans [from, to) of repeated starts."""
    if not len(at):
        return at, at
    gap = np.flatnonzero(np.diff(at) > length)
    return at[np.r_[0, gap + 1]], at[np.r_[gap, len(at) - 1]] + length


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of each document;
    ``kept`` is the remaining bytes."""
    hashed = _hashed(docs)
    runs = covered(docs, length).select(F.col("digest").alias("d"), "runs")
    joined = hashed.join(runs, hashed["digest"] == runs["d"], "left").select("doc_id", "raw", "runs")

    def run(batches):
        for batch in batches:
            rows = []
            for doc, raw, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _starts(batch.column(2)), strict=True):
                a, b = _spans(found, length)
                keep, at = [], 0
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    keep.append(raw[at:x])
                    at = y
                kept = b"".join([*keep, raw[at:]])
                rows.append((doc, len(raw), len(raw) - len(kept), len(a), hashlib.sha256(kept).hexdigest(), kept))
            if rows:
                yield _batch(rows, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"], [pa.int64()] * 4 + [pa.string(), pa.binary()])

    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
