"""Embedding near-duplicates by cross-polytope hashing.

A vector is padded to a power of two, rotated by three rounds of random signs
and the fast Hadamard transform, and hashed to its largest coordinate and that
one's sign; ``hashes`` such values make a table's code, the more the more
vectors there are. A vector is filed under its code and
probes the code in which its least certain hash takes the runner-up
(multiprobe). All members of a bucket are compared by exact cosine in double
precision. The number of tables follows from ``recall``: enough that a pair at
the threshold itself meets with that chance, for any number of hashes.

Tables are worked off one after another, and a table's shuffle goes before the
next one's, so that disk holds a vector about three times, however many tables
there are. Equal vectors are one class, so a vector of very many copies is one
member. Buckets of any size are dealt out in block pairs; a task returns, for
each member, the vectors linked to it, and a spanning forest, never all pairs.
A pair is counted only in the first table and least bucket where it meets,
which both members' codes tell.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing and are their own component; vectors of unequal
length don't link; repeated vec_ids are separate vectors that share what is
said of an id's component; a null vec_id is never a minimum; empty tables give
no rows; extra columns are not read; a cosine of exactly the threshold links
(ties); a cosine is worked out on whole vectors of any length.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import Scratch

RECALL, BLOCK = 0.995, 1024
#: Microseconds of work for a row, for a hash of it, and for a comparison.
SHUFFLED, HASHED, COMPARED = 40.0, 10.0, 0.02


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row."""
    n, size, step = x.shape[0], x.shape[1], 1
    while step < size:
        x = x.reshape(n, -1, 2, step)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(n, size)
        step *= 2
    return x


def codes(vectors: np.ndarray, tables: range, hashes: int, seed: int = 42) -> np.ndarray:
    """(rows, tables, 2): each table's own code, then its probe, in which the hash
    whose two largest coordinates are closest takes the runner-up."""
    n, d = vectors.shape
    size = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :d] = vectors / np.abs(vectors).max(1, keepdims=True)
    padded /= np.sqrt((padded * padded).sum(1, keepdims=True))
    out, rows = np.zeros((n, len(tables), 2), "i8"), np.arange(n)
    for k, t in enumerate(tables):
        rng = np.random.default_rng([seed, t])
        digits, gaps = [], []
        for _ in range(hashes):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], size)) / math.sqrt(size)
            place = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
            swap = np.abs(y[rows, place[:, 0]]) < np.abs(y[rows, place[:, 1]])
            place[swap] = place[swap][:, ::-1]
            top = np.take_along_axis(y, place, 1)
            digits.append(2 * place + (top < 0))
            gaps.append(np.abs(top[:, 0]) - np.abs(top[:, 1]))
        least = np.argmin(gaps, axis=0)
        for j, digit in enumerate(digits):
            out[:, k, 0] = out[:, k, 0] * (2 * size) + digit[:, 0]
            out[:, k, 1] = out[:, k, 1] * (2 * size) + np.where(least == j, digit[:, 1], digit[:, 0])
    return out


def tables_for(width: int, hashes: int, least: float, recall: float, trials: int = 4000) -> int:
    """How many tables let a pair of cosine exactly ``least`` meet with chance
    ``recall`` or more: from how often random such pairs meet in one."""
    if width < 2:
        return 1
    rng = np.random.default_rng(5)
    x = rng.normal(size=(trials, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=(trials, width))
    y -= (y * x).sum(1, keepdims=True) * x
    y = least * x + math.sqrt(1 - least * least) * y / np.linalg.norm(y, axis=1, keepdims=True)
    a, b = codes(x, range(1), hashes)[:, 0], codes(y, range(1), hashes)[:, 0]
    met = ((a[:, 0] == b[:, 0]) | (a[:, 1] == b[:, 0]) | (a[:, 0] == b[:, 1])).mean()
    met = max(met - 2 * math.sqrt(met * (1 - met) / trials), 1e-4)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - met)))


def plan(total: int, width: int, least: float, recall: float) -> tuple[int, int]:
    """Hashes a table and tables, by the least estimated work: in each table a
    vector is shuffled and hashed, and compared with its buckets' members. Every
    choice has the recall asked for."""
    codes_of_one = 2 << max(1, (width - 1).bit_length())
    best = (math.inf, 1, 1)
    for hashes in range(1, 60 // codes_of_one.bit_length() + 1):
        tables = tables_for(width, hashes, least, recall)
        met = 2 * total / codes_of_one**hashes
        best = min(best, (tables * (SHUFFLED + HASHED * hashes + COMPARED * met), hashes, tables))
        if met < 1:
            break
    return best[1:]


def _meet(own: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First table and least bucket in which the pairs (a, b) meet."""
    x, y = own[a], own[b]
    most = np.iinfo("i8").max
    at = np.minimum(np.where((x == y[:, :, :1]).any(2), y[:, :, 0], most), np.where((y == x[:, :, :1]).any(2), x[:, :, 0], most))
    first = (at < most).argmax(1)
    return first, at[np.arange(len(a)), first]


def _file(t: int, hashes: int):
    """Rows of one table: each vector under its own code and under its probe."""

    def run(batches):
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy()
            for d in np.unique(sizes).tolist():
                part = batch.take(pa.array(np.flatnonzero(sizes == d)))
                c = codes(part.column(1).flatten().to_numpy().reshape(-1, d), range(t, t + 1), hashes)[:, 0]
                for probe in range(2):
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, d, "i4")), pa.array(c[:, probe].copy()), *part.columns, pa.array(np.full(n, probe == 0))], ["size", "code", "digest", "v", "copies", "filed"])

    return run


def _verify(t: int, tables: int, hashes: int, least: float):
    """Links, by exact cosine, of sorted members of bucket blocks of table ``t``."""

    def run(batches):
        for batch in common.groups(batches, 4):
            starts = common.starts_of(batch, 4)
            ends = np.append(starts[1:], batch.num_rows)
            digest, copies = batch.column(5).to_pylist(), batch.column(7).to_numpy()
            home = batch.column(8).to_numpy(zero_copy_only=False)
            d, code, block_a, block_b, own = (batch.column(k).to_numpy() for k in range(5))
            out = []
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                if b - a < 2 or not home[a:b].any():
                    continue
                raw = batch.column(6).slice(a, b - a).flatten().to_numpy().reshape(-1, d[a]).astype("f8")
                x = raw / np.abs(raw).max(1, keepdims=True)
                x = x / np.sqrt((x * x).sum(1, keepdims=True))
                near = np.triu(x @ x.T >= least, 1)
                u, v = near.nonzero()
                ok = home[a + u] | home[a + v]
                if block_a[a] != block_b[a]:
                    ok &= own[a + u] != own[a + v]
                u, v = u[ok], v[ok]
                if not len(u):
                    continue
                some = np.unique(np.r_[u, v])
                every = np.zeros((b - a, tables, 2), "i8")
                every[some] = codes(raw[some], range(tables), hashes)
                first = np.zeros(len(u), bool)
                for i in range(0, len(u), 100_000):
                    place, bucket = _meet(every, u[i : i + 100_000], v[i : i + 100_000])
                    first[i : i + 100_000] = (place == t) & (bucket == code[a])
                if not first.any():
                    continue
                u, v = u[first], v[first]
                links = np.bincount(u, copies[a + v], b - a) + np.bincount(v, copies[a + u], b - a)
                linked = np.zeros((b - a, b - a), bool)
                linked[u, v] = linked[v, u] = True
                partner = dict(_tree(linked))
                for i in np.flatnonzero(links > 0).tolist():
                    out.append((digest[a + i], int(links[i]), digest[a + partner[i]] if i in partner else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.binary()), strict=True)], ["u", "links", "v"])

    return run


def link(vectors: DataFrame, least: float = 0.95, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors``."""
    spark = vectors.sparkSession
    common.tune(spark)
    scratch = Scratch(spark)
    exact = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(exact).alias("v"))
    sound = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("sound", sound).withColumn("digest", F.unhex(F.md5(F.to_json("v").cast("binary"))))
    good = rows.filter("sound")
    classes = scratch.table(good.groupBy("digest").agg(F.first("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("first_id")), "classes")
    total, widest = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    widest = widest or 1
    hashes, tables = plan(total, widest, least, recall)
    found = None
    for t in range(tables):
        filed = classes.select("digest", "v", "copies").mapInArrow(_file(t, hashes), f"size int, code bigint, digest binary, v {exact}, copies bigint, filed boolean")
        large = filed.groupBy("size", "code").agg(F.count("*").alias("members")).filter(F.col("members") > BLOCK)
        large = scratch.table(large, f"large-{t}")
        dealt = common.split_large(filed, large, ["size", "code"], "digest", BLOCK)
        keys = ["size", "code", "block_a", "block_b"]
        dealt = dealt.select(*keys, "own", "digest", "v", "copies", "filed").repartition(*keys).sortWithinPartitions(*keys)
        part = scratch.table(dealt.mapInArrow(_verify(t, tables, hashes, least), "u binary, links bigint, v binary"), f"found-{t}")
        found = part if found is None else found.union(part)
        scratch.drop(f"large-{t}")
        common.release(spark)
    parts = common.components(scratch, found.filter("v is not null").select("u", "v"), "vectors")
    links = found.groupBy("u").agg(F.sum("links").alias("links"))
    home = classes.select("digest", "copies", "first_id").join(links, F.col("digest") == F.col("u"), "left").join(parts, F.col("digest") == F.col("node"), "left")
    home = scratch.table(home.select("digest", "first_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "digest").alias("component")), "home")
    scratch.drop("classes", *[f"found-{t}" for t in range(tables)])
    ids = home.groupBy("component").agg(F.min("first_id").alias("component_id"))
    told = home.join(ids, "component").select("digest", "n_links", "component_id")
    out = good.select("vec_id", "digest").join(told, "digest").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.col("sound")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _tree(linked: np.ndarray):
    """(child, parent) of a spanning forest."""
    for parent, child in common.forest(len(linked), lambda i, o: linked[i][o]):
        yield child, parent
