"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within ``radius`` bits: bits are grouped into partitions, bits
that differ together into the same one; partition i gets a threshold t_i with
sum(t_i + 1) = radius + 1, so two fingerprints within the radius are within
t_i in some partition; dynamic programming chooses the thresholds (and the
number of partitions) that cost least by the candidate counts estimated from a
sample. A fingerprint is filed under its partition's value and probes all
values within t_i of it; members of a bucket are verified on all bits. The
sample (``SAMPLE`` fingerprints) only sets the cost, never the result.

Buckets of any size are dealt out in block pairs (``common.in_blocks``) and
give a spanning forest of verified links, not all pairs.

Defined results: see each function; null texts are empty, null doc_ids are
documents whose id never is a minimum unless all of a group are null; repeated
rows are separate documents; empty tables give no rows; extra columns of the
input are not read (``deduplicate`` returns them as they are).
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import Scratch

SAMPLE, SEED = 4096, 42
#: Shingles hashed at a time in one text.
_STEP = 1 << 16


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of each k-word shingle, repeats included (A-Z lower-cased, ASCII white space)."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, "<u8")
    if len(words) < k:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], "<u8")
    return np.fromiter((xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))), "<u8", len(words) - k + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that over half of the hashes have; none: zero."""
    ones = np.zeros(64, "i8")
    for i in range(0, len(hashes), _STEP):
        ones += np.unpackbits(hashes[i : i + _STEP].view("u1"), bitorder="little").reshape(-1, 64).sum(0, dtype="i8")
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, print): print is the unsigned fingerprint's bits as a long."""
    common.tune(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found: dict = {}
            texts = batch.column(1).to_pylist()
            for t in texts:
                if t not in found:
                    found[t] = fingerprint(shingle_hashes(t, k))
            prints = np.array([found[t] for t in texts], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, print bigint")


def _group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits into ``parts`` equal groups: each group grows by the bit most correlated with it."""
    bits = np.unpackbits(sample.view("u1"), bitorder="little").reshape(-1, 64).astype("f8")
    with np.errstate(invalid="ignore", divide="ignore"):
        tied = np.abs(np.nan_to_num(np.corrcoef(bits.T))) if len(bits) > 2 else np.eye(64)
    left, out = list(range(64)), []
    for p in range(parts, 0, -1):
        size = round(len(left) / p)
        group = [left.pop(0)]
        while len(group) < size:
            nxt = max(left, key=lambda b: (tied[b, group].sum(), -b))
            left.remove(nxt)
            group.append(nxt)
        out.append(sorted(group))
    return out


def _within(differ: np.ndarray, t: int) -> float:
    """Chance that at most t of these bits differ, each on its own."""
    odds = np.zeros(t + 2)
    odds[0] = 1
    for p in differ:
        odds[1:] = odds[1:] * (1 - p) + odds[:-1] * p
        odds[0] *= 1 - p
    return float(odds[: t + 1].sum())


def plan(sample: np.ndarray, total: int, radius: int, pair_cost: float = 0.01) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each probed partition, of least estimated cost: rows
    filed and probed, and ``pair_cost`` for each candidate pair."""
    rate = np.unpackbits(sample.view("u1"), bitorder="little").reshape(-1, 64).mean(0) if len(sample) else np.full(64, 0.5)
    differ = np.clip(2 * rate * (1 - rate), 0.02, 0.5)
    best = (math.inf, [])
    for parts in range(1, radius + 2):
        grouped = _group_bits(sample, parts)
        cost = []
        for g in grouped:
            row = [0.0]  # threshold -1: not probed
            for t in range(radius + 1):
                probes = sum(math.comb(len(g), j) for j in range(t + 1))
                row.append(total * (probes + (t > 0)) + pair_cost * total * total / 2 * _within(differ[g], t) * (1 + (t > 0)))
            cost.append(row)
        # least cost of the first i partitions with `used` of radius + 1 spent
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for row in cost:
            after: dict[int, tuple[float, list[int]]] = {}
            for used, (c, ts) in table.items():
                for spend in range(radius + 2 - used):
                    if (n := (c + row[spend], [*ts, spend - 1]))[0] < after.get(used + spend, (math.inf,))[0]:
                        after[used + spend] = n
            table = after
        c, ts = table[radius + 1]
        if c < best[0]:
            best = (c, [(g, t) for g, t in zip(grouped, ts, strict=True) if t >= 0])
    return best[1]


def _pext(values: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(values), "u8")
    for k, b in enumerate(bits):
        out |= ((values >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def links(scratch: Scratch, prints: DataFrame, radius: int) -> DataFrame:
    """Verified links (u, v) between the distinct ``print`` values, enough to
    connect all that ``radius`` connects."""
    total = prints.count()
    some = prints.orderBy(F.xxhash64("print")).limit(SAMPLE).collect()
    parts = plan(np.array([r[0] for r in some], "<i8").view("<u8"), total, radius)
    masks = [np.array([sum(1 << b for b in c) for j in range(t + 1) for c in itertools.combinations(range(len(bits)), j)], "u8") for bits, t in parts]

    def file(batches):
        for batch in batches:
            p = batch.column(0).to_numpy()
            for at in range(0, len(p), 4096):
                own = p[at : at + 4096]
                for k, (bits, _) in enumerate(parts):
                    value = _pext(own.view("<u8"), bits)
                    for m, mask in enumerate(masks[k].tolist()):
                        yield _rows(k, value ^ np.uint64(mask), own, m == 0)

    def _rows(k, value, own, filed):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k, "i4")), pa.array(value.view("<i8")), pa.array(own), pa.array(np.full(len(own), filed))], ["part", "value", "print", "filed"])

    filed = scratch.table(prints.mapInArrow(file, "part int, value bigint, print bigint, filed boolean"), "filed")
    dealt = common.in_blocks(scratch, filed, ["part", "value"], "print", "filed").select("part", "value", "block_a", "block_b", "print", "filed", "own")

    def verify(batches):
        for batch in common.groups(batches, 4):
            starts = common.starts_of(batch, 4)
            ends = np.append(starts[1:], batch.num_rows)
            value, home = batch.column(4).to_numpy().view("<u8"), batch.column(5).to_numpy(zero_copy_only=False)
            out = []
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                if b - a > 1:
                    v, f = value[a:b], home[a:b]
                    near = lambda i, o, v=v, f=f: (np.bitwise_count(v[o] ^ v[i]) <= radius) & (f[o] | f[i])
                    out += [(v[i], v[j]) for i, j in common.forest(b - a, near)]
            if out:
                u, w = np.array(out, "<u8").T
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(u).view("<i8")), pa.array(np.ascontiguousarray(w).view("<i8"))], ["u", "v"])

    return scratch.table(dealt.mapInArrow(verify, "u bigint, v bigint"), "links")


def link(docs: DataFrame, k: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    prints = scratch.table(fingerprints(docs, k), "prints")
    distinct = scratch.table(prints.groupBy("print").agg(F.min("doc_id").alias("first_id")), "distinct")
    found = common.components(scratch, links(scratch, distinct.select("print"), radius), "prints")
    scratch.drop("filed", "filed-sizes", "links")
    home = distinct.join(found, distinct["print"] == found["node"], "left").select("print", "first_id", F.coalesce("component", "print").alias("component"))
    home = scratch.table(home, "home")
    least = home.groupBy("component").agg(F.min("first_id").alias("component_id"))
    ids = home.join(least, "component").select("print", "component_id")
    return prints.join(ids, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


# --- near-duplicate texts by shingle similarity -------------------------------------------

KEYS = 6
_RNG = np.random.default_rng(7)
_KEY_MULTIPLIERS = _RNG.integers(1, 2**63, KEYS, dtype="u8") * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    return h * np.uint64(0xBF58476D1CE4E5B9)


def minimum_hashes(hashes: np.ndarray) -> list[int]:
    return [int((_mix(hashes * m)).min()) for m in _KEY_MULTIPLIERS]


def _profiles(docs: DataFrame, k: int) -> DataFrame:
    common.tune(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = {}
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest not in rows and len(h := shingle_hashes(text, k)):
                    unique = np.unique(h)
                    rows[digest] = (digest, len(unique), minimum_hashes(unique), fingerprint(h))
            if rows:
                c = list(zip(*rows.values(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0]), pa.array(c[1], pa.int64()), pa.array([np.array(x, "u8").view("i8").tolist() for x in c[2]], pa.list_(pa.int64())), pa.array(np.array(c[3], "u8").view("i8"))], ["digest", "n", "keys", "print"])

    return docs.mapInArrow(run, "digest string, n bigint, keys array<bigint>, print bigint")


def near_sets(sets: list[np.ndarray], similarity: float):
    """``near(i, others)``: whether exact Jaccard similarities of these sets reach
    ``similarity``. Counts common items over the others' items or over the
    holders of i's items, whichever are fewer."""
    size = np.array([len(x) for x in sets], "i8")
    end = np.cumsum(size)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype("i4")
    held = np.bincount(ids)
    stop = np.cumsum(held)
    holder = np.repeat(np.arange(len(sets), dtype="i4"), size)[np.argsort(ids, kind="stable")]
    marked = np.zeros(len(held), bool)

    def items(ends, lengths, values):
        skip = np.cumsum(lengths) - lengths
        return values[np.repeat(ends - lengths - skip, lengths) + np.arange(lengths.sum())]

    def near(i, o):
        ok = np.minimum(size[o], size[i]) + 1e-9 >= similarity * np.maximum(size[o], size[i])
        if not ok.any():
            return ok
        of, own = o[ok], ids[end[i] - size[i] : end[i]]
        if held[own].sum() < size[of].sum():
            both = np.bincount(items(stop[own], held[own], holder), minlength=len(size))[of]
        else:
            marked[own] = True
            both = np.add.reduceat(marked[items(end[of], size[of], ids)], np.cumsum(size[of]) - size[of], dtype="i8")
            marked[own] = False
        ok[ok] = both + 1e-9 >= similarity * (size[of] + size[i] - both)
        return ok

    return near


def near_duplicates(scratch: Scratch, docs: DataFrame, k: int = 5, similarity: float = 0.8, radius: int = 3) -> DataFrame:
    """(digest, component) of distinct texts of Jaccard similarity ``similarity``
    or more on k-word shingles, chained; texts alone in theirs are left out.

    Texts whose fingerprints are linked within ``radius`` bits (``links``,
    chained) meet. At 0.8 on five-word shingles 64-bit fingerprints are 5 to 14
    bits apart, too far for pigeonhole partitions to select anything, so the
    others meet under one of ``KEYS`` minimum hashes as well (a pair at 0.8
    misses all with chance 0.2^6). The
    exact similarity of whole texts decides each link inside the group, with no
    estimate before it, so a member stays in the search until a true link
    reaches it.
    """
    hashed = docs.select(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), F.col("text").cast("string").alias("text"))
    one = _profiles(hashed, k).groupBy("digest").agg(*[F.first(c).alias(c) for c in ("n", "keys", "print")])
    profiles = scratch.table(one, "profiles")
    prints = scratch.table(profiles.select("print").distinct(), "distinct")
    linked = common.components(scratch, links(scratch, prints, radius), "prints")
    scratch.drop("distinct", "filed", "filed-sizes", "links")
    near = profiles.join(linked, profiles["print"] == linked["node"], "left").select("digest", F.lit(KEYS).alias("place"), F.coalesce("component", "print").alias("key"), "n")
    keyed = profiles.select("digest", F.posexplode("keys").alias("place", "key"), "n").union(near)
    met = keyed.join(keyed.groupBy("place", "key").agg(F.count("*").alias("members")).filter("members > 1"), ["place", "key"])
    met = scratch.table(met.select("digest", "place", "key", "n"), "met")
    wanted = met.select("digest").distinct()
    texts = hashed.join(wanted, "digest", "left_semi").dropDuplicates(["digest"])

    def shingles(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, k)).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["digest", "shingles"])

    sets = scratch.table(texts.mapInArrow(shingles, "digest string, shingles binary"), "sets")
    dealt = common.in_blocks(scratch, met, ["place", "key"], "digest", "met", weight="n", carried=sets).select("place", "key", "block_a", "block_b", "digest", "shingles")

    def decide(batches):
        for batch in common.groups(batches, 4):
            starts = common.starts_of(batch, 4)
            ends = np.append(starts[1:], batch.num_rows)
            digests, sets = batch.column(4), batch.column(5)
            out = []
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                if b - a > 1:
                    near = near_sets([np.frombuffer(s.as_buffer(), "<u8") for s in sets.slice(a, b - a)], similarity)
                    out += [(a + i, a + j) for i, j in common.forest(b - a, near)]
            if out:
                u, v = np.array(out).T
                yield pa.RecordBatch.from_arrays([digests.take(pa.array(u)), digests.take(pa.array(v))], ["u", "v"])

    sure = scratch.table(dealt.mapInArrow(decide, "u string, v string"), "sure")
    out = common.components(scratch, sure, "texts")
    scratch.drop("profiles", "met", "met-sizes", "sets", "sure")
    return out.select(F.col("node").alias("digest"), "component")


def deduplicate(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of equal or near-duplicate texts: the
    one of the least doc_id (nulls last). Texts without words are equal if they
    are equal byte by byte; a null text is an empty one."""
    scratch = Scratch(docs.sparkSession)
    found = near_duplicates(scratch, docs, k, similarity)
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id")
    classes = docs.select(digest.alias("digest"), "doc_id").groupBy("digest").agg(F.min(order).alias("best"))
    classes = scratch.table(classes.join(found, "digest", "left").withColumn("component", F.coalesce("component", "digest")), "classes")
    kept = classes.groupBy("component").agg(F.min(F.struct("best.null", "best.doc_id", "digest")).alias("kept"))
    kept = kept.select(F.col("kept.digest").alias("digest"), F.col("kept.doc_id").alias("first_id"))
    rows = common.whole(docs, own=digest, id=F.col("doc_id"))
    out = rows.join(kept, (F.col("own") == F.col("digest")) & F.col("id").eqNullSafe(F.col("first_id")))
    return out.dropDuplicates(["own"]).select("row.*")
