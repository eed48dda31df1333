"""Token-ID output in bit-plane files, and their reader.

A file holds the documents of one range of doc_id in ascending order. Its ids
are cut into blocks of a fixed number of ids; a block is transposed into bit
or byte planes, each plane is compressed with zstandard by itself, and the
chunk index at the end gives every plane's place, so that a reader can take
any block. Layout: magic, planes of block 0, 1, ...; the index as compressed
JSON lines (one for each block: first id, ids, offset, plane lengths) and
document columns (doc_id, flag for null, tokens); its place and size; magic.

Defined results: a null or empty text is the end id alone; a null doc_id sorts
first; repeated doc_ids stay separate documents, ordered by their text's hash;
an empty table gives no file and no row; extra columns are not read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .encoding import encoder

MAGIC = b"TSBP\x01\x00\x00\x00"
BLOCK = 1 << 16
ENTRY = "first_id bigint, file string, part int, docs bigint, tokens bigint, bytes bigint"
DOCUMENT = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Planes of one block, lowest first, only as many as its largest id needs."""
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    if kind == "byte":
        return [np.ascontiguousarray(ids.view("u1").reshape(-1, 4)[:, k]).tobytes() for k in range(-(-bits // 8))]
    return [np.packbits((ids >> np.uint32(k)).astype("u1") & 1).tobytes() for k in range(bits)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        out = np.zeros((n, 4), "u1")
        for k, plane in enumerate(planes):
            out[:, k] = np.frombuffer(plane, "u1")
        return out.reshape(-1).view("<u4")
    ids = np.zeros(n, "<u4")
    for k, plane in enumerate(planes):
        ids |= np.unpackbits(np.frombuffer(plane, "u1"), count=n).astype("<u4") << np.uint32(k)
    return ids


class PlaneWriter:
    """Streams ids into planes; memory is one block and the document columns."""

    def __init__(self, sink, kind: str = "byte", level: int = 3, block: int = BLOCK):
        self.sink, self.kind, self.block = sink, kind, block
        self.zip = zstandard.ZstdCompressor(level=level)
        self.waiting, self.held, self.done, self.at = [], 0, 0, 0
        self.index, self.docs, self.sizes = [], [], []
        self._put(MAGIC)

    def _put(self, raw: bytes) -> None:
        self.sink.write(raw)
        self.at += len(raw)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.sizes.append(len(ids) // 4)
        self.waiting.append(ids)
        self.held += len(ids) // 4
        while self.held >= self.block:
            every = np.frombuffer(b"".join(self.waiting), "<u4")
            whole = len(every) // self.block * self.block
            for i in range(0, whole, self.block):
                self._block(every[i : i + self.block])
            self.waiting, self.held = [every[whole:].tobytes()], len(every) - whole

    def _block(self, ids: np.ndarray) -> None:
        at, planes = self.at, [self.zip.compress(p) for p in to_planes(ids, self.kind)]
        for p in planes:
            self._put(p)
        self.index.append([self.done, len(ids), at, [len(p) for p in planes]])
        self.done += len(ids)

    def close(self) -> int:
        if self.held:
            self._block(np.frombuffer(b"".join(self.waiting), "<u4"))
        head = {"kind": self.kind, "block": self.block, "docs": len(self.docs), "blocks": self.index}
        null = np.array([d is None for d in self.docs], "u1")
        ids = np.array([d or 0 for d in self.docs], "<i8")
        tail = [json.dumps(head).encode(), ids.tobytes(), null.tobytes(), np.array(self.sizes, "<u4").tobytes()]
        tail = self.zip.compress(b"".join(struct.pack("<Q", len(x)) + x for x in tail))
        at = self.at
        self._put(tail)
        self._put(struct.pack("<QQ", at, len(tail)) + MAGIC)
        return self.at


class PlaneReader:
    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        size = source.tell()
        source.seek(size - 24)
        at, length, magic = struct.unpack("<QQ8s", source.read(24))
        source.seek(0)
        if magic != MAGIC or source.read(8) != MAGIC:
            raise ValueError("not a plane file, or cut short")
        source.seek(at)
        raw, parts = zstandard.ZstdDecompressor().decompress(source.read(length)), []
        while raw:
            n = struct.unpack("<Q", raw[:8])[0]
            parts.append(raw[8 : 8 + n])
            raw = raw[8 + n :]
        head = json.loads(parts[0])
        self.kind, self.blocks = head["kind"], head["blocks"]
        null = np.frombuffer(parts[2], "u1")
        self.docs = [None if x else int(d) for d, x in zip(np.frombuffer(parts[1], "<i8"), null, strict=True)]
        self.sizes = np.frombuffer(parts[3], "<u4").astype("i8")

    def block(self, k: int) -> np.ndarray:
        _, n, at, lengths = self.blocks[k]
        self.source.seek(at)
        raw, unzip, out = self.source.read(sum(lengths)), zstandard.ZstdDecompressor(), []
        for size in lengths:
            out.append(unzip.decompress(raw[:size]))
            raw = raw[size:]
        return from_planes(out, n, self.kind)

    def documents(self):
        """(doc_id, start in this file, ids) in order, a block in memory at a time."""
        held, k, start = np.empty(0, "<u4"), 0, 0
        for doc, size in zip(self.docs, self.sizes, strict=True):
            parts, need = [], int(size)
            while len(held) < need:
                parts.append(held)
                need -= len(held)
                held = self.block(k)
                k += 1
            parts.append(held[:need])
            held = held[need:]
            yield doc, start, np.concatenate(parts)
            start += int(size)


def open_store(uri: str):
    """pyarrow's file system of a shared folder, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int, split: str = "byte", kind: str = "byte") -> DataFrame:
    """Writes ``docs`` to ``folder`` and returns the manifest, a row a file.

    One range shuffle puts documents in order; each task streams one file under
    a name of its own attempt, so a task that is run again leaves at most an
    unlisted file: only the manifest's files count.
    """
    spark = docs.sparkSession
    common.tune(spark)
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie", "text")
    )
    end = struct.pack("<I", end_id)

    def run(batches):
        from pyspark import TaskContext

        context, writer, first, tokens = TaskContext.get(), None, None, 0
        part = context.partitionId()
        name = f"part-{part:06d}-{context.attemptNumber()}-{uuid.uuid4().hex[:12]}.tsbp"
        store, path = open_store(folder)
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                store.create_dir(path, recursive=True)
                sink = store.open_output_stream(f"{path}/{name}")
                writer, first = PlaneWriter(sink, kind), batch.column(0)[0].as_py()
            ids = batch.column(0).to_pylist()
            for at in range(0, len(ids), 64):
                for doc, raw in zip(ids[at : at + 64], encoder(vocabulary, split).encode(batch.column(1)[at : at + 64].to_pylist()), strict=True):
                    writer.add(doc, raw + end)
                    tokens += len(raw) // 4 + 1
        if writer is not None:
            n = len(writer.docs)
            size = writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"first_id": pa.array([first], pa.int64()), "file": [f"{folder}/{name}"], "part": pa.array([part], pa.int32()), "docs": [n], "tokens": [tokens], "bytes": [size]})

    return ordered.mapInArrow(run, ENTRY)


def read(manifest: list, spark) -> DataFrame:
    """Per document from the files: its place among all ids, its tokens, their CRC.

    ``manifest`` is a row a file, so as many as the writer had tasks.
    """
    base, rows = 0, []
    for r in sorted(manifest, key=lambda r: r["part"]):
        rows.append((r["file"], base))
        base += r["tokens"]
    files = spark.createDataFrame(rows, "file string, base bigint")
    files = files.repartitionByRange(max(1, len(rows)), "base") if len(rows) > 1 else files

    def run(batches):
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, path = open_store(file)
                with store.open_input_file(path) as source:
                    out = []
                    for doc, start, ids in PlaneReader(source).documents():
                        out.append((doc, base + start, len(ids), zlib.crc32(ids.tobytes())))
                        if len(out) == 4096:
                            yield _batch(out)
                            out = []
                    if out:
                        yield _batch(out)

    return files.mapInArrow(run, DOCUMENT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)


def write_and_read(docs: DataFrame, vocabulary: str, end_id: int = 2, kind: str = "byte") -> DataFrame:
    """The round trip through files in the shared folder."""
    folder = f"{common.shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    common.remove_at_exit(docs.sparkSession, folder)
    return read(write(docs, folder, vocabulary, end_id, kind=kind).collect(), docs.sparkSession)
