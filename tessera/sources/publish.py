"""Versioned tables behind numbered pointers (B12-B14); segmented tables are in ``commits``."""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


_POINTER = re.compile(r"CURRENT\.(\d{12})\.json$")


def _pointers(spark: SparkSession, root: str) -> list[int]:
    fs, at = _fs(spark, root)
    if not fs.exists(at):
        return []
    return sorted(int(m[1]) for s in fs.listStatus(at) if (m := _POINTER.search(s.getPath().getName())))


def publish(df: DataFrame, root: str, keep: int = 2) -> str:
    """Writes a new version below ``root``, then a new pointer of the next number.

    Readers follow the highest number, and a pointer is written beside its place
    and renamed into it, so they see the old version or the new one at every
    moment, and a crash leaves the old one. If two writers race, the rename of
    the second fails. The ``keep`` last versions stay.
    """
    spark, version = df.sparkSession, f"v={uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{version}")
    before = _pointers(spark, root)
    number = (before[-1] if before else 0) + 1
    fs, to = _fs(spark, f"{root}/CURRENT.{number:012d}.json")
    _, fresh = _fs(spark, f"{root}/_{version[2:]}.tmp")
    out = fs.create(fresh, True)
    out.write(bytearray(json.dumps({"version": version}).encode()))
    out.close()
    if fs.exists(to) or not fs.rename(fresh, to):
        fs.delete(fresh, False)
        raise RuntimeError(f"another writer has published version {number} of {root}")
    for old in before[: len(before) + 1 - keep] if keep else []:
        name = _version(spark, root, old)
        fs.delete(_fs(spark, f"{root}/CURRENT.{old:012d}.json")[1], False)
        fs.delete(_fs(spark, f"{root}/{name}")[1], True)
    return version


def _version(spark: SparkSession, root: str, number: int) -> str:
    fs, at = _fs(spark, f"{root}/CURRENT.{number:012d}.json")
    source = fs.open(at)
    try:
        return json.loads(bytes(source.readAllBytes()))["version"]
    finally:
        source.close()


def published(spark: SparkSession, root: str) -> bool:
    """Whether ``root`` holds a version; versions without a pointer are an error, not a first run."""
    if _pointers(spark, root):
        return True
    fs, at = _fs(spark, root)
    if fs.exists(at) and any(s.getPath().getName().startswith("v=") for s in fs.listStatus(at)):
        raise RuntimeError(f"{root} holds versions but no pointer")
    return False


def current(spark: SparkSession, root: str) -> DataFrame:
    if not published(spark, root):
        raise FileNotFoundError(f"nothing is published below {root}")
    return spark.read.parquet(f"{root}/{_version(spark, root, _pointers(spark, root)[-1])}")


def staging(root: str, job: str) -> str:
    """Where a job writes before it publishes."""
    if not re.fullmatch(r"[A-Za-z0-9._-]+", job):
        raise ValueError(f"a job's name is letters, digits, dot, dash and underscore: {job!r}")
    return f"{root}/staging/{job}"


# --- artifacts (B14) ----------------------------------------------------------


def save_artifact(df: DataFrame, root: str, signature: str) -> str:
    """Keeps a collected result under the hash of what it was made from."""
    path = f"{root}/artifact-{hashlib.sha256(signature.encode()).hexdigest()}"
    df.write.mode("overwrite").parquet(path)
    return path


def load_artifact(spark: SparkSession, root: str, signature: str) -> DataFrame | None:
    """The result kept for this signature, if it was written to its end."""
    path = f"{root}/artifact-{hashlib.sha256(signature.encode()).hexdigest()}"
    fs, done = _fs(spark, f"{path}/_SUCCESS")
    return spark.read.parquet(path) if fs.exists(done) else None
