"""Indexing jobs: plans, bounded batches, degradation, checkpoints, leases.

What is one decision at a time stays on the driver and is small: a job's state,
its tasks, a lease. What touches rows is a DataFrame.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# States that may follow each, and bounds of a batch.
NEXT = {
    "pending": ("discovering", "failed"), "discovering": ("parsing", "failed", "partial_ready"), "parsing": ("extracting", "failed", "partial_ready"),
    "extracting": ("embedding", "failed", "partial_ready"), "embedding": ("reporting", "failed", "partial_ready"), "reporting": ("ready", "failed", "partial_ready"),
    "ready": (), "failed": ("pending",), "partial_ready": ("pending",),
}
MOST_FILES, MOST_RECORDS = 64, 2048


def plan(before: dict[str, dict[str, str]], after: dict[str, dict[str, str]], versions: tuple[dict[str, str], dict[str, str]] = ({}, {})) -> dict[str, list[str]]:
    """What has to be indexed again (I27): changed and deleted paths of each source;
    a new parser version rebuilds its whole source, a new embedding model all
    vectors, a changed profile its relations."""
    old, new = versions
    out: dict[str, list[str]] = {}
    for source in ("code", "docs", "profiles"):
        a, b = before.get(source, {}), after.get(source, {})
        forced = old.get(source) != new.get(source)
        out[f"{source}_changed"] = sorted(p for p, h in b.items() if forced or a.get(p) != h)
        out[f"{source}_deleted"] = sorted(set(a) - set(b))
    model = old.get("embedding_model") != new.get("embedding_model")
    out["vectors"] = sorted(after.get("docs", {})) if model else out["docs_changed"]
    out["relations"] = sorted(after.get("profiles", {})) if out["code_changed"] or out["code_deleted"] else out["profiles_changed"]
    return out


def batches(items: Iterable[tuple[str, int]], most_files: int = MOST_FILES, most_records: int = MOST_RECORDS) -> Iterator[list[str]]:
    """Items (key, records) in order, as many a batch as both bounds allow, one at least."""
    held: list[str] = []
    total = 0
    for key, n in items:
        n = max(1, n)
        if held and (len(held) >= most_files or total + n > most_records):
            yield held
            held, total = [], 0
        held.append(key)
        total += n
    if held:
        yield held


def deal(items: DataFrame, key: str, records: str, most_files: int = MOST_FILES, most_records: int = MOST_RECORDS) -> DataFrame:
    """Adds ``batch`` to rows of a table that no driver holds (I29): sorted ranges are
    numbered in parallel, each batch within both bounds unless one row alone is over."""

    def run(parts):
        batch, files, total = 0, 0, 0
        mark = uuid.uuid4().hex[:12]
        for part in parts:
            n = part.column(part.schema.get_field_index(records)).to_pylist()
            out = []
            for x in n:
                x = max(1, x or 0)
                if files and (files >= most_files or total + x > most_records):
                    batch, files, total = batch + 1, 0, 0
                files, total = files + 1, total + x
                out.append(f"{mark}-{batch:08d}")
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], [*part.schema.names, "batch"])

    schema = items.withColumn("batch", F.lit("")).schema
    return items.repartitionByRange(key).sortWithinPartitions(key).mapInArrow(run, schema)


def apply_or_degrade(keys: list[str], apply: Callable[[list[str]], None]) -> dict[str, str]:
    """Applies a batch; if that fails, each key alone, so that one bad item costs only
    itself (I30). Returns the errors by key."""
    try:
        apply(keys)
        return {}
    except Exception as whole:
        if len(keys) == 1:
            return {keys[0]: f"{type(whole).__name__}: {whole}"}
    failed = {}
    for key in keys:
        try:
            apply([key])
        except Exception as e:
            failed[key] = f"{type(e).__name__}: {e}"
    return failed


def parallel_map(rows: DataFrame, key: str, value: str, function: Callable[[str], str]) -> DataFrame:
    """(key, value, error) in order of keys: ``function`` over each row, errors caught
    item by item (I33). Tasks are the workers; a batch is all that is in flight."""

    def run(parts):
        for part in parts:
            done, bad = [], []
            for x in part.column(1).to_pylist():
                try:
                    done.append(function(x))
                    bad.append(None)
                except Exception as e:
                    done.append(None)
                    bad.append(type(e).__name__)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(done, pa.string()), pa.array(bad, pa.string())], [key, value, "error"])

    schema = f"{key} {rows.schema[key].dataType.simpleString()}, {value} string, error string"
    return rows.select(key, value).mapInArrow(run, schema).orderBy(key)


class Conflict(RuntimeError):
    """A lease that another job holds, or a step that a job's state doesn't allow."""


@dataclass
class Job:
    job_id: str
    status: str = "pending"
    attempts: int = 1
    tasks: dict[str, dict] = field(default_factory=dict)
    signature: str | None = None


class JobStore:
    """Jobs, their checkpoints and leases as files of one folder (I31, I32). A file is
    written beside its place and renamed into it, so a reader never sees a part."""

    def __init__(self, folder: str, clock: Callable[[], float] = time.time):
        self.folder, self.clock = folder, clock
        os.makedirs(folder, exist_ok=True)

    def _write(self, name: str, held: dict) -> None:
        path = os.path.join(self.folder, name)
        fresh = f"{path}.{uuid.uuid4().hex}"
        with open(fresh, "w", encoding="utf-8") as f:
            json.dump(held, f, sort_keys=True)
            f.flush()
            os.fsync(f.fileno())
        os.replace(fresh, path)

    def load(self, job_id: str) -> Job:
        try:
            with open(os.path.join(self.folder, f"job-{job_id}.json"), encoding="utf-8") as f:
                return Job(**json.load(f))
        except FileNotFoundError:
            return Job(job_id)

    def save(self, job: Job) -> None:
        self._write(f"job-{job.job_id}.json", job.__dict__)

    def move(self, job_id: str, status: str) -> Job:
        """To another state, if the present one allows it (I32)."""
        job = self.load(job_id)
        if status not in NEXT[job.status]:
            raise Conflict(f"{job.status} is not followed by {status}")
        job.attempts += status == "pending"
        job.status = status
        self.save(job)
        return job

    # -- checkpoints (I31) --

    def start(self, job_id: str, planned: dict) -> Job:
        """The job for a plan; under another plan's signature its checkpoints are void."""
        signature = hashlib.sha256(json.dumps(planned, sort_keys=True).encode()).hexdigest()
        job = self.load(job_id)
        if job.signature != signature:
            job.tasks, job.signature = {}, signature
            self.save(job)
        return job

    def record(self, job_id: str, task: str, status: str, input_hash: str) -> None:
        """collected: the result is kept; applied: it is visible and may be skipped."""
        job = self.load(job_id)
        job.tasks[task] = {"status": status, "input_hash": input_hash, "attempts": job.tasks.get(task, {}).get("attempts", 0) + (status == "collected")}
        self.save(job)

    def left(self, job_id: str, tasks: dict[str, str]) -> list[str]:
        """Tasks (name: hash of the input) that are not applied with this input, in order."""
        done = self.load(job_id).tasks
        return [t for t, h in tasks.items() if done.get(t, {}).get("status") != "applied" or done[t]["input_hash"] != h]

    # -- leases (I32) --

    def _lease(self, lock: str) -> dict | None:
        try:
            with open(os.path.join(self.folder, f"lock-{lock}.json"), encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return None

    def acquire(self, lock: str, owner: str, seconds: float = 3600) -> dict:
        """Takes a lease that is free, one's own or expired. Creation is exclusive; an
        expired lease is first renamed away, which only one job can do."""
        path, now = os.path.join(self.folder, f"lock-{lock}.json"), self.clock()
        held = self._lease(lock)
        fresh = {"owner": owner, "acquired": now, "expires": now + seconds}
        if held and held["owner"] == owner:
            self._write(f"lock-{lock}.json", fresh)
            return fresh
        if held:
            if held["expires"] > now:
                raise Conflict(f"{lock} is held by {held['owner']}")
            try:
                os.rename(path, f"{path}.{uuid.uuid4().hex}.expired")
            except FileNotFoundError:
                pass
        try:
            with open(path, "x", encoding="utf-8") as f:
                json.dump(fresh, f)
        except FileExistsError:
            raise Conflict(f"{lock} was taken by another job") from None
        return fresh

    def heartbeat(self, lock: str, owner: str, seconds: float = 3600) -> dict:
        held = self._lease(lock)
        if not held or held["owner"] != owner:
            raise Conflict(f"{lock} is not held by {owner}")
        held |= {"expires": self.clock() + seconds, "heartbeat": self.clock()}
        self._write(f"lock-{lock}.json", held)
        return held

    def release(self, lock: str, owner: str) -> bool:
        held = self._lease(lock)
        if not held or held["owner"] != owner:
            return False
        os.unlink(os.path.join(self.folder, f"lock-{lock}.json"))
        return True
