"""Cases, jobs and the registry of graphs as small tables: rows in, rows out."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.sinks import graph_store

#: How long a job is a worker's.
LEASE = timedelta(minutes=5)


# ---- the graphs there are


@dataclass
class GraphRecord:
    id: str
    name: str
    created_at: str
    vertices: int = 0
    edges: int = 0


class GraphRegistry:
    """Graphs by id, with a name for people and how much was imported, in a JSON file that is replaced whole."""

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def _read(self) -> dict[str, GraphRecord]:
        return {r["id"]: GraphRecord(**r) for r in json.loads(self.path.read_text())} if self.path.exists() else {}

    def _write(self, records: dict[str, GraphRecord]) -> None:
        new = self.path.with_name(f"{self.path.name}.{uuid.uuid4().hex}")
        new.write_text(json.dumps([asdict(r) for r in records.values()]))
        os.replace(new, self.path)

    def ensure(self, graph_id: str, name: str) -> GraphRecord:
        records = self._read()
        if graph_id not in records:
            records[graph_id] = GraphRecord(graph_id, name, datetime.now().isoformat())
            self._write(records)
        return records[graph_id]

    def create(self, name: str) -> GraphRecord:
        return self.ensure(f"graph_{uuid.uuid4().hex[:12]}", name)

    def all(self) -> list[GraphRecord]:
        """The newest first."""
        return sorted(self._read().values(), key=lambda r: r.created_at, reverse=True)

    def get(self, graph_id: str) -> GraphRecord | None:
        return self._read().get(graph_id)

    def delete(self, graph_id: str) -> None:
        self._write({k: r for k, r in self._read().items() if k != graph_id})

    def add(self, graph_id: str, vertices: int, edges: int) -> None:
        records = self._read()
        if r := records.get(graph_id):
            r.vertices, r.edges = r.vertices + vertices, r.edges + edges
            self._write(records)


# ---- cases


def new_cases(rows: DataFrame, now: Column | None = None) -> DataFrame:
    """Open cases of rows(title, created_by; priority): case_id, title, status, priority, created_by, created_at, updated_at."""
    at = F.current_timestamp() if now is None else now
    priority = F.coalesce("priority", F.lit("medium")) if "priority" in rows.columns else F.lit("medium")
    return rows.select(F.concat(F.lit("case:"), F.replace(F.expr("uuid()"), F.lit("-"), F.lit(""))).alias("case_id"), "title", F.lit("open").alias("status"), priority.alias("priority"), "created_by", at.alias("created_at"), at.alias("updated_at"))


def case_list(cases: DataFrame, status: str | None = None) -> DataFrame:
    c = cases if status is None else cases.where(F.col("status") == status)
    return c.orderBy(F.desc("created_at"), "case_id")


def case(cases: DataFrame, case_id: str) -> DataFrame:
    return cases.where(F.col("case_id") == case_id).limit(1)


def subjects(rows: DataFrame) -> DataFrame:
    """HAS_SUBJECT edges of rows(case_id, entity_id, subject_role, added_by): one a case and entity."""
    e = rows.select(F.col("case_id").alias("src"), F.col("entity_id").alias("dst"), F.lit("HAS_SUBJECT").alias("edge_type"), F.lit(0).cast("long").alias("rank"), "subject_role", "added_by")
    return e.groupBy(*graph_store.EDGE_KEY).agg(F.min(F.struct("subject_role", "added_by")).alias("_r")).select(*graph_store.EDGE_KEY, "_r.*")


def notes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(note vertices, HAS_NOTE edges) of rows(case_id, body, author_id): an id is a hash of these three, so writing again changes nothing."""
    n = rows.select("case_id", "body", "author_id", F.concat(F.lit("note:"), F.substring(F.sha2(F.concat_ws("\0", "case_id", "author_id", "body").cast("binary"), 256), 1, 32)).alias("vid")).dropDuplicates(["vid"])
    v = n.select("vid", F.lit("case_note").alias("tag"), "body", "author_id")
    return v, n.select(F.col("case_id").alias("src"), F.col("vid").alias("dst"), F.lit("HAS_NOTE").alias("edge_type"), F.lit(0).cast("long").alias("rank"))


def pending_reviews(items: DataFrame, queue_type: str | None = None, every_status: bool = False) -> DataFrame:
    """Review items(queue_type, status, ...) that wait, or all."""
    i = items if every_status else items.where("status = 'pending'")
    return i if queue_type is None else i.where(F.col("queue_type") == queue_type)


# ---- jobs


def claimable(now: datetime) -> Column:
    """Whether a job waits and nobody holds it, or whoever held it is late."""
    free = (F.coalesce("lease_owner", F.lit("")) == "") | (F.col("lease_expires_at") < F.lit(now))
    return (F.col("status").isin("pending", "running") & free & ((F.col("status") == "pending") | (F.col("lease_expires_at") < F.lit(now)))) & (F.col("attempt") < F.col("max_attempts"))


def claimed(jobs: DataFrame, worker: str, now: datetime, lease: timedelta = LEASE, limit: int = 1) -> DataFrame:
    """jobs(job_id, job_type, status, attempt, max_attempts, lease_owner, lease_expires_at, created_at, ...) with the oldest claimable ones now the worker's."""
    mine = jobs.where(claimable(now)).orderBy("created_at", "job_id").limit(limit).select("job_id", F.lit(True).alias("_mine"))
    j, got = jobs.join(mine, "job_id", "left"), F.col("_mine").isNotNull()
    return j.withColumns({"status": F.when(got, "running").otherwise(F.col("status")), "attempt": F.col("attempt") + got.cast("int"), "lease_owner": F.when(got, worker).otherwise(F.col("lease_owner")), "lease_expires_at": F.when(got, F.lit(now + lease)).otherwise(F.col("lease_expires_at"))}).drop("_mine")


def finished(jobs: DataFrame, worker: str, results: DataFrame, now: datetime) -> DataFrame:
    """jobs after results(job_id, result_json, error): only the worker's own running jobs end, completed or failed."""
    r = results.select("job_id", F.col("result_json").alias("_r"), F.col("error").alias("_e"))
    own = (F.col("lease_owner") == worker) & (F.col("status") == "running") & (F.col("_r").isNotNull() | F.col("_e").isNotNull())
    j = jobs.join(r, "job_id", "left").withColumn("_own", F.coalesce(own, F.lit(False)))
    done = {"status": F.when(F.col("_e").isNotNull(), "failed").otherwise("completed"), "result_json": F.col("_r"), "error": F.col("_e"), "completed_at": F.lit(now)}
    return j.withColumns({c: F.when(F.col("_own"), v).otherwise(F.col(c)) if c in jobs.columns else F.when(F.col("_own"), v) for c, v in done.items()}).drop("_r", "_e", "_own")


def run_jobs(jobs: DataFrame, worker: str, handlers: dict[str, Callable[[dict], dict]], now: datetime, limit: int = 1) -> DataFrame:
    """Claim up to `limit` jobs, run them by type on the driver (a handler may start Spark jobs), and end them. Unknown types fail."""
    held = claimed(jobs, worker, now, limit=limit)
    held = held.sparkSession.createDataFrame(held.collect(), held.schema)  # what was claimed stays claimed
    out = []
    for job in held.where((F.col("lease_owner") == worker) & (F.col("status") == "running")).collect():
        try:
            if job.job_type not in handlers:
                raise ValueError(f"unknown job type: {job.job_type}")
            out.append((job.job_id, json.dumps(handlers[job.job_type](json.loads(job.payload_json or "{}"))), None))
        except Exception as error:  # a job's failure is its result
            out.append((job.job_id, None, str(error)))
    return finished(held, worker, held.sparkSession.createDataFrame(out, "job_id string, result_json string, error string"), now)
