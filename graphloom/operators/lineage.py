"""Tables computed once and kept as Parquet in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a temporary folder is made, set as the checkpoint folder and removed
    at exit, but only on one machine (tests): on a cluster it is an error, as no executor
    would find what another wrote to its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm_dir.get() if jvm_dir.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{found}")
        found = f"file://{found}"
    return found if "://" in found or found.startswith("file:") else f"file://{found}"


#: A folder for all that this process writes, by shared folder.
_runs: dict[str, str] = {}


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, below one that is this process's own and goes with it."""
    shared = shared_dir(spark).rstrip("/")
    if shared not in _runs:
        _runs[shared] = f"{shared}/graphloom-{uuid.uuid4().hex}"
        atexit.register(remove, spark, _runs[shared])
    return f"{_runs[shared]}/{tag}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Remove a path; what is gone already, or can't be reached any more, is left alone."""
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended, or so has Python
        pass


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, computes once.

    The files outlive any executor, and readers get only the columns they use. They stay
    until discard, or until this process ends.
    """
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Remove the files of tables that materialize gave and nothing will read again."""
    for df in tables:
        if path := getattr(df, "_scratch", None):
            remove(df.sparkSession, path)


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage: what a loop or several readers go on from."""
    return materialize(df, "cut")
