"""Session settings, table access and durable stages.

A stage is a table written to the folder that all executors share (``spark.checkpoint.dir``). It
cuts lineage: a lost executor costs a re-read, never a recomputation of what came before. The
folder is taken from the session and only chosen here where none is set (tests, a laptop).
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MADE: list[str] = []


def builder(app: str = "siftwright", master: str | None = None):
    """A session builder with the settings the plans are written for."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return b.config(map=conf)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for stages: the cluster's, or one of our own where the session names none and all of it runs in this process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all its machines share")
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="siftwright-")
        atexit.register(_drop_local, _OWN[app])
    return _OWN[app]


def _drop_local(uri: str) -> None:
    import shutil

    shutil.rmtree(uri.removeprefix("file://"), ignore_errors=True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody has; :func:`clear_stages` deletes what was put there."""
    path = f"{shared_dir(spark)}/{name}-{os.getpid()}-{uuid.uuid4().hex[:12]}"
    _MADE.append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of it.

    The table stays as long as results that read it may be needed: see :func:`clear_stages`.
    """
    path = new_path(df.sparkSession, f"stage-{name}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_stages(spark: SparkSession) -> int:
    """Delete all that this process put into the shared folder; results not yet written then can't be read."""
    n = len(_MADE)
    while _MADE:
        drop_path(spark, _MADE.pop())
    return n


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
