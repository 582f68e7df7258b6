"""Session construction and the shared checkpoint location."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job here relies on. Timestamps are compared in UTC and AQE
# re-plans joins / coalesces partitions / splits skewed partitions at run time.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str = "local[*]", shuffle_partitions: int = 8,
                app_name: str = "newsprism", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session for local runs and tests.

    On a cluster the session comes from the launcher; only call this where
    you own the configuration.
    """
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins. Only a ``local[...]`` master (tests) may go
    without one and gets a scratch folder; elsewhere executors would write to their
    own disks, so an unset folder raises.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="newsprism-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from the folder it was loaded from.

    Workers started outside the repository folder otherwise lack it; where the
    package is installed on the executors this changes nothing.
    """
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if home not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([home, *filter(None, paths)])


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared checkpoint folder.

    The table survives executor loss (unlike cached or locally checkpointed
    blocks), is written by a single job (``checkpoint()`` re-runs the last
    stage to write), and later reads get column pruning and pushed filters.
    Iterative fits and multi-job queries re-read it instead of re-tokenising.

    Tables go when their consumer says so (``drop_cut``, ``scratch``), and at the
    latest when the application ends.
    """
    spark = df.sparkSession
    home = f"{checkpoint_dir(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}"
    if home not in _HOMES:
        _HOMES.add(home)
        atexit.register(_delete, spark, home)
    path = f"{home}/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    cut = spark.read.parquet(path)
    _CUTS.append((cut, path))
    if getattr(_LOCAL, "cuts", None) is not None:
        _LOCAL.cuts.append(cut)
    return cut


_HOMES: set[str] = set()
_CUTS: list[tuple[DataFrame, str]] = []
_LOCAL = threading.local()  # cuts made inside this thread's innermost scratch block


def _delete(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file system; nothing to do once the context has stopped."""
    if spark.sparkContext._jsc is None:
        return
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def drop_cut(cut: DataFrame) -> None:
    """Delete the table behind ``cut_lineage``'s result; frames still built on it can no longer run."""
    for entry in [e for e in _CUTS if e[0] is cut]:
        _delete(cut.sparkSession, entry[1])
        _CUTS.remove(entry)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end of the block, every table cut inside it: for work whose result no longer reads them."""
    outer, mine = _LOCAL.__dict__.get("cuts"), []
    _LOCAL.cuts = mine
    try:
        yield
    finally:
        _LOCAL.cuts = outer
        for cut in mine:
            drop_cut(cut)
