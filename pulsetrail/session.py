"""Session helpers.

On a cluster the session comes from the submitter and nothing here is needed.
``local_session`` is for tests, the bench and laptops.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cores: int = 8, **conf) -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cores}]").appName("pulsetrail")
               .config("spark.sql.shuffle.partitions", str(cores))
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", "12g")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true"))
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Where the session names none, one is made locally and deleted at the end,
    on one machine only: on a cluster executors could not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="pulsetrail-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(id(spark.sparkContext), []).append(path)
    return path


_WRITTEN: dict[int, list[str]] = {}


def discard_written(spark: SparkSession) -> int:
    """Delete every folder handed out by ``fresh_path`` in this session; returns how many there were.

    For the end of a run, when its results are stored elsewhere.
    """
    paths = _WRITTEN.pop(id(spark.sparkContext), [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark removes a job's shuffle files when the job ends; its results are stored or with the driver by then."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
