"""Session settings and the shared working folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_DIR = "spark.checkpoint.dir"


def session(app: str = "assetlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the package is written for.

    UTC keeps windows and partition values equal on every machine. AQE coalesces
    and splits shuffle partitions, so the shuffle partition count is an upper
    bound and not a tuning knob. Keyword arguments use ``__`` for the dots.
    """
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update({name.replace("__", "."): value for name, value in conf.items()})
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session may run without ``spark.checkpoint.dir``; it gets a
    temporary folder that is removed when the process ends.
    """
    path = spark.conf.get(_CHECKPOINT_DIR, None)
    if path:
        return path.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError(f"set {_CHECKPOINT_DIR} to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="assetlake-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.conf.set(_CHECKPOINT_DIR, path)
    return path


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def with_conf(spark: SparkSession, settings: Mapping[str, str]) -> Iterator[None]:
    """Settings that hold inside the block; the caller's own come back afterwards."""
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def is_missing_path(error: AnalysisException) -> bool:
    """Whether a read failed because nothing has been written there yet. Every other error must come out."""
    return error.getCondition() == "PATH_NOT_FOUND"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back; what comes next sees the same rows each time."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Materialize ``df`` in the shared folder and forget its lineage.

    A reliable checkpoint outlives lost executors, and a value that is not
    deterministic (approximate percentiles, sampled bounds) is fixed by it.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return df.checkpoint(eager=True)
