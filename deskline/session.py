"""Session defaults and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "deskline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tested under.

    Shuffle width is left to AQE: a generous initial number that is coalesced
    at run time, so the same code fits a laptop and a cluster.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # A repeated field of a model answer has its last value.
        .config("spark.sql.variant.allowDuplicateKeys", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_local_base: str | None = None


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name below the shared folder the session names.

    ``spark.checkpoint.dir`` is the cluster's shared storage.  Only where it is
    unset and all tasks run on this machine a temporary folder is made and used
    instead; on a cluster executors would not see each other's files.
    """
    global _local_base
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        if _local_base is None:
            _local_base = tempfile.mkdtemp(prefix="deskline-")
        base = _local_base
    return f"{base.rstrip('/')}/deskline/{purpose}-{uuid.uuid4().hex}"


def cut(df: DataFrame, purpose: str = "cut", partition_by: str | None = None) -> DataFrame:
    """The result as a written table in the shared folder.

    Computed once, survives lost executors and ends the lineage (a checkpoint
    would compute it a second time unless it is cached as well).
    """
    path = work_dir(df.sparkSession, purpose)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Takes away the files of tables that `cut` wrote and nothing reads any more."""
    for table in tables:
        session = table.sparkSession
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            if "/deskline/" in folder:
                path = session._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


ARROW_BYTES = 4 << 20


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile gives its shuffle files back when it is written, not when the driver collects garbage,
    and its rows go to Python in batches of few bytes, however long they are.
    """
    settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(ARROW_BYTES)}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
