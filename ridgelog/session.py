"""Session defaults and the shared scratch location."""

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
_SCRATCH: dict[str, list[str]] = {}

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app_name: str = "ridgelog", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators rely on.

    The session time zone is UTC because timestamps are zone-free throughout.
    Shuffle partitions are left to AQE: the initial number is high and AQE
    coalesces it, so the same setting serves a laptop and a large cluster.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # every column operation would otherwise record its call site, which is a third of the time that building a large plan takes
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        # streaming state on local disk instead of the heap: deduplication keeps ten minutes of ids
        STATE_STORE: ROCKSDB,
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, whatever store the session names; the session's setting comes back afterwards.

    A stream takes its settings when it is started. State machines with several variables or timers run on no other store.
    """
    before = spark.conf.getAll.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)


def shared_root(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    Only a local master may run without the setting; it then gets a temporary
    folder, because driver and executors are one process there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="ridgelog-")
    return _LOCAL_ROOTS[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; ``release_scratch`` removes what was written there."""
    path = os.path.join(shared_root(spark), f"{label}-{uuid.uuid4().hex}")
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def folder_system(spark: SparkSession, path: str):
    """The file system of a path and the path itself, as Hadoop sees them."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), root


def release_scratch(spark: SparkSession) -> int:
    """Remove everything this application wrote to scratch paths; frames that read it must not be used any more."""
    removed = 0
    for path in _SCRATCH.pop(spark.sparkContext.applicationId, []):
        system, root = folder_system(spark, path)
        removed += system.delete(root, True)
    return removed


def checkpointed(df, label: str = "cut"):
    """Cut the lineage of ``df`` by writing it to the shared folder and reading it back.

    A written table survives lost executors and is not recomputed. It stays until
    ``release_scratch``, because any number of frames may read it.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
