"""Session helpers: a local session for tests/bench and shared scratch paths.

Scratch output (archives written by the round-trip checks, streaming
checkpoints) always goes under the folder the cluster names in
``spark.checkpoint.dir``; only when that is unset (local tests) is a
private folder created and registered.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


# Recommended for any deployment. Rule-heavy projections generate long
# Java methods; the JVM does not JIT-compile methods above 8000 bytes of
# bytecode, so such a stage would run interpreted. Capping whole-stage
# methods at that size makes Spark split them instead, and the JVM flag
# lifts the limit for what remains.
RECOMMENDED_CONF = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}
JVM_OPTIONS = "-XX:-DontCompileHugeMethods"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "impactlens") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("IMPACTLENS_DRIVER_MEMORY", "4g"))
        .config("spark.driver.extraJavaOptions", JVM_OPTIONS)
    )
    conf = dict(RECOMMENDED_CONF)
    if os.environ.get("IMPACTLENS_HUGE_METHOD_LIMIT"):
        conf["spark.sql.codegen.hugeMethodLimit"] = os.environ["IMPACTLENS_HUGE_METHOD_LIMIT"]
    for item in filter(None, os.environ.get("IMPACTLENS_CONF", "").split(",")):
        k, _, v = item.partition("=")
        conf[k.strip()] = v.strip()
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_utc(spark)
    return spark


def ensure_utc(spark: SparkSession) -> None:
    """Event time, partition dates and report ids are defined in UTC."""
    if spark.conf.get("spark.sql.session.timeZone", None) not in ("UTC", "Etc/UTC", "Z"):
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in
    ``spark.checkpoint.dir``. Only a local-mode session (tests) without one
    gets a private folder; on a cluster a machine-local folder would not be
    visible to other executors, so an unset setting is an error there."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...) "
                               "for archives, round trips and streaming checkpoints")
        root = tempfile.mkdtemp(prefix="impactlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused folder under the shared checkpoint root; it goes
    when the driver ends."""
    path = f"{checkpoint_root(spark)}/impactlens/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


CHECKPOINT_FILES = "spark.sql.streaming.checkpointFileManagerClass"
_BY_FILE_SYSTEM = "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"


@contextmanager
def light_checkpoints(spark: SparkSession, path: str):
    """While it holds, streams write checkpoints on a local disk by Hadoop's
    ``FileSystem``. Spark's default, ``FileContext``, starts several processes
    (``readlink``) for every file there, and is no safer: on a local disk both
    look for the target and then rename. Other file systems, and a class that
    was chosen already, stay as they are."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    scheme = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme()
    ours = scheme == "file" and spark.conf.get(CHECKPOINT_FILES, None) is None
    if ours:
        spark.conf.set(CHECKPOINT_FILES, _BY_FILE_SYSTEM)
    try:
        yield
    finally:
        if ours:
            spark.conf.unset(CHECKPOINT_FILES)
