"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings that make results independent of the machine and keep skewed joins safe.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}
_LOCAL_FOLDERS: dict[str, str] = {}


def session(app: str = "hazardlake", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Only a session on one machine (``local[...]``) may go without; it gets a folder under /tmp.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = "file://" + tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp")
    return _LOCAL_FOLDERS[app]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``checkpoint()`` write to the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
