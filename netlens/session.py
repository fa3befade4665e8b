"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every netlens job relies on: UTC so hour buckets do not move with the
# client zone, AQE for runtime coalescing / skew handling.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, app: str = "netlens",
              shuffle_partitions: int | None = None, conf: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (conf or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


_SCRATCH: dict[str, str] = {}  # application id -> scratch folder made here (local runs only)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment (a shared file system) and is
    returned as is, so stream checkpoints under it survive restarts. When it is
    unset, the context's checkpoint folder is used; on a local master a scratch
    folder is created and given to the context (``spark.checkpoint.dir`` is a
    static setting and is not changed here), on any other it is an error, as
    executors would not share a local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if base:
        if current is None:
            spark.sparkContext.setCheckpointDir(base)
        return base
    app = spark.sparkContext.applicationId
    if app in _SCRATCH:
        return _SCRATCH[app]
    if current:
        return current
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    d = tempfile.mkdtemp(prefix="netlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(d)
    _SCRATCH[app] = d
    return d
