"""Session construction and the settings every plan in this library relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

#: UTC keeps timestamps equal to the oracle's; LAST_WIN is the duplicate-key rule of the data model.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[*]", app: str = "larder", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session with this library's settings; shuffle_partitions should grow with the data (about 100 per GB)."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in (SETTINGS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.ui.enabled": "false"} | extra).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set the runtime settings on a session that somebody else made."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.

    Where the setting is missing, local mode, which is one machine, gets a new temporary folder; a cluster is refused,
    as no folder of the driver's own would do.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-larder-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")
