"""Intermediate tables in the folder that driver and executors share.

Iterative operators cut their lineage by writing a Parquet table below
``spark.checkpoint.dir`` and reading it again, so a lost executor costs a
re-read and not a recomputation of the whole history.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from larder.session import shared_folder


class Scratch:
    """Named tables of one operator run. ``put`` writes and rereads; ``drop`` deletes what later steps don't need."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/larder/{name}-{uuid.uuid4().hex}"
        self.made = 0

    def put(self, frame: DataFrame, name: str) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{name}-{self.made}"
        frame.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(frame.schema).parquet(path)
        out._larder_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(frame._larder_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
