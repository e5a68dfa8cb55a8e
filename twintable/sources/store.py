"""Dataset store: one parquet folder per dataset id."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


class DatasetStore:
    """Save, load, list and delete tables under one root folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, dataset_id: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_-]+", dataset_id):
            raise ValueError(f"bad dataset id: {dataset_id!r}")
        return f"{self.root}/{dataset_id}.parquet"

    def _hadoop(self, path: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, dataset_id: str | None = None) -> str:
        dataset_id = dataset_id or uuid.uuid4().hex
        df.write.mode("overwrite").parquet(self._path(dataset_id))
        return dataset_id

    def load(self, dataset_id: str) -> DataFrame:
        if not self.exists(dataset_id):
            raise KeyError(dataset_id)
        return self.spark.read.parquet(self._path(dataset_id))

    def exists(self, dataset_id: str) -> bool:
        path, fs = self._hadoop(self._path(dataset_id))
        return fs.exists(path)

    def ids(self) -> list[str]:
        path, fs = self._hadoop(self.root)
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(n[: -len(".parquet")] for n in names if n.endswith(".parquet"))

    def delete(self, dataset_id: str) -> bool:
        path, fs = self._hadoop(self._path(dataset_id))
        return fs.delete(path, True)
