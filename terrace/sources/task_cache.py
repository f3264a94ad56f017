"""Results of tasks, kept under the hash of all that they depend on: what was computed once isn't computed again.

A result's key is the canonical JSON hash of the task's inputs and the version of what computes it, so a changed query, schema
slice or configuration is another key. Puts only ever add files, under the version's folder, and the files of a put appear
when it is complete; two puts of one key hold the same result, of which a read takes one. So writers needn't wait for
each other, and one that is lost adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.canonical import fingerprint
from ..operators.shared import materialise

PARTS = ("task", "sql", "schema_slice", "config")


def keyed(tasks: DataFrame, version: str) -> DataFrame:
    """``tasks`` (task, sql, schema_slice, config) with their key."""
    parts = F.struct(*PARTS, F.lit(version).alias("version"))
    kind = StructType([*[tasks.schema[c] for c in PARTS], *tasks.select(F.lit(version).alias("version")).schema])
    return tasks.withColumn("key", fingerprint(parts, kind))


class TaskCache:
    """The results of one version under ``path``; result: the schema of what ``compute`` gives besides the key."""

    def __init__(self, spark: SparkSession, path: str, version: str, result: StructType):
        self.spark, self.top, self.version = spark, path, version
        self.schema = StructType().add("key", "string")
        for f in result:
            self.schema.add(f)

    @property
    def path(self) -> str:
        return f"{self.top}/version-{self.version}"

    def _folder(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def stored(self) -> DataFrame:
        """All results kept, with their keys; a key that was put twice comes twice."""
        folder, fs = self._folder(self.path)
        return self.spark.read.schema(self.schema).parquet(self.path) if fs.exists(folder) else self.spark.createDataFrame([], self.schema)

    def put(self, results: DataFrame) -> None:
        """Adds ``results`` (with their key)."""
        results.select(*self.schema.names).write.mode("append").parquet(self.path)

    def get(self, tasks: DataFrame) -> DataFrame:
        """key and result rows of those ``tasks`` that have one; a result may have several rows, but those of one put only."""
        return self.stored().join(keyed(tasks, self.version).select("key").distinct(), "key", "left_semi").distinct()

    def pending(self, tasks: DataFrame) -> DataFrame:
        """``tasks`` with their key, those without a result."""
        return keyed(tasks, self.version).join(self.stored().select("key").distinct(), "key", "left_anti")

    def run(self, tasks: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The results of all ``tasks``, of which ``compute`` is only given those without one; what it gives is kept."""
        left = materialise(self.pending(tasks), "tasks")
        if not left.isEmpty():
            self.put(compute(left))
        return self.get(tasks)

    def evict(self) -> list[str]:
        """Deletes the results of all other versions, and gives their names."""
        folder, fs = self._folder(self.top)
        gone = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName() != f"version-{self.version}"] if fs.exists(folder) else []
        for p in gone:
            fs.delete(p, True)
        return sorted(p.getName().removeprefix("version-") for p in gone)
