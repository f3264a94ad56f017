"""Slices of a stored table kept up to date from a stream, whatever is late, replayed or broken off.

Each micro-batch is reduced to partial rows, which are stored by slice and batch id; then the slices that the batch has
rows of are merged again from the partials of all batches and put in the place of the old ones. A batch that is replayed
after a break-off finds its own partials and overwrites them, so nothing counts twice, and late rows reopen their slice.
The work of a batch is its own rows and the partials of its slices; raw rows aren't kept or read again.

The table equals one batch run over all rows, if ``merge`` of partials of parts is ``merge`` of the partials of the whole
(sums, counts, minima, maxima, sketches, but no ratios). Partials are a file or more for each slice and batch, so a
trigger of seconds on slices of years makes small files: choose the trigger by the slice.

Defined results: rows with a null slice are a slice of their own; a batch without rows changes nothing; a stream that had
no rows is an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class SliceStream:
    """The table in the folder ``path`` with the columns ``schema``, sliced by ``slice_col``.

    ``partial`` reduces the rows of a batch to rows of that schema, ``merge`` several such rows of a key to one."""

    def __init__(self, path: str, schema: str, slice_col: str, partial: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame]):
        self.path, self.schema, self.slice_col, self.partial, self.merge = path, schema, slice_col, partial, merge

    def _stored(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return spark.createDataFrame([], schema)
        # the types are said, as they can't be guessed from folder names
        return spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _partials(self, spark: SparkSession) -> DataFrame:
        return self._stored(spark, "partials", f"{self.schema}, batch long")

    def take(self, batch: DataFrame, batch_id: int) -> None:
        """Brings one micro-batch in; again with the same id and rows it changes nothing."""
        spark, key = batch.sparkSession, F.col(self.slice_col)
        rows = self.partial(batch).withColumn("batch", F.lit(batch_id).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.slice_col, "batch").parquet(f"{self.path}/partials")
        kept = self._partials(spark)
        touched = kept.where(F.col("batch") == batch_id).select(self.slice_col).distinct()
        # an equality, so that only the folders of those slices are read; the null slice apart
        again = kept.join(touched, self.slice_col, "left_semi")
        if not touched.where(key.isNull()).isEmpty():
            again = again.unionByName(kept.where(key.isNull()))
        columns = spark.createDataFrame([], self.schema).columns
        merged = self.merge(again.drop("batch")).select(*columns)
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.slice_col).parquet(f"{self.path}/table")

    def start(self, stream: DataFrame, **trigger) -> StreamingQuery:
        """Runs ``stream`` into the table, from where the last run ended; ``trigger`` as in writeStream.trigger."""
        writer = stream.writeStream.foreachBatch(self.take).option("checkpointLocation", f"{self.path}/checkpoint")
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def read(self, spark: SparkSession) -> DataFrame:
        return self._stored(spark, "table", self.schema)

    def reopened(self, spark: SparkSession, days: int) -> DataFrame:
        """The slice, batch and latest (the watermark's day) of batches that had rows of a slice that ended more than
        ``days`` before the latest slice of the batches before. Slices are dates here."""
        pairs = self._partials(spark).select(self.slice_col, "batch").distinct()
        # one row a batch
        last = pairs.groupBy("batch").agg(F.max(self.slice_col).alias("latest"))
        last = last.withColumn("latest", F.max("latest").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)))
        return pairs.join(last, "batch").where(F.col(self.slice_col) < F.date_sub("latest", days)).select(self.slice_col, "batch", "latest")
