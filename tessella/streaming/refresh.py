"""Keeping the index table up to date from a folder of blobs, as a stream that reads each file once.

A batch of new blobs is merged into the present version (the new record of a chunk wins) and written as the next version; a small
marker file names the version, and is added last. If a known blob was superseded or has vanished, the index is built anew from the effective ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import index


class IndexTable:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _version(self) -> int:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/current")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return -1
        return self.spark.read.text(f"{self.folder}/current").select(F.max(F.col("value").cast("int"))).first()[0]

    def read(self, name: str = "index") -> DataFrame | None:
        v = self._version()
        return None if v < 0 else self.spark.read.parquet(f"{self.folder}/v{v:08d}/{name}")

    def _commit(self, entries: DataFrame, blobs: DataFrame) -> None:
        v = self._version() + 1
        at = f"{self.folder}/v{v:08d}"
        # Rows of one chunk range stand together, so that lookups by chunk read few row groups.
        entries.repartitionByRange("chunk").sortWithinPartitions("chunk").write.mode("overwrite").parquet(f"{at}/index")
        blobs.write.mode("overwrite").parquet(f"{at}/blobs")
        # One more marker file: readers see the version before or this one, never none.
        self.spark.createDataFrame([(str(v),)], "value string").coalesce(1).write.mode("append").text(f"{self.folder}/current")

    def merge(self, batch: DataFrame, all_blobs: DataFrame) -> None:
        """``batch``: the blobs not seen before. ``all_blobs``: every blob there is, from which an index is rebuilt if need be."""
        known, entries = self.read("blobs"), self.read()
        effective = index.effective_blobs(all_blobs).select("blob")
        # Every known blob must still count: one that was superseded, or that has vanished, takes its entries along.
        stale = known is not None and not known.join(effective, "blob", "left_anti").isEmpty()
        if batch.isEmpty() and not stale:
            return
        gone = index.superseded(all_blobs)
        if known is None or stale:
            self._commit(index.canonical_holders(index.holders(all_blobs).drop("blob")), effective)
            return
        fresh = batch.join(gone, "blob", "left_anti")
        new = index.canonical_holders(index.holders(fresh).drop("blob"))
        self._commit(index.merge_new_wins(entries, new), known.unionByName(fresh.select("blob")).distinct())

    def refresh(self, blob_folder: str, checkpoint: str) -> None:
        """Takes in whatever has come since the last call."""
        stream = self.spark.readStream.schema(schemas.INDEX_BLOBS).parquet(blob_folder)
        every = self.spark.read.schema(schemas.INDEX_BLOBS).parquet(blob_folder)
        q = stream.writeStream.foreachBatch(lambda batch, _: self.merge(batch, every)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        self.merge(every.where(F.lit(False)), every)  # without new files no batch runs, but known ones may have gone
