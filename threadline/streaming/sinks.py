"""What streams are drained into: an exact split of late rows, and a keyed table with a ledger."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadline.session import delete_path, path_exists


def drain(stream: DataFrame, write: Callable[[DataFrame, int], None], state: str, mode: str = "append") -> None:
    """Hand everything the stream holds now to ``write``, batch by batch; ``state`` remembers where it ended."""
    running = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    running.awaitTermination()


def batch_folder(root: str, number: int) -> str:
    return f"{root}/batch={number}"


class LateSplit:
    """Parts rows in time from late ones, exactly.

    The stateful operators of Spark drop rows that are later than the watermark without a
    trace.  Here each batch is parted first: a row is late if its time is not after the
    greatest time of the batches before, less ``delay`` seconds; rows without a time count
    as late.  A stateful operator behind this, with the same delay, sees the rows in time
    only in batches that end where batches end here, so its own watermark is never ahead
    and it drops nothing.

    ``root/times`` keeps one row a batch, ``root/on_time`` and ``root/late`` the rows, each
    under its batch number: a batch that runs again replaces itself.
    """

    def __init__(self, spark: SparkSession, root: str, time: str, delay: int) -> None:
        self.spark, self.root, self.time, self.delay = spark, root, time, delay
        self.on_time_path, self.late_path = f"{root}/on_time", f"{root}/late"

    def watermark(self, number: int) -> Column:
        """The watermark that batch ``number`` is held to; null for the first."""
        path = f"{self.root}/times"
        if not path_exists(self.spark, path):
            return F.lit(None).cast("timestamp")
        known = self.spark.read.schema("batch long, most timestamp").parquet(path).filter(F.col("batch") < number)
        most = known.agg(F.max("most").alias("m")).first()["m"]
        return F.lit(None).cast("timestamp") if most is None else F.lit(most) - F.make_dt_interval(secs=F.lit(self.delay).cast("decimal(18,6)"))

    def drain(self, stream: DataFrame, summarise: Callable[[DataFrame], DataFrame]) -> None:
        """Part what the stream holds now; ``summarise`` is narrow and keeps the time column."""

        def write(batch: DataFrame, number: int) -> None:
            limit = self.watermark(number)
            rows = summarise(batch).withColumn("_late", F.col(self.time).isNull() | F.coalesce(F.col(self.time) <= limit, F.lit(False)))
            rows = rows.persist()
            try:
                for path, kept in ((self.on_time_path, rows.filter("not _late")), (self.late_path, rows.filter("_late"))):
                    kept.drop("_late").write.mode("overwrite").parquet(batch_folder(path, number))
                # The greatest time of the rows as they arrived, also of those that gave nothing.
                batch.agg(F.max(self.time).alias("most")).write.mode("overwrite").parquet(batch_folder(f"{self.root}/times", number))
            finally:
                rows.unpersist()

        drain(stream, write, f"{self.root}/state-split")

    def on_time(self, schema: T.StructType) -> DataFrame:
        """The rows in time as a stream of their own.

        A batch is many files, so their number never ends a batch of this stream.
        """
        return self.spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(self.on_time_path)

    def late(self, schema: T.StructType) -> DataFrame:
        """The late rows of every batch."""
        return self.spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(self.late_path)


class KeyedTable:
    """A table by key that takes each batch exactly once and is read as one table.

    Rows lie in slots (coarse, such as a month).  A batch rewrites just the slots that it
    touches, into files of its own number, and is then entered in the ledger with the files
    that hold now for each slot: the entry is the commit.  A batch that is in the ledger is
    skipped; one that failed before its entry writes the same files again.  Files that two
    commits have replaced are deleted, so that readers of the last table are not disturbed.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType) -> None:
        self.spark, self.root, self.schema = spark, root, schema
        self.ledger_path = f"{root}/ledger"

    def _ledger(self) -> DataFrame | None:
        if not path_exists(self.spark, self.ledger_path):
            return None
        return self.spark.read.schema("entry string, at long, slot string, path string, batch string").parquet(self.ledger_path)

    def committed(self, entry: str) -> bool:
        """Whether ``entry`` has its own folder in the ledger, or stands in that of a commit of several."""
        if path_exists(self.spark, f"{batch_folder(self.ledger_path, entry)}/_SUCCESS"):
            return True
        ledger = self._ledger()
        return ledger is not None and not ledger.filter(F.col("entry") == entry).isEmpty()

    def paths(self) -> dict[str, str]:
        """Folder of the rows of each slot, as of the last commit."""
        ledger = self._ledger()
        if ledger is None:
            return {}
        # One row for each slot: coarse slots are few.
        rows = ledger.filter("path is not null").groupBy("slot").agg(F.max_by("path", "at").alias("path")).collect()
        return {row["slot"]: row["path"] for row in rows}

    def _read(self, paths: Sequence[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def rows(self) -> DataFrame:
        return self._read(sorted(self.paths().values()))

    def commit(self, entry: str, incoming: DataFrame, slot: Column, merge: Callable[[DataFrame, DataFrame], DataFrame], also: Sequence[str] = ()) -> None:
        """Take ``incoming`` under the name ``entry``, unless it was taken before; ``also`` names what else it holds."""
        if self.committed(entry):
            return
        now = self.paths()
        incoming = incoming.select(*self.schema.names).persist()
        try:
            touched = sorted(row["slot"] for row in incoming.select(slot.alias("slot")).distinct().collect())
            merged = merge(self._read([now[s] for s in touched if s in now]), incoming).select(*self.schema.names)
            folder = f"{self.root}/rows/{entry}"
            merged.withColumn("_slot", slot).repartition("_slot").write.mode("overwrite").partitionBy("_slot").parquet(folder)
        finally:
            incoming.unpersist()
        ledger = self._ledger()
        at = 0 if ledger is None else (ledger.agg(F.max("at").alias("at")).first()["at"] or 0) + 1
        entries = [(entry, at, s, f"{folder}/_slot={s}") for s in touched] or [(entry, at, None, None)]
        entries += [(name, at, None, None) for name in also]
        schema = "entry string, at long, slot string, path string"
        self.spark.createDataFrame(entries, schema).coalesce(1).write.mode("overwrite").parquet(batch_folder(self.ledger_path, entry))
        self._forget(touched)

    def _forget(self, touched: Sequence[str]) -> None:
        """Delete the files of the touched slots, but for the last two commits of each."""
        seen = self._ledger().filter(F.col("slot").isin(list(touched))).groupBy("slot")
        old = seen.agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("at", "path")))), 3, 2).alias("old")).collect()
        for row in old:
            for _, path in row["old"]:
                delete_path(self.spark, path)
