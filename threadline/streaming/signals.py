"""Streaming extraction and pair counts, with state that ends at the watermark.

Both forms run in two drains.  The first parts late rows from rows in time, exactly
(``LateSplit``); the second is stateful: its state holds what lies within ``delay`` of the
newest time, however long the stream runs.  Late rows wait in a side table until a rebuild
merges them.  Every drain continues from its checkpoint.  For states beyond the memory of
the executors set ``spark.sql.streaming.stateStore.providerClass`` to the RocksDB provider.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadline.operators.signals import extract_signals
from threadline.schemas import OBSERVATION
from threadline.session import delete_path, path_exists
from threadline.streaming.sinks import KeyedTable, LateSplit, batch_folder, drain

TIME = "observed_at"


def read_observation_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Observation parquet files with an ``observed_at`` time, as they arrive."""
    schema = T.StructType([*OBSERVATION.fields, T.StructField(TIME, T.TimestampType())])
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _signals(observations: DataFrame) -> DataFrame:
    return extract_signals(observations, keep=[TIME])


class SignalStream:
    """Distinct signals of observations as they arrive.

    A signal is dropped while one with its key is held in state, that is, within ``delay``
    seconds of it.  Repeats farther apart and late rows meet in ``rebuild``, which writes
    the table anew, each signal once with its earliest time.
    """

    def __init__(self, spark: SparkSession, root: str, delay: int = 86_400) -> None:
        self.spark, self.root, self.delay = spark, root, delay
        self.split = LateSplit(spark, root, TIME, delay)
        example = spark.createDataFrame([], T.StructType([*OBSERVATION.fields, T.StructField(TIME, T.TimestampType())]))
        self.schema = _signals(example).schema

    def drain(self, observations: DataFrame) -> None:
        """Take everything the stream of observations holds now."""
        self.split.drain(observations, _signals)
        timed = self.split.on_time(self.schema).withWatermark(TIME, f"{self.delay} seconds")
        once = timed.dropDuplicatesWithinWatermark(["signal_key"])
        drain(once, lambda batch, number: batch.write.mode("overwrite").parquet(batch_folder(f"{self.root}/accepted", number)), f"{self.root}/state-once")

    def _numbered(self, path: str) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def accepted(self) -> DataFrame:
        """What the stateful operator let through, with its batch number."""
        return self._numbered(f"{self.root}/accepted")

    def late(self) -> DataFrame:
        """The side table of late signals, with their batch number."""
        return self._numbered(self.split.late_path)

    def rebuild(self) -> DataFrame:
        """Merge the last table, the batches since and late rows into a new table, and return it.

        The table names the batches it holds, so that those are not merged again.
        """
        tables = f"{self.root}/tables"
        last = self._last_table(tables)
        table = self.spark.createDataFrame([], self.schema) if last is None else self.spark.read.schema(self.schema).parquet(f"{tables}/{last}/rows")
        parts, held = [table], []
        for kind, rows in (("accepted", self.accepted()), ("late", self.late())):
            if last is not None:
                known = self.spark.read.parquet(f"{tables}/{last}/batches").filter(F.col("kind") == kind).select("batch")
                rows = rows.join(known, "batch", "left_anti")
                held.append(known.select(F.lit(kind).alias("kind"), "batch"))
            parts.append(rows.drop("batch"))
            held.append(rows.select(F.lit(kind).alias("kind"), "batch").distinct())
        union = parts[0].unionByName(parts[1]).unionByName(parts[2])
        first = Window.partitionBy("signal_key").orderBy(F.asc_nulls_last(TIME), "signal_id")
        once = union.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
        number = 0 if last is None else int(last) + 1
        once.write.mode("overwrite").parquet(f"{tables}/{number}/rows")
        batches = held[0]
        for more in held[1:]:
            batches = batches.unionByName(more)
        # Written last: a table without its batches was not finished and is written again.
        batches.distinct().coalesce(1).write.mode("overwrite").parquet(f"{tables}/{number}/batches")
        if last is not None and int(last) > 0:
            delete_path(self.spark, f"{tables}/{int(last) - 1}")
        return self.spark.read.schema(self.schema).parquet(f"{tables}/{number}/rows")

    def _last_table(self, tables: str) -> str | None:
        number = 0
        while path_exists(self.spark, f"{tables}/{number + 1}/batches/_SUCCESS"):
            number += 1
        if path_exists(self.spark, f"{tables}/{number}/batches/_SUCCESS"):
            return str(number)
        return None


def edge_counts(edges: DataFrame, window: str = "1 day") -> DataFrame:
    """Edge counts per pair and time window of (case_id, src_id, tgt_id, observed_at), of a table or a stream."""
    counts = edges.groupBy(F.window(TIME, window), "case_id", "src_id", "tgt_id").agg(F.count(F.lit(1)).alias("interactions"))
    return counts.select("case_id", "src_id", "tgt_id", F.col("window.start").alias("window_start"), "interactions")


class EdgeCountStream:
    """Pair counts per time window of edges as they arrive, in a table by key.

    The windows in state are counted in update mode; a batch hands on the new counts of the
    pairs that it touched, and ``KeyedTable`` takes each batch once.  Late edges are counted
    by ``merge_late``, each batch of them once.  Both counts are kept apart, so that a
    window that is still open can be updated after late edges of it were merged.
    """

    KEYS = ("case_id", "src_id", "tgt_id", "window_start")
    EDGE = "case_id string, src_id string, tgt_id string, observed_at timestamp"
    ROW = "case_id string, src_id string, tgt_id string, window_start timestamp, counted long, version long, late long"

    def __init__(self, spark: SparkSession, root: str, window: str = "1 day", delay: int = 86_400) -> None:
        self.spark, self.root, self.window, self.delay = spark, root, window, delay
        self.split = LateSplit(spark, root, TIME, delay)
        self.table = KeyedTable(spark, f"{root}/table", T._parse_datatype_string(self.ROW))

    def take(self, counts: DataFrame, number: int) -> None:
        """Upsert the counts of one batch; a batch that was taken changes nothing."""
        rows = counts.select(*self.KEYS, F.col("interactions").alias("counted"), F.lit(number).cast("long").alias("version"), F.lit(0).cast("long").alias("late"))
        self.table.commit(f"counts-{number}", rows, self._slot(), self._merge)

    @staticmethod
    def _slot() -> Column:
        return F.date_format("window_start", "yyyy-MM")

    def _merge(self, existing: DataFrame, incoming: DataFrame) -> DataFrame:
        """The counts of the highest version, the sum of late ones: combined on the map side."""
        return existing.unionByName(incoming).groupBy(*self.KEYS).agg(
            F.max_by("counted", "version").alias("counted"), F.max("version").alias("version"), F.sum("late").alias("late")
        )

    def drain(self, edges: DataFrame) -> None:
        """Take everything the stream of edges holds now."""
        schema = T._parse_datatype_string(self.EDGE)
        self.split.drain(edges.select(*schema.names), lambda batch: batch)
        timed = self.split.on_time(schema).withWatermark(TIME, f"{self.delay} seconds")
        drain(edge_counts(timed, self.window), self.take, f"{self.root}/state-counts", "update")

    def merge_late(self) -> None:
        """Count the late edges of batches that were not counted yet, all of them in one rewrite of the table."""
        late = self.split.late(T._parse_datatype_string(self.EDGE)).filter(f"{TIME} is not null")
        numbers = sorted(row["batch"] for row in late.select("batch").distinct().collect())
        fresh = [number for number in numbers if not self.table.committed(f"late-{number}")]
        if fresh:
            counts = edge_counts(late.filter(F.col("batch").isin(fresh)), self.window)
            none = F.lit(None).cast("long")
            rows = counts.select(*self.KEYS, none.alias("counted"), none.alias("version"), F.col("interactions").alias("late"))
            names = [f"late-{number}" for number in fresh]
            self.table.commit(names[0], rows, self._slot(), self._merge, names[1:])

    def counts(self) -> DataFrame:
        """(case_id, src_id, tgt_id, window_start, interactions): one table, each key once."""
        total = F.coalesce("counted", F.lit(0)) + F.coalesce("late", F.lit(0))
        return self.table.rows().select(*self.KEYS, total.cast("long").alias("interactions"))
