"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "threadline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; the cluster's own values win elsewhere."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a private one only for a local master with none set."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="threadline-checkpoint-")
    spark.sparkContext.setCheckpointDir(shared)
    return shared


def _state_root(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/threadline/{spark.sparkContext.applicationId}"


def _located(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any store Spark reaches; nothing happens if there is none."""
    store, target = _located(spark, path)
    store.delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    store, target = _located(spark, path)
    return store.exists(target)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` below the checkpoint folder and read it back.

    The written copy survives lost executors, the plan of the result is a plain
    column-pruned scan with true sizes, and iterative operators keep plans of
    constant size.  ``discard`` deletes a copy that nothing reads any more,
    ``clear_states`` all copies of the application once its results are consumed.
    """
    spark = df.sparkSession
    path = f"{_state_root(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.state_path = path
    return written


def bucketed(df: DataFrame, *keys: str, dealt: int | None = None) -> DataFrame:
    """A written copy of ``df`` in buckets of ``keys``: joins and aggregations on them read it without a shuffle.

    ``dealt``: the number of partitions into which ``df`` was dealt by ``keys`` already; they
    become the buckets.  ``discard`` drops the copy like others.
    """
    spark = df.sparkSession
    name = f"threadline_{uuid.uuid4().hex}"
    buckets = dealt or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{_state_root(spark)}/{name}"
    writer = (df if dealt else df.repartition(buckets, *keys)).write.format("parquet").bucketBy(buckets, *keys)
    (writer if dealt else writer.sortBy(*keys)).option("path", path).saveAsTable(name)
    written = spark.table(name)
    written.state_path, written.state_table = path, name
    return written


class Pile:
    """Rows gathered round by round in one folder and read back as one table.

    However many rounds a loop takes, the plan of the result is a single scan.
    """

    def __init__(self, like: DataFrame) -> None:
        self.spark, self.schema = like.sparkSession, like.schema
        self.path = f"{_state_root(self.spark)}/{uuid.uuid4().hex}"
        like.limit(0).write.parquet(self.path)

    def add(self, rows: DataFrame) -> None:
        rows.select(*self.schema.names).write.mode("append").parquet(self.path)

    def add_part(self, rows: DataFrame) -> DataFrame:
        """Add rows, written once, and read back just these."""
        part = f"{self.path}/part-{uuid.uuid4().hex}"
        rows.select(*self.schema.names).write.parquet(part)
        return self.spark.read.schema(self.schema).parquet(part)

    def rows(self) -> DataFrame:
        gathered = self.spark.read.option("recursiveFileLookup", "true").schema(self.schema).parquet(self.path)
        gathered.state_path = self.path
        return gathered


def discard(*states: DataFrame) -> None:
    """Delete the written copies of states that were replaced; others are left alone."""
    for state in states:
        path = getattr(state, "state_path", None)
        if getattr(state, "state_table", None):
            state.sparkSession.sql(f"DROP TABLE IF EXISTS {state.state_table}")
        if path:
            delete_path(state.sparkSession, path)


def clear_states(spark: SparkSession) -> None:
    """Delete every written copy of this application; results that still read one must be consumed before."""
    delete_path(spark, _state_root(spark))
