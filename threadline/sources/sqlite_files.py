"""Rows out of many SQLite files, one file per task."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sqlite_harvest(
    spark: SparkSession, paths: DataFrame, table: str, schema: T.StructType, batch: int = 500
) -> DataFrame:
    """Rows of ``table`` from every file in ``paths`` (path); files without it give none.

    Files are opened read-only on the executors and read in batches, so memory holds
    one batch.  A file that cannot be read gives one row with its ``error`` set.
    """
    names = schema.fieldNames()
    out = T.StructType(
        [T.StructField("path", T.StringType()), T.StructField("error", T.StringType()), *schema.fields]
    )
    listing = ", ".join(f'"{name}"' for name in names)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                try:
                    link = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
                    try:
                        known = link.execute(
                            "select 1 from sqlite_master where type = 'table' and name = ?", (table,)
                        ).fetchone()
                        if not known:
                            continue
                        rows = link.execute(f'select {listing} from "{table}"')
                        while chunk := rows.fetchmany(batch):
                            part = pd.DataFrame(chunk, columns=names, dtype=object)
                            part.insert(0, "error", None)
                            part.insert(0, "path", path)
                            yield part
                    finally:
                        link.close()
                except sqlite3.Error as problem:
                    yield pd.DataFrame(
                        [[path, str(problem), *[None] * len(names)]], columns=["path", "error", *names], dtype=object
                    )

    # Round robin over many partitions: files differ in size, tasks pick up the slack.
    spread = paths.select("path").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInPandas(read, out)


def harvested(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and the reject table of unreadable files."""
    return rows.filter(F.col("error").isNull()).drop("error"), rows.filter(F.col("error").isNotNull()).select("path", "error")
