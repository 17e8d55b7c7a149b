"""Keyed tables without a transactional format: upsert, guard, delete, bulk write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyed_upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Insert or replace by key, highest ``version`` wins; of equal versions the incoming row.

    Incoming rows with one key and version carry no order; the one with the largest JSON
    text wins.  The maximum per key combines on the map side, so a key with very many
    versions is reduced before the shuffle.
    """
    rest = [name for name in existing.columns if name not in keys and name != version]
    rows = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    body = F.struct(version, *rest)
    order = F.struct(F.col(version), F.col("_new"), F.to_json(body))
    picked = rows.groupBy(*keys).agg(F.max_by(body, order).alias("r"))
    return picked.select(*keys, F.col(f"r.{version}"), *[f"r.{name}" for name in rest]).select(*existing.columns)


def cross_case_guard(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows with ``accepted`` false where another case owns the key."""
    owner = existing.groupBy(key).agg(F.min("case_id").alias("owner"))
    checked = incoming.join(owner, key, "left")
    accepted = F.col("owner").isNull() | (F.col("owner") == F.col("case_id"))
    return checked.select(*incoming.columns, accepted.alias("accepted"))


def delete_cascade(tables: dict[str, DataFrame], cases: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the given cases (case_id)."""
    gone = cases.select("case_id").distinct()
    return {name: table.join(gone, "case_id", "left_anti") for name, table in tables.items()}


def delete_by_job(artifacts: DataFrame, job_id: str) -> DataFrame:
    """Rows of other jobs and of none."""
    return artifacts.filter(~F.col("processing_job_id").eqNullSafe(job_id))


def bulk_graph_write(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One folder per node label and per relation, written in parallel."""
    nodes.write.mode("overwrite").partitionBy("entity_type").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("rel_label").parquet(f"{path}/edges")


def newest_first_list(df: DataFrame, owner: Column, time: str, *ties: str) -> DataFrame:
    """Rows of one owner, newest first."""
    return df.filter(owner).orderBy(F.desc(time), *ties)


def newest_per_owner(df: DataFrame, owner: str, time: str, tie: str, keep: int) -> DataFrame:
    """The ``keep`` newest rows of every owner, ranked; the bound is applied before the shuffle."""
    order = Window.partitionBy(owner).orderBy(F.desc(time), tie)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)
