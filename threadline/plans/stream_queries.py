"""Streaming forms, drained over the driver tables and compared with the batch result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadline.plans.registry import Inputs, query
from threadline.plans.text_queries import _EMAIL_RE, _PHONE_RE, _matches
from threadline.session import ensure_checkpoint_dir
from threadline.streaming.signals import EdgeCountStream, SignalStream


def _root(t: Inputs) -> str:
    return f"{ensure_checkpoint_dir(t.spark)}/threadline/stream-{uuid.uuid4().hex}"


def _stream(t: Inputs, table: str, key: str) -> DataFrame:
    """The table as files of rows in no order of time; a micro-batch takes a quarter of them, each file is a task."""
    rows = t.table(table)
    path = f"{ensure_checkpoint_dir(t.spark)}/threadline/arrivals-{uuid.uuid4().hex}"
    files = max(1, int(t.spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    rows.repartition(4 * files, F.xxhash64(key)).write.parquet(path)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


@query("stream_signals", f"""SELECT DISTINCT observation_id, 'Email' AS entity_type, lower(raw) AS normalized_value FROM {_matches('doc_obs', _EMAIL_RE)} m
    UNION ALL SELECT DISTINCT observation_id, 'PhoneNumber', CASE WHEN length(d) = 10 THEN '+91' || d WHEN length(d) = 12 AND d LIKE '91%' THEN '+' || d WHEN length(d) = 11 AND d LIKE '0%' THEN '+91' || d[2:]
      WHEN raw LIKE '+%' THEN '+' || d ELSE d END FROM (SELECT *, regexp_replace(raw, '[^0-9]', '', 'g') AS d FROM {_matches('doc_obs', _PHONE_RE)} q) p
      WHERE length(d) + CASE WHEN length(d) < 10 AND raw LIKE '+%' THEN 1 ELSE 0 END >= 10""", "doc_obs")
def _(t: Inputs) -> DataFrame:
    """Documents as they arrive, to distinct signals."""
    documents = _stream(t, "documents", "doc_id")
    observations = documents.select(
        F.concat(F.lit("CASE-"), "source").alias("case_id"), F.concat(F.lit("EV-"), "source").alias("evidence_id"),
        F.concat(F.lit("ART-"), "doc_id").alias("artifact_id"), F.concat(F.lit("JOB-"), "lang").alias("job_id"),
        F.concat(F.lit("ART-"), "doc_id", F.lit("-OBS-TEXT")).alias("observation_id"), F.lit("DOCUMENT_TEXT").alias("observation_type"),
        F.lit("Page 1").alias("location_reference"), F.lit("page_1_text").alias("key"), F.col("text").alias("value"),
        F.lit(1.0).alias("confidence"), F.lit("page 1").alias("provenance_note"),
        F.timestamp_seconds(F.lit(1700000000) + F.col("doc_id")).alias("observed_at"),
    )
    stream = SignalStream(t.spark, _root(t), delay=600)
    stream.drain(observations)
    return stream.rebuild().filter("entity_type in ('Email', 'PhoneNumber')").select("observation_id", "entity_type", "normalized_value")


@query("stream_edge_counts", """SELECT 'CASE-' || l_linestatus AS case_id, 'P-' || l_partkey AS src_id, 'S-' || l_suppkey AS tgt_id,
      strftime(date_trunc('day', l_shipdate), '%Y-%m-%d') AS day, count(*) AS interactions FROM lineitem GROUP BY 1, 2, 3, 4""")
def _(t: Inputs) -> DataFrame:
    """Pair counts per day over the order lines as they arrive."""
    lines = _stream(t, "lineitem", "l_orderkey")
    edges = lines.select(
        F.concat(F.lit("CASE-"), "l_linestatus").alias("case_id"), F.concat(F.lit("P-"), "l_partkey").alias("src_id"),
        F.concat(F.lit("S-"), "l_suppkey").alias("tgt_id"), F.col("l_shipdate").cast("timestamp").alias("observed_at"),
    )
    stream = EdgeCountStream(t.spark, _root(t), "1 day", delay=200 * 86_400)
    stream.drain(edges)
    stream.merge_late()
    return stream.counts().select("case_id", "src_id", "tgt_id", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "interactions")
