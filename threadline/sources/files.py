"""Evidence files: manifests, registration, multi-part sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.functions.ordered import with_previous, with_row_number
from threadline.session import cut_lineage


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Every file below ``path`` with its bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def hash_manifest(files: DataFrame) -> DataFrame:
    """Path, size and digest of each file; hashing runs where the bytes are read."""
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def master_digest(manifest: DataFrame, owner: str) -> DataFrame:
    """Digest over the concatenated hex digests of each owner in path order.

    A digest of a sequence is sequential by definition.  The rows of an owner arrive
    sorted by Spark and are fed to the hash batch by batch; memory holds one batch.
    """
    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, count = None, None, 0
        for frame in frames:
            done = []
            for name, digest in zip(frame[owner], frame["sha256"], strict=True):
                if state is not None and name != current:
                    done.append((current, state.hexdigest(), count))
                    state = None
                if state is None:
                    current, state, count = name, hashlib.sha256(), 0
                state.update(digest.encode())
                count += 1
            if done:
                yield pd.DataFrame(done, columns=[owner, "master_digest", "files"])
        if state is not None:
            yield pd.DataFrame([(current, state.hexdigest(), count)], columns=[owner, "master_digest", "files"])

    ordered = manifest.select(owner, "path", "sha256").repartition(owner).sortWithinPartitions(owner, "path")
    return ordered.mapInPandas(fold, f"`{owner}` string, master_digest string, files bigint")


def tree_digest(manifest: DataFrame, owner: str, fan: int = 1024) -> DataFrame:
    """Digest of each owner as a tree over its digests in path order: ``fan`` neighbours make one node.

    Every node is a bounded group and all nodes of a level are hashed in parallel, so one
    large owner is spread over many tasks; a single remaining node is the digest.
    """
    nodes = with_row_number(manifest.select(owner, "path", "sha256"), [owner], ["path"], "place")
    nodes = cut_lineage(nodes.select(owner, (F.col("place") - 1).alias("place"), F.col("sha256").alias("digest")))
    files = nodes.groupBy(owner).agg(F.count(F.lit(1)).alias("files"))
    finished = None
    level = nodes
    while True:
        sizes = level.groupBy(owner).agg(F.count(F.lit(1)).alias("n"))
        counted = level.join(sizes, owner)
        ready = cut_lineage(counted.filter("n = 1").select(owner, F.col("digest").alias("tree_digest")))
        finished = ready if finished is None else finished.unionByName(ready)
        parent = F.floor(F.col("place") / fan)
        grouped = counted.filter("n > 1").groupBy(owner, parent.alias("place")).agg(F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("d"))
        level = cut_lineage(grouped.select(owner, "place", F.sha2(F.array_join("d.digest", ""), 256).alias("digest")))
        if level.isEmpty():
            return finished.join(files, owner)


def _digested(files: DataFrame, existing: DataFrame) -> DataFrame:
    stored = existing.select("case_id", "filename", F.lit(True).alias("stored")).distinct()
    narrow = files.select(
        "case_id", "evidence_id", "filename", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("size_bytes"),
        F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"),
    )
    return narrow.join(stored, ["case_id", "filename"], "left")


def evidence_register(files: DataFrame, existing: DataFrame) -> DataFrame:
    """New evidence rows: empty files and names already stored are refused.

    ``files`` has (case_id, evidence_id, filename, content).  Of several new files with
    one name the smallest evidence id is stored.  Contents are hashed where they are
    read; only digests are shuffled.
    """
    fresh = _digested(files, existing).filter("size_bytes > 0 AND stored IS NULL")
    row = F.struct("evidence_id", "size_bytes", "sha256", "md5")
    return fresh.groupBy("case_id", "filename").agg(F.min(row).alias("r")).select(
        "case_id", "r.evidence_id", "filename", "r.size_bytes", "r.sha256", "r.md5",
        F.lit("PRESERVED").alias("preservation_status"), F.lit("INTACT").alias("integrity_status"),
    )


def evidence_rejects(files: DataFrame, existing: DataFrame) -> DataFrame:
    """(case_id, evidence_id, filename, reason) of the files that ``evidence_register`` refuses."""
    rows = _digested(files, existing)
    usable = (F.col("size_bytes") > 0) & F.col("stored").isNull()
    first = rows.filter(usable).groupBy("case_id", "filename").agg(F.min("evidence_id").alias("first"))
    reason = (
        F.when(F.col("size_bytes") == 0, "EMPTY").when(F.col("stored"), "ALREADY_STORED")
        .when(F.col("evidence_id") != F.col("first"), "SAME_NAME_IN_BATCH")
    )
    judged = rows.join(first, ["case_id", "filename"], "left").withColumn("reason", reason)
    return judged.filter(F.col("reason").isNotNull()).select("case_id", "evidence_id", "filename", "reason")


def segment_number(name: Column) -> Column:
    """Number in an ``.E01`` style suffix, null for other names."""
    return F.nullif(F.regexp_extract(F.upper(name), r"\.E(\d{2,})$", 1), F.lit("")).cast("int")


def segment_gap_check(files: DataFrame) -> DataFrame:
    """Multi-part files whose number does not follow the part before it.

    ``files`` has (directory, stem, name).
    """
    parts = files.withColumn("segment", segment_number(F.col("name"))).filter(F.col("segment").isNotNull())
    follows = with_previous(parts, ["directory", "stem"], ["segment", "name"], {"previous": "segment"})
    return follows.filter(F.col("segment") != F.col("previous") + 1).select(
        "directory", "stem", "name", "previous", "segment"
    )


# Suffixes that start an image set, and those that belong to one.
PRIMARY_SUFFIXES = [".e01", ".raw", ".dd", ".img"]


def candidate_sets(files: DataFrame) -> DataFrame:
    """Image files grouped by folder and stem, with part count and total size.

    ``files`` has (directory, name, size).  Only sets with a primary file count.
    """
    low = F.lower("name")
    stem = F.regexp_extract("name", r"^(.*[^.])\.[^.]+$", 1)
    suffix = F.regexp_extract(low, r"[^.](\.[^.]+)$", 1)
    part = suffix.rlike(r"^\.(e|raw|dd|img)")
    rows = files.withColumn("stem", stem).withColumn("suffix", suffix).filter(part)
    sets = rows.groupBy("directory", "stem").agg(
        F.min(F.when(F.col("suffix").isin(PRIMARY_SUFFIXES), F.col("name"))).alias("primary_file"),
        F.count(F.lit(1)).alias("segment_count"),
        F.sum("size").alias("total_size_bytes"),
        F.min("name").alias("first_segment"),
        F.max("name").alias("last_segment"),
    )
    ident = F.concat(F.lit("cand_"), F.lower(F.regexp_replace("stem", "[^a-zA-Z0-9_]", "_")))
    kind = F.when(F.lower("primary_file").endswith(".e01"), "E01").otherwise("RAW")
    return sets.filter(F.col("primary_file").isNotNull()).select(
        ident.alias("candidate_id"), "directory", "stem", "primary_file", "segment_count", "total_size_bytes",
        "first_segment", "last_segment", kind.alias("format"),
    )
