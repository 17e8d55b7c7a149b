"""Evidence contracts and stored observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ARTIFACT = (
    "struct<artifact_id:string,artifact_name:string,artifact_type:string,mime_type:string,size_bytes:bigint,"
    "sha256:string,allocation_status:string,recovery_status:string,is_deleted:boolean,is_recovered:boolean,"
    "is_carved:boolean,provenance_trace:string,content_path:string,extracted_file_path:string,"
    "created_at:string,modified_at:string,accessed_at:string>"
)
_ENTITY = (
    "struct<entity_id:string,entity_type:string,observed_value:string,value:string,confidence:double,"
    "source_offset:string,provenance_trace:string>"
)
_ENVELOPE = (
    "struct<case_id:string,evidence_id:string,processing_job_id:string,engine_name:string,"
    "engine_version:string,processed_at:string>"
)
# Both contract shapes in one schema; the envelope tells them apart.
CONTRACT = (
    f"contract_version string, case_id string, evidence_id string, processing_job_id string, "
    f"provenance_envelope {_ENVELOPE}, observed_artifacts array<{_ARTIFACT}>, extracted_entities array<{_ENTITY}>, "
    f"extracted_artifacts array<{_ARTIFACT}>, entities array<{_ENTITY}>"
)


def read_contracts(spark: SparkSession, path: str) -> DataFrame:
    """Contract JSON files, one object per file."""
    return spark.read.schema(CONTRACT).option("multiLine", True).json(path)


def parse_contracts(rows: DataFrame, column: str) -> DataFrame:
    """Contract JSON text in a column."""
    return rows.select(F.from_json(column, CONTRACT).alias("c")).select("c.*")


def _envelope() -> list[Column]:
    def field(name: str, plain: str | None = None) -> Column:
        inner = F.col(f"provenance_envelope.{name}")
        return F.coalesce(inner, F.col(plain)) if plain else inner

    return [
        field("case_id", "case_id").alias("case_id"),
        field("evidence_id", "evidence_id").alias("evidence_id"),
        field("processing_job_id", "processing_job_id").alias("job_id"),
        field("engine_name").alias("engine_name"),
        field("engine_version").alias("engine_version"),
    ]


def contract_artifacts(contracts: DataFrame) -> DataFrame:
    """One row per artifact with the envelope copied to it; missing arrays give none."""
    items = F.when(F.col("provenance_envelope").isNotNull(), F.col("observed_artifacts")).otherwise(F.col("extracted_artifacts"))
    return contracts.select(*_envelope(), F.explode(items).alias("a")).select(
        "case_id", "evidence_id", "job_id", "engine_name", "engine_version", "a.*"
    )


def contract_entities(contracts: DataFrame) -> DataFrame:
    """One row per raw entity with the envelope copied to it."""
    items = F.when(F.col("provenance_envelope").isNotNull(), F.col("extracted_entities")).otherwise(F.col("entities"))
    return contracts.select(*_envelope(), F.explode(items).alias("e")).select(
        "case_id", "evidence_id", "job_id", "e.entity_id", "e.entity_type",
        F.coalesce("e.observed_value", "e.value").alias("observed_value"),
        "e.confidence", "e.source_offset", "e.provenance_trace",
    )


def contract_scan(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    contracts = read_contracts(spark, path)
    return contract_artifacts(contracts), contract_entities(contracts)


def observation_scan(parsed: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Stored observation JSON to one row per observation.

    ``parsed`` has (artifact_id, case_id, structured_metadata, observations) as JSON
    text.  Evidence and job come from the metadata, else the artifact table, else the
    artifact id and ``JOB-UNKNOWN``.
    """
    shape = (
        "array<struct<observation_id:string,observation_type:string,location_reference:string,key:string,"
        "value:variant,confidence:double,provenance_note:string>>"
    )
    owner = artifacts.select(
        "artifact_id", F.col("evidence_id").alias("_ev"), F.col("processing_job_id").alias("_job")
    )
    rows = parsed.select(
        "case_id", "artifact_id",
        F.nullif(F.get_json_object("structured_metadata", "$.evidence_id"), F.lit("")).alias("_mev"),
        F.nullif(F.get_json_object("structured_metadata", "$.job_id"), F.lit("")).alias("_mjob"),
        F.explode(F.from_json("observations", shape)).alias("o"),
    ).join(owner, "artifact_id", "left")
    # Text stays plain text; objects are kept as JSON.
    value = F.when(
        F.schema_of_variant("o.value") == "STRING", F.try_variant_get("o.value", "$", "string")
    ).otherwise(F.to_json("o.value"))
    return rows.select(
        "case_id",
        F.coalesce("_mev", "_ev", "artifact_id").alias("evidence_id"),
        "artifact_id",
        F.coalesce("_mjob", "_job", F.lit("JOB-UNKNOWN")).alias("job_id"),
        "o.observation_id", "o.observation_type", "o.location_reference", "o.key",
        value.alias("value"), "o.confidence", "o.provenance_note",
    )


def observation_scope(
    parsed: DataFrame, artifacts: DataFrame, case_id: str, artifact_id: str | None = None, job_id: str | None = None
) -> DataFrame:
    """Parsed artifacts of one artifact, else of one job, else of the whole case."""
    inside = parsed.filter(F.col("case_id") == case_id)
    if artifact_id:
        return inside.filter(F.col("artifact_id") == artifact_id)
    if not job_id:
        return inside
    owner = artifacts.select("artifact_id", F.col("processing_job_id").alias("_job"))
    hit = (
        F.col("artifact_id").contains(job_id)
        | F.coalesce(F.get_json_object("structured_metadata", "$.job_id") == job_id, F.lit(False))
        | F.coalesce(F.col("_job") == job_id, F.lit(False))
    )
    return inside.join(owner, "artifact_id", "left").filter(hit).select(*parsed.columns)
