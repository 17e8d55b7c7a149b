"""Deterministic identifiers: a short display id and the full digest used for joins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*parts: Column) -> Column:
    """Hex sha256 of the parts joined with a colon; null parts count as empty text."""
    texts = [F.coalesce(part.cast("string"), F.lit("")) for part in parts]
    return F.sha2(F.concat_ws(":", *texts), 256)


def short(hex_digest: Column, length: int) -> Column:
    return F.upper(F.substring(hex_digest, 1, length))


def type_code(entity_type: Column) -> Column:
    return F.upper(F.substring(entity_type, 1, 3))


def signal_id(entity_type: Column, signal_key: Column) -> Column:
    return F.concat(F.lit("SIG-"), type_code(entity_type), F.lit("-"), short(signal_key, 8))


def relationship_id(relationship_key: Column) -> Column:
    return F.concat(F.lit("REL-"), short(relationship_key, 8))


def canonical_key(case_id: Column, entity_type: Column, normalized: Column) -> Column:
    return digest(case_id, type_code(entity_type), normalized)


def canonical_id(entity_type: Column, key: Column) -> Column:
    return F.concat(F.lit("CAN-"), type_code(entity_type), F.lit("-"), short(key, 6))


def loader_canonical_id(case_id: Column, code: str, value: Column) -> Column:
    """Id used by the ledger loaders: same shape, over the trimmed lower-case value."""
    clean = F.lower(F.trim(value))
    return F.concat(F.lit(f"CAN-{code}-"), short(digest(case_id, F.lit(code), clean), 6))


def artifact_id(case_id: Column, evidence_id: Column, job_id: Column, name: Column, trace: Column) -> Column:
    """Id of an artifact that came without one."""
    safe_job = F.regexp_replace(job_id, "[^A-Za-z0-9_-]", "_")
    safe_case = F.replace(F.regexp_replace(case_id, "[^A-Za-z0-9_-]", "_"), F.lit("CASE_"), F.lit(""))
    tail = short(digest(case_id, evidence_id, job_id, name, trace), 12)
    return F.concat(F.lit("ART-"), safe_case, F.lit("-"), safe_job, F.lit("-"), tail)


def packed(key: Column) -> Column:
    """A text as bytes: a digest in half its length, any other text behind 33 zeros, so that no two texts share bytes."""
    return F.when(key.rlike("^[0-9a-f]{64}\\z"), F.unhex(key)).otherwise(F.concat(F.lit(bytes(33)), key.cast("binary")))


def unpacked(key: Column) -> Column:
    """The text that ``packed`` was given."""
    return F.when(F.length(key) == 32, F.lower(F.hex(key))).otherwise(F.substr(key, F.lit(34)).cast("string"))
