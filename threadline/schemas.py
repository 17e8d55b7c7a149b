"""Table schemas and fixed value lists."""

from __future__ import annotations

from pyspark.sql import types as T

# One row per parsed observation.  ``value`` is text for text observations and a
# JSON object for the structured ones.
OBSERVATION = T.StructType(
    [
        T.StructField("case_id", T.StringType()),
        T.StructField("evidence_id", T.StringType()),
        T.StructField("artifact_id", T.StringType()),
        T.StructField("job_id", T.StringType()),
        T.StructField("observation_id", T.StringType()),
        T.StructField("observation_type", T.StringType()),
        T.StructField("location_reference", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("provenance_note", T.StringType()),
    ]
)

# Node labels.
NODE_LABELS = ["Person", "PhoneNumber", "Email", "Vehicle", "Location", "Organization", "BankAccount"]

# Legal (relationship, source label, target label) triples, in reading order.
# USED_VEHICLE is stored but was not read; it is listed here so that it is.
EDGE_TRIPLES = [
    ("COMMUNICATED_WITH", "Email", "Email"),
    ("COMMUNICATED_WITH", "Person", "Person"),
    ("ASSOCIATED_WITH", "Person", "Person"),
    ("USED_PHONE", "Person", "PhoneNumber"),
    ("USED_EMAIL", "Person", "Email"),
    ("USED_VEHICLE", "Person", "Vehicle"),
    ("CALLED", "PhoneNumber", "PhoneNumber"),
    ("LOCATED_AT", "Person", "Location"),
    ("CAPTURED_AT", "Person", "Location"),
    ("VISITED", "Person", "Location"),
    ("TRANSFERRED_TO", "Person", "Person"),
    ("TRANSFERRED_TO", "BankAccount", "BankAccount"),
    ("MENTIONED_WITH", "Person", "Organization"),
]

# Human review states.
REVIEW_STATUSES = ["UNDER_REVIEW", "HUMAN_VERIFIED_LEAD", "REJECTED_ASSOCIATION"]

# Artifact enumerations.
ALLOCATION_STATUSES = ["ALLOCATED", "UNALLOCATED", "DELETED", "UNKNOWN"]
RECOVERY_STATUSES = ["NONE", "RECOVERED", "CARVED", "PARTIAL", "UNKNOWN"]
EXPLORER_BUCKETS = ["DOCUMENT", "IMAGE", "DATABASE", "SPREADSHEET", "EMAIL", "CDR", "LOG", "RECOVERED", "OTHER"]
