"""Call records, payment ledgers and ground-truth sheets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.functions import ids

# Header spellings of the two ends, lower case, in order of preference.
CALLER_HEADERS = ["caller_number", "a_number", "from_number", "caller"]
CALLEE_HEADERS = ["called_number", "b_number", "to_number", "receiver"]
PAYER_HEADERS = ["sender_account", "from_account", "debit_account", "account_no"]
PAYEE_HEADERS = ["receiver_account", "to_account", "credit_account", "beneficiary_account"]


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every value text."""
    return spark.read.option("header", True).csv(path)


def _first_filled(df: DataFrame, headers: list[str]) -> Column:
    by_name = {name.strip().lower(): name for name in df.columns}
    found = [F.nullif(F.col(f"`{by_name[name]}`"), F.lit("")) for name in headers if name in by_name]
    return F.trim(F.coalesce(*found, F.lit(""))) if found else F.lit("")


def _edges(rows: DataFrame, code: str, label: str, relation: str, confidence: float) -> DataFrame:
    return rows.select(
        "case_id",
        ids.loader_canonical_id(F.col("case_id"), code, F.col("a")).alias("src_id"),
        ids.loader_canonical_id(F.col("case_id"), code, F.col("b")).alias("tgt_id"),
        F.col("a").alias("src_name"),
        F.col("b").alias("tgt_name"),
        F.lit(label).alias("src_label"),
        F.lit(label).alias("tgt_label"),
        F.lit(relation).alias("rel_label"),
        "evidence_id",
        F.lit(confidence).alias("confidence"),
    )


def cdr_load(
    rows: DataFrame, case_id: Column, evidence_id: Column, more_callers: Sequence[str] = (), more_callees: Sequence[str] = ()
) -> DataFrame:
    """Call records to CALLED edges; spaces and dashes go, blank ends are dropped.

    ``more_callers`` and ``more_callees`` are further header spellings of a caller's own sheets.
    """
    ends = rows.select(
        case_id.alias("case_id"), evidence_id.alias("evidence_id"),
        F.regexp_replace(_first_filled(rows, [*CALLER_HEADERS, *more_callers]), "[ -]", "").alias("a"),
        F.regexp_replace(_first_filled(rows, [*CALLEE_HEADERS, *more_callees]), "[ -]", "").alias("b"),
    )
    return _edges(ends.filter("a <> '' and b <> ''"), "PHO", "PhoneNumber", "CALLED", 0.95)


def ledger_load(
    rows: DataFrame, case_id: Column, evidence_id: Column, more_payers: Sequence[str] = (), more_payees: Sequence[str] = ()
) -> DataFrame:
    """Payments to TRANSFERRED_TO edges; blank ends and self transfers are dropped.

    ``more_payers`` and ``more_payees`` are further header spellings of a caller's own sheets.
    """
    ends = rows.select(
        case_id.alias("case_id"), evidence_id.alias("evidence_id"),
        _first_filled(rows, [*PAYER_HEADERS, *more_payers]).alias("a"), _first_filled(rows, [*PAYEE_HEADERS, *more_payees]).alias("b"),
    )
    return _edges(ends.filter("a <> '' and b <> '' and a <> b"), "BAN", "BankAccount", "TRANSFERRED_TO", 0.90)


def edge_nodes(edges: DataFrame) -> DataFrame:
    """Nodes of loader edges with the number of mentions."""
    ends = F.explode(
        F.array(
            F.struct(F.col("src_id").alias("id"), F.col("src_label").alias("entity_type"), F.col("src_name").alias("canonical_name")),
            F.struct(F.col("tgt_id").alias("id"), F.col("tgt_label").alias("entity_type"), F.col("tgt_name").alias("canonical_name")),
        )
    ).alias("n")
    return edges.select("case_id", ends).groupBy("case_id", "n.id").agg(
        F.min("n.entity_type").alias("entity_type"), F.min("n.canonical_name").alias("canonical_name"),
        F.count(F.lit(1)).alias("observed_count"),
    )


def truth_entity_label(entity_type: Column) -> Column:
    kind = F.upper(F.trim(entity_type))
    return (
        F.when(kind.isin("ORGANIZATION", "COMPANY", "ORG"), "Organization")
        .when(kind.isin("PHONENUMBER", "PHONE"), "PhoneNumber")
        .when(kind.isin("EMAIL", "EMAILADDRESS"), "Email")
        .when(kind.isin("BANKACCOUNT", "ACCOUNT"), "BankAccount")
        .when(kind.isin("VEHICLE", "VEHICLEPLATE"), "Vehicle")
        .when(kind.isin("LOCATION", "ADDRESS"), "Location")
        .otherwise("Person")
    )


# Sheet relationship type to (stored relation, label of an unknown target).
TRUTH_RELATIONS = {
    "USED_PHONE": ("USED_PHONE", "PhoneNumber"),
    "USES_PHONE": ("USED_PHONE", "PhoneNumber"),
    "USED_VEHICLE": ("USED_VEHICLE", "Vehicle"),
    "OWNS_VEHICLE": ("USED_VEHICLE", "Vehicle"),
    "LOCATED_AT": ("LOCATED_AT", "Location"),
    "VISITED": ("LOCATED_AT", "Location"),
    "CAPTURED_AT": ("LOCATED_AT", "Location"),
    "TRANSFERRED_TO": ("TRANSFERRED_TO", "Person"),
    "FINANCIAL_TRANSFER": ("TRANSFERRED_TO", "Person"),
    "COMMUNICATED_WITH": ("COMMUNICATED_WITH", "Person"),
    "CALLS": ("COMMUNICATED_WITH", "Person"),
    "CALLED": ("COMMUNICATED_WITH", "Person"),
}
TRUTH_ORG_RELATIONS = ["ASSOCIATED_WITH_ORGANIZATION", "MENTIONED_WITH", "DIRECTOR_OF"]


def truth_graph_load(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entity and relationship sheets to nodes and edges; unknown ends become nodes.

    ``entities`` has (case_id, entity_id, canonical_name, entity_type); ``relations``
    has (case_id, relationship_id, source_entity, target_entity, relationship_type,
    expected_confidence, evidence_id).
    """
    known = entities.groupBy("case_id", F.trim("entity_id").alias("id")).agg(
        F.max(F.struct(truth_entity_label(F.col("entity_type")).alias("label"), F.trim("canonical_name").alias("name"))).alias("n")
    ).select("case_id", "id", F.col("n.label").alias("entity_type"), F.col("n.name").alias("canonical_name"))
    kind = F.upper(F.trim("relationship_type"))
    stored, guess = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (relation, label) in TRUTH_RELATIONS.items():
        stored = F.when(kind == name, F.lit(relation)).otherwise(stored)
        guess = F.when(kind == name, F.lit(label)).otherwise(guess)
    is_org = kind.isin(TRUTH_ORG_RELATIONS)
    org_guess = F.when(F.col("tgt_id").contains("ORG"), "Organization").otherwise("Person")
    rows = relations.select(
        "case_id", F.trim("relationship_id").alias("rel_id"), F.trim("source_entity").alias("src_id"),
        F.trim("target_entity").alias("tgt_id"), "relationship_type",
        F.coalesce(F.col("expected_confidence").try_cast("double"), F.lit(0.95)).alias("confidence"), "evidence_id",
    ).withColumn("guess", F.when(is_org, org_guess).otherwise(F.coalesce(guess, F.lit("Person"))))
    rows = rows.withColumn("stored", stored).withColumn("is_org", is_org)
    ends = F.explode(
        F.array(
            F.struct(F.col("src_id").alias("id"), F.lit("Person").alias("entity_type")),
            F.struct(F.col("tgt_id").alias("id"), F.col("guess").alias("entity_type")),
        )
    ).alias("n")
    missing = rows.select("case_id", ends).select("case_id", "n.*").join(known, ["case_id", "id"], "left_anti")
    missing = missing.groupBy("case_id", "id").agg(F.min("entity_type").alias("entity_type"))
    nodes = known.unionByName(missing.withColumn("canonical_name", F.col("id")))
    label = nodes.select("case_id", "id", "entity_type")
    source = label.select("case_id", F.col("id").alias("src_id"), F.col("entity_type").alias("src_label"))
    target = label.select("case_id", F.col("id").alias("tgt_id"), F.col("entity_type").alias("tgt_label"))
    joined = rows.join(source, ["case_id", "src_id"]).join(target, ["case_id", "tgt_id"])
    org_relation = F.when(F.col("tgt_label") == "Organization", "MENTIONED_WITH").otherwise("ASSOCIATED_WITH")
    relation = F.when(F.col("is_org"), org_relation).otherwise(F.coalesce("stored", F.lit("ASSOCIATED_WITH")))
    edges = joined.select(
        "case_id", "rel_id", "src_id", "tgt_id", "src_label", "tgt_label", relation.alias("rel_label"),
        "evidence_id", "confidence",
    )
    return nodes.withColumn("observed_count", F.lit(1).cast("long")), edges
