"""Forensic relational tables: accounts, communications, attribute pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Artifact type ids and the attributes read for each, with their value column.
MESSAGE, EXIF, WEB = 13, 16, 4
MESSAGE_FIELDS = {
    "email_from": ("TSK_EMAIL_FROM", "value_text"),
    "email_to": ("TSK_EMAIL_TO", "value_text"),
    "email_cc": ("TSK_EMAIL_CC", "value_text"),
    "subject": ("TSK_SUBJECT", "value_text"),
    "datetime_sent": ("TSK_DATETIME_SENT", "value_int64"),
    "datetime_rcvd": ("TSK_DATETIME_RCVD", "value_int64"),
    "msg_id": ("TSK_MSG_ID", "value_text"),
}
GPS_FIELDS = {
    "latitude": ("TSK_GEO_LATITUDE", "value_double"),
    "longitude": ("TSK_GEO_LONGITUDE", "value_double"),
    "datetime_created": ("TSK_DATETIME_CREATED", "value_int64"),
    "device_make": ("TSK_DEVICE_MAKE", "value_text"),
    "device_model": ("TSK_DEVICE_MODEL", "value_text"),
}
WEB_FIELDS = {
    "url": ("TSK_URL", "value_text"),
    "domain": ("TSK_DOMAIN", "value_text"),
    "title": ("TSK_TITLE", "value_text"),
    "datetime_accessed": ("TSK_DATETIME_ACCESSED", "value_int64"),
    "program_name": ("TSK_PROG_NAME", "value_text"),
    "user_name": ("TSK_USER_NAME", "value_text"),
}


def _filled(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit("")))


def accounts_scan(accounts: DataFrame) -> DataFrame:
    """Accounts with an identifier; type 4 is e-mail."""
    kind = F.col("account_type_id")
    return accounts.filter(_filled("account_unique_identifier") != "").select(
        "account_id", "account_type_id",
        F.when(kind == 4, "EMAIL").otherwise(F.concat(F.lit("TYPE_"), kind.cast("string"))).alias("account_type"),
        _filled("account_unique_identifier").alias("account_unique_identifier"),
        F.col("account_id").cast("string").alias("row_id"),
    )


def account_comm_scan(relationships: DataFrame, accounts: DataFrame, limit: int | None = None) -> DataFrame:
    """Communications between two accounts that both have an identifier.

    ``limit`` keeps the first relationships by id, before blank endpoints go.
    """
    name = accounts.select("account_id", _filled("account_unique_identifier").alias("name"))
    calls = relationships.filter(F.col("relationship_type") == 1)
    sender = name.select(F.col("account_id").alias("account1_id"), F.col("name").alias("from_account"))
    receiver = name.select(F.col("account_id").alias("account2_id"), F.col("name").alias("to_account"))
    joined = calls.join(sender, "account1_id").join(receiver, "account2_id")
    if limit is not None:
        joined = joined.orderBy("relationship_id").limit(limit)
    return joined.filter("from_account <> '' and to_account <> ''").select(
        "relationship_id", "account1_id", "account2_id", "date_time", "from_account", "to_account"
    )


def attribute_pivot(
    artifacts: DataFrame, attributes: DataFrame, types: DataFrame, type_id: int, fields: dict[str, tuple[str, str]]
) -> DataFrame:
    """One row per artifact of the type, one column per attribute.

    The attribute list is fixed, so a conditional maximum does it in one aggregation
    that combines on the map side.
    """
    own = artifacts.filter(F.col("artifact_type_id") == type_id).select("artifact_id", "obj_id")
    rows = own.join(attributes, "artifact_id").join(types, "attribute_type_id")
    columns = [
        F.max(F.when(F.col("type_name") == attribute, F.col(source))).alias(name)
        for name, (attribute, source) in fields.items()
    ]
    pivoted = rows.groupBy("artifact_id", "obj_id").agg(*columns)
    texts = [name for name, (_, source) in fields.items() if source == "value_text"]
    return pivoted.select(
        "artifact_id", "obj_id",
        *[_filled(name).alias(name) if name in texts else F.col(name) for name in fields],
    )


def eav_email_pivot(artifacts: DataFrame, attributes: DataFrame, types: DataFrame) -> DataFrame:
    """Messages with a sender or a recipient."""
    pivoted = attribute_pivot(artifacts, attributes, types, MESSAGE, MESSAGE_FIELDS)
    return pivoted.filter("email_from <> '' or email_to <> ''")


def eav_gps_pivot(artifacts: DataFrame, attributes: DataFrame, types: DataFrame) -> DataFrame:
    """Positions with both coordinates."""
    pivoted = attribute_pivot(artifacts, attributes, types, EXIF, GPS_FIELDS)
    return pivoted.filter("latitude is not null and longitude is not null")


def eav_web_pivot(artifacts: DataFrame, attributes: DataFrame, types: DataFrame, type_id: int = WEB) -> DataFrame:
    """Web rows; the type id picks history, cookies or downloads."""
    return attribute_pivot(artifacts, attributes, types, type_id, WEB_FIELDS)


def extraction_summary(observations: DataFrame) -> DataFrame:
    """Observation counts per type and in total."""
    counts = observations.rollup("observation_type").agg(
        F.grouping("observation_type").alias("_all"), F.count(F.lit(1)).alias("count")
    )
    kind = F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col("observation_type"))
    return counts.select(kind.alias("observation_type"), "count")


def to_observations(
    rows: DataFrame, observation_type: str, code: str, id_column: str, table: str, scope: dict[str, Column]
) -> DataFrame:
    """Relational rows as observations with their values as JSON."""
    ident = F.col(id_column).cast("string")
    body = F.struct(ident.alias("row_id"), *rows.columns)
    return rows.select(
        *[column.alias(name) for name, column in scope.items()],
        F.concat(scope["artifact_id"], F.lit(f"-OBS-{code}-"), ident).alias("observation_id"),
        F.lit(observation_type).alias("observation_type"),
        F.concat(F.lit(f"{table}: "), ident).alias("location_reference"),
        F.concat(F.lit(f"{code.lower()}_"), ident).alias("key"),
        F.to_json(body).alias("value"),
        F.lit(1.0).alias("confidence"),
        F.concat(F.lit(f"{table}.id="), ident).alias("provenance_note"),
    )


def table_profile(df: DataFrame) -> DataFrame:
    """Name, type and nullability of every column, with the exact row count."""
    described = [
        F.struct(
            F.lit(field.name).alias("column_name"),
            F.lit(field.dataType.simpleString()).alias("column_type"),
            F.lit(field.nullable).alias("nullable"),
        )
        for field in df.schema.fields
    ]
    counted = df.agg(F.count(F.lit(1)).alias("row_count"))
    return counted.select(F.explode(F.array(*described)).alias("c"), "row_count").select(
        "c.column_name", "c.column_type", "c.nullable", "row_count", F.lit(False).alias("is_estimate")
    )


def sample_rows(df: DataFrame, rows: int = 10) -> DataFrame:
    """A few rows, with binary cells replaced by their length."""
    shown = [
        F.concat(F.lit("<BLOB "), F.octet_length(field.name).cast("string"), F.lit(" bytes>")).alias(field.name)
        if field.dataType.typeName() == "binary"
        else F.col(field.name)
        for field in df.schema.fields
    ]
    return df.limit(rows).select(*shown)
