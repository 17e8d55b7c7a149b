"""Relationships between signals of one observation.

Every rule is an equi-join on the observation plus the finest shared key the rule
has (table row, header position, text stretch), so no rule pairs everything in an
observation and a huge observation spreads over many tasks.  Two people in one
text are never linked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadline.functions import ids
from threadline.operators.signals import SCOPE

NEAR = 120


def _build(
    pairs: DataFrame,
    source_label: str,
    target_label: str,
    relation: str,
    method: str,
    confidence: float,
    location: Column,
) -> DataFrame:
    """Rows with the signals' ``src_`` and ``tgt_`` columns to relationship rows."""
    key = ids.digest(F.col("case_id"), F.col("src_signal_id"), F.col("tgt_signal_id"), F.lit(relation))
    return pairs.withColumn("relationship_key", key).select(
        ids.relationship_id(F.col("relationship_key")).alias("rel_id"),
        "relationship_key",
        *SCOPE,
        F.col("src_signal_id").alias("source_signal_id"),
        F.col("tgt_signal_id").alias("target_signal_id"),
        F.col("src_signal_key").alias("source_signal_key"),
        F.col("tgt_signal_key").alias("target_signal_key"),
        F.lit(source_label).alias("source_label"),
        F.lit(target_label).alias("target_label"),
        F.lit(relation).alias("rel_label"),
        location.alias("source_location"),
        F.lit(method).alias("extraction_method"),
        F.lit(confidence).alias("confidence"),
        F.lit("UNDER_REVIEW").alias("human_verification_status"),
        F.lit(None).cast("string").alias("timestamp_observed"),
        F.col("src_normalized_value").alias("source_value"),
        F.col("tgt_normalized_value").alias("target_value"),
    )


FIELDS = ["signal_id", "signal_key", "source_location", "position", "next_blank", "observed_value", "normalized_value"]


def _side(signals: DataFrame, condition: Column, name: str, extra: list[str] | None = None) -> DataFrame:
    """One end's signals, each field a column of its own, so that a join carries only those that are read."""
    fields = [F.col(field).alias(f"{name}_{field}") for field in FIELDS]
    return signals.filter(condition).select(*SCOPE, *(extra or []), *fields)


def _paired(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of both sides with equal keys, merged in sorted order: a side's size shows only as it is extracted.

    Digests travel as bytes.
    """
    names = ["src_signal_key", "tgt_signal_key"]
    left, right = (side.withColumn(name, ids.packed(F.col(name))) for side, name in zip((left, right), names))
    return left.join(right.hint("merge"), keys).withColumns({name: ids.unpacked(F.col(name)) for name in names})


def _methods(*names: str) -> Column:
    return F.col("extraction_method").isin(*names)


def _in_row() -> Column:
    return F.col("row_index").isNotNull() & F.col("extraction_method").startswith("SQLITE_COLUMN:")


def _plain(location: Column) -> Column:
    """Drop the side suffix a signal's location carries."""
    return F.regexp_replace(location, ":(from|to)(_name)?$", "")


def rel_row_phone(signals: DataFrame) -> DataFrame:
    """Person and phone in the same row."""
    people = _side(signals, _in_row() & (F.col("entity_type") == "Person"), "src", ["row_index"])
    phones = _side(signals, _in_row() & (F.col("entity_type") == "PhoneNumber"), "tgt", ["row_index"])
    pairs = _paired(people, phones, [*SCOPE, "row_index"])
    return _build(
        pairs, "Person", "PhoneNumber", "USED_PHONE", "SQLITE_ROW_CONTACT_BINDING", 1.0,
        F.col("src_source_location"),
    )


def rel_row_location(signals: DataFrame) -> DataFrame:
    """Person and place in the same row."""
    people = _side(signals, _in_row() & (F.col("entity_type") == "Person"), "src", ["row_index"])
    places = _side(signals, _in_row() & (F.col("entity_type") == "Location"), "tgt", ["row_index"])
    pairs = _paired(people, places, [*SCOPE, "row_index"])
    return _build(
        pairs, "Person", "Location", "LOCATED_AT", "SQLITE_ROW_LOCATION_BINDING", 1.0,
        F.col("src_source_location"),
    )


def rel_row_called(signals: DataFrame) -> DataFrame:
    """Caller and callee of a row with two or more phones.

    The array per row is bounded by the number of phone columns in the dictionary.
    """
    phones = signals.filter(_in_row() & (F.col("entity_type") == "PhoneNumber"))
    method = F.lower("extraction_method")
    directed = method.contains("caller") | method.contains("sender")
    phone = F.struct(
        "position", "signal_id", "signal_key", "source_location", directed.alias("directed"), "normalized_value"
    )
    rows = phones.groupBy(*SCOPE, "row_index").agg(F.array_sort(F.collect_list(phone)).alias("phones"))
    rows = rows.filter(F.size("phones") >= 2)
    caller = F.coalesce(
        F.get(F.filter("phones", lambda item: item.getField("directed")), F.lit(0)), F.get("phones", F.lit(0))
    )
    rows = rows.withColumn("src", caller)
    callee = F.filter(
        F.col("phones"), lambda item: item.getField("position") != F.col("src").getField("position")
    )
    rows = rows.withColumn("tgt", F.get(callee, F.lit(0)))
    ends = [F.col(end).getField(field).alias(f"{end}_{field}") for end in ("src", "tgt") for field in ("signal_id", "signal_key", "source_location", "normalized_value")]
    pairs = rows.select(*SCOPE, *ends)
    return _build(
        pairs, "PhoneNumber", "PhoneNumber", "CALLED", "SQLITE_ROW_COMMUNICATION_LOG", 1.0,
        F.col("src_source_location"),
    )


def rel_text_proximity(signals: DataFrame) -> DataFrame:
    """Person and phone whose first mentions lie close together in the same paragraph.

    The text is cut into stretches as long as the allowed distance; a phone also
    joins from the stretch before and after its own, so the distance test is an
    equi-join and only close pairs ever meet.
    """
    people = _side(signals, _methods("STRUCTURED_NAME_PREFIX"), "src")
    phones = _side(signals, _methods("REGEX_PHONE_E164"), "tgt")
    people = people.withColumn("stretch", F.floor(F.col("src_position") / NEAR))
    own = F.floor(F.col("tgt_position") / NEAR)
    phones = phones.withColumn("stretch", F.explode(F.array(own - 1, own, own + 1)))
    low = F.least("src_position", "tgt_position")
    high = F.greatest("src_position", "tgt_position")
    blank = F.when(F.col("src_position") <= F.col("tgt_position"), F.col("src_next_blank")).otherwise(
        F.col("tgt_next_blank")
    )
    end = high + F.length("tgt_observed_value")
    pairs = _paired(people, phones, [*SCOPE, "stretch"]).filter(
        (F.col("src_position") >= 0)
        & (F.col("tgt_position") >= 0)
        & (high - low < NEAR)
        & ((blank < 0) | (blank + 2 > end))
    )
    return _build(
        pairs, "Person", "PhoneNumber", "USED_PHONE", "DOCUMENT_STRUCTURED_CONTACT_BLOCK", 0.90,
        F.col("src_source_location"),
    )


def rel_account_comm(signals: DataFrame) -> DataFrame:
    """Sender account to receiver account of one communication row."""
    senders = _side(signals, _methods("AUTOPSY_ACCOUNT_COMM_FROM"), "src")
    receivers = _side(signals, _methods("AUTOPSY_ACCOUNT_COMM_TO"), "tgt")
    return _build(
        _paired(senders, receivers, SCOPE), "Email", "Email", "COMMUNICATED_WITH",
        "AUTOPSY_ACCOUNT_RELATIONSHIP", 1.0, _plain(F.col("src_source_location")),
    )


def rel_header_used_email(signals: DataFrame, strict: bool = True) -> DataFrame:
    """Named mailbox owner to address.

    ``strict`` binds a name to the address it stands next to; otherwise every
    recipient name is bound to every recipient address of the message.
    """
    def tagged(suffix: str) -> DataFrame:
        tag = F.when(_methods(f"AUTOPSY_EMAIL_FROM{suffix}"), "FROM").when(_methods(f"AUTOPSY_EMAIL_TO{suffix}"), "TO")
        return signals.withColumn("tag", tag).withColumn("slot", F.col("position"))

    extra = ["tag", "slot"] if strict else ["tag"]
    people = _side(tagged("_NAME"), F.col("tag").isNotNull(), "src", extra)
    boxes = _side(tagged(""), F.col("tag").isNotNull(), "tgt", extra)
    pairs = _paired(people, boxes, [*SCOPE, *extra])
    return _build(
        pairs, "Person", "Email", "USED_EMAIL", "EMAIL_HEADER_NAME_BINDING", 1.0, F.col("tgt_source_location")
    )


def rel_message_comm(signals: DataFrame) -> DataFrame:
    """Sender address to each recipient address."""
    senders = _side(signals, _methods("AUTOPSY_EMAIL_FROM"), "src")
    receivers = _side(signals, _methods("AUTOPSY_EMAIL_TO"), "tgt")
    return _build(
        _paired(senders, receivers, SCOPE), "Email", "Email", "COMMUNICATED_WITH",
        "EMAIL_MESSAGE_COMMUNICATION", 1.0, _plain(F.col("src_source_location")),
    )


def rel_message_person_comm(signals: DataFrame) -> DataFrame:
    """Named sender to each named recipient."""
    senders = _side(signals, _methods("AUTOPSY_EMAIL_FROM_NAME"), "src")
    receivers = _side(signals, _methods("AUTOPSY_EMAIL_TO_NAME"), "tgt")
    return _build(
        _paired(senders, receivers, SCOPE), "Person", "Person", "COMMUNICATED_WITH",
        "EMAIL_MESSAGE_PERSON_COMMUNICATION", 0.95, _plain(F.col("src_source_location")),
    )


def extract_relationships(signals: DataFrame, strict_headers: bool = True) -> DataFrame:
    """All relationship rules over the signals."""
    parts = [
        rel_row_phone(signals),
        rel_row_location(signals),
        rel_row_called(signals),
        rel_text_proximity(signals),
        rel_account_comm(signals),
        rel_header_used_email(signals, strict_headers),
        rel_message_comm(signals),
        rel_message_person_comm(signals),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
