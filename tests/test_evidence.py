"""Extraction, relationships and the whole path on literal observations."""

import json

import pytest
from pyspark.sql import functions as F

from threadline.operators import relations
from threadline.operators.ingest import build_case_graph
from threadline.operators.signals import extract_signals, sig_meta_author, _extractors, register_extractor
from threadline.schemas import OBSERVATION


def obs(number, kind, value, key="k", case="C"):
    text = value if isinstance(value, str) else json.dumps(value)
    return (case, "EV", "ART", "J", f"O{number}", kind, "loc", key, text, 1.0, "n")


@pytest.fixture(scope="module")
def card(spark):
    body = "Name: Mr. Vikram Singh\nPhone: +91-9876543210\nContact: raj kumar, raj@x.com\n\nIFSC HDFC0001234 A/C No: 123456789012 Tel 9876500000"
    return spark.createDataFrame([obs(1, "DOCUMENT_TEXT", body)], OBSERVATION)


def test_text_signals(card):
    got = {(r.entity_type, r.normalized_value): r for r in extract_signals(card).collect()}
    assert ("Person", "Vikram Singh") in got and ("Person", "Raj Kumar") in got
    assert ("PhoneNumber", "+919876543210") in got and ("Email", "raj@x.com") in got
    assert ("BankAccount", "HDFC0001234") in got and ("BankAccount", "123456789012") in got
    assert all(r.confidence >= 0.9 and r.provenance_trace == "ART:O1#loc" for r in got.values())
    assert all(r.signal_id.endswith(r.signal_key[:8].upper()) for r in got.values())


def test_proximity_stops_at_blank_line(card):
    found = relations.rel_text_proximity(extract_signals(card)).count()
    # Both people reach the phone of the first paragraph, none the one after the blank line.
    assert found == 2


def test_no_cooccurrence(spark):
    rows = spark.createDataFrame([obs(1, "DOCUMENT_TEXT", "Name: Ann Lee\nSuspect: Bob Ray\n")], OBSERVATION)
    signals = extract_signals(rows)
    assert signals.count() == 2
    assert relations.extract_relationships(signals).count() == 0


def test_rows_bind_only_their_own_row(spark):
    rows = [{"id": i, "name": f"person {chr(97 + i)}x", "phone": f"98765432{i:02d}", "city": "pune", "score": 1.5, "flag": False} for i in range(12)]
    table = spark.createDataFrame([obs(1, "SQLITE_SAMPLE_ROWS", {"rows": rows})], OBSERVATION)
    signals = extract_signals(table)
    assert signals.count() == 36
    phones = relations.rel_row_phone(signals)
    assert phones.count() == 12
    assert relations.rel_row_location(signals).count() == 12
    assert {r.source_location for r in phones.collect()} == {f"loc, Row {i + 1}" for i in range(12)}


def test_called_prefers_the_sender_column(spark):
    rows = [{"receiver_phone": "9000000001", "sender_phone": "9000000002"}, {"phone": "9000000003"}, {"phone": "9000000004", "mobile": "9000000005"}]
    signals = extract_signals(spark.createDataFrame([obs(1, "SQLITE_SAMPLE_ROWS", {"rows": rows})], OBSERVATION))
    value = {r.signal_id: r.normalized_value[-1] for r in signals.collect()}
    got = {(value[r.source_signal_id], value[r.target_signal_id]) for r in relations.rel_row_called(signals).collect()}
    assert got == {("2", "1"), ("4", "5")}


def test_headers(spark):
    mail = {"email_from": '"Doe, John" <jd@x.com>', "email_to": "Ann Lee <al@x.com>; bob@y.org, Q R <q@z.net>, 123 <n@z.net>", "row_id": "7"}
    signals = extract_signals(spark.createDataFrame([obs(1, "FORENSIC_EMAIL_MESSAGE", mail)], OBSERVATION))
    people = {r.normalized_value for r in signals.filter("entity_type = 'Person'").collect()}
    assert people == {"Doe John", "Ann Lee", "Q R"}
    assert signals.filter("entity_type = 'Email'").count() == 5
    assert relations.rel_header_used_email(signals).count() == 3
    assert relations.rel_header_used_email(signals, strict=False).count() == 1 + 2 * 4
    assert relations.rel_message_comm(signals).count() == 4
    assert relations.rel_message_person_comm(signals).count() == 2


def test_system_users_and_blank_accounts(spark):
    rows = [
        obs(1, "FORENSIC_WEB_HISTORY", {"user_name": "Local Service"}), obs(2, "FORENSIC_WEB_HISTORY", {"user_name": "jean doe"}),
        obs(3, "FORENSIC_ACCOUNT", {"account_type": "EMAIL", "account_unique_identifier": "  "}), obs(4, "FORENSIC_ACCOUNT", {"account_type": "TYPE_2", "account_unique_identifier": "a@b.com"}),
        obs(5, "FORENSIC_EXIF_GPS", {"latitude": 1.0}), obs(6, "IMAGE_GPS", {"latitude": 28.613939, "longitude": 77.2}),
    ]
    got = {(r.entity_type, r.normalized_value) for r in extract_signals(spark.createDataFrame(rows, OBSERVATION)).collect()}
    assert got == {("Person", "Jean Doe"), ("Location", "28.61394, 77.20000")}


def test_registered_rule_joins_the_extraction(spark):
    register_extractor("twice", sig_meta_author)
    try:
        rows = spark.createDataFrame([obs(1, "DOCUMENT_METADATA", "ann lee", key="author")], OBSERVATION)
        assert extract_signals(rows).count() == 2
    finally:
        del _extractors["twice"]


def test_ingest_is_repeatable_and_isolated(spark):
    mail = {"email_from": "Ann Lee <al@x.com>", "email_to": "Bob Ray <br@y.org>"}
    rows = spark.createDataFrame([obs(1, "FORENSIC_EMAIL_MESSAGE", mail), obs(1, "FORENSIC_EMAIL_MESSAGE", mail, case="D")], OBSERVATION)
    first, second = build_case_graph(rows), build_case_graph(rows)

    def tables(built):
        return sorted(map(str, built.nodes.collect())), sorted(map(str, built.edges.collect()))

    assert tables(first) == tables(second)
    assert first.edges.count() == 8 and first.nodes.count() == 8
    owner = first.nodes.select("id", F.col("case_id").alias("c"))
    crossing = first.edges.join(owner, F.col("src_id") == F.col("id")).filter("c <> case_id")
    assert crossing.count() == 0


def test_a_case_graph_writes_lean_signals_only(spark):
    """Mapping and relationships are not written; signals have all their columns, in buckets or not."""
    mail = {"email_from": "Ann Lee <al@x.com>", "email_to": "Bob Ray <br@y.org>; cy@z.org"}
    rows = spark.createDataFrame([obs(n, "FORENSIC_EMAIL_MESSAGE", mail) for n in (1, 2, 3, 3)], OBSERVATION)
    read = lambda df: sorted(map(repr, df.collect()))
    plain = extract_signals(rows)
    found = []
    for partitions in (None, 3):
        built = build_case_graph(rows, fuzzy_types=["Organization"], partitions=partitions)
        assert built.signals.columns == plain.columns and read(built.signals) == read(plain)
        assert not hasattr(built.mapping, "state_path") and not hasattr(built.relationships, "state_path")
        found.append([read(df) for df in (built.nodes, built.edges, built.relationships, built.mapping)])
    assert found[0] == found[1] and len(found[0][1]) == 5
