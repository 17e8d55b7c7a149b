"""Sources, sinks and governance on literal inputs."""

import hashlib
import json
import sqlite3

from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadline.operators import artifacts as art
from threadline.operators import governance as gov
from threadline.sources import contracts, files, keyed, ledgers, relational
from threadline.sources.sqlite_files import harvested, sqlite_harvest


def test_sqlite_harvest(spark, tmp_path):
    for name, rows in (("a.db", [(1, "x"), (2, "y")]), ("b.db", None)):
        link = sqlite3.connect(tmp_path / name)
        if rows:
            link.execute("create table accounts (account_id integer, name text)")
            link.executemany("insert into accounts values (?, ?)", rows)
        link.commit()
        link.close()
    (tmp_path / "c.db").write_bytes(b"not a database at all" * 10)
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.db", "b.db", "c.db", "missing.db")], "path string")
    schema = T.StructType([T.StructField("account_id", T.LongType()), T.StructField("name", T.StringType())])
    good, bad = harvested(sqlite_harvest(spark, paths, "accounts", schema, batch=1))
    assert sorted((r.account_id, r.name) for r in good.collect()) == [(1, "x"), (2, "y")]
    assert bad.count() == 2


def test_contract_files(spark, tmp_path):
    done = {"contract_version": "1.0.0", "provenance_envelope": {"case_id": "C", "evidence_id": "E", "processing_job_id": "J"}, "observed_artifacts": [{"artifact_id": "A", "artifact_name": "n.pdf"}], "extracted_entities": [{"entity_type": "PHONE_NUMBER", "observed_value": "9"}]}
    plain = {"contract_version": "1", "case_id": "C2", "evidence_id": "E2"}
    for number, body in enumerate((done, plain)):
        (tmp_path / f"{number}.json").write_text(json.dumps(body, indent=1))
    artifacts, entities = contracts.contract_scan(spark, str(tmp_path))
    assert [(r.case_id, r.artifact_id) for r in artifacts.collect()] == [("C", "A")]
    assert [(r.case_id, r.observed_value) for r in entities.collect()] == [("C", "9")]


def test_sheets(spark, tmp_path):
    (tmp_path / "calls.csv").write_text("Caller_Number,B_Number\n98 76-5,12\n,13\n")
    sheet = ledgers.read_sheet(spark, str(tmp_path / "calls.csv"))
    edges = ledgers.cdr_load(sheet, F.lit("C"), F.lit("E"))
    assert [(r.src_name, r.tgt_name, r.confidence) for r in edges.collect()] == [("98765", "12", 0.95)]
    assert ledgers.edge_nodes(edges).count() == 2
    money = spark.createDataFrame([("a", "b"), ("c", "c"), ("", "d")], "from_account string, to_account string")
    assert ledgers.ledger_load(money, F.lit("C"), F.lit("E")).count() == 1


def test_truth_graph(spark):
    entities = spark.createDataFrame([("C", "P1", "Ann", "Person"), ("C", "ORG1", "Acme", "Company")], "case_id string, entity_id string, canonical_name string, entity_type string")
    relations = spark.createDataFrame(
        [("C", "R1", "P1", "ORG1", "director_of", "0.8", "E"), ("C", "R2", "P1", "999", "USES_PHONE", "", "E"), ("C", "R3", "P9", "P1", "KNOWS", None, "E")],
        "case_id string, relationship_id string, source_entity string, target_entity string, relationship_type string, expected_confidence string, evidence_id string",
    )
    nodes, edges = ledgers.truth_graph_load(entities, relations)
    assert {r.id: r.entity_type for r in nodes.collect()} == {"P1": "Person", "ORG1": "Organization", "999": "PhoneNumber", "P9": "Person"}
    assert {r.rel_id: (r.rel_label, r.confidence) for r in edges.collect()} == {"R1": ("MENTIONED_WITH", 0.8), "R2": ("USED_PHONE", 0.95), "R3": ("ASSOCIATED_WITH", 0.95)}


def test_relational_edges(spark):
    accounts = spark.createDataFrame([(1, 4, "a@x"), (2, 3, "  "), (3, 4, "b@x")], "account_id long, account_type_id int, account_unique_identifier string")
    assert [(r.account_id, r.account_type) for r in relational.accounts_scan(accounts).orderBy("account_id").collect()] == [(1, "EMAIL"), (3, "EMAIL")]
    calls = spark.createDataFrame([(1, 1, 3, 1, 10), (2, 1, 2, 1, 11), (3, 1, 3, 2, 12)], "relationship_id long, account1_id long, account2_id long, relationship_type int, date_time long")
    assert relational.account_comm_scan(calls, accounts).count() == 1
    assert relational.account_comm_scan(calls, accounts, limit=1).count() == 1


def test_files(spark, tmp_path):
    for name, body in (("one.txt", b"abc"), ("two.txt", b"defg")):
        (tmp_path / name).write_bytes(body)
    manifest = files.hash_manifest(files.read_files(spark, str(tmp_path)))
    digests = [hashlib.sha256(body).hexdigest() for body in (b"abc", b"defg")]
    assert [r.sha256 for r in manifest.orderBy("path").collect()] == digests
    master = files.master_digest(manifest.withColumn("owner", F.lit("o")), "owner").first()
    assert master.master_digest == hashlib.sha256("".join(digests).encode()).hexdigest()
    sets = spark.createDataFrame([("d", "a", f"a.E{n:02d}") for n in (1, 2, 4)] + [("d", "b", "b.raw")], "directory string, stem string, name string")
    assert [(r.name, r.previous, r.segment) for r in files.segment_gap_check(sets).collect()] == [("a.E04", 2, 4)]


def test_classifier(spark):
    rows = [
        ("partition.hdr", "PARTITION_TABLE", "PARTITION_TABLE", "HEX"), ("suspect_chats.db", "DATABASE", "DATABASE", "DATABASE"),
        ("deleted_photo.jpg", "IMAGE", "IMAGE", "IMAGE"), ("report.pdf", "DOCUMENT", "DOCUMENT", "PDF"), ("call_log.csv", "CDR", "CDR", "SPREADSHEET"),
        (".hidden", "OTHER", "OTHER", "HEX"), ("archive.tar.docx", "OTHER", "DOCUMENT", "TEXT"),
    ]
    table = spark.createDataFrame(rows, "name string, kind string, category string, viewer string")
    for row in table.withColumn("c", art.artifact_classify(F.col("name"), F.col("kind"))).collect():
        assert (row.c.category, row.c.viewer) == (row.category, row.viewer), row.name


def test_upsert_and_guard(spark):
    old = spark.createDataFrame([("A", "C", 1), ("B", "C", 1)], "artifact_id string, case_id string, version int")
    new = spark.createDataFrame([("A", "C", 2), ("B", "D", 2), ("E", "D", 2)], "artifact_id string, case_id string, version int")
    checked = keyed.cross_case_guard(old, new, "artifact_id")
    accepted = checked.filter("accepted").drop("accepted")
    merged = keyed.keyed_upsert(old, accepted, ["artifact_id"], "version")
    assert sorted(map(tuple, merged.collect())) == [("A", "C", 2), ("B", "C", 1), ("E", "D", 2)]
    again = keyed.keyed_upsert(merged, accepted, ["artifact_id"], "version")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, merged.collect()))


def test_audit_chain(spark):
    events = spark.createDataFrame([("x", i, f'{{"n":{i}}}') for i in range(3)], "chain string, seq long, payload string")
    log = gov.audit_append(events, "chain", "seq").orderBy("seq")
    rows = log.collect()
    last = "0" * 64
    for row in rows:
        assert row.previous_event_hash == last
        last = hashlib.sha256(f"{last}:{row.payload}".encode()).hexdigest()
        assert row.event_hash == last
    assert gov.audit_verify(log, "chain", "seq").first().is_valid
    edited = log.withColumn("payload", F.when(F.col("seq") == 1, F.lit("{}")).otherwise(F.col("payload")))
    verdict = gov.audit_verify(edited, "chain", "seq").first()
    assert (verdict.is_valid, verdict.wrong_hashes, verdict.broken_links) == (False, 1, 0)
    missing = gov.audit_verify(log.filter("seq <> 1"), "chain", "seq").first()
    assert (missing.is_valid, missing.broken_links) == (False, 1)
    heads = log.filter("seq = 2").select("chain", F.col("event_hash").alias("head"))
    more = spark.createDataFrame([("x", 3, "{}")], "chain string, seq long, payload string")
    grown = log.unionByName(gov.audit_append(more, "chain", "seq", heads))
    assert gov.audit_verify(grown, "chain", "seq").first().is_valid


def test_triage_budget(spark):
    rows = [("J", i, 0, i, i != 0, 10 if i != 1 else 999, i != 2, i != 3) for i in range(8)]
    table = spark.createDataFrame(rows, "job_id string, artifact_id long, priority int, position long, on_disk boolean, size long, supported boolean, parses boolean")
    got = [r.outcome for r in art.parse_triage(table, budget=2, size_limit=100).orderBy("position").collect()]
    assert got == ["FILE_NOT_ON_DISK", "EXCEEDS_SIZE_LIMIT", "UNSUPPORTED_FORMAT", "PARSER_ERROR", "PROCESSED", "PROCESSED", "BUDGET_EXCEEDED", "BUDGET_EXCEEDED"]
