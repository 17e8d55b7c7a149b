"""Relationship rules: pairs of repeated rows, and what a pair carries."""

from pyspark.sql import functions as F

from threadline.operators import relations as rel
from threadline.plans import catalog, text_queries
from threadline.operators.signals import extract_signals

MAIL = '{"row_id":"1","email_from":"\\"Ann, Lee\\" <A@x.example>","email_to":"Bo Day <b@x.example>; c@x.example"}'


def mails(spark, ids):
    row = spark.range(1).select(
        *[F.lit("1").alias(c) for c in ("case_id", "evidence_id", "artifact_id", "job_id")],
        F.explode(F.array(*[F.lit(i) for i in ids])).alias("observation_id"), F.lit("FORENSIC_EMAIL_MESSAGE").alias("observation_type"),
        F.lit("m").alias("location_reference"), F.lit(MAIL).alias("value"),
    )
    return extract_signals(row, ["sig_message_header"], partitions=3)


def found(rows):
    return sorted(tuple(r) for r in rows.select("observation_id", "source_value", "target_value").collect())


def test_pairs_carry_both_values(spark):
    signals = mails(spark, ["p", None])
    assert found(rel.rel_message_comm(signals)) == [("p", "a@x.example", "b@x.example"), ("p", "a@x.example", "c@x.example")]
    assert found(rel.rel_message_person_comm(signals)) == [("p", "Ann Lee", "Bo Day")]
    named = [("p", "Ann Lee", "a@x.example"), ("p", "Bo Day", "b@x.example")]
    assert found(rel.rel_header_used_email(signals)) == named
    assert found(rel.rel_header_used_email(signals, strict=False)) == [*named, ("p", "Bo Day", "c@x.example")]


def test_rows_that_come_twice_pair_with_each_other(spark):
    assert len(found(rel.rel_message_person_comm(mails(spark, ["p", "p"])))) == 4


def test_a_join_carries_no_digest_that_nobody_reads(spark, capsys):
    signals = text_queries._written(mails(spark, ["p"]))
    rel.rel_message_comm(signals).select("observation_id", "source_value", "target_value").explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "signal_key" not in plan and "Broadcast" not in plan


def test_written_signals_keep_their_ids(spark):
    signals = mails(spark, ["p", "q"])
    ids = lambda rows: sorted(tuple(r) for r in rows.select("signal_id", "signal_key", "normalized_value").collect())
    assert ids(text_queries._written(signals)) == ids(signals)


def test_a_call_has_both_ends_though_rows_come_twice(spark, tmp_path):
    order = "SELECT 1L AS o_orderkey, 2L AS o_custkey, 'O' AS o_orderstatus, '1-URGENT' AS o_orderpriority"
    spark.sql(f"{order} UNION ALL {order}").write.parquet(f"{tmp_path}/orders.parquet")
    calls = catalog.all_queries()["rel_row_called"](spark, str(tmp_path)).select("source", "target").collect()
    assert [tuple(r) for r in calls] == [("+917000000002", "+918000000001")]


def test_accounts_of_a_row_meet_without_a_shuffle(spark, tmp_path):
    """Signals stay in the buckets that they were extracted in; rows that are there twice meet each other."""
    from threadline.plans import catalog

    lines = [(n, n % 7, n % 5, n % 4, "O" if n % 2 else "F") for n in range(40)] + [(3, 3, 3, 3, "O")] + [(1, None, 1, 1, "O")]
    table = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_linestatus string")
    table.write.parquet(f"{tmp_path}/lineitem.parquet")
    found = catalog.all_queries()["rel_account_comm"](spark, str(tmp_path))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    rows = sorted((r.observation_id, r.source, r.target) for r in found.collect())
    once = [(f"COMM-{o}-{n}-{p}-{s}", f"p{p}@parts.example.com", f"s{s}@supp.example.com") for o, p, s, n, _ in lines[:40]]
    assert rows == sorted(once + 3 * [once[3]])
