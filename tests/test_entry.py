"""The driver contract."""

import __spark_entry__ as contract


def test_contract(spark):
    frame = contract.entry(spark)
    assert frame.columns[:3] == ["case_id", "src_id", "tgt_id"] and frame.count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
