"""Normalisation, patterns and similarity against literal values."""

import pytest
from pyspark.sql import functions as F

from threadline.functions import similarity, text
from threadline.operators.signals import byte_signals, observed_filesystem
from threadline.operators import resolve

CASES = [
    ("Phone", "9876543210", "+919876543210"),
    ("Phone", "+91-98765-43210", "+919876543210"),
    ("Phone", "09876543210", "+919876543210"),
    ("Phone", "+91 98765 43210", "+919876543210"),
    ("Phone", "+1-415-555-2671", "+14155552671"),
    ("Phone", "+4155552671", "+914155552671"),
    ("Email", "  A.B@Example.COM ", "a.b@example.com"),
    ("Person", "  Mr. Vikram   Singh  ", "Vikram Singh"),
    ("Person", "dr. rajesh kumar", "Rajesh Kumar"),
    ("Person", "VIKRAM SINGH", "Vikram Singh"),
    ("Person", "Mrinal Sen", "Mrinal Sen"),
    ("Person", "3rd o_neil", "3Rd O_Neil"),
    ("Person", "josé ñandú", "José Ñandú"),
    ("Location", "28.613939, 77.209021", "28.61394, 77.20902"),
    ("Location", "new  delhi,  india", "New Delhi India"),
    ("Location", "Connaught Place, Zone-1", "Connaught Place Zone 1"),
    ("UPI", "  hdfc 0001234  ", "HDFC0001234"),
    ("Vehicle", "DL-01-AB-1234", "DL01AB1234"),
    ("Vehicle", "dl 01 ab 1234", "DL01AB1234"),
    ("Org", "Enterprise Pvt Ltd", "Enterprise"),
    ("PHONE_NUMBER", "9876543210", "+919876543210"),
    ("Unknown", " a   b ", "a b"),
    ("Person", "", ""),
]


def test_normalisation(spark):
    rows = spark.createDataFrame([(i, *case) for i, case in enumerate(CASES)], "i int, kind string, raw string, expected string")
    out = rows.select("raw", "expected", text.norm_dispatch(F.col("kind"), F.col("raw")).alias("got")).collect()
    assert [(r.raw, r.got) for r in out] == [(r.raw, r.expected) for r in out]


def test_phone_digit_filter(spark):
    values = ["2023", "8080", "0000000000", "1111111111", "+91-98765-43210", "(555) 123-4567"]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r.v: r.ok for r in rows.select("v", text.phone_digits_ok(F.col("v")).alias("ok")).collect()}
    assert [v for v in values if got[v]] == ["+91-98765-43210", "(555) 123-4567"]


def test_byte_signals_keep_everything_unless_limited(spark):
    noise = "year 2023; port 8080; 0000000000; 1111111111; "
    body = noise + "+91-98765-43210; 9876543210; (555) 123-4567; a@x.com b@x.com c@x.com" + " pad" * 30000 + " late@x.com"
    files = spark.createDataFrame([("A", body)], "artifact_id string, text string")
    found = byte_signals(files).collect()
    digits = {"".join(ch for ch in r.observed_value if ch.isdigit()) for r in found if r.entity_type == "PhoneNumber"}
    assert {"9876543210", "5551234567"} <= digits and "1111111111" not in digits
    assert sum(r.entity_type == "Email" for r in found) == 4
    assert byte_signals(files, limit=2).count() == 4


def test_filesystem(spark):
    row = spark.sql("SELECT 'xxNTFSxx' a, 'MSDOS5' b, 'EXT' c, '' d")
    got = row.select(*[observed_filesystem(F.col(n)).alias(n) for n in "abcd"]).first()
    assert tuple(got) == ("NTFS", "FAT32", "EXT4", "FAT32")


def _classify(spark, rows):
    df = spark.createDataFrame(rows, "later string, earlier string, entity_type string").withColumn("case_id", F.lit("C"))
    return {(r.later, r.earlier): r for r in resolve.classify_pairs(df).collect()}


def test_match_classes(spark):
    got = _classify(
        spark,
        [
            ("Vikram Singh", "Vikram Singh", "Person"),
            ("V Singh", "Vikram Singh", "Person"),
            ("Vikram Singh", "Anita Desai", "Person"),
            ("tide", "diet", "Person"),
            ("diet", "tide", "Person"),
            ("+919876543210", "+919876543211", "PhoneNumber"),
            ("", "x", "Person"),
        ],
    )
    assert got[("Vikram Singh", "Vikram Singh")].match_class == "EXACT_MATCH"
    initial = got[("V Singh", "Vikram Singh")]
    assert (initial.match_class, initial.confidence) == ("AMBIGUOUS_CANDIDATE", 0.75)
    assert initial.rule == "PERSON_INITIAL_MATCH_HUMAN_REVIEW_REQUIRED"
    assert got[("Vikram Singh", "Anita Desai")].match_class == "DISTINCT_NON_MATCH"
    assert (got[("tide", "diet")].ratio, got[("diet", "tide")].ratio) == (0.25, 0.5)
    phones = got[("+919876543210", "+919876543211")]
    assert round(phones.ratio, 3) == 0.923 and phones.match_class == "HIGH_CONFIDENCE_FUZZY"
    assert got[("", "x")].rule == "EMPTY_VALUE"


@pytest.mark.parametrize("threshold", [0.85])
def test_edit_budget(spark, threshold):
    got = spark.range(1).select(similarity.edit_budget(F.lit(13), F.lit(13), threshold)).first()[0]
    assert got == 3
