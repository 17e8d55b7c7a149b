"""Explainable association score of an edge and its priority ring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Base weight per relationship type; anything else weighs 0.40.
BASE_WEIGHTS = {
    "CALLED": 1.00,
    "USED_PHONE": 0.80,
    "USED_VEHICLE": 0.75,
    "ASSOCIATED_WITH": 0.65,
    "CONNECTED_TO": 0.50,
    "VISITED": 0.40,
    "PARTICIPATED_IN": 0.40,
}
DEFAULT_WEIGHT = 0.40

# Ring bounds and labels.
RINGS = {
    "RED": "Highest-Priority Analytical Lead",
    "YELLOW": "Moderate-Priority Potential Association",
    "GREEN": "Lower-Priority Contextual Link",
}


def base_weight(relation: Column) -> Column:
    weight = F.lit(DEFAULT_WEIGHT)
    for name, value in BASE_WEIGHTS.items():
        weight = F.when(F.upper(relation) == name, F.lit(value)).otherwise(weight)
    return weight


def recency(days: Column) -> Column:
    return F.exp(-days / F.lit(30.0))


def association_score(
    relation: Column, frequency: Column, days: Column, sources: Column, confidence: Column, provenance_ok: Column
) -> Column:
    """Four factors of 25 points each, times the match confidence and provenance factors."""
    often = F.least(F.lit(1.0), F.log(1 + frequency) / F.log(F.lit(15.0)))
    proof = F.least(F.lit(1.0), F.lit(0.25) + F.lit(0.25) * sources)
    raw = F.lit(25.0) * base_weight(relation) + F.lit(25.0) * often
    raw = raw + F.lit(25.0) * recency(days) + F.lit(25.0) * proof
    certain = F.greatest(F.lit(0.5), F.least(F.lit(1.0), confidence))
    traced = F.when(provenance_ok, F.lit(1.0)).otherwise(F.lit(0.5))
    return F.bround(F.least(F.lit(100.0), raw * certain * traced), 0).cast("int")


def ring(score: Column) -> Column:
    return F.when(score > 75, "RED").when(score >= 41, "YELLOW").otherwise("GREEN")


def priority_label(ring_name: Column) -> Column:
    label = F.lit(None).cast("string")
    for name, text in RINGS.items():
        label = F.when(ring_name == name, F.lit(text)).otherwise(label)
    return label


def score_explain(
    relation: Column, frequency: Column, days: Column, sources: Column, confidence: Column, provenance_ok: Column
) -> Column:
    """Six sentences that show what went into the score; their texts are fixed values."""
    def percent(value: Column) -> Column:
        return F.concat(F.bround(value * 100, 0).cast("int").cast("string"), F.lit("%"))

    proof = F.when(provenance_ok, "Verified Cryptographic SHA-256").otherwise("Unverified / Degraded")
    return F.array(
        F.concat(F.lit("Relationship Type Weight: "), relation, F.lit(" (Base: "), percent(base_weight(relation)), F.lit(")")),
        F.concat(F.lit("Frequency Count: "), frequency.cast("string"), F.lit(" interactions recorded")),
        F.concat(F.format_string("Recency: Recorded %.1f days ago (Decay: ", F.bround(days, 1)), percent(recency(days)), F.lit(")")),
        F.concat(F.lit("Independent Sources: "), sources.cast("string"), F.lit(" distinct artifacts")),
        F.concat(F.lit("Entity Resolution Match Confidence: "), percent(confidence)),
        F.concat(F.lit("Provenance Integrity: "), proof),
    )


def ccc_score(df: DataFrame) -> DataFrame:
    """Score rows with rel_type, frequency, days_elapsed, source_count, er_confidence, provenance_valid."""
    inputs = [
        F.col(name)
        for name in ("rel_type", "frequency", "days_elapsed", "source_count", "er_confidence", "provenance_valid")
    ]
    scored = df.withColumn("association_score", association_score(*inputs))
    scored = scored.withColumn("concentric_ring", ring(F.col("association_score")))
    return scored.withColumn("priority_label", priority_label(F.col("concentric_ring")))


def ccc_score_edges(case_edges: DataFrame, mode: str = "fixed", as_of: Column | None = None) -> DataFrame:
    """Score consolidated edges.

    ``fixed`` uses four times the count (at most 60) and seven days; ``observed``
    uses the real count and the days between ``as_of`` and the edge's last_seen.
    """
    if mode == "fixed":
        frequency = F.least(F.col("interaction_count") * 4, F.lit(60))
        days = F.lit(7.0)
    elif mode == "observed":
        seconds = F.unix_timestamp(as_of) - F.unix_timestamp("last_seen")
        frequency = F.col("interaction_count")
        days = F.greatest(F.lit(0.0), seconds / F.lit(86400.0))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    sources = F.greatest(F.col("evidence_count"), F.lit(1))
    score = association_score(
        F.col("first_type"), frequency, days, sources, F.col("confidence"), F.lit(True)
    )
    scored = case_edges.withColumn("ccc_score", score)
    scored = scored.withColumn("ccc_ring", ring(F.col("ccc_score")))
    return scored.withColumn("priority_label", priority_label(F.col("ccc_ring")))


def ring_queue(scored: DataFrame, k: int) -> DataFrame:
    """The k best edges of every ring of every case; the rank bound is pushed before the shuffle."""
    order = Window.partitionBy("case_id", "ccc_ring").orderBy(F.desc("ccc_score"), "src_id", "tgt_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def score_evaluate(scored: DataFrame) -> DataFrame:
    """Checks of scored rows against expected ring and score bounds, with the pass rate."""
    passed = (
        (F.col("concentric_ring") == F.col("expected_ring"))
        & (F.col("association_score") >= F.coalesce("min_expected_score", F.lit(0)))
        & (F.col("association_score") <= F.coalesce("max_expected_score", F.lit(100)))
    )
    checked = scored.withColumn("passed", passed)
    return checked.agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if("passed").alias("passed"),
        F.avg(F.col("passed").cast("double")).alias("pass_rate"),
    )
