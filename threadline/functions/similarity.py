"""String similarity and match classes."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HIGH = 0.85
AMBIGUOUS = 0.60


def _ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    matcher = SequenceMatcher(None)
    values = []
    for a, b in zip(left, right, strict=True):
        if not a or not b:
            values.append(0.0)
            continue
        matcher.set_seqs(a.lower(), b.lower())
        values.append(matcher.ratio())
    return pd.Series(values, dtype="float64")


_ratio_udf = F.pandas_udf(_ratio, T.DoubleType())


def similarity(left: Column, right: Column) -> Column:
    """Ratcliff-Obershelp ratio of the lower-cased texts; the argument order matters."""
    return _ratio_udf(left, right)


def edit_budget(left_length: Column, right_length: Column, threshold: float) -> Column:
    """Most insertions plus deletions a pair may need and still reach ``threshold``.

    ratio = 2 M / (a + b), and a + b - 2 M characters stay unmatched.
    """
    return F.floor((left_length + right_length) * F.lit(1.0 - threshold) + F.lit(1e-9)).cast("int")


def _last(name: Column) -> Column:
    return F.element_at(F.split(name, " "), -1)


def initials_agree(left: Column, right: Column) -> Column:
    """Both have two or more words and one first word is a single letter that fits the other."""
    left_words, right_words = F.split(left, " "), F.split(right, " ")
    first_left, first_right = F.get(left_words, F.lit(0)), F.get(right_words, F.lit(0))
    return (
        (F.size(left_words) >= 2)
        & (F.size(right_words) >= 2)
        & ((F.length(first_left) == 1) | (F.length(first_right) == 1))
        & (F.upper(F.substring(first_left, 1, 1)) == F.upper(F.substring(first_right, 1, 1)))
    )


def initial_match(left: Column, right: Column, could: Column | None = None) -> Column:
    """One name is the other with its first name cut to the initial.

    Rows that cannot match hand nulls to the ratio, which costs nothing there.
    """
    could = initials_agree(left, right) if could is None else could & initials_agree(left, right)
    return could & (similarity(F.when(could, _last(left)), F.when(could, _last(right))) >= HIGH)


def match_class(left: Column, right: Column, entity_type: Column, ratio: Column, initial: Column) -> Column:
    """Struct (match_class, confidence, rule).

    The class comes from the unrounded ratio, the confidence is rounded half-even.
    """
    rounded = F.bround(ratio, 2)

    def row(name: str, confidence: Column, rule: Column | str) -> Column:
        rule = F.lit(rule) if isinstance(rule, str) else rule
        return F.struct(
            F.lit(name).alias("match_class"), confidence.alias("confidence"), rule.alias("rule")
        )

    return (
        F.when((left == "") | (right == ""), row("DISTINCT_NON_MATCH", F.lit(0.0), "EMPTY_VALUE"))
        .when(
            left == right,
            row("EXACT_MATCH", F.lit(1.0), F.concat(F.lit("EXACT_NORMALIZED_"), F.upper(entity_type))),
        )
        .when(
            (F.upper(entity_type) == "PERSON") & initial,
            row("AMBIGUOUS_CANDIDATE", F.lit(0.75), "PERSON_INITIAL_MATCH_HUMAN_REVIEW_REQUIRED"),
        )
        .when(ratio >= HIGH, row("HIGH_CONFIDENCE_FUZZY", rounded, "FUZZY_STRING_SIMILARITY"))
        .when(ratio >= AMBIGUOUS, row("AMBIGUOUS_CANDIDATE", rounded, "AMBIGUOUS_SIMILARITY_HUMAN_REVIEW_REQUIRED"))
        .otherwise(row("DISTINCT_NON_MATCH", rounded, "NO_MATCH"))
    )
