"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; everything between is a word.
BLANKS = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"


def named(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame, columns: Iterable[str] | None = None) -> Column:
    """The given columns (default: all) as one struct, so that no working column can clash with them."""
    return F.struct(*[named(name) for name in (df.columns if columns is None else columns)])


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts 0."""
    core = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(core == "", F.lit(0)).otherwise(F.size(F.split(core, GAP))).cast("long")


def same(left: str, right: str, columns: Iterable[str]) -> Column:
    """Null-safe equality of the columns of two aliased sides."""
    condition = F.lit(True)
    for name in columns:
        condition = condition & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return condition


def small_batches(spark: SparkSession, rows: int = 250, megabytes: int = 8) -> None:
    """Hand at most so many texts, and about so many bytes of them, to a Python worker at a time.

    So its memory stays small however long the texts are.  The settings belong to the
    session and stay, since frames run later than they are built; a session that asks for
    fewer rows keeps its own numbers.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{megabytes}m")


def logit(p: Column) -> Column:
    return F.log(p / (F.lit(1.0) - p))
