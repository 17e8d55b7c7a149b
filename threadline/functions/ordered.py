"""Row numbers, lags and leads over long ordered groups.

A plain ``Window.partitionBy(key)`` sends a whole key to one task.  When one key
may hold a large share of the rows that task becomes the job.  Here the rows are
range-partitioned on (key, order) instead, so a long key spans many slices; each
slice is windowed on its own and the few values that cross a slice border (row
counts, first and last rows) travel through a table with one row per (slice, key).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadline.session import cut_lineage

SLICE = "_slice"


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Range-partition on (keys, order) and tag each row with its slice number.

    The written copy pins the slices: both uses of a slice (its rows and its border
    values) must see the same split, also after a task is re-run.
    """
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    return cut_lineage(ranged.withColumn(SLICE, F.spark_partition_id()))


def _same(left: str, right: str, columns: Sequence[str]) -> Column:
    condition = F.lit(True)
    for name in columns:
        condition = condition & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return condition


def with_row_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "row_number"
) -> DataFrame:
    """Row number from 1 inside each key, without one task per key."""
    parts = sliced(df, keys, order)
    group = [*keys, SLICE]
    sizes = parts.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    local = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    numbered = parts.withColumn("_local", local)
    return (
        numbered.alias("n")
        .join(offsets.alias("o"), _same("n", "o", group))
        .select("n.*", (F.col("o._offset") + F.col("n._local")).alias(name))
        .drop("_local", SLICE)
    )


def _with_neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    outputs: Mapping[str, str],
    forward: bool,
) -> DataFrame:
    parts = sliced(df, keys, order)
    group = [*keys, SLICE]
    local = Window.partitionBy(*group).orderBy(*order)
    shift = F.lead if forward else F.lag
    packed = F.struct(*[F.col(source).alias(target) for target, source in outputs.items()])
    rows = parts.withColumn("_packed", packed)
    rows = rows.withColumn("_near", shift("_packed").over(local))
    # The first (last) row of a slice takes its neighbour from the slice before (after).
    # A packed struct is never null, so a null neighbour marks exactly the slice border.
    far_end = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    if forward:
        ends = rows.withColumn("_n", far_end).filter("_n = 1")
    else:
        after = F.lead(F.lit(1)).over(local)
        ends = rows.withColumn("_n", after).filter("_n is null")
    across = Window.partitionBy(*keys).orderBy(SLICE)
    borders = ends.select(*group, F.col("_packed").alias("_edge"))
    borders = borders.select(*group, shift("_edge").over(across).alias("_far"))
    joined = rows.alias("r").join(borders.alias("b"), _same("r", "b", group), "left")
    chosen = F.coalesce(F.col("r._near"), F.col("b._far"))
    kept = [F.col(f"r.{name}") for name in df.columns]
    return joined.select(*kept, *[chosen.getField(target).alias(target) for target in outputs])


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], outputs: Mapping[str, str]
) -> DataFrame:
    """``lag`` by one for several columns: ``outputs`` maps new name to source column."""
    return _with_neighbour(df, keys, order, outputs, forward=False)


def with_next(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], outputs: Mapping[str, str]
) -> DataFrame:
    """``lead`` by one for several columns: ``outputs`` maps new name to source column."""
    return _with_neighbour(df, keys, order, outputs, forward=True)
