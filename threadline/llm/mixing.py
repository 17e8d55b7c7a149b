"""Mixing sources to target weights by systematic sampling.

Every source gets a share of the mix by weight, bounded by how often it may be
repeated.  Inside a source every document expects ``target / source size`` copies;
the expected copies are prefix-summed in order of size, one random offset is added,
and a document is emitted once for every integer its stretch of the sum crosses.
Ordering by size makes the sample spread evenly over short and long documents, so
the words taken stay close to the target.

Defined results
---------------
* A null text has size 0; a null source is a source of its own, last in order.
* A source of size 0 has target 0 and gives nothing.
* Documents of one size are ordered by a hash of their id, then the id, null ids first.
* Repeated rows are documents of their own; each is counted and drawn for itself.
* An empty table gives an empty result.  Reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadline.functions.ordered import with_row_number
from threadline.llm.common import named, same, whole_row, word_count
from threadline.session import cut_lineage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
SEED = "mix-1"


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS
) -> DataFrame:
    """Targets of (source, source_size) rows.

    Sources take the weights in turn, by code point, null last.  Targets above
    ``repeats`` times a source's size stop there and their excess is shared again by
    weight until none is above.  Each pass reads one row of sums.
    """
    order = [F.col("source").isNull(), F.col("source")]
    ranked = with_row_number(sizes, [], order, "place")
    turn = F.lit(list(weights))
    ranked = ranked.withColumn("weight", F.get(turn, ((F.col("place") - 1) % len(weights)).cast("int")))
    ranked = cut_lineage(ranked.withColumn("most", F.col("source_size") * F.lit(repeats)))
    total = ranked.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    budget, level = share * (total["s"] or 0), 0.0
    if total["w"]:
        level = budget / total["w"]
        while True:
            above = F.col("weight") * F.lit(level) >= F.col("most")
            row = ranked.agg(
                F.sum(F.when(above, F.col("most"))).alias("held"), F.sum(F.when(~above, F.col("weight"))).alias("free")
            ).first()
            fresh = (budget - (row["held"] or 0)) / row["free"] if row["free"] else level
            if fresh <= level:
                break
            level = fresh
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.lit(level))
    return ranked.select("source", "source_size", target.alias("target"))


def _offset(seed: str) -> Column:
    """One number in [0, 1) for each source."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("none")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(
    docs: DataFrame,
    keep: Sequence[str] | None = None,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
    seed: str = SEED,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """(doc, source, size, source_size, target, copies): every document and how often the mix takes it.

    ``doc`` holds the columns named by ``keep``, default all.  Rows are range-partitioned
    by (source, size), so a large source spans many tasks; only row counts per slice and
    source travel between them.
    """
    tie = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(named(id_column).cast("string"), F.lit(""))))
    rows = docs.select(
        whole_row(docs, keep).alias("doc"), named(source_column).alias("source"), word_count(named(text_column)).alias("size"),
        tie.alias("tie"), named(id_column).alias("id"),
    )
    order = ["source", "size", "tie", "id"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(ranged.withColumn("at", F.monotonically_increasing_id()))
    slice_ = F.shiftright("at", 33)
    # Rows of a source are contiguous in a slice, so a slice's first row and count give every place.
    parts = placed.groupBy("source", slice_.alias("slice")).agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")
    )
    parts = cut_lineage(parts)
    targets = source_targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, repeats)
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    parts = parts.select("source", "slice", "first", before.alias("before"))
    parts = parts.alias("p").join(targets.alias("t"), same("p", "t", ["source"])).select("p.*", "t.source_size", "t.target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    parts = cut_lineage(parts.select("*", rate.alias("rate"), _offset(seed).alias("shift")))
    joined = placed.withColumn("slice", slice_).alias("d").join(parts.alias("p"), same("d", "p", ["source", "slice"]))
    place = F.col("p.before") + F.col("d.at") - F.col("p.first")
    upto = lambda n: F.floor(n.cast("double") * F.col("p.rate") + F.col("p.shift"))
    copies = upto(place + 1) - upto(place)
    return joined.select("d.doc", "d.source", "d.size", "p.source_size", "p.target", copies.cast("int").alias("copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns only."""
    taken = mix(docs, **options).filter("copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("doc.*")
