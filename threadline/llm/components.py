"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadline.session import cut_lineage, discard


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every end of (a, b) links; root is the smallest node that can be reached.

    Two star contractions take turns: each node hands its larger neighbours, then its
    smaller ones, to the smallest node it knows.  Links end as stars around the
    smallest nodes after few rounds, also for long chains.  Every round is written
    below the checkpoint folder; groups are only ever aggregated, never gathered.
    """
    links = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = cut_lineage(links)
    mark = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        stars = small.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(
            least.select(F.col("m").alias("a"), F.col("u").alias("b"))
        )
        before, links = links, cut_lineage(stars.filter("a <> b").distinct())
        discard(before)
        seen = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if seen == mark:
            break
        mark = seen
    roots = links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    return links.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(roots)
