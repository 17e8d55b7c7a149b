"""Modularity communities on the undirected weighted projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadline.functions.ordered import with_row_number
from threadline.operators.analytics import NODE, project_nodes, undirected_weights
from threadline.session import cut_lineage, discard

MIN_GAIN = 1e-7


def _both_ways(links: DataFrame) -> DataFrame:
    """Each undirected link from both ends; a self link appears once with double weight."""
    forward = links.select("case_id", "a", "b", F.when(F.col("a") == F.col("b"), 2 * F.col("weight")).otherwise(F.col("weight")).alias("weight"))
    return forward.unionByName(
        forward.filter("a <> b").select("case_id", F.col("b").alias("a"), F.col("a").alias("b"), "weight")
    )


def modularity(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Modularity per case of labels (case_id, id, community) on links (case_id, a, b, weight)."""
    ways = _both_ways(links)
    left = labels.select("case_id", F.col("id").alias("a"), F.col("community").alias("ca"))
    right = labels.select("case_id", F.col("id").alias("b"), F.col("community").alias("cb"))
    ends = ways.join(left, ["case_id", "a"]).join(right, ["case_id", "b"])
    per = ends.groupBy("case_id", "ca").agg(
        F.sum("weight").alias("total"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0)).alias("inside")
    )
    whole = per.groupBy("case_id").agg(F.sum("total").alias("m2"))
    share = F.col("inside") / F.col("m2") - (F.col("total") / F.col("m2")) * (F.col("total") / F.col("m2"))
    return per.join(whole, "case_id").groupBy("case_id").agg(F.sum(share).alias("modularity"))


# One round of moves.  ``stay`` is the gain of the own community without oneself.
_MOVE_STEP = """
    WITH sizes AS (
      SELECT l.case_id, l.community, sum(n.k) AS tot FROM {labels} l JOIN {nodes} n ON l.case_id = n.case_id AND l.id = n.id
      GROUP BY l.case_id, l.community),
    near AS (
      SELECT w.case_id, w.a AS id, l.community, sum(w.weight) AS w
      FROM {ways} w JOIN {labels} l ON w.case_id = l.case_id AND w.b = l.id WHERE w.a <> w.b GROUP BY w.case_id, w.a, l.community),
    scored AS (
      SELECT e.case_id, e.id, e.community, o.community AS own, n.k, n.m2,
        e.w - n.k * (s.tot - CASE WHEN e.community = o.community THEN n.k ELSE 0 END) / n.m2 AS gain
      FROM near e JOIN sizes s ON e.case_id = s.case_id AND e.community = s.community
        JOIN {labels} o ON e.case_id = o.case_id AND e.id = o.id JOIN {nodes} n ON e.case_id = n.case_id AND e.id = n.id),
    choice AS (
      SELECT case_id, id, own, max(k) AS k, max(m2) AS m2, max(struct(gain, community)) AS top,
        max(CASE WHEN community = own THEN gain END) AS stay
      FROM scored GROUP BY case_id, id, own)
    SELECT c.case_id, c.id, c.own, c.top.community AS target,
      c.top.gain - coalesce(c.stay, -c.k * (h.tot - c.k) / c.m2) AS lift
    FROM choice c JOIN sizes h ON c.case_id = h.case_id AND c.own = h.community
    WHERE pmod(xxhash64(c.id, {turn}), 2) = {side} AND c.top.community <> c.own
      AND c.top.gain > coalesce(c.stay, -c.k * (h.tot - c.k) / c.m2) + {least}"""


def _apart(moves: DataFrame) -> DataFrame:
    """Moves that are the best of both communities they touch.

    No two of them share a community, so each gains what it promises and together they
    raise modularity; the best move of a case is always among them.
    """
    ends = moves.select("case_id", F.col("own").alias("c"), "lift", "id").unionByName(
        moves.select("case_id", F.col("target").alias("c"), "lift", "id")
    )
    best = ends.groupBy("case_id", "c").agg(F.max(F.struct("lift", "id")).getField("id").alias("id"))
    for end in ("own", "target"):
        moves = moves.join(best.withColumnRenamed("c", end), ["case_id", end, "id"], "left_semi")
    return moves


def _local_moves(links: DataFrame) -> DataFrame:
    """Move nodes to the neighbouring community with the best gain until nothing gains.

    Half of the nodes, by hash and round, may move at a time.  A round in which a case
    lost modularity, because neighbours moved at once, is taken back for that case; from
    then on it makes only moves that touch no common community, and these always gain.
    So modularity only rises and the loop ends by itself.
    """
    spark = links.sparkSession
    ways = cut_lineage(_both_ways(links))
    strength = ways.groupBy("case_id", F.col("a").alias("id")).agg(F.sum("weight").cast("double").alias("k"))
    total = strength.groupBy("case_id").agg(F.sum("k").alias("m2"))
    nodes = cut_lineage(strength.join(total, "case_id"))
    labels = cut_lineage(nodes.select(*NODE, F.col("id").alias("community")))
    scores = cut_lineage(modularity(links, labels))
    # One row per case and round that was taken back; two of them end a case (then gains are below rounding).
    setbacks = cut_lineage(scores.select("case_id").limit(0))
    calm = step = 0
    while calm < 2:
        found = spark.sql(_MOVE_STEP, labels=labels, nodes=nodes, ways=ways, turn=step // 2, side=step % 2, least=MIN_GAIN)
        backs = setbacks.groupBy("case_id").agg(F.count(F.lit(1)).alias("backs"))
        found = cut_lineage(found.join(backs, "case_id", "left").filter("backs is null or backs < 2"))
        moves = cut_lineage(found.filter("backs is null").unionByName(_apart(found.filter("backs = 1"))))
        step += 1
        calm = calm + 1 if moves.isEmpty() else 0
        if not calm:
            target = moves.select(*NODE, "target")
            moved = cut_lineage(labels.join(target, NODE, "left").select(*NODE, F.coalesce("target", "community").alias("community")))
            labels, scores, worse = _accept(links, labels, moved, scores, moves.select("case_id").distinct())
            before, setbacks = setbacks, cut_lineage(setbacks.unionByName(worse))
            discard(before, moved)
        discard(found, moves)
    discard(ways, nodes)
    return labels


def _accept(
    links: DataFrame, labels: DataFrame, moved: DataFrame, scores: DataFrame, tried: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Case by case the moved labels where they raised modularity, else the old ones; the scores; the tried cases kept back."""
    fresh = modularity(links, moved).withColumnRenamed("modularity", "fresh")
    judged = scores.join(fresh, "case_id").withColumn("better", F.col("fresh") > F.col("modularity") + MIN_GAIN)
    judged = cut_lineage(judged)
    better = judged.filter("better").select("case_id")
    kept = labels.join(better, "case_id", "left_anti").unionByName(moved.join(better, "case_id", "left_semi"))
    score = F.when(F.col("better"), F.col("fresh")).otherwise(F.col("modularity"))
    result = cut_lineage(kept), cut_lineage(judged.select("case_id", score.alias("modularity")))
    worse = cut_lineage(tried.join(better, "case_id", "left_anti"))
    discard(labels, scores, judged)
    return *result, worse


def community_labels(pairs: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Community of every node: local moves, then contraction, case by case until modularity stops rising.

    A case whose level brought nothing is frozen and leaves the loop; the answer of a
    case does not depend on the other cases of the table.
    """
    everyone = project_nodes(nodes, pairs).select(*NODE)
    base = cut_lineage(undirected_weights(pairs))
    links = base
    labels = cut_lineage(everyone.select(*NODE, F.col("id").alias("community")))
    scores = cut_lineage(modularity(base, labels))
    while not links.isEmpty():
        moved = _local_moves(links)
        lift = moved.select("case_id", F.col("id").alias("community"), F.col("community").alias("up"))
        merged = cut_lineage(
            labels.join(lift, ["case_id", "community"], "left").select(*NODE, F.coalesce("up", "community").alias("community"))
        )
        labels, scores, frozen = _accept(base, labels, merged, scores, links.select("case_id").distinct())
        left = moved.select("case_id", F.col("id").alias("a"), F.col("community").alias("ca"))
        right = moved.select("case_id", F.col("id").alias("b"), F.col("community").alias("cb"))
        open_ = links.join(frozen, "case_id", "left_anti")
        joined = open_.join(left, ["case_id", "a"]).join(right, ["case_id", "b"])
        before, links = links, cut_lineage(
            joined.groupBy("case_id", F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("weight").alias("weight"))
        )
        discard(moved, merged, frozen)
        if before is not base:
            discard(before)
    return labels


def communities(pairs: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Members with community id (largest first) and size."""
    labels = community_labels(pairs, nodes)
    sizes = labels.groupBy("case_id", "community").agg(F.count(F.lit(1)).alias("size"))
    ranked = with_row_number(sizes, ["case_id"], [F.desc("size"), F.asc("community")], "rank")
    pad = F.when(F.col("rank") < 10, F.lit("0")).otherwise(F.lit(""))
    name = F.concat(F.lit("COMM-"), pad, F.col("rank").cast("string"))
    return labels.join(ranked.withColumn("community_id", name), ["case_id", "community"]).select(
        *NODE, "community_id", "size"
    )
