"""Graph analytics per case, as joins and aggregations.

Input is ``project_graph``: directed pair weights.  Iterative operators write their
state to the checkpoint folder every round, so a lost executor re-reads it and the
plan stays small.  Pair tables stay partitioned by the whole pair, which spreads a
hub's edges; joins on one end are left to adaptive execution (size-checked
broadcast, else skew splitting).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadline.functions.ordered import with_row_number
from threadline.session import Pile, bucketed, cut_lineage, discard

PAIR = ["case_id", "src_id", "tgt_id"]
NODE = ["case_id", "id"]


# --- projection ----------------------------------------------------------------


def project_graph(edges: DataFrame) -> DataFrame:
    """Directed pair weights: edge rows, distinct evidence, first edge id, distance."""
    filled = edges.filter((F.length("src_id") > 0) & (F.length("tgt_id") > 0))
    pairs = filled.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("weight"),
        F.count_distinct("evidence_id").alias("evidence_count"),
        F.min("rel_id").alias("sample_edge_id"),
    )
    return pairs.withColumn("dist", F.lit(1.0) / F.col("weight"))


def undirected_weights(pairs: DataFrame) -> DataFrame:
    """Weights of both directions summed, as (case_id, a, b, weight) with a <= b."""
    return pairs.groupBy(
        "case_id", F.least("src_id", "tgt_id").alias("a"), F.greatest("src_id", "tgt_id").alias("b")
    ).agg(F.sum("weight").alias("weight"))


def project_nodes(nodes: DataFrame | None, pairs: DataFrame) -> DataFrame:
    """All nodes: given ones (isolated included) and unseen endpoints as Unknown."""
    ends = F.explode(F.array("src_id", "tgt_id")).alias("id")
    seen = pairs.select("case_id", ends).distinct()
    if nodes is None:
        return seen
    known = nodes.select(*NODE, "entity_type")
    extra = seen.join(known, NODE, "left_anti").withColumn("entity_type", F.lit("Unknown"))
    return known.unionByName(extra)


# --- degree and frequency ------------------------------------------------------


def degree_metrics(pairs: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """In, out and undirected distinct neighbours; a self loop counts one, one and two."""
    out = pairs.select("case_id", F.col("src_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.lit(0).alias("u"))
    into = pairs.select("case_id", F.col("tgt_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.lit(0).alias("u"))
    both = undirected_weights(pairs).select("case_id", F.explode(F.array("a", "b")).alias("id"))
    both = both.select(*NODE, F.lit(0).alias("o"), F.lit(0).alias("i"), F.lit(1).alias("u"))
    rows = out.unionByName(into).unionByName(both)
    if nodes is not None:
        rows = rows.unionByName(nodes.select(*NODE, F.lit(0).alias("o"), F.lit(0).alias("i"), F.lit(0).alias("u")))
    return rows.groupBy(*NODE).agg(
        F.sum("i").alias("in_degree"),
        F.sum("o").alias("out_degree"),
        F.sum("u").alias("unique_neighbors"),
        F.sum("u").alias("total_degree"),
    )


def degree_centrality(pairs: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """In plus out edges over the number of other nodes of the case.

    Both ends of a pair are counted in one pass and one aggregation; distinct neighbours,
    which ``degree_metrics`` adds, take another one and are not needed here.
    """
    end = lambda column, out: F.struct(F.col(column).alias("id"), F.lit(out).alias("o"), F.lit(1 - out).alias("i"))
    rows = pairs.select("case_id", F.inline(F.array(end("src_id", 1), end("tgt_id", 0))))
    if nodes is not None:
        rows = rows.unionByName(nodes.select(*NODE, F.lit(0).alias("o"), F.lit(0).alias("i")))
    degrees = rows.groupBy(*NODE).agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    sizes = degrees.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    share = (F.col("in_degree") + F.col("out_degree")) / (F.col("n") - 1)
    return degrees.join(sizes, "case_id").select(
        *NODE, "out_degree", F.when(F.col("n") > 1, share).otherwise(1.0).alias("degree_centrality")
    )


def weighted_frequency(pairs: DataFrame) -> DataFrame:
    """Pairs with their case's pair count and highest weight; order by weight to list them."""
    totals = pairs.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("unique_pairs"), F.max("weight").alias("max_frequency")
    )
    # Written, a few cases show their size: their totals go to the pairs, which are not dealt by case.
    return pairs.join(cut_lineage(totals), "case_id").select(
        *PAIR, "weight", "evidence_count", "sample_edge_id", "unique_pairs", "max_frequency"
    )


# --- PageRank ------------------------------------------------------------------

# One round: per case, the rank held by nodes without a way out and whether the case
# had settled; then each node's inflow and its own row meet in one aggregation.
_RANK_STEP = """
    WITH cases AS (
      SELECT case_id, sum(CASE WHEN dangling THEN rank ELSE 0D END) AS lost,
        {step} > 1 AND sum(abs(rank - before)) < max(n) * {tolerance} AS settled
      FROM {state} GROUP BY case_id),
    flows AS (
      SELECT l.case_id, l.tgt_id AS id, s.rank * l.share AS flow, CAST(NULL AS BIGINT) AS n,
        CAST(NULL AS BOOLEAN) AS dangling, CAST(NULL AS DOUBLE) AS rank, CAST(NULL AS DOUBLE) AS before
      FROM {links} l JOIN {state} s ON l.case_id = s.case_id AND l.id = s.id
      UNION ALL SELECT case_id, id, 0D, n, dangling, rank, before FROM {state}),
    summed AS (
      SELECT case_id, id, sum(flow) AS flow, max(n) AS n, max(dangling) AS dangling, max(rank) AS rank, max(before) AS before
      FROM flows GROUP BY case_id, id)
    SELECT m.case_id, m.id, m.n, m.dangling,
      CASE WHEN c.settled THEN m.rank
        ELSE {damping} * (m.flow + c.lost / m.n) + (1 - {damping}) / m.n END AS rank,
      CASE WHEN c.settled THEN m.before ELSE m.rank END AS before,
      c.settled AS done
    FROM summed m JOIN cases c ON m.case_id = c.case_id"""


def pagerank(
    pairs: DataFrame,
    nodes: DataFrame | None = None,
    damping: float = 0.85,
    tolerance: float = 1e-6,
) -> DataFrame:
    """Weighted PageRank per case; a case stops once its change is below n times ``tolerance``.

    Damping below 1 shrinks the change every round, so every case settles.  Links are
    written once in buckets of their source and never shuffled again; only ranks and
    combined inflows move.
    """
    if not 0 <= damping < 1:
        raise ValueError("damping must be at least 0 and below 1")
    everyone = project_nodes(nodes, pairs).select(*NODE)
    sizes = everyone.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    totals = pairs.groupBy("case_id", F.col("src_id").alias("id")).agg(F.sum("weight").alias("total"))
    links = pairs.select("case_id", F.col("src_id").alias("id"), "tgt_id", "weight")
    links = links.join(totals, NODE).select(*NODE, "tgt_id", (F.col("weight") / F.col("total")).alias("share"))
    links = bucketed(links, "case_id", "id")
    state = everyone.join(sizes, "case_id").join(totals, NODE, "left")
    state = cut_lineage(
        state.select(
            *NODE, "n", F.col("total").isNull().alias("dangling"),
            (F.lit(1.0) / F.col("n")).alias("rank"), F.lit(0.0).alias("before"), F.lit(False).alias("done"),
        )
    )
    spark = pairs.sparkSession
    step = 0
    while not state.filter("not done").isEmpty():
        step += 1
        before, state = state, cut_lineage(
            spark.sql(_RANK_STEP, state=state, links=links, damping=damping, tolerance=tolerance, step=step)
        )
        discard(before)
    discard(links)
    return state.select(*NODE, F.col("rank").alias("pagerank"))


# --- components ----------------------------------------------------------------


def component_labels(pairs: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Smallest node id of each node's weak component.

    Alternates two star contractions: every node hands its larger neighbours, then
    its smaller ones, to the smallest node it knows.  The edge set ends as stars around
    component minima after about log-squared rounds, long chains included.  Rounds work on
    64-bit numbers of the nodes; names return at the end.
    """
    links = undirected_weights(pairs.filter(F.col("src_id") != F.col("tgt_id"))).select("case_id", "a", "b")
    named = cut_lineage(links.dropna())
    names, seed = _numbered(named)
    ends = [_number(end, seed) for end in ("a", "b")]
    links = cut_lineage(named.select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b")))
    discard(named)
    signature = None
    while True:
        # Larger neighbours of u, u itself included through its minimum.
        near = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = near.filter("b > a").join(low, "a").select(F.col("b").alias("v"), "m")
        large = large.filter("v <> m").distinct()
        # Smaller neighbours: v > m in every row, so v's smaller side is its m values.
        least = large.groupBy("v").agg(F.min("m").alias("least"))
        # v itself goes to its least neighbour once, not with each of them.
        small = large.join(least, "v").filter("m <> least").select(F.col("least").alias("a"), F.col("m").alias("b"))
        stars = small.distinct().unionByName(least.select(F.col("least").alias("a"), F.col("v").alias("b")))
        before, links = links, cut_lineage(stars.distinct())
        discard(before)
        mark = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if mark == signature:
            break
        signature = mark
    rooted = names.join(links.select(F.col("b").alias("v"), F.col("a").alias("root")), "v", "left")
    rooted = cut_lineage(rooted.select("case_id", "id", F.coalesce("root", "v").alias("root")))
    labels = rooted.join(rooted.groupBy("root").agg(F.min("id").alias("component")), "root").select("case_id", "id", "component")
    everyone = project_nodes(nodes, pairs).select(*NODE)
    return everyone.join(labels, NODE, "left").select(*NODE, F.coalesce("component", "id").alias("component"))


def _number(end: str, seed: int) -> Column:
    # A null leaves no trace in a hash, so it is told apart by itself.
    return F.xxhash64("case_id", F.col("case_id").isNull(), end, F.lit(seed))


def _numbered(links: DataFrame) -> tuple[DataFrame, int]:
    """(v, case_id, id) of all ends of links (case_id, a, b), and the seed of their numbers v."""
    return _numbers_of(links.select("case_id", F.explode(F.array("a", "b")).alias("id")))


def _numbers_of(nodes: DataFrame) -> tuple[DataFrame, int]:
    """(v, case_id, id) of all nodes (case_id, id), and the seed of their numbers v.

    Should two nodes share a number, the next seed is tried, so that numbers tell nodes apart.
    """
    node = F.struct("case_id", "id")
    seed = 0
    while True:
        found = nodes.groupBy(_number("id", seed).alias("v")).agg(F.min(node).alias("low"), F.max(node).alias("high"))
        names = cut_lineage(found.select("v", "low.case_id", "low.id", (F.col("low") != F.col("high")).alias("shared")))
        if names.filter("shared").isEmpty():
            return names.drop("shared"), seed
        discard(names)
        seed += 1


def weak_components(pairs: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Members with their component's size and rank (largest first, smallest id on a tie)."""
    labels = component_labels(pairs, nodes)
    sizes = labels.groupBy("case_id", "component").agg(F.count(F.lit(1)).alias("size"))
    ranked = with_row_number(sizes, ["case_id"], [F.desc("size"), F.asc("component")], "rank")
    pad = F.when(F.col("rank") < 10, F.lit("0")).otherwise(F.lit(""))
    name = F.concat(F.lit("WCC-"), pad, F.col("rank").cast("string"))
    named = ranked.select("case_id", "component", "size", name.alias("component_id"))
    return labels.join(named, ["case_id", "component"]).select(*NODE, "component_id", "size")


def _spread(seed: DataFrame, links: DataFrame) -> DataFrame:
    """Fixed point of taking the largest label over incoming links (from_v, to_v)."""
    state = cut_lineage(seed)
    frontier = state
    while True:
        offers = links.join(frontier.select(F.col("v").alias("from_v"), "label"), "from_v")
        offers = offers.groupBy(F.col("to_v").alias("v")).agg(F.max("label").alias("offer"))
        done, frontier = frontier, cut_lineage(offers.join(state, "v").filter("offer > label").select("v", F.col("offer").alias("label")))
        if done is not state:
            discard(done)
        if frontier.isEmpty():
            return state
        fresh = frontier.withColumnRenamed("label", "fresh")
        before, state = state, cut_lineage(state.join(fresh, "v", "left").select("v", F.coalesce("fresh", "label").alias("label")))
        if before is not frontier:
            discard(before)


def strong_labels(pairs: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Strong component of every node, named after its largest id."""
    labels, names = _strong_numbers(pairs, nodes)
    named = labels.join(names, "v")
    heads = named.groupBy("component").agg(F.max("id").alias("name"))
    return named.join(heads, "component").select(*NODE, F.col("name").alias("component"))


def _strong_numbers(pairs: DataFrame, nodes: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(v, component) of every node by 64-bit numbers, which tell cases apart too, and the nodes' names (v, case_id, id).

    Rounds of: contract chains (nodes with one way in and one out) to one link each, by
    doubling; peel nodes with no way in or no way out (each is a component); colour the
    rest with the largest number that reaches them, and take from each colour the nodes that
    can walk back to that one, so that every colour is a pivot.  In the end the nodes of a
    chain join the component of its two ends, if that is one, and else are their own.
    """
    named = cut_lineage(pairs.select(*PAIR))
    everyone = cut_lineage(project_nodes(nodes, named).select(*NODE))
    names, seed = _numbers_of(everyone)
    open_nodes = cut_lineage(everyone.select(_number("id", seed).alias("v")))
    links = named.filter((F.col("src_id") != F.col("tgt_id")) & F.col("case_id").isNotNull())
    links = cut_lineage(links.select(_number("src_id", seed).alias("from_v"), _number("tgt_id", seed).alias("to_v")))
    discard(named, everyone)
    pile = Pile(open_nodes.select("v", F.col("v").alias("component")))
    chains: list[DataFrame] = []
    while not open_nodes.isEmpty():
        hung, rings, links = _contract_chains(links)
        if hung is not None:
            chains.append(hung)
            pile.add(rings)
            gone = hung.select("v").unionByName(rings.select("v"))
            open_nodes = cut_lineage(open_nodes.join(gone, "v", "left_anti"))
        # Peel: a link stays while its start has a way in and its end a way out.
        while True:
            end = lambda column, out: F.struct(F.col(column).alias("v"), F.lit(out).alias("o"), F.lit(1 - out).alias("i"))
            ways = links.select(F.inline(F.array(end("from_v", 1), end("to_v", 0)))).groupBy("v").agg(F.max("o").alias("o"), F.max("i").alias("i"))
            ways = cut_lineage(ways)
            dead = ways.filter("o = 0 or i = 0")
            if dead.isEmpty():
                break
            before, links = links, cut_lineage(_without(links, dead))
            discard(before, ways)
        kept = ways.select("v")
        pile.add(open_nodes.join(kept, "v", "left_anti").select("v", F.col("v").alias("component")))
        open_nodes = kept
        if open_nodes.isEmpty():
            break
        # In buckets of their start: rounds shuffle labels, not links.
        before, links = links, bucketed(links, "from_v")
        discard(before)
        colour = _spread(open_nodes.select("v", F.col("v").alias("label")), links)
        ends = links.join(colour.select(F.col("v").alias("from_v"), F.col("label").alias("f")), "from_v")
        ends = ends.join(colour.select(F.col("v").alias("to_v"), F.col("label").alias("t")), "to_v")
        within = bucketed(ends.filter("f = t").select(F.col("to_v").alias("from_v"), F.col("from_v").alias("to_v")), "from_v")
        back = _spread(colour.select("v", F.when(F.col("v") == F.col("label"), 1).otherwise(0).alias("label")), within).filter("label = 1")
        taken = cut_lineage(colour.join(back.select("v"), "v", "left_semi").select("v", F.col("label").alias("component")))
        discard(within)
        pile.add(taken)
        open_nodes = cut_lineage(open_nodes.join(taken, "v", "left_anti"))
        before, links = links, cut_lineage(_within(links, open_nodes))
        discard(before)
    for hung in reversed(chains):
        known = pile.rows()
        head = known.select(F.col("v").alias("head"), F.col("component").alias("h"))
        tail = known.select(F.col("v").alias("tail"), F.col("component").alias("t"))
        placed = hung.join(head, "head").join(tail, "tail")
        pile.add(cut_lineage(placed.select("v", F.when(F.col("h") == F.col("t"), F.col("h")).otherwise(F.col("v")).alias("component"))))
    return pile.rows(), names


def _contract_chains(links: DataFrame) -> tuple[DataFrame | None, DataFrame | None, DataFrame]:
    """Nodes of chains with the chain's ends (v, head, tail), rings with their component, and the links left.

    Pointers to both ends double their reach with each round, so a chain takes as many
    rounds as its length has binary digits.  A ring has no ends: its pointers go round
    until the largest number on their way stops growing.
    """
    none = F.lit(None).cast("long")
    way = lambda v, tail, head: F.struct(F.col(v).alias("v"), tail.alias("tail"), head.alias("head"))
    ways = links.select(F.inline(F.array(way("from_v", F.col("to_v"), none), way("to_v", none, F.col("from_v")))))
    degrees = ways.groupBy("v").agg(F.count("tail").alias("o"), F.count("head").alias("i"), F.max("tail").alias("tail"), F.max("head").alias("head"))
    inner = cut_lineage(degrees.filter("o = 1 and i = 1").select("v", "head", "tail"))
    if inner.isEmpty():
        return None, None, links
    state = cut_lineage(inner.select("v", "head", "tail", F.col("v").alias("high"), F.lit(True).alias("open")))
    while True:
        forward = state.select(F.col("v").alias("tail"), F.col("tail").alias("tail_next"), F.col("high").alias("high_next"))
        backward = state.select(F.col("v").alias("head"), F.col("head").alias("head_next"))
        joined = state.join(forward, "tail", "left").join(backward, "head", "left")
        high = F.greatest("high", F.coalesce("high_next", "high"))
        still = F.col("tail_next").isNotNull() | F.col("head_next").isNotNull()
        joined = joined.select(
            "v", F.coalesce("head_next", "head").alias("head"), F.coalesce("tail_next", "tail").alias("tail"), high.alias("high"), still.alias("open"),
            (still & (high > F.col("high")) | (F.col("open") & ~still)).alias("moved"),
        )
        before, state = state, cut_lineage(joined)
        discard(before)
        if state.filter("moved").isEmpty():
            break
    # What is open when nothing moves goes round in a ring.
    rings = state.filter("open").select("v", F.col("high").alias("component"))
    hung = cut_lineage(state.filter("not open").select("v", "head", "tail"))
    bridges = hung.filter("head <> tail").select(F.col("head").alias("from_v"), F.col("tail").alias("to_v"))
    return hung, rings, cut_lineage(_without(links, inner).unionByName(bridges).distinct())


def _without(links: DataFrame, nodes: DataFrame) -> DataFrame:
    kept = links.join(nodes.select(F.col("v").alias("from_v")), "from_v", "left_anti")
    return kept.join(nodes.select(F.col("v").alias("to_v")), "to_v", "left_anti").select("from_v", "to_v")


def _within(links: DataFrame, nodes: DataFrame) -> DataFrame:
    kept = links.join(nodes.select(F.col("v").alias("from_v")), "from_v", "left_semi")
    return kept.join(nodes.select(F.col("v").alias("to_v")), "to_v", "left_semi").select("from_v", "to_v")


def strong_components(pairs: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Number of strong components per case and the size of the largest."""
    labels, names = _strong_numbers(pairs, nodes)
    sizes = labels.groupBy(F.col("component").alias("v")).agg(F.count(F.lit(1)).alias("size")).join(names, "v")
    return sizes.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("strongly_connected_count"), F.max("size").alias("largest_component_size")
    )


# --- neighbours and weighted paths ---------------------------------------------


def k_hop_neighbors(pairs: DataFrame, egos: DataFrame) -> DataFrame:
    """Directed one-hop and two-hop neighbours of each ego (case_id, id), ego excluded."""
    links = pairs.select(*PAIR).filter(F.col("src_id") != F.col("tgt_id"))
    ego = egos.select("case_id", F.col("id").alias("ego_id"))
    one = links.join(ego.select("case_id", "ego_id", F.col("ego_id").alias("src_id")), ["case_id", "src_id"])
    one = one.select("case_id", "ego_id", F.col("tgt_id").alias("id")).distinct()
    two = links.join(one.select("case_id", "ego_id", F.col("id").alias("src_id")), ["case_id", "src_id"])
    two = two.select("case_id", "ego_id", F.col("tgt_id").alias("id")).distinct()
    two = two.filter("id <> ego_id").join(one, ["case_id", "ego_id", "id"], "left_anti")
    return one.withColumn("hop", F.lit(1)).unionByName(two.withColumn("hop", F.lit(2)))


def top_two(ranks: DataFrame) -> DataFrame:
    """The two highest-ranked nodes of each case as (case_id, source_id, target_id)."""
    order = F.struct((-F.bround("pagerank", 6)).alias("r"), F.col("id"))
    best = ranks.groupBy("case_id").agg(F.min(order).alias("a"))
    rest = ranks.join(best.select("case_id", F.col("a.id").alias("id")), NODE, "left_anti")
    second = rest.groupBy("case_id").agg(F.min(order).alias("b"))
    return best.join(second, "case_id").select(
        "case_id", F.col("a.id").alias("source_id"), F.col("b.id").alias("target_id")
    )


def shortest_path_weighted(pairs: DataFrame, queries: DataFrame) -> DataFrame:
    """Cheapest directed path by distance 1 / weight for (case_id, source_id, target_id).

    Frontier relaxation: only nodes improved in the last round send offers, and
    offers that cannot beat the cost found for the target are dropped.
    """
    links = cut_lineage(pairs.select(*PAIR, "dist"))
    goal = ["case_id", "source_id", "target_id"]
    state = cut_lineage(
        queries.select(*goal, F.col("source_id").alias("id"), F.lit(0.0).alias("cost"), F.array("source_id").alias("path"))
    )
    frontier = state
    while not frontier.isEmpty():
        bound = state.filter("id = target_id").select(*goal, F.col("cost").alias("bound"))
        offers = links.join(frontier.withColumnRenamed("id", "src_id"), ["case_id", "src_id"])
        offers = offers.select(
            *goal, F.col("tgt_id").alias("id"), F.bround(F.col("cost") + F.col("dist"), 12).alias("cost"),
            F.array_append("path", F.col("tgt_id")).alias("path"),
        )
        offers = offers.join(bound, goal, "left").filter("bound is null or cost < bound")
        best = offers.groupBy(*goal, "id").agg(F.min(F.struct("cost", F.size("path").alias("hops"), "path")).alias("o"))
        known = state.select(*goal, "id", F.col("cost").alias("known"))
        better = best.join(known, [*goal, "id"], "left").filter("known is null or o.cost < known")
        frontier = cut_lineage(better.select(*goal, "id", "o.cost", "o.path"))
        state = cut_lineage(state.join(frontier.select(*goal, "id"), [*goal, "id"], "left_anti").unionByName(frontier))
    hit = state.filter("id = target_id").select(*goal, "cost", "path")
    return queries.join(hit, goal, "left").select(
        *goal,
        F.col("path").isNotNull().alias("path_exists"),
        F.array_join("path", ">").alias("path"),
        F.when(F.col("path").isNull(), 0).otherwise(F.size("path") - 1).alias("hop_count"),
        F.bround("cost", 6).alias("total_cost"),
    )


# --- time patterns and empty cases ---------------------------------------------


def event_time(sent: Column, received: Column, observed: Column) -> Column:
    """Epoch seconds used for a communication: its own time, else sent, else received."""
    return F.coalesce(observed, sent, received)


def timestamp_summary(stamps: DataFrame) -> DataFrame:
    """Count, first and last of the positive epoch seconds (case_id, epoch) of each case."""
    valid = stamps.filter(F.col("epoch") > 0)
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    summary = valid.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("total_events"),
        F.min("epoch").cast("long").alias("earliest_timestamp"),
        F.max("epoch").cast("long").alias("latest_timestamp"),
    )
    def text(name: str) -> Column:
        return F.concat(F.date_format(F.timestamp_seconds(name), iso), F.lit("+00:00"))

    return summary.withColumn("earliest_iso", text("earliest_timestamp")).withColumn("latest_iso", text("latest_timestamp"))


def timestamp_patterns(stamps: DataFrame) -> DataFrame:
    """Month counts and a full 24-hour histogram, as (case_id, kind, period, count)."""
    valid = stamps.filter(F.col("epoch") > 0).withColumn("at", F.timestamp_seconds("epoch"))
    months = valid.groupBy("case_id", F.date_format("at", "yyyy-MM").alias("period")).agg(F.count(F.lit(1)).alias("count"))
    hours = valid.groupBy("case_id", F.hour("at").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    grid = hours.select("case_id").distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    full = grid.join(hours, ["case_id", "hour"], "left").select(
        "case_id", F.lit("HOUR").alias("kind"), F.lpad(F.col("hour").cast("string"), 2, "0").alias("period"),
        F.coalesce("n", F.lit(0).cast("long")).alias("count"),
    )
    return months.select("case_id", F.lit("MONTH").alias("kind"), "period", "count").unionByName(full)


def empty_case_summary(cases: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node, edge and pair totals of every case; cases without nodes or edges are marked empty."""
    n = nodes.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    pair_rows = edges.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("w"))
    e = pair_rows.groupBy("case_id").agg(F.sum("w").alias("e"), F.count(F.lit(1)).alias("p"))
    zero = F.lit(0).cast("long")
    joined = cases.select("case_id").join(n, "case_id", "left").join(e, "case_id", "left")
    empty = F.col("n").isNull() | F.col("e").isNull()
    return joined.select(
        "case_id",
        empty.alias("is_empty"),
        F.coalesce("n", zero).alias("total_nodes"),
        F.coalesce("e", zero).alias("total_raw_edges"),
        F.when(empty, zero).otherwise(F.coalesce("p", zero)).alias("unique_directed_pairs"),
    )
