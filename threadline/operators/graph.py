"""Case graph: nodes, edges, provenance, consolidation, layers and lookups.

Edges are rows (case_id, src_id, tgt_id, src_label, tgt_label, rel_label,
evidence_id, confidence, rel_id), a multigraph that is never pre-deduplicated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.functions import ids
from threadline.operators import scoring
from threadline.schemas import EDGE_TRIPLES, REVIEW_STATUSES
from threadline.session import cut_lineage

NODE_KEY = ["case_id", "id"]
PAIR_KEY = ["case_id", "src_id", "tgt_id"]
#: Hashes of repeated relationship ids that are looked up; with more, all rows are grouped.
REPEATED = 500_000


# --- nodes and edges -----------------------------------------------------------


def node_upsert(existing: DataFrame, incoming: DataFrame, additive: bool = False) -> DataFrame:
    """Merge node tables (case_id, id, entity_type, canonical_name, observed_count).

    By default the incoming count replaces the stored one, so a re-run changes
    nothing; ``additive`` adds the counts.
    """
    tagged = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    newest = F.max(F.struct("_new", "entity_type", "canonical_name", "observed_count")).alias("n")
    merged = tagged.groupBy(*NODE_KEY).agg(newest, F.sum("observed_count").alias("total"))
    count = F.col("total") if additive else F.col("n.observed_count")
    return merged.select(*NODE_KEY, "n.entity_type", "n.canonical_name", count.alias("observed_count"))


def edge_dedupe(batch: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One edge per (source, relation, target, evidence), none that is already stored."""
    key = ["case_id", "src_id", "rel_label", "tgt_id", "evidence_id"]
    rest = [name for name in batch.columns if name not in key]
    lead = [name for name in ("rel_id",) if name in rest]
    packed = F.min(F.struct(*lead, *[name for name in rest if name not in lead])).alias("e")
    once = batch.groupBy(*key).agg(packed).select(*key, *[f"e.{name}" for name in rest]).select(*batch.columns)
    if existing is None:
        return once
    return once.join(existing.select(*key).distinct(), key, "left_anti")


def legal_triple(relation: Column, source: Column, target: Column) -> Column:
    """Whether the relation may join these labels, as a constant lookup."""
    known = F.array(*[F.lit("|".join(triple)) for triple in EDGE_TRIPLES])
    return F.array_contains(known, F.concat_ws("|", relation, source, target))


def edge_schema_check(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every edge with a reject reason, null where it may be stored."""
    legal = legal_triple(F.col("rel_label"), F.col("src_label"), F.col("tgt_label"))
    # What the labels decide is not looked up.
    illegal = edges.filter(~legal).select(*edges.columns, F.lit("ILLEGAL_TRIPLE").alias("reject_reason"))
    present = nodes.select("case_id", "id").distinct()
    checked = (
        edges.filter(F.coalesce(legal, F.lit(True)))
        .join(present.select("case_id", F.col("id").alias("src_id"), F.lit(True).alias("_s")), ["case_id", "src_id"], "left")
        .join(present.select("case_id", F.col("id").alias("tgt_id"), F.lit(True).alias("_t")), ["case_id", "tgt_id"], "left")
    )
    reason = F.when(F.col("_s").isNull(), "UNKNOWN_SOURCE").when(F.col("_t").isNull(), "UNKNOWN_TARGET")
    return checked.select(*edges.columns, reason.alias("reject_reason")).unionByName(illegal)


def provenance_records(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """One record per entity, per relationship and per ordered pair (lowest relationship id)."""
    entity = entities.select(
        "case_id", F.col("canonical_entity_id").alias("resource_id"), F.lit("ENTITY").alias("resource_type"),
        F.to_json(F.struct(*[name for name in entities.columns if name != "case_id"])).alias("provenance"),
    )
    payload = [name for name in relationships.columns if name not in ("case_id",)]
    relation = _first_records(relationships, payload)
    first = relationships.groupBy(*PAIR_KEY).agg(
        F.min(F.struct("rel_id", *[name for name in payload if name not in ("rel_id", "src_id", "tgt_id")])).alias("r")
    )
    pair = first.select(
        "case_id",
        F.concat(F.lit("PAIR:"), "src_id", F.lit("->"), "tgt_id").alias("resource_id"),
        F.lit("RELATIONSHIP_PAIR").alias("resource_type"),
        F.to_json("r").alias("provenance"),
    )
    return entity.unionByName(relation).unionByName(pair)


def _first_records(relationships: DataFrame, payload: list[str]) -> DataFrame:
    """The least record of each relationship id.

    Ids repeat only where evidence was ingested again, so they are told apart by a hash first
    and just the rows whose hash repeats are grouped, unless those hashes are too many.
    """
    key = F.xxhash64("case_id", "rel_id")
    repeated = cut_lineage(relationships.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_key"))
    records = relationships.select(
        "case_id", F.col("rel_id").alias("resource_id"), F.lit("RELATIONSHIP").alias("resource_type"),
        F.to_json(F.struct(*payload)).alias("provenance"), key.alias("_key"),
    )
    least = lambda rows: rows.groupBy("case_id", "resource_id", "resource_type").agg(F.min("provenance").alias("provenance"))
    if repeated.limit(REPEATED + 1).count() > REPEATED:
        return least(records)
    single = records.join(repeated, "_key", "left_anti").drop("_key")
    return single.unionByName(least(records.join(repeated, "_key", "left_semi")))


def case_nodes(nodes: DataFrame, bindings: DataFrame) -> DataFrame:
    """Nodes bound to their case by the resource table (resource_id, case_id)."""
    owners = bindings.select(F.col("resource_id").alias("id"), "case_id")
    owned = nodes.join(owners, ["id", "case_id"], "left_semi")
    role = F.when(F.col("entity_type") == "Person", "Contact Lead").otherwise(F.col("entity_type"))
    return owned.withColumn("role", role)


def relation_rank(relation: Column, source: Column, target: Column) -> Column:
    """Reading order of the edge tables; it decides which type counts as first."""
    rank = F.lit(len(EDGE_TRIPLES))
    for index in range(len(EDGE_TRIPLES) - 1, -1, -1):
        name, src, tgt = EDGE_TRIPLES[index]
        same = (relation == name) & (source == src) & (target == tgt)
        rank = F.when(same, F.lit(index)).otherwise(rank)
    return rank


def case_edges(edges: DataFrame, review: DataFrame | None = None) -> DataFrame:
    """One row per ordered pair: count, types, strongest confidence, evidence, summary.

    The set of types travels as a bit mask and the evidence as a distinct count, so
    a pair with very many edges needs no array of them; ``edge_breakdown`` lists them.
    """
    inside = edges.filter(F.col("src_id") != F.col("tgt_id"))
    rank = relation_rank(F.col("rel_label"), F.col("src_label"), F.col("tgt_label"))
    confidence = F.coalesce(F.nullif(F.col("confidence"), F.lit(0.0)), F.lit(1.0))
    seen = F.max("observed_at").alias("last_seen") if "observed_at" in edges.columns else F.lit(None).cast("timestamp").alias("last_seen")
    grouped = inside.withColumn("_bit", F.pow(F.lit(2), rank).cast("int")).groupBy(*PAIR_KEY).agg(
        F.count(F.lit(1)).alias("interaction_count"),
        F.bit_or("_bit").alias("_types"),
        F.max(confidence).alias("confidence"),
        F.count_distinct("evidence_id").alias("evidence_count"),
        F.min("evidence_id").alias("first_evidence_id"),
        F.min("rel_id").alias("rel_id"),
        seen,
    )
    names = F.array(*[F.lit(name) for name, _, _ in EDGE_TRIPLES], F.lit("OTHER"))
    types = F.array_distinct(
        F.filter(names, lambda name, index: F.col("_types").bitwiseAND(F.pow(F.lit(2), index).cast("int")) != 0)
    )
    result = grouped.withColumn("distinct_types", types)
    many = F.size("distinct_types") > 1
    first = F.get("distinct_types", F.lit(0))
    summary = (
        F.when(many, F.concat(F.size("distinct_types").cast("string"), F.lit(" Link Types ("), F.col("interaction_count").cast("string"), F.lit(" Connections)")))
        .when(F.col("interaction_count") > 1, F.concat(first, F.lit(" ("), F.col("interaction_count").cast("string"), F.lit("x)")))
        .otherwise(first)
    )
    result = result.select(
        F.concat(F.lit("EDGE-"), "case_id", F.lit("-"), ids.short(ids.digest(F.col("case_id"), F.col("src_id"), F.col("tgt_id")), 12)).alias("edge_id"),
        "rel_id", *PAIR_KEY,
        first.alias("first_type"),
        F.when(many, "MULTI_LINK").otherwise(first).alias("relationship_type"),
        summary.alias("relationship"),
        "distinct_types", "interaction_count", "confidence", "evidence_count", "first_evidence_id", "last_seen",
    )
    if review is None:
        return result.withColumn("human_verification_status", F.lit("UNDER_REVIEW"))
    return review_overlay(result, "edge_id", review)


def edge_breakdown(edges: DataFrame) -> DataFrame:
    """Per pair, relation and evidence: count and strongest confidence."""
    return (
        edges.filter(F.col("src_id") != F.col("tgt_id"))
        .groupBy(*PAIR_KEY, "rel_label", "evidence_id")
        .agg(F.count(F.lit(1)).alias("connections"), F.max("confidence").alias("confidence"))
    )


def edge_overview(edges: DataFrame, subject: str) -> DataFrame:
    """Consolidated edges scored with fixed inputs that favour one subject."""
    overview = case_edges(edges)
    near = (F.col("src_id") == subject) | (F.col("tgt_id") == subject)
    score = scoring.association_score(
        F.col("first_type"),
        F.when(near, 15).otherwise(5),
        F.when(near, 2.0).otherwise(14.0),
        F.when(F.col("confidence") >= 0.90, 3).otherwise(1),
        F.col("confidence"),
        F.lit(True),
    )
    scored = overview.withColumn("ccc_score", score)
    scored = scored.withColumn("ccc_ring", scoring.ring(F.col("ccc_score")))
    return scored.withColumn("is_consolidated", F.col("interaction_count") > 1)


# --- layers, neighbours, paths -------------------------------------------------


def undirected(pairs: DataFrame) -> DataFrame:
    """Both directions of each pair, as (case_id, node, other)."""
    forward = pairs.select("case_id", F.col("src_id").alias("node"), F.col("tgt_id").alias("other"))
    return forward.unionByName(forward.select("case_id", F.col("other").alias("node"), F.col("node").alias("other")))


def anchor_layers(nodes: DataFrame, pairs: DataFrame, anchors: DataFrame) -> DataFrame:
    """Layer 0 to 3 of every node by distance from the case's anchor.

    An anchor without edges gives way to the node with most edges (smallest id on a tie).
    """
    links = undirected(pairs.filter(F.col("src_id") != F.col("tgt_id")))
    degree = links.groupBy("case_id", "node").agg(F.count(F.lit(1)).alias("degree"))
    anchor = anchors.select("case_id", F.col("anchor_id").alias("node")).withColumn("_a", F.lit(True))
    ranked = degree.join(anchor, ["case_id", "node"], "left")
    best = F.min(F.struct(F.when(F.col("_a"), 0).otherwise(1), (-F.col("degree")), "node")).alias("best")
    roots = ranked.groupBy("case_id").agg(best).select("case_id", F.col("best.node").alias("root"))
    roots = anchors.select("case_id", "anchor_id").join(roots, "case_id", "full_outer").select(
        "case_id", F.coalesce("root", "anchor_id").alias("root")
    )
    start = roots.select("case_id", F.col("root").alias("node"))
    one = links.join(start, ["case_id", "node"], "left_semi").select("case_id", F.col("other").alias("node")).distinct()
    two = links.join(one, ["case_id", "node"], "left_semi").select("case_id", F.col("other").alias("node")).distinct()
    layer = start.withColumn("layer", F.lit(0))
    layer = layer.unionByName(one.withColumn("layer", F.lit(1))).unionByName(two.withColumn("layer", F.lit(2)))
    nearest = layer.groupBy("case_id", F.col("node").alias("id")).agg(F.min("layer").alias("layer"))
    placed = nodes.join(nearest, NODE_KEY, "left").withColumn("layer", F.coalesce("layer", F.lit(3)))
    return placed.withColumn("is_anchor", F.col("layer") == 0)


def anchor_fallback(cases: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes plus the anchor of each case where it is missing; cases without one get a placeholder."""
    name = F.coalesce("anchor_name", F.lit("Case Anchor"))
    anchor = cases.select(
        "case_id",
        F.coalesce("anchor_id", F.concat(F.lit("ANCHOR-"), "case_id")).alias("id"),
        F.lit("Person").alias("entity_type"),
        name.alias("canonical_name"),
        F.lit(0).cast("long").alias("observed_count"),
    )
    missing = anchor.join(nodes.select(*NODE_KEY), NODE_KEY, "left_anti")
    known = nodes.select("case_id", "id", "entity_type", "canonical_name", "observed_count")
    empty = cases.select("case_id").join(nodes.select("case_id").distinct(), "case_id", "left_anti")
    marked = known.withColumn("is_empty", F.lit(False)).unionByName(
        missing.join(empty.withColumn("is_empty", F.lit(True)), "case_id", "left").withColumn(
            "is_empty", F.coalesce("is_empty", F.lit(False))
        )
    )
    return marked


def k_hop_undirected(pairs: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """Nodes within ``hops`` of each case's start node, with the distance, start excluded.

    Every step joins edges with the last level only; ``pairs`` may be raw edges.
    """
    links = undirected(pairs)
    reached = starts.select("case_id", F.col("id").alias("node")).withColumn("distance", F.lit(0))
    frontier = reached
    for step in range(1, hops + 1):
        near = links.join(frontier.select("case_id", "node"), ["case_id", "node"], "left_semi")
        near = near.select("case_id", F.col("other").alias("node")).distinct()
        frontier = near.join(reached, ["case_id", "node"], "left_anti").withColumn("distance", F.lit(step))
        frontier = cut_lineage(frontier)
        reached = reached.unionByName(frontier)
    return reached.filter("distance > 0").select("case_id", F.col("node").alias("id"), "distance")


def k_hop_directed(pairs: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """Nodes at the end of a directed walk of exactly ``hops`` steps; ``pairs`` may be raw edges."""
    frontier = starts.select("case_id", F.col("id").alias("src_id"))
    for _ in range(hops):
        step = pairs.select(*PAIR_KEY).join(frontier, ["case_id", "src_id"], "left_semi")
        frontier = step.select("case_id", F.col("tgt_id").alias("src_id")).distinct()
    return frontier.select("case_id", F.col("src_id").alias("id"))


def _one(spark: SparkSession, node: str) -> DataFrame:
    return spark.range(1).select(F.lit(node).alias("node"), F.array(F.lit(node)).alias("path"))


def shortest_path_unweighted(pairs: DataFrame, source: str, target: str, case_id: str) -> DataFrame:
    """Fewest-hop path, direction ignored; length -1 when there is none.

    The search grows from both ends, a whole level at a time on the smaller side, and
    joins edges with that level only; ``pairs`` may be raw edges.
    """
    links = undirected(pairs.filter(F.col("case_id") == case_id)).select("node", "other")
    spark = pairs.sparkSession
    fronts = [_one(spark, source), _one(spark, target)]
    seen, sizes = list(fronts), [1, 1]
    met = fronts[0].join(fronts[1].withColumnRenamed("path", "back"), "node")
    while met.isEmpty():
        side = 0 if sizes[0] <= sizes[1] else 1
        stepped = links.join(fronts[side], "node").groupBy(F.col("other").alias("node")).agg(F.min("path").alias("path"))
        stepped = stepped.join(seen[side], "node", "left_anti")
        fronts[side] = cut_lineage(stepped.select("node", F.array_append("path", F.col("node")).alias("path")))
        sizes[side] = fronts[side].count()
        if not sizes[side]:
            break
        seen[side] = seen[side].unionByName(fronts[side])
        ahead, behind = (fronts[0], seen[1]) if side == 0 else (seen[0], fronts[1])
        met = ahead.join(behind.withColumnRenamed("path", "back"), "node")
    # The way back ends where the way there ends.
    whole = F.concat("path", F.slice(F.reverse("back"), F.lit(2), F.greatest(F.size("back") - 1, F.lit(0))))
    best = met.select(F.struct(F.size(whole).alias("n"), whole.alias("path")).alias("r")).agg(F.min("r").getField("path").alias("path"))
    return best.select(
        F.lit(source).alias("source_id"), F.lit(target).alias("target_id"),
        F.coalesce(F.size("path") - 1, F.lit(-1)).alias("path_length"), F.array_join("path", ">").alias("path_nodes"),
    )


# --- lookups and overlays ------------------------------------------------------


def entity_detail(nodes: DataFrame, provenance: DataFrame, case_id: str, entity_id: str, review: DataFrame | None = None) -> DataFrame:
    """One entity of the case with its evidence, or no row when the case does not own it."""
    own = nodes.filter((F.col("case_id") == case_id) & (F.col("id") == entity_id))
    facts = provenance.select("case_id", F.col("canonical_entity_id").alias("id"), "evidence_id", "evidence_count", "artifact_count", "observation_count")
    joined = own.join(facts, NODE_KEY, "left")
    if review is None:
        return joined.withColumn("human_verification_status", F.lit("UNDER_REVIEW"))
    return review_overlay(joined, "id", review)


def relationship_detail(relationships: DataFrame, consolidated: DataFrame, case_id: str, lookup: str | DataFrame) -> DataFrame:
    """Provenance chain of a relationship, found by relationship id or by edge id.

    ``lookup`` is an id or a table with a column ``lookup`` of ids.
    """
    asked = lookup if isinstance(lookup, DataFrame) else relationships.sparkSession.range(1).select(F.lit(lookup).alias("lookup"))
    edges = consolidated.filter(F.col("case_id") == case_id).select("case_id", "rel_id", F.explode(F.array("edge_id", "rel_id")).alias("lookup"))
    direct = relationships.filter(F.col("case_id") == case_id).select("case_id", "rel_id", F.col("rel_id").alias("lookup"))
    wanted = edges.unionByName(direct).join(asked, "lookup", "left_semi").select("case_id", "rel_id").distinct()
    chain = ["evidence_id", "artifact_id", "observation_id", "job_id", "source_location", "extraction_method"]
    available = [name for name in chain if name in relationships.columns]
    return relationships.join(wanted, ["case_id", "rel_id"], "left_semi").select(
        "case_id", "rel_id", "src_id", "tgt_id", "rel_label", *available
    )


def evidence_trace(edges: DataFrame, evidence: str) -> DataFrame:
    """Every edge an evidence item supports."""
    return edges.filter(F.col("evidence_id") == evidence).select(*PAIR_KEY, "rel_label", "evidence_id", "confidence")


def review_overlay(targets: DataFrame, id_column: str, decisions: DataFrame) -> DataFrame:
    """Latest valid human status per target: of the case first, else of the target anywhere.

    ``decisions`` has (case_id, target_id, status, decided_at).
    """
    valid = decisions.filter(F.col("status").isin(REVIEW_STATUSES))
    scoped = valid.groupBy("case_id", F.col("target_id").alias(id_column)).agg(F.max(F.struct("decided_at", "status")).alias("_c"))
    anywhere = valid.groupBy(F.col("target_id").alias(id_column)).agg(F.max(F.struct("decided_at", "status")).alias("_g"))
    joined = targets.join(scoped, ["case_id", id_column], "left").join(anywhere, id_column, "left")
    status = F.coalesce("_c.status", "_g.status", F.lit("UNDER_REVIEW"))
    return joined.select(*targets.columns, status.alias("human_verification_status"))


def review_rejects(decisions: DataFrame) -> DataFrame:
    """Decisions with a status that does not exist."""
    return decisions.filter(~F.col("status").isin(REVIEW_STATUSES) | F.col("status").isNull())


def label_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts per node label and per relation triple."""
    node = nodes.groupBy(F.col("entity_type").alias("label")).agg(F.count(F.lit(1)).alias("count"))
    triple = F.concat(F.col("src_label"), F.lit("-"), F.col("rel_label"), F.lit("->"), F.col("tgt_label"))
    edge = edges.groupBy(triple.alias("label")).agg(F.count(F.lit(1)).alias("count"))
    return node.withColumn("kind", F.lit("NODE")).unionByName(edge.withColumn("kind", F.lit("EDGE")))


def anchor_link(nodes: DataFrame, anchors: DataFrame, evidence: str) -> DataFrame:
    """Edges from each case's anchor to all its phones and addresses."""
    relation = F.when(F.col("entity_type") == "PhoneNumber", "USED_PHONE").otherwise("USED_EMAIL")
    ends = nodes.filter(F.col("entity_type").isin("PhoneNumber", "Email"))
    return ends.join(anchors.select("case_id", "anchor_id"), "case_id").select(
        "case_id",
        F.col("anchor_id").alias("src_id"),
        F.col("id").alias("tgt_id"),
        F.lit("Person").alias("src_label"),
        F.col("entity_type").alias("tgt_label"),
        relation.alias("rel_label"),
        F.lit(evidence).alias("evidence_id"),
        F.lit(0.95).alias("confidence"),
    )


def case_counts(cases: DataFrame, evidence: DataFrame, artifacts: DataFrame, provenance: DataFrame) -> DataFrame:
    """Evidence, entity and relationship counts; artifacts stand in for evidence when there are any."""
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("case_id").agg(F.count(F.lit(1)).alias(name))

    entities = count(provenance.filter("resource_type = 'ENTITY'"), "_n")
    relations = count(provenance.filter("resource_type = 'RELATIONSHIP'"), "_r")
    joined = (
        cases.select("case_id")
        .join(count(evidence, "_e"), "case_id", "left")
        .join(count(artifacts, "_a"), "case_id", "left")
        .join(entities, "case_id", "left")
        .join(relations, "case_id", "left")
    )
    zero = F.lit(0).cast("long")
    return joined.select(
        "case_id",
        F.coalesce("_a", "_e", zero).alias("evidence_count"),
        F.coalesce("_n", zero).alias("entity_count"),
        F.coalesce("_r", zero).alias("relationship_count"),
    )

