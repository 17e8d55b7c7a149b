"""Case graph, scoring and analytics queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadline.operators import analytics, centrality, communities, graph, overview, scoring
from threadline.plans.registry import Inputs, query

# --- SQL twins of shared steps -------------------------------------------------

_PAIRS = "SELECT case_id, src_id, tgt_id, count(*) AS weight FROM links GROUP BY ALL"
_RANK = "CASE rel_label WHEN 'COMMUNICATED_WITH' THEN 1 WHEN 'ASSOCIATED_WITH' THEN 2 ELSE 3 END"
_CASE_EDGES = f"""SELECT case_id, src_id, tgt_id, count(*) AS n, count(DISTINCT rel_label) AS types, max(confidence) AS confidence,
    count(DISTINCT evidence_id) AS evidence_count, min(evidence_id) AS first_evidence_id, min(rel_id) AS rel_id, arg_min(rel_label, {_RANK}) AS first_type,
    string_agg(DISTINCT rel_label, ',') AS any_types, max(observed_at) AS last_seen FROM links WHERE src_id <> tgt_id GROUP BY case_id, src_id, tgt_id"""


def _score(frequency: str, days: str, sources: str, confidence: str, kind: str, valid: str = "true") -> str:
    base = (
        f"CASE {kind} WHEN 'CALLED' THEN 1e0 WHEN 'USED_PHONE' THEN 0.8e0 WHEN 'USED_VEHICLE' THEN 0.75e0 WHEN 'ASSOCIATED_WITH' THEN 0.65e0 "
        "WHEN 'CONNECTED_TO' THEN 0.5e0 ELSE 0.4e0 END"
    )
    raw = (
        f"(25e0 * {base} + 25e0 * least(1e0, ln(1 + {frequency}) / ln(15e0)) + 25e0 * exp(-({days}) / 30e0) + 25e0 * least(1e0, 0.25e0 + 0.25e0 * ({sources})))"
    )
    return (
        f"CAST(round_even(least(100e0, {raw} * greatest(0.5e0, least(1e0, {confidence})) * CASE WHEN {valid} THEN 1e0 ELSE 0.5e0 END), 0) AS INT)"
    )


def _ring(score: str) -> str:
    return f"CASE WHEN {score} > 75 THEN 'RED' WHEN {score} >= 41 THEN 'YELLOW' ELSE 'GREEN' END"


_SCORED = f"SELECT *, {_score('least(n * 4, 60)', '7e0', 'greatest(evidence_count, 1)', 'confidence', 'first_type')} AS score FROM ({_CASE_EDGES}) e"
_DEGREE = """SELECT case_id, id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(u) AS BIGINT) AS total_degree FROM (
    SELECT case_id, src_id AS id, 0 AS i, 1 AS o, 0 AS u FROM (SELECT DISTINCT case_id, src_id, tgt_id FROM links)
    UNION ALL SELECT case_id, tgt_id, 1, 0, 0 FROM (SELECT DISTINCT case_id, src_id, tgt_id FROM links)
    UNION ALL SELECT case_id, id, 0, 0, 1 FROM (SELECT case_id, unnest([a, b]) AS id FROM
      (SELECT DISTINCT case_id, least(src_id, tgt_id) AS a, greatest(src_id, tgt_id) AS b FROM links))) d GROUP BY 1, 2"""


def _pairs(t: Inputs, binding: str = "links") -> DataFrame:
    return analytics.project_graph(t.bound(binding))


# --- flagship ------------------------------------------------------------------


@query("top_links", f"""SELECT s.case_id, s.src_id, s.tgt_id, s.score AS ccc_score, ring AS ccc_ring, CAST(rank AS INT) AS rank, s.n AS interaction_count,
      a.total_degree AS src_degree, b.total_degree AS tgt_degree
    FROM (SELECT *, row_number() OVER (PARTITION BY case_id, ring ORDER BY score DESC, src_id, tgt_id) AS rank FROM (SELECT *, {_ring('score')} AS ring FROM ({_SCORED}) x) y) s
    JOIN ({_DEGREE}) a ON a.case_id = s.case_id AND a.id = s.src_id JOIN ({_DEGREE}) b ON b.case_id = s.case_id AND b.id = s.tgt_id WHERE rank <= 100""", "links")
def _(t: Inputs) -> DataFrame:
    """Best-scored links of every ring with both ends' degrees."""
    links = t.bound("links")
    best = scoring.ring_queue(scoring.ccc_score_edges(graph.case_edges(links)), 100)
    degrees = analytics.degree_metrics(analytics.project_graph(links)).select("case_id", "id", "total_degree")
    source = degrees.select("case_id", F.col("id").alias("src_id"), F.col("total_degree").alias("src_degree"))
    target = degrees.select("case_id", F.col("id").alias("tgt_id"), F.col("total_degree").alias("tgt_degree"))
    return best.join(source, ["case_id", "src_id"]).join(target, ["case_id", "tgt_id"]).select(
        "case_id", "src_id", "tgt_id", "ccc_score", "ccc_ring", "rank", "interaction_count", "src_degree", "tgt_degree"
    )


# --- nodes and edges -----------------------------------------------------------


@query("node_upsert", """SELECT case_id, id, CASE WHEN case_id = 'CASE-O' THEN observed_count + 5 ELSE observed_count END AS observed_count FROM nodes
    UNION ALL SELECT 'CASE-NEW', id, observed_count + 5 FROM nodes WHERE case_id = 'CASE-O'""", "nodes")
def _(t: Inputs) -> DataFrame:
    nodes = t.bound("nodes")
    fresh = nodes.filter("case_id = 'CASE-O'").withColumn("observed_count", F.col("observed_count") + 5)
    incoming = fresh.unionByName(fresh.withColumn("case_id", F.lit("CASE-NEW")))
    return graph.node_upsert(nodes, incoming).select("case_id", "id", "observed_count")


@query("node_upsert_additive", "SELECT case_id, id, observed_count * 2 AS observed_count FROM nodes", "nodes")
def _(t: Inputs) -> DataFrame:
    nodes = t.bound("nodes")
    return graph.node_upsert(nodes, nodes, additive=True).select("case_id", "id", "observed_count")


@query("edge_dedupe", """SELECT case_id, src_id, rel_label, tgt_id, evidence_id, min(rel_id) AS rel_id FROM links l
    WHERE NOT EXISTS (SELECT 1 FROM links x WHERE x.job_id = 'JOB-R' AND x.case_id = l.case_id AND x.src_id = l.src_id AND x.rel_label = l.rel_label AND x.tgt_id = l.tgt_id AND x.evidence_id = l.evidence_id)
    GROUP BY ALL""", "links")
def _(t: Inputs) -> DataFrame:
    links = t.bound("links")
    fresh = graph.edge_dedupe(links, links.filter("job_id = 'JOB-R'"))
    return fresh.select("case_id", "src_id", "rel_label", "tgt_id", "evidence_id", "rel_id")


@query("edge_schema_check", """SELECT rel_id, CASE WHEN lab = 'CALLED' THEN 'ILLEGAL_TRIPLE' WHEN starts_with(src_id, 'P') AND s.p_size > 40 THEN 'UNKNOWN_SOURCE'
      WHEN starts_with(tgt_id, 'P') AND g.p_size > 40 THEN 'UNKNOWN_TARGET' END AS reject_reason
    FROM (SELECT *, CASE job_id WHEN 'JOB-N' THEN 'CALLED' ELSE rel_label END AS lab FROM links) l
    LEFT JOIN part s ON 'P-' || s.p_partkey = l.src_id LEFT JOIN part g ON 'P-' || g.p_partkey = l.tgt_id""", "links")
def _(t: Inputs) -> DataFrame:
    links = t.bound("links").withColumn("rel_label", F.when(F.col("job_id") == "JOB-N", "CALLED").otherwise(F.col("rel_label")))
    known = t.bound("nodes").filter("id like 'S-%' or observed_count <= 40")
    return graph.edge_schema_check(links, known).select("rel_id", "reject_reason")


@query("provenance_records", """SELECT 'ENTITY' AS resource_type, case_id, id AS resource_id, id AS named, NULL AS evidence_id FROM nodes
      UNION ALL SELECT 'RELATIONSHIP', case_id, rel_id, rel_id, min(evidence_id) FROM links GROUP BY case_id, rel_id
      UNION ALL SELECT 'RELATIONSHIP_PAIR', case_id, 'PAIR:' || src_id || '->' || tgt_id, min(rel_id), arg_min(evidence_id, rel_id) FROM links GROUP BY case_id, src_id, tgt_id""", "links nodes")
def _(t: Inputs) -> DataFrame:
    entities = t.bound("nodes").withColumnRenamed("id", "canonical_entity_id")
    found = graph.provenance_records(entities, t.bound("links"))
    part = lambda name: F.get_json_object("provenance", f"$.{name}")
    named = F.when(F.col("resource_type") == "ENTITY", part("canonical_entity_id")).otherwise(part("rel_id"))
    return found.select("resource_type", "case_id", "resource_id", named.alias("named"), part("evidence_id").alias("evidence_id"))


@query("pair_provenance", """SELECT case_id, 'PAIR:' || src_id || '->' || tgt_id AS resource_id, min(rel_id) AS rel_id FROM links GROUP BY 1, 2""", "links")
def _(t: Inputs) -> DataFrame:
    """First relationship of every pair."""
    entities = t.bound("nodes").withColumnRenamed("id", "canonical_entity_id")
    found = graph.provenance_records(entities, t.bound("links")).filter("resource_type = 'RELATIONSHIP_PAIR'")
    return found.select("case_id", "resource_id", F.get_json_object("provenance", "$.rel_id").alias("rel_id"))


@query("case_nodes", "SELECT case_id, id, 'Contact Lead' AS role FROM nodes n WHERE (case_id = 'CASE-O') = (observed_count % 2 = 0)", "nodes")
def _(t: Inputs) -> DataFrame:
    nodes = t.bound("nodes")
    owner = F.when(F.col("observed_count") % 2 == 0, "CASE-O").otherwise("CASE-F")
    bindings = nodes.select(F.col("id").alias("resource_id"), owner.alias("case_id"))
    return graph.case_nodes(nodes, bindings).select("case_id", "id", "role")


@query("case_edges", f"""SELECT case_id, src_id, tgt_id, first_type, CASE WHEN types = 1 THEN first_type ELSE 'MULTI_LINK' END AS relationship_type,
      CASE WHEN types > 1 THEN types || ' Link Types (' || n || ' Connections)' WHEN n > 1 THEN first_type || ' (' || n || 'x)' ELSE first_type END AS relationship,
      CAST(types AS INT) AS type_count, n AS interaction_count, confidence, evidence_count, first_evidence_id, rel_id FROM ({_CASE_EDGES}) e""", "links")
def _(t: Inputs) -> DataFrame:
    return graph.case_edges(t.bound("links")).select(
        "case_id", "src_id", "tgt_id", "first_type", "relationship_type", "relationship", F.size("distinct_types").alias("type_count"),
        "interaction_count", "confidence", "evidence_count", "first_evidence_id", "rel_id",
    )


@query("edge_breakdown", "SELECT case_id, src_id, tgt_id, rel_label, evidence_id, count(*) AS connections, max(confidence) AS confidence FROM links GROUP BY 1, 2, 3, 4, 5", "links")
def _(t: Inputs) -> DataFrame:
    return graph.edge_breakdown(t.bound("links"))


_NEAR = "(src_id = 'S-7' OR tgt_id = 'S-7')"


@query("edge_overview", f"""SELECT case_id, src_id, tgt_id, {_score(f'CASE WHEN {_NEAR} THEN 15 ELSE 5 END', f'CASE WHEN {_NEAR} THEN 2e0 ELSE 14e0 END', 'CASE WHEN confidence >= 0.9 THEN 3 ELSE 1 END', 'confidence', 'first_type')} AS ccc_score,
      n > 1 AS is_consolidated FROM ({_CASE_EDGES}) e""", "links")
def _(t: Inputs) -> DataFrame:
    return graph.edge_overview(t.bound("links"), "S-7").select("case_id", "src_id", "tgt_id", "ccc_score", "is_consolidated")


# --- layers, neighbours, paths -------------------------------------------------

_BOTH = "SELECT DISTINCT case_id, src_id AS a, tgt_id AS b FROM links UNION SELECT DISTINCT case_id, tgt_id, src_id FROM links"
_OBOTH = "SELECT case_id, src_id AS a, tgt_id AS b FROM order_links UNION ALL SELECT case_id, tgt_id, src_id FROM order_links"


@query("anchor_layers", f"""WITH root AS (SELECT case_id, min(a) FILTER (a = 'C-5') AS anchor, arg_min(a, (-d, a)) AS busiest FROM (SELECT case_id, a, count(*) AS d FROM ({_OBOTH}) GROUP BY 1, 2) GROUP BY 1),
      r AS (SELECT case_id, coalesce(anchor, busiest) AS id FROM root),
      one AS (SELECT DISTINCT l.case_id, l.b AS id FROM ({_OBOTH}) l JOIN r ON r.case_id = l.case_id AND r.id = l.a),
      two AS (SELECT DISTINCT l.case_id, l.b AS id FROM ({_OBOTH}) l JOIN one ON one.case_id = l.case_id AND one.id = l.a)
    SELECT n.case_id, n.id, CAST(CASE WHEN r.id IS NOT NULL THEN 0 WHEN one.id IS NOT NULL THEN 1 WHEN two.id IS NOT NULL THEN 2 ELSE 3 END AS INT) AS layer
    FROM (SELECT DISTINCT case_id, a AS id FROM ({_OBOTH})) n LEFT JOIN r ON r.case_id = n.case_id AND r.id = n.id
      LEFT JOIN one ON one.case_id = n.case_id AND one.id = n.id LEFT JOIN two ON two.case_id = n.case_id AND two.id = n.id""", "order_links")
def _(t: Inputs) -> DataFrame:
    links = t.bound("order_links")
    pairs = analytics.project_graph(links)
    nodes = analytics.project_nodes(None, pairs)
    anchors = pairs.select("case_id").distinct().withColumn("anchor_id", F.lit("C-5"))
    return graph.anchor_layers(nodes, pairs, anchors).select("case_id", "id", "layer")


@query("anchor_fallback", """SELECT case_id, id, canonical_name, false AS is_empty FROM nodes UNION ALL SELECT 'CASE-O', 'X-1', 'Subject', false
    UNION ALL SELECT 'CASE-EMPTY', 'ANCHOR-CASE-EMPTY', 'Case Anchor', true""", "nodes")
def _(t: Inputs) -> DataFrame:
    cases = t.sql("""SELECT * FROM (VALUES ('CASE-O', 'X-1', 'Subject'), ('CASE-F', 'S-0', 'Known'), ('CASE-EMPTY', CAST(NULL AS STRING), CAST(NULL AS STRING))) v(case_id, anchor_id, anchor_name)""")
    return graph.anchor_fallback(cases, t.bound("nodes")).select("case_id", "id", "canonical_name", "is_empty")


@query("k_hop_undirected", f"""SELECT case_id, id, CAST(min(d) AS INT) AS distance FROM (WITH RECURSIVE hop(case_id, id, d) AS (SELECT DISTINCT case_id, 'C-5', 0 FROM order_links
      UNION SELECT l.case_id, l.b, d + 1 FROM hop JOIN ({_OBOTH}) l ON l.case_id = hop.case_id AND l.a = hop.id WHERE d < 3) SELECT * FROM hop) h WHERE id <> 'C-5' GROUP BY 1, 2""", "order_links")
def _(t: Inputs) -> DataFrame:
    links = t.bound("order_links")
    starts = links.select("case_id").distinct().withColumn("id", F.lit("C-5"))
    return graph.k_hop_undirected(links, starts, 3)


@query("k_hop_directed", f"""WITH p AS ({_PAIRS}), one AS (SELECT DISTINCT case_id, tgt_id AS id FROM p WHERE src_id = 'P-5'),
      two AS (SELECT DISTINCT p.case_id, p.tgt_id AS id FROM p JOIN one ON p.case_id = one.case_id AND p.src_id = one.id)
    SELECT DISTINCT p.case_id, p.tgt_id AS id FROM p JOIN two ON p.case_id = two.case_id AND p.src_id = two.id""", "links")
def _(t: Inputs) -> DataFrame:
    links = t.bound("links")
    starts = links.select("case_id").distinct().withColumn("id", F.lit("P-5"))
    return graph.k_hop_directed(links, starts, 3)


@query("shortest_path_unweighted", f"""SELECT 'P-3' AS source_id, 'P-90' AS target_id, CAST(coalesce(min(d), -1) AS INT) AS path_length FROM (WITH RECURSIVE hop(id, d) AS (SELECT 'P-3', 0
      UNION SELECT l.b, d + 1 FROM hop JOIN ({_BOTH}) l ON l.a = hop.id AND l.case_id = 'CASE-O' WHERE d < 6) SELECT * FROM hop) h WHERE id = 'P-90'""", "links")
def _(t: Inputs) -> DataFrame:
    return graph.shortest_path_unweighted(t.bound("links"), "P-3", "P-90", "CASE-O").select("source_id", "target_id", "path_length")


# --- lookups and overlays ------------------------------------------------------


@query("entity_detail", "SELECT case_id, id, canonical_name, observed_count, 'UNDER_REVIEW' AS human_verification_status FROM nodes WHERE case_id = 'CASE-O' AND id = 'P-7'", "nodes")
def _(t: Inputs) -> DataFrame:
    facts = t.bound("links").groupBy("case_id", F.col("src_id").alias("canonical_entity_id")).agg(
        F.min("evidence_id").alias("evidence_id"), F.count_distinct("evidence_id").alias("evidence_count"),
        F.count_distinct("artifact_id").alias("artifact_count"), F.count_distinct("observation_id").alias("observation_count"),
    )
    found = graph.entity_detail(t.bound("nodes"), facts, "CASE-O", "P-7")
    return found.select("case_id", "id", "canonical_name", "observed_count", "human_verification_status")


@query("relationship_detail", """SELECT case_id, rel_id, src_id, tgt_id, rel_label, evidence_id, artifact_id, observation_id, job_id FROM links
    WHERE case_id = 'CASE-O' AND rel_id = (SELECT min(rel_id) FROM links WHERE case_id = 'CASE-O' AND src_id = 'S-3' AND tgt_id = (SELECT min(tgt_id) FROM links WHERE case_id = 'CASE-O' AND src_id = 'S-3'))""", "links")
def _(t: Inputs) -> DataFrame:
    links = t.bound("links")
    # Only the edges of one source are consolidated.
    consolidated = graph.case_edges(links.filter("case_id = 'CASE-O' and src_id = 'S-3'"))
    wanted = consolidated.agg(F.min_by("edge_id", "tgt_id").alias("lookup"))
    return graph.relationship_detail(links, consolidated, "CASE-O", wanted)


@query("evidence_trace", "SELECT case_id, src_id, tgt_id, rel_label, confidence FROM links WHERE evidence_id = 'EV-77'", "links")
def _(t: Inputs) -> DataFrame:
    return graph.evidence_trace(t.bound("links"), "EV-77").drop("evidence_id")


_DECISIONS = """SELECT CASE WHEN event_id % 3 = 0 THEN 'CASE-O' ELSE 'CASE-F' END AS case_id, 'S-' || (user_id % 40) AS target_id,
    CASE event_type WHEN 'view' THEN 'HUMAN_VERIFIED_LEAD' WHEN 'click' THEN 'REJECTED_ASSOCIATION' WHEN 'error' THEN 'BOGUS' ELSE 'UNDER_REVIEW' END AS status, event_id AS decided_at FROM {events}"""
_DECIDED = _DECISIONS.replace("{events}", "events")


@query("review_overlay", f"""SELECT n.case_id, n.id, coalesce(c.s, g.s, 'UNDER_REVIEW') AS human_verification_status FROM nodes n
    LEFT JOIN (SELECT case_id, target_id, arg_max(status, decided_at) AS s FROM ({_DECIDED}) d WHERE status <> 'BOGUS' GROUP BY 1, 2) c ON c.case_id = n.case_id AND c.target_id = n.id
    LEFT JOIN (SELECT target_id, arg_max(status, decided_at) AS s FROM ({_DECIDED}) d WHERE status <> 'BOGUS' GROUP BY 1) g ON g.target_id = n.id""", "nodes")
def _(t: Inputs) -> DataFrame:
    return graph.review_overlay(t.bound("nodes"), "id", t.sql(_DECISIONS)).select("case_id", "id", "human_verification_status")


@query("review_rejects", f"SELECT target_id, decided_at FROM ({_DECIDED}) d WHERE status = 'BOGUS'")
def _(t: Inputs) -> DataFrame:
    return graph.review_rejects(t.sql(_DECISIONS)).select("target_id", "decided_at")


@query("label_counts", """SELECT entity_type AS label, count(*) AS count, 'NODE' AS kind FROM nodes GROUP BY 1
    UNION ALL SELECT 'Person-' || rel_label || '->Person', count(*), 'EDGE' FROM links GROUP BY rel_label""", "links nodes")
def _(t: Inputs) -> DataFrame:
    return graph.label_counts(t.bound("nodes"), t.bound("links"))


@query("anchor_link", """SELECT case_id, 'A-' || case_id AS src_id, id AS tgt_id, CASE WHEN starts_with(id, 'P') THEN 'USED_PHONE' ELSE 'USED_EMAIL' END AS rel_label FROM nodes WHERE starts_with(id, 'P') OR observed_count > 5""", "nodes")
def _(t: Inputs) -> DataFrame:
    kind = F.when(F.col("id").startswith("P"), "PhoneNumber").when(F.col("observed_count") > 5, "Email").otherwise("Person")
    nodes = t.bound("nodes").withColumn("entity_type", kind)
    anchors = nodes.select("case_id").distinct().withColumn("anchor_id", F.concat(F.lit("A-"), "case_id"))
    return graph.anchor_link(nodes, anchors, "EV-LINK").select("case_id", "src_id", "tgt_id", "rel_label")


@query("case_counts", """SELECT c.case_id, coalesce(a.n, e.n, 0) AS evidence_count, coalesce(p.n, 0) AS entity_count, coalesce(r.n, 0) AS relationship_count FROM cases c
    LEFT JOIN (SELECT 'CASE-' || (o_custkey % 25) AS case_id, count(*) AS n FROM orders GROUP BY 1) e ON e.case_id = c.case_id
    LEFT JOIN (SELECT 'CASE-' || (doc_id % 12) AS case_id, count(*) AS n FROM documents GROUP BY 1) a ON a.case_id = c.case_id
    LEFT JOIN (SELECT 'CASE-' || (p_partkey % 20) AS case_id, count(*) AS n FROM part GROUP BY 1) p ON p.case_id = c.case_id
    LEFT JOIN (SELECT 'CASE-' || (l_suppkey % 9) AS case_id, count(*) AS n FROM lineitem GROUP BY 1) r ON r.case_id = c.case_id""", "cases")
def _(t: Inputs) -> DataFrame:
    provenance = t.sql("SELECT 'CASE-' || (p_partkey % 20) AS case_id, 'ENTITY' AS resource_type FROM {part} UNION ALL SELECT 'CASE-' || (l_suppkey % 9), 'RELATIONSHIP' FROM {lineitem}")
    evidence = t.sql("SELECT 'CASE-' || (o_custkey % 25) AS case_id FROM {orders}")
    artifacts = t.sql("SELECT 'CASE-' || (doc_id % 12) AS case_id FROM {documents}")
    return graph.case_counts(t.bound("cases"), evidence, artifacts, provenance)


# --- scoring -------------------------------------------------------------------

_INPUTS = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 7 WHEN 0 THEN 'CALLED' WHEN 1 THEN 'USED_PHONE' WHEN 2 THEN 'USED_VEHICLE' WHEN 3 THEN 'ASSOCIATED_WITH' WHEN 4 THEN 'CONNECTED_TO'
    WHEN 5 THEN 'VISITED' ELSE 'OTHER' END AS rel_type, CAST(l_quantity AS INT) AS frequency, CAST(l_suppkey % 90 AS DOUBLE) AS days_elapsed, CAST(l_partkey % 5 AS INT) AS source_count,
    1e0 - l_discount * 6 AS er_confidence, l_returnflag <> 'R' AS provenance_valid FROM {lineitem}"""
_IN = _INPUTS.replace("{lineitem}", "lineitem")


@query("ccc_score", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, score AS association_score, {_ring('score')} AS concentric_ring FROM (SELECT *, {_score('frequency', 'days_elapsed', 'source_count', 'er_confidence', 'rel_type', 'provenance_valid')} AS score FROM ({_IN}) i) s")
def _(t: Inputs) -> DataFrame:
    return scoring.ccc_score(t.sql(_INPUTS)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "association_score", "concentric_ring")


@query("ccc_score_edges", f"SELECT case_id, src_id, tgt_id, score AS ccc_score, {_ring('score')} AS ccc_ring FROM ({_SCORED}) s", "links")
def _(t: Inputs) -> DataFrame:
    scored = scoring.ccc_score_edges(graph.case_edges(t.bound("links")))
    return scored.select("case_id", "src_id", "tgt_id", "ccc_score", "ccc_ring")


@query("ccc_score_edges_observed", f"SELECT case_id, src_id, tgt_id, {_score('n', 'greatest(0e0, (epoch(TIMESTAMP ' + chr(39) + '2002-01-01' + chr(39) + ') - epoch(last_seen)) / 86400e0)', 'greatest(evidence_count, 1)', 'confidence', 'first_type')} AS ccc_score FROM ({_CASE_EDGES}) e", "links")
def _(t: Inputs) -> DataFrame:
    scored = scoring.ccc_score_edges(graph.case_edges(t.bound("links")), "observed", F.lit("2002-01-01").cast("timestamp"))
    return scored.select("case_id", "src_id", "tgt_id", "ccc_score")


@query("ring_queue", f"""SELECT case_id, src_id, tgt_id, ring AS ccc_ring, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id, ring ORDER BY score DESC, src_id, tgt_id) AS rank
    FROM (SELECT *, {_ring('score')} AS ring FROM ({_SCORED}) x) y) z WHERE rank <= 25""", "links")
def _(t: Inputs) -> DataFrame:
    scored = scoring.ccc_score_edges(graph.case_edges(t.bound("links")))
    return scoring.ring_queue(scored, 25).select("case_id", "src_id", "tgt_id", "ccc_ring", "rank")


@query("score_explain", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'Relationship Type Weight: ' || rel_type || ' (Base: ' || CASE rel_type WHEN 'CALLED' THEN 100 WHEN 'USED_PHONE' THEN 80 WHEN 'USED_VEHICLE' THEN 75 WHEN 'ASSOCIATED_WITH' THEN 65
      WHEN 'CONNECTED_TO' THEN 50 ELSE 40 END || '%)|Frequency Count: ' || frequency || ' interactions recorded|Recency: Recorded ' || printf('%.1f', days_elapsed) || ' days ago (Decay: '
      || CAST(round_even(exp(-days_elapsed / 30e0) * 100, 0) AS INT) || '%)|Independent Sources: ' || source_count || ' distinct artifacts|Entity Resolution Match Confidence: ' || CAST(round_even(er_confidence * 100, 0) AS INT)
      || '%|Provenance Integrity: ' || CASE WHEN provenance_valid THEN 'Verified Cryptographic SHA-256' ELSE 'Unverified / Degraded' END AS explanation FROM ({_IN}) i""")
def _(t: Inputs) -> DataFrame:
    names = ("rel_type", "frequency", "days_elapsed", "source_count", "er_confidence", "provenance_valid")
    lines = scoring.score_explain(*[F.col(name) for name in names])
    return t.sql(_INPUTS).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(lines, "|").alias("explanation"))


@query("score_evaluate", f"""SELECT count(*) AS cases, count(*) FILTER (ok) AS passed, round(avg(ok::INT), 6) AS pass_rate FROM (SELECT {_ring('score')} = CASE WHEN rel_type = 'CALLED' THEN 'YELLOW' ELSE 'GREEN' END AND score >= 20 AS ok
    FROM (SELECT *, {_score('frequency', 'days_elapsed', 'source_count', 'er_confidence', 'rel_type', 'provenance_valid')} AS score FROM ({_IN}) i) s) e""")
def _(t: Inputs) -> DataFrame:
    scored = scoring.ccc_score(t.sql(_INPUTS))
    expected = scored.withColumn("expected_ring", F.when(F.col("rel_type") == "CALLED", "YELLOW").otherwise("GREEN"))
    expected = expected.withColumn("min_expected_score", F.lit(20)).withColumn("max_expected_score", F.lit(None).cast("int"))
    return scoring.score_evaluate(expected).select("cases", "passed", F.round("pass_rate", 6).alias("pass_rate"))


# --- analytics -----------------------------------------------------------------


@query("project_graph", "SELECT case_id, src_id, tgt_id, count(*) AS weight, count(DISTINCT evidence_id) AS evidence_count, min(rel_id) AS sample_edge_id, round(1e0 / count(*), 6) AS dist FROM links GROUP BY 1, 2, 3", "links")
def _(t: Inputs) -> DataFrame:
    return _pairs(t).withColumn("dist", F.round("dist", 6))


@query("undirected_weights", "SELECT case_id, least(src_id, tgt_id) AS a, greatest(src_id, tgt_id) AS b, count(*) AS weight FROM links GROUP BY 1, 2, 3", "links")
def _(t: Inputs) -> DataFrame:
    return analytics.undirected_weights(_pairs(t))


@query("degree_metrics", f"SELECT n.case_id, n.id, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree, coalesce(total_degree, 0) AS total_degree FROM nodes n LEFT JOIN ({_DEGREE}) d ON d.case_id = n.case_id AND d.id = n.id", "links nodes")
def _(t: Inputs) -> DataFrame:
    return analytics.degree_metrics(_pairs(t), t.bound("nodes")).drop("unique_neighbors")


@query("degree_centrality", f"""SELECT d.case_id, d.id, d.out_degree, round((in_degree + out_degree) / (n - 1)::DOUBLE, 6) AS degree_centrality FROM ({_DEGREE}) d
    JOIN (SELECT case_id, count(*) AS n FROM ({_DEGREE}) GROUP BY 1) s ON s.case_id = d.case_id""", "links")
def _(t: Inputs) -> DataFrame:
    return analytics.degree_centrality(_pairs(t)).withColumn("degree_centrality", F.round("degree_centrality", 6))


@query("weighted_frequency", f"SELECT *, count(*) OVER (PARTITION BY case_id) AS unique_pairs, max(weight) OVER (PARTITION BY case_id) AS max_frequency FROM ({_PAIRS}) p", "links")
def _(t: Inputs) -> DataFrame:
    return analytics.weighted_frequency(_pairs(t)).drop("evidence_count", "sample_edge_id")


_PR = """WITH RECURSIVE p AS (SELECT case_id, src_id, tgt_id, count(*)::DOUBLE AS w FROM links GROUP BY 1, 2, 3), tot AS (SELECT case_id, src_id AS id, sum(w) AS t FROM p GROUP BY 1, 2),
      v AS (SELECT DISTINCT case_id, id FROM nodes), nn AS (SELECT case_id, count(*) AS n FROM v GROUP BY 1),
      lk AS (SELECT p.case_id, p.src_id, p.tgt_id, p.w / tot.t AS share FROM p JOIN tot ON tot.case_id = p.case_id AND tot.id = p.src_id),
      base AS (SELECT v.case_id, v.id, nn.n, tot.t IS NULL AS dangling FROM v JOIN nn ON nn.case_id = v.case_id LEFT JOIN tot ON tot.case_id = v.case_id AND tot.id = v.id),
      it(step, case_id, id, n, dangling, r, prev) AS (SELECT 0, case_id, id, n, dangling, 1e0 / n, 0e0 FROM base
        UNION ALL SELECT any_value(s.step) + 1, s.case_id, s.id, any_value(s.n), any_value(s.dangling),
          0.85e0 * (sum(s.flow) + any_value(l.lost) / any_value(s.n)) + 0.15e0 / any_value(s.n), max(s.r)
        FROM (SELECT step, case_id, id, n, dangling, r, 0e0 AS flow FROM it
          UNION ALL SELECT it.step, it.case_id, lk.tgt_id, it2.n, it2.dangling, 0e0, it.r * lk.share FROM it JOIN lk ON lk.case_id = it.case_id AND lk.src_id = it.id JOIN base it2 ON it2.case_id = lk.case_id AND it2.id = lk.tgt_id) s
        JOIN (SELECT case_id, sum(CASE WHEN dangling THEN r ELSE 0e0 END) AS lost FROM it GROUP BY 1) l ON l.case_id = s.case_id WHERE s.step < 60 GROUP BY s.case_id, s.id),
      chg AS (SELECT case_id, step FROM it WHERE step > 0 GROUP BY case_id, step HAVING sum(abs(r - prev)) < any_value(n) * 1e-6)
    SELECT it.case_id, it.id, round(it.r, 6) AS pagerank FROM it JOIN (SELECT case_id, min(step) AS step FROM chg GROUP BY 1) c ON c.case_id = it.case_id AND c.step = it.step"""


@query("pagerank", _PR, "links nodes")
def _(t: Inputs) -> DataFrame:
    return analytics.pagerank(_pairs(t), t.bound("nodes")).withColumn("pagerank", F.round("pagerank", 6))


@query("weak_components", """SELECT case_id, id, root AS component, count(*) OVER (PARTITION BY case_id, root) AS size FROM (
      SELECT case_id, src_id AS id, min(tgt_id) OVER (PARTITION BY case_id, src_id) AS low, least(min(tgt_id) OVER (PARTITION BY case_id, src_id), src_id) AS root FROM (SELECT DISTINCT case_id, src_id, tgt_id FROM order_links)
      UNION SELECT case_id, tgt_id, NULL, least(min(tgt_id) OVER (PARTITION BY case_id, src_id), src_id) FROM order_links) x
    GROUP BY case_id, id, root""", "order_links")
def _(t: Inputs) -> DataFrame:
    """Components of the customer and order forest, named by their smallest node."""
    pairs = _pairs(t, "order_links")
    labels = analytics.component_labels(pairs)
    sizes = labels.groupBy("case_id", "component").agg(F.count(F.lit(1)).alias("size"))
    return labels.join(sizes, ["case_id", "component"])


@query("weak_components_ranked", """SELECT case_id, 'WCC-' || CASE WHEN r < 10 THEN '0' ELSE '' END || r AS component_id, size, size AS members FROM (
      SELECT case_id, size, row_number() OVER (PARTITION BY case_id ORDER BY size DESC, low) AS r FROM (SELECT case_id, src_id, count(*) + 1 AS size, least(src_id, min(tgt_id)) AS low FROM order_links GROUP BY 1, 2) c) d""", "order_links")
def _(t: Inputs) -> DataFrame:
    found = analytics.weak_components(_pairs(t, "order_links"))
    return found.groupBy("case_id", "component_id", "size").agg(F.count(F.lit(1)).alias("members"))


@query("weak_components_chain", "SELECT user_id, count(*) AS size FROM events GROUP BY user_id")
def _(t: Inputs) -> DataFrame:
    """Long chains: every event linked to the event of the same user before it."""
    from threadline.functions.ordered import with_previous

    events = t.table("events").select("user_id", "event_id")
    linked = with_previous(events, ["user_id"], [F.asc("event_id")], {"before": "event_id"})
    pairs = linked.select(
        F.lit("C").alias("case_id"), F.lpad(F.coalesce("before", "event_id").cast("string"), 12, "0").alias("src_id"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("tgt_id"), F.lit(1).alias("weight"),
    )
    labels = analytics.component_labels(pairs)
    owner = events.select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), "user_id")
    return labels.join(owner, "id").groupBy("component", "user_id").agg(F.count(F.lit(1)).alias("size")).select("user_id", "size")


@query("strong_components_lines")
def _(t: Inputs) -> DataFrame:
    return analytics.strong_components(_pairs(t), t.bound("nodes"))


_BETWEENNESS = """WITH RECURSIVE p AS (SELECT case_id, src_id, tgt_id, 1e0 / count(*) AS d FROM brand_links WHERE src_id <> tgt_id GROUP BY 1, 2, 3),
      v AS (SELECT case_id, src_id AS id FROM brand_links UNION SELECT case_id, tgt_id FROM brand_links), nn AS (SELECT case_id, count(*)::DOUBLE AS n FROM v GROUP BY 1),
      sp(step, case_id, s, id, c) AS (SELECT 0, case_id, id, id, 0e0 FROM v
        UNION ALL SELECT any_value(step) + 1, case_id, s, id, min(c) FROM (
          SELECT sp.step, p.case_id, sp.s, p.tgt_id AS id, round(sp.c + p.d, 10) AS c FROM sp JOIN p ON p.case_id = sp.case_id AND p.src_id = sp.id UNION ALL SELECT * FROM sp) x
        WHERE step < 14 GROUP BY case_id, s, id),
      d AS (SELECT case_id, s, id, c FROM sp WHERE step = 14),
      tight AS (SELECT a.case_id, a.s, p.src_id, p.tgt_id FROM d a JOIN p ON p.case_id = a.case_id AND p.src_id = a.id
        JOIN d b ON b.case_id = a.case_id AND b.s = a.s AND b.id = p.tgt_id WHERE abs(a.c + p.d - b.c) < 1e-9),
      sig(step, case_id, s, id, n) AS (SELECT 0, case_id, id, id, 1e0 FROM v
        UNION ALL SELECT any_value(g.step) + 1, g.case_id, g.s, t.tgt_id, sum(g.n) FROM sig g JOIN tight t ON t.case_id = g.case_id AND t.s = g.s AND t.src_id = g.id
        GROUP BY g.case_id, g.s, t.tgt_id),
      q AS (SELECT case_id, s, id, sum(n) AS n FROM sig GROUP BY 1, 2, 3),
      share AS (SELECT t.*, a.n / b.n AS f FROM tight t JOIN q a ON a.case_id = t.case_id AND a.s = t.s AND a.id = t.src_id JOIN q b ON b.case_id = t.case_id AND b.s = t.s AND b.id = t.tgt_id),
      dep(step, case_id, s, id, part) AS (SELECT 0, case_id, s, id, 1e0 FROM d
        UNION ALL SELECT any_value(e.step) + 1, e.case_id, e.s, h.src_id, sum(e.part * h.f) FROM dep e JOIN share h ON h.case_id = e.case_id AND h.s = e.s AND h.tgt_id = e.id
        GROUP BY e.case_id, e.s, h.src_id)
    SELECT v.case_id, v.id, CASE WHEN n > 2 THEN round(coalesce(raw, 0) / ((n - 1) * (n - 2)), 6) ELSE 0 END AS betweenness FROM v JOIN nn ON nn.case_id = v.case_id
      LEFT JOIN (SELECT case_id, id, sum(part) AS raw FROM dep WHERE step > 0 AND id <> s GROUP BY 1, 2) r ON r.case_id = v.case_id AND r.id = v.id"""


@query("betweenness_brands", _BETWEENNESS, "brand_links")
def _(t: Inputs) -> DataFrame:
    return centrality.betweenness(_pairs(t, "brand_links")).withColumn("betweenness", F.round("betweenness", 6))


def _steps(t: Inputs, text: str) -> DataFrame:
    return analytics.project_graph(t.sql(text).selectExpr("*", "'EV-1' AS evidence_id", "concat(src_id, tgt_id) AS rel_id"))


@query("strong_components", """SELECT 'CASE-' || c_custkey // 12 % 3 AS case_id, sum(CASE WHEN g % 2 = 0 THEN 1 ELSE n END)::BIGINT AS strongly_connected_count,
      max(CASE WHEN g % 2 = 0 THEN n ELSE 1 END) AS largest_component_size
    FROM (SELECT min(c_custkey) AS c_custkey, c_custkey // 12 AS g, count(*) AS n FROM customer GROUP BY 2) c WHERE n > 1 GROUP BY 1""")
def _(t: Inputs) -> DataFrame:
    """Chains of up to 12 customers; every other one is closed to a ring, which is one component."""
    pairs = _steps(t, """SELECT 'CASE-' || (c_custkey DIV 12 % 3) AS case_id, 'C-' || c_custkey AS src_id,
          CASE WHEN c_custkey % 12 = 11 OR last THEN 'C-' || (c_custkey - c_custkey % 12) ELSE 'C-' || (c_custkey + 1) END AS tgt_id
        FROM (SELECT c_custkey, c_custkey = (SELECT max(c_custkey) FROM {customer}) AS last FROM {customer}) c
        WHERE (c_custkey % 12 <> 11 AND NOT last) OR (c_custkey DIV 12) % 2 = 0""")
    return analytics.strong_components(pairs)


@query("betweenness", """SELECT 'CASE-' || c_custkey // 9 AS case_id, 'C-' || c_custkey AS id,
      CASE WHEN n > 2 THEN round((c_custkey % 9) * (n - 1 - c_custkey % 9)::DOUBLE / ((n - 1) * (n - 2)), 6) ELSE 0 END AS betweenness
    FROM (SELECT *, count(*) OVER (PARTITION BY c_custkey // 9) AS n FROM customer) c WHERE n > 1""")
def _(t: Inputs) -> DataFrame:
    """One-way chains of nine customers: the i-th of n lies on i (n - 1 - i) shortest paths."""
    pairs = _steps(t, """SELECT 'CASE-' || (a.c_custkey DIV 9) AS case_id, 'C-' || a.c_custkey AS src_id, 'C-' || b.c_custkey AS tgt_id
        FROM {customer} a JOIN {customer} b ON b.c_custkey = a.c_custkey + 1 AND b.c_custkey DIV 9 = a.c_custkey DIV 9""")
    return centrality.betweenness(pairs).withColumn("betweenness", F.round("betweenness", 6))


@query("case_analytics", """SELECT 'CASE-' || c_custkey // 9 AS case_id, count(*) - 1 AS unique_pairs, CAST(1 AS BIGINT) AS max_frequency, CAST(1 AS BIGINT) AS weak_components,
      count(*) AS strong_components, round(CASE WHEN count(*) > 2 THEN 2 ELSE 1 END / (count(*) - 1)::DOUBLE, 6) AS top_degree,
      CASE WHEN count(*) > 2 THEN round(((count(*) - 1) // 2) * (count(*) // 2) / ((count(*) - 1) * (count(*) - 2))::DOUBLE, 6) ELSE 0 END AS top_betweenness
    FROM customer GROUP BY c_custkey // 9 HAVING count(*) > 1""")
def _(t: Inputs) -> DataFrame:
    """One-way chains of nine customers, projected once for all analytics."""
    edges = t.sql("""SELECT 'CASE-' || (a.c_custkey DIV 9) AS case_id, 'C-' || a.c_custkey AS src_id, 'C-' || b.c_custkey AS tgt_id,
          'EV-1' AS evidence_id, 'C-' || a.c_custkey AS rel_id
        FROM {customer} a JOIN {customer} b ON b.c_custkey = a.c_custkey + 1 AND b.c_custkey DIV 9 = a.c_custkey DIV 9""")
    return overview.CaseAnalytics(edges).summary()


@query("communities", """SELECT case_id, id, count(*) OVER (PARTITION BY g) AS size, min(id) OVER (PARTITION BY g) AS head FROM (
      SELECT 'CASE-' || c_custkey // 40 AS case_id, 'C-' || lpad(c_custkey::VARCHAR, 9, '0') AS id, c_custkey // 5 AS g, count(*) OVER (PARTITION BY c_custkey // 5) AS n FROM customer) c WHERE n > 1""")
def _(t: Inputs) -> DataFrame:
    """Eight cliques of five customers in each case: the cliques are the communities."""
    pairs = _steps(t, """SELECT 'CASE-' || (a.c_custkey DIV 40) AS case_id, 'C-' || lpad(CAST(a.c_custkey AS STRING), 9, '0') AS src_id,
          'C-' || lpad(CAST(b.c_custkey AS STRING), 9, '0') AS tgt_id
        FROM {customer} a JOIN {customer} b ON a.c_custkey DIV 5 = b.c_custkey DIV 5 AND a.c_custkey < b.c_custkey""")
    found = communities.communities(pairs)
    heads = found.groupBy("case_id", "community_id").agg(F.min("id").alias("head"))
    return found.join(heads, ["case_id", "community_id"]).select("case_id", "id", "size", "head")


@query("communities_brands")
def _(t: Inputs) -> DataFrame:
    return communities.communities(_pairs(t, "brand_links"))


@query("modularity_of_components", """SELECT case_id, round(sum(inside / m2 - (tot / m2) * (tot / m2)), 6) AS modularity FROM (
      SELECT case_id, src_id, 2e0 * count(*) AS inside, 2e0 * count(*) AS tot, sum(2e0 * count(*)) OVER (PARTITION BY case_id) AS m2 FROM order_links GROUP BY case_id, src_id) c GROUP BY 1""", "order_links")
def _(t: Inputs) -> DataFrame:
    pairs = _pairs(t, "order_links")
    labels = analytics.component_labels(pairs).withColumnRenamed("component", "community")
    found = communities.modularity(analytics.undirected_weights(pairs), labels)
    return found.withColumn("modularity", F.round("modularity", 6))


@query("shortest_path_weighted", f"""SELECT q.case_id, 'P-3' AS source_id, 'S-2' AS target_id, round(min(c), 6) AS total_cost FROM (SELECT DISTINCT case_id FROM links) q
    LEFT JOIN (WITH RECURSIVE p AS ({_PAIRS}), sp(step, case_id, id, c) AS (SELECT DISTINCT 0, case_id, 'P-3', 0e0 FROM p
      UNION ALL SELECT any_value(step) + 1, case_id, id, min(c) FROM (SELECT sp.step, p.case_id, p.tgt_id AS id, sp.c + 1e0 / p.weight AS c FROM sp JOIN p ON p.case_id = sp.case_id AND p.src_id = sp.id
        UNION ALL SELECT * FROM sp) s WHERE step < 12 GROUP BY case_id, id) SELECT * FROM sp) h ON h.case_id = q.case_id AND h.id = 'S-2' GROUP BY 1""", "links")
def _(t: Inputs) -> DataFrame:
    pairs = _pairs(t)
    asked = pairs.select("case_id").distinct().withColumn("source_id", F.lit("P-3")).withColumn("target_id", F.lit("S-2"))
    return analytics.shortest_path_weighted(pairs, asked).select("case_id", "source_id", "target_id", "total_cost")


@query("k_hop_neighbors", f"""WITH p AS ({_PAIRS}), one AS (SELECT DISTINCT case_id, tgt_id AS id FROM p WHERE src_id = 'S-4'),
      two AS (SELECT DISTINCT p.case_id, p.tgt_id AS id FROM p JOIN one ON p.case_id = one.case_id AND p.src_id = one.id WHERE p.tgt_id <> 'S-4' AND NOT EXISTS (SELECT 1 FROM one o WHERE o.case_id = p.case_id AND o.id = p.tgt_id))
    SELECT case_id, id, CAST(1 AS INT) AS hop FROM one UNION ALL SELECT case_id, id, 2 FROM two""", "links")
def _(t: Inputs) -> DataFrame:
    links = t.bound("links")
    egos = links.select("case_id").distinct().withColumn("id", F.lit("S-4"))
    return analytics.k_hop_neighbors(links, egos).drop("ego_id")


_STAMPS = "SELECT 'CASE-' || (user_id % 5) AS case_id, CASE WHEN event_type = 'error' THEN 0 ELSE 1700000000 + event_id * 3611 END AS epoch FROM {events}"


@query("timestamp_patterns", """SELECT case_id, 'MONTH' AS kind, strftime(to_timestamp(epoch) AT TIME ZONE 'UTC', '%Y-%m') AS period, count(*) AS count FROM s WHERE epoch > 0 GROUP BY 1, 3
    UNION ALL SELECT c.case_id, 'HOUR', lpad(CAST(h AS VARCHAR), 2, '0'), count(epoch) FROM (SELECT DISTINCT case_id FROM s WHERE epoch > 0) c CROSS JOIN range(24) r(h)
      LEFT JOIN s ON s.case_id = c.case_id AND epoch > 0 AND (epoch // 3600) % 24 = h GROUP BY 1, 3""".replace(" s ", f" ({_STAMPS.replace('{events}', 'events')}) s "))
def _(t: Inputs) -> DataFrame:
    return analytics.timestamp_patterns(t.sql(_STAMPS))


@query("timestamp_summary", f"""SELECT case_id, count(*) AS total_events, CAST(min(epoch) AS BIGINT) AS earliest_timestamp, CAST(max(epoch) AS BIGINT) AS latest_timestamp,
      strftime(to_timestamp(min(epoch)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '+00:00' AS earliest_iso,
      strftime(to_timestamp(max(epoch)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '+00:00' AS latest_iso FROM ({_STAMPS.replace('{events}', 'events')}) s WHERE epoch > 0 GROUP BY 1""")
def _(t: Inputs) -> DataFrame:
    return analytics.timestamp_summary(t.sql(_STAMPS))


@query("empty_case_summary", """SELECT c.case_id, n.n IS NULL OR e.e IS NULL AS is_empty, coalesce(n.n, 0) AS total_nodes, coalesce(e.e, 0) AS total_raw_edges,
      CASE WHEN n.n IS NULL OR e.e IS NULL THEN 0 ELSE e.p END AS unique_directed_pairs
    FROM (SELECT 'CASE-' || x AS case_id FROM (VALUES ('O'), ('F'), ('NONE')) v(x)) c LEFT JOIN (SELECT case_id, count(*) AS n FROM nodes GROUP BY 1) n ON n.case_id = c.case_id
    LEFT JOIN (SELECT case_id, count(*) AS e, count(DISTINCT src_id || '>' || tgt_id) AS p FROM links GROUP BY 1) e ON e.case_id = c.case_id""", "links nodes")
def _(t: Inputs) -> DataFrame:
    cases = t.sql("SELECT 'CASE-' || x AS case_id FROM (VALUES ('O'), ('F'), ('NONE')) v(x)")
    return analytics.empty_case_summary(cases, t.bound("nodes"), t.bound("links"))
