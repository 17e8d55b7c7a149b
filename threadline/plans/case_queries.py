"""Location, access, audit and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadline.operators import governance as gov
from threadline.operators import location
from threadline.plans.registry import Inputs, query

# --- location ------------------------------------------------------------------

_IMAGES = """SELECT 'CASE-' || (event_id % 6) AS case_id, 'ART-' || event_id AS artifact_id, user_id % 80 + 0.12e0 AS latitude, CASE WHEN event_type = 'error' THEN NULL ELSE user_id % 170 + 0.34e0 END AS longitude,
    CASE WHEN event_type = 'click' THEN '' ELSE CAST(2000 + event_id % 900 AS VARCHAR(20)) END AS exif_datetime, 'Acme' AS device_make, CAST(NULL AS VARCHAR(20)) AS device_model FROM {events}"""
_STOPS = """SELECT case_id, 'LOC-' || artifact_id || '-GPS' AS stop_id, latitude AS lat, longitude AS lng, nullif(exif_datetime, '') AS stop_time FROM (""" + _IMAGES.replace("{events}", "events") + """) i WHERE latitude IS NOT NULL AND longitude IS NOT NULL"""


def _stops(t: Inputs) -> DataFrame:
    return location.image_stops(t.sql(_IMAGES))


@query("location_stops", f"""SELECT case_id, stop_id, lat, lng, stop_time, 'EXIF_GPS' AS source_type, 'Acme' AS device FROM ({_STOPS}) s
    UNION ALL SELECT case_id, observation_id, CAST(value->>'$.latitude' AS DOUBLE), CAST(value->>'$.longitude' AS DOUBLE),
      strftime(to_timestamp(CAST(value->>'$.datetime_created' AS BIGINT)) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S'), 'FORENSIC_OBSERVATION', 'Acme ' || (value->>'$.device_model') FROM gps_obs""", "gps_obs")
def _(t: Inputs) -> DataFrame:
    stops = location.location_stops(t.sql(_IMAGES), t.bound("gps_obs"))
    return stops.select("case_id", "stop_id", "lat", "lng", "stop_time", "source_type", "device")


@query("stop_order", f"SELECT case_id, stop_id, row_number() OVER (PARTITION BY case_id ORDER BY stop_time NULLS LAST, stop_id) AS stop_index FROM ({_STOPS}) s")
def _(t: Inputs) -> DataFrame:
    return location.stop_order(_stops(t)).select("case_id", "stop_id", "stop_index")


@query("routes", f"""SELECT case_id, 'ROUTE-' || i AS route_id, stop_time AS departure, arrival, lat AS from_lat, to_lat FROM (
      SELECT *, row_number() OVER w AS i, lead(stop_time) OVER w AS arrival, lead(lat) OVER w AS to_lat FROM ({_STOPS}) s WHERE stop_time IS NOT NULL WINDOW w AS (PARTITION BY case_id ORDER BY stop_time, stop_id)) r
    WHERE arrival IS NOT NULL AND arrival <> stop_time""")
def _(t: Inputs) -> DataFrame:
    return location.routes(_stops(t)).select("case_id", "route_id", "departure", "arrival", "from_lat", "to_lat")


_CELLS = f"SELECT *, CAST(round_even(lat / 5, 0) * 5 AS BIGINT) AS lat_cell, CAST(round_even(lng / 5, 0) * 5 AS BIGINT) AS lng_cell FROM ({_STOPS}) s"


@query("grid_clusters", f"""SELECT case_id, 'CLUST-' || row_number() OVER (PARTITION BY case_id ORDER BY late, t, s) AS cluster_id, lat_cell, lng_cell, center_lat, center_lng, count FROM (
      SELECT case_id, lat_cell, lng_cell, round(avg(lat), 6) AS center_lat, round(avg(lng), 6) AS center_lng, count(*) AS count, min(stop_time) IS NULL AS late, min(stop_time) AS t,
        arg_min(stop_id, (stop_time IS NULL, coalesce(stop_time, ''), stop_id)) AS s FROM ({_CELLS}) c GROUP BY 1, 2, 3 HAVING count(*) > 1) g""")
def _(t: Inputs) -> DataFrame:
    found = location.grid_clusters(_stops(t)).drop("name")
    return found.withColumn("center_lat", F.round("center_lat", 6)).withColumn("center_lng", F.round("center_lng", 6))


@query("cluster_members", f"SELECT case_id, lat_cell, lng_cell, stop_id FROM (SELECT *, count(*) OVER (PARTITION BY case_id, lat_cell, lng_cell) AS n FROM ({_CELLS}) c) m WHERE n > 1")
def _(t: Inputs) -> DataFrame:
    stops = _stops(t)
    clusters = location.grid_clusters(stops)
    members = location.cluster_members(stops, clusters)
    return members.join(clusters.select("case_id", "cluster_id", "lat_cell", "lng_cell"), ["case_id", "cluster_id"]).drop("cluster_id")


@query("manual_stop", f"""SELECT 'CASE-' || r AS case_id, 'LOC-MANUAL-' || (coalesce(n, 0) + k) AS stop_id, city, 'India' AS country, '2026-01-01' AS stop_time
    FROM (SELECT n_nationkey % 9 AS r, n_name AS city, row_number() OVER (PARTITION BY n_nationkey % 9 ORDER BY n_name) AS k FROM nation) q
    LEFT JOIN (SELECT case_id, count(*) AS n FROM ({_STOPS}) s GROUP BY 1) c ON c.case_id = 'CASE-' || r""")
def _(t: Inputs) -> DataFrame:
    asked = t.sql("SELECT 'CASE-' || (n_nationkey % 9) AS case_id, n_name AS city, CAST(NULL AS STRING) AS country, 1D AS lat, 2D AS lng, CAST(NULL AS STRING) AS stop_time FROM {nation}")
    return location.manual_stop(_stops(t), asked, "2026-01-01").select("case_id", "stop_id", "city", "country", "stop_time")


@query("timeline_events", """SELECT 'CASE-' || l_linestatus AS case_id, 'CALL' AS event_kind, 'L-' || l_orderkey AS event_id, epoch_us(l_shipdate) // 1000000 AS at FROM lineitem
    UNION ALL SELECT 'CASE-' || o_orderstatus, 'FILE', 'O-' || o_orderkey, epoch_us(o_orderdate) // 1000000 FROM orders
    UNION ALL SELECT 'CASE-' || event_type, 'GEO', 'E-' || event_id, epoch_us(ts) // 1000000 FROM events""")
def _(t: Inputs) -> DataFrame:
    sources = {
        "CALL": t.sql("SELECT 'CASE-' || l_linestatus AS case_id, 'L-' || l_orderkey AS event_id, l_shipdate AS event_time, '' AS description FROM {lineitem}"),
        "FILE": t.sql("SELECT 'CASE-' || o_orderstatus AS case_id, 'O-' || o_orderkey AS event_id, o_orderdate AS event_time, '' AS description FROM {orders}"),
        "GEO": t.sql("SELECT 'CASE-' || event_type AS case_id, 'E-' || event_id AS event_id, ts AS event_time, '' AS description FROM {events}"),
    }
    merged = location.timeline_events({kind: df.withColumn("event_time", F.col("event_time").cast("timestamp")) for kind, df in sources.items()})
    return merged.select("case_id", "event_kind", "event_id", F.unix_timestamp("event_time").alias("at"))


# --- access --------------------------------------------------------------------

_FREE = "(role = 'HIGHER_AUTHORITY' OR (role = 'COURT_JUDGE' AND court_level IN ('SUPREME_COURT', 'HIGH_COURT')))"
_NEEDS = "(role = 'INVESTIGATION_OFFICER' OR (role = 'COURT_JUDGE' AND court_level = 'SPECIFIC_COURT'))"


@query("access_scope", f"""WITH star AS (SELECT DISTINCT user_id FROM grants WHERE case_id = '*')
    SELECT user_id, '*' AS case_id FROM users WHERE {_FREE} OR ({_NEEDS} AND user_id IN (SELECT user_id FROM star))
    UNION SELECT u.user_id, g.case_id FROM users u JOIN grants g ON g.user_id = u.user_id WHERE {_NEEDS} AND u.user_id NOT IN (SELECT user_id FROM star)""", "users grants")
def _(t: Inputs) -> DataFrame:
    return gov.access_scope(t.bound("users"), t.bound("grants"))


@query("case_access_filter", """SELECT request_id, target_case_id AS case_id FROM requests WHERE target_case_id IN (SELECT case_id FROM grants WHERE user_id = 'U-10')
    OR EXISTS (SELECT 1 FROM grants WHERE user_id = 'U-10' AND case_id = '*')""", "requests grants")
def _(t: Inputs) -> DataFrame:
    rows = t.bound("requests").select("request_id", F.col("target_case_id").alias("case_id"))
    users = t.bound("users")
    return gov.case_access_filter(rows, users, t.bound("grants"), "U-10")


_OWNED = """SELECT r.*, coalesce(nullif(resource_owner_case_id, ''), b.c, e.c, a.c) AS owner_case_id FROM requests r
    LEFT JOIN (SELECT 'EV-' || p_partkey AS id, max('CASE-' || (p_size % 25)) AS c FROM part WHERE p_partkey < 100 GROUP BY 1) b ON b.id = r.resource_id
    LEFT JOIN (SELECT 'EV-' || s_suppkey AS id, max('CASE-' || s_nationkey) AS c FROM supplier GROUP BY 1) e ON e.id = r.resource_id
    LEFT JOIN (SELECT 'EV-' || c_custkey AS id, max('CASE-' || c_nationkey) AS c FROM customer WHERE c_custkey >= 400 GROUP BY 1) a ON a.id = r.resource_id"""


def _owned(t: Inputs) -> DataFrame:
    bindings = t.sql("SELECT 'EV-' || p_partkey AS resource_id, 'CASE-' || (p_size % 25) AS case_id FROM {part} WHERE p_partkey < 100")
    evidence = t.sql("SELECT 'EV-' || s_suppkey AS evidence_id, 'CASE-' || s_nationkey AS case_id FROM {supplier}")
    artifacts = t.sql("SELECT 'EV-' || c_custkey AS artifact_id, 'CASE-' || c_nationkey AS case_id FROM {customer} WHERE c_custkey >= 400")
    return gov.owner_resolution(t.bound("requests"), bindings, evidence, artifacts)


@query("owner_resolution", f"SELECT request_id, owner_case_id FROM ({_OWNED}) o", "requests")
def _(t: Inputs) -> DataFrame:
    return _owned(t).select("request_id", "owner_case_id")


_SENIOR = "role IN ('HIGHER_AUTHORITY', 'COURT_JUDGE')"


@query("access_decisions", f"""SELECT request_id, reason NOT LIKE '%DENY%' AS allowed, reason FROM (SELECT request_id, CASE
      WHEN action = 'REGISTER_EVIDENCE' AND role = 'COURT_JUDGE' THEN 'BFLA DENY: Role ''' || role || ''' cannot register evidence.'
      WHEN action = 'CREATE_CASE' AND role = 'COURT_JUDGE' THEN 'BFLA DENY: Role ''' || role || ''' cannot create cases.'
      WHEN action = 'CREATE_CASE' THEN 'ALLOW: Authorized role case creation granted.'
      WHEN action = 'VIEW_AUDIT_LOGS' AND NOT {_SENIOR} THEN 'BFLA DENY: Role ''' || role || ''' lacks permission to access audit logs.'
      WHEN action = 'JUDICIAL_OVERRIDE' AND NOT {_SENIOR} THEN 'BFLA DENY: Role ''' || role || ''' cannot issue judicial overrides.'
      WHEN action = 'CHANGE_OWNERSHIP' AND NOT {_SENIOR} THEN 'BFLA DENY: Role ''' || role || ''' cannot modify ownership or judicial assignment.'
      WHEN target_case_status = 'CLOSED' AND action <> 'REOPEN_CASE' THEN 'CLOSED CASE DENY: Modifications to closed cases are prohibited unless reopened.'
      WHEN target_case_status = 'CLOSED' AND NOT {_SENIOR} THEN 'BFLA DENY: Role ''' || role || ''' cannot reopen a closed case.'
      WHEN owner_case_id <> target_case_id THEN 'ID MANIPULATION DENY: Resource ''' || resource_id || ''' belongs to case ''' || owner_case_id || ''', not target case ''' || target_case_id || '''.'
      WHEN role = 'HIGHER_AUTHORITY' THEN 'ALLOW: Higher authority cross-case authorization granted.'
      WHEN role = 'COURT_JUDGE' AND court_level IS NULL THEN 'DENY: Court judge missing judicial context.'
      WHEN role = 'COURT_JUDGE' AND court_level = 'SUPREME_COURT' THEN 'ALLOW: Supreme Court national jurisdiction granted.'
      WHEN role = 'COURT_JUDGE' AND court_level = 'HIGH_COURT' THEN 'ALLOW: High Court state jurisdiction granted.'
      WHEN g.user_id IS NULL AND s.user_id IS NULL AND role = 'COURT_JUDGE' THEN 'BOLA DENY: Specific Court judge not assigned to case ''' || target_case_id || '''.'
      WHEN g.user_id IS NULL AND s.user_id IS NULL THEN 'BOLA DENY: Officer not authorized for case ''' || target_case_id || '''.'
      ELSE 'ALLOW: Server-side authorization check passed.' END AS reason
    FROM ({_OWNED}) o LEFT JOIN (SELECT DISTINCT user_id, case_id FROM grants WHERE case_id <> '*') g ON g.user_id = o.user_id AND g.case_id = o.target_case_id
      LEFT JOIN (SELECT DISTINCT user_id FROM grants WHERE case_id = '*') s ON s.user_id = o.user_id) d""", "requests grants")
def _(t: Inputs) -> DataFrame:
    return gov.access_decisions(_owned(t), t.bound("grants")).select("request_id", "allowed", "reason")


@query("grant_resolution", """WITH star AS (SELECT DISTINCT user_id FROM grants WHERE case_id = '*'), linked AS (
      SELECT u.user_id, c.case_id FROM users u JOIN (SELECT case_id, created_by AS who FROM cases UNION SELECT case_id, unnest(string_split(assigned_list, ',')) FROM cases) c ON c.who = u.user_id OR c.who = u.username)
    SELECT user_id, '*' AS case_id FROM star WHERE user_id IN (SELECT user_id FROM users)
    UNION SELECT user_id, case_id FROM (SELECT user_id, case_id FROM grants WHERE case_id <> '*' AND user_id IN (SELECT user_id FROM users) UNION SELECT * FROM linked) l WHERE user_id NOT IN (SELECT user_id FROM star)""", "users grants cases")
def _(t: Inputs) -> DataFrame:
    cases = t.bound("cases").withColumn("assigned", F.split("assigned_list", ","))
    return gov.grant_resolution(t.bound("users"), t.bound("grants"), cases)


@query("grant_change", """SELECT user_id, case_id, max(granted_at) AS granted_at FROM (SELECT * FROM grants UNION ALL SELECT user_id, 'CASE-1', 900000000 FROM users) g
    WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.user_id = g.user_id AND NOT is_active AND g.case_id = 'CASE-2') GROUP BY 1, 2""", "users grants")
def _(t: Inputs) -> DataFrame:
    users = t.bound("users")
    fresh = users.select("user_id", F.lit("CASE-1").alias("case_id"), F.lit(900000000).cast("long").alias("granted_at"))
    gone = users.filter("not is_active").select("user_id", F.lit("CASE-2").alias("case_id"))
    return gov.grant_change(t.bound("grants"), fresh, gone)


@query("active_judges", "SELECT user_id, username FROM users WHERE role = 'COURT_JUDGE' AND is_active", "users")
def _(t: Inputs) -> DataFrame:
    return gov.active_judges(t.bound("users")).select("user_id", "username")


@query("case_create", "SELECT case_id, array_to_string(list_distinct_order, ',') AS team, 'DRAFT' AS status FROM (SELECT case_id, CASE WHEN list_contains(a, created_by) THEN a ELSE list_append(a, created_by) END AS list_distinct_order FROM (SELECT *, string_split(assigned_list, ',') AS a FROM cases) c) d", "cases")
def _(t: Inputs) -> DataFrame:
    asked = t.bound("cases").withColumn("assigned", F.split("assigned_list", ","))
    return gov.case_create(asked).select("case_id", F.array_join("assigned", ",").alias("team"), "status")


@query("case_update", """SELECT c.case_id, coalesce(CASE WHEN n % 2 = 0 THEN 'new ' || n END, name) AS name, CASE WHEN n % 4 = 1 THEN 'ACTIVE' ELSE status END AS status
    FROM (SELECT *, CAST(case_id[6:] AS INT) AS n FROM cases) c""", "cases")
def _(t: Inputs) -> DataFrame:
    updates = t.sql("SELECT 'CASE-' || n_nationkey AS case_id, CASE WHEN n_nationkey % 2 = 0 THEN 'new ' || n_nationkey END AS name, n_nationkey % 4 = 1 AS reopen FROM {nation}")
    return gov.case_update(t.bound("cases"), updates).select("case_id", "name", "status")


# --- audit ---------------------------------------------------------------------

_CHAIN = """(WITH RECURSIVE e AS (SELECT actor_id, seq, payload, row_number() OVER (PARTITION BY actor_id ORDER BY seq) AS i FROM audit_events),
      c(actor_id, i, seq, prev, hash) AS (SELECT actor_id, i, seq, repeat('0', 64), sha256(repeat('0', 64) || ':' || payload) FROM e WHERE i = 1
        UNION ALL SELECT e.actor_id, e.i, e.seq, c.hash, sha256(c.hash || ':' || e.payload) FROM c JOIN e ON e.actor_id = c.actor_id AND e.i = c.i + 1) SELECT * FROM c)"""


@query("audit_append", f"SELECT actor_id, seq, prev AS previous_event_hash, hash AS event_hash FROM {_CHAIN} x", "audit_events")
def _(t: Inputs) -> DataFrame:
    return gov.audit_append(t.bound("audit_events"), "actor_id", "seq").select("actor_id", "seq", "previous_event_hash", "event_hash")


@query("audit_verify", """SELECT actor_id, count(*) AS events, CAST(0 AS BIGINT) AS broken_links, count(*) FILTER (decision = 'DENY' AND action = 'view') AS wrong_hashes,
      count(*) FILTER (decision = 'DENY' AND action = 'view') = 0 AS is_valid FROM audit_events GROUP BY 1""", "audit_events")
def _(t: Inputs) -> DataFrame:
    """Chains whose denied views were edited after the fact."""
    log = gov.audit_append(t.bound("audit_events"), "actor_id", "seq")
    edited = F.when((F.col("decision") == "DENY") & (F.col("action") == "view"), F.concat("payload", F.lit(" "))).otherwise(F.col("payload"))
    return gov.audit_verify(log.withColumn("payload", edited), "actor_id", "seq")


_TREE = """WITH RECURSIVE e AS (SELECT actor_id, seq, decision = 'DENY' AND action = 'view' AS edited, sha256('0:' || payload) AS hash,
        row_number() OVER (PARTITION BY actor_id ORDER BY seq) - 1 AS place FROM audit_events),
      tree(level, actor_id, place, hash) AS (SELECT 0, actor_id, place, hash FROM e
        UNION ALL SELECT any_value(level) + 1, actor_id, place // 16, sha256('1:' || string_agg(hash, ',' ORDER BY place))
        FROM (SELECT *, count(*) OVER (PARTITION BY actor_id) AS m FROM tree) x WHERE m > 1 GROUP BY actor_id, place // 16),
      roots AS (SELECT actor_id, max(level) AS levels, arg_max(hash, level) AS root FROM tree WHERE place = 0 GROUP BY 1)"""


@query("audit_tree_roots", f"{_TREE} SELECT actor_id, CAST(levels AS INT) AS levels, root FROM roots", "audit_events")
def _(t: Inputs) -> DataFrame:
    """The root of each actor's log as a hash tree."""
    _, nodes = gov.audit_tree(t.bound("audit_events"), "actor_id", "seq")
    return gov.audit_roots(nodes, "actor_id")


@query("audit_tree_proofs", f"{_TREE} SELECT e.actor_id, e.seq, e.place, CAST(r.levels AS INT) AS steps, NOT e.edited AS is_valid FROM e JOIN roots r ON r.actor_id = e.actor_id", "audit_events")
def _(t: Inputs) -> DataFrame:
    """Inclusion proofs of all events, shown with the events as they are now: denied views were edited after the fact."""
    numbered, nodes = gov.audit_tree(t.bound("audit_events"), "actor_id", "seq")
    edited = F.when((F.col("decision") == "DENY") & (F.col("action") == "view"), F.concat("payload", F.lit(" "))).otherwise(F.col("payload"))
    # Steps are counted before the roots come in, so that no path is shuffled with its event.
    proofs = gov.audit_proofs(numbered.withColumn("payload", edited), nodes, "actor_id").withColumn("steps", F.size("path"))
    proved = gov.audit_proved(proofs, gov.audit_roots(nodes, "actor_id"), "actor_id")
    return proved.select("actor_id", "seq", "place", "steps", "is_valid")


@query("audit_summary", """SELECT actor_id, case_id, action, CAST(grouping_id(actor_id, case_id, action) AS INT) AS level, count(*) FILTER (decision = 'ALLOW') AS allowed, count(*) FILTER (decision = 'DENY') AS denied
    FROM audit_events GROUP BY CUBE (actor_id, case_id, action)""", "audit_events")
def _(t: Inputs) -> DataFrame:
    return gov.audit_summary(t.bound("audit_events"))


# --- reports and integrity -----------------------------------------------------


@query("report_stats", """SELECT c.case_id, coalesce(a.n, 0) AS total_artifacts, coalesce(a.d, 0) AS deleted_artifacts, coalesce(a.n - a.d, 0) AS allocated_artifacts, coalesce(b.txt, '') AS category_breakdown, coalesce(o.n, 0) AS parsed_observations_count,
      coalesce(e.n, 0) AS total_entities, coalesce(r.n, 0) AS total_relationships
    FROM (SELECT DISTINCT case_id FROM artifacts UNION SELECT 'CASE-O') c
    LEFT JOIN (SELECT case_id, count(*) AS n FROM nodes GROUP BY 1) e ON e.case_id = c.case_id LEFT JOIN (SELECT case_id, count(*) AS n FROM links GROUP BY 1) r ON r.case_id = c.case_id
    LEFT JOIN (SELECT case_id, count(*) AS n, count(*) FILTER (allocation_status = 'DELETED' OR category IN ('DELETED', 'DELETED_FILE')) AS d FROM artifacts GROUP BY 1) a ON a.case_id = c.case_id
    LEFT JOIN (SELECT case_id, string_agg(category || '=' || n, ',' ORDER BY category || '=' || n) AS txt FROM (SELECT case_id, category, count(*) AS n FROM artifacts GROUP BY 1, 2) k GROUP BY 1) b ON b.case_id = c.case_id
    LEFT JOIN (SELECT case_id, count(*) AS n FROM doc_obs GROUP BY 1) o ON o.case_id = c.case_id""", "artifacts doc_obs nodes links")
def _(t: Inputs) -> DataFrame:
    """Cases with artifacts, and one that has entities and relationships instead."""
    artifacts = t.bound("artifacts")
    graph_case = t.bound("nodes").filter("case_id = 'CASE-O'").select("case_id")
    cases = artifacts.select("case_id").unionByName(graph_case).distinct().withColumn("anchor_id", F.lit(None).cast("string"))
    found = gov.report_stats(artifacts, t.bound("nodes"), t.bound("links"), t.bound("doc_obs"), cases)
    return found.drop("anchor_id")


@query("report_samples", "SELECT case_id, artifact_id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY artifact_id) AS rank FROM artifacts) a WHERE rank <= 15", "artifacts")
def _(t: Inputs) -> DataFrame:
    return gov.report_samples(t.bound("artifacts"), ["artifact_id"], 15).select("case_id", "artifact_id", "rank")


@query("report_lineage", """SELECT case_id, report_id, v AS version_number, 'v' || v || '.0' AS version, lag(report_id) OVER (PARTITION BY case_id ORDER BY v) AS previous_version_id,
      v = max(v) OVER (PARTITION BY case_id) AS is_current FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY generated_at, report_id) AS v FROM reports) r""", "reports")
def _(t: Inputs) -> DataFrame:
    return gov.report_lineage(t.bound("reports")).drop("generated_at", "pages")


@query("report_scope_list", "SELECT report_id, case_id FROM reports WHERE case_id IN (SELECT case_id FROM grants)", "reports grants")
def _(t: Inputs) -> DataFrame:
    return gov.report_scope_list(t.bound("reports"), t.bound("grants")).select("report_id", "case_id")


@query("content_digest", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def _(t: Inputs) -> DataFrame:
    return t.table("documents").select("doc_id", gov.content_digest(F.col("text")).alias("sha256"))


@query("evidence_integrity", """SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'MISMATCH' ELSE 'INTACT' END AS integrity_status, CASE WHEN doc_id % 9 = 0 THEN 'CORRUPTED' ELSE 'VERIFIED' END AS verification_result FROM documents""")
def _(t: Inputs) -> DataFrame:
    stored = t.sql("SELECT doc_id, 'EV-' || doc_id AS evidence_id, sha2(text, 256) AS sha256 FROM {documents}")
    now = t.sql("SELECT 'EV-' || doc_id AS evidence_id, sha2(CASE WHEN doc_id % 9 = 0 THEN text || ' ' ELSE text END, 256) AS sha256 FROM {documents}")
    return gov.evidence_integrity(stored, now).select("doc_id", "integrity_status", "verification_result")


@query("job_integrity", "SELECT 'JOB-' || doc_id AS job_id, CASE WHEN doc_id % 7 = 0 THEN 'REJECTED' WHEN doc_id % 5 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS job_status FROM documents")
def _(t: Inputs) -> DataFrame:
    stored = t.sql("SELECT 'EV-' || doc_id AS evidence_id, sha2(text, 256) AS sha256 FROM {documents}")
    jobs = t.sql("""SELECT 'JOB-' || doc_id AS job_id, 'EV-' || doc_id AS evidence_id, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE sha2(text, 256) END AS pre_hash,
        CASE WHEN doc_id % 5 = 0 THEN 'y' ELSE sha2(text, 256) END AS post_hash FROM {documents}""")
    return gov.job_integrity(jobs, stored).select("job_id", "job_status")
