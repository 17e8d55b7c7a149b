"""Queries for scans, sources, sinks and artifacts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadline.functions import text
from threadline.operators import artifacts as art
from threadline.plans.registry import Inputs, query
from threadline.sources import contracts, files, keyed, ledgers, relational
from threadline.session import ensure_checkpoint_dir

# --- relational scans ----------------------------------------------------------

_ACCOUNTS = (
    "SELECT c_custkey AS account_id, CASE c_nationkey % 3 WHEN 0 THEN 4 ELSE c_nationkey END AS account_type_id, "
    "CASE WHEN c_custkey % 11 = 0 THEN '  ' ELSE ' u' || c_custkey || '@x.example ' END AS account_unique_identifier FROM {customer}"
)
_CALLS = (
    "SELECT o_orderkey AS relationship_id, o_custkey AS account1_id, o_orderkey % 150 AS account2_id, "
    "CASE o_orderstatus WHEN 'P' THEN 2 ELSE 1 END AS relationship_type, o_orderkey * 60 AS date_time FROM {orders}"
)


def _plain(sql: str) -> str:
    return sql.replace("{", "").replace("}", "")


@query("accounts_scan", f"""SELECT account_id, CASE WHEN account_type_id = 4 THEN 'EMAIL' ELSE 'TYPE_' || account_type_id END AS account_type,
    trim(account_unique_identifier) AS account_unique_identifier FROM ({_plain(_ACCOUNTS)}) a WHERE trim(account_unique_identifier) <> ''""")
def _(t: Inputs) -> DataFrame:
    return relational.accounts_scan(t.sql(_ACCOUNTS)).select("account_id", "account_type", "account_unique_identifier")


@query("account_comm_scan", f"""SELECT relationship_id, account1_id, account2_id, date_time, trim(a.account_unique_identifier) AS from_account,
    trim(b.account_unique_identifier) AS to_account FROM ({_plain(_CALLS)}) r JOIN ({_plain(_ACCOUNTS)}) a ON account1_id = a.account_id
    JOIN ({_plain(_ACCOUNTS)}) b ON account2_id = b.account_id
    WHERE relationship_type = 1 AND trim(a.account_unique_identifier) <> '' AND trim(b.account_unique_identifier) <> ''""")
def _(t: Inputs) -> DataFrame:
    return relational.account_comm_scan(t.sql(_CALLS), t.sql(_ACCOUNTS))


# Attributes of an order as mail, of an event as position, of a part as web row.
_TYPES = (
    "SELECT CAST(row_number() OVER (ORDER BY name) AS INT) AS attribute_type_id, name AS type_name FROM (VALUES ('TSK_EMAIL_FROM'), ('TSK_EMAIL_TO'), ('TSK_EMAIL_CC'), "
    "('TSK_SUBJECT'), ('TSK_DATETIME_SENT'), ('TSK_DATETIME_RCVD'), ('TSK_MSG_ID'), ('TSK_GEO_LATITUDE'), ('TSK_GEO_LONGITUDE'), "
    "('TSK_DATETIME_CREATED'), ('TSK_DEVICE_MAKE'), ('TSK_DEVICE_MODEL'), ('TSK_URL'), ('TSK_DOMAIN'), ('TSK_TITLE'), "
    "('TSK_DATETIME_ACCESSED'), ('TSK_PROG_NAME'), ('TSK_USER_NAME')) v(name)"
)


def _attributes(t: Inputs, source: str, ident: str, values: dict[str, tuple[str, str]]) -> DataFrame:
    """Long attribute rows (artifact_id, attribute_type_id, three value columns) of a wide table."""
    types = t.sql(_TYPES)
    slots = ("value_text", "value_int64", "value_double")
    kinds = dict(zip(slots, ("string", "bigint", "double"), strict=True))
    entries = [
        F.struct(
            F.lit(name).alias("type_name"),
            *[(F.expr(expr) if slot == used else F.lit(None)).cast(kinds[slot]).alias(slot) for slot in slots],
        )
        for name, (used, expr) in values.items()
    ]
    rows = t.table(source).select(F.expr(ident).alias("artifact_id"), F.explode(F.array(*entries)).alias("a"))
    present = rows.select("artifact_id", "a.*").filter("coalesce(value_text, cast(value_int64 as string), cast(value_double as string)) is not null")
    return present.join(types, "type_name").select("artifact_id", "attribute_type_id", *slots)


def _owners(t: Inputs, source: str, ident: str, kind: int) -> DataFrame:
    return t.table(source).select(F.expr(ident).alias("artifact_id"), (F.expr(ident) * 10).alias("obj_id"), F.lit(kind).alias("artifact_type_id"))


@query("eav_email_pivot", """SELECT o_orderkey AS artifact_id, o_orderkey * 10 AS obj_id,
      CASE WHEN o_orderstatus <> 'P' THEN 'u' || o_custkey || '@x.example' ELSE '' END AS email_from,
      CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority ELSE '' END AS email_to, o_orderstatus AS subject,
      CAST(o_custkey * 60 AS BIGINT) AS datetime_sent
    FROM orders WHERE o_orderstatus <> 'P' OR o_orderpriority <> '5-LOW'""")
def _(t: Inputs) -> DataFrame:
    attributes = _attributes(t, "orders", "o_orderkey", {
        "TSK_EMAIL_FROM": ("value_text", "case when o_orderstatus <> 'P' then ' u' || o_custkey || '@x.example ' end"),
        "TSK_EMAIL_TO": ("value_text", "case when o_orderpriority <> '5-LOW' then o_orderpriority end"),
        "TSK_SUBJECT": ("value_text", "o_orderstatus"),
        "TSK_DATETIME_SENT": ("value_int64", "o_custkey * 60"),
    })
    found = relational.eav_email_pivot(_owners(t, "orders", "o_orderkey", relational.MESSAGE), attributes, t.sql(_TYPES))
    return found.select("artifact_id", "obj_id", "email_from", "email_to", "subject", "datetime_sent")


@query("eav_gps_pivot", """SELECT event_id AS artifact_id, event_id * 10 AS obj_id, value AS latitude, value + user_id AS longitude,
      CAST(user_id * 60 AS BIGINT) AS datetime_created, event_type AS device_make FROM events WHERE event_type <> 'error' AND event_type <> 'click'""")
def _(t: Inputs) -> DataFrame:
    attributes = _attributes(t, "events", "event_id", {
        "TSK_GEO_LATITUDE": ("value_double", "case when event_type <> 'error' then value end"),
        "TSK_GEO_LONGITUDE": ("value_double", "case when event_type <> 'click' then value + user_id end"),
        "TSK_DATETIME_CREATED": ("value_int64", "user_id * 60"),
        "TSK_DEVICE_MAKE": ("value_text", "event_type"),
    })
    found = relational.eav_gps_pivot(_owners(t, "events", "event_id", relational.EXIF), attributes, t.sql(_TYPES))
    return found.select("artifact_id", "obj_id", "latitude", "longitude", "datetime_created", "device_make")


@query("eav_web_pivot", """SELECT page_id AS artifact_id, page_id * 10 AS obj_id, url, '' AS domain, 'user' || page_id AS user_name,
      CAST(length(html) AS BIGINT) AS datetime_accessed FROM pages""")
def _(t: Inputs) -> DataFrame:
    attributes = _attributes(t, "pages", "page_id", {
        "TSK_URL": ("value_text", "url"),
        "TSK_USER_NAME": ("value_text", "'user' || page_id"),
        "TSK_DATETIME_ACCESSED": ("value_int64", "length(html)"),
    })
    found = relational.eav_web_pivot(_owners(t, "pages", "page_id", relational.WEB), attributes, t.sql(_TYPES))
    return found.select("artifact_id", "obj_id", "url", "domain", "user_name", "datetime_accessed")


_ALL_OBS = ["mail_obs", "gps_obs", "web_obs", "account_obs", "comm_obs"]


@query("extraction_summary", " UNION ALL ".join(
    f"SELECT observation_type, count(*) AS count FROM {name} GROUP BY 1" for name in _ALL_OBS
) + " UNION ALL SELECT 'TOTAL', CAST(sum(n) AS BIGINT) FROM (" + " UNION ALL ".join(f"SELECT count(*) AS n FROM {name}" for name in _ALL_OBS) + ") x", " ".join(_ALL_OBS))
def _(t: Inputs) -> DataFrame:
    rows = t.bound(_ALL_OBS[0])
    for name in _ALL_OBS[1:]:
        rows = rows.unionByName(t.bound(name))
    return relational.extraction_summary(rows)


@query("table_profile", """SELECT d.column_name, CASE d.column_type WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' ELSE
      CASE WHEN d.column_type LIKE 'TIMESTAMP%' THEN 'timestamp' ELSE lower(d.column_type) END END AS column_type, d."null" = 'YES' AS nullable, n AS row_count, false AS is_estimate
    FROM (SELECT count(*) AS n FROM lineitem) c, (DESCRIBE SELECT * FROM lineitem) d""")
def _(t: Inputs) -> DataFrame:
    profile = relational.table_profile(t.table("lineitem"))
    return profile.withColumn("column_type", F.regexp_replace("column_type", "timestamp.*", "timestamp"))


# --- contracts and observations ------------------------------------------------


def _contract_text(t: Inputs) -> DataFrame:
    """One contract per document in the implemented form, one per part in the documented form."""
    done = t.sql("""SELECT to_json(named_struct('contract_version', '1.0.0', 'provenance_envelope',
        named_struct('case_id', 'CASE-' || source, 'evidence_id', 'EV-' || lang, 'processing_job_id', 'JOB-' || doc_id, 'engine_name', 'ENGINE', 'engine_version', '1'),
        'observed_artifacts', array(named_struct('artifact_id', 'ART-' || doc_id, 'artifact_name', source || '.txt', 'size_bytes', n_chars)),
        'extracted_entities', array(named_struct('entity_id', 'E1-' || doc_id, 'entity_type', 'PHONE_NUMBER', 'observed_value', '9' || doc_id, 'confidence', 1.0D),
          named_struct('entity_id', 'E2-' || doc_id, 'entity_type', 'EMAIL_ADDRESS', 'observed_value', doc_id || '@x.example', 'confidence', 0.5D)))) AS contract FROM {documents}""")
    planned = t.sql("""SELECT to_json(named_struct('contract_version', '1', 'case_id', 'CASE-' || p_brand, 'evidence_id', 'EV-P', 'processing_job_id', 'JOB-P',
        'extracted_artifacts', array(named_struct('artifact_id', 'ARTP-' || p_partkey, 'artifact_name', p_name, 'size_bytes', p_size)))) AS contract FROM {part}""")
    return done.unionByName(planned)


@query("contract_scan", """SELECT 'CASE-' || source AS case_id, 'EV-' || lang AS evidence_id, 'JOB-' || doc_id AS job_id, 'ART-' || doc_id AS artifact_id,
      source || '.txt' AS artifact_name, CAST(n_chars AS BIGINT) AS size_bytes FROM documents
    UNION ALL SELECT 'CASE-' || p_brand, 'EV-P', 'JOB-P', 'ARTP-' || p_partkey, p_name, CAST(p_size AS BIGINT) FROM part""")
def _(t: Inputs) -> DataFrame:
    rows = contracts.contract_artifacts(contracts.parse_contracts(_contract_text(t), "contract"))
    return rows.select("case_id", "evidence_id", "job_id", "artifact_id", "artifact_name", "size_bytes")


@query("contract_entities", """SELECT 'CASE-' || source AS case_id, 'JOB-' || doc_id AS job_id, e.id || doc_id AS entity_id,
      CASE e.id WHEN 'E1-' THEN 'PhoneNumber' ELSE 'Email' END AS label, CASE e.id WHEN 'E1-' THEN '9' || doc_id ELSE doc_id || '@x.example' END AS observed_value,
      CASE e.id WHEN 'E1-' THEN 1e0 ELSE 0.5e0 END AS confidence FROM documents, (VALUES ('E1-'), ('E2-')) e(id)""")
def _(t: Inputs) -> DataFrame:
    rows = contracts.contract_entities(contracts.parse_contracts(_contract_text(t), "contract"))
    return rows.select("case_id", "job_id", "entity_id", text.type_to_label(F.col("entity_type")).alias("label"), "observed_value", "confidence")


_PARSED = """SELECT 'CASE-' || (doc_id % 5) AS case_id, 'ART-' || doc_id || '-JOB-' || source AS artifact_id,
    CASE doc_id % 3 WHEN 0 THEN '{{"evidence_id":"EV-M","job_id":"JOB-M"}}' WHEN 1 THEN '{{"evidence_id":"EV-M"}}' ELSE '{{}}' END AS structured_metadata,
    '[{{"observation_id":"O1","observation_type":"DOCUMENT_TEXT","key":"k","value":"plain ' || doc_id || '","confidence":1.0}},'
    || '{{"observation_id":"O2","observation_type":"IMAGE_GPS","key":"g","value":{{"latitude":' || (doc_id % 90) || '}},"confidence":0.5}}]' AS observations
    FROM {documents}"""
_STORED = "SELECT 'ART-' || doc_id || '-JOB-' || source AS artifact_id, 'EV-A' AS evidence_id, 'JOB-' || lang AS processing_job_id FROM {documents} WHERE doc_id % 2 = 0"


def _parsed_sql() -> str:
    return _PARSED.replace("{documents}", "documents").replace("{{", "{").replace("}}", "}")


@query("observation_scan", f"""SELECT p.case_id, coalesce(nullif(structured_metadata->>'$.evidence_id', ''), s.evidence_id, p.artifact_id) AS evidence_id, p.artifact_id,
      coalesce(nullif(structured_metadata->>'$.job_id', ''), s.processing_job_id, 'JOB-UNKNOWN') AS job_id, o.id AS observation_id, o.kind AS observation_type,
      CASE o.id WHEN 'O1' THEN observations->>'$[0].value' ELSE observations->>'$[1].value' END AS value, o.c AS confidence
    FROM ({_parsed_sql()}) p LEFT JOIN ({_plain(_STORED)}) s ON p.artifact_id = s.artifact_id,
      (VALUES ('O1', 'DOCUMENT_TEXT', 1e0), ('O2', 'IMAGE_GPS', 0.5e0)) o(id, kind, c)""")
def _(t: Inputs) -> DataFrame:
    rows = contracts.observation_scan(t.sql(_PARSED), t.sql(_STORED))
    return rows.select("case_id", "evidence_id", "artifact_id", "job_id", "observation_id", "observation_type", "value", "confidence")


@query("observation_scope", f"""SELECT p.artifact_id FROM ({_parsed_sql()}) p LEFT JOIN ({_plain(_STORED)}) s ON p.artifact_id = s.artifact_id
    WHERE p.case_id = 'CASE-3' AND (contains(p.artifact_id, 'JOB-src3') OR coalesce(structured_metadata->>'$.job_id' = 'JOB-src3', false) OR coalesce(s.processing_job_id = 'JOB-src3', false))""")
def _(t: Inputs) -> DataFrame:
    return contracts.observation_scope(t.sql(_PARSED), t.sql(_STORED), "CASE-3", job_id="JOB-src3").select("artifact_id")


@query("contract_validate", """SELECT doc_id, CASE WHEN lang = 'de' THEN 'entities' ELSE '' END AS missing_keys, source <> 'src1' AS artifacts_complete,
      lang <> 'de' AND source <> 'src1' AS is_valid, CAST(1 AS INT) AS artifact_count, CASE WHEN lang = 'de' THEN 0 ELSE 2 END AS entity_count FROM documents""")
def _(t: Inputs) -> DataFrame:
    rows = t.sql("""SELECT doc_id, '{{"contract_version":"1","case_id":"C","evidence_id":"E","source":{{}},"file_record":{{}},"extracted_artifacts":[{{"artifact_id":"A' || doc_id
        || '","extracted_file_path":"' || CASE WHEN source = 'src1' THEN '' ELSE 'x' END || '"}}],' || CASE WHEN lang = 'de' THEN '' ELSE '"entities":["a","b"],' END
        || '"relationships":[],"timeline_events":[],"observation_provenance":{{}}}}' AS contract FROM {documents}""")
    return art.contract_validate(rows).select("doc_id", "missing_keys", "artifacts_complete", "is_valid", "artifact_count", "entity_count")


# --- ledgers -------------------------------------------------------------------


def _loader_id(code: str, value: str) -> str:
    return f"'CAN-{code}-' || upper(sha256('CASE-1:{code}:' || {value})[1:6])"


@query("cdr_load", f"""SELECT {_loader_id('PHO', "'9' || o_custkey")} AS src_id, {_loader_id('PHO', "'80' || o_orderkey")} AS tgt_id, 'EV-' || o_orderstatus AS evidence_id, CAST(0.95 AS DOUBLE) AS confidence
    FROM orders WHERE o_orderpriority <> '5-LOW'""")
def _(t: Inputs) -> DataFrame:
    sheet = t.sql("SELECT ' 9-' || o_custkey AS `A_Number `, CASE WHEN o_orderpriority = '5-LOW' THEN ' ' ELSE '8 0-' || o_orderkey END AS Receiver, o_orderstatus AS s FROM {orders}")
    edges = ledgers.cdr_load(sheet, F.lit("CASE-1"), F.concat(F.lit("EV-"), "s"))
    return edges.select("src_id", "tgt_id", "evidence_id", "confidence")


@query("ledger_load", f"""SELECT {_loader_id('BAN', "'ac' || l_suppkey")} AS src_id, {_loader_id('BAN', "'ac' || l_partkey")} AS tgt_id, 'EV-' || l_orderkey AS evidence_id, CAST(0.9 AS DOUBLE) AS confidence
    FROM lineitem WHERE l_suppkey <> l_partkey""")
def _(t: Inputs) -> DataFrame:
    sheet = t.sql("SELECT 'AC' || l_suppkey AS Debit_Account, ' AC' || l_partkey AS Credit_Account, l_orderkey AS k FROM {lineitem}")
    edges = ledgers.ledger_load(sheet, F.lit("CASE-1"), F.concat(F.lit("EV-"), "k"))
    return edges.select("src_id", "tgt_id", "evidence_id", "confidence")


@query("truth_graph_load", """SELECT 'R-' || l_orderkey || '-' || l_linenumber AS rel_id, 'P-' || l_partkey AS src_id, 'S-' || l_suppkey AS tgt_id,
      CASE WHEN p.p_partkey IS NULL THEN 'Person' WHEN p_size % 2 = 0 THEN 'Organization' ELSE 'Person' END AS src_label,
      CASE WHEN mn.k = 'N' THEN 'PhoneNumber' ELSE mn.l END AS tgt_label,
      CASE l_returnflag WHEN 'N' THEN 'USED_PHONE' WHEN 'A' THEN 'TRANSFERRED_TO' ELSE 'ASSOCIATED_WITH' END AS rel_label
    FROM lineitem LEFT JOIN part p ON l_partkey = p_partkey,
      (SELECT s, max(k) AS k, 'Person' AS l FROM (SELECT l_suppkey AS s, '' AS k FROM lineitem) GROUP BY s) mn WHERE mn.s = l_suppkey""")
def _(t: Inputs) -> DataFrame:
    entities = t.sql("SELECT 'C' AS case_id, 'P-' || p_partkey AS entity_id, p_name AS canonical_name, CASE WHEN p_size % 2 = 0 THEN 'Company' ELSE 'Person' END AS entity_type FROM {part}")
    relations = t.sql("""SELECT 'C' AS case_id, 'R-' || l_orderkey || '-' || l_linenumber AS relationship_id, ' P-' || l_partkey AS source_entity, 'S-' || l_suppkey AS target_entity,
        CASE l_returnflag WHEN 'N' THEN 'uses_phone' WHEN 'A' THEN 'FINANCIAL_TRANSFER' ELSE 'KNOWS' END AS relationship_type, '' AS expected_confidence, 'EV' AS evidence_id FROM {lineitem}""")
    _, edges = ledgers.truth_graph_load(entities, relations)
    return edges.select("rel_id", "src_id", "tgt_id", "src_label", "tgt_label", "rel_label")


@query("truth_graph_nodes", """SELECT 'P-' || p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'Organization' ELSE 'Person' END AS entity_type, p_name AS canonical_name, CAST(1 AS BIGINT) AS observed_count FROM part
    UNION ALL SELECT 'S-' || l_suppkey, 'Person', 'S-' || l_suppkey, 1 FROM lineitem GROUP BY l_suppkey""")
def _(t: Inputs) -> DataFrame:
    """Entities of the sheet, and the ends of relationships that it does not name."""
    entities = t.sql("SELECT 'C' AS case_id, ' P-' || p_partkey AS entity_id, p_name || ' ' AS canonical_name, CASE WHEN p_size % 2 = 0 THEN 'Company' ELSE 'Person' END AS entity_type FROM {part}")
    relations = t.sql("""SELECT 'C' AS case_id, 'R-' || l_orderkey AS relationship_id, 'P-' || l_partkey AS source_entity, 'S-' || l_suppkey AS target_entity,
        'KNOWS' AS relationship_type, '' AS expected_confidence, 'EV' AS evidence_id FROM {lineitem} WHERE l_partkey IN (SELECT p_partkey FROM {part})
        UNION ALL SELECT 'C', 'R-x', 'S-' || l_suppkey, 'S-' || l_suppkey, 'KNOWS', '', 'EV' FROM {lineitem}""")
    nodes, _ = ledgers.truth_graph_load(entities, relations)
    return nodes.select("id", "entity_type", "canonical_name", "observed_count")


# --- keyed tables --------------------------------------------------------------


@query("keyed_upsert", """SELECT user_id, max(event_id) AS event_id, CASE WHEN max(event_id) % 3 = 0 THEN 'again' ELSE arg_max(event_type, event_id) END AS event_type,
      arg_max(value, event_id) AS value FROM events GROUP BY user_id""")
def _(t: Inputs) -> DataFrame:
    """Two halves, and some rows that come in again with the same version and another, smaller text."""
    events = t.table("events").select("user_id", "event_id", "event_type", "value")
    old = events.filter("event_type in ('view', 'click') or event_id % 3 = 0")
    again = events.filter("event_id % 3 = 0").withColumn("event_type", F.lit("again"))
    new = events.filter("event_type not in ('view', 'click') and event_id % 3 <> 0").unionByName(again)
    return keyed.keyed_upsert(old, new, ["user_id"], "event_id")


@query("cross_case_guard", """SELECT e.event_id, coalesce(o.owner = 'CASE-' || e.event_type, true) AS accepted FROM events e
    LEFT JOIN (SELECT 'ART-' || (o_orderkey % 5000) AS artifact_id, min('CASE-' || CASE o_orderstatus WHEN 'F' THEN 'view' ELSE 'click' END) AS owner FROM orders GROUP BY 1) o
    ON o.artifact_id = 'ART-' || e.event_id""")
def _(t: Inputs) -> DataFrame:
    old = t.sql("SELECT 'ART-' || (o_orderkey % 5000) AS artifact_id, 'CASE-' || CASE o_orderstatus WHEN 'F' THEN 'view' ELSE 'click' END AS case_id FROM {orders}")
    new = t.sql("SELECT event_id, 'ART-' || event_id AS artifact_id, 'CASE-' || event_type AS case_id FROM {events}")
    return keyed.cross_case_guard(old, new, "artifact_id").select("event_id", "accepted")


@query("delete_cascade", """SELECT 'artifacts' AS table_name, artifact_id AS row_id FROM artifacts WHERE case_id NOT IN ('CASE-src3', 'CASE-src7')
    UNION ALL SELECT 'observations', observation_id FROM doc_obs WHERE case_id NOT IN ('CASE-src3', 'CASE-src7')
    UNION ALL SELECT 'jobs', 'JOB-' || doc_id FROM documents WHERE source NOT IN ('src3', 'src7')
    UNION ALL SELECT 'evidence', 'EV-' || doc_id FROM documents WHERE source NOT IN ('src3', 'src7')
    UNION ALL SELECT 'cases', 'CASE-' || source FROM documents WHERE source NOT IN ('src3', 'src7') GROUP BY source""", "artifacts doc_obs")
def _(t: Inputs) -> DataFrame:
    gone = t.sql("SELECT DISTINCT 'CASE-' || source AS case_id FROM {documents} WHERE source IN ('src3', 'src7')")
    tables = {
        "artifacts": t.bound("artifacts").select("case_id", F.col("artifact_id").alias("row_id")),
        "observations": t.bound("doc_obs").select("case_id", F.col("observation_id").alias("row_id")),
        "jobs": t.sql("SELECT 'CASE-' || source AS case_id, 'JOB-' || doc_id AS row_id FROM {documents}"),
        "evidence": t.sql("SELECT 'CASE-' || source AS case_id, 'EV-' || doc_id AS row_id FROM {documents}"),
        "cases": t.sql("SELECT DISTINCT 'CASE-' || source AS case_id, 'CASE-' || source AS row_id FROM {documents}"),
    }
    kept = keyed.delete_cascade(tables, gone)
    parts = [df.select(F.lit(name).alias("table_name"), "row_id") for name, df in kept.items()]
    return reduce(DataFrame.unionByName, parts)


@query("delete_by_job", "SELECT artifact_id, nullif(processing_job_id, 'JOB-src6') AS processing_job_id FROM artifacts WHERE processing_job_id <> 'JOB-src5'", "artifacts")
def _(t: Inputs) -> DataFrame:
    rows = t.bound("artifacts").withColumn("processing_job_id", F.nullif("processing_job_id", F.lit("JOB-src6")))
    return keyed.delete_by_job(rows, "JOB-src5").select("artifact_id", "processing_job_id")


@query("newest_first_list", "SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS placed FROM orders WHERE o_custkey = 7")
def _(t: Inputs) -> DataFrame:
    listed = keyed.newest_first_list(t.table("orders"), F.col("o_custkey") == 7, "o_orderdate", "o_orderkey")
    return listed.select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("placed"))


@query("newest_per_owner", """SELECT o_custkey, o_orderkey, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders) r
    WHERE rank <= 3""")
def _(t: Inputs) -> DataFrame:
    return keyed.newest_per_owner(t.table("orders"), "o_custkey", "o_orderdate", "o_orderkey", 3).select("o_custkey", "o_orderkey", "rank")


@query("bulk_graph_write", """SELECT 'edges' AS part, rel_label AS label, count(*) AS n, count(DISTINCT src_id || '>' || tgt_id) AS ids FROM links GROUP BY rel_label
    UNION ALL SELECT 'nodes', entity_type, count(*), count(DISTINCT id) FROM nodes GROUP BY entity_type""", "links nodes")
def _(t: Inputs) -> DataFrame:
    """Write the graph partitioned by label, read it back and count."""
    import uuid

    path = f"{ensure_checkpoint_dir(t.spark)}/threadline/graph-{uuid.uuid4().hex}"
    keyed.bulk_graph_write(t.bound("nodes"), t.bound("links"), path)
    read = lambda part: t.spark.read.parquet(f"{path}/{part}")
    edges = read("edges").select(F.lit("edges").alias("part"), F.col("rel_label").alias("label"), F.concat("src_id", F.lit(">"), "tgt_id").alias("id"))
    nodes = read("nodes").select(F.lit("nodes").alias("part"), F.col("entity_type").alias("label"), "id")
    return edges.unionByName(nodes).groupBy("part", "label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))


# --- files ---------------------------------------------------------------------


@query("hash_manifest", "SELECT 'doc/' || doc_id AS path, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes, sha256(text) AS sha256 FROM documents")
def _(t: Inputs) -> DataFrame:
    rows = t.sql("SELECT 'doc/' || doc_id AS path, CAST(octet_length(text) AS BIGINT) AS length, CAST(text AS BINARY) AS content FROM {documents}")
    return files.hash_manifest(rows)


@query("master_digest", "SELECT source AS owner, sha256(string_agg(sha256(text), '' ORDER BY 'doc/' || doc_id)) AS master_digest, count(*) AS files FROM documents GROUP BY source")
def _(t: Inputs) -> DataFrame:
    rows = t.sql("SELECT source AS owner, 'doc/' || doc_id AS path, sha2(text, 256) AS sha256 FROM {documents}")
    return files.master_digest(rows, "owner")


def _tree(levels: int) -> str:
    text = "SELECT source AS owner, row_number() OVER (PARTITION BY source ORDER BY 'doc/' || doc_id) - 1 AS place, sha256(text) AS digest FROM documents"
    for _ in range(levels):
        text = f"""SELECT owner, place // 4 AS place, CASE WHEN any_value(n) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY place)) END AS digest
            FROM (SELECT *, count(*) OVER (PARTITION BY owner) AS n FROM ({text}) t) c GROUP BY owner, place // 4"""
    return text


@query("tree_digest", f"SELECT owner, digest AS tree_digest, files FROM ({_tree(8)}) d JOIN (SELECT source, count(*) AS files FROM documents GROUP BY 1) n ON n.source = owner")
def _(t: Inputs) -> DataFrame:
    rows = t.sql("SELECT source AS owner, 'doc/' || doc_id AS path, sha2(text, 256) AS sha256 FROM {documents}")
    return files.tree_digest(rows, "owner", 4)


@query("segment_gap_check", """SELECT directory, name, CAST(previous AS INT) AS previous, CAST(segment AS INT) AS segment FROM (
      SELECT directory, name, segment, lag(segment) OVER (PARTITION BY directory ORDER BY segment) AS previous FROM (
        SELECT 'D' || l_suppkey AS directory, 'set.E' || CASE WHEN l_partkey < 10 THEN '0' ELSE '' END || l_partkey AS name, l_partkey AS segment FROM lineitem GROUP BY ALL) s) r
    WHERE segment <> previous + 1""")
def _(t: Inputs) -> DataFrame:
    rows = t.sql("SELECT DISTINCT 'D' || l_suppkey AS directory, 'set' AS stem, 'set.E' || CASE WHEN l_partkey < 10 THEN '0' ELSE '' END || l_partkey AS name FROM {lineitem}")
    return files.segment_gap_check(rows).select("directory", "name", "previous", "segment")


_INCOMING = """SELECT 'CASE-' || source AS case_id, 'EV-' || doc_id AS evidence_id, 'f' || (doc_id - doc_id % 40) AS filename,
    CAST(CASE WHEN doc_id % 9 = 0 THEN '' ELSE text END AS BINARY) AS content FROM {documents}"""
_STORED_FILES = "SELECT 'CASE-' || source AS case_id, 'f' || (doc_id - doc_id % 40) AS filename FROM {documents} WHERE doc_id % 7 = 0"
_NEW_FILES = """(SELECT d.*, s.doc_id IS NOT NULL AS stored, row_number() OVER (PARTITION BY d.source, d.doc_id - d.doc_id % 40 ORDER BY d.doc_id % 9 = 0, 'EV-' || d.doc_id) AS n
    FROM documents d LEFT JOIN (SELECT source, doc_id - doc_id % 40 AS k, min(doc_id) AS doc_id FROM documents WHERE doc_id % 7 = 0 GROUP BY 1, 2) s
      ON s.source = d.source AND s.k = d.doc_id - d.doc_id % 40) f"""


@query("evidence_register", f"""SELECT 'EV-' || doc_id AS evidence_id, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes, sha256(text) AS sha256, md5(text) AS md5
    FROM {_NEW_FILES} WHERE NOT stored AND doc_id % 9 <> 0 AND n = 1""")
def _(t: Inputs) -> DataFrame:
    """Several new files share a name, some are empty, some names are stored already."""
    return files.evidence_register(t.sql(_INCOMING), t.sql(_STORED_FILES)).select("evidence_id", "size_bytes", "sha256", "md5")


@query("evidence_rejects", f"""SELECT 'EV-' || doc_id AS evidence_id, CASE WHEN doc_id % 9 = 0 THEN 'EMPTY' WHEN stored THEN 'ALREADY_STORED' ELSE 'SAME_NAME_IN_BATCH' END AS reason
    FROM {_NEW_FILES} WHERE stored OR doc_id % 9 = 0 OR n > 1""")
def _(t: Inputs) -> DataFrame:
    return files.evidence_rejects(t.sql(_INCOMING), t.sql(_STORED_FILES)).select("evidence_id", "reason")


@query("candidate_sets", """SELECT 'cand_set_' || p_name_u AS candidate_id, directory, segment_count, total_size_bytes, format FROM (
      SELECT regexp_replace(lower('x' || (p_partkey % 50)), '[^a-zA-Z0-9_]', '_', 'g') AS p_name_u, p_brand AS directory, count(*) AS segment_count,
        CAST(sum(p_size) AS BIGINT) AS total_size_bytes, CASE WHEN count(*) FILTER (p_size % 3 = 0) > 0 THEN 'E01' ELSE 'RAW' END AS format, count(*) FILTER (p_size % 3 <> 1) AS primaries
      FROM part GROUP BY ALL) g WHERE primaries > 0""")
def _(t: Inputs) -> DataFrame:
    rows = t.sql("""SELECT p_brand AS directory, 'set x' || (p_partkey % 50) || CASE p_size % 3 WHEN 0 THEN '.E01' WHEN 1 THEN '.E02' ELSE '.raw' END AS name,
        CAST(p_size AS BIGINT) AS size FROM {part}""")
    return files.candidate_sets(rows).select("candidate_id", "directory", "segment_count", "total_size_bytes", "format")


# --- artifacts -----------------------------------------------------------------

_EXT = """CASE d % 17 WHEN 0 THEN '.pdf' WHEN 1 THEN '.txt' WHEN 2 THEN '.jpg' WHEN 3 THEN '.png' WHEN 4 THEN '.db' WHEN 5 THEN '.sqlite' WHEN 6 THEN '.eml' WHEN 7 THEN '.log'
  WHEN 8 THEN '.csv' WHEN 9 THEN '.xlsx' WHEN 10 THEN '.mp4' WHEN 11 THEN '.wav' WHEN 12 THEN '.e01' WHEN 13 THEN '.docx' WHEN 14 THEN '' WHEN 15 THEN '.xyz' ELSE '.webp' END"""
_RAW = f"(SELECT *, {_EXT} AS e, artifact_type AS k FROM (SELECT *, CAST(artifact_id[5:] AS BIGINT) AS d FROM artifacts_raw) q)"


@query("artifact_classify", f"""SELECT artifact_id,
      CASE WHEN k = 'PARTITION_TABLE' THEN 'PARTITION_TABLE' WHEN k = 'DELETED_FILE' THEN 'DELETED_FILE' WHEN k = 'RECOVERED_FILE' THEN 'RECOVERED_FILE'
        WHEN e IN ('.db', '.sqlite') OR k = 'DATABASE' THEN 'DATABASE' WHEN e IN ('.pdf', '.txt', '.docx') THEN 'DOCUMENT'
        WHEN e IN ('.jpg', '.png', '.webp') OR k = 'IMAGE' THEN 'IMAGE' WHEN e = '.eml' THEN 'EMAIL' WHEN e = '.log' THEN 'LOG'
        WHEN k = 'CDR' THEN 'CDR' WHEN e IN ('.csv', '.xlsx') THEN 'SPREADSHEET' WHEN e IN ('.mp4', '.wav') THEN 'MEDIA' WHEN e = '.e01' THEN 'FORENSIC_IMAGE' ELSE 'OTHER' END AS category,
      CASE WHEN k = 'PARTITION_TABLE' THEN 'application/x-partition-table' WHEN k IN ('DELETED_FILE', 'RECOVERED_FILE') THEN 'application/octet-stream'
        WHEN e IN ('.db', '.sqlite') OR k = 'DATABASE' THEN 'application/x-sqlite3' WHEN e = '.pdf' THEN 'application/pdf' WHEN e = '.txt' THEN 'text/plain' WHEN e = '.docx' THEN 'application/msword'
        WHEN e IN ('.jpg', '.png', '.webp') OR k = 'IMAGE' THEN 'image/' || CASE WHEN e IN ('.jpg', '') THEN 'jpeg' ELSE replace(e, '.', '') END
        WHEN e = '.eml' THEN 'message/rfc822' WHEN e = '.log' THEN 'text/plain' WHEN k = 'CDR' OR e IN ('.csv', '.xlsx') THEN CASE WHEN e = '.csv' THEN 'text/csv' ELSE 'application/vnd.ms-excel' END
        WHEN e = '.mp4' THEN 'video/mp4' WHEN e = '.wav' THEN 'audio/wav' WHEN e = '.e01' THEN 'application/x-forensic-image' ELSE 'application/octet-stream' END AS mime_type,
      CASE WHEN e = '' AND k = 'PARTITION_TABLE' THEN '.hdr' WHEN e = '' AND k = 'DATABASE' THEN '.db' ELSE e END AS file_extension
    FROM {_RAW}""", "artifacts_raw")
def _(t: Inputs) -> DataFrame:
    rows = t.bound("artifacts_raw")
    return rows.select("artifact_id", art.artifact_classify(F.col("artifact_name"), F.col("artifact_type")).alias("c")).select(
        "artifact_id", "c.category", "c.mime_type", "c.file_extension"
    )


@query("artifact_status", """SELECT artifact_id,
      CASE WHEN allocation_status IN ('ALLOCATED', 'UNALLOCATED', 'DELETED', 'UNKNOWN') THEN allocation_status WHEN artifact_type = 'DELETED_FILE' OR is_deleted THEN 'DELETED' ELSE 'ALLOCATED' END AS allocation_status,
      CASE WHEN recovery_status IN ('NONE', 'RECOVERED', 'CARVED', 'PARTIAL', 'UNKNOWN') THEN recovery_status WHEN artifact_type = 'RECOVERED_FILE' OR is_recovered THEN 'RECOVERED'
        WHEN is_carved THEN 'CARVED' ELSE 'NONE' END AS recovery_status FROM artifacts_raw""", "artifacts_raw")
def _(t: Inputs) -> DataFrame:
    return art.build_artifacts(t.bound("artifacts_raw")).select("artifact_id", "allocation_status", "recovery_status")


@query("artifact_id_derive", """SELECT doc_id, 'ART-' || source || '_x-JOB_' || lang || '-' || upper(sha256('CASE_' || source || '/x:EV:JOB ' || lang || ':n:' || doc_id)[1:12]) AS artifact_id FROM documents""")
def _(t: Inputs) -> DataFrame:
    rows = t.sql("SELECT doc_id, CAST(NULL AS STRING) AS a, 'CASE_' || source || '/x' AS c, 'EV' AS e, 'JOB ' || lang AS j, 'n' AS n, CAST(doc_id AS STRING) AS p FROM {documents}")
    return rows.select("doc_id", art.artifact_id_derive(*[F.col(name) for name in "acejnp"]).alias("artifact_id"))


@query("artifact_type_infer", f"""SELECT artifact_id, CASE WHEN d % 4 = 1 THEN 'CDR' WHEN e = '.eml' THEN 'EMAIL' WHEN d % 4 = 0 THEN 'RECOVERED_FILE'
      WHEN d % 4 = 3 OR d % 5 = 0 THEN 'DELETED_FILE' WHEN e IN ('.jpg', '.png', '.webp') THEN 'IMAGE' WHEN e IN ('.pdf', '.txt', '.docx') THEN 'DOCUMENT'
      WHEN e IN ('.db', '.sqlite') THEN 'DATABASE' WHEN e IN ('.csv', '.xlsx') THEN 'SPREADSHEET' WHEN e = '.log' THEN 'LOG' ELSE 'OTHER' END AS artifact_type,
      CASE WHEN d % 4 IN (0, 3) OR d % 5 = 0 THEN 'DELETED' ELSE 'ALLOCATED' END AS allocation_status, CASE WHEN d % 4 = 0 THEN 'CARVED' ELSE 'NONE' END AS recovery_status FROM {_RAW}""", "artifacts_raw")
def _(t: Inputs) -> DataFrame:
    rows = t.bound("artifacts_raw")
    return rows.select("artifact_id", art.artifact_type_infer(F.col("artifact_name"), ~F.col("is_deleted")).alias("i")).select("artifact_id", "i.*")


@query("artifact_filter", """SELECT artifact_id, category FROM artifacts WHERE (allocation_status = 'DELETED' OR category IN ('DELETED', 'DELETED_FILE'))
    AND lower(filename) LIKE '%file_src1%' AND mime_type = 'text/plain'""", "artifacts")
def _(t: Inputs) -> DataFrame:
    found = art.artifact_filter(t.bound("artifacts"), category="DELETED", filename="FILE_src1", mime_type="text/plain")
    return found.select("artifact_id", "category")


@query("artifact_search", "SELECT artifact_id FROM artifacts WHERE lower(filename) LIKE '%src12%' OR lower(artifact_id) LIKE '%src12%' OR sha256 LIKE '%src12%'", "artifacts")
def _(t: Inputs) -> DataFrame:
    return art.artifact_search(t.bound("artifacts"), " SRC12 ").select("artifact_id")


@query("case_search", "SELECT case_id FROM cases WHERE lower(name) LIKE '%nation_1%' OR lower(created_by) LIKE '%nation_1%' OR lower(description) LIKE '%nation_1%'", "cases")
def _(t: Inputs) -> DataFrame:
    return art.case_search(t.bound("cases"), "Nation_1").select("case_id")


@query("explorer_counts", """SELECT b.bucket, count(a.artifact_id) AS count FROM (VALUES ('DOCUMENT'), ('IMAGE'), ('DATABASE'), ('SPREADSHEET'), ('EMAIL'), ('CDR'), ('LOG'), ('RECOVERED'), ('OTHER')) b(bucket)
    LEFT JOIN (SELECT artifact_id, CASE WHEN category = 'RECOVERED_FILE' THEN 'RECOVERED' WHEN category IN ('DELETED_FILE', 'MEDIA') THEN 'OTHER' ELSE category END AS k FROM artifacts) a ON a.k = b.bucket GROUP BY 1""", "artifacts")
def _(t: Inputs) -> DataFrame:
    return art.explorer_counts(t.bound("artifacts"))


@query("text_bounds", """SELECT artifact_id, CAST(page_number AS INT) AS page_number, CAST(length(b) AS INT) AS character_count,
      CAST(len(list_filter(regexp_split_to_array(b, '\\s+'), lambda w: w <> '')) AS INT) AS word_count, false AS truncated,
      b[1:300] || CASE WHEN length(b) > 300 THEN '...' ELSE '' END AS text_snippet
    FROM (SELECT 'CONV-' || conv_id AS artifact_id, turn + 1 AS page_number, text AS b FROM conversations
      UNION ALL SELECT 'DOC-' || doc_id, 1, text FROM documents) p""")
def _(t: Inputs) -> DataFrame:
    pages = t.sql("""SELECT 'CONV-' || conv_id AS artifact_id, CAST(turn + 1 AS INT) AS page_number, text FROM {conversations}
        UNION ALL SELECT 'DOC-' || doc_id, 1, text FROM {documents}""")
    return art.text_bounds(pages)


@query("text_totals", """SELECT 'CONV-' || conv_id AS artifact_id, count(*) AS pages_inspected,
      CAST(sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))) AS BIGINT) AS total_words_extracted FROM conversations GROUP BY 1""")
def _(t: Inputs) -> DataFrame:
    pages = t.sql("SELECT 'CONV-' || conv_id AS artifact_id, CAST(turn + 1 AS INT) AS page_number, text FROM {conversations}")
    return art.text_totals(art.text_bounds(pages))


@query("exif_explode", """SELECT 'IMG-' || p_partkey || '-OBS-EXIF-' || k.t AS observation_id, 'EXIF:' || k.t AS location_reference, CASE k.t WHEN 'Make' THEN p_brand ELSE p_type END AS value
    FROM part, (VALUES ('Make'), ('Model')) k(t)""")
def _(t: Inputs) -> DataFrame:
    images = t.sql("SELECT 'IMG-' || p_partkey AS artifact_id, map('Make', p_brand, 'Model', p_type) AS tags FROM {part}")
    return art.exif_explode(images).select("observation_id", "location_reference", "value")


@query("image_summary", """SELECT 'IMG-' || p_partkey AS artifact_id, CASE WHEN p_size % 5 = 0 THEN 0e0 ELSE round_even(p_partkey::DOUBLE / (p_size % 5), 3) END AS aspect_ratio,
      CAST(2 AS INT) AS exif_tag_count, true AS has_exif FROM part""")
def _(t: Inputs) -> DataFrame:
    images = t.sql("SELECT 'IMG-' || p_partkey AS artifact_id, p_partkey AS width, p_size % 5 AS height, map('Make', p_brand, 'Model', p_type) AS tags, false AS has_gps FROM {part}")
    return art.image_summary(images).select("artifact_id", "aspect_ratio", "exif_tag_count", "has_exif")


@query("extraction_shortlist", """SELECT image_id, path, CAST(tier AS INT) AS tier, too_large, rank FROM (
      SELECT *, n_chars > 10000 AS too_large, row_number() OVER (PARTITION BY image_id ORDER BY tier, doc_id) AS rank FROM (
        SELECT 'IMG-' || source AS image_id, doc_id, '/d' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.xyz' ELSE '/autopsy.db' END AS path,
          n_chars, CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS tier FROM documents WHERE n_chars > 0) f) r""")
def _(t: Inputs) -> DataFrame:
    rows = t.sql("SELECT 'IMG-' || source AS image_id, doc_id AS position, '/d' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.xyz' ELSE '/autopsy.db' END AS path, n_chars AS size FROM {documents}")
    return art.extraction_shortlist(rows, ["autopsy.db"], 10000).select("image_id", "path", "tier", "too_large", "rank")


@query("parse_priority", f"SELECT artifact_id, CASE WHEN k = 'DATABASE' OR e IN ('.db', '.sqlite') THEN 0 WHEN k = 'IMAGE' OR e IN ('.jpg', '.png', '.webp') THEN 1 WHEN e = '.pdf' THEN 2 ELSE 3 END AS priority FROM {_RAW}", "artifacts_raw")
def _(t: Inputs) -> DataFrame:
    return t.bound("artifacts_raw").select("artifact_id", art.parse_priority(F.col("artifact_name"), F.col("artifact_type")).alias("priority"))


@query("format_sniff", """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'PDF' WHEN 1 THEN 'SQLITE' WHEN 2 THEN 'GIF' WHEN 3 THEN 'WEBP' WHEN 4 THEN 'EVF' ELSE 'UNSUPPORTED' END AS format FROM documents""")
def _(t: Inputs) -> DataFrame:
    rows = t.sql("""SELECT doc_id, concat(CASE doc_id % 6 WHEN 0 THEN X'255044462D312E34' WHEN 1 THEN X'53514C69746520666F726D6174203300' WHEN 2 THEN X'474946383961'
        WHEN 3 THEN X'52494646AABBCCDD57454250' WHEN 4 THEN X'455646090D0AFF00' ELSE X'7E7E' END, CAST(text AS BINARY)) AS content FROM {documents}""")
    return rows.select("doc_id", art.format_sniff(F.col("content")).alias("format"))


_TRIAGE = """SELECT 'JOB-' || event_type AS job_id, event_id AS artifact_id, CAST(user_id % 4 AS INT) AS priority, event_id AS position, user_id % 10 <> 0 AS on_disk,
    CAST(value * 100 AS BIGINT) AS size, user_id % 7 <> 0 AS supported, event_id % 13 <> 0 AS parses FROM {events}"""


@query("parse_triage", f"""SELECT job_id, artifact_id, CASE WHEN NOT on_disk THEN 'FILE_NOT_ON_DISK' WHEN NOT supported THEN 'UNSUPPORTED_FORMAT' WHEN NOT parses THEN 'PARSER_ERROR'
      ELSE 'PROCESSED' END AS outcome FROM ({_plain(_TRIAGE)}) q""")
def _(t: Inputs) -> DataFrame:
    return art.parse_triage(t.sql(_TRIAGE)).select("job_id", "artifact_id", "outcome")


@query("parse_triage_bounded", f"""SELECT job_id, artifact_id, CASE WHEN NOT on_disk THEN 'FILE_NOT_ON_DISK' WHEN before >= 150 THEN 'BUDGET_EXCEEDED' WHEN size > 5000 THEN 'EXCEEDS_SIZE_LIMIT'
      WHEN NOT supported THEN 'UNSUPPORTED_FORMAT' WHEN NOT parses THEN 'PARSER_ERROR' ELSE 'PROCESSED' END AS outcome
    FROM (SELECT *, coalesce(sum(CASE WHEN on_disk AND size <= 5000 AND supported AND parses THEN 1 ELSE 0 END)
      OVER (PARTITION BY job_id ORDER BY priority, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({_plain(_TRIAGE)}) q) r""")
def _(t: Inputs) -> DataFrame:
    return art.parse_triage(t.sql(_TRIAGE), budget=150, size_limit=5000).select("job_id", "artifact_id", "outcome")


@query("parse_status", """SELECT event_id, CASE WHEN user_id % 11 = 0 THEN 'FAILED' WHEN value > 90 THEN 'OVERSIZED' WHEN event_type = 'view' THEN 'UNSUPPORTED' WHEN event_type = 'error' THEN 'CORRUPTED'
      WHEN event_type = 'click' THEN 'FAILED' ELSE 'SUCCESS' END AS status, event_type = 'signup' OR user_id % 2 = 0 AS integrity FROM events""")
def _(t: Inputs) -> DataFrame:
    rows = t.sql("""SELECT event_id, user_id % 11 <> 0 AS present, value AS size, event_type <> 'view' AS good, CASE event_type WHEN 'error' THEN 'File is MALFORMED' WHEN 'click' THEN 'boom' END AS problem,
        CASE WHEN user_id % 2 = 0 THEN 'AB' ELSE 'CD' END AS digest, CASE WHEN event_type = 'signup' THEN '' ELSE 'ab' END AS expected FROM {events}""")
    status = art.parse_status(F.col("present"), F.col("size"), F.lit(90), F.col("good"), F.col("problem"))
    return rows.select("event_id", status.alias("status"), art.hash_matches(F.col("digest"), F.col("expected")).alias("integrity"))


@query("parse_cache_reuse", "SELECT artifact_id FROM artifacts WHERE category <> 'IMAGE'", "artifacts")
def _(t: Inputs) -> DataFrame:
    everything = t.bound("artifacts")
    return art.parse_cache_reuse(everything, everything.filter("category = 'IMAGE'")).select("artifact_id")


@query("truth_compare", """SELECT coalesce(a.p_partkey, b.l_partkey) AS part, CASE WHEN a.p_partkey IS NULL THEN 'UNEXPECTED' WHEN b.l_partkey IS NULL THEN 'MISSING' ELSE 'FOUND' END AS verdict,
      CASE WHEN b.l_partkey IS NULL THEN 'HIGH' END AS severity
    FROM (SELECT p_partkey FROM part WHERE p_size > 10) a FULL JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 45) b ON a.p_partkey = b.l_partkey""")
def _(t: Inputs) -> DataFrame:
    expected = t.sql("SELECT p_partkey AS part FROM {part} WHERE p_size > 10")
    observed = t.sql("SELECT l_partkey AS part FROM {lineitem} WHERE l_quantity > 45")
    return art.truth_compare(expected, observed, ["part"])
