"""Engine inputs derived from the driver tables.

Each text runs in Spark (names in braces are DataFrames) and, with the braces
removed, in the SQL engine the checks use.
"""

BINDINGS = {
    # Directed multigraph: every order line links a part and a supplier, one way or the other.
    "links": """
        SELECT 'CASE-' || l_linestatus AS case_id,
          CASE WHEN l_linenumber % 2 = 0 THEN 'S-' || l_suppkey ELSE 'P-' || l_partkey END AS src_id,
          CASE WHEN l_linenumber % 2 = 0 THEN 'P-' || l_partkey ELSE 'S-' || l_suppkey END AS tgt_id,
          'Person' AS src_label, 'Person' AS tgt_label,
          CASE l_returnflag WHEN 'R' THEN 'COMMUNICATED_WITH' WHEN 'A' THEN 'ASSOCIATED_WITH'
            ELSE 'TRANSFERRED_TO' END AS rel_label,
          'EV-' || l_orderkey AS evidence_id,
          1e0 - l_discount AS confidence,
          'REL-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS rel_id,
          'ART-' || l_suppkey AS artifact_id, 'OBS-' || l_orderkey || '-' || l_linenumber AS observation_id,
          'JOB-' || l_returnflag AS job_id, l_shipdate AS observed_at
        FROM {lineitem}""",
    # Nodes of that graph in both cases.
    "nodes": """
        SELECT 'CASE-O' AS case_id, 'P-' || p_partkey AS id, 'Person' AS entity_type, p_name AS canonical_name,
          CAST(p_size AS BIGINT) AS observed_count FROM {part}
        UNION ALL
        SELECT 'CASE-O', 'S-' || s_suppkey, 'Person', s_name, CAST(s_nationkey AS BIGINT) FROM {supplier}
        UNION ALL
        SELECT 'CASE-F' AS case_id, 'P-' || p_partkey AS id, 'Person' AS entity_type, p_name AS canonical_name,
          CAST(p_size AS BIGINT) AS observed_count FROM {part}
        UNION ALL
        SELECT 'CASE-F', 'S-' || s_suppkey, 'Person', s_name, CAST(s_nationkey AS BIGINT) FROM {supplier}""",
    # Brand and supplier graph: few nodes, heavy weights.
    "brand_links": """
        SELECT 'CASE-' || l_linestatus AS case_id,
          CASE WHEN l_linenumber % 2 = 0 THEN 'S-' || l_suppkey ELSE p_brand END AS src_id,
          CASE WHEN l_linenumber % 2 = 0 THEN p_brand ELSE 'S-' || l_suppkey END AS tgt_id,
          'EV-' || l_orderkey AS evidence_id, 'REL-' || l_orderkey || '-' || l_linenumber AS rel_id
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    # Star forest: a customer and its orders.
    "order_links": """
        SELECT 'CASE-' || o_orderstatus AS case_id, 'C-' || o_custkey AS src_id, 'O-' || o_orderkey AS tgt_id,
          'Person' AS src_label, 'Person' AS tgt_label, 'COMMUNICATED_WITH' AS rel_label,
          'EV-' || o_orderpriority AS evidence_id, 'REL-' || o_orderkey AS rel_id, 1e0 AS confidence
        FROM {orders}""",
    # Whole documents as text observations.
    "doc_obs": """
        SELECT 'CASE-' || source AS case_id, 'EV-' || source AS evidence_id, 'ART-' || doc_id AS artifact_id,
          'JOB-' || lang AS job_id, 'ART-' || doc_id || '-OBS-TEXT' AS observation_id,
          'DOCUMENT_TEXT' AS observation_type, 'Page 1' AS location_reference, 'page_1_text' AS key,
          text AS value, 1e0 AS confidence, 'page 1' AS provenance_note
        FROM {documents}""",
    # A contact card per customer.
    "cards": """
        SELECT 'CASE-' || c_nationkey AS case_id, 'EV-' || c_mktsegment AS evidence_id,
          'ART-C' || c_custkey AS artifact_id, 'JOB-CARD' AS job_id, 'ART-C' || c_custkey || '-OBS-TEXT' AS observation_id,
          'DOCUMENT_TEXT' AS observation_type, 'Page 1' AS location_reference, 'page_1_text' AS key,
          'Name: ' || lower(c_mktsegment) || ' holder' || chr(10) || 'Phone: +91-9' || lpad(CAST(c_custkey AS VARCHAR(20)), 9, '0')
            || chr(10) || 'Email: c' || c_custkey || '@Mail.Example.com' || chr(10)
            || CASE WHEN c_custkey % 3 = 0 THEN chr(10) ELSE '' END
            || 'A/C No: ' || lpad(CAST(c_custkey AS VARCHAR(20)), 12, '7') || chr(10) || 'IFSC HDFC0' || lpad(CAST(c_custkey AS VARCHAR(20)), 6, '0')
            || chr(10) || 'Company: ' || lower(c_mktsegment) || ' Pvt Ltd' || chr(10)
            || 'Officer: case clerk' || chr(10) || 'Tel 8' || lpad(CAST(c_custkey AS VARCHAR(20)), 9, '1') AS value,
          1e0 AS confidence, 'page 1' AS provenance_note
        FROM {customer}""",
    # Table rows: one observation per order with a contact row and a call row.
    "row_obs": """
        SELECT 'CASE-' || o_orderstatus AS case_id, 'EV-' || o_orderpriority AS evidence_id, 'ART-DB' AS artifact_id,
          'JOB-DB' AS job_id, 'OBS-' || o_orderkey AS observation_id, 'SQLITE_SAMPLE_ROWS' AS observation_type,
          'Table: t' AS location_reference, 'rows' AS key,
          '{{"rows":[{{"id":' || o_orderkey || ',"name":"clerk ' || o_custkey || '","phone":"9' || lpad(CAST(o_custkey AS VARCHAR(20)), 9, '0')
            || '","city":"zone  ' || o_orderpriority || '"}},{{"receiver_phone":"8' || lpad(CAST(o_orderkey AS VARCHAR(20)), 9, '0')
            || '","Sender_Phone":"7' || lpad(CAST(o_custkey AS VARCHAR(20)), 9, '0') || '","note":1}}]}}' AS value,
          1e0 AS confidence, 'row' AS provenance_note
        FROM {orders}""",
    # Mail messages: one per order, one sender and two recipients, names quoted with a comma.
    "mail_obs": """
        SELECT 'CASE-' || o_orderstatus AS case_id, 'EV-' || o_orderpriority AS evidence_id, 'ART-MAIL' AS artifact_id,
          'JOB-MAIL' AS job_id, 'MSG-' || o_orderkey AS observation_id, 'FORENSIC_EMAIL_MESSAGE' AS observation_type,
          'blackboard_artifacts: ' || o_orderkey AS location_reference, 'msg' AS key,
          '{{"row_id":"' || o_orderkey || '","email_from":"' || chr(92) || '"Clerk, No ' || o_custkey || chr(92) || '" <C' || o_custkey
            || '@Mail.Example.com>","email_to":"desk ' || o_orderstatus || ' <d' || o_orderkey || '@desk.example.org>; plain'
            || o_custkey || '@x.example.net"}}' AS value,
          1e0 AS confidence, 'msg' AS provenance_note
        FROM {orders}""",
    # Account pairs: one per order line.
    "comm_obs": """
        SELECT 'CASE-' || l_linestatus AS case_id, 'EV-' || l_orderkey AS evidence_id, 'ART-COMM' AS artifact_id,
          'JOB-COMM' AS job_id, 'COMM-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS observation_id,
          'FORENSIC_COMMUNICATION' AS observation_type, 'Table: account_relationships' AS location_reference, 'comm' AS key,
          '{{"row_id":"' || l_orderkey || '","from_account":" P' || l_partkey || '@Parts.example.com ","to_account":"s' || l_suppkey
            || '@supp.example.com"}}' AS value,
          1e0 AS confidence, 'comm' AS provenance_note
        FROM {lineitem}""",
    # Device events: positions, accounts and web users.
    "gps_obs": """
        SELECT 'CASE-' || event_type AS case_id, 'EV-' || user_id AS evidence_id, 'ART-GPS' AS artifact_id, 'JOB-GPS' AS job_id,
          'GPS-' || event_id AS observation_id, 'FORENSIC_EXIF_GPS' AS observation_type, 'blackboard_artifacts: ' || event_id AS location_reference,
          'gps' AS key,
          '{{"row_id":"' || event_id || '","latitude":' || (user_id % 60) || '.12' || (event_id % 7) || '3,"longitude":' || (user_id % 120)
            || '.34' || (event_id % 9) || '1,"datetime_created":' || (1700000000 + event_id * 60) || ',"device_make":"Acme","device_model":"M'
            || (user_id % 5) || '"}}' AS value,
          1e0 AS confidence, 'gps' AS provenance_note
        FROM {events}""",
    "account_obs": """
        SELECT 'CASE-' || c_mktsegment AS case_id, 'EV-' || c_nationkey AS evidence_id, 'ART-ACC' AS artifact_id, 'JOB-ACC' AS job_id,
          'ACC-' || c_custkey AS observation_id, 'FORENSIC_ACCOUNT' AS observation_type, 'Table: accounts' AS location_reference, 'acc' AS key,
          '{{"row_id":"' || c_custkey || '","account_type":"' || CASE WHEN c_nationkey % 2 = 0 THEN 'EMAIL' ELSE 'TYPE_2' END
            || '","account_unique_identifier":"  User' || c_custkey || '@Bank.example.com "}}' AS value,
          1e0 AS confidence, 'acc' AS provenance_note
        FROM {customer}""",
    "web_obs": """
        SELECT 'CASE-' || event_type AS case_id, 'EV-' || user_id AS evidence_id, 'ART-WEB' AS artifact_id, 'JOB-WEB' AS job_id,
          'WEB-' || event_id AS observation_id, 'FORENSIC_WEB_HISTORY' AS observation_type, 'blackboard_artifacts: ' || event_id AS location_reference,
          'web' AS key,
          '{{"row_id":"' || event_id || '","user_name":"' || CASE WHEN event_type = 'error' THEN 'System' WHEN event_type = 'click' THEN 'ab'
            ELSE 'user ' || chr(97 + CAST(user_id % 26 AS INT)) || ' ' || event_type END || '"}}' AS value,
          1e0 AS confidence, 'web' AS provenance_note
        FROM {events}""",
    "meta_obs": """
        SELECT 'CASE-' || p_type AS case_id, 'EV-' || p_size AS evidence_id, 'ART-P' || p_partkey AS artifact_id, 'JOB-META' AS job_id,
          'META-' || p_partkey AS observation_id, 'DOCUMENT_METADATA' AS observation_type, 'Info' AS location_reference,
          CASE p_partkey % 3 WHEN 0 THEN 'author' WHEN 1 THEN 'creator' ELSE 'producer' END AS key,
          CASE WHEN p_size % 2 = 0 THEN 'Dr. ' ELSE ' ' END || p_name AS value, 1e0 AS confidence, 'meta' AS provenance_note
        FROM {part}""",
    # Artifacts: one per document, names and flags made from its columns.
    "artifacts_raw": """
        SELECT 'ART-' || doc_id AS artifact_id, 'CASE-' || source AS case_id, 'EV-' || lang AS evidence_id, 'JOB-' || source AS job_id,
          CASE doc_id % 4 WHEN 0 THEN '/carved/' WHEN 1 THEN '/data/cdr/' WHEN 2 THEN '/Users/' ELSE '/Deleted/' END || source || '_' || doc_id ||
          CASE doc_id % 17 WHEN 0 THEN '.pdf' WHEN 1 THEN '.txt' WHEN 2 THEN '.JPG' WHEN 3 THEN '.png' WHEN 4 THEN '.db' WHEN 5 THEN '.sqlite'
            WHEN 6 THEN '.eml' WHEN 7 THEN '.log' WHEN 8 THEN '.csv' WHEN 9 THEN '.xlsx' WHEN 10 THEN '.mp4' WHEN 11 THEN '.wav' WHEN 12 THEN '.E01'
            WHEN 13 THEN '.docx' WHEN 14 THEN '' WHEN 15 THEN '.xyz' ELSE '.webp' END AS artifact_name,
          CASE doc_id % 11 WHEN 0 THEN 'PARTITION_TABLE' WHEN 1 THEN 'DELETED_FILE' WHEN 2 THEN 'RECOVERED_FILE' WHEN 3 THEN 'DATABASE' WHEN 4 THEN 'CDR'
            WHEN 5 THEN 'IMAGE' ELSE 'OTHER' END AS artifact_type,
          CASE doc_id % 13 WHEN 0 THEN 'UNALLOCATED' WHEN 1 THEN 'BOGUS' WHEN 2 THEN 'DELETED' END AS allocation_status,
          CASE doc_id % 19 WHEN 0 THEN 'PARTIAL' WHEN 1 THEN 'NOPE' END AS recovery_status,
          doc_id % 5 = 0 AS is_deleted, doc_id % 7 = 0 AS is_recovered, doc_id % 6 = 0 AS is_carved,
          CAST(n_chars AS BIGINT) AS size_bytes, md5(CAST(doc_id AS VARCHAR(20))) AS sha256
        FROM {documents}""",
    "artifacts": """
        SELECT 'ART-' || doc_id AS artifact_id, 'CASE-' || source AS case_id, 'EV-' || lang AS evidence_id, 'JOB-' || source AS processing_job_id,
          'File_' || source || '_' || doc_id AS filename,
          CASE doc_id % 10 WHEN 0 THEN 'DOCUMENT' WHEN 1 THEN 'IMAGE' WHEN 2 THEN 'DATABASE' WHEN 3 THEN 'EMAIL' WHEN 4 THEN 'LOG' WHEN 5 THEN 'CDR'
            WHEN 6 THEN 'RECOVERED_FILE' WHEN 7 THEN 'DELETED_FILE' WHEN 8 THEN 'MEDIA' ELSE 'SPREADSHEET' END AS category,
          CASE doc_id % 3 WHEN 0 THEN 'ALLOCATED' WHEN 1 THEN 'DELETED' ELSE 'UNALLOCATED' END AS allocation_status,
          CASE doc_id % 5 WHEN 0 THEN 'RECOVERED' WHEN 1 THEN 'CARVED' ELSE 'NONE' END AS recovery_status,
          CASE doc_id % 2 WHEN 0 THEN 'text/plain' ELSE 'image/png' END AS mime_type,
          CAST(n_chars AS BIGINT) AS size_bytes, md5(CAST(doc_id AS VARCHAR(20))) AS sha256
        FROM {documents}""",
    # Audit events: one chain per actor.
    "audit_events": """
        SELECT event_id AS seq, 'U-' || user_id AS actor_id, 'CASE-' || (user_id % 7) AS case_id, event_type AS action,
          CASE WHEN value < 20 THEN 'DENY' ELSE 'ALLOW' END AS decision,
          '{{"action":"' || event_type || '","actor_id":"U-' || user_id || '","event_id":' || event_id || '}}' AS payload
        FROM {events}""",
    "users": """
        SELECT 'U-' || c_custkey AS user_id, 'user' || c_custkey AS username,
          CASE c_custkey % 4 WHEN 0 THEN 'HIGHER_AUTHORITY' WHEN 1 THEN 'COURT_JUDGE' WHEN 2 THEN 'INVESTIGATION_OFFICER' ELSE 'INVESTIGATION_OFFICER' END AS role,
          CASE c_nationkey % 4 WHEN 0 THEN 'SUPREME_COURT' WHEN 1 THEN 'HIGH_COURT' WHEN 2 THEN 'SPECIFIC_COURT' END AS court_level,
          c_acctbal > 0 AS is_active
        FROM {customer}""",
    "grants": """
        SELECT 'U-' || o_custkey AS user_id, CASE WHEN o_orderkey % 97 = 0 THEN '*' ELSE 'CASE-' || (o_orderkey % 25) END AS case_id,
          o_orderkey AS granted_at
        FROM {orders}""",
    "cases": """
        SELECT 'CASE-' || n_nationkey AS case_id, n_name AS name, 'user' || n_regionkey AS created_by, 'Case of ' || n_name AS description,
          'U-' || n_nationkey || ',user' || (n_nationkey + 3) AS assigned_list,
          CASE n_nationkey % 3 WHEN 0 THEN 'CLOSED' WHEN 1 THEN 'ACTIVE' ELSE 'DRAFT' END AS status
        FROM {nation}""",
    "requests": """
        SELECT 'RQ-' || o_orderkey AS request_id, 'U-' || o_custkey AS user_id,
          CASE o_custkey % 4 WHEN 0 THEN 'HIGHER_AUTHORITY' WHEN 1 THEN 'COURT_JUDGE' ELSE 'INVESTIGATION_OFFICER' END AS role,
          CASE o_orderkey % 4 WHEN 0 THEN 'SUPREME_COURT' WHEN 1 THEN 'HIGH_COURT' WHEN 2 THEN 'SPECIFIC_COURT' END AS court_level,
          CASE o_orderkey % 9 WHEN 0 THEN 'REGISTER_EVIDENCE' WHEN 1 THEN 'CREATE_CASE' WHEN 2 THEN 'VIEW_AUDIT_LOGS' WHEN 3 THEN 'JUDICIAL_OVERRIDE'
            WHEN 4 THEN 'CHANGE_OWNERSHIP' WHEN 5 THEN 'REOPEN_CASE' ELSE 'READ_CASE' END AS action,
          'EV-' || (o_orderkey % 500) AS resource_id, 'CASE-' || (o_orderkey % 25) AS target_case_id,
          CASE WHEN o_orderpriority = '1-URGENT' THEN 'CLOSED' ELSE 'ACTIVE' END AS target_case_status,
          CASE WHEN o_orderkey % 10 = 3 THEN 'CASE-1' END AS resource_owner_case_id
        FROM {orders}""",
    # Reports: the orders of a customer are the versions of its report.
    "reports": """
        SELECT 'CASE-' || o_custkey AS case_id, 'REP-' || o_orderkey AS report_id, o_orderdate AS generated_at, o_totalprice AS pages
        FROM {orders}""",
}
