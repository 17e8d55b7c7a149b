"""Normalisation, extraction, relationship and resolution queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadline.functions import ids, text
from threadline.operators import relations as rel
from threadline.operators import resolve
from threadline.operators.signals import SCOPE, byte_signals, extract_signals, image_signals
from threadline.operators.ingest import build_case_graph
from threadline.plans.registry import Inputs, query
from threadline.session import bucketed, cut_lineage

# Title case in the SQL engine: every run of letters starts upper case.
_TITLE = (
    "array_to_string(list_transform(regexp_extract_all({0}, '[a-zA-Z]+|[^a-zA-Z]+'), "
    "lambda w: upper(w[1]) || lower(w[2:])), '')"
)


def _title(value: str) -> str:
    return _TITLE.format(value)


def _collapse(value: str) -> str:
    return f"trim(regexp_replace({value}, '\\s+', ' ', 'g'))"


def _norm_person(value: str) -> str:
    bare = f"regexp_replace(trim({value}), '^(?:mr\\.|mrs\\.|ms\\.|dr\\.|prof\\.|shri|smt\\.|mr|mrs|ms|dr|prof)\\s+', '', 'i')"
    return _title(_collapse(f"regexp_replace({bare}, '[^\\w\\s]', '', 'g')"))


def _norm_phone(value: str) -> str:
    d = f"regexp_replace({value}, '[^0-9]', '', 'g')"
    return (
        f"CASE WHEN length({d}) = 10 THEN '+91' || {d} WHEN length({d}) = 12 AND {d} LIKE '91%' THEN '+' || {d} "
        f"WHEN length({d}) = 11 AND {d} LIKE '0%' THEN '+91' || {d}[2:] WHEN {value} LIKE '+%' THEN '+' || {d} ELSE {d} END"
    )


_RAW_NAMES = "CASE p_partkey % 4 WHEN 0 THEN ' Mr. ' WHEN 1 THEN 'dr  ' WHEN 2 THEN 'Shrimp ' ELSE '' END || p_name || CASE p_size % 3 WHEN 0 THEN ' 3rd_x' WHEN 1 THEN ', o.k-' ELSE '  ' END"
_RAW_PHONES = (
    "CASE o_orderkey % 6 WHEN 0 THEN '+91-9' || lpad(CAST(o_orderkey AS VARCHAR(20)), 9, '0') WHEN 1 THEN '0' || lpad(CAST(o_custkey AS VARCHAR(20)), 10, '8') "
    "WHEN 2 THEN '+1 (415) ' || lpad(CAST(o_custkey AS VARCHAR(20)), 7, '5') WHEN 3 THEN '91 ' || lpad(CAST(o_orderkey AS VARCHAR(20)), 10, '6') "
    "WHEN 4 THEN lpad(CAST(o_orderkey AS VARCHAR(20)), 10, '7') ELSE '12.' || o_custkey END"
)


@query("norm_person", f"SELECT p_partkey, {_norm_person('raw')} AS normalized FROM (SELECT p_partkey, {_RAW_NAMES} AS raw FROM part) r")
def _(t: Inputs) -> DataFrame:
    raw = t.sql(f"SELECT p_partkey, {_RAW_NAMES} AS raw FROM {{part}}")
    return raw.select("p_partkey", text.norm_person(F.col("raw")).alias("normalized"))


@query("norm_phone", f"SELECT o_orderkey, {_norm_phone('raw')} AS normalized FROM (SELECT o_orderkey, {_RAW_PHONES} AS raw FROM orders) r")
def _(t: Inputs) -> DataFrame:
    raw = t.sql(f"SELECT o_orderkey, {_RAW_PHONES} AS raw FROM {{orders}}")
    return raw.select("o_orderkey", text.norm_phone(F.col("raw")).alias("normalized"))


@query("norm_email", "SELECT o_orderkey, 'c' || o_custkey || '@' || lower(o_orderpriority) || '.example.com' AS normalized FROM orders")
def _(t: Inputs) -> DataFrame:
    raw = t.sql("SELECT o_orderkey, '  C' || o_custkey || '@' || o_orderpriority || '.Example.COM ' AS raw FROM {orders}")
    return raw.select("o_orderkey", text.norm_email(F.col("raw")).alias("normalized"))


@query("norm_plate", "SELECT o_orderkey, upper(regexp_replace('dl ' || o_custkey || '-ab.' || o_orderkey, '[\\s.\\-]', '', 'g')) AS normalized FROM orders")
def _(t: Inputs) -> DataFrame:
    raw = t.sql("SELECT o_orderkey, 'dl ' || o_custkey || '-ab.' || o_orderkey AS raw FROM {orders}")
    return raw.select("o_orderkey", text.norm_compact(F.col("raw")).alias("normalized"))


@query("norm_account", "SELECT c_custkey, upper(regexp_replace(lower(c_mktsegment) || ' 00-' || c_custkey || '.7 ', '[\\s.\\-]', '', 'g')) AS normalized FROM customer")
def _(t: Inputs) -> DataFrame:
    raw = t.sql("SELECT c_custkey, lower(c_mktsegment) || ' 00-' || c_custkey || '.7 ' AS raw FROM {customer}")
    return raw.select("c_custkey", text.norm_compact(F.col("raw")).alias("normalized"))


_SPACED = "regexp_replace(raw, '[^\\w\\s]', ' ', 'g')"
_RAW_PLACES = "CASE event_id % 2 WHEN 0 THEN ' ' || (user_id % 90) || '.1234' || (event_id % 9) || '1 , -' || (user_id % 180) || '.5 ' ELSE 'new  ' || event_type || ', zone-' || user_id END"


@query(
    "norm_location",
    f"SELECT event_id, CASE WHEN regexp_matches(raw, '^\\s*[-+]?[0-9]+(\\.[0-9]+)?\\s*,\\s*[-+]?[0-9]+(\\.[0-9]+)?\\s*$') "
    f"THEN printf('%.5f, %.5f', CAST(trim(split_part(raw, ',', 1)) AS DOUBLE), CAST(trim(split_part(raw, ',', 2)) AS DOUBLE)) "
    f"ELSE {_title(_collapse(_SPACED))} END AS normalized "
    f"FROM (SELECT event_id, {_RAW_PLACES} AS raw FROM events) r",
)
def _(t: Inputs) -> DataFrame:
    raw = t.sql(f"SELECT event_id, {_RAW_PLACES} AS raw FROM {{events}}")
    return raw.select("event_id", text.norm_location(F.col("raw")).alias("normalized"))


_RAW_ORGS = "p_name || CASE p_size % 4 WHEN 0 THEN ' Pvt Ltd' WHEN 1 THEN ' inc.' WHEN 2 THEN ' incorporated' ELSE ' Corporation, Limited' END"


@query(
    "norm_org",
    "SELECT p_partkey, " + _title(_collapse("regexp_replace(regexp_replace(trim(raw), '\\b(pvt|ltd|inc|corp|corporation|private|limited)\\b', '', 'gi'), '[^\\w\\s]', '', 'g')"))
    + f" AS normalized FROM (SELECT p_partkey, {_RAW_ORGS} AS raw FROM part) r",
)
def _(t: Inputs) -> DataFrame:
    raw = t.sql(f"SELECT p_partkey, {_RAW_ORGS} AS raw FROM {{part}}")
    return raw.select("p_partkey", text.norm_org(F.col("raw")).alias("normalized"))


_TYPES = "CASE o_orderkey % 6 WHEN 0 THEN 'Phone' WHEN 1 THEN 'EmailAddress' WHEN 2 THEN 'UPI' WHEN 3 THEN 'Vehicle' WHEN 4 THEN 'Person' ELSE 'Other' END"
_ANY = "' Dr. 98' || o_orderkey || ' - X.y  ' || o_orderpriority || ' '"


@query(
    "norm_dispatch",
    f"SELECT o_orderkey, CASE kind WHEN 'Phone' THEN {_norm_phone('raw')} WHEN 'EmailAddress' THEN lower(trim(raw)) "
    f"WHEN 'UPI' THEN upper(regexp_replace(raw, '[\\s.\\-]', '', 'g')) WHEN 'Vehicle' THEN upper(regexp_replace(raw, '[\\s.\\-]', '', 'g')) "
    f"WHEN 'Person' THEN {_norm_person('raw')} ELSE {_collapse('raw')} END AS normalized "
    f"FROM (SELECT o_orderkey, {_TYPES} AS kind, {_ANY} AS raw FROM orders) r",
)
def _(t: Inputs) -> DataFrame:
    raw = t.sql(f"SELECT o_orderkey, {_TYPES} AS kind, {_ANY} AS raw FROM {{orders}}")
    return raw.select("o_orderkey", text.norm_dispatch(F.col("kind"), F.col("raw")).alias("normalized"))


@query(
    "dms_to_decimal",
    "SELECT event_id, round((CASE event_type WHEN 'view' THEN -1e0 WHEN 'click' THEN -1e0 ELSE 1e0 END) * (user_id % 90 + (event_id % 60) / 60.0 + value / 3600.0), 6) AS degrees FROM events",
)
def _(t: Inputs) -> DataFrame:
    parts = t.sql(
        "SELECT event_id, user_id % 90 AS d, event_id % 60 AS m, value AS s, CASE event_type WHEN 'view' THEN 'S' WHEN 'click' THEN 'w' ELSE 'N' END AS ref FROM {events}"
    )
    return parts.select("event_id", F.round(text.dms_to_decimal(F.col("d"), F.col("m"), F.col("s"), F.col("ref")), 6).alias("degrees"))


_LABELS = "CASE o_orderkey % 7 WHEN 0 THEN 'phone' WHEN 1 THEN 'EmailAddress' WHEN 2 THEN 'PERSONNAME' WHEN 3 THEN 'VehiclePlate' WHEN 4 THEN 'address' WHEN 5 THEN 'Org' ELSE o_orderpriority END"


@query(
    "type_to_label",
    f"SELECT o_orderkey, CASE upper({_LABELS}) WHEN 'PHONE' THEN 'PhoneNumber' WHEN 'EMAILADDRESS' THEN 'Email' WHEN 'VEHICLEPLATE' THEN 'Vehicle' "
    "WHEN 'ADDRESS' THEN 'Location' WHEN 'ORG' THEN 'Organization' ELSE 'Person' END AS label FROM orders",
)
def _(t: Inputs) -> DataFrame:
    return t.sql(f"SELECT o_orderkey, {_LABELS} AS kind FROM {{orders}}").select("o_orderkey", text.type_to_label(F.col("kind")).alias("label"))


@query(
    "phone_digit_filter",
    "SELECT o_orderkey, length(d) BETWEEN 10 AND 15 AND list_unique(string_split(d, '')) > 2 AS ok FROM "
    f"(SELECT o_orderkey, regexp_replace({_RAW_PHONES}, '[^0-9]', '', 'g') AS d FROM orders) r",
)
def _(t: Inputs) -> DataFrame:
    raw = t.sql(f"SELECT o_orderkey, {_RAW_PHONES} AS raw FROM {{orders}}")
    return raw.select("o_orderkey", text.phone_digits_ok(F.col("raw")).alias("ok"))


# --- signals -------------------------------------------------------------------

_SIGNAL = ["signal_id", "observation_id", "entity_type", "observed_value", "normalized_value", "extraction_method", "confidence"]


def _tasks(t: Inputs) -> int:
    """The given tables lie in one file and row group each; extraction is dealt into as many tasks as a shuffle has, all cores at least."""
    return max(t.spark.sparkContext.defaultParallelism, int(t.spark.conf.get("spark.sql.shuffle.partitions")))


def _signals(t: Inputs, binding: str, *rules: str) -> DataFrame:
    return extract_signals(t.bound(binding), list(rules), partitions=_tasks(t)).select(*_SIGNAL)


def _signal_sql(source: str, entity: str, observed: str, normalized: str, method: str, score: float, suffix: str = "''", where: str = "true") -> str:
    """SQL twin of one extraction rule over rows ``source`` that yield the observed value."""
    code = entity[:3].upper()
    return (
        f"SELECT 'SIG-{code}-' || upper(sha256(case_id || ':' || observation_id || {suffix} || ':{entity}:' || n)[1:8]) AS signal_id, observation_id, "
        f"'{entity}' AS entity_type, o AS observed_value, n AS normalized_value, {method} AS extraction_method, CAST({score} AS DOUBLE) AS confidence "
        f"FROM (SELECT *, {normalized} AS n FROM (SELECT *, {observed} AS o FROM {source}) q) p WHERE {where}"
    )


def _matches(binding: str, pattern: str, group: int = 0) -> str:
    return f"(SELECT *, unnest(list_distinct(regexp_extract_all(value, '{pattern}', {group}))) AS raw FROM {binding})"


_PHONE_RE = "(?:\\+91[-\\s]?)?[6-9][0-9]{9}\\b|\\+[1-9][0-9]{6,14}\\b"
_NAME_RE = "(?i)\\b(?:name|contact|person|suspect|officer|author|target|subject|holder)\\s*[:=]\\s*([A-Za-z .]{2,40})\\n"
_EMAIL_RE = "\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\b"


@query("sig_text_phone", _signal_sql(_matches("doc_obs", _PHONE_RE), "PhoneNumber", "trim(raw)", _norm_phone("o"), "'REGEX_PHONE_E164'", 1, where="length(n) >= 10"), "doc_obs")
def _(t: Inputs) -> DataFrame:
    return _signals(t, "doc_obs", "sig_text_phone")


@query("sig_text_email", _signal_sql(_matches("doc_obs", _EMAIL_RE), "Email", "trim(raw)", "lower(o)", "'REGEX_RFC5322_EMAIL'", 1), "doc_obs")
def _(t: Inputs) -> DataFrame:
    return _signals(t, "doc_obs", "sig_text_email")


@query("sig_text_name", _signal_sql(
    _matches("cards", _NAME_RE, 1),
    "Person", "trim(raw)", _norm_person("o"), "'STRUCTURED_NAME_PREFIX'", 0.95, where="length(n) >= 3"), "cards")
def _(t: Inputs) -> DataFrame:
    return _signals(t, "cards", "sig_text_name")


@query("sig_text_org", _signal_sql(
    _matches("cards", "(?i)\\b(?:org|organization|company|agency|firm|bank)\\s*[:=]\\s*([A-Za-z0-9 .&]{2,50})\\n", 1),
    "Organization", "trim(raw)", _title(_collapse("regexp_replace(regexp_replace(o, '\\b(pvt|ltd)\\b', '', 'gi'), '[^\\w\\s]', '', 'g')")),
    "'STRUCTURED_ORG_PREFIX'", 0.95, where="length(n) >= 3"), "cards")
def _(t: Inputs) -> DataFrame:
    return _signals(t, "cards", "sig_text_org")


@query("sig_text_ifsc", _signal_sql(_matches("cards", "\\b[A-Z]{4}0[A-Z0-9]{6}\\b"), "BankAccount", "trim(raw)", "upper(o)", "'REGEX_IFSC_CODE'", 1), "cards")
def _(t: Inputs) -> DataFrame:
    return _signals(t, "cards", "sig_text_ifsc")


@query("sig_text_account", _signal_sql(
    _matches("cards", "(?i)\\b(?:a/c|acc|account|bank\\s*a/c)\\s*(?:no\\.?|num(?:ber)?\\.?)?\\s*[:=]?\\s*([0-9]{9,18})\\b", 1),
    "BankAccount", "trim(raw)", "upper(o)", "'STRUCTURED_BANK_ACCOUNT'", 0.95), "cards")
def _(t: Inputs) -> DataFrame:
    return _signals(t, "cards", "sig_text_account")


@query("sig_meta_author", _signal_sql("meta_obs", "Person", "trim(value)", _norm_person("value"), "'PDF_METADATA_AUTHOR'", 0.9, where="key IN ('author', 'creator') AND length(n) >= 3"), "meta_obs")
def _(t: Inputs) -> DataFrame:
    return _signals(t, "meta_obs", "sig_meta_author")


def _row_part(entity: str, path: str, column: str, row: int, normalized: str) -> str:
    return _signal_sql("row_obs", entity, f"trim(value->>'$.rows[{row}].{path}')", normalized, f"'SQLITE_COLUMN:{column}'", 1, suffix=f"'-R{row}'")


@query("sig_row_columns", " UNION ALL ".join([
    _row_part("Person", "name", "name", 0, _norm_person("o")),
    _row_part("PhoneNumber", "phone", "phone", 0, _norm_phone("o")),
    _row_part("Location", "city", "city", 0, _title(_collapse("regexp_replace(o, '[^\\w\\s]', ' ', 'g')"))),
    _row_part("PhoneNumber", "receiver_phone", "receiver_phone", 1, _norm_phone("o")),
    _row_part("PhoneNumber", "Sender_Phone", "Sender_Phone", 1, _norm_phone("o")),
]), "row_obs")
def _(t: Inputs) -> DataFrame:
    return _signals(t, "row_obs", "sig_row_columns")


@query("sig_gps", _signal_sql("gps_obs", "Location", "'Lat: ' || (value->>'$.latitude') || ', Lon: ' || (value->>'$.longitude')",
    "printf('%.5f, %.5f', CAST(value->>'$.latitude' AS DOUBLE), CAST(value->>'$.longitude' AS DOUBLE))", "'AUTOPSY_EXIF_GPS'", 1), "gps_obs")
def _(t: Inputs) -> DataFrame:
    return _signals(t, "gps_obs", "sig_gps")


@query("sig_account", _signal_sql("account_obs", "Email", "trim(value->>'$.account_unique_identifier')", "lower(o)", "'AUTOPSY_ACCOUNTS_TABLE'", 1, where="value->>'$.account_type' = 'EMAIL'"), "account_obs")
def _(t: Inputs) -> DataFrame:
    return _signals(t, "account_obs", "sig_account")


def _comm_part(field: str, tag: str) -> str:
    return _signal_sql("comm_obs", "Email", f"trim(value->>'$.{field}')", "lower(o)", f"'AUTOPSY_ACCOUNT_COMM_{tag}'", 1, suffix=f"'-{tag}'")


@query("sig_comm_pair", _comm_part("from_account", "FROM") + " UNION ALL " + _comm_part("to_account", "TO"), "comm_obs")
def _(t: Inputs) -> DataFrame:
    return _signals(t, "comm_obs", "sig_comm_pair")


_MAIL = (
    "(SELECT *, value->>'$.email_from' AS ef, string_split(value->>'$.email_to', '; ') AS et FROM mail_obs)"
)


@query("sig_message_header", " UNION ALL ".join([
    _signal_sql(_MAIL, "Email", "regexp_extract(ef, '<(.*)>', 1)", "lower(o)", "'AUTOPSY_EMAIL_FROM'", 1, suffix="'-F0'"),
    _signal_sql(_MAIL, "Person", "regexp_extract(ef, '\"(.*)\"', 1)", _norm_person("o"), "'AUTOPSY_EMAIL_FROM_NAME'", 0.95, suffix="'-FP0'"),
    _signal_sql(_MAIL, "Email", "regexp_extract(et[1], '<(.*)>', 1)", "lower(o)", "'AUTOPSY_EMAIL_TO'", 1, suffix="'-T0'"),
    _signal_sql(_MAIL, "Person", "trim(regexp_extract(et[1], '^(.*)<', 1))", _norm_person("o"), "'AUTOPSY_EMAIL_TO_NAME'", 0.95, suffix="'-TP0'"),
    _signal_sql(_MAIL, "Email", "et[2]", "lower(o)", "'AUTOPSY_EMAIL_TO'", 1, suffix="'-T1'"),
]), "mail_obs")
def _(t: Inputs) -> DataFrame:
    return _signals(t, "mail_obs", "sig_message_header")


@query("sig_web_user", _signal_sql("web_obs", "Person", "trim(value->>'$.user_name')", _norm_person("o"), "'AUTOPSY_WEB_USER'", 0.9,
    where="upper(o) NOT IN ('SYSTEM', 'LOCAL SERVICE', 'NETWORK SERVICE', 'ROOT', 'DEFAULT', 'ALL USERS') AND length(n) >= 3"), "web_obs")
def _(t: Inputs) -> DataFrame:
    return _signals(t, "web_obs", "sig_web_user")


_LOOSE = "(?:\\+?[0-9]{1,3}[-\\s]?)?\\(?[0-9]{3}\\)?[-\\s]?[0-9]{3}[-\\s]?[0-9]{4}|\\+?[6-9][0-9]{9,11}"
_LOOSE_MAIL = "[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}"
_DIGITS = "regexp_replace(raw, '[^0-9]', '', 'g')"


@query(
    "sig_bytes_phone",
    f"""SELECT DISTINCT 'ART-' || doc_id AS artifact_id, 'PhoneNumber' AS entity_type, trim(raw) AS observed_value
        FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_LOOSE}')) AS raw FROM documents) m
        WHERE length({_DIGITS}) BETWEEN 10 AND 15 AND list_unique(string_split({_DIGITS}, '')) > 2
        UNION ALL
        SELECT DISTINCT 'ART-' || doc_id, 'Email', raw FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_LOOSE_MAIL}')) AS raw FROM documents) m""",
)
def _(t: Inputs) -> DataFrame:
    files = t.sql("SELECT 'ART-' || doc_id AS artifact_id, text FROM {documents}")
    return byte_signals(files).select("artifact_id", "entity_type", "observed_value")


@query(
    "sig_image_scan",
    f"""SELECT DISTINCT 'PAGE-' || page_id AS artifact_id, 'PhoneNumber' AS entity_type, raw AS observed_value
        FROM (SELECT page_id, unnest(regexp_extract_all(html, '\\+?[1-9][0-9]{{1,14}}')) AS raw FROM pages) m
        UNION ALL
        SELECT DISTINCT 'PAGE-' || page_id, 'Email', raw FROM (SELECT page_id, unnest(regexp_extract_all(html, '{_LOOSE_MAIL}')) AS raw FROM pages) m""",
)
def _(t: Inputs) -> DataFrame:
    files = t.sql("SELECT 'PAGE-' || page_id AS artifact_id, html AS text FROM {pages}")
    return image_signals(files).select("artifact_id", "entity_type", "observed_value")


# --- relationships -------------------------------------------------------------

_REL = ["observation_id", "source_label", "target_label", "rel_label", "extraction_method", "confidence", "source", "target"]


def _written(signals: DataFrame, dealt: int | None = None, unread: tuple[str, ...] = ()) -> DataFrame:
    """Signals extracted and written once, as the relationship rules read them: the digest in bytes, the display id made from it again.

    ``dealt``: the number of partitions that they were extracted in; they stay in these, as
    buckets of their scope, so that rules which pair by the scope read them without a shuffle.
    ``unread``: columns from which nothing that the query returns is made; they are not written.
    """
    packed = signals.drop("signal_id", "provenance_trace", "confidence", *unread)
    if "signal_key" not in unread:
        packed = packed.withColumn("signal_key", F.unhex("signal_key"))
    written = bucketed(packed, *SCOPE, dealt=dealt) if dealt else cut_lineage(packed)
    named = written.withColumns({name: F.lit(None).cast("string") for name in unread})
    if "signal_key" not in unread:
        named = named.withColumn("signal_key", F.lower(F.hex("signal_key")))
    return named.withColumn("signal_id", ids.signal_id(F.col("entity_type"), F.col("signal_key")))


def _related(t: Inputs, binding: str, rule, *rules: str, unread: tuple[str, ...] = ()) -> DataFrame:
    """Relationships of a binding, with the signals' values in place of their ids."""
    found = rule(_written(extract_signals(t.bound(binding), list(rules) or None, partitions=_tasks(t)), _tasks(t), unread))
    # A row whose phones all lie in one column has a caller and nobody called.
    found = found.dropna(subset=["source_value", "target_value"])
    return found.withColumnsRenamed({"source_value": "source", "target_value": "target"}).select(*_REL)


def _rel_sql(binding: str, source_label: str, target_label: str, relation: str, method: str, score: float, source: str, target: str, where: str = "true") -> str:
    return (
        f"SELECT observation_id, '{source_label}' AS source_label, '{target_label}' AS target_label, '{relation}' AS rel_label, "
        f"'{method}' AS extraction_method, CAST({score} AS DOUBLE) AS confidence, {source} AS source, {target} AS target FROM {binding} WHERE {where}"
    )


_NAME0 = _norm_person("(value->>'$.rows[0].name')")
_PHONE0 = _norm_phone("(value->>'$.rows[0].phone')")
_CITY0 = _title(_collapse("regexp_replace(value->>'$.rows[0].city', '[^\\w\\s]', ' ', 'g')"))


@query("rel_row_phone", _rel_sql("row_obs", "Person", "PhoneNumber", "USED_PHONE", "SQLITE_ROW_CONTACT_BINDING", 1, _NAME0, _PHONE0), "row_obs")
def _(t: Inputs) -> DataFrame:
    return _related(t, "row_obs", rel.rel_row_phone, "sig_row_columns")


@query("rel_row_location", _rel_sql("row_obs", "Person", "Location", "LOCATED_AT", "SQLITE_ROW_LOCATION_BINDING", 1, _NAME0, _CITY0), "row_obs")
def _(t: Inputs) -> DataFrame:
    return _related(t, "row_obs", rel.rel_row_location, "sig_row_columns")


@query("rel_row_called", _rel_sql("row_obs", "PhoneNumber", "PhoneNumber", "CALLED", "SQLITE_ROW_COMMUNICATION_LOG", 1,
    _norm_phone("(value->>'$.rows[1].Sender_Phone')"), _norm_phone("(value->>'$.rows[1].receiver_phone')")), "row_obs")
def _(t: Inputs) -> DataFrame:
    return _related(t, "row_obs", rel.rel_row_called, "sig_row_columns")


_PROXIMITY = f"""SELECT observation_id, 'Person' AS source_label, 'PhoneNumber' AS target_label, 'USED_PHONE' AS rel_label,
          'DOCUMENT_STRUCTURED_CONTACT_BLOCK' AS extraction_method, CAST(0.9 AS DOUBLE) AS confidence, {_norm_person('po')} AS source, {_norm_phone('ho')} AS target
        FROM (SELECT *, strpos(value, po) AS pp, strpos(value, ho) AS hp FROM (
          SELECT n.observation_id, n.value, trim(n.raw) AS po, trim(h.raw) AS ho
          FROM {_matches('cards', _NAME_RE, 1)} n
          JOIN {_matches('cards', _PHONE_RE)} h ON n.observation_id = h.observation_id) q) p
        WHERE abs(pp - hp) < 120 AND strpos(substr(value, least(pp, hp), greatest(pp, hp) + length(ho) - least(pp, hp)), chr(10) || chr(10)) = 0
          AND length({_norm_phone('ho')}) >= 10"""


@query("rel_text_proximity", _PROXIMITY, "cards")
def _(t: Inputs) -> DataFrame:
    return _related(t, "cards", rel.rel_text_proximity, "sig_text_phone", "sig_text_name")


@query("rel_account_comm", _rel_sql("comm_obs", "Email", "Email", "COMMUNICATED_WITH", "AUTOPSY_ACCOUNT_RELATIONSHIP", 1,
    "lower(trim(value->>'$.from_account'))", "lower(trim(value->>'$.to_account'))"), "comm_obs")
def _(t: Inputs) -> DataFrame:
    return _related(t, "comm_obs", rel.rel_account_comm, "sig_comm_pair", unread=("signal_key", "observed_value", "source_location"))


_FROM_MAIL = "lower(regexp_extract(ef, '<(.*)>', 1))"
_FROM_NAME = _norm_person("regexp_extract(ef, '\"(.*)\"', 1)")
_TO_MAIL = "lower(regexp_extract(et[1], '<(.*)>', 1))"
_TO_NAME = _norm_person("regexp_extract(et[1], '^(.*)<', 1)")


@query("rel_header_used_email", " UNION ALL ".join([
    _rel_sql(_MAIL, "Person", "Email", "USED_EMAIL", "EMAIL_HEADER_NAME_BINDING", 1, _FROM_NAME, _FROM_MAIL),
    _rel_sql(_MAIL, "Person", "Email", "USED_EMAIL", "EMAIL_HEADER_NAME_BINDING", 1, _TO_NAME, _TO_MAIL),
]), "mail_obs")
def _(t: Inputs) -> DataFrame:
    return _related(t, "mail_obs", rel.rel_header_used_email, "sig_message_header")


@query("rel_header_used_email_parity", " UNION ALL ".join([
    _rel_sql(_MAIL, "Person", "Email", "USED_EMAIL", "EMAIL_HEADER_NAME_BINDING", 1, _FROM_NAME, _FROM_MAIL),
    _rel_sql(_MAIL, "Person", "Email", "USED_EMAIL", "EMAIL_HEADER_NAME_BINDING", 1, _TO_NAME, _TO_MAIL),
    _rel_sql(_MAIL, "Person", "Email", "USED_EMAIL", "EMAIL_HEADER_NAME_BINDING", 1, _TO_NAME, "lower(et[2])"),
]), "mail_obs")
def _(t: Inputs) -> DataFrame:
    return _related(t, "mail_obs", lambda s: rel.rel_header_used_email(s, strict=False), "sig_message_header")


@query("rel_message_comm", " UNION ALL ".join([
    _rel_sql(_MAIL, "Email", "Email", "COMMUNICATED_WITH", "EMAIL_MESSAGE_COMMUNICATION", 1, _FROM_MAIL, _TO_MAIL),
    _rel_sql(_MAIL, "Email", "Email", "COMMUNICATED_WITH", "EMAIL_MESSAGE_COMMUNICATION", 1, _FROM_MAIL, "lower(et[2])"),
]), "mail_obs")
def _(t: Inputs) -> DataFrame:
    return _related(t, "mail_obs", rel.rel_message_comm, "sig_message_header")


@query("rel_message_person_comm", _rel_sql(_MAIL, "Person", "Person", "COMMUNICATED_WITH", "EMAIL_MESSAGE_PERSON_COMMUNICATION", 0.95, _FROM_NAME, _TO_NAME), "mail_obs")
def _(t: Inputs) -> DataFrame:
    return _related(t, "mail_obs", rel.rel_message_person_comm, "sig_message_header")


@query(
    "rel_no_cooccurrence",
    f"SELECT observation_id, source_label, target_label, rel_label, source, target FROM ({_PROXIMITY}) p",
    "cards",
)
def _(t: Inputs) -> DataFrame:
    """Every relationship of texts that name two people each: phones near a name, and no person with a person."""
    found = _related(t, "cards", rel.extract_relationships)
    return found.select("observation_id", "source_label", "target_label", "rel_label", "source", "target")


# --- resolution ----------------------------------------------------------------

def _name_signals(t: Inputs) -> DataFrame:
    rows = t.sql(
        "SELECT 'CASE-' || p_type AS case_id, 'EV-' || p_brand AS evidence_id, 'ART-' || p_size AS artifact_id, 'JOB-NAMES' AS job_id, "
        "'OBS-' || p_partkey AS observation_id, 'Person' AS entity_type, p_name AS observed_value, p_partkey AS seq FROM {part}"
    )
    normalized = rows.withColumn("normalized_value", text.norm_person(F.col("observed_value")))
    key = ids.digest(F.col("case_id"), F.col("observation_id"), F.col("entity_type"), F.col("normalized_value"))
    return normalized.withColumn("signal_key", key).withColumn("signal_id", ids.signal_id(F.col("entity_type"), F.col("signal_key")))


def _resolved(t: Inputs) -> DataFrame:
    return resolve.resolve_values(resolve.distinct_values(_name_signals(t), "seq"))


@query("string_similarity_names")
def _(t: Inputs) -> DataFrame:
    """Similarity of every pair of names close enough to matter, with its exact ratio."""
    values = resolve.distinct_values(_name_signals(t), "seq")
    return resolve.classify_pairs(resolve.candidate_pairs(values, 0.85)).select("case_id", "earlier", "later", F.round("ratio", 6).alias("ratio"))


@query("match_classify_names")
def _(t: Inputs) -> DataFrame:
    values = resolve.distinct_values(_name_signals(t), "seq")
    pairs = resolve.classify_pairs(resolve.candidate_pairs(values, 0.60))
    return pairs.select("case_id", "earlier", "later", "match_class", "confidence", "rule")


@query("initial_match_names")
def _(t: Inputs) -> DataFrame:
    """Full names against the same people with the first name cut to its letter."""
    full = _name_signals(t)
    cut = F.concat(F.upper(F.substring("p_name", 1, 1)), F.lit(" "), F.initcap(F.element_at(F.split("p_name", " "), -1)))
    short = t.sql("SELECT 'CASE-' || p_type AS case_id, 'Person' AS entity_type, p_name, p_partkey + 1000000000 AS seq FROM {part}")
    short = short.select("case_id", "entity_type", cut.alias("normalized_value"), "seq")
    both = full.select("case_id", "entity_type", "normalized_value", "seq").unionByName(short)
    pairs = resolve.classify_pairs(resolve.initial_pairs(resolve.distinct_values(both, "seq")))
    return pairs.select("case_id", "earlier", "later", "match_class", "confidence", "rule")


@query("resolve_entities_names")
def _(t: Inputs) -> DataFrame:
    return resolve.resolve_entities(_resolved(t)).drop("canonical_key")


# Two values in each case: a name, and the name with k letters that it does not have.  All n
# letters of the name match, so the ratio is 2n / (2n + k) by definition.
_GROWN = """SELECT 'CASE-' || c_custkey AS case_id, 'Person' AS entity_type, c_name AS base, c_name || repeat('q', CAST(1 + c_custkey % 30 AS INT)) AS grown, CAST(c_custkey AS BIGINT) AS seq FROM {customer}"""
_GROWN_SQL = _GROWN.replace("{customer}", "customer")
_RATIO = "(2e0 * length(base) / (length(base) + length(grown)))"


def _grown(t: Inputs) -> DataFrame:
    both = t.sql(_GROWN).select("case_id", "entity_type", F.explode(F.array("base", "grown")).alias("normalized_value"), "seq")
    return resolve.distinct_values(both.withColumn("seq", F.col("seq") * 2 + F.length("normalized_value") % 2), F.length("normalized_value"))


@query("string_similarity", f"SELECT case_id, base AS earlier, grown AS later, round({_RATIO}, 6) AS ratio FROM ({_GROWN_SQL}) g WHERE {_RATIO} >= 0.85")
def _(t: Inputs) -> DataFrame:
    """Similarity of every pair close enough to matter, with its exact ratio."""
    found = resolve.classify_pairs(resolve.candidate_pairs(_grown(t), 0.85))
    return found.select("case_id", "earlier", "later", F.round("ratio", 6).alias("ratio"))


@query("match_classify", f"""SELECT case_id, base AS earlier, grown AS later, CASE WHEN {_RATIO} >= 0.85 THEN 'HIGH_CONFIDENCE_FUZZY' ELSE 'AMBIGUOUS_CANDIDATE' END AS match_class,
      round_even({_RATIO}, 2) AS confidence, CASE WHEN {_RATIO} >= 0.85 THEN 'FUZZY_STRING_SIMILARITY' ELSE 'AMBIGUOUS_SIMILARITY_HUMAN_REVIEW_REQUIRED' END AS rule
    FROM ({_GROWN_SQL}) g WHERE {_RATIO} >= 0.6""")
def _(t: Inputs) -> DataFrame:
    found = resolve.classify_pairs(resolve.candidate_pairs(_grown(t), 0.60))
    return found.select("case_id", "earlier", "later", "match_class", "confidence", "rule")


@query("resolve_entities", f"""SELECT case_id, CASE WHEN {_RATIO} >= 0.85 OR k = 0 THEN base ELSE grown END AS canonical_name, CASE WHEN {_RATIO} >= 0.85 THEN 2 ELSE 1 END::BIGINT AS distinct_values,
      CASE WHEN {_RATIO} >= 0.85 THEN round_even({_RATIO}, 2) ELSE 1e0 END AS match_confidence, CASE WHEN {_RATIO} >= 0.85 THEN 'FUZZY_STRING_SIMILARITY' ELSE 'NEW_CANONICAL_ROOT' END AS match_method
    FROM ({_GROWN_SQL}) g, (VALUES (0), (1)) v(k) WHERE k = 0 OR {_RATIO} < 0.85""")
def _(t: Inputs) -> DataFrame:
    """Clusters with fuzzy merging on: the grown name joins the name where the ratio allows it."""
    found = resolve.resolve_entities(resolve.resolve_values(_grown(t)))
    return found.select("case_id", "canonical_name", "distinct_values", "match_confidence", "match_method")


@query("review_queue", f"""SELECT case_id, base AS earlier, grown AS later, round_even({_RATIO}, 2) AS confidence, 'AMBIGUOUS_SIMILARITY_HUMAN_REVIEW_REQUIRED' AS rule
    FROM ({_GROWN_SQL}) g WHERE {_RATIO} >= 0.6 AND {_RATIO} < 0.85""")
def _(t: Inputs) -> DataFrame:
    return resolve.review_queue(resolve.resolve_values(_grown(t))).select("case_id", "earlier", "later", "confidence", "rule")


@query("initial_match", """SELECT 'CASE-' || c_custkey AS case_id, 'Anna ' || c_name AS earlier, 'A ' || c_name || CASE WHEN c_custkey % 2 = 0 THEN 'q' ELSE '' END AS later,
      'AMBIGUOUS_CANDIDATE' AS match_class, 0.75e0 AS confidence, 'PERSON_INITIAL_MATCH_HUMAN_REVIEW_REQUIRED' AS rule FROM customer WHERE c_custkey % 3 <> 0""")
def _(t: Inputs) -> DataFrame:
    """Full names against initials: the last name equal or nearly so; every third has another initial."""
    rows = t.sql("""SELECT 'CASE-' || c_custkey AS case_id, 'Person' AS entity_type, 'Anna ' || c_name AS normalized_value, 0L AS seq FROM {customer}
        UNION ALL SELECT 'CASE-' || c_custkey, 'Person', CASE WHEN c_custkey % 3 = 0 THEN 'B ' ELSE 'A ' END || c_name || CASE WHEN c_custkey % 2 = 0 THEN 'q' ELSE '' END, 1L FROM {customer}""")
    pairs = resolve.classify_pairs(resolve.initial_pairs(resolve.distinct_values(rows, "seq")))
    return pairs.select("case_id", "earlier", "later", "match_class", "confidence", "rule")


@query("resolve_entities_exact_only",
    f"""SELECT 'CASE-' || p_type AS case_id, 'Person' AS entity_type, {_title('p_name')} AS canonical_name, count(*) AS supporting_observations_count,
          'CAN-PER-' || upper(sha256('CASE-' || p_type || ':PER:' || {_title('p_name')})[1:6]) AS canonical_entity_id
        FROM part GROUP BY ALL""")
def _(t: Inputs) -> DataFrame:
    """Resolution with fuzzy merging off, which SQL can check."""
    values = resolve.distinct_values(_name_signals(t), "seq")
    found = resolve.resolve_entities(resolve.resolve_values(values, fuzzy_types=["Organization"]))
    return found.select("case_id", "entity_type", "canonical_name", "supporting_observations_count", "canonical_entity_id")


@query("canonical_id",
    f"SELECT p_partkey, 'CAN-PER-' || upper(sha256('CASE-' || p_type || ':PER:' || {_title('p_name')})[1:6]) AS canonical_entity_id FROM part")
def _(t: Inputs) -> DataFrame:
    named = _name_signals(t)
    key = ids.canonical_key(F.col("case_id"), F.col("entity_type"), F.col("normalized_value"))
    return named.select(F.col("seq").alias("p_partkey"), ids.canonical_id(F.col("entity_type"), key).alias("canonical_entity_id"))


def _exact_mapping(t: Inputs) -> tuple[DataFrame, DataFrame]:
    named = _name_signals(t)
    values = resolve.resolve_values(resolve.distinct_values(named, "seq"), fuzzy_types=["Organization"])
    return named, resolve.signal_to_entity(named, values)


_CAN = f"'CAN-PER-' || upper(sha256('CASE-' || p_type || ':PER:' || {_title('p_name')})[1:6])"


@query("signal_to_entity", f"SELECT 'OBS-' || p_partkey AS observation_id, {_CAN} AS canonical_entity_id FROM part")
def _(t: Inputs) -> DataFrame:
    return _exact_mapping(t)[1].select("observation_id", "canonical_entity_id")


@query("entity_provenance", f"""SELECT DISTINCT {_CAN} AS canonical_entity_id, k.kind, CASE k.kind WHEN 'evidence_id' THEN 'EV-' || p_brand WHEN 'artifact_id' THEN 'ART-' || p_size
    WHEN 'job_id' THEN 'JOB-NAMES' ELSE 'OBS-' || p_partkey END AS ref FROM part, (VALUES ('evidence_id'), ('artifact_id'), ('job_id'), ('observation_id')) k(kind)""")
def _(t: Inputs) -> DataFrame:
    return resolve.entity_provenance(_exact_mapping(t)[1]).select("canonical_entity_id", "kind", "ref")


@query("primary_evidence", f"""SELECT {_CAN} AS canonical_entity_id, min('EV-' || p_brand) AS evidence_id, count(DISTINCT p_brand) AS evidence_count,
    count(DISTINCT p_size) AS artifact_count, CAST(1 AS BIGINT) AS job_count, count(DISTINCT p_partkey) AS observation_count FROM part GROUP BY 1""")
def _(t: Inputs) -> DataFrame:
    found = resolve.primary_evidence(resolve.entity_provenance(_exact_mapping(t)[1]))
    return found.drop("case_id", "canonical_key")


def _canonical(t: Inputs) -> DataFrame:
    signals = extract_signals(t.bound("comm_obs"), ["sig_comm_pair"], partitions=_tasks(t))
    signals = _written(signals, _tasks(t), ("observed_value", "source_location"))
    values = resolve.resolve_values(resolve.distinct_values(signals, "signal_key"), fuzzy_types=["Person"])
    return resolve.canonicalize_relationships(rel.rel_account_comm(signals), resolve.signal_to_entity(signals, values))


def _mail_can(value: str) -> str:
    return f"'CAN-EMA-' || upper(sha256(case_id || ':EMA:' || {value})[1:6])"


@query("canonicalize_relationships", f"""SELECT case_id, {_mail_can("lower(trim(value->>'$.from_account'))")} AS src_id, {_mail_can("lower(trim(value->>'$.to_account'))")} AS tgt_id,
    'COMMUNICATED_WITH' AS rel_label, observation_id, 1e0 AS confidence FROM comm_obs""", "comm_obs")
def _(t: Inputs) -> DataFrame:
    return _canonical(t).select("case_id", "src_id", "tgt_id", "rel_label", "observation_id", "confidence")


@query("review_queue_names")
def _(t: Inputs) -> DataFrame:
    return resolve.review_queue(_resolved(t)).select("case_id", "earlier", "later", "confidence", "rule")


@query("er_evaluate", """
    SELECT CAST(tp AS BIGINT) AS true_matches, CAST(fp - tp AS BIGINT) AS false_matches, CAST(ep - tp AS BIGINT) AS missed_matches,
      round(tp / fp, 6) AS precision, round(tp / ep, 6) AS recall, round(2 * (tp / fp) * (tp / ep) / (tp / fp + tp / ep), 6) AS f1_score
    FROM (SELECT (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*)::DOUBLE n FROM part WHERE p_size > 3 GROUP BY p_name, p_brand)) AS tp,
      (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*)::DOUBLE n FROM part GROUP BY p_brand)) AS fp,
      (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*)::DOUBLE n FROM part WHERE p_size > 3 GROUP BY p_name)) AS ep) x""")
def _(t: Inputs) -> DataFrame:
    truth = t.sql("SELECT p_partkey AS obs_id, p_name AS cluster_id, p_size > 3 AS counted FROM {part}")
    guess = t.sql("SELECT p_partkey AS obs_id, p_brand AS cluster_id FROM {part}")
    found = resolve.er_evaluate(truth, guess)
    return found.select(
        "true_matches", "false_matches", "missed_matches",
        *[F.round(name, 6).alias(name) for name in ("precision", "recall", "f1_score")],
    )


@query("case_graph_ingest", f"""SELECT kind, label, count(*) AS rows FROM (
      SELECT DISTINCT 'NODE' AS kind, 'Email' AS label, case_id || m AS k FROM (SELECT case_id, {_FROM_MAIL} AS m FROM {_MAIL} UNION SELECT case_id, {_TO_MAIL} FROM {_MAIL} UNION SELECT case_id, lower(et[2]) FROM {_MAIL}) a
      UNION ALL SELECT DISTINCT 'NODE', 'Person', case_id || n FROM (SELECT case_id, {_FROM_NAME} AS n FROM {_MAIL} UNION SELECT case_id, {_TO_NAME} FROM {_MAIL}) b
      UNION ALL SELECT DISTINCT 'EDGE', r, case_id || s || '>' || t || '>' || evidence_id FROM (
        SELECT case_id, evidence_id, 'USED_EMAIL' AS r, {_FROM_NAME} AS s, {_FROM_MAIL} AS t FROM {_MAIL} UNION SELECT case_id, evidence_id, 'USED_EMAIL', {_TO_NAME}, {_TO_MAIL} FROM {_MAIL}
        UNION SELECT case_id, evidence_id, 'COMMUNICATED_WITH', {_FROM_MAIL}, {_TO_MAIL} FROM {_MAIL} UNION SELECT case_id, evidence_id, 'COMMUNICATED_WITH', {_FROM_MAIL}, lower(et[2]) FROM {_MAIL}
        UNION SELECT case_id, evidence_id, 'COMMUNICATED_WITH', {_FROM_NAME}, {_TO_NAME} FROM {_MAIL}) e) g GROUP BY 1, 2""", "mail_obs")
def _(t: Inputs) -> DataFrame:
    """Messages to a case graph, fuzzy merging off so that SQL can check it."""
    built = build_case_graph(t.bound("mail_obs"), fuzzy_types=["Organization"], partitions=_tasks(t))
    nodes = built.nodes.groupBy(F.lit("NODE").alias("kind"), F.col("entity_type").alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    edges = built.edges.groupBy(F.lit("EDGE").alias("kind"), F.col("rel_label").alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    return nodes.unionByName(edges)
