"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

OP2 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS tie FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place
  FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][place % 3 + 1] AS weight, source_size * 2 AS most FROM s),
b AS (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE AS budget, sum(weight)::DOUBLE AS w FROM w),
passes(level) AS (
  SELECT budget / w FROM b
  UNION ALL
  SELECT fresh FROM (
    SELECT level, ((SELECT budget FROM b) - coalesce(sum(most) FILTER (weight * level >= most), 0)::DOUBLE)
      / nullif(sum(weight) FILTER (weight * level < most), 0)::DOUBLE AS fresh
    FROM passes, w GROUP BY level) WHERE fresh > level),
t AS (
  SELECT source, source_size, least(most::DOUBLE, weight * (SELECT max(level) FROM passes)) AS target,
    ('0x' || substr(md5('mix-1:' || coalesce('s' || source, 'none')), 1, 8))::BIGINT::DOUBLE / 4294967296::DOUBLE AS shift FROM w),
j AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.shift,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.tie, d.doc_id NULLS FIRST)::DOUBLE AS n
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (floor(n * rate + shift) - floor((n - 1) * rate + shift))::INTEGER AS copies FROM j)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM c"""

OP3 = r"""
WITH t AS (
  SELECT conv_id, role, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)),
c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY place) AS turns, count(*) AS n_turns FROM t GROUP BY conv_id),
d AS (SELECT turns, n_turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY turns, n_turns),
k AS (
  SELECT * FROM d WHERE NOT EXISTS (
    SELECT 1 FROM d AS l WHERE l.n_turns > d.n_turns AND l.turns[1] = d.turns[1] AND l.turns[1:d.n_turns] = d.turns))
SELECT k.conv_id, ((t.place - 1) // 256)::INTEGER AS part, k.n_turns, k.n_copies,
  string_agg('<|im_start|>' || replace(coalesce(t.role, ''), '<|', '< |') || chr(10)
    || replace(coalesce(t.text, ''), '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY t.place) AS text
FROM k JOIN t ON t.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY ALL"""

OP7 = r"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, to_timestamp(1704067200 + coalesce(page_id, 0)) AT TIME ZONE 'UTC' AS date,
    coalesce(page_id, 0) % 12 AS nth FROM pages),
x AS (
  SELECT *, '"' || md5(html) || '"' AS tag, strftime(date, '%Y-%m-%d %H:%M:%S') || ' GMT' AS since,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM p),
u AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '')
    || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS main,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda q: q <> '')), '&') AS query FROM x),
r AS (SELECT *, main || CASE WHEN query = '' THEN '' ELSE '?' || query END AS key FROM u),
v AS (
  SELECT *, CASE WHEN nth = 9 THEN date - INTERVAL 3650 DAYS ELSE date + INTERVAL 1 DAY END AS later,
    CASE WHEN nth IN (3, 5) THEN NULL WHEN nth = 7 THEN '"other"' ELSE tag END AS v_tag,
    CASE WHEN nth = 5 THEN since END AS v_since FROM r),
f AS (
  SELECT v.*, s.page_id AS t_id, s.tag AS t_tag, s.since AS t_since, s.html AS t_html,
    row_number() OVER (PARTITION BY v.page_id ORDER BY s.date DESC NULLS LAST, 'r' || s.page_id DESC) AS n
  FROM v LEFT JOIN r AS s ON s.key = v.key AND s.date < v.later),
o AS (
  SELECT *, CASE WHEN t_id IS NULL THEN 'orphan' WHEN coalesce(v_tag = t_tag, v_since = t_since) IS NULL THEN 'unverified'
    WHEN coalesce(v_tag = t_tag, v_since = t_since) THEN 'resolved' ELSE 'changed' END AS outcome FROM f WHERE n = 1)
SELECT 'v' || page_id AS record_id, key AS url_key, 'r' || t_id AS refers_to, outcome,
  CASE WHEN outcome = 'resolved' THEN 200 END AS http_status,
  CASE WHEN outcome = 'resolved' THEN array_to_string(list_filter([
    'content-type: text/html; charset=utf-8', CASE WHEN v_tag IS NULL THEN 'etag: ' || t_tag END,
    CASE WHEN v_since IS NULL THEN 'last-modified: ' || t_since END, 'content-length: ' || strlen(t_html),
    CASE WHEN v_tag IS NOT NULL THEN 'etag: W/' || v_tag END, CASE WHEN v_since IS NOT NULL THEN 'last-modified: ' || v_since END,
    'cache-control: max-age=120', 'x-cache: HIT'], lambda h: h IS NOT NULL), chr(13) || chr(10)) END AS headers,
  CASE WHEN outcome = 'resolved' THEN md5(t_html) END AS payload_md5,
  CASE WHEN outcome = 'resolved' THEN strlen(t_html)::INTEGER END AS payload_bytes
FROM o"""

_STEPS = "\n".join(
    rf"""
counts{k} AS (SELECT right(gram, {k + 1}) AS tail, sum(yes) AS yes, sum(no) AS no FROM train GROUP BY 1),
after{k} AS (
  SELECT left(tail, {k}) AS context, sum(yes) AS n_yes, count(*) FILTER (yes > 0) AS k_yes, sum(no) AS n_no,
    count(*) FILTER (no > 0) AS k_no FROM counts{k} GROUP BY 1),
level{k} AS (
  SELECT gram, CASE WHEN coalesce(n_yes, 0) > 0 THEN (coalesce(yes, 0) + k_yes * p_yes) / (n_yes + k_yes) ELSE p_yes END AS p_yes,
    CASE WHEN coalesce(n_no, 0) > 0 THEN (coalesce(no, 0) + k_no * p_no) / (n_no + k_no) ELSE p_no END AS p_no
  FROM {f'level{k - 1}' if k else 'asked'} AS l LEFT JOIN counts{k} AS c ON c.tail = right(l.gram, {k + 1})
    LEFT JOIN after{k} AS a ON a.context = left(right(l.gram, {k + 1}), {k})),"""
    for k in range(5)
)

OP9 = rf"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p),
urls AS (
  SELECT DISTINCT url, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'yes' WHEN rule IS NOT NULL THEN 'no' END AS side,
    ('0x' || substr(md5(url), 1, 4))::INTEGER % 5 = 0 AS held FROM r),
padded AS (SELECT *, repeat(chr(2), 4) || url || chr(3) AS text FROM urls),
grams AS (
  SELECT url, side, held, substr(text, i, 5) AS gram
  FROM (SELECT url, side, held, text, unnest(range(1, length(text) - 3)) AS i FROM padded)),
train AS (
  SELECT gram, count(*) FILTER (side = 'yes') AS yes, count(*) FILTER (side = 'no') AS no
  FROM grams WHERE side IS NOT NULL AND NOT held GROUP BY gram),
asked AS (SELECT DISTINCT gram, 1.0::DOUBLE / 256 AS p_yes, 1.0::DOUBLE / 256 AS p_no FROM grams WHERE side IS NULL OR held),
{_STEPS}
scores AS (
  SELECT url, side, held, sum(ln(p_yes) - ln(p_no)) / count(*) AS score FROM grams JOIN level4 USING (gram)
  WHERE side IS NULL OR held GROUP BY url, side, held),
cut AS (
  SELECT avg(score) FILTER (side = 'yes') AS my, avg(score) FILTER (side = 'no') AS mn,
    stddev_pop(score) FILTER (side = 'yes') + 1e-9 AS sy, stddev_pop(score) FILTER (side = 'no') + 1e-9 AS sn FROM scores WHERE held)
SELECT r.page_id, r.host, r.path, r.rule, CASE
  WHEN r.rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN r.rule IS NOT NULL THEN 'block'
  WHEN cut.my IS NULL OR cut.mn IS NULL OR s.score >= (cut.my * cut.sn + cut.mn * cut.sy) / (cut.sy + cut.sn) THEN 'allow'
  ELSE 'block' END AS verdict
FROM r CROSS JOIN cut LEFT JOIN (SELECT url, score FROM scores WHERE side IS NULL) AS s ON s.url = r.url"""


OP13 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS z, row_number() OVER () AS r
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)),
s AS (
  SELECT a.vec_id AS anchor_id, a.r AS anchor, x.vec_id AS id, x.r, x.label = a.label AS positive, list_inner_product(a.z, x.z)::BIGINT AS score
  FROM v AS a JOIN v AS x ON a.r <> x.r WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE positive QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id NULLS LAST) <= 5)
SELECT p.anchor_id, p.id AS positive_id,
  row_number() OVER (PARTITION BY p.anchor, p.r ORDER BY n.score DESC, n.id NULLS LAST)::INTEGER AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s AS n ON n.anchor = p.anchor AND NOT n.positive AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10"""


def sql() -> dict[str, str]:
    return {"op2_mixing": OP2, "op3_chat_format": OP3, "op7_warc_revisits": OP7, "op9_url_filter": OP9, "op13_hard_negatives": OP13}
