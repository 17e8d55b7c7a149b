"""WARC: resolving not-modified revisits against the latest earlier full response.

A revisit record of a 304 answer holds no payload.  An as-of join by canonical URL
finds the latest full response captured before it; if the validators agree, the
response stands in for the revisit: its payload, its status and its headers, updated
by those headers that a 304 answer may update.

Defined results
---------------
* Full responses are ``response`` records with status 200; others are never referred to.
* Earlier means a strictly smaller date.  Of responses with one date the largest record id counts.
* Outcome ``resolved``: the first validator that both have (ETag compared weakly, else
  Last-Modified) agrees.  ``changed``: it differs.  ``unverified``: they share none.
  ``orphan``: no earlier response.  ``not_304``: the revisit has a status line of another
  status (as one of an identical payload has), so it says nothing about validators.
  Only ``resolved`` revisits get payload and headers.
* A null URL or date makes an orphan.  Malformed header lines are left out; of repeated
  header names all lines count when merging, the first as validator.
* Ids may be null or repeat: revisits and responses are told apart by URL, date and id.
* A response of any length is carried whole, once for each revisit it answers.
* Of responses with one URL, date and id the one with the largest headers, then payload, counts; repeated revisits are resolved one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadline.functions.ordered import sliced
from threadline.llm.common import same
from threadline.session import cut_lineage

#: Fields of a stored response that a 304 answer does not replace (framing, coding and connection fields).
KEPT_FIELDS = [
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type",
    "keep-alive", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
]


def canonical_url(url: Column, scheme: bool = False, www: bool = False, ports: Sequence[int] = (80, 443)) -> Column:
    """Fragment and final slash dropped, host lower-cased, query sorted.

    Scheme and ``www.`` are dropped unless they are to tell URLs apart; so are the given ports.
    """
    whole = F.regexp_replace(F.trim(url), r"#.*$", "")
    begin = r"^[A-Za-z][A-Za-z0-9+.-]*://"
    bare = F.regexp_replace(whole, begin, "")
    host = F.lower(F.regexp_extract(bare, r"^[^/?]*", 0))
    if not www:
        host = F.regexp_replace(host, r"^www\.", "")
    if ports:
        host = F.regexp_replace(host, f":({'|'.join(map(str, ports))})$", "")
    if scheme:
        host = F.concat(F.lower(F.regexp_extract(whole, begin, 0)), host)
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    sorted_ = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: x != "")), "&")
    return F.concat(host, path, F.when(sorted_ == "", F.lit("")).otherwise(F.concat(F.lit("?"), sorted_)))


def header_lines(block: Column) -> Column:
    """Header block to [(name, value)]: names in lower case, in order, without the status line."""
    lines = F.filter(F.split(F.coalesce(block, F.lit("")), r"\r?\n"), lambda x: x.rlike(r"^[!#$%&'*+.^_`|~0-9A-Za-z-]+:"))
    return F.transform(
        lines,
        lambda x: F.struct(
            F.lower(F.regexp_extract(x, r"^([^:]*):", 1)).alias("name"), F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("value")
        ),
    )


def header(lines: Column, name: str) -> Column:
    """First value of a header, null if there is none."""
    return F.get(F.filter(lines, lambda x: x["name"] == name), F.lit(0))["value"]


def status(block: Column) -> Column:
    return F.regexp_extract(F.coalesce(block, F.lit("")), r"^HTTP/\S+ (\d{3})", 1)


def merged_headers(stored: Column, fresh: Column) -> Column:
    """Stored headers, those that the fresh answer may and does name replaced by its own."""
    kept = F.lit(KEPT_FIELDS)
    update = F.filter(fresh, lambda x: ~F.array_contains(kept, x["name"]))
    named_ = F.transform(update, lambda x: x["name"])
    return F.concat(F.filter(stored, lambda x: ~F.array_contains(named_, x["name"])), update)


def latest_earlier(rows: DataFrame) -> DataFrame:
    """``rows`` (key, date, full, id, ...) with ``found``, ``target_date``, ``target``: is there a full row of
    the key with a smaller date, and the date and id of the last.

    Keys are cut into slices of the date order, so a hot key spans many tasks; each
    slice hands its last full row to the next.
    """
    # At one date rows that are not full come first, so that they see only earlier ones.
    order = ["date", "full", "id"]
    parts = sliced(rows, ["key"], order)
    group = ["key", "_slice"]
    full = F.when(F.col("full"), F.struct("id", "date"))
    local = F.last(full, ignorenulls=True).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    ends = parts.groupBy(*group).agg(F.max(F.when(F.col("full"), F.struct("date", "id"))).alias("end"))
    across = Window.partitionBy("key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*group, F.last("end", ignorenulls=True).over(across).alias("before"))
    joined = parts.withColumn("local", local).alias("r").join(ends.alias("e"), same("r", "e", group))
    # The structs tell whether there is a response, also where its id is null.
    of = lambda c: F.when(F.col("r.local").isNotNull(), F.col(f"r.local.{c}")).otherwise(F.col(f"e.before.{c}"))
    found = F.col("r.local").isNotNull() | F.col("e.before").isNotNull()
    return joined.select(*[F.col(f"r.{c}") for c in rows.columns], found.alias("found"), of("date").alias("target_date"), of("id").alias("target"))


def resolve_revisits(records: DataFrame, scheme: bool = False, www: bool = False, ports: Sequence[int] = (80, 443)) -> DataFrame:
    """(record_id, url_key, refers_to, outcome, http_status, headers, payload) for every revisit of ``records``.

    ``records``: record_id, record_type, target_uri, date (timestamp), http_headers, payload.
    ``scheme``, ``www`` and ``ports`` say what ``canonical_url`` tells apart.  Payloads are
    joined last, and only for what is resolved.
    """
    key = canonical_url(F.col("target_uri"), scheme, www, ports)
    full = (F.col("record_type") == "response") & (status(F.col("http_headers")) == "200")
    lines = header_lines(F.col("http_headers"))
    heads = records.select(
        F.col("record_id").alias("id"), key.alias("key"), F.col("date"), F.coalesce(full, F.lit(False)).alias("full"),
        (F.col("record_type") == "revisit").alias("revisit"), lines.alias("lines"), status(F.col("http_headers")).isin("304", "").alias("same"),
    )
    timed = heads.filter("(full or revisit) and key is not null and date is not null")
    asof = latest_earlier(timed.select("key", "date", "full", "id", "revisit"))
    # Revisits of one key, date and id have one response, so they may share its row.
    asof = asof.filter("revisit").select("key", "date", "id", "found", F.col("target_date").alias("stored_date"), F.col("target").alias("refers_to")).distinct()
    revisits = heads.filter("revisit").select("key", "date", "id", "lines", "same")
    linked = revisits.alias("v").join(
        asof.alias("a"),
        (F.col("v.key") == F.col("a.key")) & (F.col("v.date") == F.col("a.date")) & F.col("v.id").eqNullSafe(F.col("a.id")), "left",
    )
    linked = linked.select("v.id", "v.key", "v.lines", "v.same", F.coalesce("a.found", F.lit(False)).alias("found"), "a.stored_date", "a.refers_to")
    linked = cut_lineage(linked)
    stored = records.filter(F.coalesce(full, F.lit(False))).select(
        key.alias("stored_key"), F.col("date").alias("stored_date"), F.col("record_id").alias("refers_to"),
        lines.alias("stored"), "payload",
    ).filter("stored_key is not null and stored_date is not null")
    # Only responses that do repeat pass an aggregation; the join after it stays one that Spark can split
    # where very many revisits refer to one response.
    place = ["stored_key", "stored_date", "refers_to"]
    repeated = cut_lineage(stored.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*place))
    again = same("s", "t", place)
    once = stored.alias("s").join(repeated.alias("t"), again, "left_anti").unionByName(
        stored.alias("s").join(repeated.alias("t"), again, "left_semi").groupBy(*place)
        .agg(F.max(F.struct("stored", "payload")).alias("r")).select(*place, "r.stored", "r.payload")
    )
    # Orphans stay out of the join: as null keys they would all meet in one task.
    joined = linked.filter("found").alias("l").join(
        once.alias("s"),
        (F.col("l.key") == F.col("s.stored_key")) & (F.col("l.stored_date") == F.col("s.stored_date"))
        & F.col("l.refers_to").eqNullSafe(F.col("s.refers_to")), "left",
    ).select("l.id", "l.key", "l.lines", "l.same", "l.found", "l.refers_to", "s.stored", "s.payload")
    orphans = linked.filter("not found").drop("stored_date")
    joined = joined.unionByName(orphans, allowMissingColumns=True)
    tag = lambda c: F.regexp_replace(header(F.col(c), "etag"), r"^W/", "")
    since = lambda c: header(F.col(c), "last-modified")
    agrees = F.coalesce(tag("lines") == tag("stored"), since("lines") == since("stored"))
    outcome = (
        F.when(~F.col("found"), "orphan").when(~F.col("same"), "not_304").when(agrees.isNull(), "unverified").when(agrees, "resolved").otherwise("changed")
    )
    joined = joined.withColumn("outcome", outcome)
    ok = F.col("outcome") == "resolved"
    return joined.select(
        F.col("id").alias("record_id"), F.col("key").alias("url_key"), "refers_to", "outcome",
        F.when(ok, F.lit(200)).alias("http_status"), F.when(ok, merged_headers(F.col("stored"), F.col("lines"))).alias("headers"),
        F.when(ok, F.col("payload")).alias("payload"),
    )


def header_text(headers: Column) -> Column:
    """Headers as lines of text."""
    return F.array_join(F.transform(headers, lambda x: F.concat(x["name"], F.lit(": "), x["value"])), "\r\n")
