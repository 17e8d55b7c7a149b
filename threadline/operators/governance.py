"""Access decisions, grants, audit chains, reports and integrity checks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadline.functions.ordered import with_previous, with_row_number
from threadline.session import Pile, cut_lineage
from threadline.sources.keyed import keyed_upsert

GENESIS = "0" * 64
# Roles and court levels.
OFFICER, AUTHORITY, JUDGE = "INVESTIGATION_OFFICER", "HIGHER_AUTHORITY", "COURT_JUDGE"
SUPREME, HIGH, SPECIFIC = "SUPREME_COURT", "HIGH_COURT", "SPECIFIC_COURT"


# --- access --------------------------------------------------------------------


def _sees_all() -> Column:
    court = (F.col("role") == JUDGE) & F.col("court_level").isin(SUPREME, HIGH)
    return (F.col("role") == AUTHORITY) | F.coalesce(court, F.lit(False))


def _needs_grant() -> Column:
    court = (F.col("role") == JUDGE) & (F.col("court_level") == SPECIFIC)
    return (F.col("role") == OFFICER) | F.coalesce(court, F.lit(False))


def access_scope(users: DataFrame, grants: DataFrame) -> DataFrame:
    """Cases each user may see as (user_id, case_id); ``*`` stands for all cases.

    ``users`` has (user_id, role, court_level), ``grants`` (user_id, case_id).
    """
    needing = users.filter(_needs_grant()).select("user_id")
    listed = grants.select("user_id", "case_id").join(needing, "user_id", "left_semi")
    whole = listed.filter("case_id = '*'").select("user_id")
    free = users.filter(_sees_all()).select("user_id").unionByName(whole).distinct()
    named = listed.filter("case_id <> '*'").join(free, "user_id", "left_anti").distinct()
    return named.unionByName(free.withColumn("case_id", F.lit("*")))


def case_access_filter(rows: DataFrame, users: DataFrame, grants: DataFrame, user_id: str) -> DataFrame:
    """Rows (with case_id) one user may see: all, or a semi-join on the user's cases."""
    scope = access_scope(users.filter(F.col("user_id") == user_id), grants)
    if not scope.filter("case_id = '*'").isEmpty():
        return rows
    return rows.join(scope.select("case_id"), "case_id", "left_semi")


def owner_resolution(requests: DataFrame, bindings: DataFrame, evidence: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Owning case of each requested resource: given, bound, evidence, artifact, in that order."""
    bound = bindings.groupBy("resource_id").agg(F.max("case_id").alias("_b"))
    ev = evidence.groupBy(F.col("evidence_id").alias("resource_id")).agg(F.max("case_id").alias("_e"))
    art = artifacts.groupBy(F.col("artifact_id").alias("resource_id")).agg(F.max("case_id").alias("_a"))
    joined = requests.join(bound, "resource_id", "left").join(ev, "resource_id", "left").join(art, "resource_id", "left")
    given = F.nullif("resource_owner_case_id", F.lit(""))
    return joined.select(*requests.columns, F.coalesce(given, "_b", "_e", "_a").alias("owner_case_id"))


def access_decisions(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """Decision and reason per request, rules in fixed order; the reason texts are fixed values.

    ``requests`` has (request_id, user_id, role, court_level, action, resource_id,
    target_case_id, target_case_status, owner_case_id); ``grants`` (user_id, case_id).
    """
    role = F.col("role")
    action = F.col("action")
    case_name = F.col("target_case_id")
    star = grants.filter("case_id = '*'").select("user_id").distinct().withColumn("_star", F.lit(True))
    own = grants.filter("case_id <> '*'").select("user_id", F.col("case_id").alias("target_case_id")).distinct()
    rows = requests.join(star, "user_id", "left").join(own.withColumn("_own", F.lit(True)), ["user_id", "target_case_id"], "left")
    granted = F.coalesce("_star", "_own", F.lit(False))

    def no(reason: Column | str) -> Column:
        return F.struct(F.lit(False).alias("allowed"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))

    def yes(reason: str) -> Column:
        return F.struct(F.lit(True).alias("allowed"), F.lit(reason).alias("reason"))

    def role_text(text: str) -> Column:
        return F.concat(F.lit("BFLA DENY: Role '"), role, F.lit(f"' {text}"))

    writer = role.isin(OFFICER, AUTHORITY)
    senior = role.isin(AUTHORITY, JUDGE)
    closed = F.coalesce(F.col("target_case_status") == "CLOSED", F.lit(False))
    foreign = F.coalesce(F.col("owner_case_id") != case_name, F.lit(False))
    decision = (
        F.when((action == "REGISTER_EVIDENCE") & ~writer, no(role_text("cannot register evidence.")))
        .when((action == "CREATE_CASE") & ~writer, no(role_text("cannot create cases.")))
        .when(action == "CREATE_CASE", yes("ALLOW: Authorized role case creation granted."))
        .when((action == "VIEW_AUDIT_LOGS") & ~senior, no(role_text("lacks permission to access audit logs.")))
        .when((action == "JUDICIAL_OVERRIDE") & ~senior, no(role_text("cannot issue judicial overrides.")))
        .when(
            action.isin("ASSIGN_JUDICIAL_CONTEXT", "CHANGE_OWNERSHIP") & ~senior,
            no(role_text("cannot modify ownership or judicial assignment.")),
        )
        .when(
            closed & ~action.isin("REOPEN_CASE", "DELETE_CASE"),
            no("CLOSED CASE DENY: Modifications to closed cases are prohibited unless reopened."),
        )
        .when(closed & ~senior, no(role_text("cannot reopen a closed case.")))
        .when(
            foreign,
            no(F.concat(
                F.lit("ID MANIPULATION DENY: Resource '"), "resource_id", F.lit("' belongs to case '"), "owner_case_id",
                F.lit("', not target case '"), case_name, F.lit("'."),
            )),
        )
        .when(role == AUTHORITY, yes("ALLOW: Higher authority cross-case authorization granted."))
        .when((role == JUDGE) & F.col("court_level").isNull(), no("DENY: Court judge missing judicial context."))
        .when((role == JUDGE) & (F.col("court_level") == SUPREME), yes("ALLOW: Supreme Court national jurisdiction granted."))
        .when((role == JUDGE) & (F.col("court_level") == HIGH), yes("ALLOW: High Court state jurisdiction granted."))
        .when(
            (role == JUDGE) & (F.col("court_level") == SPECIFIC) & ~granted,
            no(F.concat(F.lit("BOLA DENY: Specific Court judge not assigned to case '"), case_name, F.lit("'."))),
        )
        .when(
            (role == OFFICER) & ~granted,
            no(F.concat(F.lit("BOLA DENY: Officer not authorized for case '"), case_name, F.lit("'."))),
        )
        .otherwise(yes("ALLOW: Server-side authorization check passed."))
    )
    return rows.withColumn("_d", decision).select(*requests.columns, "_d.allowed", "_d.reason")


def grant_resolution(users: DataFrame, grants: DataFrame, cases: DataFrame) -> DataFrame:
    """Cases each user may read: granted, created or assigned (by id or name); ``*`` stands alone.

    ``users`` has (user_id, username), ``cases`` (case_id, created_by, assigned array).
    """
    star = grants.filter("case_id = '*'").select("user_id").distinct()
    explicit = grants.filter("case_id <> '*'").select("user_id", "case_id")
    names = users.select("user_id", F.explode(F.array("user_id", "username")).alias("who")).distinct()
    created = cases.select("case_id", F.col("created_by").alias("who"))
    assigned = cases.select("case_id", F.explode("assigned").alias("who"))
    linked = created.unionByName(assigned).distinct().join(names, "who").select("user_id", "case_id")
    listed = explicit.unionByName(linked).join(users.select("user_id"), "user_id", "left_semi")
    listed = listed.join(star, "user_id", "left_anti").distinct()
    return listed.unionByName(star.join(users.select("user_id"), "user_id", "left_semi").withColumn("case_id", F.lit("*")))


def grant_change(grants: DataFrame, granted: DataFrame, revoked: DataFrame) -> DataFrame:
    """Grants after insert-or-replace and revocation (user_id, case_id, granted_at)."""
    merged = keyed_upsert(grants, granted, ["user_id", "case_id"], "granted_at")
    return merged.join(revoked.select("user_id", "case_id"), ["user_id", "case_id"], "left_anti").select(*grants.columns)


def active_judges(users: DataFrame) -> DataFrame:
    return users.filter((F.col("role") == JUDGE) & F.col("is_active"))


def case_create(requests: DataFrame) -> DataFrame:
    """Case rows: the creator joins the distinct assignees, status DRAFT."""
    team = F.array_distinct(F.array_append(F.coalesce("assigned", F.array().cast("array<string>")), F.col("created_by")))
    return requests.withColumn("assigned", team).withColumn("status", F.lit("DRAFT"))


def case_update(cases: DataFrame, updates: DataFrame, key: str = "case_id") -> DataFrame:
    """Replace only supplied fields; a ``reopen`` flag sets ACTIVE."""
    fields = [name for name in cases.columns if name != key and name in updates.columns]
    fresh = updates.select(key, *[F.col(name).alias(f"_{name}") for name in fields], *(["reopen"] if "reopen" in updates.columns else []))
    joined = cases.join(fresh, key, "left")
    columns = {name: F.coalesce(f"_{name}", name) for name in fields}
    if "reopen" in updates.columns:
        columns["status"] = F.when(F.col("reopen"), "ACTIVE").otherwise(columns.get("status", F.col("status")))
    return joined.select(*[columns[name].alias(name) if name in columns else F.col(name) for name in cases.columns])


# --- audit ---------------------------------------------------------------------


def audit_payload(columns: Sequence[str]) -> Column:
    """Canonical JSON of an event: keys sorted, no spaces, nulls written."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def event_hash(previous: Column, payload: Column) -> Column:
    return F.sha2(F.concat(previous, F.lit(":"), payload), 256)


def audit_append(events: DataFrame, chain: str, order: str, heads: DataFrame | None = None) -> DataFrame:
    """Chain new events: every hash covers the hash before it.

    ``events`` has the chain id, the order and a ``payload`` column.  A hash chain is
    sequential by definition, so one chain is one stream; chains run in parallel.
    Spark sorts, and the fold keeps only the last hash between batches.  ``heads``
    gives the last stored hash of each chain (chain, head).
    """
    source = events.select(*events.columns, F.lit(GENESIS).alias("_head"))
    if heads is not None:
        joined = events.join(heads.select(chain, "head"), chain, "left")
        source = joined.select(*events.columns, F.coalesce("head", F.lit(GENESIS)).alias("_head"))
    out = T.StructType(
        [*events.schema.fields, T.StructField("previous_event_hash", T.StringType()), T.StructField("event_hash", T.StringType())]
    )

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = None, GENESIS
        for frame in frames:
            before, after = [], []
            for name, head, payload in zip(frame[chain], frame["_head"], frame["payload"], strict=True):
                if name != current:
                    current, last = name, head
                before.append(last)
                last = hashlib.sha256(f"{last}:{payload}".encode()).hexdigest()
                after.append(last)
            yield frame.drop(columns=["_head"]).assign(previous_event_hash=before, event_hash=after)

    ordered = source.repartition(F.col(chain)).sortWithinPartitions(chain, order)
    return ordered.mapInPandas(fold, out)


def audit_append_segments(events: DataFrame, chain: str, segment: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Chain the events of every segment of a chain, and the segments among themselves.

    A segment (a day, say) starts from the genesis hash and is one stream, so a long chain
    is spread over as many tasks as it has segments.  The second table has one event per
    segment, whose payload names the segment and its last hash; it is chained in order of
    the segments and seals them.  Both tables can be verified in parallel.
    """
    key = F.to_json(F.struct(chain, segment))
    log = cut_lineage(audit_append(events.withColumn("_segment_key", key), "_segment_key", order))
    last = log.groupBy(chain, segment).agg(F.max_by("event_hash", order).alias("last_hash"), F.count(F.lit(1)).alias("events"))
    seals = last.withColumn("payload", F.concat_ws(":", F.col(segment).cast("string"), F.col("events").cast("string"), "last_hash"))
    return log.drop("_segment_key"), audit_append(seals, chain, segment)


#: Children of a node of the hash tree.
FANOUT = 16


def leaf_hash(payload: Column) -> Column:
    return F.sha2(F.concat(F.lit("0:"), payload), 256)


def node_hash(children: Column) -> Column:
    """Hash of an inner node; its first letter differs from a leaf's, so that no leaf passes for a node."""
    return F.sha2(F.concat(F.lit("1:"), F.array_join(children, ",")), 256)


def audit_tree(events: DataFrame, chain: str, order: str, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """A hash tree over the events of each chain: numbered events, and (chain, level, place, hash, children) of all nodes.

    Unlike a hash chain a tree is built by many tasks however long one log is: events are
    numbered in slices, and every level hashes groups of ``fanout`` neighbours.  The node of
    the highest level is the root; it seals order and content of the whole log.
    """
    numbered = cut_lineage(with_row_number(events, [chain], [F.asc(order)], "_n").withColumn("place", F.col("_n") - 1).drop("_n"))
    none = F.lit(None).cast("array<string>")
    level = numbered.select(chain, F.lit(0).alias("level"), "place", leaf_hash(F.col("payload")).alias("hash"), none.alias("children"))
    nodes = Pile(level)
    level = nodes.add_part(level)
    number = 0
    while True:
        number += 1
        child = F.struct("place", "hash")
        # At most ``fanout`` children; a chain with one node left has its root.
        above = level.groupBy(chain, F.floor(F.col("place") / fanout).alias("up")).agg(F.array_sort(F.collect_list(child)).alias("c"))
        above = above.filter((F.col("up") > 0) | (F.size("c") > 1))
        children = F.col("c.hash")
        # The first group of a chain with further groups has more than one child, unless the chain is done.
        level = nodes.add_part(above.select(chain, F.lit(number).alias("level"), F.col("up").alias("place"), node_hash(children).alias("hash"), children.alias("children")))
        if level.isEmpty():
            return numbered, nodes.rows()


def audit_roots(nodes: DataFrame, chain: str) -> DataFrame:
    """(chain, levels, root) of every tree."""
    top = nodes.filter("place = 0").groupBy(chain).agg(F.max("level").alias("levels"), F.max_by("hash", "level").alias("root"))
    return top.select(chain, "levels", "root")


def audit_proofs(asked: DataFrame, nodes: DataFrame, chain: str, fanout: int = FANOUT) -> DataFrame:
    """``asked`` (rows with the chain and ``place``) with ``path``: place among, and hashes of, the children of each node above.

    A path has one step for each level; with the payload it leads to the root.  Places under
    one node of the lowest level share all but their place in it, so a path is gathered once
    for each such node and handed to its places.
    """
    inner = nodes.filter("level > 0").select(chain, "level", F.col("place").alias("up"), "children")
    levels = audit_roots(nodes, chain).select(chain, "levels")
    rows = asked.withColumn("_first", F.floor(F.col("place") / fanout))
    steps = rows.select(chain, "_first").distinct().join(levels, chain)
    steps = steps.select(chain, "_first", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("levels")))).alias("level"), "levels").filter("level <= levels")
    above = F.floor(F.col("_first") / F.pow(F.lit(float(fanout)), F.col("level") - 1)).cast("long")
    below = F.floor(F.col("_first") / F.pow(F.lit(float(fanout)), F.col("level") - 2)).cast("long")
    steps = steps.select(chain, "_first", "level", F.when(F.col("level") > 1, (below % fanout).cast("int")).alias("at"), above.alias("up"))
    found = steps.join(inner, [chain, "level", "up"])
    paths = found.groupBy(chain, "_first").agg(F.array_sort(F.collect_list(F.struct("level", "at", "children"))).alias("path"))
    own = (F.col("place") % fanout).cast("int")
    path = F.transform("path", lambda step: F.struct(
        step["level"].alias("level"), F.coalesce(step["at"], own).alias("at"), step["children"].alias("children")
    ))
    empty = F.array().cast("array<struct<level: int, at: int, children: array<string>>>")
    return rows.join(paths, [chain, "_first"], "left").select(*asked.columns, F.coalesce(path, empty).alias("path"))


def audit_proved(proofs: DataFrame, roots: DataFrame, chain: str) -> DataFrame:
    """``proofs`` with ``is_valid``: whether the payload and its path lead to the root of its chain."""
    climbed = F.aggregate(
        "path", leaf_hash(F.col("payload")),
        lambda below, step: F.when(F.get(step["children"], step["at"]) == below, node_hash(step["children"])).otherwise(F.lit("broken")),
    )
    return proofs.join(roots.select(chain, "root"), chain).withColumn("is_valid", climbed == F.col("root")).drop("root")


def audit_verify(log: DataFrame, chain: str, order: str) -> DataFrame:
    """Per chain: events, broken links, wrong hashes and validity; fully parallel."""
    linked = with_previous(log, [chain], [F.asc(order)], {"expected_previous": "event_hash"})
    expected = F.coalesce("expected_previous", F.lit(GENESIS))
    broken = F.col("previous_event_hash") != expected
    wrong = event_hash(F.col("previous_event_hash"), F.col("payload")) != F.col("event_hash")
    return linked.groupBy(chain).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(broken).alias("broken_links"),
        F.count_if(wrong).alias("wrong_hashes"),
        (F.count_if(broken | wrong) == 0).alias("is_valid"),
    )


def audit_summary(log: DataFrame) -> DataFrame:
    """Allow and deny counts by actor, case and action, with all subtotals."""
    cube = log.cube("actor_id", "case_id", "action").agg(
        F.count_if(F.col("decision") == "ALLOW").alias("allowed"),
        F.count_if(F.col("decision") == "DENY").alias("denied"),
        F.grouping_id().alias("level"),
    )
    return cube.select("actor_id", "case_id", "action", F.col("level").cast("int").alias("level"), "allowed", "denied")


# --- reports and integrity -----------------------------------------------------


def report_stats(artifacts: DataFrame, nodes: DataFrame, edges: DataFrame, observations: DataFrame, cases: DataFrame) -> DataFrame:
    """Totals per case with the category breakdown as ``CATEGORY=count`` text."""
    gone = (F.col("allocation_status") == "DELETED") | F.col("category").isin("DELETED", "DELETED_FILE")
    per_category = artifacts.groupBy("case_id", "category").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(gone).alias("d")
    )
    entry = F.concat("category", F.lit("="), F.col("n").cast("string"))
    # At most one entry per artifact category.
    totals = per_category.groupBy("case_id").agg(
        F.sum("n").alias("total_artifacts"), F.sum("d").alias("deleted_artifacts"),
        F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("category_breakdown"),
    )

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("case_id").agg(F.count(F.lit(1)).alias(name))

    joined = cases.select("case_id", "anchor_id").join(totals, "case_id", "left")
    joined = joined.join(count(nodes, "_n"), "case_id", "left").join(count(edges, "_e"), "case_id", "left")
    joined = joined.join(count(observations, "_o"), "case_id", "left")
    zero = F.lit(0).cast("long")
    total, deleted = F.coalesce("total_artifacts", zero), F.coalesce("deleted_artifacts", zero)
    return joined.select(
        "case_id", "anchor_id", total.alias("total_artifacts"), (total - deleted).alias("allocated_artifacts"),
        deleted.alias("deleted_artifacts"), F.coalesce("category_breakdown", F.lit("")).alias("category_breakdown"),
        F.coalesce("_n", zero).alias("total_entities"), F.coalesce("_e", zero).alias("total_relationships"),
        F.coalesce("_o", zero).alias("parsed_observations_count"),
    )


def report_samples(df: DataFrame, order: Sequence[Column | str], keep: int) -> DataFrame:
    """First ``keep`` rows of every case; the rank bound is applied before the shuffle."""
    window = Window.partitionBy("case_id").orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= keep)


def report_lineage(reports: DataFrame) -> DataFrame:
    """Version number, previous report and current flag of (case_id, report_id, generated_at)."""
    order = [F.asc("generated_at"), F.asc("report_id")]
    numbered = with_row_number(reports, ["case_id"], order, "version_number")
    linked = with_previous(numbered, ["case_id"], [F.asc("version_number")], {"previous_version_id": "report_id"})
    newest = numbered.groupBy("case_id").agg(F.max("version_number").alias("_last"))
    version = F.concat(F.lit("v"), F.col("version_number").cast("string"), F.lit(".0"))
    return linked.join(newest, "case_id").select(
        *reports.columns, "version_number", version.alias("version"), "previous_version_id",
        (F.col("version_number") == F.col("_last")).alias("is_current"),
    )


def report_scope_list(reports: DataFrame, authorized: DataFrame) -> DataFrame:
    """Reports of the authorized cases; order by generated_at to list them newest first."""
    return reports.join(authorized.select("case_id").distinct(), "case_id", "left_semi")


def content_digest(content: Column) -> Column:
    return F.sha2(content, 256)


def evidence_integrity(evidence: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Stored against recomputed digests (evidence_id, sha256)."""
    fresh = recomputed.select("evidence_id", F.col("sha256").alias("_now"))
    same = F.coalesce(F.col("sha256") == F.col("_now"), F.lit(False))
    return evidence.join(fresh, "evidence_id", "left").select(
        *evidence.columns,
        F.when(same, "INTACT").otherwise("MISMATCH").alias("integrity_status"),
        F.when(same, "VERIFIED").otherwise("CORRUPTED").alias("verification_result"),
    )


def job_integrity(jobs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Outcome of each job (job_id, evidence_id, pre_hash, post_hash) against its evidence digest."""
    stored = evidence.select("evidence_id", F.col("sha256").alias("_stored"))
    outcome = (
        F.when(F.col("_stored").isNull() | (F.col("pre_hash") != F.col("_stored")), "REJECTED")
        .when(F.col("post_hash") != F.col("pre_hash"), "FAILED")
        .otherwise("COMPLETED")
    )
    return jobs.join(stored, "evidence_id", "left").select(*jobs.columns, outcome.alias("job_status"))
