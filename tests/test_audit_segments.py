"""Audit chains in segments, against hashes computed one by one."""

import hashlib

from threadline.operators import governance as gov


def chained(payloads):
    last = gov.GENESIS
    for payload in payloads:
        last = hashlib.sha256(f"{last}:{payload}".encode()).hexdigest()
        yield last


def test_one_hot_chain_in_segments(spark):
    rows = [("hot", n // 50, n, f"p{n}") for n in range(400)] + [("cold", 0, 1, "x")]
    events = spark.createDataFrame(rows, "actor string, day int, seq long, payload string")
    log, seals = gov.audit_append_segments(events, "actor", "day", "seq")
    hashes = {(r.actor, r.seq): r.event_hash for r in log.collect()}
    ends = []
    for day in range(8):
        expected = list(chained(f"p{n}" for n in range(50 * day, 50 * day + 50)))
        assert [hashes["hot", n] for n in range(50 * day, 50 * day + 50)] == expected
        ends.append(f"{day}:50:{expected[-1]}")
    sealed = sorted((r for r in seals.collect() if r.actor == "hot"), key=lambda r: r.day)
    assert [r.payload for r in sealed] == ends and [r.event_hash for r in sealed] == list(chained(ends))
    assert {r.actor: r.is_valid for r in gov.audit_verify(seals, "actor", "day").collect()} == {"hot": True, "cold": True}
    assert log.select("actor", "seq").distinct().count() == 401


def tree_by_hand(payloads, fanout):
    level = [hashlib.sha256(f"0:{p}".encode()).hexdigest() for p in payloads]
    levels = 0
    while len(level) > 1:
        groups = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        level, levels = [hashlib.sha256(("1:" + ",".join(g)).encode()).hexdigest() for g in groups], levels + 1
    return levels, level[0]


def test_hash_tree_of_a_hot_chain(spark):
    sizes = {"hot": 700, "one": 1, "four": 4, "five": 5}
    rows = [(actor, n, f"p{actor}{n}") for actor, size in sizes.items() for n in range(size)]
    events = spark.createDataFrame(rows, "actor string, seq long, payload string").repartition(5)
    numbered, nodes = gov.audit_tree(events, "actor", "seq", fanout=4)
    roots = gov.audit_roots(nodes, "actor")
    expected = {a: tree_by_hand([f"p{a}{n}" for n in range(size)], 4) for a, size in sizes.items()}
    assert {r.actor: (r.levels, r.root) for r in roots.collect()} == expected
    proofs = gov.audit_proofs(numbered, nodes, "actor", fanout=4)
    assert proofs.count() == sum(sizes.values())
    assert all(len(r.path) == expected[r.actor][0] and all(len(s.children) <= 4 for s in r.path) for r in proofs.collect())
    proved = gov.audit_proved(proofs, roots, "actor").collect()
    assert all(r.is_valid for r in proved)
    # Edited, moved and foreign events are found, each on its own.
    forged = [(r.actor, r.seq, r.payload + "x" if r.seq == 3 else r.payload, r.place ^ 1 if r.seq == 8 else r.place) for r in proved]
    forged = spark.createDataFrame(forged, "actor string, seq long, payload string, place long")
    wrong = {(r.actor, r.seq) for r in gov.audit_proved(gov.audit_proofs(forged, nodes, "actor", fanout=4), roots, "actor").collect() if not r.is_valid}
    assert wrong == {("hot", 3), ("four", 3), ("five", 3), ("hot", 8)}


def test_events_of_a_hot_chain_are_numbered_without_a_gap(spark):
    events = spark.range(20_000).selectExpr("'hot' AS actor", "id AS seq", "concat('p', id) AS payload")
    numbered, _ = gov.audit_tree(events, "actor", "seq")
    assert numbered.filter("place = seq").count() == numbered.count() == 20_000


def test_paths_are_gathered_once_for_all_events_under_a_node(spark):
    events = spark.range(300).selectExpr("'hot' AS actor", "id AS seq", "concat('p', id) AS payload")
    numbered, nodes = gov.audit_tree(events, "actor", "seq")
    asked = numbered.unionByName(numbered.filter("seq < 3"))
    proofs = gov.audit_proofs(asked, nodes, "actor")
    plan = proofs._jdf.queryExecution().optimizedPlan().toString()
    # The steps start from distinct lowest nodes, not from a row for each event.
    assert "monotonically_increasing_id" not in plan and "_first" in plan
    found = proofs.collect()
    assert len(found) == 303 and {s.at for r in found for s in r.path if s.level == 1} == set(range(16))
    assert all([s.level for s in r.path] == [1, 2, 3] and [s.at for s in r.path] == [r.place % 16, r.place // 16 % 16, r.place // 256] for r in found)
    assert all(r.is_valid for r in gov.audit_proved(proofs, gov.audit_roots(nodes, "actor"), "actor").collect())
