"""Strong components of chains, rings and random graphs, against a plain search."""

import random

from threadline.operators import analytics


def strong_by_hand(links, nodes):
    ahead = {}
    for a, b in links:
        ahead.setdefault(a, set()).add(b)

    def reach(v):
        seen, todo = {v}, [v]
        while todo:
            for w in ahead.get(todo.pop(), ()):
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        return seen

    known = {v: reach(v) for v in nodes}
    return {v: frozenset(w for w in known[v] if v in known[w]) for v in nodes}


def frame(spark, links):
    return spark.createDataFrame([("C", a, b, 1) for a, b in links], "case_id string, src_id string, tgt_id string, weight long")


def components_of(spark, links):
    groups = {}
    rows = analytics.strong_labels(frame(spark, links)).collect()
    assert len(rows) == len({r.id for r in rows})
    for r in rows:
        groups.setdefault(r.component, set()).add(r.id)
    return {v: frozenset(g) for g in groups.values() for v in g}


def test_chains_rings_and_random_graphs(spark):
    rng = random.Random(3)
    links = {(f"c{i}", f"c{i + 1}") for i in range(40)} | {(f"r{i:02}", f"r{(i + 1) % 23:02}") for i in range(23)}
    links |= {("r00", "t0"), ("t0", "t1"), ("t1", "r05")} | {("p", "q"), ("q", "p")} | {("h", f"l{i}") for i in range(3)} | {("l0", "l0b"), ("l0b", "h")}
    links |= {(f"g{rng.randrange(40)}", f"g{rng.randrange(40)}") for _ in range(55)}
    links = {(a, b) for a, b in links if a != b}
    nodes = {v for link in links for v in link}
    assert components_of(spark, links) == strong_by_hand(links, nodes)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """4,096 nodes in one line, and as many in one ring: rounds grow with the digits of the length."""
    writes = []
    plain = analytics.cut_lineage
    monkeypatch.setattr(analytics, "cut_lineage", lambda df: writes.append(1) or plain(df))
    n = 4096
    line = [(f"v{i:05}", f"v{i + 1:05}") for i in range(n - 1)]
    found = analytics.strong_components(frame(spark, line)).first()
    assert (found.strongly_connected_count, found.largest_component_size) == (n, 1)
    assert len(writes) <= 30  # a dozen rounds of doubling, one write each, and what surrounds them
    writes.clear()
    found = analytics.strong_components(frame(spark, [*line, (line[-1][1], line[0][0])])).first()
    assert (found.strongly_connected_count, found.largest_component_size) == (1, n)
    assert len(writes) <= 30


def test_nodes_that_share_a_number_are_numbered_again(spark, monkeypatch):
    from pyspark.sql import functions as F

    from threadline.operators import analytics

    real, seeds = analytics._number, []

    def number(end, seed):
        seeds.append(seed)
        return real(end, seed) if seed else F.pmod(real(end, seed), F.lit(2))

    monkeypatch.setattr(analytics, "_number", number)
    rows = [("x", f"n{i}", f"n{i + 1}", 1) for i in range(0, 12, 2)] + [("y", "n3", "n1", 1), ("y", "n1", "n2", 1), (None, "n1", "n2", 1), ("z", "n5", "n5", 1)]
    pairs = spark.createDataFrame(rows, "case_id string, src_id string, tgt_id string, weight long")
    found = {(r.case_id, r.id): r.component for r in analytics.component_labels(pairs).collect()}
    expected = {("x", f"n{i + d}"): f"n{i}" for i in range(0, 12, 2) for d in (0, 1)} | {("x", "n10"): "n10", ("x", "n11"): "n10"}
    expected |= {("y", n): "n1" for n in ("n1", "n2", "n3")} | {(None, "n1"): "n1", (None, "n2"): "n2", ("z", "n5"): "n5"}
    assert found == expected and max(seeds) == 1


def test_strong_rounds_shuffle_labels_not_links(spark, monkeypatch):
    """Links lie in buckets of 64-bit numbers; nodes of null, of two cases and given twice keep their places."""
    links = [("C", "a", "b"), ("C", "b", "c"), ("C", "c", "a"), ("C", "a", "c"), ("C", "c", "d"), ("D", "a", "b"), ("D", "b", "a"), ("D", "b", "c"),
             ("D", "c", "b"), ("D", "z", "z"), (None, "a", "b"), (None, "b", "a"), ("C", None, "a")]
    pairs = spark.createDataFrame(links, "case_id string, src_id string, tgt_id string")
    nodes = spark.createDataFrame([("C", "a", "P"), ("C", "lone", "P"), ("C", "lone", "P"), ("E", "x", "P"), ("E", "x", "P"), (None, "x", "P"), ("x", None, "P")],
                                  "case_id string, id string, entity_type string")
    seen = []
    plain = analytics._spread
    monkeypatch.setattr(analytics, "_spread", lambda seed, links: seen.append((links.state_table, dict(links.dtypes))) or plain(seed, links))
    labels = {(r.case_id, r.id, r.component) for r in analytics.strong_labels(pairs, nodes).collect()}
    assert {x for x in labels if x[0] in ("C", "D") and x[1]} == {
        ("C", "a", "c"), ("C", "b", "c"), ("C", "c", "c"), ("C", "d", "d"), ("C", "lone", "lone"), ("D", "a", "c"), ("D", "b", "c"), ("D", "c", "c"), ("D", "z", "z"),
    }
    assert len(seen) >= 2 and all(kinds == {"from_v": "bigint", "to_v": "bigint"} for _, kinds in seen)
    found = {r.case_id: (r.strongly_connected_count, r.largest_component_size) for r in analytics.strong_components(pairs, nodes).collect()}
    assert (found["D"], found["E"]) == ((2, 3), (1, 2)) and found["C"][1] == 3
