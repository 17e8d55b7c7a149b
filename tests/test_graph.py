"""Graph analytics against small plain computations."""

import heapq
import random
from collections import defaultdict

import pytest

from threadline.functions.ordered import with_next, with_previous, with_row_number
from threadline.operators import analytics, centrality, communities, graph, scoring


@pytest.fixture(scope="module")
def edges(spark):
    rng = random.Random(1)
    rows = [("C", f"n{rng.randrange(24):02d}", f"n{rng.randrange(24):02d}") for _ in range(45)]
    rows = [row for row in rows if row[1] != row[2]]
    rows += [("C", "x1", "x2"), ("C", "x2", "x3"), ("D", "a", "b"), ("D", "b", "a"), ("D", "b", "c")]
    table = [(c, a, b, "Person", "Person", "COMMUNICATED_WITH", f"EV{i}", 1.0, f"R{i:02d}") for i, (c, a, b) in enumerate(rows)]
    return spark.createDataFrame(
        table, "case_id string, src_id string, tgt_id string, src_label string, tgt_label string, rel_label string, evidence_id string, confidence double, rel_id string"
    )


@pytest.fixture(scope="module")
def pairs(edges):
    return analytics.project_graph(edges).persist()


@pytest.fixture(scope="module")
def weights(pairs):
    out = defaultdict(dict)
    for row in pairs.collect():
        out[row.case_id][(row.src_id, row.tgt_id)] = row.weight
    return out


def names(weights):
    return sorted({end for pair in weights for end in pair})


def brandes(weights):
    near = defaultdict(list)
    for (a, b), w in weights.items():
        near[a].append((b, 1.0 / w))
    score = dict.fromkeys(names(weights), 0.0)
    for start in score:
        done, order, before, paths, seen, heap = {}, [], defaultdict(list), defaultdict(float), {start: 0.0}, [(0.0, start)]
        paths[start] = 1.0
        while heap:
            cost, node = heapq.heappop(heap)
            if node in done:
                continue
            done[node] = cost
            order.append(node)
            for other, step in near[node]:
                total = cost + step
                if other not in seen or total < seen[other] - 1e-12:
                    seen[other], paths[other], before[other] = total, paths[node], [node]
                    heapq.heappush(heap, (total, other))
                elif abs(total - seen[other]) < 1e-12 and other not in done:
                    paths[other] += paths[node]
                    before[other].append(node)
        share = defaultdict(float)
        for node in reversed(order):
            for parent in before[node]:
                share[parent] += paths[parent] / paths[node] * (1 + share[node])
            if node != start:
                score[node] += share[node]
    size = len(score)
    return {node: value / ((size - 1) * (size - 2)) for node, value in score.items()}


def test_betweenness(pairs, weights):
    got = {(r.case_id, r.id): r.betweenness for r in centrality.betweenness(pairs, blocks=2).collect()}
    for case, links in weights.items():
        for node, value in brandes(links).items():
            assert got[(case, node)] == pytest.approx(value, abs=1e-9)


def test_strong_components(pairs, weights):
    got = {r.case_id: (r.strongly_connected_count, r.largest_component_size) for r in analytics.strong_components(pairs).collect()}
    for case, links in weights.items():
        reach = {}
        for node in names(links):
            seen, todo = set(), [node]
            while todo:
                here = todo.pop()
                for (a, b) in links:
                    if a == here and b not in seen:
                        seen.add(b)
                        todo.append(b)
            reach[node] = seen
        groups = {frozenset([v, *(u for u in reach[v] if v in reach[u])]) for v in reach}
        assert got[case] == (len(groups), max(map(len, groups)))


def test_communities_beat_components(pairs):
    links = analytics.undirected_weights(pairs)
    labels = communities.community_labels(pairs)
    found = {r.case_id: r.modularity for r in communities.modularity(links, labels).collect()}
    parts = analytics.component_labels(pairs).withColumnRenamed("component", "community")
    base = {r.case_id: r.modularity for r in communities.modularity(links, parts).collect()}
    assert found["C"] > base["C"] + 0.1 and found["D"] >= base["D"] - 1e-9
    assert labels.count() == analytics.project_nodes(None, pairs).count()


def test_pagerank_matches_power_iteration(pairs, weights):
    got = {(r.case_id, r.id): r.pagerank for r in analytics.pagerank(pairs).collect()}
    for case, links in weights.items():
        nodes = names(links)
        out = defaultdict(float)
        for (a, _), w in links.items():
            out[a] += w
        rank = dict.fromkeys(nodes, 1 / len(nodes))
        for _ in range(100):
            lost = sum(rank[n] for n in nodes if not out[n])
            fresh = {n: 0.15 / len(nodes) + 0.85 * lost / len(nodes) for n in nodes}
            for (a, b), w in links.items():
                fresh[b] += 0.85 * rank[a] * w / out[a]
            change = sum(abs(fresh[n] - rank[n]) for n in nodes)
            rank = fresh
            if change < len(nodes) * 1e-6:
                break
        for node in nodes:
            assert got[(case, node)] == pytest.approx(rank[node], abs=1e-12)


def test_layers_and_case_edges(spark, edges, pairs):
    nodes = analytics.project_nodes(None, pairs)
    anchors = spark.createDataFrame([("C", "x1"), ("D", "missing")], "case_id string, anchor_id string")
    got = {(r.case_id, r.id): r.layer for r in graph.anchor_layers(nodes, pairs, anchors).collect()}
    assert (got[("C", "x1")], got[("C", "x2")], got[("C", "x3")], got[("C", "n00")]) == (0, 1, 2, 3)
    # D's anchor is isolated: its busiest node takes over.
    assert (got[("D", "b")], got[("D", "a")], got[("D", "c")]) == (0, 1, 1)
    assert graph.case_edges(edges.filter("case_id = 'Z'")).count() == 0


def test_multi_link_summary(spark):
    rows = [
        ("C", "a", "b", "Person", "PhoneNumber", "USED_PHONE", "E1", 0.9, "R1"), ("C", "a", "b", "Person", "Person", "ASSOCIATED_WITH", "E2", None, "R2"),
        ("C", "a", "b", "Person", "Person", "ASSOCIATED_WITH", "E2", 0.5, "R3"), ("C", "c", "c", "Person", "Person", "ASSOCIATED_WITH", "E2", 0.5, "R4"),
    ]
    table = spark.createDataFrame(rows, "case_id string, src_id string, tgt_id string, src_label string, tgt_label string, rel_label string, evidence_id string, confidence double, rel_id string")
    [edge] = graph.case_edges(table).collect()
    assert edge.distinct_types == ["ASSOCIATED_WITH", "USED_PHONE"] and edge.relationship == "2 Link Types (3 Connections)"
    assert (edge.relationship_type, edge.confidence, edge.evidence_count, edge.interaction_count) == ("MULTI_LINK", 1.0, 2, 3)


def test_scores(spark):
    rows = [("CALLED", 18, 2.0, 3, 1.0, True), ("USED_PHONE", 4, 12.0, 2, 1.0, True), ("VISITED", 1, 60.0, 1, 0.75, True), ("CALLED", 10, 2.0, 3, 1.0, True), ("CALLED", 10, 2.0, 3, 1.0, False)]
    table = spark.createDataFrame(rows, "rel_type string, frequency int, days_elapsed double, source_count int, er_confidence double, provenance_valid boolean")
    got = [(r.association_score, r.concentric_ring) for r in scoring.ccc_score(table).collect()]
    assert got[:3] == [(98, "RED"), (70, "YELLOW"), (24, "GREEN")]
    assert got[4][0] < got[3][0]


def test_ordered_helpers_split_a_hot_key(spark):
    rows = [("hot" if i % 3 else "cold", i) for i in range(300)]
    random.Random(2).shuffle(rows)
    table = spark.createDataFrame(rows, "k string, i long")
    numbered = {(r.k, r.i): r.n for r in with_row_number(table, ["k"], ["i"], "n").collect()}
    before = {(r.k, r.i): r.p for r in with_previous(table, ["k"], ["i"], {"p": "i"}).collect()}
    after = {(r.k, r.i): r.p for r in with_next(table, ["k"], ["i"], {"p": "i"}).collect()}
    for key in ("hot", "cold"):
        values = sorted(i for k, i in rows if k == key)
        for at, value in enumerate(values):
            assert numbered[(key, value)] == at + 1
            assert before[(key, value)] == (values[at - 1] if at else None)
            assert after[(key, value)] == (values[at + 1] if at + 1 < len(values) else None)


def test_paths(spark, pairs):
    none = graph.shortest_path_unweighted(pairs, "x1", "n00", "C").first()
    assert none.path_length == -1
    some = graph.shortest_path_unweighted(pairs, "x3", "x1", "C").first()
    assert (some.path_length, some.path_nodes) == (2, "x3>x2>x1")
    asked = spark.createDataFrame([("C", "x1", "x3"), ("C", "x3", "x1")], "case_id string, source_id string, target_id string")
    got = {r.source_id: r for r in analytics.shortest_path_weighted(pairs, asked).collect()}
    assert (got["x1"].hop_count, got["x1"].total_cost, got["x3"].path_exists) == (2, 2.0, False)


def test_weighted_frequency_does_not_deal_pairs_by_case(spark, capsys):
    rows = [("c", f"a{i}", f"b{i}", i, 1, "e") for i in range(4)]
    pairs = spark.createDataFrame(rows, "case_id string, src_id string, tgt_id string, weight int, evidence_count int, sample_edge_id string")
    found = analytics.weighted_frequency(pairs)
    found.explain()
    assert "SortMergeJoin" not in capsys.readouterr().out
    assert {(r.unique_pairs, r.max_frequency) for r in found.collect()} == {(4, 3)}


_EDGE = "case_id string, src_id string, tgt_id string, src_label string, tgt_label string, rel_label string, rel_id string, evidence_id string"


def test_edges_that_labels_decide_are_not_looked_up(spark):
    rows = [
        ("c", "a", "b", "Person", "Person", "COMMUNICATED_WITH", "r1", "e"), ("c", "a", "no", "Person", "Person", "COMMUNICATED_WITH", "r2", "e"),
        ("c", "no", "no", "Person", "Person", "COMMUNICATED_WITH", "r3", "e"), ("c", "no", "b", "Person", "Person", "CALLED", "r4", "e"),
        (None, "a", "b", None, "Person", None, "r5", "e"), ("c", "a", "b", "Person", "Person", "CALLED", "r6", None), ("c", None, "b", "Person", "Person", "COMMUNICATED_WITH", "r7", "e"),
    ]
    nodes = spark.createDataFrame([("c", "a"), ("c", "b"), ("c", "a")], "case_id string, id string")
    checked = graph.edge_schema_check(spark.createDataFrame(rows, _EDGE), nodes)
    assert checked.columns == [*(f.split()[0] for f in _EDGE.split(", ")), "reject_reason"]
    found = {r.rel_id: r.reject_reason for r in checked.collect()}
    assert found == {
        "r1": None, "r2": "UNKNOWN_TARGET", "r3": "UNKNOWN_SOURCE", "r4": "ILLEGAL_TRIPLE", "r5": "ILLEGAL_TRIPLE", "r6": "ILLEGAL_TRIPLE", "r7": "UNKNOWN_SOURCE",
    }
    # Illegal edges form a branch of their own, which has no join.
    plan = checked._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union" and "Join" not in plan.children().last().toString()


def test_only_repeated_relationship_ids_are_grouped(spark, monkeypatch):
    rows = [("c", "a", "b", "Person", "Person", "CALLED", f"r{i}", f"e{i}") for i in range(20)]
    rows += [("c", "a", "b", "Person", "Person", "CALLED", "r3", "e1"), ("d", "a", "b", "Person", "Person", "CALLED", "r3", "e7")]
    rows += [(None, "a", "b", "Person", "Person", "CALLED", None, e) for e in ("e9", "e8", "e8")]
    edges = spark.createDataFrame(rows, _EDGE)
    entities = spark.createDataFrame([("c", "a")], "case_id string, canonical_entity_id string")

    def records():
        found = graph.provenance_records(entities, edges).filter("resource_type = 'RELATIONSHIP'")
        return sorted(((r.case_id or "", r.resource_id or "", r.provenance) for r in found.collect()))

    split = records()
    assert len(split) == 22 and '"evidence_id":"e1"' in dict(((c, i), p) for c, i, p in split)["c", "r3"]
    assert '"evidence_id":"e8"' in dict(((c, i), p) for c, i, p in split)["", ""]
    monkeypatch.setattr(graph, "REPEATED", 0)
    assert records() == split
