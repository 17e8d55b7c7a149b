import math
from collections import defaultdict

from threadline.llm import mixing
from tools.compare import check, connect


def targets_by_hand(sizes, weights=(3, 1, 2), share=1.5, repeats=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, held, budget = set(order), {}, share * sum(sizes.values())
    while True:
        total = sum(weight[s] for s in left)
        above = {s for s in left if total and budget * weight[s] / total >= repeats * sizes[s]}
        if not above:
            return held | {s: budget * weight[s] / total for s in left}
        for s in above:
            held[s] = repeats * sizes[s]
            budget -= held[s]
        left -= above


def test_targets_and_copies(spark, docs_of):
    rows = [(i, "w " * (1 + i * 7 % 60), "en", f"s{i % 7}" if i % 9 else None) for i in range(900)]
    rows += [(5000 + i, "w " * 5, "en", "s1") for i in range(600)]
    found = mixing.mix(docs_of(rows), ["doc_id"]).collect()
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    for r in found:
        sizes[r.source] += r.size
        taken[r.source] += r.copies * r["size"]
        targets[r.source] = r.target
        assert 0 <= r.copies <= 2
    expected = targets_by_hand(sizes)
    for source, target in expected.items():
        assert math.isclose(targets[source], target, rel_tol=1e-9)
        assert abs(taken[source] - target) <= 120
    again = mixing.mix(docs_of(rows), ["doc_id"]).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_odd_rows(spark, odd_docs):
    found = mixing.mix(odd_docs, ["doc_id", "size"]).collect()
    assert len(found) == odd_docs.count()
    assert {r["size"] for r in found if r.doc.doc_id in (1, 2, 5)} == {0}
    mixed = mixing.mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns
    assert mixed.count() == sum(r.copies for r in mixing.mix(odd_docs).collect())


def test_empty(spark, odd_docs):
    assert mixing.mix(odd_docs.limit(0)).count() == 0


def test_twin(spark, data):
    status, _, note = check(spark, connect(data), data, "op2_mixing")
    assert status == "ok", note
