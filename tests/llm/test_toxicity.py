import random
import zlib

import numpy as np

import __spark_entry__ as contract
from threadline.llm import toxicity as tx

INSULTS, GROUPS = ["vile", "nasty", "awful", "foul"], ["northerners", "bakers", "cyclists", "tenants"]


def corpus(n=6000, seed=3):
    """Toxic is an insult with a group of its own half of the lists; other pairs, and either alone, are clean."""
    rng = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randrange(15, 40))
        kind, insult, group = i % 3, rng.randrange(4), rng.randrange(4)
        if kind != 1:
            words[rng.randrange(5)] = INSULTS[insult]
        if kind != 2:
            words[5 + rng.randrange(5)] = GROUPS[group].capitalize() + ","
        rows.append((i, " ".join(words), "en", "a"))
        labels.append((i, 1, int(kind == 0 and insult // 2 == group // 2)))
    return rows, labels


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_pairs_are_learnt_on_held_out_rows(spark, docs_of, labels_of):
    rows, labels = corpus()
    found = {r.doc.doc_id: r for r in tx.judge(docs_of(rows), labels_of(labels), ["doc_id"]).collect()}
    assert all(found[i].held_out == held(i) for i in found)
    truth = {i: y for i, _, y in labels}
    test = [i for i in found if held(i)]
    right = sum(found[i].predicted == truth[i] for i in test) / len(test)
    assert right >= 0.95
    # Without factors the same terms cannot tell the pair from its parts so well.
    texts = {i: t for i, t, *_ in rows}
    train = [i for i in texts if not held(i)]
    flat = tx.learn([tx.buckets_of(texts[i]) for i in train], np.array([truth[i] for i in train]))
    flat.weights[1:] = 0
    additive = [flat.odds(tx.buckets_of(texts[i])) for i in test]
    ranks = np.argsort(np.argsort(additive)) + 1
    y = np.array([truth[i] for i in test])
    scores = np.argsort(np.argsort([found[i].score for i in test])) + 1
    area = lambda r: (r[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())
    assert area(scores) > 0.98 and area(ranks) < 0.95


def test_labels_held_out_are_never_read(spark, docs_of, labels_of):
    rows, labels = corpus(600)
    flipped = [(i, q, 1 - y if held(i) else y) for i, q, y in labels]
    first, second = (
        {r.doc.doc_id: r.score for r in tx.judge(docs_of(rows), labels_of(given), ["doc_id"]).collect()} for given in (labels, flipped)
    )
    assert first == second


def test_odds_are_the_pair_sum():
    rng = np.random.default_rng(1)
    machine = tx.Machine(0.5, rng.normal(size=(1 + tx.FACTORS, 1 << tx.BITS)).astype(np.float32))
    at = np.array([3, 77, 4096, 9])
    w, v = machine.weights[0].astype(float), machine.weights[1:].astype(float)
    expected = 0.5 + sum(w[i] for i in at) + sum(v[:, a] @ v[:, b] for n, a in enumerate(at) for b in at[:n])
    assert abs(machine.odds(at) - expected) < 1e-6


def test_slope_is_the_gradient():
    rng = np.random.default_rng(2)
    row, column = np.array([0, 0, 1, 1, 2, 3]), np.array([0, 1, 1, 2, 0, 2])
    y, loud = np.array([1.0, 0, 0, 1]), np.array([1.0, 0.5, 0.1])
    theta = rng.normal(size=(1 + tx.FACTORS) * 3 + 1)
    _, slope = tx.loss_and_slope(theta, row, column, y, loud)
    for i in range(len(theta)):
        step = np.zeros(len(theta))
        step[i] = 1e-6
        high, low = (tx.loss_and_slope(theta + s * step, row, column, y, loud)[0] for s in (1, -1))
        assert abs((high - low) / 2e-6 - slope[i]) < 1e-6


def test_odd_rows(spark, odd_docs, docs_of, labels_of):
    none = tx.judge(odd_docs, labels_of([]), ["doc_id"]).collect()
    assert len(none) == odd_docs.count() and {r.score for r in none} == {0.0}
    rows, labels = corpus(600)
    extra = labels_of([*labels, (None, 1, 1), (7, None, None), (8, 1, 0), (8, 1, 1), (3, 1, 0)])
    docs = docs_of(rows)
    judged = tx.judge(docs.unionByName(odd_docs).unionByName(docs), extra).collect()
    assert len(judged) == 2 * docs.count() + odd_docs.count()
    assert judged[0].doc.asDict().keys() == set(docs.columns)
    assert all(0 <= r.score <= 1 for r in judged)
    empty = {r.score for r in judged if not (r.doc.text or "").split()}
    assert len(empty) == 1
    assert not any(r.held_out for r in judged if r.doc.doc_id is None)
    assert tx.judge(docs.limit(0), extra).count() == 0
    only = tx.judge(docs, labels_of([(1, 1, 1), (2, 1, 1)]), ["doc_id"]).collect()
    assert {r.score for r in only} == {1.0}


def test_query(spark, data):
    rows = contract.queries()["op11_toxicity"](spark, data)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"]
    found = rows.collect()
    assert len(found) == spark.read.parquet(f"{data}/documents.parquet").count()
    assert all(r.held_out == held(r.doc_id) and r.predicted == int(r.score >= 0.5) for r in found)
