import math
import random

import numpy as np

import __spark_entry__ as contract
from threadline.llm import quality_classifier as qc


def corpus(n=1500, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(n):
        poor, toxic = i % 7 == 0, i % 11 == 0
        words = rng.choices(vocabulary, k=rng.randrange(60, 160))
        if poor:
            words = [w + "###" if k % 3 else w for k, w in enumerate(words)]
        if toxic:
            words[rng.randrange(20)] = rng.choice(["vile,", "Nasty", "awful."])
            words[-1] = rng.choice(["vile", "nasty", "awful"])
        rows.append((i, " ".join(words), "en", f"src{i % 5}"))
        if i % 2:
            labels.append((i, int(not poor), int(toxic)))
    return rows, labels


def test_held_out_documents(spark, docs_of, labels_of):
    rows, labels = corpus()
    found = {r.doc.doc_id: r for r in qc.classify(docs_of(rows), labels_of(labels), ["doc_id"]).collect()}
    held = [i for i in found if i % 2 == 0]
    clean = [i for i in held if i % 7 and i % 11]
    assert sum(found[i].kept for i in clean) >= 0.98 * len(clean)
    assert sum(not found[i].kept for i in held if i % 7 == 0) >= 0.95 * sum(i % 7 == 0 for i in held)
    assert sum(not found[i].kept for i in held if i % 11 == 0) >= 0.95 * sum(i % 11 == 0 for i in held)


def test_given_tables(spark, data):
    found = {r.doc_id: r for r in contract.queries()["op1_quality_classifier"](spark, data).collect()}
    assert len(found) == spark.read.parquet(f"{data}/documents.parquet").count()
    labels = [r for r in spark.read.parquet(f"{data}/labels.parquet").collect() if r.doc_id in found]
    good = [r.doc_id for r in labels if r.quality == 1 and r.toxic == 0]
    assert sum(found[i].kept for i in good) >= 0.97 * len(good)


def test_sparse_sites_shrink_to_their_host(spark, docs_of, labels_of):
    plain = "some plain words that say nothing at all about it"
    rows = [(i, plain, "xx", "bad" if i % 2 else "fine") for i in range(400)]
    rows += [(1000, plain, "rare", "bad"), (1001, plain, "rare", "fine"), (1002, plain, "rare", "new")]
    labels = [(i, int(not (i % 2 and i % 10 < 9)), 0) for i in range(400)]
    found = {r.doc.doc_id: r for r in qc.classify(docs_of(rows), labels_of(labels), ["doc_id"]).collect()}
    assert found[1].site_poor > found[1000].site_poor > found[1002].site_poor > found[1001].site_poor > found[0].site_poor
    assert abs(found[1002].site_poor - sum(1 - q for _, q, _ in labels) / 400) < 0.1


def test_odd_rows(spark, odd_docs, labels_of):
    labels = labels_of([(1, 1, None), (2, 0, 1), (2, 1, 0), (None, 1, 0), (3, None, 1), (4, 1, 0), (99, 0, 0)])
    for narrow, keep in ((True, ["doc_id"]), (False, None)):
        assert qc.classify(odd_docs, labels, keep, narrow=narrow).count() == odd_docs.count()
    assert qc.classify(odd_docs, labels).select("doc.*").columns == odd_docs.columns
    assert qc.classify(odd_docs, labels.limit(0)).filter("kept").count() == odd_docs.count()
    assert qc.classify(odd_docs.limit(0), labels.limit(0)).count() == 0


def test_regression_ends_at_a_minimum():
    rng = np.random.default_rng(1)
    at = [sorted(set(rng.integers(0, 40, 6).tolist())) for _ in range(800)]
    y = [int(3 in row or (7 in row and rng.random() < 0.7) or rng.random() < 0.1) for row in at]
    weights, bias = qc._regress(at, y, set(range(40)))
    w = np.array([weights[i] for i in range(40)] + [bias])
    row = np.repeat(np.arange(800), [len(x) for x in at])
    loss, slope = qc.logistic_loss(w, row, np.concatenate(at).astype(int), np.array(y, float))
    assert np.abs(slope).max() < 2e-3
    for _ in range(20):  # no lower point around
        assert qc.logistic_loss(w + rng.normal(0, 0.2, 41), row, np.concatenate(at).astype(int), np.array(y, float))[0] > loss


def posteriors_by_hand(rows, rates):
    """Moments, strengths and shrinkage in plain Python: rows of (host, path, evidence, label or None) for one head."""
    counted = {}
    for host, path, e, label in rows:
        weight = 1.0 if label is not None else qc.SOFT
        outcome = label if label is not None else 1 / (1 + math.exp(-(e + math.log(rates / (1 - rates)))))
        n, k = counted.get((host, path), (0.0, 0.0))
        counted[host, path] = n + weight, k + weight * outcome
    hosts = {}
    for (host, _), (n, k) in counted.items():
        hosts.setdefault(host, []).append((n, k))
    p0 = rates
    total = {h: (sum(n for n, _ in v), sum(k for _, k in v)) for h, v in hosts.items()}
    m, everything = len(total), sum(n for n, _ in total.values())
    spread = sum(n * (k / n - p0) ** 2 for n, k in total.values()) / (p0 * (1 - p0)) - (m - 1)
    units = everything - sum(n * n for n, _ in total.values()) / everything - (m - 1)
    strength = lambda excess, units, freedom: (lambda r: (1 - r) / r if freedom > 0 else 1e6)(min(0.999, max(1e-6, excess / units if units > 0 else 0)))
    first = strength(spread, units, m - 1)
    shrunk = {h: (k + first * p0) / (n + first) for h, (n, k) in total.items()}
    low = sum(n * (k / n - total[h][1] / total[h][0]) ** 2 / (shrunk[h] * (1 - shrunk[h])) for (h, _), (n, k) in counted.items())
    freedom = sum(1 - 1 / len(hosts[h]) for h, _ in counted)
    reach = sum(n - sum(x * x for x, _ in hosts[h]) / total[h][0] / len(hosts[h]) for (h, _), (n, k) in counted.items())
    second = strength(low - freedom, reach - freedom, freedom)
    return {site: (k + second * shrunk[site[0]]) / (n + second) for site, (n, k) in counted.items()}


def test_posteriors_against_brute_force(spark, docs_of, labels_of):
    rows, labels = corpus(900, 6)
    rows = [(i, t, "de" if i % 3 else "en", src if i % 7 else f"src{i % 2}") for i, t, _, src in rows]
    docs, known = docs_of(rows), labels_of(labels)
    found = {r.doc.doc_id: r for r in qc.classify(docs, known, ["doc_id"]).collect()}
    truth = {i: (int(q == 0), t) for i, q, t in labels}
    model = qc.fit(docs, known)
    for head, at in (("poor", 0), ("toxic", 1)):
        given = [(src, lang, found[i][f"e_{head}"], truth[i][at] if i in truth else None) for i, _, lang, src in rows]
        expected = posteriors_by_hand(given, model.rates[head])
        for i, _, lang, src in rows:
            site, r = min(1 - 1e-6, max(1e-6, expected[src, lang])), found[i]
            assert math.isclose(r[f"site_{head}"], site, rel_tol=1e-9)
            odds = r[f"e_{head}"] + math.log(site / (1 - site))
            assert math.isclose(r[f"p_{head}"], 1 / (1 + math.exp(-odds)), rel_tol=1e-9)
    assert all(r.kept == (r.p_poor < qc.CUT and r.p_toxic < qc.CUT) for r in found.values())
