import math
import random
import re
import struct
from collections import Counter

import xxhash

import __spark_entry__ as contract
from threadline.llm import quality_rules as rules


def counts_by_hand(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    dup = sum(line in lines[:i] for i, line in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines), dup, len(covered)


def test_counts():
    rng = random.Random(2)
    texts = ["", None, "a b c a b c", "x\nx\n \nx y\r\nx", "a a a a", "a b a b a b a", "é ü\xa0b 中 文", "#*$%&|<> <\n\n", "a b"]
    texts += [" ".join(rng.choice("abcd") for _ in range(rng.randrange(40))) for _ in range(300)]
    for text in texts:
        assert rules.text_counts(text or "") == counts_by_hand(text), text


def test_binomial_tail():
    for n, p in ((10, 0.3), (60, 0.02)):
        for k in range(n + 1):
            exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert math.isclose(rules.binomial_tail(k, n, p), min(1.0, exact), rel_tol=1e-9)


def test_query_against_brute_force(spark, data):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    found = {r.doc_id: r for r in contract.queries()["op10_quality_rules"](spark, data).collect()}
    assert set(found) == set(docs)
    measured = {}
    for i, doc in docs.items():
        n, chars, symbols, lines, dup, repeat = counts_by_hand(doc.text)
        failed = n < 50 or 100 * repeat > 50 * n
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, dup, repeat, failed)
        values = [symbols / chars, dup / lines, repeat / n, chars / n, n / chars] if n else [0] * 5
        measured[i] = (doc.lang, failed, dict(zip(rules.CUTOFFS, values, strict=True)))
    cut = cutoffs_by_hand(measured, labels)
    for i, (lang, failed, values) in measured.items():
        beyond = [n for n in values if values[n] > cut.get(lang, {}).get(n, math.inf)]
        assert found[i].kept == (not failed and not beyond)


def in_fold(i):
    h = xxhash.xxh64_intdigest(struct.pack("<q", i), 42)
    return (h - (1 << 64) if h >> 63 else h) % rules.FOLD == 0


def cutoffs_by_hand(measured, labels):
    """lang -> cutoffs, from id -> (lang, base_failed, values): the path by trying every next step on every document."""
    known = [(i, *measured[i], y.quality == 1 and not y.toxic) for i, y in labels.items() if i in measured and not measured[i][1]]
    fold = [k for k in known if in_fold(k[0])]
    now, path = {}, []
    beyond = lambda values, cuts: any(values[n] > c for n, c in cuts.items())
    while True:
        best = None
        for m, (name, candidates) in enumerate(rules.CUTOFFS.items()):
            tried = candidates.index(now[name]) + 1 if name in now else 0
            alike = {}
            for c in candidates[tried:]:
                fresh = [k for k in fold if not beyond(k[3], now) and k[3][name] > c]
                alike.setdefault((sum(not k[4] for k in fresh), sum(k[4] for k in fresh)), []).append(c)
            for (gain, loss), cuts in alike.items():
                if gain and (best is None or (gain / (loss + 0.5), gain, -m) > best[0]):
                    best = (gain / (loss + 0.5), gain, -m), name, cuts[len(cuts) // 2]
        if best is None:
            break
        now = {**now, best[1]: best[2]}
        if sum(k[4] for k in fold if beyond(k[3], now)) > 2 * rules.RISK * sum(k[4] for k in fold):
            break
        path.append(now)
    test = [k for k in known if k[4] and not in_fold(k[0])]
    strata, chosen, p = {k[1] for k in test}, {}, rules.RISK
    for s in strata:
        mine = [k[3] for k in test if k[1] == s]
        for cuts in path:
            k, n = sum(beyond(v, cuts) for v in mine), len(mine)
            if sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) > rules.LEVEL / len(strata):
                break
            chosen[s] = cuts
    return chosen


def test_every_language_gets_cutoffs_on_enough_labels(spark):
    data = "/root/testdata/sf0.1"
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang").collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    found = {r.doc_id: r for r in contract.queries()["op10_quality_rules"](spark, data).collect()}
    passed = {i for i, r in found.items() if not r.base_failed}
    poor = {s: [i for i, y in labels.items() if docs.get(i) == s and y.quality == 0 and i in passed] for s in ("en", "de", "fr", "es")}
    good = {s: [i for i, y in labels.items() if docs.get(i) == s and y.quality == 1 and not y.toxic and i in passed] for s in poor}
    for s in poor:
        assert sum(not found[i].kept for i in poor[s]) >= 0.9 * len(poor[s])
        assert sum(not found[i].kept for i in good[s]) <= rules.RISK * len(good[s])


def test_cutoffs_control_the_risk(spark, docs_of, labels_of):
    rng = random.Random(4)

    def text(junk):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9))) for _ in range(80)]
        return " ".join(w + "###" if junk and k % 2 else w for k, w in enumerate(words))

    rows = [(i, text(i % 8 == 0), ("en", None)[i % 3 == 0], "s") for i in range(6000)]
    labels = [(i, int(i % 8 != 0), 0) for i in range(0, 6000, 1)]
    judged = rules.judge(docs_of(rows), labels_of(labels), ["doc_id"], risk=0.05)
    kept = {r.doc.doc_id: r.kept for r in judged.collect()}
    good = [i for i in kept if i % 8]
    assert sum(not kept[i] for i in good) <= 0.05 * len(good)
    assert not any(kept[i] for i in kept if i % 8 == 0)


def test_odd_rows(spark, odd_docs, labels_of):
    labels = labels_of([(1, None, None), (None, 1, 0), (4, 1, None), (4, 0, 0), (77, 1, 1)])
    for narrow, keep in ((True, ["doc_id"]), (False, None)):
        found = rules.judge(odd_docs, labels, keep, narrow=narrow).collect()
        assert len(found) == odd_docs.count()
        assert [r.kept for r in found if r.n_words < 50] == [False] * sum(r.n_words < 50 for r in found)
        assert all(r.cuts_failed == [] for r in found)  # too few labels for any cutoff
    assert rules.judge(odd_docs, labels).filter("kept").select("doc.*").columns == odd_docs.columns
    assert rules.judge(odd_docs.limit(0), labels.limit(0)).count() == 0
