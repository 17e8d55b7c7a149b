import itertools
import random

import corpus_pipeline
from threadline.llm import near_copies as near


def shingles_by_hand(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", words) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups_by_hand(texts, similarity=0.8):
    """id -> smallest id of its component."""
    sets = {i: shingles_by_hand(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if both >= similarity * either:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {i: find(i) for i in texts}


def edited(rng, words, n):
    words = list(words)
    for place in rng.sample(range(len(words)), n):
        words[place] = f"new{rng.randrange(10**6)}"
    return words


def test_copies_around_the_bound(spark):
    rng = random.Random(5)
    texts = {}
    for _ in range(40):  # one, two, ... words changed: similarities on both sides of 0.8
        base = [f"w{rng.randrange(10**4)}" for _ in range(200)]
        for n in (0, 1, 2, 3, 4, 5, 6, 8):
            texts[len(texts)] = " ".join(edited(rng, base, n))
    base = [f"h{rng.randrange(10**4)}" for _ in range(150)]
    for _ in range(120):  # one large group
        texts[len(texts)] = " ".join(edited(rng, base, 2))
    expected = groups_by_hand(texts)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near.near_copies(frame).collect()}
    assert found == expected
    assert len(set(expected.values())) > 41  # some copies are too far


def test_pipeline_stage_drops_copies(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    least = groups_by_hand({r.doc_id: r.text for r in docs.collect()})
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, data).collect())
    assert kept == sorted(set(least.values()))
    assert not {145, 177} & set(kept)  # similar by 0.83 to 6 and 1, 7 and 11 bits of SimHash away


def test_odd_rows(spark, odd_docs):
    found = near.near_copies(odd_docs).collect()
    assert len(found) == odd_docs.count()
    assert {r.component_id for r in found if r.doc_id in (1, 2, 5)} == {1}
    assert {r.component_id for r in found if r.doc_id is None} == {1, 3}
    kept = near.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert len(kept.collect()) == len({(r.component_id, bytes(r.first_key)) for r in found})
    assert near.near_copies(odd_docs.limit(0)).count() == 0
    assert near.one_of_each(odd_docs.limit(0)).count() == 0


def test_columns_of_any_type(spark):
    rows = [(1, "a b c d e f", {"k": 1}, [1]), (2, "a b c d e f", {"k": 2}, [2]), (2, "a b c d e f", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string, int>, a array<int>")
    kept = near.one_of_each(docs)
    assert kept.columns == docs.columns
    assert [(r.doc_id, r.m) for r in kept.collect()] == [(1, {"k": 1})]


def test_every_pair_at_the_bound_is_found(spark):
    """Recall at similarities from 0.8 on, measured against all pairs."""
    rng = random.Random(11)
    texts, wanted = {}, {}
    for g in range(300):
        base = [f"g{g}w{rng.randrange(500)}" for _ in range(120)]
        texts[2 * g], texts[2 * g + 1] = " ".join(base), " ".join(edited(rng, base, 1 + g % 3))
    for g in range(300):
        a, b = shingles_by_hand(texts[2 * g]), shingles_by_hand(texts[2 * g + 1])
        wanted[g] = len(a & b) >= 0.8 * len(a | b)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near.near_copies(frame).collect()}
    assert [found[2 * g] == found[2 * g + 1] for g in range(300)] == [wanted[g] for g in range(300)]
    assert 50 < sum(wanted.values()) < 290


def test_copies_of_one_text_meet_it_and_not_each_other(spark, monkeypatch):
    """Copies that are similar to their original alone: pairs decided stay in proportion to the texts."""
    rng = random.Random(3)
    base = [f"o{i}" for i in range(150)]
    texts = {i: " ".join(edited(rng, base, 3)) for i in range(300)} | {300: " ".join(base)}
    decided = []
    passed = near._passed
    monkeypatch.setattr(near, "_passed", lambda pairs, *how: decided.append(pairs.count()) or passed(pairs, *how))
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near.near_copies(frame).collect()}
    assert found == groups_by_hand(texts)
    assert decided[-1] <= len(texts) and sum(decided) <= near.BANDS * len(texts)


def test_fingerprints_link_first(spark, monkeypatch):
    """Pairs within two bits of SimHash are decided before any that min-hashes find."""
    rng = random.Random(4)
    bases = [[f"s{g}w{i}" for i in range(400)] for g in range(30)]
    texts = {}
    for g, base in enumerate(bases):
        texts[2 * g], texts[2 * g + 1] = " ".join(base), " ".join([*base, f"more{rng.randrange(10**6)}"])
    prints = {i: near.set_fingerprint(near.shingle_hashes(near.words_of(t))) for i, t in texts.items()}
    close = sum((prints[2 * g] ^ prints[2 * g + 1]) & (1 << 64) - 1 in {0} | {1 << i | 1 << j for i in range(64) for j in range(64)} for g in range(30))
    decided = []
    passed = near._passed
    monkeypatch.setattr(near, "_passed", lambda pairs, *how: decided.append(pairs.count()) or passed(pairs, *how))
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near.near_copies(frame).collect()}
    assert found == {i: i - i % 2 for i in texts}
    assert decided[0] == close > 0
