import random

import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as contract
from threadline.llm import simhash_dedup as dedup
from threadline.llm.components import components


def print_by_hand(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", words) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(prints, radius=2):
    values = sorted(set(prints))
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= radius:
                parent[find(a)] = find(b)
    return {v: find(v) for v in values}


def test_masks_cover_every_pair_of_bits():
    masks = [m & (2**64 - 1) for m in dedup.masks()]
    assert len(masks) == 7
    for i in range(64):
        for j in range(64):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(1)
    values = {rng.getrandbits(64) - 2**63 for _ in range(200)}
    for _ in range(20):  # chains of near values
        v = rng.getrandbits(64)
        for _ in range(30):
            v ^= 1 << rng.randrange(64)
            v ^= rng.choice([0, 1 << rng.randrange(64)])
            values.add(v - 2**63)
    centre = rng.getrandbits(63)  # a bucket far beyond the pair bound
    values |= {centre ^ (1 << rng.randrange(62)) ^ (1 << rng.randrange(62)) for _ in range(400)}
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    roots = {r.node: r.root for r in components(dedup.near_links(frame)).collect()}
    expected = components_by_hand(values)
    groups = lambda of: sorted(sorted(v for v in values if of(v) == r) for r in {of(v) for v in values})
    assert groups(lambda v: roots.get(v, v)) == groups(expected.get)


def test_query_against_brute_force(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    prints = {i: print_by_hand(t) for i, t in texts.items()}
    root = components_by_hand(prints.values())
    least = {}
    for i, p in prints.items():
        least[root[p]] = min(i, least.get(root[p], i))
    found = contract.queries()["op4_simhash_dedup"](spark, data).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == {
        i: (f"{p:016x}", least[root[p]]) for i, p in prints.items()
    }


def test_odd_rows(spark, odd_docs):
    found = dedup.near_duplicates(odd_docs).collect()
    assert len(found) == odd_docs.count()
    # Texts without words share fingerprint 0 and the smallest id among them.
    assert {r.component_id for r in found if r.fp == 0} == {1}
    assert {r.component_id for r in found if r.doc_id is None} == {1, 3}
    kept = dedup.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = kept.collect()
    assert sorted((r.doc_id, r.text or "") for r in rows if r.doc_id == 3) == [(3, "another text under the same id"), (3, "one two three four")]
    assert len(rows) == len({r.component_id for r in found}) + 1  # id 3 names two components
    assert dedup.near_duplicates(odd_docs.limit(0)).count() == 0
    assert dedup.one_of_each(odd_docs.limit(0)).count() == 0


def test_long_text_in_blocks(spark):
    text = " ".join(f"w{i * i % 7919}" for i in range(70_000))
    assert dedup.fingerprint_of(text) & (2**64 - 1) == print_by_hand(text)


def test_no_shingle_is_lost_between_blocks():
    # Seeds whose bits are so even that one shingle less after a block changes the fingerprint.
    for n, seed in ((dedup.BLOCK + 1, 3), (dedup.BLOCK + 1, 9), (2 * dedup.BLOCK + 2, 9), (2 * dedup.BLOCK + 2, 30)):
        rng = random.Random(seed)
        text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(n + 2))
        assert dedup.fingerprint_of(text) & (2**64 - 1) == print_by_hand(text), n


def test_null_ids_only(spark):
    frame = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, "z")], "doc_id long, text string")
    found = dedup.near_duplicates(frame).collect()
    assert len(found) == 3 and {r.component_id for r in found} == {None}
    assert dedup.one_of_each(frame).filter(F.col("text") == "a b c d").count() == 1
