import hashlib
import math
import random
from collections import Counter

import xxhash

import __spark_entry__ as contract
from threadline.llm import fingerprints as fp

BITS = 2**64 - 1


def print_by_hand(text):
    words = text.encode().split()
    found = Counter(words) + Counter(a + b" " + b for a, b in zip(words, words[1:]))
    votes = [0.0] * 64
    for term, n in found.items():
        h = xxhash.xxh64_intdigest(term)
        for b in range(64):
            votes[b] += (1 + math.log2(n)) * (1 if h >> b & 1 else -1)
    return votes, sum(1 << b for b in range(64) if votes[b] > 0)


def agrees(value, text):
    """Equal but for bits whose votes are a tie."""
    votes, expected = print_by_hand(text)
    return all(abs(votes[b]) < 1e-6 for b in range(64) if ((value ^ expected) >> b) & 1)


def expected_rows(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
        text, following = text or "", following or ""
        n = len(text) // 4
        yield i, text, text[: len(text) - n] + following[:n], following


def test_search_finds_all_within_the_radius(spark):
    rng = random.Random(3)
    values = {rng.getrandbits(64) - 2**63 for _ in range(300)}
    for v in list(values)[:60]:
        for k in range(6):
            w = v
            for b in rng.sample(range(63), k):
                w ^= 1 << b
            values.add(w)
    asked = sorted(values)[:80]
    prints = spark.createDataFrame([(v,) for v in values], "fp long")
    queries = spark.createDataFrame([(v,) for v in asked], "query long")
    for radius, blocks in ((3, 5), (2, 4), (0, 1)):
        found = sorted(map(tuple, fp.search(prints, queries, radius, blocks).collect()))
        assert found == sorted((q, v, d) for q in asked for v in values if (d := ((q ^ v) & BITS).bit_count()) <= radius)


def test_query_against_brute_force(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    found = {r.doc_id: r for r in contract.queries()["op8_fingerprints"](spark, data).collect()}
    assert len(found) == len(rows)
    prints = {i: int(r.fingerprint, 16) for i, r in found.items()}
    for i, text, change, following in expected_rows(rows):
        r = found[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(change.encode()).hexdigest()
        assert agrees(prints[i], text) and agrees(int(r.edited_fingerprint, 16), change)
        assert r.near_edited == 1 - (prints[i] ^ int(r.edited_fingerprint, 16)).bit_count() / 64
        assert r.near_next == 1 - (prints[i] ^ (fp.simhash(following) & BITS)).bit_count() / 64
        near = sum((prints[i] ^ p).bit_count() <= 3 for p in prints.values()) - 1
        assert r.n_near == (near if i % 100 == 0 else None)


def test_likeness_tells_edits_from_strangers(spark, data):
    found = contract.queries()["op8_fingerprints"](spark, data).collect()
    assert sum(r.near_edited > r.near_next for r in found) >= 0.97 * len(found)


def test_odd_rows(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for slices in (1, 4, 50):
        found = fp.fingerprint_pairs(odd_docs, slices=slices).collect()
        key = lambda i, n, digest, p: (i is not None, i or 0, n, digest, p)
        got = sorted(key(r.doc_id, r.n_chars, r.edited_sha256, r.next_fp) for r in found)
        assert got == sorted(
            key(i, len(t), hashlib.sha256(c.encode()).hexdigest(), fp.simhash(f)) for i, t, c, f in expected_rows(rows)
        )
    assert fp.fingerprint_pairs(odd_docs.limit(0)).count() == 0
    nulls = fp.fingerprint_pairs(odd_docs.filter("doc_id is null")).collect()
    assert len(nulls) == 2
    single = fp.fingerprint_pairs(odd_docs.filter("doc_id = 6")).collect()
    assert len(single) == 1 and single[0].fp == single[0].next_fp
