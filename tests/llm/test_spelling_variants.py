import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as contract
from threadline.llm import spelling_variants as sv


def words_by_hand(docs):
    lower = str.maketrans(sv.UPPER, sv.LOWER)
    found = Counter()
    for ident, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def near_by_hand(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(counts):
    rows, form = {}, {}
    for w in counts:
        near = [v for v in counts if near_by_hand(v, w)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= 5 * counts[w]:
            form[w] = best
        rows[w] = [counts[w], len(near)]
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        rows[w] += [form.get(w), counts.get(form.get(w)), root]
    return {w: tuple(r) for w, r in rows.items()}


def found_in(frame):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in frame.collect()}


def test_query_against_brute_force(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    found = contract.queries()["op12_spelling_variants"](spark, data)
    assert set(found.columns) == {"word", "form", "root", "n", "n_near", "form_n"}
    assert found_in(found) == variants_by_hand(words_by_hand(docs))


def test_chains_ties_and_anagrams(spark, monkeypatch):
    rng = random.Random(4)
    counts = {"abcdef": 5, "abcdeg": 25, "abcdgg": 125, "bbcdgg": 125, "abcdggg": 700, "éabcde": 50, "èabcde": 10}
    letters = list("aabbcc")
    while len(counts) < 700:  # anagrams share one vector; no box parts them
        rng.shuffle(letters)
        counts["".join(letters) + rng.choice(["", "d", "dd", "x"])] = rng.choice([5, 30, 200, 2000])
        counts["".join(rng.choices("abcdé", k=6))] = rng.choice([5, 30, 200])
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    expected = variants_by_hand(counts)
    assert expected["abcdef"][2:] == ("abcdeg", 25, "abcdggg")
    assert found_in(sv.group_variants(frame)) == expected
    # Many leaves and many parts of each give the same.
    for name, value in (("LEAF", 40), ("SAMPLE", 300), ("TWIG", 4), ("INDEX_PART", 16), ("QUESTION_PART", 32)):
        monkeypatch.setattr(sv, name, value)
    assert found_in(sv.group_variants(frame)) == expected


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text("abÀ", min_size=1, max_size=5), unique=True, max_size=30))
def test_pairs_of_one_task(words):
    coded = [w.encode("latin-1") for w in words]
    found = {tuple(sorted((words[int(a)], words[int(b)]))) for q, p in sv.pairs_within(coded, coded) for a, b in zip(q, p, strict=True)}
    assert found == {(a, b) for a in words for b in words if a < b and near_by_hand(a, b)}


def test_boxes_lose_no_word():
    rng = random.Random(9)
    words = sorted({"".join(rng.choices("abcdeé", k=rng.randrange(3, 7))).encode("latin-1") for _ in range(900)})
    top = sv.Top(sv.counts_of(words[::3]), 8)
    home = top.home(sv.counts_of(words))
    asked = set(zip(*map(np.ndarray.tolist, top.reach(sv.counts_of(words))), strict=True))
    assert top.leaves > 10
    assert len(asked) < 0.8 * len(words) * top.leaves  # boxes prune
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            if len(b) >= len(a) and near_by_hand(a, b):
                assert (i, int(home[j])) in asked


def test_odd_rows(spark, odd_docs):
    found = {r.word: r.n for r in sv.damaged_words(odd_docs).collect()}
    assert found == words_by_hand([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert found_in(sv.group_variants(sv.damaged_words(odd_docs))).keys() == found.keys()
    assert sv.group_variants(sv.damaged_words(odd_docs.limit(0))).count() == 0
    rows = [(None, "Straße straße STRASSE École école " * 3), (1, "x" * 200_000 + " " + "x" * 199_999), (2, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.word: r.n for r in sv.damaged_words(frame).collect()} == words_by_hand(rows)
    long = spark.createDataFrame([("x" * 200_000, 5), ("x" * 199_999, 25)], "word string, n long")
    assert {r.n: r.form_n for r in sv.group_variants(long).collect()} == {5: 25, 25: None}
