from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import zlib
from tokenizers import Tokenizer

import __spark_entry__ as contract
from threadline.llm import packing, token_counts, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


ODD = [
    "", " ", "\n", "a, b. it's, x.,; 9, .,; é! ²? don't.",  "a\n b", "a \nb", "x  y", "don't we'll 'S 's", "<|endoftext|>", "a<|endoftext|> b", "tab\tand\x0b\x0c\r\n",
    "é²½ ١٢ ⅷ x́  nbsp em 　cjk 中文", "\x1c\x1d\x85", "՘ new", "\U0001f600 smile", "under_score __init__", "a" * 5000,
]


def test_counts_and_ids_are_the_library_s(plain):
    counter, encoder = tokens.Counter(PATH), tokens.Encoder(PATH)
    for text in ODD:
        ids = plain(text)
        assert counter.count(text) == len(ids), text
        assert encoder.encode(text) == np.asarray(ids, "<u4").tobytes(), text


def test_character_classes_agree_where_they_are_trusted():
    split = Tokenizer.from_file(PATH).pre_tokenizer.pre_tokenize_str
    for code in [*range(0xD800), *range(0xE000, 0x20000)]:
        char = chr(code)
        if not tokens.UNSURE.match(char):
            for text in (f"a{char}1", f"!{char} {char}"):
                assert [span for _, span in split(text)] == [m.span() for m in tokens.PRETOKEN.finditer(text)], hex(code)


def test_rank_form_is_proved_and_agrees(plain):
    twin = tokens.rank_twin(PATH)
    assert twin is not None
    for code in [*range(0xD800), *range(0xE000, 0x20000)]:
        char = chr(code)
        if not tokens.UNSURE.match(char):
            for text in (f"a{char}1", f"!{char} {char}"):
                assert twin.encode_ordinary(text) == plain(text), hex(code)
    assert tokens.rank_twin(public_tokenizers.path("word_bpe_49k.json")) is None


def test_whole_tokens_are_proved(plain):
    whole = tokens.whole_tokens(PATH)
    assert len(whole) > 40_000 and " the" in whole and "<|endoftext|>" not in whole
    assert all(len(plain(s)) == 1 for s in list(whole)[:500])


def test_memory_of_pieces_is_bounded():
    seen = tokens.Remembered(len, 10)
    assert [seen["x" * (i % 37)] for i in range(500)] == [i % 37 for i in range(500)]
    assert len(seen) <= 10 and len(seen.old) <= 10


def test_count_query(spark, data, plain):
    found = {r.doc_id: r for r in contract.queries()["op5_token_counts"](spark, data).collect()}
    rows = spark.read.parquet(f"{data}/documents.parquet").collect()
    assert len(found) == len(rows)
    for row in rows:
        n, r = len(plain(row.text)), found[row.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((row.text or "").encode()), n, n > 512)


def test_count_odd_rows(spark, odd_docs, plain):
    found = token_counts.count_tokens(odd_docs, PATH).collect()
    assert [r.n_tokens for r in found] == [len(plain(r.doc.text)) for r in found]
    assert len(found) == odd_docs.count() and token_counts.count_tokens(odd_docs.limit(0), PATH).count() == 0


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(5)
    for counts in ({}, {1024: 3}, {1: 5000}, {512: 3, 256: 2}, dict(Counter(rng.integers(1, 1025, 3000).tolist()))):
        plan = packing.plan_patterns(counts)
        used = Counter()
        for lengths, times in plan:
            assert sum(lengths) <= 1024
            for n in lengths:
                used[n] += times
        assert used == Counter(counts)
        least = -(-sum(n * c for n, c in counts.items()) // 1024)
        assert sum(t for _, t in plan) <= max(least + 1, 1.02 * least)


def test_exact_fills():
    assert packing.plan_patterns({700: 1, 324: 1, 600: 1, 300: 1, 124: 1}) in (
        [((700, 324), 1), ((600, 300, 124), 1)], [((700, 324), 1), ((600, 300, 124), 1)][::-1])
    assert packing.plan_patterns({700: 2, 200: 2, 100: 2, 24: 2}) == [((700, 200, 100, 24), 2)]
    assert packing.plan_patterns({512: 3}) == [((512, 512), 1), ((512,), 1)]


@pytest.mark.parametrize(("scale", "most"), [("sf0.01", 964), ("sf0.1", 9872)])
def test_pairs_and_triples_reach_the_plan(spark, scale, most):
    docs = spark.read.parquet(f"/root/testdata/{scale}/documents.parquet")
    pieces = packing.token_pieces(docs.repartition(8), PATH, []).groupBy("length").count()
    counts = {r["length"]: r["count"] for r in pieces.collect()}
    fixed, combined, residue = packing.plan_parts(counts)
    assert sum(t for part in (fixed, combined, residue) for _, t in part) <= most
    assert sum(t for _, t in combined) >= most // 100
    assert all(sum(lengths) == 1024 and len(lengths) in (3, 4) for lengths, _ in combined)
    assert all(sum(lengths) == 1024 for lengths, _ in fixed)


def checked_packing(rows, texts, plain, capacity=1024):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for i, text in texts.items():
        ids, at = [*plain(text), 2], 0
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and len(pieces) == -(-len(ids) // capacity)
        assert all(r.length == capacity for r in pieces[1:])
        for r in pieces:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.asarray(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= 1.02 * -(-total // capacity) + 1


def test_packing_query(spark, data, plain):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    checked_packing(contract.queries()["op6_packing"](spark, data).collect(), texts, plain)


def test_packing_odd_rows(spark, odd_docs, plain):
    packed = packing.pack_documents(odd_docs, PATH).collect()
    assert sum(r.length for r in packed) == sum(len(plain(r.text)) + 1 for r in odd_docs.collect())
    assert all(len(r.ids) == 4 * r.length for r in packed)
    assert packing.pack_documents(odd_docs.limit(0), PATH).count() == 0
