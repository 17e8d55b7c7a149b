import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_near_copies import groups_by_hand
from tests.llm.test_quality_rules import counts_by_hand


def test_stages_against_brute_force(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, tables[-1], data).write.parquet(str(tmp_path / name))
        tables.append(spark.read.parquet(str(tmp_path / name)))
    assert all(t.columns == docs.columns for t in tables[:-1])
    rows = [[r.asDict() for r in t.collect()] for t in tables[:-1]]
    for before, after in zip(rows, rows[1:]):  # noqa: B905
        assert {str(r) for r in after} <= {str(r) for r in before}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    clean = {i for i, y in labels.items() if y.quality == 1 and y.toxic == 0}
    classified, ruled, single, mixed = rows[1:]
    of = lambda table: {r["doc_id"] for r in table}
    assert len(clean & of(classified)) >= 0.97 * len(clean & of(rows[0]))
    passed = []
    for r in classified:
        n, *_, repeat = counts_by_hand(r["text"])
        if n >= 50 and 100 * repeat <= 50 * n:
            passed.append(r)
    assert of(ruled) <= {r["doc_id"] for r in passed}
    assert len(clean & of(ruled)) >= 0.97 * len(clean & {r["doc_id"] for r in passed})
    least = groups_by_hand({r["doc_id"]: r["text"] for r in ruled})
    assert sorted(r["doc_id"] for r in single) == sorted(set(least.values()))
    words = lambda table: sum(len(r["text"].split()) for r in table)
    assert abs(words(mixed) - 1.5 * words(single)) <= 0.1 * words(single)
    packed = tables[-1].collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in mixed}
    once = {}
    for r in packed:  # a document taken twice has every piece twice
        once.setdefault((r.doc_id, r.piece), r)
    assert {i for i, _ in once} == set(texts)
    for (i, piece), r in once.items():
        if piece == 0:
            n = len(tokenizer.encode(texts[i], add_special_tokens=False).ids) + 1
            assert r.length == (n - 1) % 1024 + 1
    assert len(packed) == sum(-(-(len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1) // 1024) for r in mixed)


def test_run_gives_the_last_stage(spark, data):
    found = corpus_pipeline.run(spark, data)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert found.filter("offset + length > 1024").count() == 0
