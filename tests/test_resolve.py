"""Resolution against the plain sequential rule."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from threadline.operators import resolve


def ratio(a, b):
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


def initial(a, b):
    x, y = a.split(), b.split()
    if len(x) < 2 or len(y) < 2 or ratio(x[-1], y[-1]) < 0.85:
        return False
    return (len(x[0]) == 1 or len(y[0]) == 1) and x[0][0].upper() == y[0][0].upper()


def sequential(values):
    roots, joined, review = [], {}, set()
    for value in dict.fromkeys(values):
        best, high = None, 0.0
        for root in roots:
            if initial(value, root):
                review.add((value, root))
                continue
            close = ratio(value, root)
            if close >= 0.85:
                if round(close, 2) > high:
                    best, high = root, round(close, 2)
            elif close >= 0.60:
                review.add((value, root))
        if best is None:
            roots.append(value)
            joined[value] = (value, 1.0)
        else:
            joined[value] = (best, high)
    return joined, review


def noisy_names(seed, count):
    rng = random.Random(seed)
    base = ["Vikram Singh", "Rajesh Kumar", "Anita Desai", "V Singh", "Mohan Lal", "Sunita Devi Sharma", "R Kumar", "Al", "Bo", "+919876543210"]
    values = []
    for _ in range(count):
        letters = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            at, kind = rng.randrange(len(letters)), rng.random()
            if kind < 0.4:
                letters[at] = rng.choice("abcdxyz ")
            elif kind < 0.7 and len(letters) > 2:
                del letters[at]
            else:
                letters.insert(at, rng.choice("aeiou"))
        value = " ".join("".join(letters).split())
        if value:
            values.append(value)
    return values


@pytest.mark.parametrize("seed", [3, 11])
def test_same_clusters_as_sequential_pass(spark, seed):
    values = noisy_names(seed, 160)
    rows = spark.createDataFrame([("C", "Person", v, i) for i, v in enumerate(values)], "case_id string, entity_type string, normalized_value string, seq long")
    resolved = resolve.resolve_values(resolve.distinct_values(rows, "seq"))
    joined, review = sequential(values)
    assert {r.value: (r.root, r.confidence) for r in resolved.collect()} == joined
    assert {(r.later, r.earlier) for r in resolve.review_queue(resolved).collect()} == review
    entities = resolve.resolve_entities(resolved).collect()
    assert sum(e.supporting_observations_count for e in entities) == len(values)
    weakest = {}
    for value in values:
        root, confidence = joined[value]
        weakest[root] = min(weakest.get(root, 1.0), confidence)
    assert {e.canonical_name: e.match_confidence for e in entities} == weakest


def test_fuzzy_types_and_case_isolation(spark):
    rows = spark.createDataFrame(
        [("C", "PhoneNumber", "+919876543210", 1), ("C", "PhoneNumber", "+919876543211", 2), ("D", "PhoneNumber", "+919876543211", 3)],
        "case_id string, entity_type string, normalized_value string, seq long",
    )
    values = resolve.distinct_values(rows, "seq")
    assert resolve.resolve_entities(resolve.resolve_values(values)).count() == 2
    assert resolve.resolve_entities(resolve.resolve_values(values, ["Person"])).count() == 3


def test_evaluation_counts_pairs(spark):
    truth = spark.createDataFrame([(i, "a", True) for i in range(3)] + [(i, "b", True) for i in range(3, 5)] + [(5, "c", False), (6, "c", False)], "obs_id int, cluster_id string, counted boolean")
    guess = spark.createDataFrame([(0, "x"), (1, "x"), (2, "x"), (3, "y"), (4, "z"), (5, "w"), (6, "w")], "obs_id int, cluster_id string")
    got = resolve.er_evaluate(truth, guess).first()
    assert (got.true_matches, got.false_matches, got.missed_matches) == (3, 1, 1)
    assert (got.precision, got.recall, got.f1_score) == (0.75, 0.75, 0.75)


def test_keys_are_joined_without_a_broadcast(spark, capsys):
    """The planner's sizes are those of the table, not of the keys made from it."""
    rows = spark.range(40).select((F.col("id") % 2).cast("string").alias("case_id"), F.lit("Person").alias("entity_type"), F.concat(F.lit("name of "), "id").alias("value"), F.col("id").alias("seq"))
    for threshold in (0.85, 0.60):
        resolve.candidate_pairs(rows, threshold).explain()
        assert "Broadcast" not in capsys.readouterr().out


def test_keys_are_made_for_lengths_that_a_group_has(spark):
    rows = spark.range(2).select(
        F.lit("c").alias("case_id"), F.lit("Person").alias("entity_type"), F.col("id").alias("seq"),
        F.when(F.col("id") == 0, F.repeat(F.lit("abcdefghij"), 3)).otherwise(F.concat(F.repeat(F.lit("abcdefghij"), 3), F.lit("xx"))).alias("value"),
    )
    index, probe = resolve._segment_keys(rows, 0.85)
    pairs = {(30, 30), (30, 32), (32, 32)}
    assert {tuple(r) for r in index.select("short", "long").distinct().collect()} == pairs
    assert {tuple(r) for r in probe.select("short", "long").distinct().collect()} == pairs
    assert resolve.candidate_pairs(rows, 0.85).count() == 1


@pytest.mark.parametrize("threshold", [0.60, 0.85])
def test_small_groups_meet_without_keys_and_give_the_same_pairs(spark, monkeypatch, threshold):
    rng = random.Random(5)
    rows = [(f"C{rng.randrange(12) if n % 3 else n}", "Person", v, n) for n, v in enumerate(noisy_names(5, 150))]
    rows += [(None, "Person", "Anita Desai", 1), (None, "Person", "Anita Desay", 2), ("T", "Person", "Ab", 1), ("T", "Person", "aB", 1)]
    values = resolve.distinct_values(spark.createDataFrame(rows, "case_id string, entity_type string, normalized_value string, seq long"), "seq")
    found = sorted(tuple(r) for r in resolve.candidate_pairs(values, threshold).collect())
    assert found == sorted(tuple(r) for r in resolve._keyed(values, threshold).collect())
    with monkeypatch.context() as patch:
        # Groups of two or three values make no keys.
        patch.setattr(resolve, "_keyed", lambda *_: pytest.fail("keys"))
        few = spark.createDataFrame([(f"C{n}", "Person", v, n) for n in range(9) for v in ("Mohan Lal", "Mohan Lall", "Bo")], "case_id string, entity_type string, value string, seq long")
        assert resolve.candidate_pairs(few, threshold).count() == 9


def test_keys_of_relationships_travel_as_bytes(spark):
    """Digests and other texts as keys: letter case counts, and a text that looks like the bytes of a digest is another key."""
    import hashlib

    from threadline.functions import ids

    digest = hashlib.sha256(b"a").hexdigest()
    keys = [digest, digest.upper(), digest[:32], digest + "\n", "", "short", "0" * 64, "é" * 16]
    table = spark.createDataFrame([(n, key) for n, key in enumerate([*keys, None])], "n int, key string")
    packed = table.select("n", "key", ids.packed(F.col("key")).alias("p"))
    assert {r.n: r.k for r in packed.select("n", ids.unpacked(F.col("p")).alias("k")).collect()} == dict(enumerate([*keys, None]))
    assert packed.select("p").distinct().count() == len(keys) + 1
    names = ["rel_id", "rel_label", "evidence_id", "artifact_id", "observation_id", "job_id", "source_location", "extraction_method",
             "human_verification_status", "source_signal_id", "target_signal_id", "source_label", "target_label"]
    ends = [(n, keys[a], keys[b]) for n, (a, b) in enumerate([(0, 1), (1, 0), (2, 3), (4, 5), (6, 7), (0, 0), (5, 6)])]
    found = spark.createDataFrame([("C", str(n), a, b) for n, a, b in ends] + [("C", "x", None, digest), ("D", "y", digest, "short")],
                                  "case_id string, rel_id string, source_signal_key string, target_signal_key string")
    found = found.select("*", *[F.lit(name).alias(name) for name in names[1:]], F.lit(1.0).alias("confidence"))
    # "short" and the zeros are one entity; each signal is mapped twice.
    entity = lambda key: "same" if key in ("short", "0" * 64) else f"E{key}"
    mapping = spark.createDataFrame(2 * [("C", key, entity(key), f"CAN-{keys.index(key)}" if entity(key) != "same" else "CAN") for key in keys],
                                    "case_id string, signal_key string, canonical_key string, canonical_entity_id string")
    result = resolve.canonicalize_relationships(found, mapping)
    assert sorted((r.rel_id, r.src_key, r.tgt_key) for r in result.collect()) == sorted(
        (str(n), entity(a), entity(b)) for n, a, b in ends if entity(a) != entity(b)
    )
    assert result._jdf.queryExecution().optimizedPlan().toString().count("unhex(") >= 3
