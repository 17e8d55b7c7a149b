"""Entity resolution: normalised values to canonical entities.

The rule is greedy: in input order a value joins the most similar earlier cluster
root that is at least ``HIGH`` similar, else it becomes a root.  Whether a value
is a root depends only on its earlier similar values, so the sequential pass is the
lexicographically first independent set of the similarity graph.  That is what the
loop here computes, on all cases and types at once, without one task per group.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadline.functions import ids
from threadline.functions.similarity import (
    AMBIGUOUS,
    HIGH,
    edit_budget,
    initial_match,
    initials_agree,
    match_class,
    similarity,
)
from threadline.session import Pile, cut_lineage, discard

GROUP = ["case_id", "entity_type"]
# Below this threshold the edit budget exceeds what segments can cover.
SEGMENT_FLOOR = 0.75
#: Values of a group that meet without keys.
FEW = 16


def distinct_values(signals: DataFrame, order: Column | str) -> DataFrame:
    """One row per value: first position in input order and multiplicity."""
    return (
        signals.filter(F.length("normalized_value") > 0)
        .groupBy(*GROUP, F.col("normalized_value").alias("value"))
        .agg(F.min(order).alias("seq"), F.count(F.lit(1)).alias("occurrences"))
    )


def _reaching(sized: DataFrame, threshold: float, stretch: float) -> DataFrame:
    """(short, long, budget) of each group: two lengths that its values have and that can be as similar as ``threshold``.

    Keys are made for these alone; no value has a partner of any other length.
    """
    lengths = sized.select(*GROUP, F.col("size").alias("short")).distinct()
    both = lengths.join(lengths.withColumnRenamed("short", "long").hint("merge"), GROUP)
    longest = F.greatest(F.floor(F.col("short") * F.lit(stretch) + F.lit(1e-9)).cast("int"), F.col("short"))
    smallest = F.greatest(F.ceil(F.col("long") / F.lit(stretch) - F.lit(1e-9)), F.lit(1)).cast("int")
    both = both.filter(F.col("long").between(F.col("short"), longest) & (F.col("short") >= smallest))
    both = both.withColumn("budget", edit_budget(F.col("short"), F.col("long"), threshold))
    return both.filter(F.col("budget") >= F.col("long") - F.col("short"))


def _segment_keys(values: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Index keys of the shorter value and probe keys of the longer one.

    For lengths a <= b with an edit budget, the shorter value is cut into budget + 2
    pieces.  An edit breaks at most one piece, so two pieces stand unchanged in any
    similar longer value, shifted by no more than the edits before them.  Each value
    can therefore leave its most common piece (a dialling code, a mail domain) out of
    the index and still meet every partner.  Values too short for that are cut into
    budget + 1 pieces and keep them all.
    """
    stretch = (2.0 - threshold) / threshold

    def pieces(length: Column, budget: Column) -> Column:
        roomy = (budget >= 1) & (length >= 2 * (budget + 2))
        return F.when(roomy, budget + 2).otherwise(budget + 1)

    def start(length: Column, count: Column, index: Column) -> Column:
        return F.floor(length * index / count).cast("int")

    sized = values.withColumn("text", F.lower("value")).withColumn("size", F.length("text"))
    reach = _reaching(sized, threshold, stretch)
    index = sized.join(reach.withColumnRenamed("short", "size").hint("merge"), [*GROUP, "size"])
    index = index.withColumn("count", pieces(F.col("size"), F.col("budget")))
    index = index.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    begin = start(F.col("size"), F.col("count"), F.col("piece"))
    end = start(F.col("size"), F.col("count"), F.col("piece") + 1)
    index = index.select(
        *GROUP, "value", "seq", "text", "size", F.col("size").alias("short"), "long", "budget", "count", "piece",
        F.col("text").substr(begin + 1, end - begin).alias("part"),
    )
    key = [*GROUP, "short", "long", "piece", "part"]
    uses = index.groupBy(*key).agg(F.count(F.lit(1)).alias("uses"))
    # The array holds the pieces of one value, never more than its length.
    # How many keys the sequences above give is not in the planner's sizes, which are those of
    # the table read: joins of keys are merged in sorted order, never sent to the driver.
    ranked = index.join(uses.hint("merge"), key).groupBy(*GROUP, "value", "seq", "text", "size", "short", "long", "budget", "count").agg(
        F.array_sort(F.collect_list(F.struct("uses", "piece", "part"))).alias("parts")
    )
    kept = F.slice("parts", F.lit(1), F.col("budget") + 1)
    index = ranked.select(*GROUP, "value", "seq", "text", "size", "short", "long", F.inline(kept)).drop("uses")

    probe = sized.join(reach.withColumn("size", F.col("long")).hint("merge"), [*GROUP, "size"])
    gap = F.col("long") - F.col("short")
    probe = probe.withColumn("count", pieces(F.col("short"), F.col("budget")))
    probe = probe.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    back = F.floor((F.col("budget") - gap) / 2).cast("int")
    ahead = F.floor((F.col("budget") + gap) / 2).cast("int")
    begin = start(F.col("short"), F.col("count"), F.col("piece"))
    width = start(F.col("short"), F.col("count"), F.col("piece") + 1) - begin
    low = F.greatest(begin - back, F.lit(0))
    high = F.least(begin + ahead, F.col("size") - width)
    probe = probe.filter(low <= high).withColumn("at", F.explode(F.sequence(low, high)))
    probe = probe.select(
        *GROUP, "value", "seq", "text", "size", "short", "long", "piece",
        F.col("text").substr(F.col("at") + 1, width).alias("part"),
    ).distinct()
    return index, probe


def _letter_keys(values: DataFrame, threshold: float) -> DataFrame:
    """Rarest letters of each value (letter plus its count so far).

    Similar values share at least threshold / 2 of all their letters, so they also
    share one of the rarest size - least_shared + 1 letters of either.
    """
    shrink = threshold / (2.0 - threshold)
    sized = values.withColumn("text", F.lower("value")).withColumn("size", F.length("text"))
    # Sorted once a value; a copy of a letter is told by its place after the first.
    sized = sized.withColumn("sorted", F.array_sort(F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0))))
    letters = sized.select("*", F.posexplode("sorted").alias("at", "letter"))
    first = F.array_position("sorted", F.col("letter")).cast("int")
    tokens = letters.withColumn("part", F.concat_ws("#", "letter", (F.col("at") - first).cast("string"))).drop("sorted")
    frequency = tokens.groupBy(*GROUP, "part").agg(F.count(F.lit(1)).alias("uses"))
    ranked = tokens.join(frequency.hint("merge"), [*GROUP, "part"]).groupBy(*GROUP, "value", "seq", "text", "size").agg(
        F.array_sort(F.collect_list(F.struct("uses", "part"))).alias("parts")
    )
    smallest = F.greatest(F.ceil(F.col("size") * F.lit(shrink) - F.lit(1e-9)), F.lit(1))
    shared = F.ceil((F.col("size") + smallest) * F.lit(threshold / 2.0) - F.lit(1e-9))
    kept = F.slice(F.col("parts.part"), F.lit(1), (F.col("size") - shared + 1).cast("int"))
    return ranked.select(*GROUP, "value", "seq", "text", "size", F.explode(kept).alias("part"))


def _rarest(group: Sequence[str], threshold: float) -> list[list[str]]:
    """The keys that ``_letter_keys`` gives the texts of a small group."""
    marked = []
    for text in group:
        seen: Counter[str] = Counter()
        parts = []
        for letter in text:
            parts.append(f"{letter}#{seen[letter] - 1}")
            seen[letter] += 1
        marked.append(parts)
    uses = Counter(part for parts in marked for part in parts)
    shrink = threshold / (2.0 - threshold)
    kept = []
    for parts in marked:
        smallest = max(math.ceil(len(parts) * shrink - 1e-9), 1)
        shared = math.ceil((len(parts) + smallest) * (threshold / 2.0) - 1e-9)
        kept.append(sorted(parts, key=lambda part: (uses[part], part))[: len(parts) - shared + 1])
    return kept


def _small_groups(few: DataFrame, threshold: float) -> DataFrame:
    """Pairs of groups of up to ``FEW`` values: each meets each in the row of its group, under the same conditions."""
    letters = threshold <= SEGMENT_FLOOR
    member = F.struct("value", "seq", F.lower("value").alias("text"), F.length(F.lower("value")).alias("size"))
    groups = few.groupBy(*GROUP).agg(F.collect_list(member).alias("members")).filter("size(members) > 1")
    if letters:

        @F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
        def rarest(texts: pd.Series) -> pd.Series:
            return pd.Series([_rarest(group, threshold) for group in texts])

        groups = groups.withColumn("parts", rarest("members.text"))
        groups = groups.withColumn("members", F.zip_with("members", "parts", lambda m, parts: m.withField("parts", parts))).drop("parts")
    met = groups.withColumn("x", F.explode("members")).withColumn("y", F.explode("members")).filter("x.value < y.value")
    if letters:
        met = met.filter(F.arrays_overlap("x.parts", "y.parts"))
    return _close(met, threshold)


def candidate_pairs(values: DataFrame, threshold: float, against: DataFrame | None = None) -> DataFrame:
    """Pairs (earlier, later) that can reach ``threshold``; exact, no pair is lost.

    In groups of up to ``FEW`` values each meets each, which is fewer rows than the keys
    of one.  ``against`` limits the earlier side to some of the values.
    """
    sizes = values.groupBy(*GROUP).agg((F.count(F.lit(1)) <= FEW).alias("few"))
    # There may be as many groups as values: merged, never sent to the driver.
    tagged = cut_lineage(values.join(sizes.hint("merge"), GROUP))
    pairs = _small_groups(tagged.filter("few"), threshold)
    many = tagged.filter("not few").drop("few")
    if not many.isEmpty():
        pairs = pairs.unionByName(_keyed(many, threshold))
    if against is None:
        return pairs
    heads = against.select(*GROUP, F.col("value").alias("earlier"))
    return pairs.join(heads, [*GROUP, "earlier"], "left_semi")


def _keyed(values: DataFrame, threshold: float) -> DataFrame:
    """Pairs that meet under a key."""
    if threshold > SEGMENT_FLOOR:
        index, probe = _segment_keys(values, threshold)
        keys = [*GROUP, "short", "long", "piece", "part"]
        tie = (F.col("x.size") < F.col("y.size")) | (F.col("x.value") < F.col("y.value"))
    else:
        index = probe = _letter_keys(values, threshold)
        keys = [*GROUP, "part"]
        tie = F.col("x.value") < F.col("y.value")
    x, y = index.alias("x"), probe.alias("y")
    on = F.lit(True)
    for key in keys:
        on = on & (F.col(f"x.{key}") == F.col(f"y.{key}"))
    side = lambda name: F.struct(*[F.col(f"{name}.{c}") for c in ("value", "seq", "text", "size")]).alias(name)
    met = x.join(y.hint("merge"), on & tie).select(*[F.col(f"x.{name}") for name in GROUP], side("x"), side("y"))
    return _close(met, threshold).distinct()


def _close(met: DataFrame, threshold: float) -> DataFrame:
    """(earlier, later) of the values x and y that met and whose edits leave them as similar as ``threshold``."""
    budget = edit_budget(F.col("x.size"), F.col("y.size"), threshold)
    close = met.withColumn("budget", budget).filter(F.expr("levenshtein(x.text, y.text, budget) >= 0"))
    first = (F.col("x.seq") < F.col("y.seq")) | ((F.col("x.seq") == F.col("y.seq")) & (F.col("x.value") < F.col("y.value")))
    return close.select(
        *GROUP,
        F.when(first, F.col("x.value")).otherwise(F.col("y.value")).alias("earlier"),
        F.when(first, F.col("y.value")).otherwise(F.col("x.value")).alias("later"),
    )


def classify_pairs(pairs: DataFrame, left: str = "later", right: str = "earlier") -> DataFrame:
    """Add match_class, confidence and rule to value pairs."""
    scored = pairs.withColumn("ratio", similarity(F.col(left), F.col(right)))
    initial = initial_match(F.col(left), F.col(right), F.upper("entity_type") == "PERSON")
    verdict = match_class(F.col(left), F.col(right), F.col("entity_type"), F.col("ratio"), initial)
    return scored.withColumn("verdict", verdict).select(
        *pairs.columns, "ratio", "verdict.match_class", "verdict.confidence", "verdict.rule"
    )


def _find_roots(values: DataFrame, links: DataFrame) -> DataFrame:
    """Values that start a cluster: no earlier linked value is itself a start."""
    key = [*GROUP, "value"]
    later = links.select(*GROUP, F.col("later").alias("value")).distinct()
    roots = values.select(*key).join(later, key, "left_anti")
    fresh = roots
    open_links = links.select(*GROUP, "later", "earlier")
    pile = Pile(roots)
    pile.add(roots)
    while not open_links.isEmpty():
        heads = fresh.withColumnRenamed("value", "earlier")
        joined = open_links.join(heads, [*GROUP, "earlier"], "left_semi")
        merged = joined.select(*GROUP, F.col("later").alias("value")).distinct()
        undecided = open_links.select(*GROUP, F.col("later").alias("value")).distinct()
        undecided = undecided.join(merged, key, "left_anti")
        rest = open_links.join(merged.withColumnRenamed("value", "later"), [*GROUP, "later"], "left_anti")
        rest = cut_lineage(rest.join(merged.withColumnRenamed("value", "earlier"), [*GROUP, "earlier"], "left_anti"))
        waiting = rest.select(*GROUP, F.col("later").alias("value")).distinct()
        before, fresh = fresh, cut_lineage(undecided.join(waiting, key, "left_anti"))
        pile.add(fresh)
        discard(before, open_links)
        open_links = rest
    return pile.rows()


def resolve_values(values: DataFrame, fuzzy_types: Sequence[str] | None = None) -> DataFrame:
    """Cluster root, confidence and rule of every distinct value.

    ``fuzzy_types`` names the types that may merge unequal values (default: all).
    """
    values = cut_lineage(values)
    fuzzy = values
    if fuzzy_types is not None:
        fuzzy = values.filter(F.upper("entity_type").isin([name.upper() for name in fuzzy_types]))
    links = classify_pairs(candidate_pairs(fuzzy, HIGH)).filter("match_class = 'HIGH_CONFIDENCE_FUZZY'")
    links = cut_lineage(links.select(*GROUP, "later", "earlier", "confidence", "rule"))
    roots = cut_lineage(_find_roots(values, links))
    seqs = values.join(roots, [*GROUP, "value"], "left_semi").select(
        *GROUP, F.col("value").alias("earlier"), F.col("seq").alias("root_seq")
    )
    offers = links.join(roots.withColumnRenamed("value", "later"), [*GROUP, "later"], "left_anti")
    offers = offers.join(seqs, [*GROUP, "earlier"])
    best = offers.groupBy(*GROUP, F.col("later").alias("value")).agg(
        F.min(F.struct((-F.col("confidence")).alias("worst"), "root_seq", F.col("earlier").alias("root"), "rule")).alias("b")
    )
    return values.join(best, [*GROUP, "value"], "left").select(
        *GROUP,
        "value",
        "seq",
        "occurrences",
        F.coalesce("b.root", "value").alias("root"),
        F.coalesce(-F.col("b.worst"), F.lit(1.0)).alias("confidence"),
        F.coalesce("b.rule", F.lit("NEW_CANONICAL_ROOT")).alias("rule"),
    )


def resolve_entities(resolved: DataFrame) -> DataFrame:
    """One row per cluster, with its canonical id, size and weakest merge."""
    lowest = F.min("confidence")
    clusters = resolved.groupBy(*GROUP, F.col("root").alias("normalized_value")).agg(
        F.sum("occurrences").alias("supporting_observations_count"),
        F.count(F.lit(1)).alias("distinct_values"),
        lowest.alias("match_confidence"),
        F.when(lowest < 1.0, F.lit("FUZZY_STRING_SIMILARITY")).otherwise(F.lit("NEW_CANONICAL_ROOT")).alias("match_method"),
    )
    key = ids.canonical_key(F.col("case_id"), F.col("entity_type"), F.col("normalized_value"))
    return clusters.withColumn("canonical_key", key).select(
        ids.canonical_id(F.col("entity_type"), F.col("canonical_key")).alias("canonical_entity_id"),
        "canonical_key",
        *GROUP,
        F.col("normalized_value").alias("canonical_name"),
        "supporting_observations_count",
        "distinct_values",
        "match_confidence",
        "match_method",
        F.lit("UNVERIFIED_AUTOMATED_CLUSTER").alias("human_verification_status"),
    )


def signal_to_entity(signals: DataFrame, resolved: DataFrame) -> DataFrame:
    """Signal to canonical entity, by full digest and display id."""
    links = resolved.select(*GROUP, F.col("value").alias("normalized_value"), "root")
    key = ids.canonical_key(F.col("case_id"), F.col("entity_type"), F.col("root"))
    # Keys travel as bytes.
    packed = signals.withColumn("signal_key", ids.packed(F.col("signal_key")))
    joined = packed.join(links, [*GROUP, "normalized_value"]).withColumn("canonical_key", key)
    return joined.select(
        "case_id", "signal_id", ids.unpacked(F.col("signal_key")).alias("signal_key"), "entity_type", "canonical_key",
        ids.canonical_id(F.col("entity_type"), F.col("canonical_key")).alias("canonical_entity_id"),
        "evidence_id", "artifact_id", "job_id", "observation_id",
    )


def entity_provenance(mapping: DataFrame) -> DataFrame:
    """Distinct supporting ids per entity, one row per (entity, kind, id).

    Long form: an entity seen in very many places has many rows, not one huge array.
    """
    kinds = ["evidence_id", "artifact_id", "job_id", "observation_id"]
    pairs = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("ref")) for kind in kinds])
    rows = mapping.select("case_id", "canonical_entity_id", "canonical_key", F.explode(pairs).alias("p"))
    return (
        rows.select("case_id", "canonical_entity_id", "canonical_key", "p.kind", "p.ref")
        .filter(F.length("ref") > 0)
        .distinct()
    )


def primary_evidence(provenance: DataFrame) -> DataFrame:
    """First evidence id in sort order and the number of ids of each kind."""
    def count(kind: str) -> Column:
        return F.count_if(F.col("kind") == kind)

    return provenance.groupBy("case_id", "canonical_entity_id", "canonical_key").agg(
        F.min(F.when(F.col("kind") == "evidence_id", F.col("ref"))).alias("evidence_id"),
        count("evidence_id").alias("evidence_count"),
        count("artifact_id").alias("artifact_count"),
        count("job_id").alias("job_count"),
        count("observation_id").alias("observation_count"),
    )


def canonicalize_relationships(relationships: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace signal endpoints by entities; unmapped and self edges go."""
    # Dealt by the key of both joins, so that neither these nor the distinct deal it again; keys travel as bytes.
    keys = [ids.packed(F.col(name)).alias(name) for name in ("signal_key", "canonical_key")]
    entity = mapping.select("case_id", *keys, "canonical_entity_id")
    entity = entity.repartition("case_id", "signal_key").distinct()
    source = entity.select(
        "case_id", F.col("signal_key").alias("source_signal_key"),
        F.col("canonical_key").alias("src_key"), F.col("canonical_entity_id").alias("src_id"),
    )
    target = entity.select(
        "case_id", F.col("signal_key").alias("target_signal_key"),
        F.col("canonical_key").alias("tgt_key"), F.col("canonical_entity_id").alias("tgt_id"),
    )
    ends = ["source_signal_key", "target_signal_key"]
    joined = relationships.withColumns({name: ids.packed(F.col(name)) for name in ends}).join(source, ["case_id", ends[0]])
    joined = joined.join(target, ["case_id", ends[1]])
    return joined.filter(F.col("src_key") != F.col("tgt_key")).select(
        "rel_id", "src_id", "tgt_id",
        F.col("source_label").alias("src_label"), F.col("target_label").alias("tgt_label"),
        "rel_label", "case_id", "evidence_id", "artifact_id", "observation_id", "job_id", "confidence",
        "source_location", "extraction_method", "human_verification_status",
        "source_signal_id", "target_signal_id",
        ids.unpacked(F.col("src_key")).alias("src_key"), ids.unpacked(F.col("tgt_key")).alias("tgt_key"),
    )


def initial_pairs(values: DataFrame) -> DataFrame:
    """Person pairs where one first name is an initial, found through similar last names."""
    people = values.filter(F.upper("entity_type") == "PERSON").withColumn("words", F.split("value", " "))
    people = people.filter(F.size("words") >= 2).select(
        *GROUP, "value", "seq",
        F.element_at("words", -1).alias("last"),
        F.upper(F.substring(F.get("words", F.lit(0)), 1, 1)).alias("letter"),
        (F.length(F.get("words", F.lit(0))) == 1).alias("short"),
    )
    lasts = people.select(*GROUP, F.lower("last").alias("value")).distinct().withColumn("seq", F.lit(0))
    near = candidate_pairs(lasts, HIGH).select(*GROUP, F.col("earlier").alias("a"), F.col("later").alias("b"))
    same = lasts.select(*GROUP, F.col("value").alias("a"), F.col("value").alias("b"))
    both = near.unionByName(near.select(*GROUP, F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(same)
    left = people.filter("short").select(*GROUP, F.lower("last").alias("a"), "letter", F.struct("seq", "value").alias("p"))
    right = people.select(*GROUP, F.lower("last").alias("b"), "letter", F.struct("seq", "value").alias("q"))
    met = left.join(both, [*GROUP, "a"]).join(right, [*GROUP, "b", "letter"]).filter("p.value <> q.value")
    return met.select(
        *GROUP,
        F.least("p", "q").getField("value").alias("earlier"),
        F.greatest("p", "q").getField("value").alias("later"),
    ).distinct()


def review_queue(resolved: DataFrame, floor: float = AMBIGUOUS) -> DataFrame:
    """Ambiguous pairs of a value and an earlier cluster root, for a human to decide."""
    values = resolved.select(*GROUP, "value", "seq")
    roots = resolved.filter("value = root").select(*GROUP, "value", "seq")
    band = candidate_pairs(values, floor, against=roots)
    heads = roots.select(*GROUP, F.col("value").alias("earlier"))
    initials = initial_pairs(values).join(heads, [*GROUP, "earlier"], "left_semi")
    return classify_pairs(band.unionByName(initials).distinct()).filter("match_class = 'AMBIGUOUS_CANDIDATE'")


def er_evaluate(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Pair-level precision, recall and F1 of predicted clusters.

    ``truth`` has (obs_id, cluster_id, counted): clusters that are not counted expect
    no pairs.  ``predicted`` has (obs_id, cluster_id).  Pairs are counted from group
    sizes, n (n - 1) / 2 per group, and never listed.
    """
    def counted(groups: DataFrame, name: str) -> DataFrame:
        size = F.col("n").cast("double")
        return groups.select(F.lit(name).alias("side"), (size * (size - 1) / 2).alias("pairs"))

    both = truth.select("obs_id", F.col("cluster_id").alias("t"), "counted").join(
        predicted.select("obs_id", F.col("cluster_id").alias("p")), "obs_id"
    )
    expected = truth.filter("counted").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    found = predicted.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    hits = both.filter("counted").groupBy("t", "p").agg(F.count(F.lit(1)).alias("n"))
    sides = counted(hits, "tp").union(counted(found, "found")).union(counted(expected, "expected"))
    totals = sides.agg(
        *[
            F.coalesce(F.sum(F.when(F.col("side") == name, F.col("pairs"))), F.lit(0.0)).alias(name)
            for name in ("tp", "found", "expected")
        ]
    )
    precision = F.when(F.col("found") > 0, F.col("tp") / F.col("found")).otherwise(1.0)
    recall = F.when(F.col("expected") > 0, F.col("tp") / F.col("expected")).otherwise(1.0)
    scored = totals.withColumn("precision", precision).withColumn("recall", recall)
    total = F.col("precision") + F.col("recall")
    return scored.select(
        F.col("tp").cast("long").alias("true_matches"),
        (F.col("found") - F.col("tp")).cast("long").alias("false_matches"),
        (F.col("expected") - F.col("tp")).cast("long").alias("missed_matches"),
        "precision",
        "recall",
        F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0).alias("f1_score"),
    )
