"""Quality classifier: document evidence with hierarchical empirical Bayes over sites.

Two heads share the method: ``poor`` (label quality 0) and ``toxic`` (label toxic 1).

1. Evidence of a document: marks are its distinct words and the bins of a few ratios.
   Marks whose rates differ significantly between the classes enter a ridge logistic
   regression, which weighs marks that come together only once; its log-odds less those
   of the sample's rate are the evidence.  It is fitted on a bounded sample of labelled
   documents (``FIT_ROWS`` expected, chosen by a hash of the id).
2. Sites: a host (default: the source) holds paths (default: source and language).  Every document
   counts for its host and path, with its label if it has one, else with its evidence at
   a lower weight.  The spread between hosts, and between paths of a host, gives the
   strength of the priors by moments; sparse paths shrink towards their host, sparse
   hosts towards the global rate.
3. The posterior of a document is its evidence plus the log-odds of its path.

Defined results
---------------
* A null text is empty.  Null hosts or paths are sites of their own.
* Labels with a null id or null quality are none; ids with labels that disagree count by the worst.
* Without labels, or without both classes, a head rejects nothing.
* Repeated rows are classified one by one and each counts for its site.
* An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadline.llm.common import logit, named, same, small_batches, whole_row
from threadline.llm.descent import descend
from threadline.session import cut_lineage, discard

#: Expected number of labelled documents the marks are fitted on.
FIT_ROWS = 20_000
#: A word counts if its rates differ by so many standard errors; bins are few and need less.
SIGNIFICANT, BIN_SIGNIFICANT = 5.0, 3.0
#: Largest evidence of one document.
DOC_BOUND = 12.0
#: Ridge penalty of the regression, and the share by which five steps lower its loss at the end.
RIDGE, SETTLED = 0.2, 1e-4
#: Weight of an unlabelled document in its site's counts.
SOFT = 0.25
#: Rejected above this posterior.
CUT = 0.5

HEADS = ("poor", "toxic")
PUNCTUATION = ".,;:!?\"'()[]{}<>|#*$%&-_"
EDGES = (0.0, 0.01, 0.03, 0.08, 0.15, 0.3, 0.5, 0.75, 0.95)
_SYMBOLS = re.compile(r"[#*$%&|<>!]")


def _bin(value: float) -> int:
    return sum(value > edge for edge in EDGES)


def marks_of(text: str) -> list[str]:
    """Distinct words, lower-cased and without punctuation around them, and bins of ratios."""
    words = text.split()
    raw = set(words)
    found = {word.strip(PUNCTUATION).lower() for word in raw}
    found.discard("")
    n = len(words)
    size = min(6, n.bit_length() // 2)
    lines = [line for line in text.split("\n") if line.strip()]
    ratios = {
        "symbols": len(_SYMBOLS.findall(text)) / max(1, len(text)),
        "distinct": len(found) / max(1, n),
        "upper": sum(word.isupper() and len(word) > 1 for word in raw) / max(1, len(raw)),
        "lines": 1 - len(set(lines)) / max(1, len(lines)),
    }
    bins = [f" {name} {_bin(value)} {size if name == 'distinct' else ''}" for name, value in ratios.items()]
    return [*found, *bins]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _marks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([marks_of(text) for text in texts], dtype=object)


@dataclass
class Model:
    """For each head the weights of the marks, the evidence of a document without any, and the global rate.

    A head that cannot be fitted has no rate.
    """

    weights: dict[str, dict[str, float]]
    base: dict[str, float]
    rates: dict[str, float | None]


def label_table(labels: DataFrame) -> DataFrame:
    """(id, poor, toxic) with one row per labelled id."""
    return labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("id")).agg(
        F.max((F.col("quality") == 0).cast("int")).alias("poor"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic")
    )


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", rows: int = FIT_ROWS) -> Model:
    """Marks and global rates.  Only a bounded sample's marks are counted, only significant ones reach the driver."""
    known = label_table(labels)
    total = known.agg(F.count(F.lit(1)).alias("n"), *[F.sum(h).alias(h) for h in HEADS]).first()
    rates = {h: total[h] / total["n"] if total["n"] and 0 < total[h] < total["n"] else None for h in HEADS}
    share = min(1.0, rows / max(1, total["n"]))
    chosen = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(1 << 20)) < math.ceil(share * (1 << 20))
    # The chosen labels are some ``rows`` narrow rows whatever the input, so every task may hold them; no text is shuffled.
    sample = docs.filter(chosen(named(id_column))).select(named(id_column).cast("long").alias("id"), F.coalesce(named(text_column), F.lit("")).alias("text"))
    sample = sample.join(F.broadcast(known.filter(chosen(F.col("id")))), "id")
    seen = cut_lineage(sample.select("id", *HEADS, _marks("text").alias("marks")))
    sizes = seen.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(h), F.lit(0)).alias(h) for h in HEADS]).first()
    counts = seen.select(*HEADS, F.explode("marks").alias("mark")).groupBy("mark").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(h).alias(h) for h in HEADS]
    )
    counts = cut_lineage(counts.filter("n >= 5"))
    chosen_marks: dict[str, list[str]] = {}
    for h in HEADS:
        n1, n0 = sizes[h], sizes["n"] - sizes[h]
        if not n1 or not n0:
            chosen_marks[h], rates[h] = [], None
            continue
        p1 = (F.col(h) + 0.5) / F.lit(n1 + 1.0)
        p0 = (F.col("n") - F.col(h) + 0.5) / F.lit(n0 + 1.0)
        both = (F.col("n") + 1.0) / F.lit(sizes["n"] + 2.0)
        z = F.abs(p1 - p0) / F.sqrt(both * (F.lit(1.0) - both) * F.lit(1 / n1 + 1 / n0))
        least = F.when(F.col("mark").startswith(" "), F.lit(BIN_SIGNIFICANT)).otherwise(F.lit(SIGNIFICANT))
        best = counts.select("mark", z.alias("z")).filter(F.col("z") >= least)
        # All significant marks; the bounded sample bounds them.
        chosen_marks[h] = sorted(row["mark"] for row in best.collect())
    places = {mark: i for i, mark in enumerate(sorted({m for marks in chosen_marks.values() for m in marks}))}

    @F.pandas_udf("binary")
    def placed(marks: pd.Series) -> pd.Series:
        return pd.Series([np.array(sorted(places[m] for m in row if m in places), np.int32).tobytes() for row in marks], dtype=object)

    # The bounded sample, as places of its marks, packed so that the driver holds little.
    rows_ = seen.select(*HEADS, placed("marks").alias("at")).collect()
    at = [np.frombuffer(row["at"], np.int32) for row in rows_]
    model = Model({}, {}, rates)
    for h in HEADS:
        own = {places[m] for m in chosen_marks[h]}
        weights, bias = ({}, 0.0) if rates[h] is None else _regress(at, [row[h] for row in rows_], own)
        names = list(places)
        model.weights[h] = {names[i]: w for i, w in weights.items()}
        model.base[h] = bias - _odds(sizes[h] / sizes["n"]) if rates[h] is not None else 0.0
    discard(seen, counts)
    return model


def _regress(at: Sequence[Sequence[int]], outcomes: Sequence[int], own: set[int]) -> tuple[dict[int, float], float]:
    """Weights by place and bias of a ridge logistic regression on 0/1 marks over the whole sample, settled."""
    kept = np.array(sorted(own), np.int32)
    places = np.concatenate([np.asarray(part, np.int32) for part in at]) if len(at) else np.zeros(0, np.int32)
    row = np.repeat(np.arange(len(at), dtype=np.int32), [len(part) for part in at])
    mine = np.isin(places, kept)
    row, col = row[mine], np.searchsorted(kept, places[mine]).astype(np.int32)
    y = np.asarray(outcomes, float)
    start = np.zeros(len(kept) + 1)
    start[-1] = _odds(y.mean())
    w = descend(lambda w: logistic_loss(w, row, col, y), start, SETTLED)
    return {int(place): float(w[i]) for i, place in enumerate(kept)}, float(w[-1])


def logistic_loss(w: np.ndarray, row: np.ndarray, col: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean penalised loss of weights and bias, and its gradient; (row, col) are the marks held."""
    n, width = len(y), len(w) - 1
    odds = w[-1] + np.bincount(row, w[col], n)
    loss = np.logaddexp(0, odds).sum() - y @ odds + 0.5 * RIDGE * w[:-1] @ w[:-1]
    miss = np.exp(-np.logaddexp(0, -odds)) - y
    slope = np.append(np.bincount(col, miss[row], width) + RIDGE * w[:-1], miss.sum())
    return loss / n, slope / n


def evidence(docs: DataFrame, model: Model, keep: Sequence[str] | None, text_column: str = "text", **keys: Column) -> DataFrame:
    """(doc, the keys, one evidence per head)."""
    weights, base = model.weights, model.base

    @F.pandas_udf(", ".join(f"{h} double" for h in HEADS))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = []
            for text in texts:
                marks = marks_of(text)
                sums = [base[h] + math.fsum(map(weights[h].get, filter(weights[h].__contains__, marks))) for h in HEADS]
                found.append([max(-DOC_BOUND, min(DOC_BOUND, s)) for s in sums])
            yield pd.DataFrame(found, columns=list(HEADS), dtype="float64")

    # Called not deterministic, so that a filter on the verdict does not make Spark score every text twice.
    score = score.asNondeterministic()
    rows = docs.select(
        whole_row(docs, keep).alias("doc"), *[c.alias(name) for name, c in keys.items()],
        score(F.coalesce(named(text_column), F.lit(""))).alias("e"),
    )
    return rows.select("doc", *keys, *[F.col(f"e.{h}").alias(f"e_{h}") for h in HEADS])


def _odds(p: float) -> float:
    return math.log(p / (1 - p))


def _strength(excess: float, units: float, freedom: float) -> float:
    """Prior strength from the moments: ``excess`` is the spread beyond chance in units of one shared deviation."""
    rho = excess / units if units > 0 else 0.0
    rho = min(0.999, max(1e-6, rho))
    return (1 - rho) / rho if freedom > 0 else 1e6


def site_posteriors(counted: DataFrame, model: Model) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """(host, path, counts of the path and its host) and, for each head, the strengths of both priors.

    ``counted``: host, path, weight, and the weighted outcomes w_poor, w_toxic.
    """
    paths = cut_lineage(counted.groupBy("host", "path").agg(F.sum("weight").alias("n"), *[F.sum(f"w_{h}").alias(f"k_{h}") for h in HEADS]))
    hosts = paths.groupBy("host").agg(
        F.sum("n").alias("host_n"), F.count(F.lit(1)).alias("host_paths"), F.sum(F.col("n") * F.col("n")).alias("host_squares"),
        *[F.sum(f"k_{h}").alias(f"host_k_{h}") for h in HEADS],
    )
    hosts = cut_lineage(hosts)
    sites = cut_lineage(paths.alias("p").join(hosts.alias("h"), same("p", "h", ["host"])).drop(F.col("h.host")))
    strengths = {}
    for h in HEADS:
        p0 = model.rates[h]
        if p0 is None:
            strengths[h] = (1.0, 1.0)
            continue
        rate = F.col(f"host_k_{h}") / F.col("host_n")
        top = hosts.filter("host_n > 0").agg(
            F.sum(F.col("host_n") * (rate - p0) * (rate - p0)).alias("s"), F.count(F.lit(1)).alias("m"), F.sum("host_n").alias("n"),
            F.sum(F.col("host_n") * F.col("host_n")).alias("q"),
        ).first()
        m, n = top["m"] or 0, top["n"] or 0.0
        units = n - (top["q"] or 0) / n - (m - 1) if n else 0.0
        first = _strength((top["s"] or 0) / (p0 * (1 - p0)) - (m - 1), units, m - 1)
        shrunk = (F.col(f"host_k_{h}") + first * p0) / (F.col("host_n") + first)
        own = F.col(f"k_{h}") / F.col("n")
        low = sites.filter("n > 0").agg(
            F.sum(F.col("n") * (own - rate) * (own - rate) / (shrunk * (F.lit(1.0) - shrunk))).alias("s"),
            F.sum(F.lit(1.0) - F.lit(1.0) / F.col("host_paths")).alias("d"),
            F.sum(F.col("n") - F.col("host_squares") / F.col("host_n") / F.col("host_paths")).alias("u"),
        ).first()
        freedom = low["d"] or 0.0
        strengths[h] = (first, _strength((low["s"] or 0) - freedom, (low["u"] or 0) - freedom, freedom))
    return sites, strengths


def classify(
    docs: DataFrame, labels: DataFrame, keep: Sequence[str] | None = None, narrow: bool = False, id_column: str = "doc_id",
    text_column: str = "text", host: Column | None = None, path: Column | None = None, rows: int = FIT_ROWS,
) -> DataFrame:
    """(doc, host, path, evidence, site and posterior of each head, kept) for every document.

    ``narrow`` writes the evidence of the kept columns once.  Without it the evidence is
    computed again when the verdict is read, so that no text is written or shuffled.
    """
    small_batches(docs.sparkSession)
    host = named("source") if host is None else host
    path = named("lang") if path is None else path
    model = fit(docs, labels, id_column, text_column, rows)
    found = evidence(docs, model, keep, text_column, id=named(id_column).cast("long"), host=host, path=path)
    if narrow:
        found = cut_lineage(found)
    known = label_table(labels)
    narrow_rows = found.select("id", "host", "path", *[f"e_{h}" for h in HEADS])
    labelled = narrow_rows.join(known, "id", "left")
    weight = F.when(F.col("poor").isNotNull(), F.lit(1.0)).otherwise(F.lit(SOFT))
    outcomes = []
    for h in HEADS:
        rate = model.rates[h]
        soft = F.lit(0.0) if rate is None else F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col(f"e_{h}") + F.lit(_odds(rate)))))
        outcomes.append((F.coalesce(F.col(h).cast("double"), soft) * weight).alias(f"w_{h}"))
    sites, strengths = site_posteriors(labelled.select("host", "path", weight.alias("weight"), *outcomes), model)
    sites = sites.select("host", "path", "n", "host_n", *[f"k_{h}" for h in HEADS], *[f"host_k_{h}" for h in HEADS])
    rowsets = found.alias("f").join(sites.alias("s"), same("f", "s", ["host", "path"]), "left")
    columns = []
    for h in HEADS:
        rate = model.rates[h]
        if rate is None:
            columns += [F.lit(0.0).alias(f"site_{h}"), F.lit(0.0).alias(f"p_{h}")]
            continue
        first, second = strengths[h]
        host_rate = (F.col(f"s.host_k_{h}") + F.lit(first * rate)) / (F.col("s.host_n") + F.lit(first))
        site = (F.col(f"s.k_{h}") + F.lit(second) * host_rate) / (F.col("s.n") + F.lit(second))
        site = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), site))
        odds = F.col(f"f.e_{h}") + logit(site)
        columns += [site.alias(f"site_{h}"), (F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))).alias(f"p_{h}")]
    judged = rowsets.select("f.doc", "f.host", "f.path", *[F.col(f"f.e_{h}") for h in HEADS], *columns)
    return judged.withColumn("kept", (F.col("p_poor") < CUT) & (F.col("p_toxic") < CUT))
