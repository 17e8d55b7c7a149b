"""Toxicity by a factorization machine over hashed terms.

A document is the set of its distinct terms (words in lower case, without punctuation
around them), each hashed to one of ``2 ** BITS`` buckets.  Its odds are

    bias + sum w[i] + sum over pairs i < j of <v[i], v[j]>

so that two terms can weigh more, or less, together than apart: an insult beside the
mention of a group, or an insult inside a quotation.  The pair sum is taken in linear
time as half of (square of the sums less the sum of the squares) of each factor.

The machine is fitted on at most about ``FIT_ROWS`` labelled documents, chosen by a hash
of the id, with buckets that at least ``LEAST`` of them hold.  Terms whose rates do not differ
between the classes are held quietly, so that thousands of them in a long text do not
drown the few that speak.  Quasi-Newton steps go on until the loss settles.  Only the
machine travels to the workers, which score whole texts.

Rows whose crc32 of the id (as text) is 0 modulo ``FOLDS`` are held out: their labels are
never read.  Labels, ids, languages and sources are no inputs of a score.

Defined results
---------------
* A null text is empty.  A text without known terms scores what the bias alone gives.
* A label with a null id or null toxic is none; ids with labels that disagree count as toxic.
* Rows of a null id are never learnt from and not held out.  Of rows that repeat a labelled id one is learnt from.
* Without labels of both kinds every score is the share of toxic labels, 0 without labels.
* Repeated rows are scored one by one.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadline.llm.common import named, small_batches, whole_row
from threadline.llm.descent import descend

#: Expected number of labelled documents the machine is fitted on.
FIT_ROWS = 10_000
#: Terms are hashed to 2 ** BITS buckets; a bucket counts if so many sampled documents hold it.
BITS, LEAST = 18, 5
#: Factors of a bucket, penalty of weights and of factors.
FACTORS, RIDGE = 4, 0.5
#: A bucket whose rates differ by so many standard errors counts in full, others in proportion, at least the second.
CLEAR, QUIET = 8.0, 0.02
#: The loss has settled when it falls by less than this share within five steps.
SETTLED = 0.01
FOLDS = 5

PUNCTUATION = ".,;:!?\"'()[]{}<>|#*$%&-_"


def buckets_of(text: str | None) -> np.ndarray:
    """Distinct buckets of a text's terms, ascending."""
    terms = {word.strip(PUNCTUATION).lower() for word in set((text or "").split())}
    terms.discard("")
    hashes = (zlib.crc32(term.encode("utf-8", "surrogatepass")) for term in terms)
    return np.unique(np.fromiter(hashes, np.int64, len(terms)) & ((1 << BITS) - 1))


@dataclass
class Machine:
    """Bias, and for each bucket the weight and the factors (one row each); unknown buckets are zero."""

    bias: float
    weights: np.ndarray

    def odds(self, buckets: np.ndarray) -> float:
        """Logarithmic odds of a document with these buckets."""
        held = self.weights[:, buckets].astype(np.float64)
        sums = held.sum(axis=1)
        return float(self.bias + sums[0] + 0.5 * (sums[1:] @ sums[1:] - (held[1:] ** 2).sum()))


@F.pandas_udf(T.BinaryType())
def _buckets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([buckets_of(text).astype(np.int32).tobytes() for text in texts], dtype=object)


def held_out(ident: Column, folds: int = FOLDS) -> Column:
    """Whether the labels of these ids are kept out of learning."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % folds == 0, F.lit(False))


def learnable(labels: DataFrame) -> DataFrame:
    """(id, toxic) of every labelled id that is not held out."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    return known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", rows: int = FIT_ROWS) -> Machine:
    """The machine, from a bounded sample of the labelled documents."""
    known = learnable(labels)
    total = known.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k")).first()
    n, k = total["n"], total["k"] or 0
    if not 0 < k < n:
        rate = k / n if n else 0.0
        return Machine(math.inf if rate == 1 else -math.inf, np.zeros((1 + FACTORS, 1 << BITS), np.float32))
    share = min(1.0, rows / n)
    chosen = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 20)) < math.ceil(share * (1 << 20))
    ident = named(id_column).cast("long")
    sample = docs.select(ident.alias("id"), F.coalesce(named(text_column), F.lit("")).alias("text")).filter(chosen(F.col("id")))
    # The chosen labels are some ``rows`` narrow rows whatever the input, so every task may hold them; no text is shuffled.
    sample = sample.join(F.broadcast(known.filter(chosen(F.col("id")))), "id").select("id", "toxic", _buckets("text").alias("held"))
    sample = sample.groupBy("id").agg(F.first("toxic").alias("toxic"), F.min("held").alias("held"))
    # The bounded sample: ids of buckets only.
    drawn = sorted(sample.select("id", "toxic", "held").collect(), key=lambda row: row["id"])
    outcomes = np.array([row["toxic"] for row in drawn], np.float64)
    if not 0 < outcomes.sum() < len(outcomes):
        odds = math.log(k / (n - k))
        return Machine(odds, np.zeros((1 + FACTORS, 1 << BITS), np.float32))
    return learn([np.frombuffer(row["held"], np.int32) for row in drawn], outcomes)


def learn(held: Sequence[np.ndarray], outcomes: np.ndarray, least: int = LEAST) -> Machine:
    """Fit to the whole sample until the penalised loss settles."""
    n, outcomes = len(held), np.asarray(outcomes, np.float64)
    row = np.repeat(np.arange(n), [len(part) for part in held])
    bucket = np.concatenate(held) if n else np.zeros(0, np.int64)
    frequent = np.flatnonzero(np.bincount(bucket, minlength=1 << BITS) >= least)
    place = np.full(1 << BITS, -1)
    place[frequent] = np.arange(len(frequent))
    known = place[bucket] >= 0
    row, column, width = row[known], place[bucket[known]], len(frequent)
    loudness = louder(row, column, outcomes, width)
    start = np.random.default_rng(42).normal(0, 0.01, (1 + FACTORS, width))
    start[0] = 0
    start = np.append(start.ravel(), math.log(outcomes.mean() / (1 - outcomes.mean())))
    theta = descend(lambda at: loss_and_slope(at, row, column, outcomes, loudness), start, SETTLED)
    weights = np.zeros((1 + FACTORS, 1 << BITS), np.float32)
    weights[:, frequent] = theta[:-1].reshape(1 + FACTORS, width) * loudness
    return Machine(float(theta[-1]), weights)


def louder(row: np.ndarray, column: np.ndarray, outcomes: np.ndarray, width: int) -> np.ndarray:
    """Value of each term where it is held: 1 if its rates differ by ``CLEAR`` standard errors, down to ``QUIET``."""
    n, n1 = len(outcomes), outcomes.sum()
    seen, hits = np.bincount(column, minlength=width), np.bincount(column, outcomes[row], width)
    spread = (seen + 1) / (n + 2) * (1 - (seen + 1) / (n + 2)) * (1 / n1 + 1 / (n - n1))
    apart = np.abs((hits + 0.5) / (n1 + 1) - (seen - hits + 0.5) / (n - n1 + 1)) / np.sqrt(spread)
    return np.clip(apart / CLEAR, QUIET, 1.0)


def loss_and_slope(
    theta: np.ndarray, row: np.ndarray, column: np.ndarray, outcomes: np.ndarray, loudness: np.ndarray
) -> tuple[float, np.ndarray]:
    """Mean penalised loss and its gradient; ``theta`` holds weights, factors and bias, (row, column) the terms held."""
    n, width = len(outcomes), len(loudness)
    raw, bias = theta[:-1].reshape(1 + FACTORS, width), theta[-1]
    weights = raw * loudness
    odds = bias + np.bincount(row, weights[0][column], n)
    sums = [np.bincount(row, factor[column], n) for factor in weights[1:]]
    for total, factor in zip(sums, weights[1:], strict=True):
        odds += 0.5 * (total**2 - np.bincount(row, (factor**2)[column], n))
    loss = np.logaddexp(0, odds).sum() - outcomes @ odds + 0.5 * RIDGE * (raw**2).sum()
    miss = np.exp(-np.logaddexp(0, -odds)) - outcomes
    slope = np.empty_like(weights)
    own = np.bincount(column, miss[row], width)
    slope[0] = own * loudness + RIDGE * raw[0]
    for i, (total, factor) in enumerate(zip(sums, weights[1:], strict=True), 1):
        slope[i] = (np.bincount(column, (miss * total)[row], width) - factor * own) * loudness + RIDGE * raw[i]
    return loss / n, np.append(slope.ravel(), miss.sum()) / n


def score(docs: DataFrame, machine: Machine, keep: Sequence[str] | None = None, text_column: str = "text", **keys: Column) -> DataFrame:
    """(doc, the keys, score) for every row; ``keep`` names the columns of ``doc``, all by default."""

    @F.pandas_udf(T.DoubleType())
    def likelihood(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            odds = np.array([machine.odds(buckets_of(text)) for text in texts], np.float64)
            yield pd.Series(np.exp(-np.logaddexp(0, -odds)), dtype="float64")

    # Called not deterministic, so that a filter on the score does not make Spark score every text twice.
    likelihood = likelihood.asNondeterministic()
    return docs.select(
        whole_row(docs, keep).alias("doc"), *[c.alias(name) for name, c in keys.items()],
        likelihood(F.coalesce(named(text_column), F.lit(""))).alias("score"),
    )


def judge(
    docs: DataFrame, labels: DataFrame, keep: Sequence[str] | None = None, id_column: str = "doc_id", text_column: str = "text",
    cut: float = 0.5, rows: int = FIT_ROWS,
) -> DataFrame:
    """(doc, held_out, score, predicted) for every document, learnt from the labels that are not held out."""
    small_batches(docs.sparkSession)
    machine = fit(docs, labels, id_column, text_column, rows)
    scored = score(docs, machine, keep, text_column, held_out=held_out(named(id_column)))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))
