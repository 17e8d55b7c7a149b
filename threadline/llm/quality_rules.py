"""Quality rules with risk-controlled thresholds.

Simple measures of a text (symbols, repeated lines, repeated words, word lengths) get
cutoffs per stratum.  One path of joint cutoffs, each stricter than the one before, is
laid on a fold of the labelled documents (``FOLD`` of them, by a hash of the id): the next
step tightens the measure that catches most poor documents for each good one it costs.
The other labelled documents are the hold-out.  In every stratum an exact binomial test
of each step shows, at the given level, whether fewer than ``RISK`` of the good documents
lie beyond any of its cutoffs; the tests run along the path and stop at the first that
fails, which needs no correction, since the path does not depend on the hold-out.  The
level is divided by the number of strata (Bonferroni).  So with probability 1 - ``LEVEL``
no stratum loses more than ``RISK`` of its good documents to the cutoffs.  At four strata
217 good documents of the hold-out, none of them lost, are enough for a step.

Defined results
---------------
* A null text has no words and no lines; it fails the base rules.
* A document is good if its labels say quality 1 and toxic 0; null labels are no labels;
  documents with labels that disagree count by the worst.
* A stratum without enough labelled documents gets no cutoff and loses none.  A null
  stratum is one of its own.  Without a poor document in the fold there is no path.
* Repeated rows are measured one by one.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadline.llm.common import BLANKS, named, same, small_batches, whole_row
from threadline.session import cut_lineage

RISK = 0.02
LEVEL = 0.05
#: One labelled document in so many lays the path, the others test it.
FOLD = 5
WINDOW = 3
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"

#: Candidate cutoffs of each measure, the most lenient first; a document beyond the cutoff is rejected.
CUTOFFS = {
    "symbol_share": [1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02],
    "dup_line_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
    "repeat_share": [0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1],
    "word_length": [100.0, 60.0, 40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0, 11.0, 10.0],
    "shortness": [1.0, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3],
}

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def text_counts(text: str) -> tuple[int, int, int, int, int, int]:
    """Words, their characters, symbols, lines with a word, repeats of earlier lines, words in repeated windows."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    n_chars = len(text) - sum(map(text.count, BLANKS))
    lines = [line for line in raw.split(b"\n") if line.split()] if b"\n" in raw else ([raw] if words else [])
    windows = list(zip(words, words[1:], words[2:]))  # noqa: B905
    seen = Counter(windows)
    covered = 0
    if len(seen) < len(windows):
        reach = 0  # words before this place are counted
        for i, window in enumerate(windows):
            if seen[window] > 1:
                covered += i + WINDOW - max(i, reach)
                reach = i + WINDOW
    return n, n_chars, sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), covered


@F.pandas_udf(T.StructType([T.StructField(name, T.LongType()) for name in COUNTS]))
def _counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([text_counts(text) for text in texts], columns=COUNTS, dtype="int64")


# Called not deterministic, so that a filter on the counts does not make Spark count every text twice.
_counts = _counts.asNondeterministic()


def counted(docs: DataFrame, keep: Sequence[str] | None = None, text_column: str = "text") -> DataFrame:
    """(doc, the counts, base_failed)."""
    rows = docs.select(whole_row(docs, keep).alias("doc"), _counts(F.coalesce(named(text_column), F.lit(""))).alias("c"))
    rows = rows.select("doc", "c.*")
    return rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def measures() -> dict[str, Column]:
    """The measures by name; larger is worse, 0 where there is nothing to measure."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "word_length": share("word_chars", "n_words"),
        "shortness": share("n_words", "word_chars"),
    }


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), summed exactly in logarithms."""
    if k >= n:
        return 1.0
    log_p, log_q = math.log(p), math.log1p(-p)
    top = math.lgamma(n + 1)
    parts = [top - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * log_p + (n - i) * log_q for i in range(k + 1)]
    high = max(parts)
    return min(1.0, math.exp(high) * math.fsum(math.exp(x - high) for x in parts))


def strictness() -> list[Column]:
    """For each measure the number of cutoffs, from the most lenient on, that a document stays within."""
    within = lambda value, cuts: sum(((value <= c).cast("int") for c in cuts), F.lit(0))
    return [within(value, CUTOFFS[name]).alias(name) for name, value in measures().items()]


def lay_path(rows: Sequence[tuple[Sequence[int], int, int]], risk: float) -> list[dict[str, float]]:
    """Joint cutoffs, step by step stricter, from (cutoffs stayed within, poor, good) counts of the fold.

    A step tightens one measure to the cutoff that catches most poor documents for each
    good one, to the middle one of cutoffs that do alike; steps end when none catches any,
    or good losses pass twice the risk.
    """
    names, sizes = list(CUTOFFS), [len(cuts) for cuts in CUTOFFS.values()]
    stays = np.array([row[0] for row in rows], np.int64).reshape(-1, len(names))
    poor, good = (np.array([row[i] for row in rows], np.int64) for i in (1, 2))
    notch, caught, path = [0] * len(names), np.zeros(len(rows), bool), []
    while True:
        best = None
        for m, size in enumerate(sizes):
            alike: dict[tuple[int, int], list[int]] = {}
            for j in range(notch[m] + 1, size + 1):
                fresh = ~caught & (stays[:, m] < j)
                alike.setdefault((int(poor[fresh].sum()), int(good[fresh].sum())), []).append(j)
            for (gain, loss), notches in alike.items():
                worth = (gain / (loss + 0.5), gain, -m)
                if gain and (best is None or worth > best[0]):
                    best = worth, m, notches[len(notches) // 2]
        if best is None:
            return path
        _, m, j = best
        fresh = ~caught & (stays[:, m] < j)
        notch[m], caught = j, caught | fresh
        if good[caught].sum() > 2 * risk * good.sum():
            return path
        path.append({name: CUTOFFS[name][n - 1] for name, n in zip(names, notch, strict=True) if n})


def steps_taken(path: Sequence[dict[str, float]]) -> Column:
    """Number of the first step of the path that a document lies beyond; the length of the path if none."""
    first = []
    for name, value in measures().items():
        step = F.lit(len(path))
        for i in range(len(path) - 1, -1, -1):
            if name in path[i]:
                step = F.when(value > path[i][name], F.lit(i)).otherwise(step)
        first.append(step)
    return F.least(*first)


def _passed(groups: Iterator[pd.DataFrame], risk: float, level: float) -> Iterator[pd.DataFrame]:
    for group in groups:
        passed = []
        for n, beyond in zip(group["n"], group["beyond"], strict=True):
            steps = 0
            # More than risk * n losses can never pass, and the sum stays short.
            while steps < len(beyond) and beyond[steps] <= risk * n and binomial_tail(int(beyond[steps]), int(n), risk) <= level:
                steps += 1
            passed.append(steps)
        yield group.assign(steps=pd.Series(passed, index=group.index, dtype="int64"))[["stratum", "n", "steps"]]


def fit_cutoffs(known: DataFrame, risk: float = RISK, level: float = LEVEL) -> tuple[list[dict[str, float]], DataFrame]:
    """The path, and (stratum, n, steps): how many of its steps each stratum may take.

    ``known``: labelled documents that pass the base rules, with id, stratum, counts and ``good``.
    """
    marked = known.select("stratum", "good", (F.pmod(F.xxhash64("id"), F.lit(FOLD)) == 0).alias("fold"), *strictness(), *COUNTS)
    marked = cut_lineage(marked)
    # At most one row for each combination of cutoffs.
    fold = marked.filter("fold").groupBy(*CUTOFFS).agg(F.count_if(~F.col("good")).alias("poor"), F.count_if("good").alias("n_good")).collect()
    path = lay_path([([row[name] for name in CUTOFFS], row["poor"], row["n_good"]) for row in fold], risk)
    test = marked.filter("good and not fold")
    at = test.select("stratum", (steps_taken(path) if path else F.lit(0)).alias("first"))
    beyond = F.array(*[F.count_if(F.col("first") <= i) for i in range(len(path))]) if path else F.array().cast("array<long>")
    table = cut_lineage(at.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), beyond.alias("beyond")))
    part = level / max(1, table.count())
    return path, table.mapInPandas(lambda groups: _passed(groups, risk, part), "stratum string, n long, steps long")


def label_table(labels: DataFrame) -> DataFrame:
    """(id, quality, toxic): one row per labelled document, the worst label of each."""
    return labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("id")).agg(
        F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")
    )


def judge(
    docs: DataFrame, labels: DataFrame, keep: Sequence[str] | None = None, risk: float = RISK, level: float = LEVEL,
    id_column: str = "doc_id", stratum_column: str = "lang", text_column: str = "text", narrow: bool = False,
) -> DataFrame:
    """(doc, the counts, base_failed, cuts_failed, kept) for every document.

    ``narrow`` writes the counts of the kept columns once; without it, texts are carried
    along and measured again when the verdict is read, so that none is written twice.
    """
    small_batches(docs.sparkSession)
    columns = list(docs.columns if keep is None else keep)
    rows = docs.select(
        F.struct(*[named(c) for c in columns]).alias("doc"), named(id_column).alias("id"),
        named(stratum_column).cast("string").alias("stratum"), named(text_column).alias("text"),
    )
    measured = counted(rows, ["doc", "id", "stratum"]).select("doc.*", *COUNTS, "base_failed")
    if narrow:
        measured = cut_lineage(measured)
    known = measured.filter("not base_failed").join(label_table(labels), "id")
    path, strata = fit_cutoffs(known.withColumn("good", F.expr("quality = 1 and toxic = 0")), risk, level)
    columns = [F.when(F.col("steps") > 0, F.element_at(F.array(*[F.lit(step.get(name)).cast("double") for step in path]), F.col("steps").cast("int"))).alias(name)
               if path else F.lit(None).cast("double").alias(name) for name in CUTOFFS]
    table = cut_lineage(strata.select("stratum", *columns))
    joined = measured.alias("m").join(table.alias("c"), same("m", "c", ["stratum"]), "left")
    failed = F.filter(
        F.array(*[F.when(value > F.col(f"c.{name}"), F.lit(name)) for name, value in measures().items()]), lambda x: x.isNotNull()
    )
    judged = joined.select("m.doc", *[f"m.{name}" for name in COUNTS], "m.base_failed", failed.alias("cuts_failed"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("cuts_failed") == 0))
