"""Grouping of spelling variants: k-d trees over letter counts find words one edit apart.

One inserted or deleted letter changes one count by one, a replaced one changes two, so
words one edit apart have letter counts at L1 distance 1 (lengths differ by one) or at
most 2 (equal lengths).  For every pair of lengths (L, L) and (L, L + 1) a word of length
L asks a k-d tree over the counts of the other length for all vectors within that
distance; boxes farther away are pruned.  What is left is checked letter by letter.

The tree has two parts.  Its top, over length and counts, is drawn from a bounded sample
of the words (``SAMPLE`` expected) and travels to all workers; its leaves deal the work.
Every word is indexed in its own leaf and asks every leaf whose box it can reach.  A leaf
may hold any number of words, for instance anagrams, which no box can separate: index
and questions of a large leaf are dealt to parts by hash, and each part of the index
meets each part of the questions.  Inside such a meeting the tree goes on down to
``TWIG`` words, and all questions descend together.

Letters are folded into ``AXES`` axes (a to z, and a few shared ones), which can only
shorten distances, so no pair is lost.

Defined results
---------------
* A null text has no words; a null id is written as nothing when words are damaged.
* Repeated documents count each.  An empty table gives an empty result.
* A word's form is the near word of largest count, if ``RATIO`` times as frequent; ties
  go to the smallest in code-point order.  The root follows forms to the last one.
* Words whose code points all lie below U+0100 are compared as bytes; others are refused by ``group_variants``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadline.llm.common import named
from threadline.session import cut_lineage, discard

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in so many loses a letter.
DAMAGE = 199
#: Words have so many letters and occurrences at least; a form is so many times as frequent.
LETTERS, OCCURRENCES, RATIO = 6, 5, 5
AXES = 32
#: Expected words the top of the tree is drawn from; words a leaf of it should hold; words at the bottom.
SAMPLE, LEAF, TWIG = 50_000, 4_096, 48
#: Most words of one part of an index and questions of one part.
INDEX_PART, QUESTION_PART = 8_192, 65_536


def runs(text: Column) -> Column:
    """Letter runs of a text, A to Z in lower case."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(RUN), F.lit(0))


def damaged(ident: Column, run: Column, one_in: int = DAMAGE) -> Column:
    """The run, without one of its letters if the hash of ``<id>:<run>`` says so."""
    key = F.concat(F.coalesce(ident.cast("string"), F.lit("")), F.lit(":"), run)
    hashed = F.crc32(key.cast("binary"))
    place = (hashed % F.length(run)).cast("int")
    without = F.concat(F.substring(run, F.lit(1), place), F.substring(run, place + 2, F.length(run)))
    return F.when(hashed % one_in == 0, without).otherwise(run)


def damaged_words(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", one_in: int = DAMAGE) -> DataFrame:
    """(word, n): distinct words long and frequent enough, with their occurrences in all texts."""
    found = docs.select(named(id_column).alias("id"), F.explode(runs(named(text_column))).alias("run"))
    words = found.filter(F.length("run") >= LETTERS).select(damaged(F.col("id"), F.col("run"), one_in).alias("word"))
    return words.filter(F.length("word") >= LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= OCCURRENCES)


def counts_of(words: list[bytes]) -> np.ndarray:
    """One row of AXES + 1 numbers for each word: folded letter counts and the length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    axis = np.where((letters >= 97) & (letters <= 122), letters - 97, 26 + letters % (AXES - 26))
    at = np.repeat(np.arange(len(words)), lengths) * AXES + axis
    found = np.bincount(at, minlength=len(words) * AXES).reshape(len(words), AXES)
    return np.column_stack([found, lengths])


def _cut(points: np.ndarray) -> tuple[int, int] | None:
    """(axis, value) of a split into counts <= value and the rest, as even as any axis allows; none if all are equal."""
    best, found = None, None
    spread = np.flatnonzero(points.max(axis=0) > points.min(axis=0))
    for axis in spread:
        column = points[:, axis]
        middle = np.partition(column, len(column) // 2)[len(column) // 2]
        for value in (middle, middle - 1):
            lower = int((column <= value).sum())
            if 0 < lower < len(points) and (best is None or abs(2 * lower - len(points)) < best):
                best, found = abs(2 * lower - len(points)), (int(axis), int(value))
    return found


class Top:
    """The upper tree as a list of (axis, value, left, right), or (-1, leaf, 0, 0)."""

    def __init__(self, points: np.ndarray, least: float) -> None:
        self.nodes: list[tuple[int, int, int, int]] = []
        self.leaves = 0
        self._grow(points, least)

    def _grow(self, points: np.ndarray, least: float) -> int:
        place = len(self.nodes)
        self.nodes.append((-1, 0, 0, 0))
        cut = _cut(points) if len(points) > max(16, least) else None
        if cut is None:
            self.nodes[place] = (-1, self.leaves, 0, 0)
            self.leaves += 1
        else:
            lower = points[:, cut[0]] <= cut[1]
            left = self._grow(points[lower], least)
            self.nodes[place] = (*cut, left, self._grow(points[~lower], least))
        return place

    def home(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        found = np.zeros(len(points), np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            axis, value, left, right = self.nodes[node]
            if axis < 0:
                found[at] = value
            elif len(at):
                lower = points[at, axis] <= value
                todo += [(left, at[lower]), (right, at[~lower])]
        return found

    def reach(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, leaf) for every leaf with room for a word of the same or the next length one edit away."""
        n, width = points.shape
        question = np.concatenate([np.arange(n), np.arange(n)])
        centre = np.concatenate([points, points])
        centre[n:, -1] += 1  # the next length
        left_over = np.repeat([2, 1], n)
        # How far the box passed so far lies from the question on each axis.
        todo = [(0, np.arange(2 * n), np.zeros((2 * n, width), np.int8), np.zeros(2 * n, np.int8))]
        asked, leaves = [], []
        while todo:
            node, at, gaps, total = todo.pop()
            axis, value, left, right = self.nodes[node]
            if axis < 0:
                asked.append(question[at])
                leaves.append(np.full(len(at), value))
                continue
            c = centre[at, axis]
            for child, gap in ((left, c - value), (right, value + 1 - c)):
                gap = np.maximum(gaps[:, axis], np.clip(gap, 0, 4).astype(np.int8))
                # A box of other lengths is out of reach.
                farther = total - gaps[:, axis] + (gap if axis < width - 1 else 4 * gap)
                fits = farther <= left_over[at]
                if fits.any():
                    kept = gaps[fits]
                    kept[:, axis] = gap[fits]
                    todo.append((child, at[fits], kept, farther[fits]))
        pairs = np.unique(np.column_stack([np.concatenate(asked), np.concatenate(leaves)]), axis=0) if asked else np.zeros((0, 2), np.int64)
        return pairs[:, 0], pairs[:, 1]


def _bits(counts: np.ndarray) -> np.ndarray:
    """Two bits an axis, for at least one and at least two letters: they differ in no more places than the L1 distance."""
    shifts = np.arange(AXES, dtype=np.uint64)
    once = ((counts[:, :AXES] >= 1).astype(np.uint64) << shifts).sum(axis=1, dtype=np.uint64)
    twice = ((counts[:, :AXES] >= 2).astype(np.uint64) << shifts).sum(axis=1, dtype=np.uint64)
    return once | (twice << np.uint64(AXES))


def _letters(words: list[bytes], length: int) -> np.ndarray:
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), length)


def one_edit(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which rows are one edit apart; the right ones are as long as the left ones or longer by one."""
    if left.shape[1] == right.shape[1]:
        return (left != right).sum(axis=1) == 1
    front = np.logical_and.accumulate(left == right[:, :-1], axis=1).sum(axis=1)
    back = np.logical_and.accumulate((left == right[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return front + back >= left.shape[1]


def pairs_within(index: list[bytes], questions: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(question, index) places of words one edit apart where the index word is as long, or longer by one."""
    index_counts, question_counts = counts_of(index), counts_of(questions)
    index_bits, question_bits = _bits(index_counts), _bits(question_counts)
    for length in np.unique(question_counts[:, -1]):
        asked = np.flatnonzero(question_counts[:, -1] == length)
        asked_letters = _letters([questions[i] for i in asked], int(length))
        for other, radius in ((length, 2), (length + 1, 1)):
            held = np.flatnonzero(index_counts[:, -1] == other)
            if not len(held):
                continue
            held_letters = _letters([index[i] for i in held], int(other))
            centre, points = question_counts[asked, :AXES], index_counts[held, :AXES]
            nothing = np.zeros((len(asked), AXES), np.int8)
            todo = [(np.arange(len(held)), np.arange(len(asked)), nothing, nothing[:, 0])]
            while todo:
                at, who, gaps, total = todo.pop()
                cut = _cut(points[at]) if len(at) > TWIG else None
                if cut is not None:
                    axis, value = cut
                    lower = points[at, axis] <= value
                    c = centre[who, axis]
                    for side, gap in ((lower, c - value), (~lower, value + 1 - c)):
                        gap = np.maximum(gaps[:, axis], np.clip(gap, 0, 4).astype(np.int8))
                        farther = total - gaps[:, axis] + gap
                        fits = farther <= radius
                        if fits.any():
                            kept = gaps[fits]
                            kept[:, axis] = gap[fits]
                            todo.append((at[side], who[fits], kept, farther[fits]))
                    continue
                step = max(1, (1 << 20) // max(1, len(at)))
                for i in range(0, len(who), step):
                    part = who[i : i + step]
                    apart = np.bitwise_count(question_bits[asked[part], None] ^ index_bits[held[at]][None, :])
                    q, p = np.nonzero(apart <= radius)
                    q, p = part[q], at[p]
                    right = one_edit(asked_letters[q], held_letters[p])
                    yield asked[q[right]], held[p[right]]


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n) both ways for all pairs of words one edit apart."""
    n_words = words.count()
    share = min(1.0, SAMPLE / max(1, n_words))
    drawn = words.filter(F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < F.lit(int(np.ceil(share * (1 << 20))))).select("word")
    # The bounded sample draws the top of the tree, nothing else.
    sample = sorted(row["word"].encode("latin-1") for row in drawn.collect())
    top = Top(counts_of(sample), LEAF * share)

    @F.pandas_udf("struct<home: long, asks: array<long>>")
    def dealt(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points = counts_of([word.encode("latin-1") for word in batch])
            question, leaf = top.reach(points)
            asks = np.split(leaf, np.searchsorted(question, np.arange(1, len(batch)))) if len(batch) else []
            yield pd.DataFrame({"home": top.home(points), "asks": asks})

    placed = cut_lineage(words.select("word", "n", dealt("word").alias("at")).select("word", "n", "at.home", "at.asks"))
    index = placed.select(F.col("home").alias("leaf"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    questions = placed.select(F.explode("asks").alias("leaf"), "word", "n")
    part = lambda most: F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / most)).cast("int")
    held = index.groupBy("leaf").agg(part(INDEX_PART).alias("i_parts"))
    asked = questions.groupBy("leaf").agg(part(QUESTION_PART).alias("q_parts"))
    sizes = cut_lineage(held.join(asked, "leaf"))
    own = lambda word, parts: F.pmod(F.xxhash64(word), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    left = index.join(sizes, "leaf").select("leaf", own("near", "i_parts").alias("i"), every("q_parts").alias("q"), "near", "near_n")
    right = questions.join(sizes, "leaf").select("leaf", every("i_parts").alias("i"), own("word", "q_parts").alias("q"), "word", "n")

    def search(key: tuple, held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(asked):
            return pd.DataFrame({name: [] for name in ("word", "n", "near", "near_n")})
        index_words, question_words = ([w.encode("latin-1") for w in words] for words in (held["near"], asked["word"]))
        found = list(pairs_within(index_words, question_words))
        q, p = (np.concatenate([pair[i] for pair in found] or [np.zeros(0, np.int64)]) for i in (0, 1))
        ends = [asked[["word", "n"]].iloc[q], held[["near", "near_n"]].iloc[p]]
        return pd.concat([end.reset_index(drop=True) for end in ends], axis=1)

    keys = ["leaf", "i", "q"]
    schema = "word string, n long, near string, near_n long"
    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, schema)
    # Equal lengths are found from both ends; one of them is kept.
    once = pairs.filter((F.length("word") < F.length("near")) | (F.col("word") < F.col("near")))
    back = once.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return once.unionByName(back)


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every row of (word, n)."""
    words = cut_lineage(words.select("word", F.col("n").cast("long").alias("n")))
    both = near_pairs(words)
    best = F.min(F.struct((-F.col("near_n")).alias("k"), F.col("near").alias("near")))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    form = F.when(-F.col("best.k") >= ratio * F.col("n"), F.col("best.near"))
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"),
        F.when(form.isNotNull(), -F.col("best.k")).alias("form_n"),
    )
    found = cut_lineage(found)
    roots = last_forms(found.filter("form is not null").select("word", F.col("form").alias("root")))
    return found.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def last_forms(steps: DataFrame) -> DataFrame:
    """(word, root) where every word's step is followed to the end; reach doubles with each round."""
    state = cut_lineage(steps.withColumn("moved", F.lit(True)))
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = state.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        before, state = state, cut_lineage(further)
        discard(before)
        if state.filter("moved").isEmpty():
            return state.select("word", "root")
