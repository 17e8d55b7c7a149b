"""Best-fit packing of token sequences with exact-complement hashing.

Only the histogram of piece lengths decides how lengths are combined, and it has at
most as many entries as a sequence has places, whatever the input.  From the longest
length down, the gap beside a piece is filled exactly: by a single piece, a pair or a
triple whose lengths sum to it, found in an index of available lengths and pair sums
and consumed in bulk while all of them last; the most even pair or triple is taken, so
that short pieces, which fit anywhere, are spared.  What is left is packed best-fit
decreasing.  Where best fit lacks the short pieces that pairs and triples took, those
with the shortest pieces are released to it again (``plan_patterns``).  The plan gives
each length ranges of ranks; every piece then finds its sequence by its own rank, which
slices count in parallel.

Defined results
---------------
* A null text is empty: its ids are the end id alone, so it has one piece.
* A document longer than a sequence is cut so that only its first piece is shorter.
* Pieces of one length are interchangeable; repeated rows are packed one by one.
* An empty table gives an empty result.  Columns named by ``keep`` are carried.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadline.llm.common import named, same, small_batches, whole_row
from threadline.llm.tokens import encoder
from threadline.session import cut_lineage

CAPACITY = 1024
END_ID = 2
#: Shortest piece that a pair or triple may use, as shares of a sequence; each is tried.
SPARED = (0.0, 1 / 32, 1 / 16, 3 / 32, 1 / 8, 5 / 32, 3 / 16, 1 / 4)


def token_pieces(
    docs: DataFrame, path: str, keep: Sequence[str] | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
    text_column: str = "text",
) -> DataFrame:
    """(doc, piece, start, length, ids): documents as pieces of at most ``capacity`` ids, little-endian 32-bit."""
    small_batches(docs.sparkSession)
    end = end_id.to_bytes(4, "little")

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = encoder(path).encode
        for texts in batches:
            yield pd.Series([one(text) + end for text in texts], dtype=object)

    rows = docs.select(whole_row(docs, keep).alias("doc"), encode(F.coalesce(named(text_column), F.lit(""))).alias("ids"))
    rows = rows.withColumn("total", (F.octet_length("ids") / 4).cast("int"))
    # The first piece takes what whole sequences leave over.
    head = (F.col("total") - 1) % capacity + 1
    rows = rows.select("doc", "ids", head.alias("head"), F.explode(F.sequence(F.lit(0), ((F.col("total") - 1) / capacity).cast("int"))).alias("piece"))
    start = F.when(F.col("piece") == 0, F.lit(0)).otherwise(F.col("head") + (F.col("piece") - 1) * capacity)
    length = F.when(F.col("piece") == 0, F.col("head")).otherwise(F.lit(capacity))
    rows = rows.select("doc", "piece", start.alias("start"), length.alias("length"), "ids")
    cut = F.substring(F.col("ids"), F.col("start") * 4 + 1, F.col("length") * 4)
    return rows.select("doc", "piece", F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), cut.alias("ids"))


class Gaps:
    """Available lengths with their counts, and an index of the pairs that make a sum."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.left = {n: c for n, c in counts.items() if c > 0}
        self.capacity = capacity
        self.bits = sum(1 << n for n in self.left)
        #: The same bits from the other end: one shift lines every length up with its complement to a sum.
        self.turned = sum(1 << (capacity - n) for n in self.left)

    def use(self, lengths: Sequence[int], times: int) -> None:
        for n in lengths:
            self.left[n] -= times
            if not self.left[n]:
                del self.left[n]
                self.bits &= ~(1 << n)
                self.turned &= ~(1 << (self.capacity - n))

    def last(self, *lengths: int) -> int:
        """How often these lengths can be used together."""
        return min(self.left.get(n, 0) // k for n, k in Counter(lengths).items())

    def pairs(self, total: int) -> Iterator[tuple[int, int]]:
        """Available pairs with this sum, the most even one first."""
        half = (total + 1) // 2
        both = (self.bits & (self.turned >> (self.capacity - total))) >> half if total > 0 else 0
        while both:
            a = half + (both & -both).bit_length() - 1
            yield a, total - a
            both &= both - 1

    def exact(self, anchor: int, least: int) -> tuple[int, ...] | None:
        """Lengths that fill the gap beside ``anchor`` exactly: none, a single, a pair or a triple of at least ``least`` each."""
        gap = self.capacity - anchor
        if gap == 0:
            return ()
        if self.last(anchor, gap):
            return (gap,)
        for a, b in self.pairs(gap):
            if b >= least and self.last(anchor, a, b):
                return a, b
        third = -(-gap // 3)
        rest = (self.bits & ((1 << gap) - 1)) >> third
        while rest:
            a = third + (rest & -rest).bit_length() - 1
            rest &= rest - 1
            for b, c in self.pairs(gap - a):
                if c < least:
                    break
                if b <= a and self.last(anchor, a, b, c):
                    return a, b, c
        return None


Patterns = list[tuple[tuple[int, ...], int]]


def fill_exactly(counts: dict[int, int], capacity: int, least: int) -> Patterns:
    """Exact fills beside the longest pieces, by pairs and triples of pieces of at least ``least``."""
    gaps, patterns = Gaps(counts, capacity), []
    for n in sorted(gaps.left, reverse=True):
        while n in gaps.left and (found := gaps.exact(n, least)) is not None:
            times = gaps.last(n, *found)
            gaps.use((n, *found), times)
            patterns.append(((n, *found), times))
    return patterns


def plan_patterns(counts: dict[int, int], capacity: int = CAPACITY) -> Patterns:
    """[(lengths of one sequence, number of such sequences)] that use every piece of the histogram."""
    fixed, combined, residue = plan_parts(counts, capacity)
    return fixed + combined + residue


def plan_parts(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[Patterns, Patterns, Patterns]:
    """The plan's exact fills by at most a single, its exact fills by pairs and triples, and its best fits.

    Pairs and triples can take short pieces that best fit needs later.  So for several
    shortest pieces allowed (``SPARED``) the pairs and triples are laid in order of their
    shortest piece, and the last ones of them, by sixteenths, are released to best fit.
    Of the plans with fewest sequences the one with most pairs and triples is taken.
    """
    best, best_key = ([], [], []), None
    for share in SPARED:
        found = fill_exactly(counts, capacity, max(1, int(capacity * share)))
        fixed = [pattern for pattern in found if len(pattern[0]) < 3]
        combined = sorted((pattern for pattern in found if len(pattern[0]) > 2), key=lambda pattern: -min(pattern[0]))
        for sixteenths in range(16, -1, -1):
            kept = combined[: len(combined) * sixteenths // 16]
            left = Counter(counts)
            for lengths, times in fixed + kept:
                left.subtract({n: k * times for n, k in Counter(lengths).items()})
            parts = fixed, kept, best_fit(+left, capacity)
            key = (sum(times for part in parts for _, times in part), -sum(times for _, times in kept))
            if best_key is None or key < best_key:
                best, best_key = parts, key
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram; equal sequences are filled in bulk."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            gap = min((g for g, group in open_.items() if g >= n and group), default=None)
            if gap is None:
                each = capacity // n
                full, rest = divmod(left, each)
                if full:
                    open_[capacity - each * n].append(((n,) * each, full))
                if rest:
                    open_[capacity - rest * n].append(((n,) * rest, 1))
                break
            lengths, times = open_[gap].pop()
            used = min(times, left)
            if times > used:
                open_[gap].append((lengths, times - used))
            open_[gap - n].append(((*lengths, n), used))
            left -= used
    return [pattern for group in open_.values() for pattern in group]


def rank_ranges(patterns: Sequence[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, pieces per sequence, first sequence, offset in the sequence)."""
    ranges, used, sequence = [], defaultdict(int), 0
    for lengths, times in patterns:
        offset = 0
        for n, each in Counter(lengths).items():
            ranges.append((n, used[n], used[n] + each * times - 1, each, sequence, offset))
            used[n] += each * times
            offset += each * n
        sequence += times
    return ranges


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (any columns, among them ``length``) with ``sequence_id`` and ``offset``."""
    row = pieces.select(F.col("length"), whole_row(pieces).alias("row")).sortWithinPartitions("length")
    placed = cut_lineage(row.withColumn("at", F.monotonically_increasing_id()))
    slice_ = F.shiftright("at", 33)
    # Pieces of a length are contiguous in a slice, so its first row and count give every rank.
    parts = cut_lineage(placed.groupBy("length", slice_.alias("slice")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")))
    # At most ``capacity`` rows.
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ranges = rank_ranges(plan_patterns(counts, capacity))
    columns = ["length", "low", "high", "each", "first_sequence", "place"]
    # An Arrow table needs no Python worker to become rows.
    table = pa.table({name: pa.array([row[i] for row in ranges], pa.int64()) for i, name in enumerate(columns)})
    table = pieces.sparkSession.createDataFrame(table)
    earlier = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("length", "slice", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = placed.withColumn("slice", slice_).alias("d").join(before.alias("p"), same("d", "p", ["length", "slice"]))
    ranked = ranked.select("d.row", "d.length", (F.col("p.before") + F.col("d.at") - F.col("p.first")).alias("rank"))
    # Every pattern uses up a length or an open kind of sequence, so the plan is bounded by the capacity
    # alone (2,564 ranges at 1024 for 95,332 pieces, 827 for 1,507) and every task may hold it.
    found = ranked.alias("r").join(
        F.broadcast(table).alias("t"),
        (F.col("r.length") == F.col("t.length")) & F.col("r.rank").between(F.col("t.low"), F.col("t.high")),
    )
    step = F.col("r.rank") - F.col("t.low")
    return found.select(
        "r.row.*", (F.col("t.first_sequence") + F.floor(step / F.col("t.each"))).alias("sequence_id"),
        (F.col("t.place") + step % F.col("t.each") * F.col("r.length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, **options) -> DataFrame:
    """(doc, piece, start, length, ids, sequence_id, offset): the whole table, packed."""
    return pack_pieces(token_pieces(docs, path, capacity=capacity, **options), capacity)
