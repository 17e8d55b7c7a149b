"""Hard-negative mining with score bounds along spanning trees of anchors.

Vectors are scaled to integers, so scores (inner products) are exact.  Anchors are cut
into blocks of near ones and each block gets a minimum spanning tree over Euclidean
distances; rows are packed into blocks of their own.  Where a block of anchors meets a
block of rows, the root of the tree scores every row.  For any other anchor

    | <child, x> - <parent, x> | <= |child - parent| * |x|

bounds the scores of its rows by those of its parent, whose bounds are exact wherever it
was rescored itself.  Only rows whose bound reaches what the anchor still looks for are
rescored: rows of its label that could be among the first positives, then rows of other
labels that could lie in the window of one of the positives.  Nothing within reach of a
bound is skipped, so results equal those of all scores.  How much is saved depends on
the data: near anchors (copies, dense topics) save nearly all, scattered ones nothing.

Anchors are a stated query set against all rows, block by block; a block of anchors or
of rows has a fixed size, and no label, copy or anchor gathers rows in one place.

Defined results
---------------
* Rows with a null label, a null vector, or a null or non-finite component take no part.
* A shorter vector counts as filled up with zeros.
* A row with a null id is never an anchor; among equal scores it comes last.
* Every repeated row is a row of its own; an anchor's repeats may be its positives.
* Scores beyond a long count as its ends.
* Without anchors, positives or negatives there are no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadline.functions.ordered import with_row_number
from threadline.llm.common import named
from threadline.session import cut_lineage

POSITIVES, NEGATIVES = 5, 10
#: A negative lies in the window if LOW * positive <= 100 * negative <= HIGH * positive.
LOW, HIGH = 30, 90
SCALE = 256
#: Anchors of a tree, rows of a block.
TREE, BLOCK = 128, 8192
#: Rows rescored at a time; planes that deal near anchors to one tree.
STEP, PLANES = 1 << 12, 24

PACKED = "ids binary, rows binary, labels binary, vectors binary, width int, n int"
TREES = f"tree long, parents binary, lengths binary, {PACKED}"
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """Components times ``scale``, rounded down to longs; null if any component is null or not finite."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(math.inf)), F.lit(False)))
    return F.when(fine, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def _matrix(vectors: list[np.ndarray]) -> np.ndarray:
    """One row for each vector, filled up with zeros."""
    width = max((len(v) for v in vectors), default=0)
    if all(len(v) == width for v in vectors):
        return np.array(vectors, np.int64).reshape(len(vectors), width)
    found = np.zeros((len(vectors), width), np.int64)
    for row, vector in zip(found, vectors, strict=True):
        row[: len(vector)] = vector
    return found


def _pack(part: pd.DataFrame) -> dict:
    """Columns of a block; vectors in as few bytes as hold them."""
    vectors = _matrix(list(part["vector"]))
    kind = "<i2" if np.abs(vectors.astype(np.float64)).max(initial=0) < 1 << 15 else "<i8"
    return {
        "ids": part["vec_id"].to_numpy("<i8").tobytes(), "rows": part["row"].to_numpy("<i8").tobytes(),
        "labels": part["label"].to_numpy("<i8").tobytes(), "vectors": vectors.astype(kind).tobytes(), "width": vectors.shape[1], "n": len(part),
    }


class _Rows:
    """A packed block, unpacked."""

    def __init__(self, block: pd.Series, prefix: str = "") -> None:
        read = lambda name, kind: np.frombuffer(block[prefix + name], kind)
        n, width = int(block[prefix + "n"]), int(block[prefix + "width"])
        self.ids, self.rows, self.labels = read("ids", "<i8"), read("rows", "<i8"), read("labels", "<i8")
        raw = block[prefix + "vectors"]
        self.vectors = np.frombuffer(raw, "<i2" if len(raw) == 2 * n * width else "<i8").reshape(n, width).astype(np.float64)
        self.exact = None
        if np.abs(self.vectors).max(initial=0) >= 1 << 22:  # beyond what doubles add up exactly
            self.exact = np.frombuffer(raw, "<i8").reshape(n, width).astype(object)
        self.norms = np.sqrt((self.vectors**2).sum(axis=1))


def _fit(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = min(left.shape[-1], right.shape[-1])
    return left[..., :width], right[..., :width]


def _scores(rows: _Rows, which: np.ndarray, anchors: _Rows, anchor: int) -> np.ndarray:
    """Exact scores of some rows with one anchor: doubles are exact while components and widths are small."""
    exact = rows.exact is not None or anchors.exact is not None or rows.vectors.shape[1] > 512
    if not exact:
        vectors, vector = _fit(rows.vectors, anchors.vectors[anchor])
        return np.concatenate([vectors[which[i : i + STEP]] @ vector for i in range(0, max(1, len(which)), STEP)])
    left = rows.vectors.astype(np.int64).astype(object) if rows.exact is None else rows.exact
    right = anchors.vectors.astype(np.int64).astype(object) if anchors.exact is None else anchors.exact
    left, right = _fit(left[which], right[anchor])
    return np.array([min(MOST, max(LEAST, int(a @ right) if len(right) else 0)) for a in left], object)


def span(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parents, lengths) of a minimum spanning tree: parents come before children, the root has parent -1."""
    n = len(vectors)
    squares = (vectors**2).sum(axis=1)
    left, parents, nearest = np.ones(n, bool), np.full(n, -1), np.full(n, np.inf)
    order, lengths, at = [], np.zeros(n), 0
    for _ in range(n):
        left[at] = False
        order.append(at)
        gap = np.sqrt(np.maximum(0, squares + squares[at] - 2 * (vectors @ vectors[at])))
        closer = left & (gap < nearest)
        nearest[closer], parents[closer] = gap[closer], at
        if left.any():
            at = int(np.where(left, nearest, np.inf).argmin())
            # The difference itself, not the expanded square, so that rounding stays small beside the margin.
            lengths[at] = np.sqrt(((vectors[at] - vectors[parents[at]]) ** 2).sum())
    return np.array(order), parents, lengths


def _plant(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for group in groups:
        order, parents, lengths = span(_matrix(list(group["vector"])).astype(np.float64))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        parents = np.where(parents[order] < 0, -1, place[parents[order]])
        packed = _pack(group.iloc[order])
        row = {"tree": group["tree"].iloc[0], "parents": parents.astype("<i8").tobytes(), "lengths": lengths[order].astype("<f8").tobytes()}
        yield pd.DataFrame([row | packed])


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Consecutive rows of a partition, packed."""
    held, n = [], 0
    for frame in frames:
        while len(frame):
            held.append(frame.iloc[: BLOCK - n])
            frame = frame.iloc[BLOCK - n :]
            n += len(held[-1])
            if n == BLOCK:
                yield pd.DataFrame([_pack(pd.concat(held))])
                held, n = [], 0
    if n:
        yield pd.DataFrame([_pack(pd.concat(held))])


class Climb:
    """Walks a tree over a block of rows and keeps bounds of every anchor's scores."""

    def __init__(self, rows: _Rows, anchors: _Rows, parents: np.ndarray, lengths: np.ndarray) -> None:
        self.rows, self.anchors, self.parents, self.lengths = rows, anchors, parents, lengths
        self.children = np.bincount(parents[parents >= 0], minlength=len(parents))
        self.bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.rescored = 0

    def bound(self, anchor: int) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest possible scores of all rows; exact at the root."""
        parent = int(self.parents[anchor])
        if parent < 0:
            every = np.arange(len(self.rows.ids))
            low = _scores(self.rows, every, self.anchors, anchor)
            self.rescored += len(every)
            self.bounds[anchor] = (low.astype(np.float64), low.astype(np.float64))
            return self.bounds[anchor]
        low, high = self.bounds[parent]
        # The margin covers the rounding of norms, lengths and, beyond 2 ** 53, of scores.
        reach = self.lengths[anchor] * self.rows.norms * (1 + 1e-9)
        reach = reach + 1e-9 * np.maximum(np.abs(low), np.abs(high)) + 1e-3
        self.children[parent] -= 1
        if not self.children[parent]:
            del self.bounds[parent]
        self.bounds[anchor] = (low - reach, high + reach)
        return self.bounds[anchor]

    def exact(self, anchor: int, needed: np.ndarray) -> np.ndarray:
        """Exact scores of the needed rows, which become their bounds."""
        found = _scores(self.rows, needed, self.anchors, anchor)
        self.rescored += len(needed)
        low, high = self.bounds[anchor]
        low[needed] = high[needed] = found.astype(np.float64)
        if not self.children[anchor]:
            del self.bounds[anchor]
        return found


def _best(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` by score, then id."""
    if len(scores) > 4 * most and scores.dtype != object:
        cut = np.partition(scores, len(scores) - most)[len(scores) - most]
        kept = np.flatnonzero(scores >= cut)
        return kept[np.lexsort((ids[kept], -scores[kept]))[:most]]
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:most], np.int64)
    return np.lexsort((ids, -scores))[:most]


def first_positives(climb: Climb, most: int) -> Iterator[tuple]:
    """(anchor row, anchor id, row, id, score): the first rows of the anchor's label within the block."""
    rows, anchors = climb.rows, climb.anchors
    for anchor in range(len(anchors.ids)):
        low, high = climb.bound(anchor)
        same = np.flatnonzero((rows.labels == anchors.labels[anchor]) & (rows.rows != anchors.rows[anchor]))
        if len(same) > most:
            least = np.partition(low[same], len(same) - most)[len(same) - most]
            same = same[high[same] >= least]
        scores = climb.exact(anchor, same)
        for i in _best(scores, rows.ids[same], most):
            yield int(anchors.rows[anchor]), int(anchors.ids[anchor]), int(rows.rows[same[i]]), int(rows.ids[same[i]]), int(scores[i])


def window(positive: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """Least and greatest negative score of a positive's window; empty if the first is larger."""
    return -(-low * positive // 100), high * positive // 100


def first_negatives(climb: Climb, positives: dict[int, list[tuple[int, int, int]]], most: int, low: int, high: int) -> Iterator[tuple]:
    """(anchor row, place, id, score): the first rows of other labels in the window of each positive, within the block."""
    rows, anchors = climb.rows, climb.anchors
    for anchor in range(len(anchors.ids)):
        least, largest = climb.bound(anchor)
        windows = [(place, *window(score, low, high)) for place, _, score in positives.get(int(anchors.rows[anchor]), [])]
        windows = [(place, a, b) for place, a, b in windows if a <= b]
        reached = np.zeros(len(rows.ids), bool)
        for _, a, b in windows:
            reached |= (largest >= a) & (least <= b)
        other = np.flatnonzero(reached & (rows.labels != anchors.labels[anchor]))
        scores = climb.exact(anchor, other)
        ids = rows.ids[other]
        for place, a, b in windows:
            inside = np.flatnonzero((scores >= a) & (scores <= b))
            for i in inside[_best(scores[inside], ids[inside], most)]:
                yield int(anchors.rows[anchor]), place, int(ids[i]), int(scores[i])


def _climbs(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[Climb, pd.Series]]:
    for frame in frames:
        for _, pair in frame.iterrows():
            parents, lengths = np.frombuffer(pair["parents"], "<i8"), np.frombuffer(pair["lengths"], "<f8")
            yield Climb(_Rows(pair, "r_"), _Rows(pair), parents, lengths), pair


def _framed(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns, dtype="int64")


def mine(
    vectors: DataFrame, anchor: Column, label: Column | None = None, id_column: str = "vec_id", vector_column: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), best negatives of each positive first.

    ``anchor`` tells which rows are anchors, ``label`` what a row's label is (default: its column ``label``).
    """
    rows = vectors.select(
        F.coalesce(named(id_column).cast("long"), F.lit(MOST)).alias("vec_id"), (named("label") if label is None else label).cast("long").alias("label"),
        scaled(named(vector_column), scale).alias("vector"), (named(id_column).isNotNull() & F.coalesce(anchor, F.lit(False))).alias("anchor"),
    )
    # Written once, the numbers of rows stay as they are.
    rows = rows.filter("label is not null and vector is not null").withColumn("row", F.monotonically_increasing_id())
    rows = cut_lineage(rows.select("vec_id", "label", "vector", "anchor", "row"))
    blocks = rows.select("vec_id", "label", "vector", "row").mapInPandas(_blocks, PACKED)
    blocks = cut_lineage(blocks.withColumn("block", F.monotonically_increasing_id()))
    trees = cut_lineage(_trees(rows.filter("anchor")))
    n_trees = trees.count()
    # Trees are the small side: each travels once to every block of rows.
    spread = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    renamed = blocks.select("block", *[F.col(name).alias(f"r_{name}") for name in ("ids", "rows", "labels", "vectors", "width", "n")])
    every = F.sequence(F.lit(0), F.lit(max(0, n_trees - 1))).cast("array<long>")
    meetings = blocks.select("block", F.explode(every).alias("tree")).repartition(spread, "block", "tree")

    def meet(extra: DataFrame | None = None) -> DataFrame:
        sent = trees if extra is None else trees.join(extra, "tree")
        return meetings.join(sent, "tree").join(renamed, "block").drop("block")

    def find_positives(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["tree", "anchor", "anchor_id", "row", "id", "score"]
        for climb, pair in _climbs(frames):
            yield _framed([(pair["tree"], *found) for found in first_positives(climb, positives)], names)

    schema = "tree long, anchor long, anchor_id long, row long, id long, score long"
    found = meet().mapInPandas(find_positives, schema)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "row")
    found = cut_lineage(found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives))
    known = found.groupBy("tree").agg(F.collect_list(F.struct("anchor", "place", "id", "score")).alias("known"))

    def find_negatives(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for climb, pair in _climbs(frames):
            held: dict[int, list[tuple[int, int, int]]] = {}
            for one in pair["known"]:
                held.setdefault(one["anchor"], []).append((one["place"], one["id"], one["score"]))
            yield _framed(list(first_negatives(climb, held, negatives, low, high)), ["anchor", "place", "negative_id", "negative_score"])

    against = meet(known).mapInPandas(find_negatives, "anchor long, place long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    against = against.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    unknown = lambda c: F.when(F.col(c) != MOST, F.col(c))
    return against.join(found, ["anchor", "place"]).select(
        "anchor_id", unknown("id").alias("positive_id"), "rank", unknown("negative_id").alias("negative_id"),
        F.col("score").alias("positive_score"), "negative_score",
    )


def _trees(anchors: DataFrame) -> DataFrame:
    """One packed tree for every ``TREE`` anchors that follow each other by the side they take of random planes."""
    planes = np.random.default_rng(42).normal(size=(PLANES, 1024)).round(6)

    @F.pandas_udf("long")
    def side(vectors: pd.Series) -> pd.Series:
        codes = []
        for vector in vectors:
            v = np.asarray(vector, np.float64)
            shares = np.zeros(PLANES)
            for i in range(0, len(v), planes.shape[1]):
                part = v[i : i + planes.shape[1]]
                shares += planes[:, : len(part)] @ part
            codes.append(int.from_bytes(np.packbits(shares > 0).tobytes(), "big"))
        return pd.Series(codes, dtype="int64")

    dealt = anchors.select("vec_id", "label", "vector", "row", side("vector").alias("side"), F.lit(0).alias("all"))
    dealt = with_row_number(dealt, ["all"], ["side", "row"], "place")
    dealt = dealt.withColumn("tree", F.expr(f"(place - 1) div {TREE}"))
    return dealt.select("tree", "vec_id", "label", "vector", "row").groupBy("tree").applyInPandas(lambda group: next(_plant(iter([group]))), TREES)
