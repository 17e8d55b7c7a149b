"""Document fingerprints: SimHash of weighted terms, searched through permuted block tables.

Terms are the words of a text and its pairs of neighbouring words.  A term weighs
1 + log2 of how often it occurs; every bit of its hash adds or takes that weight, and
the signs of the sums are the fingerprint.  For the search the fingerprint is cut into
blocks and copied once for each choice of blocks that may stay untouched by ``radius``
changed bits, with those blocks in front as the key: fingerprints within the radius
agree on some key, so every one of them is found.

Defined results
---------------
* A null text is empty; a text without words has fingerprint 0.
* Equal texts have equal fingerprints, whatever their ids or other columns.
* The next document is the next row by id, nulls first, rows of one id by text; the
  last row is followed by the first, and a single row by itself.
* Repeated rows are documents of their own.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadline.llm.common import named, small_batches
from threadline.session import cut_lineage

RADIUS = 3
BLOCKS = 5
#: Distinct terms turned into votes at a time.
CHUNK = 1 << 15


def terms(text: str) -> Counter:
    """Terms of a text and how often each occurs."""
    words = text.encode("utf-8", "surrogatepass").split()
    found = Counter(words)
    found.update(map(b" ".join, zip(words, words[1:])))  # noqa: B905
    return found


def simhash(text: str) -> int:
    """Signed 64-bit fingerprint of a text."""
    found = terms(text)
    if not found:
        return 0
    votes, each = np.zeros(64), iter(found.items())
    while chunk := [pair for _, pair in zip(range(CHUNK), each)]:  # noqa: B905
        hashes = np.fromiter((xxhash.xxh64_intdigest(term) for term, _ in chunk), ">u8", len(chunk))
        weights = 1 + np.log2(np.fromiter((n for _, n in chunk), np.float64, len(chunk)))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        votes += 2 * (weights @ bits) - weights.sum()
    return int.from_bytes(np.packbits(votes > 0).tobytes(), "big", signed=True)


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as many first characters of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def likeness(left: Column, right: Column) -> Column:
    """Share of equal bits of two fingerprints."""
    return F.lit(1.0) - F.bit_count(left.bitwiseXOR(right)) / F.lit(64.0)


def _borders(docs: DataFrame, id_column: str, slices: int) -> tuple[list[int], bool]:
    """The ids that start a slice, the smallest first, and whether there are null ids."""
    row = docs.agg(
        F.percentile_approx(named(id_column), [i / slices for i in range(slices)], 10_000).alias("q"),
        F.min(named(id_column)).alias("least"), F.count_if(named(id_column).isNull()).alias("none"),
    ).first()
    return ([] if row["least"] is None else sorted({row["least"], *row["q"]})), row["none"] > 0


def _dealt(docs: DataFrame, id_column: str, text_column: str, slices: int) -> DataFrame:
    """(slice, ahead, id, text), each slice sorted in one partition.

    The rows that start a slice are also the last ones, marked ``ahead``, of the slice
    before it; the last slice ends with the start of the first.  So each text has its
    next one at hand after a single shuffle.
    """
    borders, nulls = _borders(docs, id_column, slices)
    first, last = 0 if nulls else 1, len(borders)
    starts = np.asarray(borders, np.int64)

    @F.pandas_udf("array<int>")
    def slices_of(ids: pd.Series) -> pd.Series:
        """The slice of an id, and the one before it for an id that starts a slice."""
        values = ids.fillna(0).astype(np.int64).to_numpy()
        place = np.where(ids.isna().to_numpy(), 0, np.searchsorted(starts, values, side="right"))
        begins = (place == 0) | np.isin(values, starts)
        before = np.where(place == first, last, place - 1)
        return pd.Series([[p, b] if s else [p] for p, b, s in zip(place.tolist(), before.tolist(), begins.tolist(), strict=True)])

    rows = docs.select(named(id_column).cast("long").alias("id"), F.coalesce(named(text_column), F.lit("")).alias("text"))
    rows = rows.select("id", "text", F.posexplode(slices_of("id")).alias("ahead", "slice"))
    order = ["slice", "ahead", "id", "text"]
    return rows.select(*order).repartition("slice").sortWithinPartitions(*order)


PAIR_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fp long, edited_fp long, next_fp long"


def _pair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to fingerprints; holds one document while its next one is awaited."""
    held = None
    names = [part.split()[0] for part in PAIR_SCHEMA.split(", ")]
    types = [pa.string() if name == "edited_sha256" else pa.int64() for name in names]
    for batch in batches:
        out = []
        for slice_, ahead, id_, text in zip(*(batch.column(c).to_pylist() for c in ("slice", "ahead", "id", "text")), strict=True):
            if ahead and (held is None or held[0] != slice_):
                continue  # the slice has its next text already
            print_ = simhash(text)
            if held and held[0] == slice_:
                change = edited(held[2], text)
                digest = hashlib.sha256(change.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((held[1], len(held[2]), digest, held[3], simhash(change), print_))
            held = None if ahead else (slice_, id_, text, print_)
        columns = zip(*out, strict=True) if out else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)


def fingerprint_pairs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", slices: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp): each document, its edited text and the next document.

    ``slices`` is a number of tasks, four for each shuffle partition if not given.  Ids are integers.
    """
    small_batches(docs.sparkSession)
    slices = slices or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _dealt(docs, id_column, text_column, slices).mapInArrow(_pair_batches, PAIR_SCHEMA)


def block_masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """A signed mask for each choice of ``blocks - radius`` blocks that radius changed bits may leave untouched."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    block = [sum(1 << bit for bit in range(a, b)) for a, b in zip(edges, edges[1:])]  # noqa: B905
    tables = [sum(chosen) for chosen in combinations(block, blocks - radius)]
    return [mask - (1 << 64) if mask >> 63 else mask for mask in tables]


def search(prints: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query, fp, distance) for every ``fp`` within ``radius`` bits of a ``query``; both sides distinct."""
    table = block_masks(radius, blocks)

    def keyed(df: DataFrame, name: str) -> DataFrame:
        keys = [F.struct(F.lit(i).alias("t"), F.col(name).bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(table)]
        return df.select(name, F.explode(F.array(*keys)).alias("key")).select(name, "key.t", "key.k")

    change = F.col("q.query").bitwiseXOR(F.col("p.fp"))
    # A pair that meets in several tables counts in the first.
    first = F.array_position(F.transform(F.lit(table), lambda m: m.bitwiseAND(change) == 0), True) - 1
    found = keyed(queries, "query").alias("q").join(
        keyed(prints, "fp").alias("p"),
        (F.col("q.t") == F.col("p.t")) & (F.col("q.k") == F.col("p.k")) & (F.bit_count(change) <= radius) & (first == F.col("q.t")),
    )
    return found.select("q.query", "p.fp", F.bit_count(change).alias("distance"))


def near_counts(pairs: DataFrame, asked: Column, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``pairs`` with ``n_near``: how many other rows have a fingerprint within the radius; null for rows not asked for."""
    pairs = cut_lineage(pairs)
    prints = cut_lineage(pairs.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.max(asked).alias("asked")))
    found = search(prints.select("fp"), prints.filter("asked").select(F.col("fp").alias("query")), radius, blocks)
    counted = found.join(prints.select("fp", "n"), "fp").groupBy("query").agg((F.sum("n") - 1).alias("n_near"))
    # Rows not asked for stay out of the join: as null keys they would all meet in one task.
    answered = pairs.filter(asked).join(counted.withColumnRenamed("query", "fp"), "fp", "left").select(*pairs.columns, "n_near")
    rest = pairs.filter(~F.coalesce(asked, F.lit(False))).withColumn("n_near", F.lit(None).cast("long"))
    return answered.unionByName(rest)
