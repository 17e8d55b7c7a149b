"""SimHash near-dedup with covering locality-sensitive hashing.

Every bit position gets a code of radius + 1 bits.  A table for each non-zero vector
keeps the positions whose code has odd overlap with the vector.  The codes of up to
``radius`` differing positions never span the whole space, so some vector is even
with all of them: its table keeps none of the differing positions and the two
fingerprints collide there.  No pair within the radius can be missed.

Buckets of few fingerprints are compared pair by pair.  Large ones are resolved
exactly without pairs: two fingerprints differ in at most two bits just when both lie
within one bit of some centre, and at most 65 fingerprints share a centre.

Defined results
---------------
* A null text is empty; a text without words has fingerprint 0 and links like any other.
* Equal texts share a fingerprint, and so a component, whatever their ids.
* A component is named by its smallest id that is not null; null if it has none.
* Repeated ids are documents of their own when linking.
* An empty table gives an empty result; other columns are kept out of the work.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadline.llm.common import named, same, small_batches, whole_row
from threadline.llm.components import components
from threadline.session import cut_lineage

RADIUS = 2
SHINGLE = 3
SEED = 42
#: A larger bucket is resolved by centres instead of pairs.
PAIR_BUCKET = 32
#: Shingles turned into bits at a time.
BLOCK = 1 << 15


def _hashes(words: list[bytes]) -> Iterator[int]:
    if len(words) <= SHINGLE:
        return iter([xxhash.xxh64_intdigest(b" ".join(words), SEED)])
    return (xxhash.xxh64_intdigest(b" ".join(words[i : i + SHINGLE]), SEED) for i in range(len(words) - SHINGLE + 1))


def _blocks(hashes: Iterator[int]) -> Iterator[np.ndarray]:
    while len(block := np.fromiter(islice(hashes, BLOCK), np.uint64)):
        yield block


def majority_bits(blocks: Iterable[np.ndarray]) -> int:
    """Signed 64-bit fingerprint of unsigned hashes: a bit is set if over half of them have it."""
    counts, n = np.zeros(64, np.int64), 0
    for block in blocks:
        counts += np.unpackbits(block.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(block)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprint_of(text: str | None) -> int:
    """Signed 64-bit fingerprint: a bit is set if over half of the shingle hashes have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return majority_bits(_blocks(_hashes(words))) if words else 0


@F.pandas_udf(T.LongType())
def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([fingerprint_of(text) for text in texts], dtype="int64")


def fingerprint(text: Column) -> Column:
    return _fingerprints(F.coalesce(text, F.lit("")))


def masks(radius: int = RADIUS) -> list[int]:
    """One signed mask for each table: 2 ** (radius + 1) - 1 of them."""
    full = 2 ** (radius + 1) - 1
    code = [1 + i % full for i in range(64)]
    tables = [sum(1 << i for i in range(64) if (code[i] & vector).bit_count() % 2) for vector in range(1, full + 1)]
    return [mask - (1 << 64) if mask >> 63 else mask for mask in tables]


def near_links(prints: DataFrame) -> DataFrame:
    """(a, b) links that connect just the distinct ``fp`` values within the radius of each other."""
    keys = [F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks())]
    rows = prints.select("fp", F.explode(F.array(*keys)).alias("bucket")).select("fp", "bucket.t", "bucket.k")
    shared = cut_lineage(rows.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    members = rows.join(shared, ["t", "k"])
    few = members.filter(F.col("n") <= PAIR_BUCKET).select("t", "k", "fp")
    near = F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= RADIUS
    pairs = few.alias("l").join(
        few.alias("r"), (F.col("l.t") == F.col("r.t")) & (F.col("l.k") == F.col("r.k")) & (F.col("l.fp") < F.col("r.fp")) & near
    )
    pairs = pairs.select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))
    many = members.filter(F.col("n") > PAIR_BUCKET).select("fp").distinct()
    flips = F.lit([0] + [1 << i if i < 63 else -(1 << 63) for i in range(64)])
    centres = many.select("fp", F.explode(F.transform(flips, lambda bit: bit.bitwiseXOR(F.col("fp")))).alias("centre"))
    balls = centres.groupBy("centre").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("around"))
    stars = balls.filter(F.size("around") > 1).select("a", F.explode("around").alias("b")).filter("a <> b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp, component_id, first_fp): every row's fingerprint and component.

    (component_id, first_fp) names one document of the component: the smallest id and
    the smallest fingerprint under that id.
    """
    small_batches(docs.sparkSession)
    rows = cut_lineage(docs.select(named(id_column).alias("doc_id"), fingerprint(named(text_column)).alias("fp")))
    # Nulls go last, so that a component with any id is named by one.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp"))
    prints = cut_lineage(rows.groupBy("fp").agg(first.alias("first")))
    roots = components(near_links(prints.select("fp")))
    rooted = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = cut_lineage(rooted.select("fp", "first", F.coalesce("root", "fp").alias("root")))
    heads = rooted.groupBy("root").agg(F.min("first").alias("head"))
    heads = rooted.join(heads, "root").select(
        "fp", F.col("head.doc_id").alias("component_id"), F.col("head.fp").alias("first_fp")
    )
    return rows.join(heads, "fp").select("doc_id", "fp", "component_id", "first_fp")


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One document of each component, with its own columns: the one that names it.

    Rows that repeat both id and fingerprint are one document; the smallest row stays.
    """
    found = near_duplicates(docs, id_column, text_column)
    heads = cut_lineage(found.select(F.col("component_id").alias("id"), F.col("first_fp").alias("fp")).distinct())
    rows = docs.select(whole_row(docs).alias("doc"), named(id_column).alias("id"), fingerprint(named(text_column)).alias("fp"))
    kept = rows.alias("d").join(heads.alias("h"), same("d", "h", ["id", "fp"]), "left_semi")
    return kept.groupBy("id", "fp").agg(F.min("doc").alias("doc")).select("doc.*")


def hex_digits(column: Column) -> Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")
