"""Near copies by word shingles: SimHash and min-hash bands find the pairs, an exact Jaccard check decides.

Texts with one word sequence (ASCII letters in lower case) are one node.  Nodes are linked
first as operator 4 links texts: by SimHash fingerprints, here of the set of shingles, that
covering masks find within two bits of each other.  Copies at 0.8 differ in up to 11 bits,
so min-hash bands find the others: a node has
``bands`` keys, each of the smallest hashes under ``rows`` hash functions; two nodes of
similarity s share no key with probability (1 - s ** rows) ** bands, at 0.8 and the given
numbers 4.7e-8.  Every pair that shares a key is decided by its similarity, unless both
ends are already connected by pairs that passed or their numbers of shingles are too far
apart.  The similarity is that of the sets of 64-bit shingle hashes, which equal those of
the shingles themselves unless two of a pair's shingles collide; sets meet in the JVM.

In each of ``ROUNDS`` rounds a centre of each bucket is compared with the bucket's nodes of
other components: the node whose buckets hold most nodes, of those that were no centre of it
before.  Such a node differs least from what its group has in common, so it is similar to
all that are similar to any of the group but for a few, and those links join most of a group
of any size at a cost in proportion to it.  What is left are nodes that share a bucket with
another component.  They are compared by prefixes: two sets of similarity s share one of
the rarest (1 - s) n + 1 shingles of either, the first one so early that enough can follow, so
only nodes with such a shingle in common meet.  A text with more shingles of its own than that meets nobody, however much
boilerplate it shares with thousands of others.  Before sets are fetched, sketches of the
min-hashes sort out pairs far below the bound: a pair at 0.8 is lost so with probability
below 1e-5.

Defined results
---------------
* A null text is empty; texts without words are one node.
* A text of at most ``shingle`` words has one shingle, all its words.
* A component is named by its smallest id that is not null; null if it has none.
* Repeated ids are documents of their own when linking.
* An empty table gives an empty result; other columns are kept out of the work.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadline.llm.common import named, same, small_batches, whole_row
from threadline.llm.components import components
from threadline.llm.simhash_dedup import majority_bits, near_links
from threadline.session import Pile, cut_lineage, discard

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 4
#: Rounds of comparing with centres before pairs.
ROUNDS = 3
#: Standard errors below the bound at which a sketch still lets a pair through.
MARGIN = 5.0
#: Shingles hashed at a time.
BLOCK = 1 << 8


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], size: int = SHINGLE) -> set[bytes]:
    if not words:
        return set()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


@cache
def hash_functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """What n functions x -> (x ^ flip) * factor take; the factors are odd."""
    rng = np.random.default_rng(42)
    return rng.integers(0, 1 << 63, n, np.uint64), rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(words: list[bytes], size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> list[int]:
    """A signed key for each band; none for a text without words."""
    return keys_of(min_hashes(shingle_hashes(words, size), bands * rows), bands, rows) if words else []


def shingle_hashes(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles(words, size)), np.uint64)


def min_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    flips, factors = hash_functions(n)
    least = np.full(n, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), BLOCK):
        np.minimum(least, ((hashes[i : i + BLOCK, None] ^ flips) * factors).min(axis=0), out=least)
    return least


def keys_of(least: np.ndarray, bands: int, rows: int) -> list[int]:
    return [xxhash.xxh64_intdigest(part.tobytes()) - (1 << 63) for part in least.reshape(bands, rows)]


def set_fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set of shingle hashes; 0 for none."""
    return majority_bits(hashes[i : i + BLOCK] for i in range(0, len(hashes), BLOCK))


def sketch_of(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One bit and eight bits of each min-hash, mixed, as signed longs."""
    mixed = (least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)
    pad = lambda bytes_: np.frombuffer(bytes_ + b"\0" * (-len(bytes_) % 8), np.int64)
    return pad(np.packbits((mixed & np.uint64(1)).astype(np.uint8)).tobytes()), pad(mixed.astype(np.uint8).tobytes())


def most_apart(similarity: float, hashes: int, bits: int) -> int:
    """Bits in which the sketches of a pair at the bound differ at most, ``MARGIN`` standard errors included."""
    mean = (1 - similarity) * hashes * bits / 2
    spread = hashes * similarity * (1 - similarity) * bits * bits / 4 + (1 - similarity) * hashes * bits / 4
    return int(mean + MARGIN * spread**0.5) + 1


_SKETCH = T.StructType([
    T.StructField("key", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())),
    T.StructField("bit", T.ArrayType(T.LongType())), T.StructField("byte", T.ArrayType(T.LongType())), T.StructField("fp", T.LongType()),
])


def _sketches(size: int, bands: int, rows: int):  # noqa: ANN202
    @F.pandas_udf(_SKETCH)
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = []
            for text in texts:  # the words of one text at a time
                words = words_of(text)
                hashes = shingle_hashes(words, size)
                least = min_hashes(hashes, bands * rows)
                keys = keys_of(least, bands, rows) if words else []
                found.append((xxhash.xxh3_128_digest(b" ".join(words)), len(hashes), keys, *sketch_of(least), set_fingerprint(hashes)))
            yield pd.DataFrame(found, columns=_SKETCH.names)

    return sketch


def _word_keys():  # noqa: ANN202
    @F.pandas_udf(T.BinaryType())
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([xxhash.xxh3_128_digest(b" ".join(words_of(text))) for text in texts], dtype="object")

    return keys


def _keyed_sets(size: int):  # noqa: ANN202
    """Word key and shingle hashes of a text."""

    @F.pandas_udf(T.StructType([T.StructField("key", T.BinaryType()), T.StructField("hashes", T.ArrayType(T.LongType()))]))
    def keyed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            keys, sets = [], []
            for text in texts:
                words = words_of(text)
                keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
                sets.append(shingle_hashes(words, size).view(np.int64))
            yield pd.DataFrame({"key": keys, "hashes": sets})

    return keyed.asNondeterministic()


def _passed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("right"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("left", "right"))
    alike = shared >= F.lit(similarity) * (F.size("left") + F.size("right") - shared)
    return cut_lineage(both.filter(alike).select("a", "b"))


def _apart(left: str, right: str, longs: int) -> Column:
    """Bits in which two sketches differ."""
    bits = [F.bit_count(F.get(F.col(left), F.lit(i)).bitwiseXOR(F.get(F.col(right), F.lit(i)))) for i in range(longs)]
    return reduce(Column.__add__, bits)


def _prefixes(rows: DataFrame, similarity: float) -> DataFrame:
    """(node, n, bit, root, h, rank): the rarest shingles of each set of ``rows`` (node, n, bit, root, hashes) that other components hold too.

    Shingles are ordered by the number of sets that hold them.  Those of one set alone come
    first and meet nobody, so they are counted and not ranked.
    """
    rows = cut_lineage(rows)
    spread = rows.select("node", "root", "n", F.explode("hashes").alias("h"))
    held = spread.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("low"), F.max("root").alias("high")).filter("m > 1")
    shared = spread.join(held, "h")
    order = Window.partitionBy("node").orderBy("m", "h")
    everyone = Window.partitionBy("node")
    ranked = shared.withColumn("rank", F.row_number().over(order) + F.col("n") - F.count(F.lit(1)).over(everyone))
    most = F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - F.lit(1e-9)) + 1
    kept = ranked.filter((F.col("rank") <= most) & (F.col("low") != F.col("high"))).select("node", "h", "rank")
    return cut_lineage(kept.join(rows.select("node", "n", "bit", "root"), "node"))


def _within_radius(nodes: DataFrame) -> DataFrame:
    """(a, b) of nodes (node, fp): links that connect just those whose fingerprints are equal or near.

    The first node of a fingerprint stands for it.
    """
    heads = cut_lineage(nodes.groupBy("fp").agg(F.min("node").alias("head")))
    equal = nodes.join(heads, "fp").select("head", "node").filter("head <> node")
    ends = near_links(heads.select("fp"))
    for end in ("a", "b"):
        ends = ends.join(heads.select(F.col("fp").alias(end), F.col("head").alias(f"{end}_node")), end)
    pairs = equal.toDF("a", "b").unionByName(ends.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))
    return cut_lineage(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def near_copies(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY,
    bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """(doc_id, key, component_id, first_key): every row's word key and component.

    (component_id, first_key) names one document of the component: the smallest id and
    the smallest key under that id.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(named(text_column), F.lit(""))
    hashes = bands * rows
    sketched = docs.select(named(id_column).alias("doc_id"), _sketches(size, bands, rows)(text).alias("s"))
    sketched = cut_lineage(sketched.select("doc_id", "s.*"))
    # Nulls go last, so that a component with any id is named by one.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    same_words = [F.first(c).alias(c) for c in ("n", "bands", "bit", "byte", "fp")]
    nodes = sketched.groupBy("key").agg(first.alias("first"), *same_words)
    # Written once, the numbers stay as they are.
    nodes = cut_lineage(nodes.withColumn("node", F.monotonically_increasing_id()))
    keyed = nodes.select("node", "n", "bit", F.posexplode("bands").alias("t", "k"))
    shared = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    members = cut_lineage(keyed.join(shared, ["t", "k"]))
    mates = members.groupBy("node").agg(F.sum("m").alias("mates"))
    alike = _within_radius(nodes.filter("n > 0"))
    # The set of each node that has a partner, from one of its texts.
    partners = members.select("node").unionByName(alike.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    ends = partners.join(nodes.select("node", "key", "first.doc_id"), "node")
    rows_ = docs.select(named(id_column).alias("doc_id"), _keyed_sets(size)(text).alias("s")).select("doc_id", "s.key", "s.hashes")
    held = ends.alias("e").join(rows_.alias("r"), same("e", "r", ["doc_id", "key"])).select("e.node", "r.hashes")
    sets = cut_lineage(held.dropDuplicates(["node"]))
    bytes_ = nodes.select("node", "byte")
    near = (
        (F.col("l.root") != F.col("r.root")) & (F.least("l.n", "r.n") >= F.lit(similarity) * F.greatest("l.n", "r.n"))
        & (_apart("l.bit", "r.bit", -(-hashes // 64)) <= most_apart(similarity, hashes, 1))
    )
    tested = Pile(members.select(F.col("node").alias("a"), F.col("node").alias("b")))
    links = Pile(tested.rows())

    def compare(pairs: DataFrame) -> DataFrame:
        """Test the pairs (a, b) that were not tested before; the roots of all links so far."""
        pairs = tested.add_part(pairs.join(tested.rows(), ["a", "b"], "left_anti"))
        left, right = (bytes_.select(F.col("node").alias(end), F.col("byte").alias(f"{end}_byte")) for end in ("a", "b"))
        close = _apart("a_byte", "b_byte", -(-hashes // 8)) <= most_apart(similarity, hashes, 8)
        pairs = cut_lineage(pairs.join(left, "a").join(right, "b").filter(close).select("a", "b"))
        links.add_part(_passed(pairs, sets, similarity))
        return components(links.rows())

    roots = compare(alike)
    centres = Pile(members.select("t", "k", "node"))
    members = cut_lineage(members.join(mates, "node").select("t", "k", "node", "n", "bit", "mates"))
    for turn in range(ROUNDS + 1):
        placed = members.join(roots, "node", "left")
        placed = cut_lineage(placed.select("t", "k", "node", "n", "bit", "mates", F.coalesce("root", "node").alias("root")))
        mixed = placed.groupBy("t", "k").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("t", "k")
        bucket = (F.col("l.t") == F.col("r.t")) & (F.col("l.k") == F.col("r.k"))
        if turn < ROUNDS:
            fresh = placed.join(mixed, ["t", "k"], "left_semi").join(centres.rows(), ["t", "k", "node"], "left_anti")
            centre = F.max_by(F.struct("node", "n", "bit", "root"), F.struct("mates", "node"))
            left = cut_lineage(fresh.groupBy("t", "k").agg(centre.alias("c")).select("t", "k", "c.*"))
            centres.add(left)
            pairs = left.alias("l").join(placed.alias("r"), bucket & near)
        else:
            left_over = placed.join(mixed, ["t", "k"], "left_semi").select("node", "n", "bit", "root").distinct()
            prefixes = _prefixes(left_over.join(sets, "node"), similarity)
            # The first shingle that two sets share leaves room for no more than what follows it in both.
            room = F.lit(1) + F.least(F.col("l.n") - F.col("l.rank"), F.col("r.n") - F.col("r.rank"))
            enough = room >= F.lit(similarity / (1 + similarity)) * (F.col("l.n") + F.col("r.n")) - F.lit(1e-9)
            pairs = prefixes.alias("l").join(
                prefixes.alias("r"), (F.col("l.h") == F.col("r.h")) & (F.col("l.node") < F.col("r.node")) & enough & near
            )
        roots = compare(pairs.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct())
        discard(placed)
    rooted = nodes.select("node", "key", "first").join(roots, "node", "left")
    rooted = cut_lineage(rooted.select("key", "first", F.coalesce("root", "node").alias("root")))
    heads = rooted.groupBy("root").agg(F.min("first").alias("head"))
    heads = rooted.join(heads, "root").select("key", F.col("head.doc_id").alias("component_id"), F.col("head.key").alias("first_key"))
    return sketched.select("doc_id", "key").join(heads, "key").select("doc_id", "key", "component_id", "first_key")


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **how: float) -> DataFrame:
    """One document of each component, with its own columns: the one that names it.

    Rows that repeat both id and words are one document; any one of them stays.  Their columns
    may have any type.
    """
    found = near_copies(docs, id_column, text_column, **how)
    heads = cut_lineage(found.select(F.col("component_id").alias("id"), F.col("first_key").alias("key")).distinct())
    text = F.coalesce(named(text_column), F.lit(""))
    rows = docs.select(whole_row(docs).alias("doc"), named(id_column).alias("id"), _word_keys()(text).alias("key"))
    kept = rows.alias("d").join(heads.alias("h"), same("d", "h", ["id", "key"]), "left_semi")
    return kept.dropDuplicates(["id", "key"]).select("doc.*")
