"""Token counts with the whole-token shortcut.

Before any text is read, each vocabulary string is encoded alone; those that come back
as their own single id are whole tokens.  A pre-token of a text that is one of them
counts 1 without merging; the library merges only the others.

Defined results
---------------
* A null text is empty: 0 bytes, 0 tokens.
* Special strings inside a text count as the library counts them by default.
* Repeated rows give repeated results; other columns are carried if asked for.
* An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadline.llm.common import named, small_batches, whole_row
from threadline.llm.tokens import counter

LIMIT = 512


def token_counter(path: str) -> Callable:
    """A column function that counts the tokens of a text by the vocabulary file at ``path``."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = counter(path).count
        for texts in batches:
            yield pd.Series([one(text) for text in texts], dtype="int64")

    return count


def count_tokens(
    docs: DataFrame, path: str, keep: Sequence[str] | None = None, limit: int = LIMIT, text_column: str = "text"
) -> DataFrame:
    """(doc, n_bytes, n_tokens, over_limit); ``doc`` holds the columns named by ``keep``, default all."""
    small_batches(docs.sparkSession)
    text = F.coalesce(named(text_column), F.lit(""))
    counted = docs.select(
        whole_row(docs, keep).alias("doc"), F.octet_length(text).cast("long").alias("n_bytes"), token_counter(path)(text).alias("n_tokens")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
