"""URL filters: listed rules first, then a character language-model ratio.

URLs that a rule allows or blocks train two character models of variable order.  Each
interpolates orders 0 to ``ORDER`` by Witten-Bell smoothing: a context seen often
trusts its own counts, a rare one the next shorter context.  A URL no rule covers is
scored by the difference of its log-likelihoods under both models, divided by its
length, and is allowed above a threshold.  One fold of the URLs is held out of the
models; the threshold is the score at which the held-out accepted and rejected URLs
are equally many standard deviations from their means.

Models, scores and thresholds are aggregations and joins over all distinct URLs.

Defined results
---------------
* A null URL, or one without ``://``, has empty host and path and no rule; a null URL is
  scored as the empty string.
* Repeated URLs count once in the models and get one verdict; equal rule lengths cannot
  both fit unless the rules are equal.
* If either class is missing, or has no held-out URL, the method allows.
* An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadline.llm.common import named
from threadline.session import cut_lineage

ORDER = 4
FOLDS = 5
#: Characters a uniform model chooses from.
ALPHABET = 256
START, END = "\x02", "\x03"


def host_of(url: Column) -> Column:
    """Host with A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest ``host/path`` rule that fits, null if none does."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        rule_host, _, rule_path = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rule_path)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def rule_verdict(rule: Column, rules: Sequence[tuple[str, str]]) -> Column:
    verdict = F.lit(None).cast("string")
    for action, name in rules:
        verdict = F.when(rule == name, F.lit(action)).otherwise(verdict)
    return verdict


def _grams(urls: DataFrame, *carry: str) -> DataFrame:
    """One row per character: ``gram`` is it with the ``ORDER`` characters before it."""
    padded = F.concat(F.lit(START * ORDER), F.col("url"), F.lit(END))
    at = F.sequence(F.lit(1), F.length(padded) - ORDER)
    grams = F.transform(at, lambda i: padded.substr(i, F.lit(ORDER + 1)))
    return urls.select(*carry, F.explode(grams).alias("gram"))


def _smoothed(seen: Column, total: Column, kinds: Column, below: Column) -> Column:
    """Witten-Bell: the share of new characters after this context goes to the shorter one."""
    return F.when(total > 0, (seen + kinds * below) / (total + kinds)).otherwise(below)


def gram_ratios(train: DataFrame, asked: DataFrame) -> DataFrame:
    """(gram, ratio) for each distinct ``gram`` asked for: log P(accepted) - log P(rejected) of its last character.

    ``train``: (gram, yes, no), counts of the longest grams in accepted and rejected URLs.
    """
    totals = train.groupBy(F.substring("gram", -1, 1).alias("c")).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    whole = totals.agg(*[f(F.col(c)).alias(f"{n}_{c}") for c in ("yes", "no") for n, f in (("n", F.sum), ("k", lambda x: F.count_if(x > 0)))]).first()
    found = asked.select("gram", *[F.lit(1.0 / ALPHABET).alias(f"p_{c}") for c in ("yes", "no")])
    for order in range(ORDER + 1):
        tail = F.substring("gram", -(order + 1), order + 1)
        counts = train.groupBy(tail.alias("tail")).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
        found = found.withColumn("tail", tail).join(counts, "tail", "left")
        if order:
            context = F.substring("tail", 1, order)
            after = counts.groupBy(context.alias("context")).agg(
                *[f(F.col(c)).alias(f"{n}_{c}") for c in ("yes", "no") for n, f in (("n", F.sum), ("k", lambda x: F.count_if(x > 0)))]
            )
            found = found.withColumn("context", context).join(after, "context", "left")
        else:
            found = found.select("*", *[F.lit(whole[f"{n}_{c}"] or 0).alias(f"{n}_{c}") for c in ("yes", "no") for n in "nk"])
        zero = lambda name: F.coalesce(F.col(name), F.lit(0))
        found = found.select(
            "gram", *[_smoothed(zero(c), zero(f"n_{c}"), zero(f"k_{c}"), F.col(f"p_{c}")).alias(f"p_{c}") for c in ("yes", "no")]
        )
    return found.select("gram", (F.log("p_yes") - F.log("p_no")).alias("ratio"))


def score_urls(urls: DataFrame) -> DataFrame:
    """(url, side, held, score) for the distinct URLs of (url, side); ``side`` is yes, no or null.

    ``held`` marks the fold that trains no model.
    """
    fold = F.conv(F.substring(F.md5("url"), 1, 4), 16, 10).cast("int") % FOLDS
    urls = cut_lineage(urls.select("url", "side", (fold == 0).alias("held")).distinct())
    learn = urls.filter("side is not null and not held")
    grams = _grams(learn, "side").groupBy("gram").agg(
        F.count_if(F.col("side") == "yes").alias("yes"), F.count_if(F.col("side") == "no").alias("no")
    )
    grams = cut_lineage(grams)
    scored = urls.filter("side is null or held").withColumn("key", F.struct(F.xxhash64("url").alias("x"), F.xxhash64("url", F.lit(1)).alias("y")))
    places = _grams(scored, "key")
    ratios = cut_lineage(gram_ratios(grams, places.select("gram").distinct()))
    sums = places.join(ratios, "gram").groupBy("key").agg((F.sum("ratio") / F.count(F.lit(1))).alias("score"))
    return scored.join(sums, "key").select("url", "side", "held", "score")


def threshold(scores: DataFrame) -> float | None:
    """The score equally many deviations from both held-out means; None if a class has none."""
    row = scores.filter("held").agg(
        *[f(F.when(F.col("side") == c, F.col("score"))).alias(f"{n}_{c}") for c in ("yes", "no") for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    ).first()
    if row["m_yes"] is None or row["m_no"] is None:
        return None
    wide, narrow = row["s_yes"] + 1e-9, row["s_no"] + 1e-9
    return (row["m_yes"] * narrow + row["m_no"] * wide) / (wide + narrow)


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """(page_id, url, host, path, rule, verdict, score) for every row; score is null where a rule decides."""
    url = named(url_column)
    rows = pages.select(named(id_column).alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("listed", rule_verdict(F.col("rule"), rules)).withColumn("text", F.coalesce("url", F.lit("")))
    side = F.when(F.col("listed") == "allow", "yes").when(F.col("listed") == "block", "no")
    scores = cut_lineage(score_urls(rows.select(F.col("text").alias("url"), side.alias("side"))))
    cut = threshold(scores)
    open_ = scores.filter("side is null").select(F.col("url").alias("text"), "score")
    joined = rows.join(open_, "text", "left")
    method = F.when(F.col("score") >= F.lit(cut), "allow").otherwise("block") if cut is not None else F.lit("allow")
    return joined.select("page_id", "url", "host", "path", "rule", F.coalesce("listed", method).alias("verdict"), "score")
