"""URL filter: rules first, then gradient-boosted trees on lexical features.

Features are lengths, path depth, digit ratio, character entropy, counts of parameters and
marks, and the block share of the host's suffix among all labelled URLs. Trees are fitted
with Spark ML on a sample of at most ``SAMPLE_PER_CLASS`` labelled URLs of each class and
applied on the JVM; suffix statistics come from all labelled rows, kept for a fixed number
of suffix buckets so that they can be broadcast.

Labels: hosts that have one of ``LISTED_WORDS`` among their parts are to be blocked, all
others that no blocking rule covers are not. The trees do not see the words; they learn
what such addresses look like.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, table

SAMPLE_PER_CLASS = 10_000
SUFFIX_BUCKETS = 4_096
TREES, DEPTH = 12, 4
LISTED_WORDS = ("casino", "bets", "pills", "adult", "spam", "ads")
#: (host, path, verdict); a rule covers its host with all subdomains, and paths that begin so.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))
FEATURES = ["url_length", "host_length", "host_parts", "host_hyphens", "depth", "digit_ratio",
            "entropy", "parameters", "has_fragment", "suffix_share"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands between the first ``://`` and the path, A-Z lower-cased, and the path."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url.cast("string"), F.lit(""))
    return (F.translate(F.regexp_extract(text, pattern, 1), string.ascii_uppercase, string.ascii_lowercase),
            F.regexp_extract(text, pattern, 2))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else NULL."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, answer in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(answer)).otherwise(verdict)
    return rule, verdict


def _count(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def entropy(text: Column) -> Column:
    """Bits per character."""
    size = F.length(text)
    return F.coalesce(F.aggregate(
        F.array_distinct(F.split(text, "")), F.lit(0.0), lambda total, sign: total - F.when(
            F.length(sign) > 0, ((size - F.length(F.replace(text, sign))) / size)
            * F.log2((size - F.length(F.replace(text, sign))) / size)).otherwise(0.0)), F.lit(0.0))


def _suffix_bucket(host: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring_index(host, ".", -1)), F.lit(SUFFIX_BUCKETS))


def lexical(rows: DataFrame) -> DataFrame:
    """Features of ``url``, ``host`` and ``path``, but for the suffix statistics."""
    url = F.coalesce(F.col("url"), F.lit(""))
    return rows.withColumns({
        "url_length": F.length(url), "host_length": F.length("host"),
        "host_parts": F.size(F.split("host", r"\.")), "host_hyphens": _count(F.col("host"), "-"),
        "depth": _count(F.col("path"), "/"),
        "digit_ratio": _count(url, string.digits) / F.greatest(F.length(url), F.lit(1)),
        "entropy": entropy(url), "has_fragment": F.contains(url, F.lit("#")).cast("int"),
        "parameters": _count(url, "&") + F.contains(url, F.lit("?")).cast("int"),
        "suffix_bucket": _suffix_bucket(F.col("host"))})


def with_features(rows: DataFrame) -> DataFrame:
    """``rows`` of urls with host, path and all features that need no statistics."""
    host, path = host_and_path(F.col("url"))
    return lexical(rows.withColumn("host", host).withColumn("path", path))


def listed(host: Column, words=LISTED_WORDS) -> Column:
    return F.arrays_overlap(F.split(host, r"[.\-]"), F.array(*(F.lit(word) for word in words)))


def fit(labelled: DataFrame) -> tuple[DataFrame, GBTClassificationModel | None]:
    """Suffix statistics and trees from rows with features and a ``label`` of 0 or 1.

    The sample is drawn from different urls, a bounded number of each class, so a url with very
    many rows counts once. Without rows of both classes there are no trees.
    """
    stats = settle(labelled.groupBy("suffix_bucket").agg(
        F.sum("label").alias("bad"), F.count("*").alias("n")))
    total, bad = stats.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    shares = stats.select("suffix_bucket", ((F.col("bad") + bad / max(total, 1)) / (F.col("n") + 1))
                          .alias("suffix_share"))
    if not 0 < bad < total:
        return shares, None
    different = settle(with_shares(labelled, shares).groupBy("url", "label", *FEATURES).agg(F.count("*").alias("n")))
    sample = settle(reduce(DataFrame.unionAll, [
        different.where(F.col("label") == label).orderBy(F.xxhash64("url", F.lit("draw")), "url")
        .limit(SAMPLE_PER_CLASS).select("label", *FEATURES) for label in (0, 1)]))
    trees = GBTClassifier(labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=7, checkpointInterval=-1)
    return shares, trees.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample))


def with_shares(rows: DataFrame, shares: DataFrame) -> DataFrame:
    """Join statistics of at most ``SUFFIX_BUCKETS`` rows."""
    return rows.join(F.broadcast(shares), "suffix_bucket", "left").fillna(0.0, ["suffix_share"])


def judge(pages: DataFrame, id_column: str = "page_id", url_column: str = "url",
          rules=RULES, words=LISTED_WORDS, labels: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, block_probability.

    The verdict is that of the longest fitting rule, else ``block`` where the trees find a
    probability above one half. NULL urls and urls without ``://`` have an empty host and
    path and fit no rule. The trees learn from ``labels`` (url, label 0 or 1) where they are
    given, else from the pages themselves by the list of words. Without labelled urls of both classes what no rule covers is
    allowed, with a NULL probability. Ids are carried as they are; other columns are ignored;
    an empty table gives no rows.
    """
    rows = with_features(pages.select(F.col(id_column).alias("page_id"), F.col(url_column).cast("string").alias("url")))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict)
    is_listed = listed(F.col("host"), words)
    if labels is None:
        labelled = rows.where((F.col("host") != "") & (is_listed | F.coalesce(
            F.col("ruled") != "block", F.lit(True)))).withColumn("label", is_listed.cast("int"))
    else:
        labelled = with_features(labels.select(F.col("url").cast("string").alias("url"),
                                               F.col("label").cast("int").alias("label"))).where("label in (0, 1)")
    shares, trees = fit(labelled)
    scored = with_shares(rows, shares)
    if trees is None:
        scored = scored.withColumn("block_probability", F.lit(None).cast("double"))
    else:
        scored = trees.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(scored))
        scored = scored.withColumn("block_probability", vector_to_array("probability")[1])
    return scored.select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("block_probability") > 0.5, "block").otherwise("allow"))
        .alias("verdict"), "block_probability")


def op2_url_filter(spark, folder: str) -> DataFrame:
    return judge(table(spark, folder, "pages"))
