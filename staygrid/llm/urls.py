"""URL filter: rules by host and path, then boosted trees over lexical features.

Everything is a DataFrame expression or a JVM estimator; no Python runs on executors.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staygrid.llm.frames import least_by

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Rules become one expression, so there may be at most this many.
MOST_RULES = 1000
# Fixed values of the contract.
RULES = (
    ("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"),
)
# A URL whose host has one of these as a word is labelled unwanted, any other wanted.
UNWANTED_WORDS = (
    "ad", "ads", "adserver", "adult", "advert", "adverts", "banner", "banners", "bet", "bets", "bingo",
    "casino", "escort", "jackpot", "lottery", "malware", "phish", "pills", "poker", "popup", "popups", "porn",
    "sex", "slots", "spam", "track", "tracker", "tracking", "viagra", "warez", "win", "xxx",
)
# Trees are fitted on at most this many URLs of either label: those with the least hash.
URLS_PER_LABEL = 5000
TREES, DEPTH, SEED = 8, 3, 11
THRESHOLD = 0.5
# Added observations when the share of unwanted URLs under a suffix is taken.
PRIOR_WEIGHT = 20.0

FEATURES = (
    "url_chars", "host_chars", "path_chars", "depth", "host_labels", "hyphens", "digit_ratio",
    "host_digit_ratio", "entropy", "host_entropy", "parameters", "query_chars", "vowel_ratio",
    "suffix_share", "suffix_seen",
)


class UrlModel(NamedTuple):
    """Trees and suffix statistics; no trees if the labels were all alike."""

    trees: GBTClassificationModel | None
    share: float
    suffixes: DataFrame


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path; both empty for a null URL or one without ``://``."""
    mark = F.instr(url, "://")
    rest = F.when(mark > 0, F.substr(url, mark + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does.

    A rule ``host/path`` fits the host itself and its subdomains if the path starts with
    the rule's. Equal lengths are decided by the rule's text.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules fit into an expression")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def count_of(text: Column, symbols: str) -> Column:
    """How many characters of ``text`` are among ``symbols``."""
    return F.length(text) - F.length(F.translate(text, symbols, ""))


def entropy(text: Column) -> Column:
    """Bits per character over letters, digits, six marks and all others together."""
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    kinds = [*LOWER, *"0123456789", *"-._/=%"]

    def add(total: Column, count: Column) -> Column:
        return total - F.when(count > 0, count / size * F.log2(count / size)).otherwise(0.0)

    # One short expression over the list of kinds; written out it would outgrow a method.
    each = F.aggregate(
        F.array(*map(F.lit, kinds)), F.lit(0.0),
        lambda total, kind: add(total, F.length(text) - F.length(F.replace(text, kind, F.lit("")))),
    )
    return add(each, F.length(F.translate(text, "".join(kinds), "")))


def with_features(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, path, suffix and the lexical features; a missing URL has zeros."""
    host, path = host_and_path(F.col(url).cast("string"))
    text = F.translate(F.coalesce(F.col(url).cast("string"), F.lit("")), UPPER, LOWER)
    rows = urls.withColumn("host", host).withColumn("path", path).withColumn("_url", text)
    query = F.regexp_extract("_url", r"^[^?#]*\?([^#]*)", 1)
    size, host_size = (F.greatest(F.length(c), F.lit(1)) for c in ("_url", "host"))
    labels = F.size(F.split("host", r"\."))
    return rows.withColumns(
        {
            "suffix": F.substring_index("host", ".", -1),
            "url_chars": F.length("_url").cast("double"),
            "host_chars": F.length("host").cast("double"),
            "path_chars": F.length("path").cast("double"),
            "depth": count_of(F.col("path"), "/").cast("double"),
            "host_labels": labels.cast("double"),
            "hyphens": count_of(F.col("host"), "-").cast("double"),
            "digit_ratio": count_of(F.col("_url"), "0123456789") / size,
            "host_digit_ratio": count_of(F.col("host"), "0123456789") / host_size,
            "entropy": entropy(F.col("_url")),
            "host_entropy": entropy(F.col("host")),
            "parameters": F.when(F.length(query) > 0, count_of(query, "&") + 1).otherwise(0).cast("double"),
            "query_chars": F.length(query).cast("double"),
            "vowel_ratio": count_of(F.col("host"), "aeiou") / host_size,
        }
    )


def by_unwanted_words(urls: DataFrame, url: str = "url") -> DataFrame:
    """(url, label): 1 for hosts with a listed word, 0 for others; no row without a host."""
    host, _ = host_and_path(F.col(url).cast("string"))
    words = F.split(host, r"[^a-z0-9]+")
    listed = F.array(*map(F.lit, UNWANTED_WORDS))
    return urls.where(F.length(host) > 0).select(
        F.col(url).cast("string").alias("url"), F.arrays_overlap(words, listed).cast("double").alias("label")
    )


def train(labelled: DataFrame, per_label: int = URLS_PER_LABEL) -> UrlModel:
    """Fit trees on at most ``per_label`` distinct URLs of either label.

    ``labelled`` has ``url`` and ``label`` (1 unwanted, 0 wanted); other labels and null
    URLs are left aside, a URL with both counts as unwanted. Which URLs are taken depends
    on their hash only. Jobs run here.
    """
    rows = (
        labelled.where(F.col("label").isin(0, 1) & F.col("url").isNotNull())
        .groupBy("url").agg(F.max("label").cast("double").alias("label"))
        .withColumn("turn", F.xxhash64("url"))
    )
    taken = least_by(rows.where("label = 1"), "turn", per_label).unionByName(
        least_by(rows.where("label = 0"), "turn", per_label)
    ).drop("turn")
    featured = with_features(taken).persist()
    try:
        total, unwanted = featured.agg(F.count(F.lit(1)), F.sum("label")).first()
        share = (unwanted or 0.0) / total if total else 0.0
        counts = featured.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("bad"))
        # As many rows as the sample has suffixes, at most 2 * per_label.
        found = [(r["suffix"], float((r["bad"] + PRIOR_WEIGHT * share) / (r["n"] + PRIOR_WEIGHT)), float(r["n"]))
                 for r in counts.orderBy("suffix").collect()]
        suffixes = labelled.sparkSession.createDataFrame(
            found, "suffix string, suffix_share double, suffix_seen double"
        )
        if not 0 < share < 1:
            return UrlModel(None, share, suffixes)
        ready = assembled(featured, suffixes, share)
        trees = GBTClassifier(
            labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=SEED, stepSize=0.3, maxBins=32
        ).fit(ready.select("features", "label"))
        return UrlModel(trees, share, suffixes)
    finally:
        featured.unpersist()


def assembled(rows: DataFrame, suffixes: DataFrame, share: float) -> DataFrame:
    joined = rows.join(F.broadcast(suffixes), "suffix", "left").fillna(
        {"suffix_share": share, "suffix_seen": 0.0}
    )
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(joined)


def judge(
    pages: DataFrame, model: UrlModel, rules: Sequence[tuple[str, str]] = RULES, threshold: float = THRESHOLD
) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of ``pages``.

    The longest rule that fits decides; else the URL is blocked if its score reaches the
    threshold. A null URL or one without ``://`` has an empty host and path, fits no rule
    and is scored on what it has (a null URL as an empty one). Repeated rows are kept, a
    null page_id stays null, no rows give no rows, other columns are not read. A very long
    URL is read whole; a score at the threshold is blocked. Nothing is
    shuffled: the suffix statistics are bounded by the training sample and broadcast.
    """
    rows = with_features(pages.select(F.col("page_id").cast("long").alias("page_id"), "url"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    if model.trees is None:
        scored = rows.withColumn("score", F.lit(float(model.share)))
    else:
        scored = model.trees.transform(assembled(rows, model.suffixes, model.share)).withColumn(
            "score", vector_to_array("probability")[1]
        )
    learned = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "score"
    )
