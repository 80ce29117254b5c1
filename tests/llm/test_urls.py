import math
import random
from collections import Counter

import pytest
from samples import SMALL

from staygrid.llm import catalog, urls

ODD = [
    (1, None), (2, ""), (3, "no-scheme.example.net/en/x"), (4, "http://EXAMPLE.Net/en/a?b=1#c"),
    (5, "https://a.example.net/en/"), (6, "https://example.net/en"), (7, "http://notexample.net/en/x"),
    (8, "http://example.com/de/x/y"), (9, "http://sub.example.com/DE/x"), (10, "http://x.org/fr/"),
    (11, "http://org/fr/x"), (12, "http://a.net"), (13, "http://a.net/"), (14, "http://u@h.com:80/p?x://y"),
    (15, "a://b://c.net/d"), (16, "http://Ä.NET/x"), (17, "http://x.com#f?/g"), (18, "http:///only/path"),
    (None, "http://a.net/"), (12, "http://a.net"), (19, "http://" + "a" * 5000 + ".com/" + "b/" * 5000 + "?" + "q=1&" * 3000),
]
LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min((tail.find(c) for c in "?#" if c in tail), default=len(tail))
    return host.translate(LOWER), tail[:end]


def plain_rule(host, path):
    fitting = []
    for what, rule in urls.RULES:
        name, slash, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + tail):
            fitting.append((len(rule), rule, what))
    return max(fitting)[1:] if fitting else (None, None)


def table(spark, rows):
    schema = "page_id long, url string, html string, host string, features string, score string, suffix string"
    return spark.createDataFrame([(*r, None, "x", "x", "x", "x") for r in rows], schema)


@pytest.fixture(scope="module")
def model(spark):
    return urls.train(urls.by_unwanted_words(spark.read.parquet(f"{SMALL}/pages.parquet")))


def test_parts_and_rules(spark, model):
    got = urls.judge(table(spark, ODD), model).collect()
    want = Counter()
    for page, url in ODD:
        host, path = plain_parts(url)
        rule, verdict = plain_rule(host, path)
        want[page, host, path, rule, verdict] += 1
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in got) == want
    assert {r.verdict for r in got} <= {"allow", "block"}
    assert urls.judge(table(spark, []), model).collect() == []


def test_longest_rule_wins(spark):
    rules = [("block", "b.com/"), ("allow", "b.com/x"), ("block", "a.b.com/x/y"), ("allow", "com/x/y/zzzz")]
    rows = [(1, "http://b.com/x/y"), (2, "http://a.b.com/x/y/zzzz"), (3, "http://b.com/w"), (4, "http://c.com/x/y/zzzz")]
    none = urls.UrlModel(None, 0.0, spark.createDataFrame([], "suffix string, suffix_share double, suffix_seen double"))
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(table(spark, rows), none, rules).collect()}
    assert got == {
        1: ("b.com/x", "allow"), 2: ("com/x/y/zzzz", "allow"), 3: ("b.com/", "block"), 4: ("com/x/y/zzzz", "allow")}
    with pytest.raises(ValueError):
        urls.judge(table(spark, rows), none, [("block", f"h{k}/") for k in range(urls.MOST_RULES + 1)])


def test_features_against_plain_counting(spark):
    rows = urls.with_features(table(spark, ODD).select("page_id", "url")).collect()
    for r in rows:
        text = (r.url or "").translate(LOWER)
        host, path = plain_parts(r.url)
        assert (r.url_chars, r.host_chars, r.depth) == (len(text), len(host), path.count("/"))
        kinds = Counter(c if c in "abcdefghijklmnopqrstuvwxyz0123456789-._/=%" else "other" for c in text)
        bits = -sum(n / len(text) * math.log2(n / len(text)) for n in kinds.values()) if text else 0.0
        assert abs(r.entropy - bits) < 1e-9
        query = text.split("#")[0].split("?", 1)[1] if "?" in text.split("#")[0] else ""
        assert r.parameters == (query.count("&") + 1 if query else 0)


def test_held_out_accuracy(spark):
    labelled = urls.by_unwanted_words(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"))
    from pyspark.sql import functions as F

    apart = F.pmod(F.xxhash64(F.lit("test"), "url"), F.lit(3)) == 0
    model = urls.train(labelled.where(~apart))
    tested = labelled.where(apart).withColumn("page_id", F.lit(1))
    assert tested.where("label = 1").count() > 20
    scored = urls.judge(tested, model, rules=[]).select(
        "host", (F.col("score") >= 0.5).cast("double").alias("said")
    )
    truth = urls.by_unwanted_words(tested.select("url"))
    hosts = truth.select(urls.host_and_path(F.col("url"))[0].alias("host"), "label").distinct()
    right = scored.join(hosts, "host").agg(F.avg((F.col("said") == F.col("label")).cast("double"))).first()[0]
    assert right > 0.95


def test_alike_and_missing_labels(spark):
    schema = "url string, label double"
    only = urls.train(spark.createDataFrame([("http://a.com/", 1.0), (None, 0.0)], schema))
    assert only.trees is None and only.share == 1.0
    assert urls.train(spark.createDataFrame([], schema)).share == 0.0


def test_no_python_in_the_plan(spark):
    plan = catalog.op6_url_filters(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    for name in ("Python", "Pandas", "Arrow"):
        assert name not in plan


def test_which_urls_are_taken_does_not_depend_on_their_order(spark):
    turn = random.Random(1)
    rows = [(f"http://h{k}.com/{'9' * (k % 7)}", float(k % 7 > 3)) for k in range(300)]
    a = urls.train(spark.createDataFrame(rows, "url string, label double"), 50)
    turn.shuffle(rows)
    b = urls.train(spark.createDataFrame(rows, "url string, label double").repartition(5), 50)
    assert a.share == b.share and sorted(a.suffixes.collect()) == sorted(b.suffixes.collect())
