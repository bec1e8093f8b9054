"""Mined verdicts against mining all token sets by hand, ties, repeated rows, long urls and clashing columns."""

import random
import time
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lumenframe.llm import urls

SCHEMA = "page_id long, url string"


def plain_rules(rows, min_support, min_confidence):
    """All antecedents of distinct (tokens, verdict) rows with their confidence and support."""
    n, whole, with_verdict = len(rows), Counter(), Counter()
    for tokens, verdict in rows:
        for k in range(1, len(tokens) + 1):
            for part in combinations(sorted(tokens), k):
                whole[part] += 1
                with_verdict[part, verdict] += 1
    return [(part, v, c / whole[part], c / n) for (part, v), c in with_verdict.items() if c / n >= min_support - 1e-12 and c / whole[part] >= min_confidence - 1e-12]


def judged_plainly(tokens, rules):
    fits = [(round(c, 9), round(s, 9), -len(p), v) for p, v, c, s in rules if set(p) <= set(tokens)]
    return max(fits)[3] if fits else None


def tokens_of(spark, rows):
    df = urls.split_url(spark.createDataFrame(rows, SCHEMA)).select("page_id", urls.tokens().alias("t"))
    return {r.page_id: r.t for r in df.collect()}


@pytest.fixture(scope="module")
def labelled():
    rows = [(f"https://shop{k % 4}.net/buy/item{k}?ref={k}", "block" if k % 4 < 2 else "allow") for k in range(40)]
    rows += [(f"https://wiki.net/page/{k}", "allow") for k in range(25)] + [(f"https://wiki.net/edit/{k}", "block") for k in range(25)]
    return rows + [("https://both.net/x", "allow"), ("https://both.net/x", "block")] + [("https://wiki.net/page/1", "allow")] * 500


def test_mined_verdicts_against_plain_mining(spark, labelled):
    pages = [(k, u) for k, u in enumerate(["https://shop0.net/buy/item7", "https://shop3.net/buy/item9?ref=1", "https://wiki.net/edit/9", "https://wiki.net/other", "https://new.net/", "https://shop1.net/sell?ref=2",
                                           "https://both.net/x", "https://x.net/page/5", "https://wiki.net/page/" + "9" * 5000, "https://shop0.net/buy/item7"])]
    distinct = sorted(set(labelled))
    known = tokens_of(spark, [(k, u) for k, (u, _) in enumerate(distinct)])
    rules = plain_rules([(known[k], v) for k, (_, v) in enumerate(distinct)], max(urls.MIN_SUPPORT, urls.MIN_COUNT / len(distinct)), urls.MIN_CONFIDENCE)
    own = tokens_of(spark, pages)
    df = spark.createDataFrame(pages, SCHEMA).withColumn("host", F.lit("clash")).withColumn("verdict", F.lit(1)).withColumn("tokens", F.lit(2))
    got = {r.page_id: r for r in urls.judged(df, rules=[], labels=spark.createDataFrame(labelled, "url string, verdict string")).collect()}
    assert len(got) == len(pages)
    for k, _ in pages:
        want = judged_plainly(own[k], rules)
        assert (got[k].verdict, got[k].by) == ((want, "mined") if want else (urls.DEFAULT, "default")), (pages[k], got[k])
    assert {got[0].verdict, got[1].verdict, got[2].verdict} == {"block", "allow"} and got[0].verdict == got[9].verdict


def test_the_sample_is_bounded_under_a_hot_url(spark, labelled, monkeypatch):
    seen, mined = [], urls.mined_rules
    monkeypatch.setattr(urls, "mined_rules", lambda rows, *a: seen.append(rows.count()) or mined(rows, *a))
    urls.judged(spark.createDataFrame([(1, "https://a.net/")], SCHEMA), rules=[], labels=spark.createDataFrame(labelled, "url string, verdict string"), max_labelled=40).count()
    assert 10 <= seen[0] <= 70


def test_deep_urls_are_mined_in_seconds(spark):
    """All subsets of forty tokens are 2**40: equal tokens are one, nested ones are cut to the most telling."""
    deep = [(f"https://a{k % 2}.net/" + "/".join(f"s{i}" for i in range(40)) + f"/{k}", "block" if k % 2 else "allow") for k in range(31)]
    nested = [(f"https://b.net/" + "/".join(f"{'x' if k % 2 else 'y'}{i}" for i in range(k)), "block" if k % 2 else "allow") for k in range(1, 41)]
    pages = [(1, "https://a1.net/s0/s1/new"), (2, "https://a0.net/s0"), (3, nested[30][0] + "/more"), (4, nested[31][0] + "/more"), (5, "https://c.net/")]
    began = time.time()
    got = {r.page_id: (r.verdict, r.by) for r in urls.judged(spark.createDataFrame(pages, SCHEMA), rules=[], labels=spark.createDataFrame(deep + nested, "url string, verdict string")).collect()}
    assert time.time() - began < 90
    assert got == {1: ("block", "mined"), 2: ("allow", "mined"), 3: ("block", "mined"), 4: ("allow", "mined"), 5: (urls.DEFAULT, "default")}


def test_cut_rules_are_counted_over_whole_urls(spark, labelled, monkeypatch):
    rows = spark.createDataFrame(sorted(set(labelled)), "url string, verdict string")
    df = urls.split_url(rows).select("url", urls.tokens().alias("tokens"), "verdict")
    classes = urls.token_classes(df, urls.MIN_COUNT)
    key = lambda r: (tuple(r.antecedent), r.verdict)
    whole = {key(r): (r.confidence, r.support) for r in urls.mined_rules(df, classes).collect()}
    monkeypatch.setattr(urls, "MOST_ITEMS", 2)
    cut = {key(r): (r.confidence, r.support) for r in urls.mined_rules(df, classes).collect()}
    assert cut and all(whole[k] == v for k, v in cut.items())


def test_rules_of_a_ninth_class_are_mined(spark):
    """Two tokens that say nothing alone and decide together, in urls with nine others that say a little each."""
    r = random.Random(5)
    labelled = []
    for k in range(96):
        u, v = k % 2, k // 2 % 2
        verdict = "block" if u == v else "allow"
        others = [f"d{j}" for j in range(9) if r.random() < (0.85 if verdict == "block" else 0.6)]
        labelled.append((f"https://a.net/{k}?" + "&".join([*others, *["u"] * u, *["v"] * v]), verdict))
    pages = [(1, "https://a.net/1?u&v"), (2, "https://a.net/2?u"), (3, "https://a.net/3?v&d1"), (4, "https://a.net/4?d1&d2&u&v"), (5, "https://a.net/5?d0&d1&d2&d3&d4&d5&d6&d7&d8&u&v")]
    known = tokens_of(spark, [(k, u) for k, (u, _) in enumerate(labelled)])
    rules = plain_rules([(known[k], v) for k, (_, v) in enumerate(labelled)], max(urls.MIN_SUPPORT, urls.MIN_COUNT / len(labelled)), urls.MIN_CONFIDENCE)
    own = tokens_of(spark, pages)
    got = {r.page_id: (r.verdict, r.by) for r in urls.judged(spark.createDataFrame(pages, SCHEMA), rules=[], labels=spark.createDataFrame(labelled, "url string, verdict string")).collect()}
    want = {k: judged_plainly(own[k], rules) for k, _ in pages}
    assert want[1] == "block" and got == {k: (v, "mined") if v else (urls.DEFAULT, "default") for k, v in want.items()}
