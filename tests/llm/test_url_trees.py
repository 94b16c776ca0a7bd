"""Operator 4: host and path by hand, rules by brute force, and held-out accuracy of the trees."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskflow.llm import url_trees as U
from riskflow.llm.queries import URL_RULES


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    tail = rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:end]


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else None


URLS = ["http://A.Example.ORG/es/1?x=1", "https://example.org/en/12", "example.org/es/", None, "", "http://", "http://x.com", "http://x.com/fr/1#t", "x://y://z/de/",
        "http://shop.com/de/a?b#c", "http://notexample.org/es/", "http://org", "http://org/", "http://a.org?x=/es/", "http://É.org/é\n/x", "http://x.net/" + "a" * 50_000, "http://x.com/fr/1#t"]


@pytest.fixture(scope="module")
def judged(spark):
    df = spark.createDataFrame([(i, u, "c", 1, "s") for i, u in enumerate(URLS)], "page_id long, url string, html string, label int, host string")
    return {r["page_id"]: r for r in U.judge(df, URL_RULES).collect()}


def test_rules(judged):
    assert len(judged) == len(URLS)
    for i, url in enumerate(URLS):
        host, path = split(url)
        assert (judged[i]["host"], judged[i]["path"]) == (host, path), url
        want = rule(host, path)
        assert judged[i]["rule"] == (want[0] if want else None)
        assert judged[i]["verdict"] in ("allow", "block") and (not want or judged[i]["verdict"] == want[1])


def test_empty_and_one_class(spark):
    schema = "page_id long, url string"
    assert U.judge(spark.createDataFrame([], schema), URL_RULES).count() == 0
    only = U.judge(spark.createDataFrame([(1, "http://x.com/de/1"), (2, "http://y.net/")], schema), URL_RULES).collect()
    assert {r["page_id"]: r["verdict"] for r in only} == {1: "block", 2: "block"}


def test_held_out_accuracy(spark):
    rng = random.Random(6)

    def url(bad):
        name = "".join(rng.choice("abcdefghij0123456789" if bad else "abcdefghij") for _ in range(rng.randint(14, 22) if bad else rng.randint(4, 9)))
        query = "?" + "&".join(f"p{i}={rng.randint(0, 9999)}" for i in range(rng.randint(2, 5))) if bad else ""
        return f"http://{name}.{'biz' if bad else 'info'}/{'x-' * rng.randint(1, 3) if bad else 'page'}{query}"

    rows = [(i, url(i % 2), i % 2) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, url string, y int").withColumns({"host": U.host_of(F.col("url")), "path": U.path_of(F.col("url"))})
    featured = U.with_suffix_statistics(U.with_features(df.withColumn("label", F.when(F.col("id") % 4 != 0, F.col("y")).when(F.col("id") % 8 == 0, F.lit(None)))))
    model = U.train(featured.where("id % 4 <> 0"))
    out = model.transform(U.assembler().transform(featured.where("id % 4 = 0")))
    assert out.where("prediction = y").count() / out.count() > 0.95


def test_entropy_is_bits_per_character(spark):
    rng = random.Random(8)
    texts = ["", "a", "aaaa", "ab", "é😀é😀ab"] + ["".join(rng.choice("abc/.é1") for _ in range(rng.randint(1, 80))) for _ in range(100)] + ["xy" * 100_000]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", U.entropy(F.col("t")).alias("e")).collect()
    for r in got:
        t = texts[r["i"]]
        want = -sum(k / len(t) * math.log2(k / len(t)) for k in Counter(t).values())
        assert abs(r["e"] - want) < 1e-9


def test_shares_leave_out_the_own_fold(spark):
    rng = random.Random(12)
    rows = [(f"https://h{i}.{rng.choice(['com', 'net'])}/{rng.choice('ab')}/{i}", rng.choice([0, 1, None])) for i in range(400)]
    frame = spark.createDataFrame(rows, "url string, label int").withColumns({"host": U.host_of(F.col("url")), "path": U.path_of(F.col("url"))})
    got = U.with_suffix_statistics(U.with_features(frame)).withColumn("part", F.pmod(F.xxhash64("url"), F.lit(U.FOLDS))).collect()
    assert len(got) == len(rows)
    known = [r for r in got if r["label"] is not None]
    overall = sum(r["label"] for r in known) / len(known)
    for r in got:
        others = [k for k in known if r["label"] is None or k["part"] != r["part"]]
        for key, column, least in (("suffix", "suffix_blocked", 0), ("segment", "segment_blocked", U.MIN_LABELLED)):
            labels = [k["label"] for k in others if k[key] == r[key]]
            want = (sum(labels) + U.SMOOTHING * overall) / (len(labels) + U.SMOOTHING) if len(labels) >= least else overall
            assert abs(r[column] - want) < 1e-9
