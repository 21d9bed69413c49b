"""URL rules and character models against a plain restatement."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import check_queries
import pytest
from pyspark.sql import functions as F

from corpus_spark.llm import url_filter
from corpus_spark.llm.queries import op11_url_filter


def plain_parse(url):
    rest = (url or "").partition("://")[2]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0]
    return host, path


def plain_rule(host, path, rules):
    fits = [rule for rule in rules if (host == rule.host or host.endswith("." + rule.host)) and path.startswith(rule.path)]
    return max(fits, key=lambda rule: len(rule.pattern), default=None)


class PlainModel:
    def __init__(self, urls, order, letters):
        self.counts, self.order, self.letters = defaultdict(Counter), order, letters
        for url in urls:
            for context, letter in plain_grams(url, order):
                for size in range(order + 1):
                    self.counts[context[order - size :]][letter] += 1

    def p(self, context, letter):
        shorter = self.p(context[1:], letter) if context else 1 / self.letters
        own = self.counts[context]
        n = sum(own.values())
        return (own[letter] + len(own) * shorter) / (n + len(own)) if n else shorter


def plain_grams(url, order):
    text = "\x02" * order + "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url or "") + "\x03"
    return [(text[at : at + order], text[at + order]) for at in range(len(text) - order)]


def plain(urls, rules, order):
    """url -> (host, path, rule, verdict, score)"""
    parsed = {url: plain_parse(url) for url in urls}
    ruled = {url: plain_rule(*parsed[url], rules) for url in parsed}
    half = {url: 0 if url is None else int(hashlib.md5(url.encode()).hexdigest()[0], 16) % 2 for url in parsed}
    letters = len({letter for url in parsed for _, letter in plain_grams(url, order)})
    models, known = {}, True
    for side in (0, 1):
        for action in ("allow", "block"):
            own = [url for url in parsed if half[url] == side and ruled[url] and ruled[url].action == action]
            known &= bool(own)
            models[action, side] = PlainModel(own, order, letters)
    scores = {}
    for url in parsed:
        grams = plain_grams(url, order)
        both = [round(sum(math.log(models["allow", side].p(*gram) / models["block", side].p(*gram)) for gram in grams) / len(grams), 6) for side in (0, 1)]
        scores[url] = both[1 - half[url]] if ruled[url] else sum(both) / 2
    means, spreads = {}, {}
    for action in ("allow", "block"):
        own = [scores[url] for url in parsed if ruled[url] and ruled[url].action == action]
        if known:
            means[action] = sum(own) / len(own)
            spreads[action] = math.sqrt(sum((score - means[action]) ** 2 for score in own) / len(own))
    if known:
        limit = round((means["allow"] * spreads["block"] + means["block"] * spreads["allow"]) / (spreads["allow"] + spreads["block"]), 6)
    found = {}
    for url in parsed:
        learnt = "allow" if not known or round(scores[url], 6) >= limit else "block"
        rule = ruled[url]
        found[url] = (*parsed[url], rule and rule.pattern, rule.action if rule else learnt, scores[url] if known else 0.0)
    return found


ODD = [
    None, "", "no scheme", "http://", "HTTP://A.NET", "http://a.net/", "http://a.net?x/", "http://net/", "http://xnet/", "http://a.b.Example.NET/en/x?y#z",
    "x://example.net/EN/", "http://example.com/de/ü\n/ö", "http://fr.org/fr/://net/", "http://ÄÖ.org/fr/", "http://𝒳.org/fr/𝒳", "http://u:p@h.net:80/", "http://h.org/fr/" + "a" * 5000,
]


def some_urls(seed, n):
    rng = random.Random(seed)
    words = ["casino", "win", "news", "blog", "Über", "shop", "a1"]
    return [
        f"http{rng.choice(['', 's'])}://{rng.choice(words)}{rng.randrange(9)}.{rng.choice(['example.net', 'example.com', 'b.org'])}/{rng.choice(['en', 'de', 'fr', 'es'])}/{rng.choice(words)}{rng.choice(['', '?p=1', '#t'])}"
        for _ in range(n)
    ]


@pytest.mark.parametrize("order", [0, 2, 4])
def test_judge_equals_plain(spark, order):
    urls = some_urls(order, 150) + ODD + ODD[:3] * 2
    df = spark.createDataFrame([(place, url, "x", 1) for place, url in enumerate(urls)], "page_id long, url string, Verdict string, of_url int")
    found = url_filter.judge(df, order=order)
    assert found.columns == ["page_id", "url", "of_url", "host", "path", "rule", "verdict", "score"]
    want = plain(urls, url_filter.RULES, order)
    rows = found.collect()
    assert len(rows) == len(urls)
    for row in rows:
        assert (row.host, row.path, row.rule, row.verdict) == want[row.url][:4], row
        assert abs(row.score - want[row.url][4]) < 2e-6
    assert url_filter.judge(df.limit(0)).count() == 0
    kept = url_filter.allowed(df, order=order)
    assert kept.columns == df.columns and sorted(row.page_id for row in kept.collect()) == sorted(row.page_id for row in rows if row.verdict == "allow")


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "http://a.net/"), (2, "http://b.com/"), (3, None)], "page_id long, url string")
    assert {row.page_id: row.verdict for row in url_filter.judge(df).collect()} == {1: "block", 2: "allow", 3: "allow"}


def test_models_find_what_rejected_urls_look_like(spark):
    rng = random.Random(5)
    urls = [f"http://{a}{i}.{tld}/{rng.choice('xyz')}" for i in range(60) for a, tld in (("casino", "net"), ("casino", "com"), ("garden", "org"), ("garden", "com"))]
    rules = (url_filter.Rule("block", "net"), url_filter.Rule("allow", "org/"))
    rows = url_filter.judge(spark.createDataFrame([(url,) for url in urls], "url string"), rules=rules).filter("rule IS NULL").collect()
    assert len(rows) == 120 and all((row.verdict == "block") == ("casino" in row.url) for row in rows)


def test_query_equals_sql(spark, small_dir):
    for folder in (small_dir, small_dir.replace("sf0.001", "sf0.01")):
        good, note = check_queries.compare(spark, check_queries.connect(folder), folder, "op11_url_filter")
        assert good, note


def test_plan_has_no_python(spark, small_dir):
    found = op11_url_filter(spark, small_dir)
    assert not any(word in found._jdf.queryExecution().toString() for word in ("Python", "Arrow", "Pandas"))
    assert found.filter(F.col("verdict").isNull()).count() == 0


def test_grams_are_not_broadcast_however_small_the_files_are(spark, monkeypatch):
    # Spark takes what is made of a file for as small as the file, and a URL makes a row of each of its characters: they are on the left.
    plans, written = [], url_filter.written
    monkeypatch.setattr(url_filter, "written", lambda df, *names: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df, *names))
    df = spark.createDataFrame([(url,) for url in some_urls(3, 100)], "url string")
    verdicts = {(row.url, row.verdict) for row in url_filter.judge(df).collect()}
    assert len(plans) == 3 and not any("BuildLeft" in plan for plan in plans)
    assert verdicts == {(url, found[3]) for url, found in plain({url for url, _ in verdicts}, url_filter.RULES, url_filter.ORDER).items()}
