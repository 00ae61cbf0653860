import re

import pytest

from octaray.llm.urls import RULES, Rule, judge_urls, rarest_token_index, host_path, url_tokens
from pyspark.sql import functions as F

URLS = [
    None, "", "no scheme/org/", "http://", "http://org", "http://org/", "HTTP://A.Example.ORG/es/x?y#z", "http://example.org/en/12", "http://notexample.org/es/",
    "http://x.com/fr/", "http://xcom/fr/", "ftp://com/de/1", "http://a.com/de", "http://a.com?/fr/", "a://b://org/", "http://a.org#/x", "http://É.com/fr/", "http://a.com/fr/" + "x" * 50_000, "http://x.com/fr/",
]


def by_hand(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best.verdict if best else "allow"


@pytest.mark.parametrize("inline", [1000, 0])
def test_rules(spark, inline):
    df = spark.createDataFrame([(i, u, "clash", "clash", "clash") for i, u in enumerate(URLS)], "page_id long, url string, host string, tokens string, best string")
    rules = (*RULES, Rule("block", "b", "/q/r"))
    got = sorted(map(tuple, judge_urls(df, rules=rules, inline_rules=inline).collect()))
    assert got == [(i, *by_hand(u, rules)) for i, u in enumerate(URLS)]
    assert judge_urls(df.limit(0), inline_rules=inline).count() == 0


def test_rules_are_filed_under_their_rarest_token(spark):
    df = spark.createDataFrame([("http://a.org/es/",)] * 3 + [("http://example.org/en/1",)], "url string")
    host, path = host_path(F.col("url"))
    index = rarest_token_index(df.select(url_tokens(host, path).alias("tokens")), RULES)
    assert {r.name: t for t, rs in index.items() for r in rs} == {"org/": "h:org", "example.org/es/": "h:example", "example.org/en/1": "h:example", "com/fr/": "h:com", "com/de/": "h:com"}
