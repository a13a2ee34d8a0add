"""Rules and reputations of hosts against plain loops, and the query against its SQL."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from check import compare, connect
from evidentia.llm import url_reputation as urls
from evidentia.llm.queries import BAD_LIMIT, DEVIATIONS, REG, SUFFIXES, URL_RULES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ODD = [
    None, "", "no scheme", "http://", "http://Ex.Example.ORG/es/1", "https://a.example.org/en/12?x=1", "https://example.org", "https://EXAMPLE.org/en/2#t", "x://y://z/en/3",
    "https://notexample.org/es/1", "https://org/a", "https://ÄÖ.com/de/5", "http://a.com/fr/7/", "http://com/de/9", "http://user@a.com:80/de/1", "http://1.2.3.4/en/5", "http://a.b.c.example.net/de/3?u=http://b.org/es/",
    "http://x.com\n/de/4", "http://trailing./en/3", "http://a.com/de/99999999999999999999999",
]


def split(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    if not m:
        return "", ""
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]


def rule_of(host, path):
    best = None
    for rule, verdict in URL_RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return best


def suffix(host):
    if re.fullmatch(r"[0-9.]+", host):
        return ""
    fits = [s for s in SUFFIXES if host == s or host.endswith("." + s)]
    return max(fits, key=len) if fits else host.rsplit(".", 1)[-1]


def domain(host):
    s = suffix(host)
    return host if s in ("", host) else host[: -len(s) - 1].rsplit(".", 1)[-1] + "." + s


def shrink(groups, center):
    """``{key: (a, b)}`` of groups ``{key: (n, x)}`` with the prior means ``center``."""
    live = [(n, x, center[k]) for k, (n, x) in groups.items() if n]
    scale = sum(n * (n - 1) * m * (1 - m) for n, _, m in live)
    over = sum((x - n * m) ** 2 - n * m * (1 - m) for n, x, m in live)
    k0 = 1 / (min(max(over / scale, urls.LEAST_SPREAD), urls.MOST_SPREAD) if scale else urls.UNKNOWN_SPREAD) - 1
    return {k: (k0 * center[k] + x, k0 * (1 - center[k]) + n - x) for k, (n, x) in groups.items()}


def brute(pages, labels):
    bad = {}
    for i, quality, toxic in labels:
        if i is not None and (quality is not None or toxic is not None):
            bad[i] = bad.get(i, False) or quality == 0 or toxic == 1
    hosts = {}
    for _, url in pages:
        host, path = split(url)
        n, x = hosts.get(host, (0, 0))
        m = re.search(r"([0-9]+)[^0-9/]*/?$", path)
        if m and int(m[1]) in bad:
            n, x = n + 1, x + bad[int(m[1])]
        hosts[host] = (n, x)
    add = lambda of: {k: tuple(sum(v[i] for h, v in hosts.items() if of(h) == k) for i in (0, 1)) for k in {of(h) for h in hosts}}
    n, x = (sum(v[i] for v in hosts.values()) for i in (0, 1))
    mean = lambda post: {k: a / (a + b) for k, (a, b) in post.items()}
    suffixes = add(suffix)
    means = mean(shrink(suffixes, {k: x / n if n else 0.0 for k in suffixes}))
    domains = add(domain)
    home = {domain(h): suffix(h) for h in hosts}
    means = mean(shrink(domains, {k: means[home[k]] for k in domains}))
    post = shrink(hosts, {h: means[domain(h)] for h in hosts})
    out = []
    for i, url in pages:
        host, path = split(url)
        a, b = post[host]
        share = a / (a + b)
        least = share - DEVIATIONS * (share * (1 - share) / (a + b + 1)) ** 0.5
        rule = rule_of(host, path)
        out.append((i, host, path, rule and rule[0], rule[1] if rule else ("block" if least > BAD_LIMIT else "allow"), *hosts[host], round(share, 6), round(least, 6)))
    return out


def tables(spark, pages, labels):
    frame = spark.createDataFrame([(i, u, None, 1) for i, u in pages], "page_id bigint, url string, html string, bad int").withColumn("verdict", F.lit(None).cast("string"))
    return frame, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def judged(spark, pages, labels):
    return urls.judge_urls(*tables(spark, pages, labels), URL_RULES, SUFFIXES, BAD_LIMIT, DEVIATIONS)


def same(got, expected):
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r[:5])
    got, expected = sorted(map(tuple, got), key=key), sorted(expected, key=key)
    assert [r[:7] for r in got] == [r[:7] for r in expected]
    assert all(abs(a - b) <= 2e-6 for r, e in zip(got, expected) for a, b in zip(r[7:], e[7:]))


def planted():
    """Bad hosts of several sizes below good and bad domains; one host holds a third of all pages."""
    rng = random.Random(1)
    hosts = [("big.example.net", 0.1, 400), ("spam.shop.net", 0.95, 60), ("other.shop.net", 0.9, 2), ("good.shop.net", 0.0, 40), ("tiny.net", 1.0, 1), ("www.fine.net", 0.2, 200), ("spam.example.net", 0.8, 300)]
    pages, labels = [], []
    for host, share, n in hosts:
        for _ in range(n):
            i = len(pages)
            pages.append((i, f"https://{host}/en/{i}.html"))
            if rng.random() < 0.7:
                labels.append((i, 1, 0) if rng.random() >= share else rng.choice([(i, 0, 0), (i, 1, 1), (i, 0, None)]))
    return pages, labels


def test_reputation(spark):
    pages, labels = planted()
    got = judged(spark, pages, labels).collect()
    same(got, brute(pages, labels))
    blocked = {r.host for r in got if r.verdict == "block"}
    assert blocked == {"spam.shop.net", "spam.example.net"}


def test_odd_rows(spark):
    pages = [(i if i % 5 else None, u) for i, u in enumerate(ODD)] + [(3, ODD[4]), (3, ODD[4])]
    labels = [(None, 0, 1), (1, 0, None), (1, 1, 0), (12, None, None), (5, None, 1), (3, 1, None), (7, 1, 0), (9, 0, 0)]
    same(judged(spark, pages, labels).collect(), brute(pages, labels))
    same(judged(spark, pages, []).collect(), brute(pages, []))
    assert judged(spark, [], labels).count() == 0


def test_longest_rule_wins(spark):
    got = {r.page_id: (r.rule, r.verdict) for r in judged(spark, [(0, "http://a.example.org/es/1"), (1, "http://example.org/en/1x"), (2, "http://example.org/en/2"), (3, "http://example.org"), (4, "http://xcom/de/1")], []).collect()}
    assert got == {0: ("example.org/es/", "block"), 1: ("example.org/en/1", "block"), 2: ("org/", "allow"), 3: (None, "allow"), 4: (None, "allow")}


def test_main_path_is_native(spark):
    pages, labels = planted()
    plan = judged(spark, pages, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_against_sql(spark):
    rows, _, problem = compare(spark, connect(SF), REG.queries["op13_host_reputation"], REG.sql["op13_host_reputation"], SF)
    assert problem is None and rows > 0
