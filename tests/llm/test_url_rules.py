"""URL filters: listed rules by string work, mined rules by all combinations."""

from __future__ import annotations

import random
import re
from itertools import combinations

import pytest

from lumenarc.llm import url_rules
from lumenarc.llm.queries import URL_RULES, op13_url_filters

ODD = [None, "", "no scheme", "://", "http://", "HTTP://Example.ORG/es/x?q=1#f", "http://a.example.org/en/12", "http://example.org", "http://notexample.org/es/", "http://Ä.COM/fr/a", "https://com/de/", "x://b.com/de/y?z=/fr/",
       "http://c.com/d", "http://org./x", "http://a..org/x", "http://h.org#/x", "http://h.org?/x", "a://b://c.org/z", "http://u@v.com:80/fr/", "http://" + "a." * 3000 + "com/de/" + "w/1-" * 9000]


def place(url):
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def fits(url, rules):
    host, path = place(url)
    found = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(found)[1:] if found else (None, None)


def mined(rows, min_support, min_confidence, min_urls):
    rows = [(frozenset(t), label) for t, label in rows if label is not None]
    n = len(rows)
    support = max(min_support, min_urls / max(n, 1))
    by_rows = {}
    for token in sorted({t for tokens, _ in rows for t in tokens}, reverse=True):
        held = frozenset(k for k, (tokens, _) in enumerate(rows) if token in tokens)
        if support * n <= len(held) < n:
            by_rows[held] = token
    tokens = sorted(by_rows.values())
    out = {}
    for size in range(1, len(tokens) + 1):
        for items in combinations(tokens, size):
            mine = [label for held, label in rows if held.issuperset(items)]
            for label in set(mine):
                c = mine.count(label)
                if c >= support * n and c / len(mine) >= min_confidence:
                    out[items, label] = (c / len(mine), c / n)
    return {(i, label): v for (i, label), v in out.items() if not any(((*i[:k], *i[k + 1 :]), label) in out and out[(*i[:k], *i[k + 1 :]), label][0] >= v[0] for k in range(len(i)))}


@pytest.fixture(scope="module")
def pages(spark):
    def make(urls):
        rows = [(k // 2, u, "h", 1, "r", "a", "t") for k, u in enumerate(urls)]
        return spark.createDataFrame(rows, "page_id long, url string, html string, row int, rule string, label string, tokens string")

    return make


def rules_of(spark, rules):
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def test_listed_rules(spark, pages):
    rules = [*URL_RULES, ("a.example.org", "/en/12", "allow"), ("net", "", "block")]
    urls = [*ODD, "ftp://x.net", "ftp://x.net/a", *ODD[5:8]]
    got = url_rules.judge(pages(urls), rules_of(spark, rules), min_support=2.0).collect()
    want = [(k // 2, *place(u), fits(u, rules)[0], fits(u, rules)[1] or "allow", None) for k, u in enumerate(urls)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def sample(seed, n=160):
    r = random.Random(seed)
    tokens = [(f"{r.choice('ab')}{r.choice('.x')}", r.choice(("en", "de", "fr")), r.choice(("shop", "news", "wiki")), r.choice(("1", "22"))) for _ in range(n)]
    rows = [([*t, "all", "twin-" + t[1]], ("block" if t[1] == "de" and t[2] == "shop" or r.random() < 0.05 else "allow") if r.random() < 0.9 else None) for t in tokens]
    return [*rows, ([], "allow"), ([], None), (["all"], "block")]


@pytest.mark.parametrize("seed,support,confidence,least", [(1, 0.02, 0.9, 5), (2, 0.002, 0.7, 3), (3, 0.1, 1.0, 5)])
def test_mined_rules_are_all_combinations(spark, seed, support, confidence, least):
    rows = sample(seed)
    got = url_rules.mine_rules(spark.createDataFrame(rows, "tokens array<string>, label string"), support, confidence, least).collect()
    want = mined(rows, support, confidence, least)
    assert want and {(tuple(r.rule_tokens), r.label) for r in got} == set(want) and len(got) == len(want)
    assert all((r.confidence, r.support) == pytest.approx(want[tuple(r.rule_tokens), r.label]) for r in got)


@pytest.mark.parametrize("limit", [100_000, 0])
def test_index_finds_the_strongest_rule(spark, monkeypatch, limit):
    monkeypatch.setattr(url_rules, "BROADCAST_ROWS", limit)
    rows = sample(4)
    rules = mined(rows, 0.002, 0.6, 2)
    table = spark.createDataFrame([(list(i), label, *v) for (i, label), v in rules.items()], "rule_tokens array<string>, label string, confidence double, support double")
    urls = [(k, t) for k, (t, _) in enumerate(sample(5))]
    got = {r.row: (r.confidence, tuple(r.rule_tokens), r.label) for r in url_rules.match_rules(spark.createDataFrame(urls, "row long, tokens array<string>"), table).collect()}
    want = {}
    for k, tokens in urls:
        held = [(v[0], v[1], len(i), list(i), label) for (i, label), v in rules.items() if set(i) <= set(tokens)]
        if held:
            best = max(held)
            want[k] = (best[0], tuple(best[3]), best[4])
    assert got == want and len(want) > 50


def test_tables_that_give_nothing(spark, pages):
    rules = rules_of(spark, URL_RULES)
    assert url_rules.judge(pages([]), rules).count() == 0
    assert {r.verdict for r in url_rules.judge(pages(["http://x.net/1", None]), rules).collect()} == {"allow"}
    none = rules_of(spark, [("x", "/", "block")]).where("false")
    assert {(r.rule, r.verdict) for r in url_rules.judge(pages(["http://x.org/1"] * 9), none).collect()} == {(None, "allow")}


def test_the_query_runs_no_python(spark, pages, tmp_path):
    urls = [f"http://h{k % 7}.example.{('com', 'org', 'net')[k % 3]}/{('de', 'fr', 'en', 'es')[k % 4]}/{k}" for k in range(400)]
    pages(urls).write.parquet(str(tmp_path / "pages.parquet"))
    df = op13_url_filters(spark, str(tmp_path))
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
    got = {(r.host, r.path): r for r in df.collect()}
    assert len(got) == 400 and {r.verdict for r in got.values() if r.host.endswith(".net") and r.path.startswith("/fr/")} == {"allow"}
    assert any(r.verdict == "block" and r.rule is None for r in got.values())
