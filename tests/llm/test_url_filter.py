"""URL verdicts against a plain reading of the rules, with weak digests too."""

import re

import pytest

from newsprism.llm import queries, url_filter

SF = "/root/testdata/sf0.001"
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]
MORE = [*RULES, ("block", "COM", "/a"), ("allow", "b.org", ""), ("block", "b.org", "/x/y/"), ("block", "b.org", "/x/y"),
        ("allow", "b.org", "/x/yz"), ("block", "ü.de", "/ä"), ("allow", "dup.fr", "/q"), ("block", "dup.fr", "/q")]
URLS = ["http://example.com/en/1", "https://www.EXAMPLE.com/en/", "http://m.www.example.com/en/x?y", "http://example.com", None,
        "", "example.com/en/", "http://", "x://a.net/es/", "http://net/fr/a#b", "http://annet/fr/", "http://a.com?/en/",
        "http://.com/", "http://com./", "a://b://example.com/en/", "http://b.org", "http://z.b.org/x/yz", "http://b.org/x/y/1",
        "http://b.org/x/y", "http://a.ü.de/äö", "http://example.com:80/en/", "http://u@example.com/en/", "http://a.com/a",
        "http://" + "a." * 30_000 + "example.com/en/" + "x" * 50_000, "http://dup.fr/q", "http://a.com/\n/en", "http://example.com/en/1"]


def brute(url, rules, default="allow"):
    found = re.search("://([^/?#]*)([^?#]*)", url or "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in found[1]) if found else ""
    path = found[2] if found else ""
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in ((v, h.lower(), p) for v, h, p in rules)
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best[3] if best else None, best[4] if best else default)


def got(df):
    return sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in df.collect()), key=repr)


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", "r", "v") for i, u in urls], "page_id long, url string, host string, rule string, Url string")


@pytest.mark.parametrize("digest", [url_filter.xxh64, lambda key: len(key) % 3, lambda key: (1 << 64) - 1 - len(key)])
def test_verdicts(spark, digest):
    rows = [*enumerate(URLS), (None, URLS[0]), (0, URLS[0])]
    for rules in (RULES, MORE, []):
        table = url_filter.rule_table(spark, rules)
        found = got(url_filter.judge_urls(pages(spark, rows), table, digest=digest))
        assert found == sorted(((i, *brute(u, rules)) for i, u in rows), key=repr)


def test_whole_table_and_empty(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    found = got(queries.op11_url_filter(spark, SF))
    assert found == sorted(((r["page_id"], *brute(r["url"], RULES)) for r in rows), key=repr)
    assert {r[3] for r in found} >= {"com/", "example.com/en/"} and {r[4] for r in found} == {"allow", "block"}
    table = url_filter.rule_table(spark, RULES)
    assert url_filter.judge_urls(pages(spark, []), table).count() == 0
    blocked = url_filter.judge_urls(pages(spark, [(1, "ftp://other.org/")]), table, default="block").first()
    assert blocked["verdict"] == "block" and blocked["rule"] is None


def test_many_rules_by_binary_search(spark):
    rules = [("block" if i % 3 else "allow", f"h{i % 700}.site{i % 13}.org", f"/p{i}") for i in range(5000)]
    urls = [(i, f"https://x.h{i % 700}.site{i % 13}.org/p{i}{'/z' * (i % 3)}") for i in range(0, 6000, 7)]
    found = got(url_filter.judge_urls(pages(spark, urls), url_filter.rule_table(spark, rules)))
    by_site = {}
    for rule in rules:
        by_site.setdefault(rule[1], []).append(rule)
    assert found == sorted(((i, *brute(u, by_site.get(u.split("/")[2][2:], []))) for i, u in urls), key=repr)


@pytest.mark.parametrize("rule", [("maybe", "a.com", "/"), ("block", "", "/"), ("block", "a/b", ""), ("allow", "a.com", "x"),
                                  (None, "a.com", "/"), ("allow", None, "/")])
def test_what_is_no_rule(spark, rule):
    with pytest.raises(ValueError):
        url_filter.build_index(url_filter.rule_table(spark, [rule]))
