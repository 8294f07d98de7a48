from __future__ import annotations

from corollary.llm import aliases
from corollary.llm.queries import RULES

SCHEMA = "page_id long, url string, html string, host string, rule int"


def link(target):
    return f'<head><link href="{target}" class=x rel="canonical"></head>'


def judged(spark, rows, **options):
    frame = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], SCHEMA)
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in aliases.judge_urls(frame, RULES, **options).collect()}


def test_rules(spark):
    got = judged(spark, [
        (1, "http://A.Example.NET/de/x?y#z", None), (2, "https://example.net/en/", ""), (3, "https://notexample.com/de/", ""), (4, "http://m.example.com/de/1", ""),
        (5, "http://x.org/fr/", ""), (6, None, None), (7, "no scheme/net", ""), (8, "ftp://host", ""), (9, "http://ÄB.net?q", ""), (10, "", ""), (11, "http://net/", ""),
    ])
    assert got == {
        1: ("a.example.net", "/de/x", "net/", "block"), 2: ("example.net", "/en/", "example.net/en/", "allow"), 3: ("notexample.com", "/de/", None, "allow"),
        4: ("m.example.com", "/de/1", "example.com/de/", "block"), 5: ("x.org", "/fr/", "org/fr/", "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"),
        8: ("host", "", None, "allow"), 9: ("Äb.net", "", None, "allow"), 10: ("", "", None, "allow"), 11: ("net", "/", "net/", "block"),
    }


def test_decisions_spread_over_links(spark):
    got = judged(spark, [
        (1, "http://a.com/1", link("http://b.com/2")), (2, "http://b.com/2#f", '<META http-equiv=refresh content="0; URL=/3">'), (3, "https://b.com/3", link("//bad.net/")),
        (4, "http://c.com/", link("x/y")), (5, "http://c.com/x/y", link("http://bad.net/?a=1&amp;b=2")), (6, "http://d.com/", link("http://bad.net/?a=1&b=2")),
        (7, "http://e.com/q", link("http://example.net/en/ok")), (8, "http://f.com/", link("http://example.net/en/ok")), (9, "http://example.net/en/ok", link("http://worse.net/")),
        (10, "http://z.com/", link("http://y.com/")), (11, "http://a.com/1", None),
    ])
    assert {k: v[3] for k, v in got.items()} == {
        1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "block", 7: "allow", 8: "allow", 9: "allow", 10: "allow", 11: "block",
    }
    more = spark.createDataFrame([("http://y.com/", "http://bad.net/z"), (None, "http://a.com/")], "source string, target string")
    assert judged(spark, [(10, "http://z.com/", link("http://y.com/"))], redirects=more)[10][3] == "block"


def test_long_chain_and_empty(spark):
    n = 60
    rows = [(i, f"http://h.com/{i}", link(f"http://h.com/{i + 1}") if i < n else link("http://bad.net/")) for i in range(n + 1)]
    assert {v[3] for v in judged(spark, rows).values()} == {"block"}
    assert aliases.judge_urls(spark.createDataFrame([], SCHEMA), RULES).count() == 0
