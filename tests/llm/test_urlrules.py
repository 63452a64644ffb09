from __future__ import annotations

import random
import re

import pytest

from vesselspark.llm.queries import URL_RULES
from vesselspark.llm.urlrules import judge

MORE = [("a.b.net", "/x/", "allow"), ("b.net", "/", "block"), ("net", "/x", "block"), ("b.net", "/x/y", "allow"), ("b.net", "/x/y", "block"),
        ("org", "", "block"), ("", "/", "block"), (None, "/", "block"), ("COM", "/z", "block")]


def plain(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = re.sub("[A-Z]+", lambda x: x[0].lower(), m[1]) if m else ""
    path = m[2] if m else ""
    fit = [(len(h), len(p), h.lower() + p, a) for h, p, a in rules if h and p is not None and a
           and ("." + host).endswith("." + h.lower()) and path.startswith(p)]
    if not fit:
        return host, path, None, "allow"
    top = max(f[:2] for f in fit)
    return (host, path, *min(f[2:] for f in fit if f[:2] == top))


@pytest.mark.parametrize("rules", [URL_RULES, URL_RULES + MORE])
@pytest.mark.parametrize("max_rules", [1000, 0])
def test_matches_trying_every_rule(spark, rules, max_rules):
    rnd = random.Random(3)
    urls = [None, "", "no scheme", "http://", "http://NET/", "ftp://x.org", "http://a\n.net/x/", "://b.net/x/yz?://c", "http://a.b.net//x/", "http://..net/"]
    for _ in range(400):
        host = ".".join(rnd.choices(["a", "b", "net", "www", "xnet"], k=rnd.randint(0, 3)) + [rnd.choice(["b.net", "example.net", "example.com", "org", "com", "inet"])])
        urls.append("https://" + host + rnd.choice(["", "/", "/x/", "/x/y", "/en/1", "/de/", "/fr/?q", "#/x/", "/z"]))
    urls += ["https://b.net/x/y"] * 300
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)] + [(None, "http://b.net/", "h")], "page_id long, url string, host string")
    table = spark.createDataFrame(rules, "host string, path string, action string")
    got = {r.id: tuple(r)[1:] for r in judge(pages, table, max_rules=max_rules, ranges=5).collect()}
    assert got.pop(None)[0] == "b.net"
    assert got == {k: plain(u, rules) for k, u in enumerate(urls)}
    assert judge(pages.limit(0), table, max_rules=max_rules).collect() == []
    assert {r.verdict for r in judge(pages, table.limit(0)).collect()} == {"allow"}
