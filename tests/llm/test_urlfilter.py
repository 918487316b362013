"""URL rules against every rule tried on every url."""

import random
import re

from askgrid.llm import urlfilter
from askgrid.llm.urlfilter import judge_urls


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), path


def by_hand(url, rules, default="allow"):
    host, path = parts(url)
    lower = lambda h: re.sub("[A-Z]+", lambda m: m[0].lower(), h)
    fits = [(len(h + p), len(h), v, lower(h) + p) for h, p, v in ((h, p or "", v) for h, p, v in rules if h and v) if host and (host == lower(h) or host.endswith("." + lower(h))) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else default


RULES = [("net", "/", "block"), ("Example.net", "/en/", "allow"), ("example.net", "/en", "block"), ("example.com", None, "block"), ("a.example.com", "/x/y/z", "allow"), ("example.com", "/x/y/zed", "block"), ("org", "/fr/", "allow"), ("org", "/fr/", "block"), (None, "/", "block"), ("com", "/", None), ("co.uk", "no", "block"), ("d.e", "/a/", "block"), ("c.d.e", "/", "allow")]
URLS = [None, "", "example.net/en/", "http://", "http:///en/", "https://EXAMPLE.NET/en/1?x=/fr/#y", "https://example.net/en", "https://example.net/EN/", "https://example.net", "ftp://x.net?q", "http://notnet/", "http://.net/", "http://net./", "http://net:80/", "http://user@b.example.com", "x://a.example.com/x/y/zed", "x://b.example.com/x/y/zed/", "x://q.org/fr/", "x://q.org/fr", "x://y://z.org/fr/", "http://c.d.e/a/", "http://É.Example.com/ü", "x://co.uk" + "/n" * 3, "h://" + "a." * 3000 + "net" + "/b" * 9000, "h://org\n/fr/", "H://example.com#net/"]


def judged(spark, rules, urls):
    df = spark.createDataFrame([(i, u, "h", "p", "r", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, path string, rule string, verdict string")
    rules = spark.createDataFrame(rules, "host string, path string, verdict string")
    out = judge_urls(df, rules)
    assert out.columns == [*df.columns, "ag_host", "ag_path", "ag_rule", "ag_verdict"]
    return {r["page_id"]: tuple(r)[6:] for r in out.collect()}


def test_odd_urls(spark, monkeypatch):
    wanted = {i: by_hand(u, RULES) for i, u in enumerate(URLS)}
    assert judged(spark, RULES, URLS) == wanted and len({w[2] for w in wanted.values()}) > 8
    monkeypatch.setattr(urlfilter, "BROADCAST_ROWS", 0)
    assert judged(spark, RULES, URLS) == wanted


def test_random_urls_and_rules(spark):
    rng = random.Random(7)
    host = lambda n: ".".join(rng.choice("ab") for _ in range(rng.randint(1, n)))
    path = lambda n: "".join(rng.choice(["/", "a", "b"]) for _ in range(rng.randint(0, n)))
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((host(3), rng.choice(["", "/"]) + path(3)) for _ in range(40))}.values())
    urls = [f"http://{host(5)}{rng.choice(['', '/'])}{path(6)}{rng.choice(['', '?a=/b', '#/'])}" for _ in range(400)]
    assert judged(spark, rules, urls) == {i: by_hand(u, rules) for i, u in enumerate(urls)}


def test_repeated_urls_and_no_rules(spark):
    urls = ["http://x.net/"] * 50 + ["http://x.com/"]
    assert judged(spark, RULES[:1], urls) == {i: by_hand(u, RULES[:1]) for i, u in enumerate(urls)}
    assert judged(spark, [], urls) == {i: by_hand(u, []) for i, u in enumerate(urls)}
    assert judged(spark, RULES, []) == {}
    pages = spark.createDataFrame([(1, "http://x.net/")], "page_id long, url string")
    rules = spark.createDataFrame(RULES[:1], "host string, path string, verdict string")
    assert judge_urls(pages, rules, keep=["page_id"], default="block").columns == ["page_id", "host", "path", "rule", "verdict"]
    assert judge_urls(pages, rules.limit(0), default="block").first()["verdict"] == "block"
