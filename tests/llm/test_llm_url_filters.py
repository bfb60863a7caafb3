import random

import pytest

from compare import differences, duck
from fleetstats.llm import url_filters as U
from fleetstats.llm.catalog import load

FOLDER = "/root/testdata/sf0.001"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def brute(urls, rules, default="allow"):
    out = []
    for page, url in urls:
        host, path = split(url)
        fit = [
            (len(h) + len(p), len(h), h + p, v)
            for h, p, v in rules
            if None not in (h, p, v) and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p) and not set(h) & set("/?#")
        ]
        best = max(fit, default=None)
        out.append((page, host, path, best[2] if best else None, best[3] if best else default))
    return sorted(out, key=repr)


def judged(spark, urls, rules, **more):
    pages = spark.createDataFrame(urls, "page_id bigint, url string")
    given = spark.createDataFrame(rules, "host string, path string, verdict string")
    out = U.judge(pages, given, **more).select("page_id", "host", "path", "rule", "verdict")
    return sorted((tuple(r) for r in out.collect()), key=repr)


ODD = [
    None, "", "no scheme", "://", "http://", "http:///en/", "HTTP://WWW.Example.COM/en/x", "http://example.com", "http://example.com?q=/en/",
    "http://example.com#/en/", "http://com/", "http://xcom/", "http://a.com/en/", "http://example.com/en", "http://example.com/en/",
    "http://www.example.com/en/1", "http://notexample.com/en/", "a://b://c.net/es/", "http://..net/es/", "http://net./es/", "http://é.net/fr/ü",
    "http://user@x.net:80/fr/", "http://x.net/fr/\n1", "http://ÀB.example.com/en/", "http://" + "a." * 20000 + "net/fr/" + "y" * 50000,
]


def test_odd_urls_and_the_query_rules(spark):
    urls = [(i, u) for i, u in enumerate(ODD)] + [(None, "http://x.net/es/"), (3, "http://x.net/es/"), (3, "http://x.net/es/")]
    assert judged(spark, urls, U.RULES) == brute(urls, U.RULES)


@pytest.mark.parametrize("keys_per_part", [1_000_000, 7])
def test_many_nested_rules_equal_brute_force(spark, keys_per_part):
    """In one part, and in many whose bounds fall inside of the rules' intervals."""
    dice = random.Random(5)

    def host(most):
        return ".".join(dice.choice(["a", "b", "com", "net"]) for _ in range(dice.randint(1, most)))

    def path(most):
        return "".join(dice.choice(["/", "/a", "/b", "x"]) for _ in range(dice.randint(0, most)))

    rules = list({(h, p): (h, p, dice.choice(["allow", "block"])) for h, p in ((host(3), "/" + path(3)) for _ in range(60))}.values())
    rules += [("b.com", "", "block"), ("a", "x", "block"), (None, "/", "block"), ("net", None, "block"), ("a/b", "/", "block"), ("", "/", "block")]
    urls = [(i, f"http://{host(5)}/{path(5)}") for i in range(600)] + [(1000 + i, "http://a.b.com/a/b") for i in range(300)]
    assert judged(spark, urls, rules, keys_per_part=keys_per_part) == brute(urls, rules)


def test_equal_rules_block_and_long_common_keys(spark):
    long = "/" + "p" * 400
    rules = [("com", "/", "allow"), ("com", "/", "block"), ("com", long, "allow"), ("com", long + "q", "block")]
    urls = [(i, f"http://h{i % 3}.com{long}{'q' * (i % 2)}{i}") for i in range(40)] + [(99, "http://com/x")]
    assert judged(spark, urls, rules, keys_per_part=5) == brute(urls, rules)


def test_clashing_columns_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/es/", "mine", "h", 5)], "page_id int, url string, near_host string, Host string, their_path int")
    rules = spark.createDataFrame(U.RULES, "host string, path string, verdict string")
    out = U.judge(pages, rules)
    assert out.columns == ["page_id", "url", "near_host", "their_path", "host", "path", "rule", "verdict"]
    assert tuple(out.first()) == (1, "http://a.net/es/", "mine", 5, "a.net", "/es/", "net/es/", "block")
    assert U.judge(pages.limit(0), rules).count() == 0
    assert U.judge(pages, rules.limit(0), default="block").first().verdict == "block"


def test_query_agrees_with_its_sql(spark):
    queries, oracles = load()
    name = "op11_url_filters"
    assert differences(spark, duck(FOLDER), FOLDER, queries[name], oracles[name]) == []
