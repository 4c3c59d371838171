import random

from quarryline.llm import urlfilter


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for c in "?#":
        rest = rest.split(c)[0]
    k = rest.find("/")
    host, path = (rest, "") if k < 0 else (rest[:k], rest[k:])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def brute(url, rules, default):
    host, path = parts(url)
    fits = [(len(h.split(".")) if h else 0, len(p), a == "block", h + p, a) for a, h, p in rules if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, default)))


def urls():
    rng = random.Random(3)
    out = [None, "", "no scheme", "http://", "://x.com/", "http://COM", "http://a..com/", "http://example.com", "http://Example.COM/en/a?b#c", "http://www.example.com/en/", "x://net/es/://y", "http://É.net/fr/é\nz", "h://a.net?q=/es/", "h://a.net#/es/"]
    for _ in range(300):
        host = ".".join(rng.choices(["www", "example", "com", "net", "a", "Net", ""], k=rng.randrange(1, 5)))
        path = "".join(rng.choices(["/", "en", "es", "fr", "e", "/en/", "?", "#"], k=rng.randrange(6)))
        out.append(f"http://{host}{path}")
    return out


def check(spark, rules, default="allow", **options):
    rows = [(i, u) for i, u in enumerate(urls())] + [(3, urls()[3]), (None, "http://b.com/")]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")
    found = urlfilter.filter_urls(pages, rules, default, **options).collect()
    assert sorted(map(tuple, found), key=str) == sorted(((i, *brute(u, rules, default)) for i, u in rows), key=str)


def test_production_rules(spark):
    check(spark, urlfilter.RULES)
    check(spark, urlfilter.RULES, limit=0)


def test_many_rules_both_ways(spark):
    rng = random.Random(5)
    rules = [("allow", "", ""), ("block", "com", ""), ("allow", "com", ""), ("block", "a.com", "/e"), ("allow", "net", "/en/es"), ("block", "net", "/en//")]
    rules += [(rng.choice(["allow", "block"]), ".".join(rng.choices(["www", "example", "com", "net"], k=rng.randrange(1, 3))), "/" + "/".join(rng.choices(["en", "es", "e", ""], k=rng.randrange(3)))) for _ in range(20)]
    rules = list({(h, p): (a, h, p) for a, h, p in rules if (h, p) != ("com", "")}.values()) + [("block", "com", ""), ("allow", "com", "")]
    check(spark, rules, "block")
    check(spark, rules, "block", limit=0)
    check(spark, [])


def test_keep_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.net/es/x", "p"), (2, "http://a.net/x", "q"), (3, None, "r")], "page_id long, url string, verdict string")
    assert sorted((r.page_id, r.verdict) for r in urlfilter.keep_allowed(pages).collect()) == [(2, "q"), (3, "r")]
    assert urlfilter.filter_urls(pages.limit(0)).count() == 0
