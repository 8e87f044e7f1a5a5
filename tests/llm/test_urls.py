import re

from skarn.llm import urls
from skarn.llm.queries import op6_url_filter


def split(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def brute_rule(host, path):
    fits = [(len(h + p), v == "allow", h + p) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, default=None)


def test_query(spark, sf01):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf01}/pages.parquet").collect()}
    got = op6_url_filter(spark, sf01).collect()
    assert len(got) == len(pages)
    for r in got:
        host, path = split(pages[r.page_id])
        rule = brute_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[2])
        assert r.verdict == ("allow" if rule is None or rule[1] else "block")


def test_aliases_take_decisions(spark):
    canonical = '<link rel="canonical" href="{}">'.format
    refresh = "<META http-equiv='refresh' content='0; URL={}'>".format
    rows = [
        (1, "https://alias.org/a#x", canonical("http://www.shop.net/es/1")),  # to a page that is blocked
        (2, "http://alias.org/b", refresh("/a")),  # two steps away, by a relative link
        (3, "http://other.org/c", canonical("https://example.com/en/z")),  # to a blocked page that was not crawled
        (4, "http://m.shop.net/es/2", "<p>"),  # blocked itself
        (5, "http://kept.org/d", canonical("http://m.shop.net/es/2")),
        (6, "http://kept.org/e", canonical("http://kept.org/d")),
        (7, "http://www.example.com/en/f", canonical("http://kept.org/d")),  # allowed: the class is allowed
        (8, "http://free.org/g?page=1&x=2", canonical("g?page=1&amp;x=2")),
        (9, None, canonical("http://m.shop.net/es/2")),
        (10, "no scheme", None),
        (11, "HTTP://UPPER.Example.NET", None),
        (11, "HTTP://UPPER.Example.NET", None),
    ]
    pages = spark.createDataFrame([(*r, "h", "p", "v") for r in rows], "page_id long, url string, html string, host string, path string, node string")
    got = {r.id: r for r in urls.filter_urls(pages).collect()}
    verdicts = {k: r.verdict for k, r in got.items()}
    assert verdicts == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "allow", 10: "allow", 11: "allow"}
    assert (got[9].host, got[9].path, got[11].host, got[11].path) == ("", "", "upper.example.net", "")
    assert urls.filter_urls(pages).count() == len(rows)
    assert urls.filter_urls(pages.limit(0)).count() == 0


def test_targets_are_resolved(spark):
    """Every link of a page, relative ones against its url, default ports left out."""
    canonical = '<link rel="canonical" href="{}">'.format
    rows = [
        (1, "http://a.org/x/y/z.html", canonical("../w") + canonical("./v")),
        (2, "https://a.org:443/x/w", "<p>"),
        (3, "http://a.org/x/y/v", canonical("http://b.net:80/es/q")),
        (4, "http://c.org/p?q=1", canonical("?q=2")),
        (5, "http://c.org/p?q=2", "<meta http-equiv=refresh content='1;url=http://b.net/fr/x'>"),
        (6, "http://d.org/" + "e/" * 50_000 + "..", "h" * 500_000 + canonical("http://b.net/es/q")),
    ]
    got = {r.id: r for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: r.verdict for k, r in got.items()} == dict.fromkeys(range(1, 7), "block")
    assert got[1].alias_of == got[2].alias_of == got[3].alias_of == got[6].alias_of != got[4].alias_of


def test_aliases_against_brute_force(spark):
    """Random links over few urls: classes by search, decisions by the rules of their members."""
    import random

    rng = random.Random(2)
    names = [f"http://{h}/{p}{k}" for h in ("one.org", "two.net", "example.com", "www.example.com") for p in ("", "es/", "en/") for k in range(12)]
    rows, links = [], []
    for k in range(150):
        url, to = rng.choice(names), rng.choice(names)
        linked = rng.random() < 0.6
        rows.append((k if k % 50 else None, url, f'<link href="{to}" rel=canonical>' if linked else None))
        links += [(url, to)] * linked
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def verdict(url):
        rule = brute_rule(*split(url))
        if rule:
            return "allow" if rule[1] else "block"
        seen, queue = {url}, [url]
        while queue:
            new = near.get(queue.pop(), set()) - seen
            seen |= new
            queue += new
        found = {r[1] for u in seen if (r := brute_rule(*split(u)))}
        return "block" if found == {False} else "allow"

    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.host, r.path, r.verdict) for r in got) == sorted((*split(u), verdict(u)) for _, u, _ in rows)
    assert sum(r.rule is None and r.verdict == "block" for r in got) > 2
