import random

from tidemark.llm import catalogue, urlfilter
from tidemark.llm.urlfilter import Rule

RULES = catalogue.URL_RULES


def parts(url):
    at = (url or "").find("://")
    if at < 0:
        return None, "", "", None
    rest = url[at + 3 :]
    ends = [rest.find(c) for c in "/?#" if c in rest]
    host, tail = (rest[: min(ends)], rest[min(ends) :]) if ends else (rest, "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return rest, host, tail.split("#")[0].split("?")[0], host + tail.split("#")[0] if host else None


def own(rules, host, path):
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.name), default=None)
    return (best.name, best.verdict) if best else (None, None)


def brute(pages, edges, rules=RULES, default="allow"):
    """pages (id, url) and pairs of addresses -> rows, by walking the graph from every page."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = []
    for page, url in pages:
        _, host, path, node = parts(url)
        rule, verdict = own(rules, host, path)
        seen, work = {node}, [node]
        while work:
            for x in near.get(work.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    work.append(x)
        said = {own(rules, *parts("x://" + x)[1:3])[1] for x in seen if x}
        out.append((page, host, path, rule, verdict or ("allow" if "allow" in said else "block" if "block" in said else default)))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_hosts_paths_and_longest_rule(spark):
    urls = [
        None, "", "no scheme", "://", "http://", "http://NET", "http://net/", "x://a.net?q=/", "http://a.NET/en/1", "http://example.net/en/",
        "http://m.example.net/en/x?a#b", "http://example.net/EN/", "http://notexample.net/en/", "https://x.example.com/de/1", "https://example.com/dex",
        "http://examplexcom/de/", "http://o.org/fr/#", "http://org#/fr/", "a://b://c/d", "http://ÄB.net/", "http://user@x.net:80/", "http://ne\tt/", "http://a.net\n/x",
    ]
    pages = spark.createDataFrame([(i, u, "<p>canonical refresh</p>", i) for i, u in enumerate(urls)], "page_id long, url string, html string, host int")
    assert rows(urlfilter.judge(pages, RULES)) == brute(list(enumerate(urls)), [])


def test_aliases_carry_blocks_and_allow_goes_first(spark):
    link = '<html><LINK href=\'{0}\' REL="alternate canonical"><link rel=canonical href=http://z.net/late>'
    rows_ = [
        (1, "http://a.com/1", link.format("https://b.NET/x#f")),  # its target is blocked and no page
        (2, "http://a.com/2", '<meta content="0; URL=/1" http-equiv=\'refresh\'>'),  # reaches it over page 1
        (3, "http://c.org/fr/1", link.format("//a.com/3")),  # allowed by a rule
        (4, "https://a.com/3?", "<p>"),  # another address: the query mark counts
        (5, "https://A.com/3#top", "<p>"),  # allowed as an alias of 3
        (6, "http://a.com/6", "<!-- " + link.format("http://n.net/") + " --><script>" + link.format("http://n.net/") + "</script>"),
        (7, "http://a.com/dir/7", link.format("eight?a=1&amp;b=2")),
        (8, "http://a.com/dir/eight?a=1&b=2", link.format("http://y.net/")),
        (9, "http://d.com", link.format("sub")),
        (10, "http://d.com/sub", link.format("mailto:a@b.net")),
        (11, "http://d.com/sub", link.format("#here")),  # a repeated address
        (12, "http://e.net/mine", link.format("http://c.org/fr/2")),  # its own rule stands
        (13, "http://e.com/both", link.format("http://e.net/mine")),  # block and allow among aliases: allow
        (14, None, link.format("http://y.net/")),
        (15, "http://f.com/", None),
        (None, "http://a.com/1", "x" * 300_000),
    ]
    pages = spark.createDataFrame(rows_, "page_id long, url string, html string")
    edges = [
        ("a.com/1", "b.net/x"), ("a.com/2", "a.com/1"), ("c.org/fr/1", "a.com/3"), ("a.com/dir/7", "a.com/dir/eight?a=1&b=2"),
        ("a.com/dir/eight?a=1&b=2", "y.net/"), ("d.com", "d.com/sub"), ("e.net/mine", "c.org/fr/2"), ("e.com/both", "e.net/mine"),
    ]
    want = brute([r[:2] for r in rows_], edges)
    got = rows(urlfilter.judge(pages, RULES))
    assert got == want
    verdict = {r[0]: r[4] for r in got}
    assert [verdict[i] for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 13)] == "block block allow allow allow allow block block allow block allow".split()
    assert urlfilter.judge(pages.limit(0), RULES).count() == 0
    assert rows(urlfilter.judge(pages.where("page_id = 15"), [], default="block")) == [(15, "f.com", "/", None, "block")]


def test_a_redirect_table_with_a_hub_and_chains(spark):
    rng = random.Random(4)
    urls = [f"http://h{rng.randrange(9)}.com/{rng.randrange(60)}" for _ in range(300)] + ["http://bad.net/"] * 3
    table = [(rng.choice(urls), rng.choice(urls)) for _ in range(40)] + [(u, "http://h1.com/hub") for u in urls[:30]]
    table += [("http://h1.com/hub", "http://bad.net/"), (None, "http://bad.net/"), ("http://h2.com/1", None)]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")
    redirects = spark.createDataFrame(table, "url string, target string")
    edges = [(parts(a)[3], parts(b)[3]) for a, b in table if a and b]
    got = rows(urlfilter.judge(pages, RULES, redirects))
    assert got == brute(list(enumerate(urls)), edges) and sum(r[4] == "block" for r in got) > 30


def test_equal_lengths_and_plan(spark):
    both = [Rule("b.c", "/", "block"), Rule("c", "/xx", "allow")]
    pages = spark.createDataFrame([(1, "http://a.b.c/xx", "")], "page_id long, url string, html string")
    made = urlfilter.judge(pages, both)
    assert rows(made)[0][3:] == ("b.c/", "block") and rows(urlfilter.judge(pages, both[::-1])) == rows(made)
    assert "Python" not in made._jdf.queryExecution().toString() and "Arrow" not in made._jdf.queryExecution().toString()
