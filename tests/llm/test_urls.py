import re

from quarrystone.llm import urls

SCHEMA = "url string, page_id long, html string, host string"


def judge(spark, rows, **options):
    return {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(rows, SCHEMA), **options).collect()}


def test_hosts_paths_and_rules(spark):
    cases = {
        1: ("HTTP://Www.Example.NET/en/x?q#f", "www.example.net", "/en/x", "example.net/en/", "allow"),
        2: ("https://a.net/en/", "a.net", "/en/", "net/", "block"),
        3: ("https://a.net", "a.net", "", None, None),
        4: ("https://xexample.com/de/", "xexample.com", "/de/", None, None),
        5: ("https://example.com/de/?x", "example.com", "/de/", "example.com/de/", "block"),
        6: ("ftp://m.org/fr/1", "m.org", "/fr/1", "org/fr/", "allow"),
        7: (None, "", "", None, "allow"),
        8: ("no scheme.net/", "", "", None, "allow"),
        9: ("x\n://ÄB.org?y", "Äb.org", "", None, None),
    }
    out = judge(spark, [(u, k, None, "clash") for k, (u, *_) in cases.items()] + [(cases[1][0], None, "", None)])
    for k, (_, host, path, rule, verdict) in cases.items():
        assert (out[k].host, out[k].path, out[k].rule) == (host, path, rule)
        assert verdict is None or out[k].verdict == verdict
    assert out[None].verdict == "allow"


def test_propagation_against_brute_force(spark):
    import random

    rng, hosts = random.Random(5), [f"h{k}.{t}" for k in range(12) for t in ("com", "net", "org")]
    rows = []
    for k in range(150):
        links = "".join(f'<a href="http{rng.choice(["s", ""])}://{rng.choice(hosts).upper()}/p?x">' for _ in range(rng.randint(0, 4)))
        rows.append((f"http://{rng.choice(hosts[:24])}/{rng.choice(['fr', 'de', 'en'])}/{k}", k, links, None))
    got = {r.host: (r.trust, r.distrust) for r in urls.propagate(urls.host_edges(spark.createDataFrame(rows, SCHEMA), domain_edges=False), _seeds(spark, rows)).collect()}
    edges = set()
    for u, _, html, _ in rows:
        src = u.split("/")[2]
        edges |= {(src, d.lower()) for d in re.findall(r"https?://([^/]+)/", html) if d.lower() != src}
    for side, walk in ((0, edges), (1, {(b, a) for a, b in edges})):
        seeds = {r.host: (r.trust, r.distrust)[side] * 0.15 for r in _seeds(spark, rows).collect()}
        rank, degree = dict(seeds), {}
        for a, _ in walk:
            degree[a] = degree.get(a, 0) + 1
        for _ in range(urls.ROUNDS):
            new = dict(seeds)
            for a, b in walk:
                new[b] = new.get(b, 0) + 0.85 * rank.get(a, 0) / degree[a]
            rank = new
        for h, v in rank.items():
            assert abs(got.get(h, (0, 0))[side] - v) < 1e-9


def _seeds(spark, rows):
    by = {}
    for u, *_ in rows:
        host, path = u.split("/")[2], "/" + u.split("/", 3)[3]
        v = "block" if host.endswith(".net") else "allow" if host.endswith(".org") and path.startswith("/fr/") else ""
        by.setdefault(host, []).append(v)
    return spark.createDataFrame([(h, v.count("allow") / len(v), v.count("block") / len(v)) for h, v in by.items()], "host string, trust double, distrust double")


def test_distrust_reaches_who_links_to_the_blocked(spark):
    rows = [(f"http://bad.net/{k}", k, "", None) for k in range(3)] + [("http://links.com/1", 10, '<a href="//bad.net/x">', None), ("http://fine.com/1", 11, '<a href="http://links.org/x">', None)]
    out = judge(spark, rows)
    assert out[10].verdict == "block" and out[11].verdict == "allow"


def test_popularity_of_the_blocked_does_not_hide_its_linkers(spark):
    """A blocked and an allowed host with 3000 linkers each, some hosts with links to both or mostly elsewhere."""
    rows = [("http://bad.net/", 0, "", None), ("http://good.org/fr/", 1, "", None), ("http://plain.com/", 2, "", None)]
    to = {"b": '<a href="//bad.net/">', "g": '<a href="//good.org/">', "p": '<a href="//plain.com/">'}
    for k in range(3000):
        rows.append((f"http://links{k}.com/", 10 + k, to["b"], None))
        rows.append((f"http://fine{k}.com/", 10_000 + k, to["g"] if k % 2 else to["p"], None))
    rows.append(("http://many.com/", 20_000, to["b"] + "".join(f'<a href="//other{k}.com/">' for k in range(9)), None))
    rows += [(f"http://more.com/{'x' if k % 5 else ''}", 30_000 + k, "", None) for k in range(5)]
    out = judge(spark, rows)
    assert all(out[10 + k].verdict == "block" for k in range(3000))
    assert all(out[10_000 + k].verdict == "allow" for k in range(3000))
    assert out[2].verdict == out[20_000].verdict == out[30_000].verdict == "allow"


def test_empty(spark):
    assert judge(spark, []) == {}
