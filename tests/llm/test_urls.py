"""Hosts, rules and shrinkage on small tables."""

from evalspark.llm import queries, urls


def judged(spark, names, labels=(), **options):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(names)], "page_id long, url string, host string, n int")
    marks = spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int")
    found = urls.host_reputation(urls.page_outcomes(pages, marks))
    return {r.page_id: r for r in urls.judge_urls(pages, found, queries.RULES, **options).collect()}, {r.host: r for r in found.collect()}


def test_parts_and_rules(spark):
    cases = [
        (None, "", "", None, "allow"), ("no scheme/x", "", "", None, "allow"), ("http://A.Com", "a.com", "", None, "allow"),
        ("http://a.com/x?y#z", "a.com", "/x", "com/", "allow"), ("http://example.com/en/1", "example.com", "/en/1", "example.com/en/", "block"),
        ("http://m.Example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"), ("http://x.www.example.com/en/q", "x.www.example.com", "/en/q", "www.example.com/en/", "allow"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"), ("http://b.net/es/1", "b.net", "/es/1", "net/es/", "block"), ("http://b.net/es", "b.net", "/es", None, "allow"),
        ("http://b.net?/es/", "b.net", "", None, "allow"), ("http://É.ORG\n/p", "É.org\n", "/p", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"), ("http://com:80/", "com:80", "/", None, "allow")]
    got, _ = judged(spark, [c[0] for c in cases])
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), cases[i]


def test_shrinkage(spark):
    names = [f"http://bad.one.org/en/{i}" for i in range(40)] + [f"http://good.two.org/en/{i}" for i in range(40, 80)] + [f"http://new.one.org/en/{900 + i}" for i in range(3)]
    names += ["http://few.two.org/en/80"]
    labels = [(i, 0, 0) for i in range(40)] + [(i, 1, 0) for i in range(40, 80)] + [(80, 1, 1), (80, 1, 0), (None, 0, 1)]
    got, hosts = judged(spark, names, labels)
    assert got[0].verdict == "block" and got[40].verdict == "allow"
    assert hosts["good.two.org"]["mean"] < hosts["few.two.org"]["mean"] < hosts["bad.one.org"]["mean"]
    assert hosts["new.one.org"].n == 0 and hosts["new.one.org"]["mean"] > hosts["good.two.org"]["mean"]
    assert all(0 <= h.low <= h["mean"] <= h.high <= 1 for h in hosts.values())


def test_empty(spark):
    assert judged(spark, [])[0] == {}
