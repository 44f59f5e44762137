from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from carpalake.llm.queries import URL_RULES
from carpalake.llm.url_rules import judge_urls

SCHEMA = "page_id long, url string, host string, key int"


def plain(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if ("." + host).endswith("." + h) and path.startswith(p)]
    best = max(fits, default=(0, None, default))
    return host, path, best[1], best[2]


URLS = [
    None, "", "no scheme", "http://", "https://EXAMPLE.org/es/1", "https://a.example.org/en/12?x=1", "http://b.example.org/en/2#f", "http://com/fr/", "http://x.com/fr/a", "http://x.com/de/a",
    "http://xcom/fr/", "http://example.org", "http://example.org?/es/", "http://notexample.org/es/", "a://b://c.org/", "http://é.org/ü", "http://a.com/FR/", "http://" + "a." * 300 + "org/" + "x" * 5000, "http://.org/", "http://org./",
]


def check(spark, urls, rules, **options):
    rows = [(i if i % 7 else None, u, "h", 1) for i, u in enumerate(urls)]
    rows += rows[:3]
    got = judge_urls(spark.createDataFrame(rows, SCHEMA).repartition(3), rules, **options).collect()
    want = [(r[0], *plain(r[1], rules)) for r in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_registered_rules(spark):
    check(spark, URLS, URL_RULES)
    check(spark, URLS, URL_RULES, ranges=1)
    check(spark, URLS, URL_RULES, ranges=50)


def test_nested_rules(spark):
    rules = [("allow", "com", ""), ("block", "com", "/"), ("allow", "com", "/a"), ("block", "com", "/a/b"), ("block", "b.com", "/a"), ("allow", "a.b.com", ""), ("block", "", "")]
    check(spark, [f"http://{h}{p}" for h in ("com", "b.com", "a.b.com", "c.com", "net") for p in ("", "/", "/a", "/a/b", "/a/bc", "/z")] + ["x"], rules)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a.b", "b", "c.b", "a"]), st.text("/ab", max_size=4)), min_size=1, max_size=12), st.lists(st.tuples(st.sampled_from(["allow", "block"]), st.sampled_from(["b", "a.b", "a"]), st.text("/ab", max_size=3)), max_size=8, unique_by=lambda r: r[1:]))
def test_random(spark, urls, rules):
    check(spark, [f"x://{h}/{p}" for h, p in urls], rules)


def test_many_rules(spark):
    """100,000 rules, nested along paths, most of them and half of the urls on one host."""
    host = lambda i: "hot.example.com" if i % 3 else f"h{i % 500}.org"
    rules = {(host(i), f"/{i % 1000}/" + "x/" * (i // 1000 % 20) + (f"{i // 20_000}" if i % 7 else "")): "block" if i % 2 else "allow" for i in range(120_000)}
    assert len(rules) > 100_000
    urls = [f"http://{'' if i % 5 else 'www.'}{host(i if i % 2 else 1)}/{i % 1001}/" + "x/" * (i % 23) + str(i % 9) for i in range(20_000)]
    got = judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), [(v, *k) for k, v in rules.items()], default="none").collect()
    assert len(got) == len(urls)
    for r in got:
        fits = [(len(h) + n, h + r.path[:n], rules[h, r.path[:n]]) for h in (r.host, r.host.removeprefix("www."), r.host.split(".")[-1]) for n in range(len(r.path) + 1) if (h, r.path[:n]) in rules]
        assert (r.rule, r.verdict) == max(fits, default=(0, None, "none"))[1:]


def test_empty(spark):
    assert judge_urls(spark.createDataFrame([], SCHEMA), URL_RULES).count() == 0
