"""The cascade over universes of thousands of keys, lists as tables, and the way by a join."""

import random

import pytest

from bytegrain.llm import url_filter
from bytegrain.llm.url_filter import Rule


def keys(spark, names):
    return spark.createDataFrame([(k,) for k in names], "key string")


@pytest.mark.parametrize("share", [0.0, 0.02, 0.5, 1.0])
def test_cascade_is_exact_over_its_universe(spark, share):
    draw = random.Random(3)
    universe = [f"host{k}.example\x00/{k % 7}" for k in range(6000)]
    listed = [k for k in universe if draw.random() < share]
    cascade = url_filter.build_cascade(keys(spark, universe), keys(spark, [*listed, "not asked for"]), rates=(0.3, 0.5))
    assert cascade.contains(universe).tolist() == [k in set(listed) for k in universe]
    assert len(cascade.levels) >= 5 or share in (0.0, 1.0)
    assert not cascade.contains([]).tolist()


def brute(host, path, rules, hosts):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = max(fits, key=lambda r: (len(r.text), len(r.host), r.verdict), default=None)
    return (rule.text, rule.verdict) if rule else (None, "block" if any(host == h or host.endswith("." + h) for h in hosts) else "allow")


@pytest.mark.parametrize("max_bytes", [64 << 20, 40])
def test_lists_as_tables(spark, max_bytes):
    draw = random.Random(9)
    host = lambda: ".".join(draw.choice(["a", "b", "www", "shop", "net", "org"]) for _ in range(draw.randint(1, 4)))
    path = lambda: "/" + "/".join(draw.choice(["x", "y", "zz"]) for _ in range(draw.randint(0, 3)))
    rules = list({(r.host, r.path): r for r in (Rule(host(), path(), draw.choice(["allow", "block"])) for _ in range(300))}.values())
    hosts = sorted({host() for _ in range(20)})
    urls = {k: f"http://{host()}{path()}?q" for k in range(2000)} | {2000: None, 2001: "no scheme"}
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in urls.items()], "page_id bigint, url string, rule string, key string")
    table = spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string")
    got = url_filter.filter_urls(pages, table, spark.createDataFrame([(h,) for h in hosts], "host string"), max_bytes=max_bytes).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r["rule"], r["verdict"]) == brute(r["host"], r["path"], rules, hosts), r
    assert {(r["host"], r["verdict"]) for r in got if r["page_id"] >= 2000} == {("", "allow")}
