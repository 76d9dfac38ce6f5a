import random

from pyspark.sql import functions as F

from strandline.llm import urlrules


def plain(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0]) + len(r[1]), len(r[0])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else default


def check(spark, urls, rules, clash="x"):
    pages = spark.createDataFrame([(i, u, clash) for i, u in enumerate(urls)], "page_id long, url string, host string").repartition(3)
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlrules.judge(pages, table).collect()}
    assert got == {i: plain(u, rules) for i, u in enumerate(urls)}


def test_contract_rules(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    urls = ["http://Example.COM/en/x", "http://www.example.com/en/x", "http://m.www.example.com/en/", "http://notexample.com/en/", "http://a.net/es/1?x=/fr/", "http://a.net/fr", "http://a.net?q", "http://a.org/", "x", None, "", "://com/", "http://com", "http://.com/", "a://b://example.com/en/", "http://example.com:80/en/", "http://ex\u00c4mple.com/", "http://a..com//", "http://example.com/EN/", "http://com./"]
    check(spark, urls + urls[:5], rules)


def test_many_rules_and_a_hot_host(spark):
    rng = random.Random(7)
    labels = ["a", "b", "ab", "c-d", "a!", "b~", "xn--é"]
    host = lambda n: ".".join(rng.choice(labels) for _ in range(rng.randint(1, n)))
    path = lambda n: "/" + "".join(rng.choice(["a", "b", "/", "ab/"]) for _ in range(rng.randint(0, n)))
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((host(3), path(3)) for _ in range(300))}.values())
    urls = [f"http://{host(5)}{path(6)}" for _ in range(1500)] + [f"http://a.b{path(6)}" for _ in range(1500)]
    check(spark, urls, rules)


def test_odd_rules_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (1, "http://a.com/x"), (None, "http://a.com/x")], "page_id long, url string")
    rules = spark.createDataFrame([("a.com", "/", "allow"), ("a.com", "/", "block"), (None, "/", "block"), ("", "/", "block"), ("a.com", None, "block")], "host string, path string, verdict string")
    assert [(r.rule, r.verdict) for r in urlrules.judge(pages, rules).collect()] == [("a.com/", "block")] * 3
    assert [(r.rule, r.verdict) for r in urlrules.judge(pages, rules.limit(0)).collect()] == [(None, "allow")] * 3
    assert urlrules.judge(pages.limit(0), rules).count() == 0


def test_long_urls(spark):
    rules = [("com", "/", "allow"), ("a.com", "/" + "x" * 5000, "block"), (".".join(["b"] * 3000) + ".com", "/", "block")]
    hosts = [".".join(["b"] * n) + ".com" for n in (1, 2999, 3000, 3001)]
    check(spark, ["http://a.com/" + "x" * n for n in (4999, 5000, 100_000)] + [f"http://{h}/" for h in hosts] + ["http://" + "h" * 100_000], rules)


def test_equal_pages_are_spread(spark):
    pages = spark.range(0, 200_000, 1, 8).select(F.lit(None).cast("long").alias("page_id"), F.lit("http://www.example.com/en/").alias("url"))
    rules = spark.createDataFrame([("example.com", "/en/", "block")], "host string, path string, verdict string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = urlrules.judge(pages, rules)
        sizes = [r["n"] for r in found.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 200_000 and len(sizes) >= 8 and max(sizes) < 60_000
        assert found.filter("verdict = 'block'").count() == 200_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
