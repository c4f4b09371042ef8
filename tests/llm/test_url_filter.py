"""Rules against plain code, the model on held-out URLs."""

import re

from pyspark.sql import functions as F

from logfault.llm import url_filter as U
from logfault.llm.queries import QUERIES, URL_RULES

SCHEMA = "page_id long, url string, host string, score int, _rule string"


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    return host, m[2] if m else ""


def rule_of(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def test_hosts_paths_and_rules(spark):
    urls = ["http://a.com/x?y#z", "HTTP://WWW.Example.COM/en/1", "https://Éa.com", "http://a.com?x=http://b.net/es/", "nothing", "", None,
            "ftp://x.net/es/", "ftp://net/fr/", "http://notnet/fr/", "http://x.xnet/es/1", "http://example.com/EN/", "://", ":///p", "http://a\nb.com/\n/?q",
            "http://example.com/en/", "http://www.example.com/en/", "http://m.www.example.com/en", "http://com", "http://com/", "a://b://c/d"]
    df = spark.createDataFrame([(i, u, "h", 1, "r") for i, u in enumerate(urls * 2)], SCHEMA)
    rows = U.filtered(df, None, URL_RULES).collect()
    assert len(rows) == 2 * len(urls)
    for r in rows:
        host, path = parts(urls[r.page_id % len(urls)])
        rule = rule_of(host, path, URL_RULES)
        assert (r.host, r.path) == (host, path)
        assert (r.rule, r.verdict) == ((rule.name, rule.verdict) if rule else (None, U.ALLOW))


def test_query_and_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    rows = {r.page_id: r for r in QUERIES["op13_url_filter"](spark, folder).collect()}
    urls = {r.page_id: r.url for r in pages.select("page_id", "url").collect()}
    assert set(rows) == set(urls)
    for i, url in urls.items():
        host, path = parts(url)
        rule = rule_of(host, path, URL_RULES)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule.name if rule else None)
        assert rows[i].verdict == rule.verdict if rule else rows[i].verdict in (U.ALLOW, U.BLOCK)
    # What no rule decides is not all of one kind, and held-out URLs that rules decide are judged like them.
    labelled = U.by_rules(pages, URL_RULES).distinct()
    seen = labelled.filter(F.pmod(F.xxhash64("url"), F.lit(4)) != 0)
    held = labelled.filter(F.pmod(F.xxhash64("url"), F.lit(4)) == 0).select(F.col("url").alias("page_id"), "url", F.col("verdict").alias("want"))
    judged = U.filtered(held, U.train(seen, sample=1500), []).join(held.withColumnRenamed("url", "u"), "page_id")
    good, count = judged.agg(F.count_if(F.col("verdict") == F.col("want")), F.count("*")).first()
    assert count > 500 and good / count >= 0.97


def test_small_table_of_words(spark):
    """A dozen labelled URLs carry over to hosts that share parts of their names."""
    bad = [f"http://{w}{i}.org/{w}" for i in range(6) for w in ("cheap-pills", "casino-win")]
    good = [f"http://{w}{i}.org/{w}" for i in range(6) for w in ("city-library", "school-news")]
    table = spark.createDataFrame([(u, U.BLOCK) for u in bad] + [(u, U.ALLOW) for u in good] + [(None, U.ALLOW), ("x", None), ("y", "other")],
                                  "url string, verdict string")
    df = spark.createDataFrame([(1, "https://best-casino-win.net/a"), (2, "https://old-city-library.net/b")], "page_id long, url string")
    model = U.train(table)
    assert {r.page_id: r.verdict for r in U.filtered(df, model, []).collect()} == {1: U.BLOCK, 2: U.ALLOW}
    again = U.train(table.repartition(7))
    assert abs(model.coefficients.toArray() - again.coefficients.toArray()).max() < 1e-12


def test_empty_one_class_and_long(spark):
    none = spark.createDataFrame([], "url string, verdict string")
    assert U.train(none) is None
    one = spark.createDataFrame([("http://a.b/c", U.BLOCK)], "url string, verdict string")
    df = spark.createDataFrame([(1, "http://" + "a" * 200_000 + ".b/" + "c" * 200_000), (2, None), (None, "http://q")], "page_id long, url string")
    rows = U.filtered(df, U.train(one), []).collect()
    assert len(rows) == 3 and {r.verdict for r in rows} == {U.BLOCK}
    empty = spark.createDataFrame([], "page_id long, url string")
    assert U.filtered(empty, U.train(one), URL_RULES).count() == 0


def test_an_empty_url_does_not_sway_others(spark):
    """The label of a URL without host and path is learned, and is not the verdict on every unknown URL."""
    for of_empty, of_words in ((U.ALLOW, U.BLOCK), (U.BLOCK, U.ALLOW)):
        rows = [(f"http://{w}{i}.org/{w}", of_words) for i in range(8) for w in ("cheap-pills", "casino-win")]
        rows += [(f"http://{w}{i}.org/{w}", of_empty) for i in range(8) for w in ("city-library", "school-news")]
        table = spark.createDataFrame([*rows, (None, of_empty)], "url string, verdict string")
        df = spark.createDataFrame([(1, None), (2, "https://zq.fr/xx"), (3, "https://big-casino-win.net/a"), (4, "https://our-city-library.net/b")],
                                   "page_id long, url string")
        got = {r.page_id: r for r in U.filtered(df, U.train(table), []).collect()}
        assert (got[1].verdict, got[3].verdict, got[4].verdict) == (of_empty, of_words, of_empty)
        assert 0.4 < got[2].score < 0.6
