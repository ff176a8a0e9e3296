"""Rules of url tokens that are always together in the labels and part in other urls."""

from pyspark.sql import functions as F

from lodestone.llm import url_filter as u


def blocked(spark, labels, urls):
    df = spark.createDataFrame(labels, "url string, bad boolean")
    tokens = u.url_tokens(F.col("url"), u.host_of(F.col("url")), u.path_of(F.col("url")))
    rules = u.mine_rules(df.select(tokens.alias("tokens"), "bad"))
    pages = spark.createDataFrame([(i, x) for i, x in enumerate(urls)], "page_id long, url string")
    return {r["url"] for r in u.judge_urls(pages, rules).filter("verdict = 'block'").collect()}


def test_every_token_of_a_class_makes_a_rule(spark):
    labels = [(f"https://b.evil.com/aa/{i}", True) for i in range(8)] + [(f"https://ok{i}.fine.de/x/{i}", False) for i in range(8)]
    urls = ["https://b.evil.com/zz/1", "https://other.com/aa/1", "https://c.evil.com/q", "https://ok1.fine.de/x/9", "https://new.fr/"]
    assert blocked(spark, labels, urls) == set(urls[:3])


def test_subdomains_of_a_site_below_two_part_suffixes(spark):
    labels = [(f"http://s{i}.bad.co.uk/{i}", True) for i in range(6)] + [(f"http://s{i}.good.co.uk/{i}", False) for i in range(9)]
    urls = ["http://www.bad.co.uk/new", "http://bad.co.uk/", "http://s1.good.co.uk/", "http://x.co.uk/"]
    assert blocked(spark, labels, urls) == set(urls[:2])


def test_classes_in_longer_rules(spark):
    """Bad only where a key of one class meets a host of another; each alone is mostly good. Any member of a class stands for it."""
    bad = [(f"http://a.site.com/{i}x?k1=1&k2=2", True) for i in range(20)]
    good = [(f"http://a.site.com/{i}y", False) for i in range(20)] + [(f"http://h{i}.org/{i}z?k1=1&k2=2", False) for i in range(20)]
    urls = ["http://a.site.com/q?k2=5", "http://b.site.com/?k1=0", "http://a.site.com/q", "http://h.org/?k1=1&k2=2", "http://h.org/?k2=1"]
    assert blocked(spark, bad + good, urls) == set(urls[:2])


def test_words_deep_in_paths_and_labels(spark):
    labels = [(f"https://s{i}.net{i}.de/l/{i}/free-casino_win/p{i}", True) for i in range(7)] + [(f"https://s{i}.net{i}.de/l/{i}/p{i}", False) for i in range(7)]
    urls = ["https://casino.example.fr/", "https://q.fr/a/b/c/CASINO-1", "https://q.fr/free-casino_win", "https://q.fr/l/1/"]
    assert blocked(spark, labels, urls) == set(urls[:3])


def test_a_site_with_thousands_of_tokens(spark):
    keys = "&".join(f"k{i}=1" for i in range(3000))
    labels = [(f"http://bad.com/?{keys}", True)] * 6 + [(f"http://fair.com/?{keys}", False)] * 6 + [("http://x.com/", False)] * 3
    assert blocked(spark, labels, ["http://bad.com/", "http://fair.com/?k5=1", "http://y.com/?k7=1&k8=1"]) == {"http://bad.com/"}
