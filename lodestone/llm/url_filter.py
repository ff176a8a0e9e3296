"""URL filter by association rules: FP-growth over URL tokens and labels, matched by an inverted index.

Every labelled url is a transaction of its tokens: host, all its parent domains of two labels and more, scheme, path segments, the words of
labels and segments, file ending, query keys, fragment mark. Spark's FP-growth mines the itemsets of at least ``MIN_ROWS`` bad urls, and a join counts
the good urls that have them too. Only rules for bad urls are made. Before mining, tokens that cannot make a longer rule
better are set aside: one that no good url has is a rule by itself, and of tokens that are in the same labelled urls the first
stands for all while longer rules are mined; afterwards each of them is a rule where the first is one, and stands for the first in longer rules (a row
without confidence says so). So a site whose urls share many query keys has few itemsets. The rules are pruned by confidence, and a rule
is dropped if a more general one is at least as confident. A rule is indexed under its rarest token, so that a url meets only the rules of its rare
tokens; it matches if all tokens of the rule are in the url. The best matching rule blocks the url.

Host rules come first: a (host, path) rule fits its host and all subdomains if the url's path starts with the rule's; the
longest rule wins. Where none fits, the mined rules decide, and a url without either is allowed.

Defined cases: a null url or one without ``://`` has an empty host and path, no tokens and the verdict allow; rows without
a label or with a null one don't train; without labels no rule is mined; repeated rows are judged one by one; an empty
table gives no rows; other columns are carried by ``judge_urls``, but for those with the names that it adds, which it replaces.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, is_small, join_bounded, table, written

#: host, path, verdict.
HOST_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Least number of bad urls that a rule holds in, however many are labelled, and its least confidence.
MIN_ROWS, MIN_CONFIDENCE = 5, 0.8
#: Copies of a transaction are made in arrays of so many.
COPIES = 10_000


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.translate(F.coalesce(F.regexp_substr(rest, F.lit("^[^/?#]*")), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_rule(host: Column, path: Column, rules=HOST_RULES) -> tuple[Column, Column]:
    """The longest fitting rule, like ``net/``, and its verdict; nulls where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, f"{h}{p}").otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a url; none where it has no host."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.lit("domain="), F.array_join(F.slice(labels, i, n), ".")))
    segments = F.array_remove(F.split(path, "/"), "")
    words = F.filter(F.split(F.translate(F.concat_ws("/", F.slice(labels, 1, F.greatest(n - 1, F.lit(0))), segments), UPPER, LOWER), r"[^\p{L}\p{N}]+"), lambda w: F.regexp_like(w, F.lit(r"^[\p{L}\p{N}]*\p{L}[\p{L}\p{N}]+$")))
    keys = F.regexp_extract_all(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), 1)
    single = F.array(
        F.concat(F.lit("scheme="), F.lower(F.substring_index(url, "://", 1))),
        F.concat(F.lit("host="), host),
        F.concat(F.lit("tld="), F.get(labels, n - 1)),
        F.concat(F.lit("dir="), F.nullif(F.get(F.split(path, "/"), F.lit(1)), F.lit(""))),
        F.concat(F.lit("end="), F.nullif(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1), F.lit(""))),
        F.when(F.contains(url, F.lit("#")), F.lit("fragment")),
    )
    each = lambda mark, xs: F.transform(xs, lambda x: F.concat(F.lit(mark), x))
    both = F.array_distinct(F.concat(F.array_compact(single), F.when(n >= 2, parents).otherwise(F.array()), each("seg=", segments), each("word=", words), each("key=", keys)))
    return F.when(host == "", F.expr("cast(array() as array<string>)")).otherwise(F.coalesce(both, F.expr("cast(array() as array<string>)")))


RULES = "tokens array<string>, n_bad long, n_good long"


def mine_rules(labelled: DataFrame, min_support: float = 0.0, min_confidence: float = MIN_CONFIDENCE, min_rows: int = MIN_ROWS) -> DataFrame:
    """(tokens, bad) rows -> rule_id, tokens, anchor, confidence, support; and rows without confidence: a token that stands for its anchor.

    min_support asks for a share of all labelled urls besides; by default the count alone decides.
    """
    spark = labelled.sparkSession
    usable = labelled.filter((F.size("tokens") > 0) & F.col("bad").isNotNull())
    sets = usable.groupBy(F.array_sort(F.array_distinct("tokens")).alias("tokens")).agg(F.count_if("bad").alias("n_bad"), F.count_if(~F.col("bad")).alias("n_good"))
    sets = written(sets.withColumn("set_key", _set_id(F.col("tokens"))), "transactions")
    n = int(sets.agg(F.sum(F.col("n_bad") + F.col("n_good"))).first()[0] or 0)
    least = max(min_rows, min_support * n)
    token = sets.select(F.explode("tokens").alias("token"), "set_key", "n_bad", "n_good").groupBy("token").agg(
        F.sum("n_bad").alias("n_bad"), F.sum("n_good").alias("n_good"), F.count("*").alias("sets"),
        # Two sums of hashes of its sets tell tokens with the same urls.
        F.sum(F.xxhash64("set_key").cast("decimal(38,0)")).alias("sum_a"), F.bit_xor(F.xxhash64(F.lit("b"), F.col("set_key"))).alias("sum_b"),
    )
    token = written(token.filter(F.col("n_bad") >= least), "tokens")  # of each token, however common, one row
    one = F.array("token").alias("tokens")
    pure = token.filter("n_good = 0").select(one, "n_bad", F.lit(0).cast("long").alias("n_good"))
    classes = token.filter("n_good > 0").groupBy("sets", "sum_a", "sum_b").agg(F.min("token").alias("token"))
    mixed = written(classes.select("token"), "tokens-mixed")
    alike = token.filter("n_good > 0").select(F.col("token").alias("other"), "sets", "sum_a", "sum_b").join(classes, ["sets", "sum_a", "sum_b"]).filter("other <> token").select("other", "token")
    alike = written(alike, "tokens-alike")
    if mixed.isEmpty():
        found = spark.createDataFrame([], RULES)
    else:
        kept = join_bounded(sets.select("set_key", "n_bad", "n_good", F.explode("tokens").alias("token")), mixed, "token", "inner")
        slim = written(kept.groupBy("set_key", "n_bad", "n_good").agg(F.array_sort(F.collect_list("token")).alias("tokens")), "transactions")
        bad = slim.filter("n_bad > 0").select("tokens", "n_bad", F.explode(F.sequence(F.lit(1).cast("long"), "n_bad", F.lit(COPIES).cast("long"))).alias("first"))
        bad = bad.select("tokens", F.explode(F.sequence("first", F.least(F.col("first") + COPIES - 1, "n_bad"))).alias("one"))
        total = slim.agg(F.sum("n_bad")).first()[0]
        # Half a row less, so that rounding never costs the last row.
        model = FPGrowth(itemsCol="tokens", minSupport=max(0.0, least - 0.5) / total, minConfidence=1.0).fit(bad)
        items = written(model.freqItemsets.select(F.array_sort("items").alias("tokens"), F.col("freq").alias("n_bad")), "itemsets").filter(F.col("n_bad") >= least)
        goods = written(_good_counts(slim.filter("n_good > 0").select("tokens", "n_good"), items, token.select("token", F.col("n_bad").alias("freq"))), "goods")
        found = items.withColumn("set_id", _set_id(F.col("tokens"))).join(goods, "set_id", "left").select("tokens", "n_bad", F.coalesce("n_good", F.lit(0)).cast("long").alias("n_good"))
    counted = pure.unionByName(found).withColumn("rule_id", _set_id(F.col("tokens"))).withColumn("confidence", F.col("n_bad") / (F.col("n_bad") + F.col("n_good"))).withColumn("support", F.col("n_bad") / F.lit(max(n, 1)))
    strong = _most_general(written(counted, "rules")).filter(F.col("confidence") >= min_confidence)
    rarest = strong.select("rule_id", F.explode("tokens").alias("token")).join(token.select("token", "n_bad"), "token").groupBy("rule_id").agg(F.min_by("token", F.struct("n_bad", "token")).alias("anchor"))
    rules = strong.select("rule_id", "tokens", "confidence", "support").join(rarest, "rule_id")
    # A rule of one token holds for all that are in the same urls.
    more = rules.filter(F.size("tokens") == 1).join(alike.withColumnRenamed("token", "anchor"), "anchor").select(_set_id(F.array("other")).alias("rule_id"), F.array("other").alias("tokens"), "confidence", "support", F.col("other").alias("anchor"))
    none = F.lit(None)
    stands = alike.select(none.cast("string").alias("rule_id"), F.array("other").alias("tokens"), none.cast("double").alias("confidence"), none.cast("double").alias("support"), F.col("token").alias("anchor"))
    return rules.unionByName(more).unionByName(stands)


def _set_id(tokens: Column) -> Column:
    return F.md5(F.array_join(tokens, "\x01"))


def _most_general(rules: DataFrame) -> DataFrame:
    """The itemsets that are more confident than every proper part of theirs.

    All parts of a frequent itemset are frequent, so the best of an itemset's parts follows from its immediate parts: one
    level of sizes after another, n look-ups an itemset instead of 2**n.
    """
    longest = int(rules.agg(F.max(F.size("tokens"))).first()[0] or 0)
    level, kept = None, None
    for size in range(1, longest + 1):
        here = rules.filter(F.size("tokens") == size)
        if level is None:
            judged = here.withColumn("of_parts", F.lit(-1.0))
        else:
            parts = here.select("rule_id", F.explode(F.transform("tokens", lambda t: F.array_remove("tokens", t))).alias("part")).select("rule_id", _set_id(F.col("part")).alias("part_id"))
            best = parts.join(level, "part_id").groupBy("rule_id").agg(F.max("best").alias("of_parts"))
            judged = here.join(best, "rule_id", "left").withColumn("of_parts", F.coalesce("of_parts", F.lit(-1.0)))
        judged = written(judged, "rules-level")
        level = judged.select(F.col("rule_id").alias("part_id"), F.greatest("confidence", "of_parts").alias("best"))
        own = judged.filter(F.col("confidence") > F.col("of_parts")).drop("of_parts")
        kept = own if kept is None else kept.unionByName(own)
    return rules if kept is None else kept


def _good_counts(good: DataFrame, itemsets: DataFrame, frequency: DataFrame) -> DataFrame:
    """set_id, n_good: how many good rows have all tokens of an itemset. Equal rows are matched once, by an itemset's rarest token."""
    ids = itemsets.select(_set_id(F.col("tokens")).alias("set_id"), F.col("tokens").alias("wanted"))
    anchors = ids.select("set_id", "wanted", F.explode("wanted").alias("token")).join(frequency, "token").groupBy("set_id").agg(F.min_by("token", F.struct("freq", "token")).alias("anchor"), F.first("wanted").alias("wanted"))
    met = good.select("tokens", "n_good", F.explode("tokens").alias("anchor")).join(anchors, "anchor")
    return met.filter(F.size(F.array_except("wanted", "tokens")) == 0).groupBy("set_id").agg(F.sum("n_good").alias("n_good"))


def judge_urls(pages: DataFrame, rules: DataFrame, host_rules=HOST_RULES) -> DataFrame:
    """Adds host, path, rule, verdict and confidence (of the best mined rule that matches, else null)."""
    added = ["host", "path", "rule", "verdict", "confidence"]
    carried = [c for c in pages.columns if c not in added]
    row = pages.select(F.struct(*[pages[c] for c in carried]).alias("row"), host_of(pages["url"]).alias("host"), path_of(pages["url"]).alias("path"))
    parsed = row.withColumn("_tokens", url_tokens(F.col("row.url"), F.col("host"), F.col("path")))
    listed = rules.filter(F.col("confidence").isNotNull()).select("anchor", "tokens", "confidence")
    index = F.broadcast(listed) if is_small(listed) else listed
    # Each distinct set of tokens is judged once, however many urls share it.
    keyed = parsed.withColumn("_set", F.md5(F.array_join(F.array_sort("_tokens"), "\x01")))
    distinct = keyed.groupBy("_set").agg(F.first("_tokens").alias("_tokens"))
    stands = rules.filter(F.col("confidence").isNull()).select(F.get("tokens", F.lit(0)).alias("_token"), F.col("anchor").alias("_for"))
    met = distinct.select("_set", F.explode("_tokens").alias("_token")).join(F.broadcast(stands) if is_small(stands) else stands, "_token")
    also = met.groupBy("_set").agg(F.collect_set("_for").alias("_also"))
    distinct = distinct.join(also, "_set", "left").select("_set", F.when(F.col("_also").isNull(), F.col("_tokens")).otherwise(F.array_union("_tokens", "_also")).alias("_tokens"))
    hits = distinct.select("_set", "_tokens", F.explode("_tokens").alias("anchor")).join(index, "anchor")
    best = hits.filter(F.size(F.array_except("tokens", "_tokens")) == 0).groupBy("_set").agg(F.max("confidence").alias("confidence"))
    judged = join_bounded(keyed, written(best.filter(F.col("confidence").isNotNull()), "matches"), "_set")
    rule, verdict = host_rule(F.col("host"), F.col("path"), host_rules)
    mined = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return judged.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, mined)).select("row.*", *added)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    labelled = pages.join(labels, "page_id").select(url_tokens(F.col("url"), host, path).alias("tokens"), "bad")
    return judge_urls(pages, mine_rules(labelled)).select("page_id", "host", "path", "rule", "verdict", "confidence")


QUERIES = {"op10_url_filter": op10_url_filter}
