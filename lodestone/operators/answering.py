"""Retrieval from question to context: filters, pruning, last mile, fall-backs, page expansion, merging, examples."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import constants as C
from ..functions import extract as E
from ..functions import text as X
from ..sources.tables import checkpointed, questions, table
from .ranking import _list, identifier_query, last_mile, query_intent
from .retrieval import _ALL, _BM25, _DENSE, _FUSED, _Q, _fused, _lexical, _pages, _vectors, ambiguous, broadcast_if_small, coverage, dense_top_k, every_term_sql, first_per, fuse_hybrid, fuse_pools, golden_metrics, parts_sql, rank_within, vector_only_rerank

SITE = "https://docs.example.org/"


# --- pieces --------------------------------------------------------------------------------------------------------


def dense_with_fallback(qs: DataFrame, vectors: DataFrame, column: str, k: int = C.DENSE_TOP_K) -> DataFrame:
    """dense_top_k where ``column`` matches; questions for which no row does are asked again without that filter."""
    strict = dense_top_k(qs, vectors, k, (column,))
    missed = qs.join(strict.select("question_id").distinct(), "question_id", "left_anti")
    return strict.unionByName(dense_top_k(missed, vectors, k))


def fuse_ranked_lists(lists: DataFrame, carry: list[str] = ()) -> DataFrame:
    """question_id, list_no, rank, id, score -> one ranking: reciprocal ranks are summed, the copy with the best score stays."""
    copy = F.struct("score", (-F.col("list_no")).alias("no"), *carry)
    fused = lists.groupBy("question_id", "id").agg(F.round(F.sum(1.0 / (C.RRF_K + F.col("rank") + 1)), 12).alias("rrf"), F.max(copy).alias("best"), F.min(F.struct("list_no", "rank")).alias("first"))
    return rank_within(fused, [F.desc("rrf"), F.asc("first"), F.asc("id")]).select("question_id", "id", "rank", "rrf", F.col("best.score").alias("score"), *[F.col(f"best.{c}").alias(c) for c in carry])


def first_list_wins(lists: DataFrame) -> DataFrame:
    """question_id, list_no, rank, id: rows whose id was in an earlier list of the question go; ranks close up."""
    n = F.row_number().over(W.partitionBy("question_id", "id").orderBy("list_no", "rank"))
    kept = lists.withColumn("_n", n).filter("_n = 1").drop("_n")
    own = F.row_number().over(W.partitionBy("question_id", "list_no").orderBy("rank")) - 1
    return kept.withColumn("_r", own).drop("rank").withColumnRenamed("_r", "rank")


def union_by_key(frames: list[DataFrame], key: Column) -> DataFrame:
    """Rows of several lists with an ``order`` each: the first of each key stays, earlier lists before later ones; blank keys go."""
    every = None
    for i, df in enumerate(frames):
        mine = df.withColumn("_list", F.lit(i)).withColumn("_key", key)
        every = mine if every is None else every.unionByName(mine)
    n = F.row_number().over(W.partitionBy("_key").orderBy("_list", "order"))
    return every.filter(F.coalesce(F.col("_key"), F.lit("")) != "").withColumn("_n", n).filter("_n = 1").drop("_n", "_key")


def prune(hits: DataFrame, qs: DataFrame, chunks: DataFrame, dedupe: bool = True) -> DataFrame:
    """Ranked hits (question_id, id, rank, score) -> those that go on, in their last order.

    Near duplicates collapse (a chunk's fingerprint is its page and tail), urls outside the question's prefix go, the last
    mile reorders, and a page keeps three. Texts stay where they are: ``chunks`` brings fingerprints.
    """
    met = hits.join(chunks, "id").join(qs.select("question_id", "url_prefix", "terms", "intent", "identifier"), "question_id")
    met = first_per(met, ["fingerprint"]) if dedupe else met
    inside = met.filter(F.col("url_prefix").isNull() | X.under_prefix(F.col("url"), F.col("url_prefix"))).withColumnRenamed("rank", "_r")
    ordered = last_mile(rank_within(inside, [F.asc("_r")]).drop("_r"))
    return first_per(ordered, ["page"], C.PER_PAGE_CAP)


def expand(direct: DataFrame, siblings: DataFrame) -> DataFrame:
    """Direct hits (question_id, id, page, rank, score) and the dense ranking of all chunks of their pages -> context.

    siblings: question_id, id, page, sib_rank (by similarity within the page), matches (a term of the question is in it).
    The two best pages give ten chunks each, 0.01 below their anchor. If all hits are of one page, it is pulled further:
    its first ten, and of its first 200 those that match, 0.005 below the anchor, 48 in all.
    """
    per_q = direct.groupBy("question_id").agg(F.countDistinct("page").alias("pages"))
    anchor = direct.groupBy("question_id", "page").agg(F.min("rank").alias("r"), F.max_by("score", -F.col("rank")).alias("anchor"))
    top = anchor.withColumn("n", F.row_number().over(W.partitionBy("question_id").orderBy("r"))).filter(F.col("n") <= C.EXPANSION_PAGES).join(per_q, "question_id")
    met = siblings.join(top, ["question_id", "page"])
    head = F.col("sib_rank") < C.EXPANSION_CHUNKS
    rescued = (F.col("pages") == 1) & (F.col("sib_rank") < C.EXPANSION_PULL) & F.col("matches")
    more = met.filter(head | rescued).withColumn("order", F.row_number().over(W.partitionBy("question_id", "page").orderBy(F.when(head, 0).otherwise(1), "sib_rank"))).filter(F.col("order") <= C.EXPANSION_KEEP)
    score = F.greatest(F.lit(0.0), F.round(F.col("anchor") - F.when(head, 0.01).otherwise(0.005), 9))
    extra = more.join(direct.select("question_id", "id"), ["question_id", "id"], "left_anti").select("question_id", "id", "page", score.alias("score"), F.lit(False).alias("direct"))
    return direct.select("question_id", "id", "page", "score", F.lit(True).alias("direct")).unionByName(extra)


def context_order(chunks: DataFrame) -> DataFrame:
    """Pages by their best score, the chunks of a page in reading order (chunk_index)."""
    per = W.partitionBy("question_id", "page")
    laid = chunks.withColumn("_best", F.max("score").over(per)).withColumn("_first", F.min("id").over(per))
    return rank_within(laid, [F.desc("_best"), F.asc("_first"), F.asc("chunk_index"), F.asc("id")], "place").drop("_best", "_first")


def retrieve(qs: DataFrame, pool: DataFrame, chunks: DataFrame, threshold: float = C.STRICT_THRESHOLD, weak: bool = True) -> DataFrame:
    """Fused candidates -> direct hits: reranked, above the threshold, pruned; where a question has none, five weak ones.

    qs: question_id, url_prefix, terms, intent, identifier; adds tier: direct or weak.
    """
    ranked = vector_only_rerank(pool).select("question_id", "id", "rank", "score")
    direct = prune(ranked.filter(F.col("score") >= threshold), qs, chunks).withColumn("tier", F.lit("direct"))
    if not weak:
        return direct
    order = rank_within(ranked.filter(F.col("score") >= C.WEAK_THRESHOLD).withColumnRenamed("rank", "_r"), [F.asc("_r")]).drop("_r")
    missed = order.filter(F.col("rank") < C.WEAK_TOP_K).join(direct.select("question_id").distinct(), "question_id", "left_anti")
    return direct.unionByName(prune(missed, qs, chunks, dedupe=False).withColumn("tier", F.lit("weak")))


def escalate(ranked: DataFrame, strong: DataFrame, best: int = 10) -> DataFrame:
    """Ranked hits, reordered by a stronger model's scores for the ten best of the questions whose ranking is ambiguous.

    strong: question_id, id, strong. Questions that are clear, and hits without a strong score, keep their scores.
    """
    flags = ambiguous(ranked).select("question_id", "ambiguous")
    met = ranked.join(flags, "question_id", "left").join(strong, ["question_id", "id"], "left")
    score = F.when(F.coalesce("ambiguous", F.lit(True)) & (F.col("rank") < best), F.coalesce("strong", "score")).otherwise(F.col("score"))
    return rank_within(met.withColumn("score", score).withColumnRenamed("rank", "_r").drop("strong", "ambiguous"), [F.desc("score"), F.asc("_r")]).drop("_r")


def covered(qs: DataFrame, ranked: DataFrame) -> DataFrame:
    """coverage for all questions: none where nothing was found."""
    return qs.select("question_id").join(coverage(ranked), "question_id", "left").withColumn("coverage", F.coalesce("coverage", F.lit("none")))


def golden_cases(ranked: DataFrame, expected: DataFrame, rejected: DataFrame) -> DataFrame:
    """golden_metrics, and whether a page of ``rejected`` (question_id, page) is among a question's hits."""
    bad = ranked.join(rejected, ["question_id", "page"]).select("question_id", F.lit(True).alias("reject_hit")).distinct()
    return golden_metrics(ranked, expected).join(bad, "question_id", "left").withColumn("reject_hit", F.coalesce("reject_hit", F.lit(False)))


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cases of two runs by question: question_id, improved, regressed, where either holds."""
    b = before.select("question_id", F.col("hit_at_1").alias("b1"), F.col("first_rank").alias("br"), F.col("reject_hit").alias("bx"))
    met = after.join(b, "question_id")
    no = lambda c: F.coalesce(c, F.lit(False))
    improved = (F.col("hit_at_1") & ~F.col("b1")) | no(F.col("first_rank") < F.col("br"))
    regressed = (~F.col("hit_at_1") & F.col("b1")) | no(F.col("first_rank") > F.col("br")) | (F.col("reject_hit") & ~F.col("bx"))
    return met.select("question_id", improved.alias("improved"), regressed.alias("regressed")).filter("improved or regressed")


def wordings(question: Column, variants: Column) -> Column:
    """What a question is asked as: cleaned, as it is, and its variants; each once, whatever its case."""
    every = F.filter(F.transform(F.concat(F.array(E.clean_query(question), question), variants), lambda w: F.trim(w)), lambda w: w != "")
    lower = F.transform(every, lambda w: F.lower(w))
    return F.filter(every, lambda w, i: F.array_position(lower, F.lower(w)) == i + 1)


# --- examples ------------------------------------------------------------------------------------------------------


def example_catalog(chunks: DataFrame) -> DataFrame:
    """The first example chunk of each (url, example_index): url, example_index, title, kind, language."""
    first = F.min(F.struct("order", F.coalesce(F.nullif(F.trim("title"), F.lit("")), "url").alias("title"), F.coalesce("kind", F.lit("other")).alias("kind"), "language")).alias("f")
    return chunks.filter((F.col("chunk_kind") == "example") & (F.trim("url") != "")).groupBy("url", "example_index").agg(first).select("url", "example_index", "f.title", "f.kind", "f.language")


def page_examples(chunks: DataFrame) -> DataFrame:
    """One example per (url, example_index), folded in order: a longer body or a whole one wins, a language fills a gap.

    An example has few parts, which are folded in one row.
    """
    parts = chunks.filter(F.col("chunk_kind") == "example").groupBy("url", "example_index").agg(F.sort_array(F.collect_list(F.struct("order", "body", "part", "language"))).alias("ps"))
    whole = lambda p: F.struct(p["body"].alias("body"), p["part"].alias("part"), p["language"].alias("language"))

    def step(a: Column, p: Column) -> Column:
        better = (F.length(p["body"]) > F.length(a["body"])) | (p["part"].isNull() & a["part"].isNotNull())
        taken = F.struct(p["body"].alias("body"), F.lit(None).cast("int").alias("part"), F.coalesce(p["language"], a["language"]).alias("language"))
        kept = F.struct(a["body"].alias("body"), a["part"].alias("part"), F.coalesce(F.nullif(a["language"], F.lit("")), p["language"]).alias("language"))
        return F.when(better, taken).otherwise(kept)

    folded = F.aggregate(F.slice("ps", F.lit(2), F.greatest(F.size("ps") - 1, F.lit(0))), whole(F.get("ps", F.lit(0))), step)
    return parts.select("url", "example_index", folded.alias("e")).select("url", "example_index", "e.body", "e.language")


def example_hits(qs: DataFrame, vectors: DataFrame, kinds: list[str] = (), k: int = C.FINAL_TOP_K) -> DataFrame:
    """Example chunks near a question: filtered, searched, reranked; relaxed to 0.50 for questions without a hit.

    vectors: id, vec, chunk_kind, kind -> question_id, id, rank, score, relaxed.
    """
    only = vectors.filter(F.col("chunk_kind") == "example")
    found = dense_top_k(qs, only.filter(F.col("kind").isin(*kinds)) if kinds else only)
    ranked = vector_only_rerank(found).filter(F.col("rank") < k).select("question_id", "id", "rank", "score")
    strict = ranked.filter(F.col("score") >= C.STRICT_THRESHOLD).withColumn("relaxed", F.lit(False))
    missed = ranked.join(strict.select("question_id").distinct(), "question_id", "left_anti")
    return strict.unionByName(missed.filter(F.col("score") >= C.RELAXED_THRESHOLD).withColumn("relaxed", F.lit(True)))


def find_examples(lists: DataFrame, k: int = C.FINAL_TOP_K) -> DataFrame:
    """question_id, list_no, rank, id, url, example_index, score -> the best examples over all lists, the first of each (url, index)."""
    n = F.row_number().over(W.partitionBy("question_id", "url", "example_index").orderBy("list_no", "rank"))
    kept = lists.withColumn("_n", n).filter("_n = 1").drop("_n").withColumnRenamed("rank", "_r")
    return rank_within(kept, [F.desc("score"), F.asc("list_no"), F.asc("_r")]).filter(F.col("rank") < k).drop("_r")


# --- queries over the tables ---------------------------------------------------------------------------------------


def _meta(spark, d, pool=None):
    """Documents as chunks of pages of 50, with a path, a symbol and a kind made of their first words.

    With ``pool`` those with its ids alone, made from their texts in one scan and kept, as every step of a retrieval brings them.
    """
    w = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)
    i = F.col("doc_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("source", "docs", "test", "example", "config")]), (i % 5 + 1).cast("int"))
    path = F.when(i % 3 != 0, F.concat(F.lit("packages/"), "source", F.lit("/v"), (i % 4 + 1).cast("string"), F.lit("/src/"), F.coalesce(F.get(w, F.lit(0)), F.lit("x")), F.lit(".ts")))
    page = F.concat_ws("/", "source", F.floor(i / 50).cast("string"))
    docs = table(spark, d, "documents")
    if pool is not None:
        docs = docs.join(broadcast_if_small(pool.select(F.col("id").alias("doc_id")).distinct()), "doc_id")
    made = docs.select(i.alias("id"), page.alias("page"), F.concat(F.lit(SITE), page).alias("url"), (i % 50).alias("chunk_index"), path.alias("path"), F.when(i % 2 == 0, F.get(w, F.lit(1))).alias("symbol"), kind.alias("kind"), F.md5(X.near_duplicate_key(page, F.coalesce("text", F.lit("")))).alias("fingerprint"))
    return made if pool is None else broadcast_if_small(checkpointed(made))


def _asked(spark, d):
    """Questions with their terms; every third asks below one source's pages."""
    q = questions(spark, d)
    prefix = F.when(F.col("question_id") % 3 == 0, F.concat(F.lit(SITE + "src"), (F.col("question_id") % 2).cast("string")))
    return q.withColumns({"url_prefix": prefix, "terms": X.query_terms(F.col("question")), "intent": query_intent(F.col("question")), "identifier": identifier_query(F.col("question"))})


def _pool(spark, d, qs=None):
    return _fused(spark, d, qs)


def filtered_topk(spark: SparkSession, d: str) -> DataFrame:
    """Both legs under a source filter: even questions ask within the source of their own document."""
    own = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source")
    qs = questions(spark, d).join(own.withColumnRenamed("id", "question_id"), "question_id").withColumn("source", F.when(F.col("question_id") % 2 == 0, F.col("source")))
    vectors = _vectors(spark, d).join(own, "id", "left")
    pool = fuse_hybrid(dense_top_k(qs, vectors, equal=("source",)), _lexical(qs, spark, d, ("source",)))
    return pool.select("question_id", "id", F.round("rrf", 9).alias("rrf"), F.round("dense", 6).alias("dense"), F.col("rank").cast("long").alias("rank"))


def crawl_root_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Even questions ask below a root that has rows (a language), odd ones below one that has none."""
    qs = questions(spark, d).withColumn("lang", F.when(F.col("question_id") % 2 == 0, "en").otherwise("none"))
    vectors = _vectors(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang"), "id", "left")
    return dense_with_fallback(qs, vectors, "lang", 20).select("question_id", "id", F.round("dense", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def last_mile_rank(spark: SparkSession, d: str) -> DataFrame:
    pool = _pool(spark, d)
    hits = vector_only_rerank(pool).select("question_id", "id", "rank", "score").join(_meta(spark, d, pool), "id").join(_asked(spark, d).select("question_id", "terms", "intent", "identifier"), "question_id")
    hits = rank_within(hits.withColumnRenamed("rank", "_r"), [F.asc("_r")])
    return last_mile(hits).select("question_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def retrieve_full(spark: SparkSession, d: str) -> DataFrame:
    """The whole path to direct hits, with a high threshold so that some questions fall back to weak evidence."""
    pool = _pool(spark, d)
    out = retrieve(_asked(spark, d), pool, _meta(spark, d, pool), threshold=0.9)
    return out.select("question_id", "id", "page", "tier", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _siblings(spark, d, direct):
    """The chunks of the hit pages by similarity, and whether one of the question's terms is in them."""
    qs = questions(spark, d).select("question_id", "qvec", X.expansion_terms(F.col("question")).alias("terms"))
    top = direct.select("question_id", "page").distinct().join(qs.select("question_id", "terms"), "question_id")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.concat_ws("/", "source", F.floor(F.col("doc_id") / 50).cast("string")).alias("page"))
    # The pages go to the texts, and only ids leave them; these go to the vectors.
    found = docs.join(broadcast_if_small(top), "page").select("question_id", "id", "page", F.exists("terms", lambda t: F.contains(F.lower("text"), t)).alias("matches"))
    met = _vectors(spark, d).join(broadcast_if_small(checkpointed(found)), "id").join(qs.select("question_id", "qvec"), "question_id")
    dot = F.aggregate(F.zip_with("qvec", "vec", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = met.select("question_id", "id", "page", F.round(dot, 6).alias("dot"), "matches")
    return scored.withColumn("sib_rank", F.row_number().over(W.partitionBy("question_id", "page").orderBy(F.desc("dot"), "id")) - 1)


def context_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Direct hits of questions, expanded and put in reading order; odd questions keep the hits of their best page alone."""
    pool = _pool(spark, d)
    direct = retrieve(_asked(spark, d), pool, _meta(spark, d, pool)).filter((F.col("question_id") % 2 == 0) | (F.col("rank") == 0)).select("question_id", "id", "page", "rank", "score")
    direct = checkpointed(direct)  # read by several steps: anchors, siblings, what is there already
    full = expand(direct, _siblings(spark, d, direct)).withColumn("chunk_index", F.col("id") % 50)
    return context_order(full).select("question_id", "id", "page", "direct", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


def _variant(qs):
    """A second wording of each question: its vector rounded, its text without the first word."""
    return qs.withColumn("qvec", F.transform("qvec", lambda x: F.round(x.cast("double"), 1))).withColumn("question", F.regexp_replace("question", r"^\S+\s*", ""))


def retrieve_many(spark: SparkSession, d: str) -> DataFrame:
    """Two wordings: their pools are fused and reranked once; the direct hits of both attempts are merged by rank.

    The second attempt asks the first wording alone, as the retry on a catalogue url does.
    """
    qs = questions(spark, d)
    first, second = _pool(spark, d, qs), _pool(spark, d, _variant(qs))
    both = fuse_pools(first.withColumn("pool", F.lit(0)).unionByName(second.withColumn("pool", F.lit(1))))
    asked, meta = _asked(spark, d), _meta(spark, d, both)
    lists = retrieve(asked, both, meta, 0.8, weak=False).withColumn("list_no", F.lit(0)).unionByName(retrieve(asked, first, meta, 0.8, weak=False).withColumn("list_no", F.lit(1)))
    merged = fuse_ranked_lists(lists.select("question_id", "list_no", "rank", "id", "score", "page"), ["page"])
    return merged.select("question_id", "id", "page", F.round("rrf", 9).alias("rrf"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def ranked_list_fusion(spark: SparkSession, d: str) -> DataFrame:
    qs = questions(spark, d)
    dense = dense_top_k(qs, _vectors(spark, d), 20).select("question_id", "id", "rank", F.col("dense").alias("score"), F.lit(0).alias("list_no"))
    other = dense_top_k(_variant(qs), _vectors(spark, d), 20).select("question_id", "id", "rank", F.col("dense").alias("score"), F.lit(1).alias("list_no"))
    return fuse_ranked_lists(dense.unionByName(other)).select("question_id", "id", F.round("rrf", 9).alias("rrf"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def cross_query_dedupe(spark: SparkSession, d: str) -> DataFrame:
    qs = questions(spark, d)
    lists = dense_top_k(qs, _vectors(spark, d), 20).withColumn("list_no", F.lit(0)).unionByName(dense_top_k(_variant(qs), _vectors(spark, d), 20).withColumn("list_no", F.lit(1)))
    return first_list_wins(lists).select("question_id", F.col("list_no").cast("long").alias("list_no"), "id", F.col("rank").cast("long").alias("rank"))


def catalog_union(spark: SparkSession, d: str) -> DataFrame:
    """Pages of the catalogue and of the index, told apart by canonical key: the catalogue's row, else the index's first."""
    p = table(spark, d, "pages").select("page_id", "url", F.col("page_id").alias("order"))
    catalogue = p.filter("page_id % 3 = 0").withColumn("list", F.lit("catalogue"))
    index = p.filter("page_id % 2 = 0").withColumn("list", F.lit("index"))
    return union_by_key([catalogue, index], X.url_key(F.col("url"))).select("page_id", "list")


def citation_sources(spark: SparkSession, d: str) -> DataFrame:
    """Three lists of cited urls, the first of each url stays; case, query, fragment and last slash don't matter."""
    key = F.lower(F.regexp_replace(F.regexp_replace(F.trim("url"), "[?#].*$", ""), "/+$", ""))
    p = table(spark, d, "pages").select("page_id", "url", (-F.col("page_id")).alias("order"))
    lists = [p.filter(F.col("page_id") % m == 0).withColumn("source", F.lit(name)) for m, name in ((5, "message"), (3, "tool"), (1, "retrieval"))]
    return union_by_key(lists, key).select("page_id", "source")


def _examples(spark, d):
    """Documents as example chunks: six of seven are examples, up to three parts each."""
    i = F.col("doc_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("code", "config", "api_response")]), (i % 3 + 1).cast("int"))
    body = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select(
        i.alias("id"), i.alias("order"), F.when(i % 7 != 0, "example").otherwise("text").alias("chunk_kind"), F.concat_ws("/", F.lit("https://e.org"), "source", F.floor(i / 30).cast("string")).alias("url"),
        F.floor(i % 30 / 3).cast("int").alias("example_index"), F.when(i % 4 != 0, F.concat(F.lit("Example "), i.cast("string"))).otherwise(" ").alias("title"), kind.alias("kind"),
        F.when(i % 5 != 0, F.col("lang")).alias("language"), body.alias("body"), F.when(i % 2 == 0, (i % 3).cast("int")).alias("part"),
    )


def example_catalog_q(spark: SparkSession, d: str) -> DataFrame:
    return example_catalog(_examples(spark, d)).withColumn("example_index", F.col("example_index").cast("long"))


def page_examples_q(spark: SparkSession, d: str) -> DataFrame:
    return page_examples(_examples(spark, d)).select("url", F.col("example_index").cast("long").alias("example_index"), F.sha2("body", 256).alias("body_hash"), "language")


def example_retrieval(spark: SparkSession, d: str) -> DataFrame:
    vectors = _vectors(spark, d).join(_examples(spark, d).select("id", "chunk_kind", "kind"), "id")
    return example_hits(questions(spark, d), vectors, ["code", "config"]).select("question_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), "relaxed")


def find_examples_q(spark: SparkSession, d: str) -> DataFrame:
    """Two wordings of each question; examples of one (url, index) count once."""
    meta = _examples(spark, d).select("id", "chunk_kind", "kind", "url", "example_index")
    vectors = _vectors(spark, d).join(meta.select("id", "chunk_kind", "kind"), "id")
    lists = None
    for n, qs in enumerate((questions(spark, d), _variant(questions(spark, d)))):
        mine = example_hits(qs, vectors).withColumn("list_no", F.lit(n))
        lists = mine if lists is None else lists.unionByName(mine)
    return find_examples(lists.join(meta.select("id", "url", "example_index"), "id")).select("question_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def escalated_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The strong score is the labels' quality."""
    ranked = vector_only_rerank(_pool(spark, d)).select("question_id", "id", "rank", "score")
    sem = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("strong"))
    return escalate(ranked, ranked.select("question_id", "id").join(sem, "id")).select("question_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def question_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Every third question has no hits."""
    ranked = vector_only_rerank(_pool(spark, d)).filter("question_id % 3 <> 0")
    return covered(questions(spark, d), ranked)


def _golden(spark, d, ranked):
    expected = _pages(questions(spark, d).select("question_id", F.col("question_id").alias("id")), spark, d).select("question_id", "page")
    other = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", F.floor(F.col("doc_id") / 50).cast("string")).alias("page"))
    rejected = questions(spark, d).select("question_id", (F.col("question_id") + 1).alias("id")).join(other, "id").select("question_id", "page")
    return golden_cases(_pages(ranked, spark, d), expected, rejected)


def golden_rejects(spark: SparkSession, d: str) -> DataFrame:
    return _golden(spark, d, _pool(spark, d))


def run_comparison(spark: SparkSession, d: str) -> DataFrame:
    """The lexical leg alone against both legs."""
    return compare_runs(_golden(spark, d, _lexical(questions(spark, d), spark, d)), _golden(spark, d, _pool(spark, d)))


def question_wordings(spark: SparkSession, d: str) -> DataFrame:
    q = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("```x = 1``` "), "text", F.lit("?!"))).otherwise(F.col("text"))
    capitals = F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    variants = F.array(capitals, F.concat(F.lit(" "), F.col("item_id").cast("string"), F.lit(" more ")), F.lit(""))
    return table(spark, d, "benchmark").select("item_id", F.size(wordings(q, variants)).cast("long").alias("wordings"), F.sha2(F.array_join(wordings(q, variants), "\n"), 256).alias("hash"), F.array_join(E.keyword_terms(F.col("text")), " ").alias("keywords"))


def rerank_queries(spark: SparkSession, d: str) -> DataFrame:
    """Passages with an error or code behind them."""
    more = F.array(F.lit(""), F.lit("\n  KeyError: 'name' in line 3\nwhy"), F.lit("\n```py\nimport os\nx = load(1)\n# no\ny = x + 2\n```\n"), F.lit(" see `call(one, two)` and a ValueError: bad thing"))
    plain = F.regexp_replace("text", r"[^A-Za-z ]", "")
    return table(spark, d, "benchmark").select("item_id", E.rerank_query(F.concat(plain, F.element_at(more, (F.col("item_id") % 4 + 1).cast("int")))).alias("query"))


def clamped_scores(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value") / 100 - 0.5
    return table(spark, d, "events").select("event_id", F.round(E.clamp_score(F.when(F.col("event_id") % 9 != 0, v)), 6).alias("clamped"), F.round(E.logistic(v), 6).alias("logistic"))


QUERIES = {
    "escalated_rerank": escalated_rerank, "question_coverage": question_coverage, "golden_rejects": golden_rejects, "run_comparison": run_comparison, "question_wordings": question_wordings, "clamped_scores": clamped_scores, "rerank_queries": rerank_queries,
    "filtered_topk": filtered_topk, "crawl_root_fallback": crawl_root_fallback, "last_mile_rank": last_mile_rank, "retrieve_full": retrieve_full, "context_expansion": context_expansion,
    "retrieve_many": retrieve_many, "ranked_list_fusion": ranked_list_fusion, "cross_query_dedupe": cross_query_dedupe, "catalog_union": catalog_union, "citation_sources": citation_sources,
    "example_catalog": example_catalog_q, "page_examples": page_examples_q, "example_retrieval": example_retrieval, "find_examples": find_examples_q,
}

_META = r"""cm AS (SELECT doc_id AS id, source || '/' || (doc_id // 50) AS page, doc_id % 50 AS chunk_index, regexp_extract_all(text, '[A-Za-z]+') AS w, source, right(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', '', 'g'), 240) AS tail FROM documents),
cmeta AS (SELECT id, page, chunk_index, CASE WHEN id % 3 <> 0 THEN 'packages/' || source || '/v' || (id % 4 + 1) || '/src/' || coalesce(w[1], 'x') || '.ts' END AS path, CASE WHEN id % 2 = 0 THEN w[2] END AS symbol,
  ['source', 'docs', 'test', 'example', 'config'][id % 5 + 1] AS kind, page || '::' || tail AS fp FROM cm)"""


def _asked_sql(q: str = "q") -> str:
    return rf"""terms0 AS (SELECT question_id, t, min(o) AS o FROM (SELECT question_id, {every_term_sql('question')} AS l FROM {q}), unnest(l) WITH ORDINALITY AS u(t, o) WHERE length(t) >= 2 AND t NOT IN ({_list(C.FILLER_WORDS)}) GROUP BY 1, 2),
terms1 AS (SELECT question_id, t, o, row_number() OVER (PARTITION BY question_id ORDER BY o) AS n FROM terms0),
asks AS (SELECT question_id, (SELECT coalesce(list(t), []) FROM terms1 WHERE terms1.question_id = {q}.question_id AND n <= 24 AND length(t) >= 3) AS terms,
  CASE WHEN regexp_matches(lower(question), '\b(how does|how is|how are|where is|implemented|implementation|internally)\b') THEN 'implementation' WHEN regexp_matches(lower(question), '\b(how do i|how to|example|snippet|usage|can i)\b') THEN 'usage' ELSE 'concept' END AS intent,
  CASE WHEN question_id % 3 = 0 THEN 'src' || (question_id % 2) END AS prefix FROM {q})"""


_M = "(t = k OR (length(t) >= 4 AND starts_with(k, t)) OR (length(k) >= 4 AND starts_with(t, k)))"


def _overlap(tokens: str) -> str:
    hit_t = f"len(list_filter(terms, lambda t: len(list_filter({tokens}, lambda k: {_M})) > 0))"
    hit_k = f"len(list_filter({tokens}, lambda k: len(list_filter(terms, lambda t: {_M})) > 0))"
    return f"CASE WHEN len(terms) > 0 AND len({tokens}) > 0 THEN greatest({hit_t} / len(terms)::DOUBLE, {hit_k} / len({tokens})::DOUBLE) ELSE 0 END"


def _tokens_sql(name: str) -> str:
    return f"flatten(list_transform(regexp_split_to_array(regexp_replace({name}, '[.][A-Za-z0-9]+$', ''), '[^A-Za-z0-9]+'), lambda z: {parts_sql('z')}))"


def _last_mile_sql(src: str, out: str) -> str:
    """Table ``out`` from ``src`` (question_id, id, rank, score); needs asks and cmeta."""
    return f"""{out}0 AS (SELECT s.question_id, s.id, s.rank, s.score, page, path, symbol, kind, terms, intent, list_filter(string_split(path, '/'), lambda x: x <> '') AS segs FROM {src} s JOIN cmeta USING (id) JOIN asks USING (question_id)),
{out}1 AS (SELECT *, {_tokens_sql("segs[-1]")} AS ft, flatten(list_transform(segs[1:len(segs) - 1], lambda y: {_tokens_sql('y')})) AS dt, {parts_sql('symbol')} AS st, regexp_replace(path, '/v[0-9]+/', '/v/') AS g, regexp_extract(path, '/v([0-9]+)/', 1)::DOUBLE AS v FROM {out}0),
{out}2 AS (SELECT *, CASE WHEN path IS NULL THEN 0 ELSE least(1, greatest({_overlap('ft')}, 0.4::DOUBLE * {_overlap('dt')})) END AS ps, CASE WHEN symbol IS NULL THEN 0 ELSE {_overlap('st')} END AS ss,
  CASE WHEN kind IN ('test', 'config') THEN 0 WHEN intent = 'implementation' THEN CASE kind WHEN 'source' THEN 1 WHEN 'docs' THEN 0.4::DOUBLE ELSE 0.6::DOUBLE END WHEN intent = 'usage' THEN CASE kind WHEN 'example' THEN 1 WHEN 'source' THEN 0.7::DOUBLE ELSE 0.6::DOUBLE END
    ELSE CASE kind WHEN 'docs' THEN 1 WHEN 'source' THEN 0.6::DOUBLE ELSE 0.7::DOUBLE END END AS ks,
  CASE WHEN v IS NULL THEN 0 ELSE least(0.30::DOUBLE, (max(v) OVER (PARTITION BY question_id, g) - v) * 0.15::DOUBLE) END AS vp, row_number() OVER (PARTITION BY question_id, page ORDER BY rank) - 1 AS seen, count(*) OVER (PARTITION BY question_id) AS n, count(path) OVER (PARTITION BY question_id) AS np FROM {out}1),
{out}3 AS (SELECT *, CASE WHEN n >= 2 AND np > 0 THEN round(0.6::DOUBLE / (1 + rank / 4.0::DOUBLE) + 0.4::DOUBLE * (ps * 0.55::DOUBLE + ss * 0.30::DOUBLE + ks * 0.15::DOUBLE) - CASE WHEN kind IN ('test', 'config') THEN 0.2::DOUBLE ELSE 0 END - vp - seen * 0.07::DOUBLE, 12) ELSE -rank END AS value,
  row_number() OVER (PARTITION BY question_id ORDER BY score DESC, rank) AS sp FROM {out}2),
{out}4 AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY value DESC, rank) AS place FROM {out}3),
{out} AS (SELECT a.question_id, a.id, a.page, a.place - 1 AS rank, CASE WHEN a.n >= 2 AND a.np > 0 THEN b.score ELSE a.score END AS score FROM {out}4 a JOIN {out}4 b ON a.question_id = b.question_id AND b.sp = a.place)"""


def _prune_sql(src: str, out: str, dedupe: bool = True) -> str:
    """Near duplicates, prefix, last mile and page cap of ``src`` (question_id, id, rank, score)."""
    first = f"SELECT *, row_number() OVER (PARTITION BY question_id, fp ORDER BY rank) AS k FROM {src} JOIN cmeta USING (id)" if dedupe else f"SELECT *, 1 AS k FROM {src} JOIN cmeta USING (id)"
    return f"""{out}a AS ({first}),
{out}b AS (SELECT {out}a.question_id, id, score, row_number() OVER (PARTITION BY {out}a.question_id ORDER BY rank) - 1 AS rank FROM {out}a JOIN asks USING (question_id) WHERE k = 1 AND (prefix IS NULL OR page = prefix OR starts_with(page, prefix || '/'))),
{_last_mile_sql(out + 'b', out + 'l')},
{out}c AS (SELECT *, row_number() OVER (PARTITION BY question_id, page ORDER BY rank) AS k FROM {out}l),
{out} AS (SELECT question_id, id, page, score, row_number() OVER (PARTITION BY question_id ORDER BY rank) - 1 AS rank FROM {out}c WHERE k <= 3)"""


_V = "v AS (SELECT question_id, list_transform(qvec, lambda x: round(x::DOUBLE, 1)) AS qvec, regexp_replace(question, '^\\S+\\s*', '') AS question FROM q)"
_DENSE_V = _DENSE.replace("dots", "dots1").replace("dense_all", "dense_all1").replace("dense AS (SELECT * FROM", "dense1 AS (SELECT * FROM").replace("FROM q,", "FROM v,")
_BM25_V = _BM25
for _n in ("ids", "asked", "heads", "toks", "stats", "postings", "dfs", "lex_all", "lex"):
    _BM25_V = re.sub(rf"\b{_n}\b", f"{_n}1", _BM25_V)
_BM25_V = _BM25_V.replace("FROM q)", "FROM v)").replace("FROM q,", "FROM v,")
_FUSED_V = _FUSED.split(",\nvec AS")[0].replace("both_legs", "both_legs1").replace("fused AS", "fused1 AS").replace("FROM dense d FULL JOIN lex x", "FROM dense1 d FULL JOIN lex1 x")
_RETRIEVE = f"{_META}, {_asked_sql()}"
_EX = """ex AS (SELECT doc_id AS id, doc_id % 7 <> 0 AS is_ex, 'https://e.org/' || source || '/' || (doc_id // 30) AS url, doc_id % 30 // 3 AS example_index, CASE WHEN doc_id % 4 <> 0 THEN 'Example ' || doc_id ELSE ' ' END AS title,
  ['code', 'config', 'api_response'][doc_id % 3 + 1] AS kind, CASE WHEN doc_id % 5 <> 0 THEN lang END AS language, coalesce(text, '') AS body, CASE WHEN doc_id % 2 = 0 THEN doc_id % 3 END AS part FROM documents)"""


def _example_sql(q: str, out: str, kinds: str) -> str:
    return f"""{out}d AS (SELECT question_id, vec_id AS id, round(list_dot_product(qvec::DOUBLE[], embedding::DOUBLE[]) / (sqrt(list_dot_product(qvec::DOUBLE[], qvec::DOUBLE[])) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 9) AS dense FROM {q}, embeddings JOIN ex ON ex.id = vec_id WHERE is_ex{kinds}),
{out}r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY dense DESC, id) - 1 AS rank FROM {out}d) WHERE rank < 50),
{out}s AS (SELECT * FROM (SELECT question_id, id, rank, round(0.6::DOUBLE * dense + 0.4::DOUBLE * (1 - rank / count(*) OVER (PARTITION BY question_id)), 9) AS score FROM {out}r) WHERE rank < 8),
{out} AS (SELECT question_id, id, score, rank, score < 0.65 AS relaxed FROM {out}s WHERE score >= 0.65 OR (score >= 0.5 AND question_id NOT IN (SELECT question_id FROM {out}s WHERE score >= 0.65)))"""


def _gold_sql(src: str, n: str) -> str:
    return f"""{n}r AS (SELECT question_id, page, rank FROM {src} JOIN meta USING (id)), {n}p AS (SELECT question_id, page, row_number() OVER (PARTITION BY question_id ORDER BY min(rank)) - 1 AS pr FROM {n}r GROUP BY 1, 2),
{n}h AS (SELECT question_id, min(pr) AS pr FROM {n}p JOIN ex USING (question_id, page) GROUP BY 1), {n}c AS (SELECT question_id, min(rank) + 1 AS f FROM {n}r JOIN ex USING (question_id, page) GROUP BY 1),
{n} AS (SELECT question_id, coalesce(pr < 1, false) AS hit_at_1, coalesce(pr < 3, false) AS hit_at_3, coalesce(pr < 5, false) AS hit_at_5, f AS first_rank, round(coalesce(1.0::DOUBLE / f, 0), 6) AS mrr, f IS NULL AS miss, EXISTS (SELECT 1 FROM {n}r JOIN rj USING (question_id, page) WHERE {n}r.question_id = e.question_id) AS reject_hit
  FROM (SELECT DISTINCT question_id FROM ex) e LEFT JOIN {n}h USING (question_id) LEFT JOIN {n}c USING (question_id))"""


_GOLD = "ex AS (SELECT question_id, page FROM q JOIN meta ON meta.id = question_id), rj AS (SELECT question_id, page FROM q JOIN meta ON meta.id = question_id + 1)"
ORACLE_SQL = {
    "escalated_rerank": f"""{_ALL}, t AS (SELECT question_id, max(score) FILTER (rank = 0) AS s0, max(score) FILTER (rank = 1) AS s1, max(score) FILTER (rank = 2) AS s2 FROM vec GROUP BY 1),
a AS (SELECT question_id, s0 < 0.70 OR coalesce(round(s0 - s1, 9) < 0.08, false) OR coalesce(round(s0 - s2, 9) < 0.12, false) AS amb FROM t),
e AS (SELECT question_id, vec.id, rank AS r, CASE WHEN amb AND rank < 10 THEN coalesce(quality::DOUBLE, score) ELSE score END AS score FROM vec JOIN a USING (question_id) LEFT JOIN labels ON doc_id = vec.id)
SELECT question_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, r) - 1 AS rank FROM e""",
    "question_coverage": f"""{_ALL}, t AS (SELECT question_id, round(max(score), 6) AS best, round(avg(score) FILTER (rank < 3), 6) AS mean3 FROM vec WHERE question_id % 3 <> 0 GROUP BY 1)
SELECT q.question_id, best, mean3, CASE WHEN best IS NULL THEN 'none' WHEN best >= 0.82 AND mean3 >= 0.75 THEN 'full' ELSE 'partial' END AS coverage FROM q LEFT JOIN t USING (question_id)""",
    "golden_rejects": f"{_ALL}, {_GOLD}, {_gold_sql('fused', 'g')} SELECT * FROM g",
    "run_comparison": f"""{_ALL}, {_GOLD}, {_gold_sql('lex', 'g')}, {_gold_sql('fused', 'k')}, c AS (SELECT question_id, (k.hit_at_1 AND NOT g.hit_at_1) OR coalesce(k.first_rank < g.first_rank, false) AS improved, (NOT k.hit_at_1 AND g.hit_at_1) OR coalesce(k.first_rank > g.first_rank, false) OR (k.reject_hit AND NOT g.reject_hit) AS regressed FROM k JOIN g USING (question_id))
SELECT * FROM c WHERE improved OR regressed""",
    "question_wordings": r"""WITH b AS (SELECT item_id, text, CASE WHEN item_id % 2 = 0 THEN '```x = 1``` ' || text || '?!' ELSE text END AS q FROM benchmark),
c AS (SELECT *, left(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(q, '(?s)```.*?```', ' ', 'g'), '`[^`]+`', ' ', 'g'), '[?!.,;:]+', ' ', 'g'), '\s+', ' ', 'g')), 400) AS c FROM b),
w AS (SELECT item_id, trim(w) AS w, i FROM c, unnest([c, q, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), ' ' || item_id || ' more ', '']) WITH ORDINALITY AS u(w, i)), f AS (SELECT item_id, first(w ORDER BY i) AS w, min(i) AS i FROM w WHERE w <> '' GROUP BY item_id, lower(w)),
k AS (SELECT item_id, w, min(i) AS i, row_number() OVER (PARTITION BY item_id ORDER BY min(i)) AS n FROM (SELECT item_id, list_transform(regexp_split_to_array(lower(trim(regexp_replace(regexp_replace(text, '[?!.,;:]+', ' ', 'g'), '\s+', ' ', 'g'))), '\s+'), lambda x: regexp_replace(x, '[^a-z0-9_.-]', '', 'g')) AS l FROM b), unnest(l) WITH ORDINALITY AS u(w, i) WHERE length(w) >= 3 GROUP BY 1, 2)
SELECT b.item_id, (SELECT count(*) FROM f WHERE f.item_id = b.item_id) AS wordings, (SELECT sha256(string_agg(w, chr(10) ORDER BY i)) FROM f WHERE f.item_id = b.item_id) AS hash, (SELECT coalesce(string_agg(w, ' ' ORDER BY i), '') FROM k WHERE k.item_id = b.item_id AND n <= 10) AS keywords FROM b""",
    "rerank_queries": r"""WITH b AS (SELECT item_id, item_id % 4 AS k, regexp_replace(text, '[^A-Za-z ]', '', 'g') AS s FROM benchmark), c AS (SELECT *, trim(regexp_replace(s, '\s+', ' ', 'g')) AS c, left(trim(s || ' see `call(one, two)` and a ValueError: bad thing'), 120) AS e FROM b)
SELECT item_id, left(trim(regexp_replace(CASE k WHEN 0 THEN left(c, 200) WHEN 1 THEN left(c || ' KeyError ''name'' in line 3 why', 200) || ' Error: KeyError: ''name'' in line 3' WHEN 2 THEN left(c, 200) || ' Snippet: x = load(1) y = x + 2'
  ELSE left(c || ' see and a ValueError bad thing', 200) || CASE WHEN contains(left(c || ' see and a ValueError bad thing', 200), left(e, 24)) THEN '' ELSE ' Error: ' || e END || ' Snippet: call(one, two)' END, '\s+', ' ', 'g')), 220) AS query FROM c""",
    "clamped_scores": "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 0 ELSE round(greatest(0, least(1, value / 100 - 0.5::DOUBLE)), 6) END AS clamped, round(1 / (1 + exp(-(value / 100 - 0.5::DOUBLE))), 6) AS logistic FROM events",
    "filtered_topk": "WITH " + _Q.replace("q AS (SELECT item_id", "q AS (SELECT CASE WHEN item_id % 2 = 0 THEN o.source END AS src, item_id").replace("ON e.vec_id = b.item_id", "ON e.vec_id = b.item_id JOIN documents o ON o.doc_id = b.item_id") + ", "
    + _DENSE.replace("FROM q, embeddings)", "FROM q, embeddings LEFT JOIN documents o ON o.doc_id = vec_id WHERE src IS NULL OR src = o.source)") + ", "
    + _BM25.replace("FROM postings JOIN dfs USING (term) JOIN asked USING (term), stats GROUP BY", "FROM postings JOIN dfs USING (term) JOIN asked USING (term) JOIN q USING (question_id) JOIN documents o ON o.doc_id = postings.id, stats WHERE src IS NULL OR src = o.source GROUP BY").replace("SELECT question_id, id, round(sum(CASE", "SELECT question_id, postings.id, round(sum(CASE").replace("GROUP BY question_id, id)", "GROUP BY question_id, postings.id)") + ", "
    + _FUSED + " SELECT question_id, id, round(rrf, 9) AS rrf, round(dense, 6) AS dense, rank FROM fused",
    "crawl_root_fallback": f"""WITH {_Q}, {_DENSE.replace('rank < 50', 'rank < 20')},
en AS (SELECT * FROM (SELECT question_id, id, dense, row_number() OVER (PARTITION BY question_id ORDER BY dense DESC, id) - 1 AS rank FROM dense_all JOIN documents ON doc_id = id WHERE lang = 'en' AND question_id % 2 = 0) WHERE rank < 20)
SELECT question_id, id, round(dense, 6) AS score, rank FROM en UNION ALL SELECT question_id, id, round(dense, 6), rank FROM dense WHERE question_id NOT IN (SELECT question_id FROM en)""",
    "last_mile_rank": f"{_ALL}, {_RETRIEVE}, h AS (SELECT question_id, id, score, row_number() OVER (PARTITION BY question_id ORDER BY rank) - 1 AS rank FROM vec JOIN cmeta USING (id)), {_last_mile_sql('h', 'lm')} SELECT question_id, id, round(score, 6) AS score, rank FROM lm",
    "retrieve_full": f"""{_ALL}, {_RETRIEVE}, hi AS (SELECT question_id, id, rank, score FROM vec WHERE score >= 0.9), {_prune_sql('hi', 'p')},
wk AS (SELECT question_id, id, score, row_number() OVER (PARTITION BY question_id ORDER BY rank) - 1 AS rank FROM vec WHERE score >= 0.15), wm AS (SELECT * FROM wk WHERE rank < 5 AND question_id NOT IN (SELECT question_id FROM p)), {_prune_sql('wm', 'pw', False)}
SELECT question_id, id, page, 'direct' AS tier, round(score, 6) AS score, rank FROM p UNION ALL SELECT question_id, id, page, 'weak', round(score, 6), rank FROM pw""",
    "context_expansion": f"""{_ALL}, {_RETRIEVE}, hi AS (SELECT question_id, id, rank, score FROM vec WHERE score >= 0.65), {_prune_sql('hi', 'p')},
wk AS (SELECT question_id, id, score, row_number() OVER (PARTITION BY question_id ORDER BY rank) - 1 AS rank FROM vec WHERE score >= 0.15), wm AS (SELECT * FROM wk WHERE rank < 5 AND question_id NOT IN (SELECT question_id FROM p)), {_prune_sql('wm', 'pw', False)},
dh AS (SELECT question_id, id, page, rank, score FROM (SELECT * FROM p UNION ALL SELECT * FROM pw) WHERE question_id % 2 = 0 OR rank = 0),
an AS (SELECT question_id, page, min(rank) AS r, first(score ORDER BY rank) AS anchor FROM dh GROUP BY 1, 2), pq AS (SELECT question_id, count(DISTINCT page) AS pages FROM dh GROUP BY 1),
tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY r) AS n FROM an) JOIN pq USING (question_id) WHERE n <= 2),
et AS (SELECT question_id, list(t) AS et FROM (SELECT question_id, t, row_number() OVER (PARTITION BY question_id ORDER BY length(t) DESC, min(o)) AS n FROM (SELECT question_id, regexp_split_to_array(lower(question), '[^a-z0-9]+') AS l FROM q), unnest(l) WITH ORDINALITY AS u(t, o) WHERE length(t) >= 3 AND t NOT IN ({_list(C.EXPANSION_FILLER)}) GROUP BY 1, 2) WHERE n <= 6 GROUP BY 1),
sb AS (SELECT tp.question_id, cmeta.id, tp.page, anchor, pages, round(list_dot_product(qvec::DOUBLE[], embedding::DOUBLE[]), 6) AS dot, coalesce(len(list_filter(et, lambda t: contains(lower(text), t))) > 0, false) AS m FROM tp JOIN cmeta USING (page) JOIN embeddings ON vec_id = cmeta.id JOIN q ON q.question_id = tp.question_id JOIN documents ON doc_id = cmeta.id LEFT JOIN et ON et.question_id = tp.question_id),
sr AS (SELECT *, row_number() OVER (PARTITION BY question_id, page ORDER BY dot DESC, id) - 1 AS sr FROM sb),
so AS (SELECT *, row_number() OVER (PARTITION BY question_id, page ORDER BY CASE WHEN sr < 10 THEN 0 ELSE 1 END, sr) AS o FROM sr WHERE sr < 10 OR (pages = 1 AND sr < 200 AND m)),
al AS (SELECT question_id, id, page, score, true AS direct FROM dh UNION ALL SELECT question_id, id, page, greatest(0, round(anchor - CASE WHEN sr < 10 THEN 0.01::DOUBLE ELSE 0.005::DOUBLE END, 9)), false FROM so WHERE o <= 48 AND NOT EXISTS (SELECT 1 FROM dh WHERE dh.question_id = so.question_id AND dh.id = so.id)),
lo AS (SELECT al.*, chunk_index, max(score) OVER w AS b, min(al.id) OVER w AS f FROM al JOIN cmeta ON cmeta.id = al.id WINDOW w AS (PARTITION BY al.question_id, al.page))
SELECT question_id, id, page, direct, round(score, 6) AS score, row_number() OVER (PARTITION BY question_id ORDER BY b DESC, f, chunk_index, id) - 1 AS place FROM lo""",
    "retrieve_many": f"""{_ALL}, {_V}, {_DENSE_V}, {_BM25_V}, {_FUSED_V}, {_RETRIEVE},
pools AS (SELECT 0 AS pool, question_id, id, dense, rank FROM fused UNION ALL SELECT 1, question_id, id, dense, rank FROM fused1),
sm AS (SELECT question_id, id, round(sum(1.0::DOUBLE / (60 + rank + 1)), 12) AS rrf, max(dense) AS dense, min(pool * 1000 + rank) AS f FROM pools GROUP BY 1, 2),
fpool AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rrf DESC, f, id) - 1 AS rank FROM sm),
v2 AS (SELECT question_id, id, rank, round(0.6::DOUBLE * dense + 0.4::DOUBLE * (1 - rank / count(*) OVER (PARTITION BY question_id)), 9) AS score FROM fpool),
h0 AS (SELECT question_id, id, rank, score FROM v2 WHERE score >= 0.8), {_prune_sql('h0', 'p')}, h1 AS (SELECT question_id, id, rank, score FROM vec WHERE score >= 0.8), {_prune_sql('h1', 'p9')},
ls AS (SELECT 0 AS no, * FROM p UNION ALL SELECT 1, * FROM p9),
mg AS (SELECT question_id, id, round(sum(1.0::DOUBLE / (60 + rank + 1)), 12) AS rrf, first(score ORDER BY score DESC, no) AS score, first(page) AS page, min(no * 1000 + rank) AS f FROM ls GROUP BY 1, 2)
SELECT question_id, id, page, round(rrf, 9) AS rrf, round(score, 6) AS score, row_number() OVER (PARTITION BY question_id ORDER BY rrf DESC, f, id) - 1 AS rank FROM mg""",
    "ranked_list_fusion": f"""WITH {_Q}, {_DENSE.replace('rank < 50', 'rank < 20')}, {_V}, {_DENSE_V.replace('rank < 50', 'rank < 20')}, l AS (SELECT 0 AS no, * FROM dense UNION ALL SELECT 1, * FROM dense1),
m AS (SELECT question_id, id, round(sum(1.0::DOUBLE / (60 + rank + 1)), 12) AS rrf, max(dense) AS score, min(no * 1000 + rank) AS f FROM l GROUP BY 1, 2) SELECT question_id, id, round(rrf, 9) AS rrf, round(score, 6) AS score, row_number() OVER (PARTITION BY question_id ORDER BY rrf DESC, f, id) - 1 AS rank FROM m""",
    "cross_query_dedupe": f"""WITH {_Q}, {_DENSE.replace('rank < 50', 'rank < 20')}, {_V}, {_DENSE_V.replace('rank < 50', 'rank < 20')}, l AS (SELECT 0 AS list_no, * FROM dense UNION ALL SELECT 1, * FROM dense1), k AS (SELECT *, row_number() OVER (PARTITION BY question_id, id ORDER BY list_no, rank) AS n FROM l)
SELECT question_id, list_no::BIGINT AS list_no, id, row_number() OVER (PARTITION BY question_id, list_no ORDER BY rank) - 1 AS rank FROM k WHERE n = 1""",
    "catalog_union": r"""WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS s, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www[.]', '') AS h, list_filter(string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^v?[0-9]+([.][0-9]+)*$')) AS g FROM pages),
k AS (SELECT page_id, s || '://' || h || '/' || array_to_string(g, '/') AS key FROM p), l AS (SELECT page_id, key, 0 AS n, 'catalogue' AS list FROM k WHERE page_id % 3 = 0 UNION ALL SELECT page_id, key, 1, 'index' FROM k WHERE page_id % 2 = 0)
SELECT first(page_id ORDER BY n, page_id) AS page_id, first(list ORDER BY n, page_id) AS list FROM l GROUP BY key""",
    "citation_sources": r"""WITH k AS (SELECT page_id, lower(regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '/+$', '')) AS key FROM pages), l AS (SELECT page_id, key, 0 AS n, 'message' AS source FROM k WHERE page_id % 5 = 0 UNION ALL SELECT page_id, key, 1, 'tool' FROM k WHERE page_id % 3 = 0 UNION ALL SELECT page_id, key, 2, 'retrieval' FROM k)
SELECT first(page_id ORDER BY n, page_id DESC) AS page_id, first(source ORDER BY n, page_id DESC) AS source FROM l WHERE key <> '' GROUP BY key""",
    "example_catalog": f"WITH {_EX}, k AS (SELECT *, row_number() OVER (PARTITION BY url, example_index ORDER BY id) AS n FROM ex WHERE is_ex) SELECT url, example_index, coalesce(nullif(trim(title), ''), url) AS title, kind, language FROM k WHERE n = 1",
    "page_examples": f"""WITH RECURSIVE {_EX}, k AS (SELECT *, row_number() OVER (PARTITION BY url, example_index ORDER BY id) AS n FROM ex WHERE is_ex),
f AS (SELECT url, example_index, n, body, part, language FROM k WHERE n = 1 UNION ALL
  SELECT f.url, f.example_index, k.n, CASE WHEN b THEN k.body ELSE f.body END, CASE WHEN b THEN NULL ELSE f.part END, CASE WHEN b THEN coalesce(k.language, f.language) ELSE coalesce(nullif(f.language, ''), k.language) END
  FROM f JOIN k ON k.url = f.url AND k.example_index = f.example_index AND k.n = f.n + 1, LATERAL (SELECT length(k.body) > length(f.body) OR (k.part IS NULL AND f.part IS NOT NULL) AS b))
SELECT url, example_index, sha256(first(body ORDER BY n DESC)) AS body_hash, arg_max(struct_pack(l := language), n).l AS language FROM f GROUP BY 1, 2""",
    "example_retrieval": f"WITH {_Q}, {_EX}, {_example_sql('q', 'x', chr(32) + 'AND kind IN (' + chr(39) + 'code' + chr(39) + ', ' + chr(39) + 'config' + chr(39) + ')')} SELECT question_id, id, round(score, 6) AS score, rank, relaxed FROM x",
    "find_examples": f"""WITH {_Q}, {_EX}, {_V}, {_example_sql('q', 'x', '')}, {_example_sql('v', 'y', '')}, l AS (SELECT 0 AS no, * FROM x UNION ALL SELECT 1, * FROM y),
k AS (SELECT l.*, row_number() OVER (PARTITION BY question_id, url, example_index ORDER BY no, rank) AS n FROM l JOIN ex USING (id))
SELECT * FROM (SELECT question_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, no, rank) - 1 AS rank FROM k WHERE n = 1) WHERE rank < 8""",
}
