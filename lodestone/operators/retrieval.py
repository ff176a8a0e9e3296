"""Retrieval: dense and lexical candidates, fusion, reranking, pruning, coverage.

Every stage carries question_id first and an explicit rank from 0, so one question or many run the same plan. Chunk texts
are never shuffled: ids go through ranking. Question sets are small and counted before they are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import constants as C
from ..functions.text import index_heading, index_terms, query_terms
from ..sources.tables import checkpointed, questions, table

QUESTION_LIMIT, QUESTION_BYTES, QUESTION_BLOCK = 100_000, 64_000_000, 10_000
#: Scores of questions by rows that a task holds at once.
SCORE_CELLS = 4_000_000


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Broadcast only where the rows are counted few, and beyond a thousand their bytes as JSON too; else Spark chooses the join."""
    rows = df.count()
    if rows > QUESTION_LIMIT or (rows > 1000 and (df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0) > QUESTION_BYTES):
        return df
    return F.broadcast(df)


def rank_within(df: DataFrame, order: list[Column], out: str = "rank", by: str = "question_id") -> DataFrame:
    return df.withColumn(out, F.row_number().over(W.partitionBy(by).orderBy(*order)) - 1)


def dense_top_k(qs: DataFrame, vectors: DataFrame, k: int = C.DENSE_TOP_K, equal: tuple[str, ...] = ()) -> DataFrame:
    """qs: question_id, qvec; vectors: id, vec -> question_id, id, dense, rank. A stated query set against all rows.

    ``equal`` names columns of both sides: a row answers a question only where it has the question's value, or the question
    has none. The questions go to the tasks as one matrix, in blocks of QUESTION_BLOCK; each batch of rows is one matrix
    product, and a task keeps the k best rows of each question, so that only these are ranked. Rows of another dimension,
    and without or with a zero vector, have no similarity.
    """
    blocks = max(1, -(-qs.count() // QUESTION_BLOCK))
    found = None
    for part in range(blocks):
        mine = qs if blocks == 1 else qs.filter(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == part)
        best = _best_of_tasks(mine, vectors, k, equal)
        found = best if found is None else found.unionByName(best)
    return rank_within(found, [F.desc("dense"), F.asc("id")]).filter(F.col("rank") < k)


def _best_of_tasks(qs: DataFrame, vectors: DataFrame, k: int, equal: tuple[str, ...]) -> DataFrame:
    asked = qs.select("question_id", "qvec", *equal).filter(F.col("qvec").isNotNull()).toPandas()  # at most about QUESTION_BLOCK rows
    groups = [(n, g) for n, g in asked.groupby(asked["qvec"].map(len))] if len(asked) else []
    packed = [(n, g["question_id"].to_numpy(), _unit(np.array(g["qvec"].tolist(), dtype=np.float64)), [g[c].to_numpy(dtype=object) for c in equal]) for n, g in groups if n]
    shared = vectors.sparkSession.sparkContext.broadcast(packed)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None] = [None] * len(shared.value)
        for batch in batches:
            sizes = batch["vec"].map(lambda v: -1 if v is None else len(v)).to_numpy()
            for i, (n, questions, m, wanted) in enumerate(shared.value):
                rows = batch[sizes == n]
                if not len(rows):
                    continue
                scores = np.round(m @ _unit(np.array(rows["vec"].tolist(), dtype=np.float64)).T, 9)
                for want, column in zip(wanted, equal):
                    have = rows[column].to_numpy(dtype=object)
                    none = np.array([w is None or w != w for w in want])
                    scores[~(none[:, None] | (want[:, None] == have[None, :]))] = np.nan
                ids = np.broadcast_to(rows["id"].to_numpy(), scores.shape)
                if best[i] is not None:
                    scores, ids = np.hstack([best[i][0], scores]), np.hstack([best[i][1], ids])
                order = np.lexsort((ids, np.where(np.isnan(scores), np.inf, -scores)))[:, :k]
                best[i] = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
        for (_, questions, _, _), held in zip(shared.value, best):
            if held is not None:
                scores, ids = held
                at, col = np.nonzero(~np.isnan(scores))
                yield pd.DataFrame({"question_id": questions[at], "id": ids[at, col], "dense": scores[at, col]})

    kinds = {f.name: f.dataType.simpleString() for f in [*qs.schema, *vectors.schema]}
    return vectors.select("id", "vec", *equal).filter(F.col("id").isNotNull()).mapInPandas(scan, f"question_id {kinds['question_id']}, id {kinds['id']}, dense double")


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.sqrt((m * m).sum(1))
    return m / np.where(length > 0, length, np.nan)[:, None]


def asked_terms(qs: DataFrame, equal: tuple[str, ...] = ()) -> DataFrame:
    """question_id, term, and the question's values of ``equal`` as _q_<name>."""
    return qs.select("question_id", *[F.col(c).alias(f"_q_{c}") for c in equal], F.explode(query_terms(F.col("question"))).alias("term"))


def chunk_terms(chunks: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, len, and the terms of each chunk in order, those of its heading and those of its text: head, body."""
    none = F.expr("cast(array() as array<string>)")
    heading = F.coalesce(index_terms(F.col("heading")), none) if "heading" in chunks.columns else none
    tokens = chunks.select("id", *carry, F.coalesce(index_terms(F.col("text")), none).alias("body"), heading.alias("head"))
    return tokens.select("id", *carry, (F.size("body") + F.size("head")).alias("len"), "head", "body")


def term_weights(chunks: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, len, terms: array<struct<term, w>> of each chunk; a term in the heading counts HEADING_WEIGHT times."""
    once = lambda c, w: F.transform(c, lambda t: F.struct(t.alias("term"), F.lit(w).alias("w")))
    return chunk_terms(chunks, carry).select("id", *carry, "len", F.concat(once("head", C.HEADING_WEIGHT), once("body", 1)).alias("terms"))


def bm25_ranked(postings: DataFrame, asked: DataFrame, stats: DataFrame, k: int, equal: tuple[str, ...] = ()) -> DataFrame:
    """postings: id, len, term, tf of all asked terms; stats: n_docs, avg_len in one row -> question_id, id, lexical, rank.

    The questions' terms go to the tasks with their weights, in blocks of QUESTION_BLOCK questions. Postings are dealt by id, each once however
    many questions ask for it, and a task keeps the k best rows of each question, so that only these are ranked.
    """
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    n = F.col("n_docs").cast("double")
    idf = F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
    weights = df.crossJoin(F.broadcast(stats)).select("term", weight.alias("weight"))  # one row
    blocks = max(1, -(-asked.select("question_id").distinct().count() // QUESTION_BLOCK))
    found = None
    for part in range(blocks):
        mine = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == part)
        best = _bm25_of_tasks(postings, mine.join(weights, "term"), stats, k, equal)
        found = best if found is None else found.unionByName(best)
    return rank_within(found, [F.desc("lexical"), F.asc("id")]).filter(F.col("rank") < k)


def _bm25_of_tasks(postings: DataFrame, weighed: DataFrame, stats: DataFrame, k: int, equal: tuple[str, ...]) -> DataFrame:
    spark = postings.sparkSession
    rows = weighed.select("question_id", "term", "weight", *[f"_q_{c}" for c in equal]).toPandas()  # at most about QUESTION_BLOCK questions of MAX_QUERY_TERMS terms
    no, terms = pd.factorize(rows["term"])
    q, names = pd.factorize(rows["question_id"])
    order = np.argsort(no, kind="stable")
    counts = np.bincount(no, minlength=len(terms)) if len(rows) else np.zeros(0, dtype=np.int64)
    first = rows.iloc[np.unique(q, return_index=True)[1]]
    wanted = [first[f"_q_{c}"].to_numpy(dtype=object) for c in equal]
    shared = spark.sparkContext.broadcast((np.asarray(names), wanted, q[order], rows["weight"].to_numpy(dtype=np.float64)[order], counts, np.cumsum(counts) - counts))
    numbers = F.broadcast(spark.createDataFrame(pd.DataFrame({"term": list(terms), "no": range(len(terms))}), "term string, no int"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, wanted, asks, weight, counts, starts = shared.value
        held = [b for b in batches if len(b)]
        if not held or not len(names):
            return
        mine = pd.concat(held, ignore_index=True)  # a part of the shuffle
        doc, ids = pd.factorize(mine["id"])
        order = np.argsort(doc, kind="stable")
        doc, no, value = doc[order], mine["no"].to_numpy()[order], mine["part"].to_numpy()[order]
        once = mine.drop_duplicates("id")
        have = [once[c].to_numpy(dtype=object) for c in equal]
        best, size = None, max(1, SCORE_CELLS // len(names))
        for low in range(0, len(ids), size):
            high = min(low + size, len(ids))
            at = slice(*np.searchsorted(doc, (low, high)))
            many = counts[no[at]]
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts[no[at]], many)
            cell = asks[step] * (high - low) + np.repeat(doc[at] - low, many)
            scores = np.bincount(cell, np.repeat(value[at], many) * weight[step], len(names) * (high - low)).reshape(len(names), high - low)
            scores = np.where(scores > 0, np.round(scores, 6), -1.0)
            for want, column in zip(wanted, have):
                none = np.array([w is None or w != w for w in want])
                scores[~(none[:, None] | (want[:, None] == column[None, low:high]))] = -1.0
            least = np.partition(scores, high - low - k, axis=1)[:, [high - low - k]] if high - low > k else 0.0
            row, col = np.nonzero((scores >= least) & (scores >= 0))
            new = pd.DataFrame({"q": row, "id": ids[low + col], "lexical": scores[row, col]})
            new = new if best is None else pd.concat([best, new])
            best = new.sort_values(["q", "lexical", "id"], ascending=[True, False, True]).groupby("q").head(k)
        yield pd.DataFrame({"question_id": names[best["q"].to_numpy()], "id": best["id"].to_numpy(), "lexical": best["lexical"].to_numpy()})

    k1, b = C.BM25_K1, C.BM25_B
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    dealt = postings.join(numbers, "term").select("id", "no", "tf", "len", *equal).repartition("id").crossJoin(F.broadcast(stats)).select("id", "no", part.alias("part"), *equal)
    kinds = {f.name: f.dataType.simpleString() for f in [*weighed.schema, *postings.schema]}
    return dealt.mapInPandas(scan, f"question_id {kinds['question_id']}, id {kinds['id']}, lexical double").withColumn("lexical", F.round("lexical", 6))


def bm25_top_k(qs: DataFrame, chunks: DataFrame, k: int = C.LEXICAL_TOP_K, equal: tuple[str, ...] = ()) -> DataFrame:
    """qs: question_id, question; chunks: id, text, and heading if there is one -> question_id, id, lexical, rank.

    A term in the heading counts HEADING_WEIGHT times. Corpus statistics are over all chunks, also where ``equal`` (see
    dense_top_k) leaves few to a question. Only postings of terms that are asked for leave the scan. This reads every text for each set of
    questions: ``lexical_index`` keeps the postings on disk and answers without the texts.
    """
    asked = asked_terms(qs, equal)
    sized = term_weights(chunks, equal)
    stats = sized.agg(F.count("*").alias("n_docs"), F.avg(F.col("len").cast("double")).alias("avg_len"))
    said = sized.select("id", *equal, "len", F.explode("terms").alias("t")).select("id", *equal, "len", "t.term", "t.w")
    postings = said.join(broadcast_if_small(asked.select("term").distinct()), "term").groupBy("id", *equal, "len", "term").agg(F.sum("w").alias("tf"))
    return bm25_ranked(postings, asked, stats, k, equal)


def fuse_hybrid(dense: DataFrame, lexical: DataFrame, k: int = C.DENSE_TOP_K) -> DataFrame:
    """Reciprocal rank fusion of both legs. Rows of the lexical leg alone take the lowest dense score of the question."""
    weight = lambda c: F.coalesce(1.0 / (C.RRF_K + F.col(c) + 1), F.lit(0.0))
    d = dense.select("question_id", "id", "dense", F.col("rank").alias("dense_rank"))
    x = lexical.select("question_id", "id", F.col("rank").alias("lexical_rank"))
    both = d.join(x, ["question_id", "id"], "full_outer").withColumn("rrf", F.round(weight("dense_rank") + weight("lexical_rank"), 12))
    least = F.min("dense").over(W.partitionBy("question_id"))
    scored = both.withColumn("dense", F.coalesce("dense", least, F.lit(0.0)))
    return rank_within(scored, [F.desc("rrf"), F.asc_nulls_last("dense_rank"), F.asc("lexical_rank")]).filter(F.col("rank") < k)


def fuse_pools(pools: DataFrame) -> DataFrame:
    """question_id, pool, id, dense, rank -> one ranking per question; the dense score is the best over the pools."""
    n = F.size(F.collect_set("pool").over(W.partitionBy("question_id")))
    summed = pools.withColumn("_n", n).groupBy("question_id", "id").agg(F.round(F.sum(1.0 / (C.RRF_K + F.col("rank") + 1)), 12).alias("rrf"), F.max("dense").alias("dense"), F.min(F.struct("pool", "rank")).alias("first"))
    return rank_within(summed, [F.desc("rrf"), F.asc("first"), F.asc("id")]).drop("first")


def position_share(rank: str = "rank") -> Column:
    return 1.0 - F.col(rank) / F.count("*").over(W.partitionBy("question_id"))


def vector_only_rerank(pool: DataFrame) -> DataFrame:
    """0.6 vector + 0.4 position; the order stays."""
    return pool.withColumn("score", F.round(0.6 * F.col("dense") + 0.4 * position_share(), 9))


def weighted_rerank(pool: DataFrame, k: int = C.FINAL_TOP_K) -> DataFrame:
    """0.5 semantic + 0.3 vector + 0.2 position, best first; a missing semantic score counts 0."""
    score = C.SEMANTIC_WEIGHT * F.coalesce("semantic", F.lit(0.0)) + C.VECTOR_WEIGHT * F.col("dense") + C.POSITION_WEIGHT * position_share()
    scored = pool.withColumn("score", F.round(score, 9)).withColumnRenamed("rank", "pool_rank")
    return rank_within(scored, [F.desc("score"), F.asc("pool_rank")]).filter(F.col("rank") < k)


def ambiguous(ranked: DataFrame) -> DataFrame:
    """question_id, top, gap2, gap3, ambiguous: a low top score, or small gaps to the second or third."""
    top = ranked.filter(F.col("rank") < 3).groupBy("question_id").agg(*[F.max(F.when(F.col("rank") == i, F.col("score"))).alias(f"s{i}") for i in range(3)])
    gap2, gap3 = F.round(F.col("s0") - F.col("s1"), 9), F.round(F.col("s0") - F.col("s2"), 9)
    flag = (F.col("s0") < 0.70) | F.coalesce(gap2 < 0.08, F.lit(False)) | F.coalesce(gap3 < 0.12, F.lit(False))
    return top.select("question_id", F.round("s0", 6).alias("top"), F.round(gap2, 6).alias("gap2"), F.round(gap3, 6).alias("gap3"), flag.alias("ambiguous"))


def first_per(df: DataFrame, key: list[str], keep: int = 1) -> DataFrame:
    """The first rows by rank of each key within a question; ranks close up after."""
    n = F.row_number().over(W.partitionBy("question_id", *key).orderBy("rank"))
    return rank_within(df.withColumn("_n", n).filter(F.col("_n") <= keep).drop("_n").withColumnRenamed("rank", "_r"), [F.asc("_r")]).drop("_r")


def coverage(ranked: DataFrame) -> DataFrame:
    """Best score, mean of the best three, and none, partial or full."""
    top = ranked.groupBy("question_id").agg(F.round(F.max("score"), 6).alias("best"), F.round(F.avg(F.when(F.col("rank") < 3, F.col("score"))), 6).alias("mean3"))
    full = (F.col("best") >= C.COVERAGE_MAX) & (F.col("mean3") >= C.COVERAGE_AVG)
    return top.withColumn("coverage", F.when(full, "full").otherwise("partial"))


def round_robin(merged: DataFrame, limit: int = 24) -> DataFrame:
    """question_id, source_no, rank, id with ids of one source each: by rank within the source, then source."""
    return rank_within(merged.withColumnRenamed("rank", "_r"), [F.asc("_r"), F.asc("source_no")]).filter(F.col("rank") < limit).drop("_r")


def tiers(ranked: DataFrame) -> DataFrame:
    """The first tier of a question that has rows: strict, relaxed, or at most five weak ones."""
    level = F.when(F.col("score") >= C.STRICT_THRESHOLD, 0).when(F.col("score") >= C.RELAXED_THRESHOLD, 1).when(F.col("score") >= C.WEAK_THRESHOLD, 2)
    best = F.min("level").over(W.partitionBy("question_id"))
    kept = ranked.withColumn("level", level).filter(F.col("level").isNotNull()).withColumn("best", best).filter(F.col("level") <= F.col("best"))
    weak = F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("score"), "rank"))
    kept = kept.withColumn("_w", weak).filter((F.col("best") < 2) | (F.col("_w") <= C.WEAK_TOP_K))
    return kept.withColumn("tier", F.element_at(F.array(F.lit("strict"), F.lit("relaxed"), F.lit("weak")), F.col("best") + 1)).drop("level", "best", "_w")


def cascade_peek(dense: DataFrame) -> DataFrame:
    """The three best raw hits of the questions whose best reaches the cascade threshold."""
    top = F.max("dense").over(W.partitionBy("question_id"))
    return dense.withColumn("_t", top).filter((F.col("_t") >= C.CASCADE_THRESHOLD) & (F.col("rank") < C.CASCADE_TOP_K)).drop("_t")


def golden_metrics(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """Per question: hit among the first 1, 3, 5 distinct pages, rank of the first matching chunk from 1, reciprocal rank, miss."""
    pages = ranked.groupBy("question_id", "page").agg(F.min("rank").alias("rank"))
    paged = rank_within(pages.withColumnRenamed("rank", "_r"), [F.asc("_r")], "page_rank").drop("_r")
    page_hit = paged.join(expected, ["question_id", "page"]).groupBy("question_id").agg(F.min("page_rank").alias("page_hit"))
    chunk_hit = ranked.join(expected, ["question_id", "page"]).groupBy("question_id").agg((F.min("rank") + 1).alias("first"))
    all_q = expected.select("question_id").distinct()
    out = all_q.join(page_hit, "question_id", "left").join(chunk_hit, "question_id", "left")
    hits = [F.coalesce(F.col("page_hit") < k, F.lit(False)).alias(f"hit_at_{k}") for k in (1, 3, 5)]
    return out.select("question_id", *hits, F.col("first").cast("long").alias("first_rank"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.col("first").isNull().alias("miss"))


# --- queries over the tables ---------------------------------------------------------------------------------------


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def _chunks(spark, d):
    """Documents as chunks, with their source and language as headings."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", index_heading([F.col("source"), F.col("lang")]).alias("heading"), "source")


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    out = dense_top_k(questions(spark, d), _vectors(spark, d))
    return out.select("question_id", "id", F.round("dense", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _lexical(qs: DataFrame, spark: SparkSession, d: str, equal: tuple[str, ...] = ()) -> DataFrame:
    """The lexical leg, from the corpus' stored index."""
    from .lexical_index import corpus_index, search

    return checkpointed(search(corpus_index(spark, d, _chunks(spark, d)), qs, equal=equal))  # k rows a question


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    out = _lexical(questions(spark, d), spark, d)
    return out.select("question_id", "id", F.round("lexical", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


def _fused(spark, d, qs=None):
    """The fused candidates, a bounded pool for each question, kept so that what follows may use them often and search once."""
    qs = questions(spark, d) if qs is None else qs
    return checkpointed(fuse_hybrid(dense_top_k(qs, _vectors(spark, d)), _lexical(qs, spark, d)))


def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).select("question_id", "id", F.round("rrf", 9).alias("rrf"), F.round("dense", 6).alias("dense"), F.col("rank").cast("long").alias("rank"))


def _pages(df: DataFrame, spark, d) -> DataFrame:
    """Pages are the sources' sections of 50 documents."""
    meta = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", F.floor(F.col("doc_id") / 50).cast("string")).alias("page"))
    return meta.join(broadcast_if_small(df), "id")


def hybrid_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """Fusion, vector-only rerank, tiers, per-page cap, the best eight."""
    tiered = tiers(vector_only_rerank(_fused(spark, d)))
    capped = first_per(_pages(tiered, spark, d), ["page"], C.PER_PAGE_CAP).filter(F.col("rank") < C.FINAL_TOP_K)
    return capped.select("question_id", "id", "page", "tier", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def vector_rerank(spark: SparkSession, d: str) -> DataFrame:
    return vector_only_rerank(_fused(spark, d)).select("question_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def weighted_rerank_q(spark: SparkSession, d: str) -> DataFrame:
    """The semantic score is the labels' quality where there is one."""
    sem = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("semantic"))
    return weighted_rerank(_fused(spark, d).join(sem, "id", "left")).select("question_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def rrf_multi_pool(spark: SparkSession, d: str) -> DataFrame:
    """Pools: the dense leg, and the nearest to the query rounded to one digit as a second variant of it."""
    qs = questions(spark, d)
    other = qs.withColumn("qvec", F.transform("qvec", lambda x: F.round(x.cast("double"), 1)))
    pools = dense_top_k(qs, _vectors(spark, d), 20).withColumn("pool", F.lit(0)).unionByName(dense_top_k(other, _vectors(spark, d), 20).withColumn("pool", F.lit(1)))
    return fuse_pools(pools).select("question_id", "id", F.round("rrf", 9).alias("rrf"), F.round("dense", 6).alias("dense"), F.col("rank").cast("long").alias("rank"))


def ambiguous_ranking_flag(spark: SparkSession, d: str) -> DataFrame:
    return ambiguous(vector_only_rerank(_fused(spark, d)))


def score_summary_coverage(spark: SparkSession, d: str) -> DataFrame:
    return coverage(vector_only_rerank(_fused(spark, d)))


def per_page_cap(spark: SparkSession, d: str) -> DataFrame:
    return first_per(_pages(_fused(spark, d), spark, d), ["page"], C.PER_PAGE_CAP).select("question_id", "id", "page", F.col("rank").cast("long").alias("rank"))


def cascade_peek_q(spark: SparkSession, d: str) -> DataFrame:
    """The question's own vector is among the rows, so the best similarity is 1."""
    return cascade_peek(dense_top_k(questions(spark, d), _vectors(spark, d))).select("question_id", "id", F.round("dense", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def page_repeat_penalty(spark: SparkSession, d: str) -> DataFrame:
    seen = F.row_number().over(W.partitionBy("question_id", "page").orderBy("rank")) - 1
    return _pages(_fused(spark, d), spark, d).select("question_id", "id", F.round(seen * C.PAGE_REPEAT_PENALTY, 6).alias("penalty"))


def page_grouping(spark: SparkSession, d: str) -> DataFrame:
    """Context order: pages by best score, chunks of a page by id."""
    hits = _pages(vector_only_rerank(_fused(spark, d)), spark, d)
    per = W.partitionBy("question_id", "page")
    laid = hits.withColumn("_best", F.max("score").over(per)).withColumn("_seen", F.min("rank").over(per)).withColumnRenamed("rank", "_r")
    return rank_within(laid, [F.desc("_best"), F.asc("_seen"), F.asc("id")], "position").select("question_id", "page", "id", F.col("position").cast("long").alias("position"))


def round_robin_merge(spark: SparkSession, d: str) -> DataFrame:
    """The three sources with the best hits of a question, in turn."""
    hits = vector_only_rerank(_fused(spark, d)).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source"), "id")
    ranked = rank_within(hits.withColumnRenamed("rank", "_r"), [F.asc("_r")], "rank", "question_id").drop("_r")
    own = F.row_number().over(W.partitionBy("question_id", "source").orderBy("rank")) - 1
    lead = F.min("rank").over(W.partitionBy("question_id", "source"))
    numbered = ranked.withColumn("own", own).withColumn("lead", lead).withColumn("source_no", F.dense_rank().over(W.partitionBy("question_id").orderBy("lead")) - 1).filter(F.col("source_no") < 3)
    return round_robin(numbered.drop("rank").withColumnRenamed("own", "rank")).select("question_id", "source", "id", F.col("rank").cast("long").alias("rank"))


def golden_metrics_q(spark: SparkSession, d: str) -> DataFrame:
    """Expected: the page of the document whose vector the question has."""
    expected = _pages(questions(spark, d).select("question_id", F.col("question_id").alias("id")), spark, d).select("question_id", "page")
    return golden_metrics(_pages(_fused(spark, d), spark, d), expected)


QUERIES = {
    "dense_topk": dense_topk, "bm25_topk": bm25_topk, "rrf_hybrid": rrf_hybrid, "rrf_multi_pool": rrf_multi_pool, "vector_only_rerank": vector_rerank,
    "weighted_rerank": weighted_rerank_q, "ambiguous_ranking_flag": ambiguous_ranking_flag, "score_summary_coverage": score_summary_coverage,
    "per_page_cap": per_page_cap, "cascade_peek": cascade_peek_q, "page_repeat_penalty": page_repeat_penalty, "page_grouping": page_grouping,
    "round_robin_merge": round_robin_merge, "golden_metrics": golden_metrics_q, "hybrid_retrieve": hybrid_retrieve,
}

_Q = """q AS (SELECT item_id AS question_id, b.text AS question, e.embedding AS qvec FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id)"""
_DENSE = """dots AS (
  SELECT question_id, vec_id AS id, list_dot_product(qvec::DOUBLE[], embedding::DOUBLE[]) AS ab,
         list_dot_product(qvec::DOUBLE[], qvec::DOUBLE[]) AS aa, list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS bb FROM q, embeddings),
dense_all AS (SELECT question_id, id, round(ab / (sqrt(aa) * sqrt(bb)), 9) AS dense FROM dots WHERE aa > 0 AND bb > 0),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY dense DESC, id) - 1 AS rank FROM dense_all) WHERE rank < 50)"""
_FILLER = ", ".join(f"'{w}'" for w in C.FILLER_WORDS)
def parts_sql(i: str) -> str:
    """split_identifier in SQL."""
    s = i
    for a, b in (("([a-z0-9])([A-Z])", r"\1 \2"), ("([A-Z]+)([A-Z][a-z])", r"\1 \2"), ("([A-Za-z])([0-9])", r"\1 \2"), ("([0-9])([A-Za-z])", r"\1 \2")):
        s = f"regexp_replace({s}, '{a}', '{b}', 'g')"
    parts = f"list_filter(regexp_split_to_array(lower({s}), '[^a-z0-9]+'), lambda p: p <> '')"
    return f"list_filter(string_split(array_to_string(list_transform({parts}, lambda p: CASE WHEN length(p) = 1 THEN p ELSE p || ' ' END), ''), ' '), lambda p: length(p) >= 2)"


_IDS = "[A-Za-z_$][A-Za-z0-9_$]*"


def every_term_sql(text: str) -> str:
    """Identifiers and the parts of compound ones, in order."""
    return f"flatten(list_transform(regexp_extract_all({text}, '{_IDS}'), lambda i: list_concat([lower(i)], CASE WHEN regexp_matches(i, '[A-Z_$0-9]') THEN {parts_sql('i')} ELSE [] END)))"


def heading_parts_sql(heading: str) -> str:
    """The distinct parts of compound identifiers, unordered."""
    return f"list_distinct(flatten(list_filter(list_transform(list_filter(regexp_extract_all({heading}, '{_IDS}'), lambda i: regexp_matches(i, '[A-Z_$0-9]')), lambda i: {parts_sql('i')}), lambda p: len(p) >= 2)))"


_BM25 = f"""ids AS (
  SELECT question_id, t AS term, ord FROM (SELECT question_id, {every_term_sql('question')} AS l FROM q), unnest(l) WITH ORDINALITY AS u(t, ord)),
asked AS (
  SELECT question_id, term FROM (
    SELECT question_id, term, row_number() OVER (PARTITION BY question_id ORDER BY min(ord)) AS n FROM ids
    WHERE length(term) >= 2 AND term NOT IN ({_FILLER}) GROUP BY question_id, term) WHERE n <= 24),
heads AS (SELECT doc_id, CASE WHEN lang = source THEN source ELSE concat_ws(' ', nullif(trim(source), ''), nullif(trim(lang), '')) END AS h FROM documents),
toks AS (SELECT doc_id AS id, coalesce(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), []) AS l, coalesce(list_concat(regexp_extract_all(lower(h), '[\\p{{L}}\\p{{N}}]+'), {heading_parts_sql('h')}), []) AS hl FROM documents JOIN heads USING (doc_id)),
stats AS (SELECT count(*)::DOUBLE AS n, avg((len(l) + len(hl))::DOUBLE) AS avg_len FROM toks),
postings AS (SELECT id, len, term, sum(w) AS tf FROM (SELECT id, len(l) + len(hl) AS len, unnest(l) AS term, 1 AS w FROM toks UNION ALL SELECT id, len(l) + len(hl), unnest(hl), 5 FROM toks) WHERE term IN (SELECT term FROM asked) GROUP BY id, len, term),
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
lex_all AS (
  SELECT question_id, id, round(sum(CASE WHEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) END
         * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))), 6) AS lexical
  FROM postings JOIN dfs USING (term) JOIN asked USING (term), stats GROUP BY question_id, id),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY lexical DESC, id) - 1 AS rank FROM lex_all) WHERE rank < 20)"""
_FUSED = """both_legs AS (
  SELECT coalesce(d.question_id, x.question_id) AS question_id, coalesce(d.id, x.id) AS id, dense, d.rank AS dr, x.rank AS lr,
         round(coalesce(1.0::DOUBLE / (60 + d.rank + 1), 0) + coalesce(1.0::DOUBLE / (60 + x.rank + 1), 0), 12) AS rrf
  FROM dense d FULL JOIN lex x ON d.question_id = x.question_id AND d.id = x.id),
fused AS (
  SELECT * FROM (SELECT question_id, id, rrf, coalesce(dense, min(dense) OVER (PARTITION BY question_id), 0) AS dense,
    row_number() OVER (PARTITION BY question_id ORDER BY rrf DESC, dr NULLS LAST, lr NULLS LAST) - 1 AS rank FROM both_legs) WHERE rank < 50),
vec AS (SELECT *, round(0.6::DOUBLE * dense + 0.4::DOUBLE * (1 - rank / count(*) OVER (PARTITION BY question_id)), 9) AS score FROM fused),
meta AS (SELECT doc_id AS id, source, source || '/' || (doc_id // 50)::VARCHAR AS page FROM documents)"""
_ALL = f"WITH {_Q}, {_DENSE}, {_BM25}, {_FUSED}"

ORACLE_SQL = {
    "dense_topk": f"WITH {_Q}, {_DENSE} SELECT question_id, id, round(dense, 6) AS score, rank FROM dense",
    "bm25_topk": f"WITH {_Q}, {_BM25} SELECT question_id, id, round(lexical, 4) AS score, rank FROM lex",
    "rrf_hybrid": f"{_ALL} SELECT question_id, id, round(rrf, 9) AS rrf, round(dense, 6) AS dense, rank FROM fused",
    "rrf_multi_pool": f"""WITH {_Q}, {_DENSE.replace('dots', 'dots0').replace('dense_all', 'dense_all0').replace('dense AS (SELECT * FROM', 'dense0 AS (SELECT * FROM').replace('rank < 50', 'rank < 20')},
q1 AS (SELECT question_id, list_transform(qvec, lambda x: round(x::DOUBLE, 1)) AS qvec FROM q),
{_DENSE.replace('dots', 'dots1').replace('dense_all', 'dense_all1').replace('dense AS (SELECT * FROM', 'dense1 AS (SELECT * FROM').replace('rank < 50', 'rank < 20').replace('FROM q,', 'FROM q1,')},
pools AS (SELECT 0 AS pool, * FROM dense0 UNION ALL SELECT 1, * FROM dense1),
summed AS (SELECT question_id, id, round(sum(1.0::DOUBLE / (60 + rank + 1)), 12) AS rrf, max(dense) AS dense, min(pool * 1000 + rank) AS f FROM pools GROUP BY 1, 2)
SELECT question_id, id, round(rrf, 9) AS rrf, round(dense, 6) AS dense, row_number() OVER (PARTITION BY question_id ORDER BY rrf DESC, f, id) - 1 AS rank FROM summed""",
    "vector_only_rerank": f"{_ALL} SELECT question_id, id, round(score, 6) AS score, rank FROM vec",
    "weighted_rerank": f"""{_ALL}, w AS (SELECT question_id, fused.id, rank AS pr, round(0.5::DOUBLE * coalesce(quality, 0) + 0.3::DOUBLE * dense + 0.2::DOUBLE * (1 - rank / count(*) OVER (PARTITION BY question_id)), 9) AS score
FROM fused LEFT JOIN labels ON doc_id = fused.id)
SELECT * FROM (SELECT question_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, pr) - 1 AS rank FROM w) WHERE rank < 8""",
    "ambiguous_ranking_flag": f"""{_ALL}, t AS (SELECT question_id, max(score) FILTER (rank = 0) AS s0, max(score) FILTER (rank = 1) AS s1, max(score) FILTER (rank = 2) AS s2 FROM vec GROUP BY 1)
SELECT question_id, round(s0, 6) AS top, round(round(s0 - s1, 9), 6) AS gap2, round(round(s0 - s2, 9), 6) AS gap3,
(s0 < 0.70 OR coalesce(round(s0 - s1, 9) < 0.08, false) OR coalesce(round(s0 - s2, 9) < 0.12, false)) AS ambiguous FROM t""",
    "score_summary_coverage": f"""{_ALL}, t AS (SELECT question_id, round(max(score), 6) AS best, round(avg(score) FILTER (rank < 3), 6) AS mean3 FROM vec GROUP BY 1)
SELECT *, CASE WHEN best >= 0.82 AND mean3 >= 0.75 THEN 'full' ELSE 'partial' END AS coverage FROM t""",
    "per_page_cap": f"""{_ALL}, p AS (SELECT fused.*, page, row_number() OVER (PARTITION BY question_id, page ORDER BY rank) AS n FROM fused JOIN meta USING (id))
SELECT question_id, id, page, row_number() OVER (PARTITION BY question_id ORDER BY rank) - 1 AS rank FROM p WHERE n <= 3""",
    "cascade_peek": f"WITH {_Q}, {_DENSE} SELECT question_id, id, round(dense, 6) AS score, rank FROM dense WHERE rank < 3 AND question_id IN (SELECT question_id FROM dense WHERE dense >= 0.80)",
    "page_repeat_penalty": f"{_ALL} SELECT question_id, id, round((row_number() OVER (PARTITION BY question_id, page ORDER BY rank) - 1) * 0.07::DOUBLE, 6) AS penalty FROM fused JOIN meta USING (id)",
    "page_grouping": f"""{_ALL}, p AS (SELECT question_id, page, id, max(score) OVER w AS b, min(rank) OVER w AS s FROM vec JOIN meta USING (id) WINDOW w AS (PARTITION BY question_id, page))
SELECT question_id, page, id, row_number() OVER (PARTITION BY question_id ORDER BY b DESC, s, id) - 1 AS position FROM p""",
    "round_robin_merge": f"""{_ALL}, h AS (SELECT question_id, source, id, row_number() OVER (PARTITION BY question_id ORDER BY rank) - 1 AS rank FROM vec JOIN meta USING (id)),
o AS (SELECT *, row_number() OVER (PARTITION BY question_id, source ORDER BY rank) - 1 AS own, min(rank) OVER (PARTITION BY question_id, source) AS lead FROM h),
n AS (SELECT *, dense_rank() OVER (PARTITION BY question_id ORDER BY lead) - 1 AS no FROM o)
SELECT * FROM (SELECT question_id, source, id, row_number() OVER (PARTITION BY question_id ORDER BY own, no) - 1 AS rank FROM n WHERE no < 3) WHERE rank < 24""",
    "golden_metrics": f"""{_ALL}, ex AS (SELECT question_id, page FROM q JOIN meta ON meta.id = question_id),
r AS (SELECT question_id, page, rank FROM fused JOIN meta USING (id)),
p AS (SELECT question_id, page, row_number() OVER (PARTITION BY question_id ORDER BY min(rank)) - 1 AS pr FROM r GROUP BY 1, 2),
ph AS (SELECT question_id, min(pr) AS pr FROM p JOIN ex USING (question_id, page) GROUP BY 1),
ch AS (SELECT question_id, min(rank) + 1 AS f FROM r JOIN ex USING (question_id, page) GROUP BY 1)
SELECT question_id, coalesce(pr < 1, false) AS hit_at_1, coalesce(pr < 3, false) AS hit_at_3, coalesce(pr < 5, false) AS hit_at_5, f AS first_rank, round(coalesce(1.0::DOUBLE / f, 0), 6) AS mrr, f IS NULL AS miss
FROM (SELECT DISTINCT question_id FROM ex) LEFT JOIN ph USING (question_id) LEFT JOIN ch USING (question_id)""",
    "hybrid_retrieve": f"""{_ALL}, l AS (SELECT *, CASE WHEN score >= 0.65 THEN 0 WHEN score >= 0.50 THEN 1 WHEN score >= 0.15 THEN 2 END AS level FROM vec),
b AS (SELECT *, min(level) OVER (PARTITION BY question_id) AS best FROM l WHERE level IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, rank) AS w FROM b WHERE level <= best),
c AS (SELECT k.*, page, row_number() OVER (PARTITION BY question_id, page ORDER BY rank) AS n FROM k JOIN meta USING (id) WHERE best < 2 OR w <= 5)
SELECT * FROM (SELECT question_id, id, page, ['strict', 'relaxed', 'weak'][best + 1] AS tier, round(score, 6) AS score, row_number() OVER (PARTITION BY question_id ORDER BY rank) - 1 AS rank FROM c WHERE n <= 3) WHERE rank < 8""",
}
