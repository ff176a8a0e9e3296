"""Cover density: documents ranked by how closely the terms of a question stand together.

A question is a set of needs, each met by any of its terms. A cover is an interval of a document that meets every need and holds no
shorter one that does. It counts the harmonic mean of the weights of the asked terms in it (heading A, body B), divided by one more than the
number of other words between them; a document's density is the sum over its covers. The places come from the stored index.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import constants as C
from ..functions.text import query_terms
from ..sources.store import Store
from ..sources.tables import questions, table
from .lexical_index import asked_postings, corpus_index
from .retrieval import _FILLER, QUESTION_BLOCK, every_term_sql, rank_within

#: The weights of a place in the heading (A) and in the body (B).
HEAD_WEIGHT, BODY_WEIGHT = 1.0, 0.4
#: Documents to a task, and places of pairs that a task holds at once.
DOCS, CELLS = 4000, 4_000_000


def _needs(asked: DataFrame) -> DataFrame:
    """question_id, term, need from 0, needs: a term asked for by two needs counts for the lower one alone, which may leave the other unmet."""
    numbered = asked.withColumn("need", F.dense_rank().over(W.partitionBy("question_id").orderBy("need")) - 1)
    whole = numbered.withColumn("needs", F.max("need").over(W.partitionBy("question_id")) + 1)
    return whole.groupBy("question_id", "term").agg(F.min("need").alias("need"), F.max("needs").alias("needs"))


def _spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items of some sizes: the item of each element, and the element's number within it."""
    return np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def rounded(x: np.ndarray) -> np.ndarray:
    """As Spark's round to six digits: halves of the shortest decimal go up."""
    y = x * 1e6
    out = np.floor(y + 0.5) / 1e6
    for i in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-3):  # few: only these may be halves
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("1e-6"), ROUND_HALF_UP))
    return out


def covers(pair: np.ndarray, at: np.ndarray, need: np.ndarray, needs: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of pairs, sorted by pair and place -> the pairs with a cover, the number of their covers, and their densities.

    Running maxima hold the last place of each need, and the earliest of them begins the shortest interval that ends here. It is a
    cover if no earlier place ends one with that beginning.
    """
    here = np.arange(len(pair))
    new = np.diff(pair, prepend=-1) != 0
    begin = np.full(len(pair), len(pair))
    for g in range(int(needs.max(initial=0))):
        begin = np.minimum(begin, np.where(g < needs, np.maximum.accumulate(np.where(need == g, here, -1)), len(pair)))
    met = begin >= np.maximum.accumulate(np.where(new, here, 0))
    ends = met.copy()
    ends[1:] &= new[1:] | ~met[:-1] | (begin[:-1] < begin[1:])
    last = np.flatnonzero(ends)
    first = begin[last]
    inverse = np.where(head, 1 / HEAD_WEIGHT, 1 / BODY_WEIGHT)
    upto = np.cumsum(inverse)
    n = last - first + 1
    density = n / (upto[last] - upto[first] + inverse[first]) / (1 + at[last] - at[first] + 1 - n)
    found, no = np.unique(pair[last], return_inverse=True)
    return found, np.bincount(no, minlength=len(found)), np.bincount(no, density, len(found))


def _best_of_tasks(postings: DataFrame, wanted: DataFrame, single: bool, k: int, parts: int) -> DataFrame:
    """The k best documents of each question in each task: question_id, id, covers, density. Postings are dealt by document, each once.

    A task does its documents and the questions in pieces of about CELLS places of pairs.
    """
    spark = postings.sparkSession
    rows = wanted.filter(F.col("term").isNotNull()).toArrow()  # at most about QUESTION_BLOCK questions and their terms
    column = lambda c: rows.column(c).combine_chunks()
    terms, asking = column("term").dictionary_encode(), column("question_id").dictionary_encode("encode")
    n_questions = len(asking.dictionary)
    key = terms.indices.to_numpy().astype(np.int64) * n_questions + asking.indices.to_numpy()
    order = np.argsort(key)
    needs = np.ones(n_questions, dtype=np.int64)
    needs[asking.indices.to_numpy()] = column("needs").to_numpy()
    shared = spark.sparkContext.broadcast((asking.dictionary, key[order], column("need").to_numpy()[order], needs, np.arange(len(terms.dictionary)) * n_questions))
    numbers = F.broadcast(spark.createDataFrame(pd.DataFrame({"term": terms.dictionary.to_pylist(), "no": range(len(terms.dictionary))}), "term string, no int"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, keys, ask_need, needs, first_key = shared.value
        held = [b for b in batches if b.num_rows]
        if not held or not len(names):
            return
        mine = pa.Table.from_batches(held).combine_chunks()  # the postings of about DOCS documents
        coded = mine.column("id").combine_chunks().dictionary_encode("encode")
        by_id = pc.array_sort_indices(coded.dictionary, null_placement="at_start").to_numpy()
        ids = coded.dictionary.take(pa.array(by_id))
        doc = np.argsort(by_id)[coded.indices.to_numpy()]  # documents are numbered in the order of their ids
        order = np.argsort(doc, kind="stable")
        doc, no, heads, size = doc[order], *[mine.column(c).to_numpy()[order].astype(np.int64) for c in ("no", "heads", "size")]
        spots = None if single else mine.column("places").combine_chunks().take(pa.array(order)).flatten().to_numpy()
        offset = np.cumsum(size) - size

        def pieces(low: int, high: int, q_low: int, q_high: int) -> Iterator[tuple]:
            at = slice(*np.searchsorted(doc, (low, high)))
            start, end = (np.searchsorted(keys, first_key + q)[no[at]] for q in (q_low, q_high))
            cells = max((high - low) * (q_high - q_low), (end - start).sum()) if single else ((end - start) * size[at]).sum()
            if cells > CELLS and high - low > 1:
                mid = (low + high) // 2
                yield from pieces(low, mid, q_low, q_high)
                yield from pieces(mid, high, q_low, q_high)
            elif cells > CELLS and q_high - q_low > 1:
                mid = (q_low + q_high) // 2
                yield from pieces(low, high, q_low, mid)
                yield from pieces(low, high, mid, q_high)
            elif cells:
                yield at, start, end - start, q_low, q_high - q_low, low, high - low

        def scored(at: slice, start: np.ndarray, many: np.ndarray, q_low: int, n_q: int, low: int, n_docs: int) -> tuple[np.ndarray, ...]:
            posting, nth = _spread(many)
            ask = start[posting] + nth
            q = keys[ask] % len(names)
            pair = (q - q_low) * n_docs + doc[at][posting] - low
            if single:  # each place is a cover of its own
                both = [np.bincount(pair, c[at][posting], n_q * n_docs) for c in (size, heads)]
                found = np.flatnonzero(both[0])
                number, head = (c[found] for c in both)
                return found // n_docs + q_low, found % n_docs + low, number.astype(np.int64), head * HEAD_WEIGHT + (number - head) * BODY_WEIGHT
            each, nth = _spread(size[at][posting])
            place = spots[offset[at][posting][each] + nth].astype(np.int64)
            by = np.argsort(pair[each] * (place.max(initial=0) + 1) + place)
            head = (nth < heads[at][posting][each])[by]
            each = each[by]
            found, number, density = covers(pair[each], place[by], ask_need[ask][each], needs[q][each], head)
            return found // n_docs + q_low, found % n_docs + low, number, density

        best, least = [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.float64)], np.full(len(names), -1.0)
        for piece in pieces(0, len(ids), 0, len(names)):
            new = scored(*piece)
            new = [c[new[3] >= least[new[0]] - 1e-6] for c in new]
            q, d, number, density = (np.concatenate(c) for c in zip(best, [*new[:3], rounded(new[3])]))
            order = np.lexsort((d, -density, q))
            q, d, number, density = (c[order] for c in (q, d, number, density))
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            least[q[rank == k - 1]] = density[rank == k - 1]
            best = [c[rank < k] for c in (q, d, number, density)]
        yield pa.RecordBatch.from_arrays([names.take(pa.array(best[0])), ids.take(pa.array(best[1])), pa.array(best[2]), pa.array(best[3])], names=["question_id", "id", "covers", "density"])

    kinds = {f.name: f.dataType.simpleString() for f in [*wanted.schema, *postings.schema]}
    met = postings.join(numbers, "term").select("id", "no", "heads", F.size("places").alias("size"), *([] if single else ["places"]))
    return met.repartition(parts, "id").mapInArrow(scan, f"question_id {kinds['question_id']}, id {kinds['id']}, covers long, density double")


def cover_density(store: Store, asked: DataFrame, k: int = C.LEXICAL_TOP_K) -> DataFrame:
    """asked: question_id, need, term -> question_id, id, covers, density, rank, over an index with positions.

    The questions go to the tasks in blocks of QUESTION_BLOCK, and a task keeps the k best documents of each, so that only these are ranked.
    Where every question has one need, each place is a cover of its own, and no place leaves the index.
    """
    wanted = _needs(asked).persist()
    single = (wanted.agg(F.max("needs")).first()[0] or 1) == 1
    postings = asked_postings(store, wanted.select("term"))
    parts = 1 + store.table("totals").first()["n"] // DOCS
    blocks = max(1, -(-wanted.select("question_id").distinct().count() // QUESTION_BLOCK))
    found = None
    for part in range(blocks):
        mine = wanted if blocks == 1 else wanted.filter(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == part)
        best = _best_of_tasks(postings, mine, single, k, parts)
        found = best if found is None else found.unionByName(best)
    return rank_within(found, [F.desc("density"), F.asc("id")]).filter(F.col("rank") < k)


# --- queries over the tables ---------------------------------------------------------------------------------------


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """question_id, place, term of the questions, each with the source of the document of its number before it."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("question_id"), "source")
    text = F.concat_ws(" ", "source", "question")
    return questions(spark, d).join(docs, "question_id").select("question_id", F.posexplode(query_terms(text)).alias("place", "term"))


def _store(spark: SparkSession, d: str) -> Store:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "source", F.col("source").alias("heading"))
    return corpus_index(spark, d, docs, name="places", positions=True)


def _shown(found: DataFrame) -> DataFrame:
    return found.select("question_id", "id", F.col("covers").cast("long").alias("covers"), "density", F.col("rank").cast("long").alias("rank"))


def cover_density_any(spark: SparkSession, d: str) -> DataFrame:
    """Documents with any term of a question."""
    return _shown(cover_density(_store(spark, d), _asked(spark, d).withColumn("need", F.lit(0))))


def cover_density_needs(spark: SparkSession, d: str) -> DataFrame:
    """Documents that meet three needs: the terms of a question are dealt over them in turn."""
    return _shown(cover_density(_store(spark, d), _asked(spark, d).withColumn("need", F.col("place") % 3)))


QUERIES = {"cover_density_any": cover_density_any, "cover_density_needs": cover_density_needs}

_PLACES = rf"""q AS (SELECT item_id AS question_id, concat_ws(' ', source, b.text) AS question FROM benchmark b JOIN embeddings ON vec_id = item_id JOIN documents ON doc_id = item_id),
ids AS (SELECT question_id, t AS term, ord FROM (SELECT question_id, {every_term_sql('question')} AS l FROM q), unnest(l) WITH ORDINALITY AS u(t, ord)),
asked AS (SELECT question_id, term, (n - 1) % 3 AS need FROM (SELECT question_id, term, row_number() OVER (PARTITION BY question_id ORDER BY min(ord)) AS n FROM ids
  WHERE length(term) >= 2 AND term NOT IN ({_FILLER}) GROUP BY 1, 2) WHERE n <= 24),
h AS (SELECT doc_id, coalesce(regexp_extract_all(lower(source), '[\p{{L}}\p{{N}}]+'), []) AS hl, coalesce(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), []) AS l FROM documents),
p AS (SELECT doc_id AS id, t AS term, i AS spot, i <= len(hl) AS head FROM h, unnest(list_concat(hl, l)) WITH ORDINALITY AS u(t, i)),
hits AS (SELECT question_id, id, need, spot, head FROM p JOIN asked USING (term))"""
_RANKED = "SELECT * FROM (SELECT question_id, id, covers, density, row_number() OVER (PARTITION BY question_id ORDER BY density DESC, id) - 1 AS rank FROM s) WHERE rank < 20"
#: The other way round: for each place the nearest place of every need from there on; the last of these ends the interval, and of the intervals with one end the latest beginning counts.
ORACLE_SQL = {
    "cover_density_any": f"WITH {_PLACES}, s AS (SELECT question_id, id, count(*) AS covers, round(sum(CASE WHEN head THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END), 6) AS density FROM hits GROUP BY 1, 2) {_RANKED}",
    "cover_density_needs": f"""WITH {_PLACES},
f AS (SELECT *, min(spot) FILTER (need = 0) OVER w AS a, min(spot) FILTER (need = 1) OVER w AS b, min(spot) FILTER (need = 2) OVER w AS c FROM hits WINDOW w AS (PARTITION BY question_id, id ORDER BY spot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
v AS (SELECT question_id, id, max(spot) AS lo, greatest(a, b, c) AS hi FROM f WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL GROUP BY question_id, id, hi),
e AS (SELECT question_id, id, lo, hi, count(*) AS n, sum(CASE WHEN head THEN 1.0::DOUBLE ELSE 2.5::DOUBLE END) AS inv FROM v JOIN hits USING (question_id, id) WHERE spot BETWEEN lo AND hi GROUP BY ALL),
s AS (SELECT question_id, id, count(*) AS covers, round(sum(n / inv / (1 + hi - lo + 1 - n)), 6) AS density FROM e GROUP BY 1, 2) {_RANKED}""",
}
