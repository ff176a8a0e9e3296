"""Embedders and rerankers by name, called in batches inside the tasks, with fall-backs.

A backend is a Python function over lists: an embedder takes texts and returns vectors, a reranker takes a question and texts and returns
scores. ``register_embedder`` and ``register_reranker`` name it; a chain of names is resolved on the driver and travels with the task, so
executors need no registry (a function of a module is sent by name, so executors must be able to import it). A backend that raises, or returns another number of results, hands over to the next one. The
column ``backend`` says which one answered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as X
from ..sources.tables import table
from .chunking import _CHUNKS, chunk_windows
from .retrieval import _ALL, _fused, broadcast_if_small, position_share, rank_within
from .structure import example_chunks

Embedder = Callable[[list[str]], list[list[float]]]
Reranker = Callable[[str, list[str]], list[float]]
BATCH = 32
#: What remains when no reranker of a chain answers: the order of the candidates, scored by vector and position.
VECTOR = "vector"
_EMBEDDERS: dict[str, Embedder] = {}
_RERANKERS: dict[str, Reranker] = {}


def register_embedder(name: str, f: Embedder) -> None:
    _EMBEDDERS[name] = f


def register_reranker(name: str, f: Reranker) -> None:
    if name == VECTOR:
        raise ValueError(f"{VECTOR} is the fall-back of every chain")
    _RERANKERS[name] = f


def chain_of(backend: str) -> list[str]:
    """The rerankers that are tried for a choice: a remote one is followed by the local ones, a local one by none but the vector order."""
    if backend == VECTOR:
        return []
    if backend.startswith("cohere"):
        return [backend, "local-auto", "local-mini"]
    return [backend]


def choose_reranker(asked: str | None = None, configured: str | None = None, code_ratio: float = 0.0) -> str:
    """What is asked for, else what is configured if a backend has that name, else vector for candidates mostly of code, else local-auto."""
    if asked:
        return asked
    if configured and (configured in _RERANKERS or configured == VECTOR):
        return configured
    return VECTOR if code_ratio >= C.CODE_RATIO else "local-auto"


def _resolved(names: list[str], known: dict[str, Callable]) -> list[tuple[str, Callable]]:
    missing = [n for n in names if n not in known]
    if missing:
        raise ValueError(f"no backend is registered as {missing}")
    return [(n, known[n]) for n in names]


def embed(chunks: DataFrame, chain: list[str], batch: int = BATCH) -> DataFrame:
    """chunks with a text -> the same with vec and backend. Texts go to the backend in batches, null as empty.

    A backend that fails is not asked again in its partition: the batch that failed and those after it go to the next one. Vectors of
    one partition can thus come from two models, which ``backend`` tells apart. Where all have failed the error of the last one is raised.
    """
    if not chain:
        raise ValueError("an embedder is needed")
    tried = _resolved(chain, _EMBEDDERS)
    if {"vec", "backend"} & set(chunks.columns):
        raise ValueError("the chunks have a column vec or backend already")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = list(tried)
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                texts = [t if isinstance(t, str) else "" for t in part["text"]]
                while True:
                    try:
                        vectors = left[0][1](texts)
                        if len(vectors) != len(texts):
                            raise ValueError(f"{left[0][0]} returned {len(vectors)} vectors for {len(texts)} texts")
                        break
                    except Exception:
                        if len(left) == 1:
                            raise
                        left.pop(0)
                yield part.assign(vec=[[float(x) for x in v] for v in vectors], backend=left[0][0])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    return chunks.mapInPandas(work, f"{fields}, vec array<double>, backend string")


def rerank(pool: DataFrame, qs: DataFrame, texts: DataFrame, chain: list[str], k: int = C.FINAL_TOP_K, batch: int = BATCH) -> DataFrame:
    """pool: question_id, id, dense, rank; qs: question_id, question; texts: id, text -> question_id, id, score, backend, rank.
    A candidate without a text is scored as an empty one.

    The candidates of a question, a bounded pool, are scored by one backend, since scores of two do not compare: where it
    fails in any batch the whole question goes to the next one, and at last keeps its order. Only candidates' texts leave the scan.
    """
    tried = _resolved(chain, _RERANKERS)
    held = texts.join(broadcast_if_small(pool.select("id").distinct()), "id", "left_semi").select("id", "text")
    rows = pool.select("question_id", "id", "rank").join(held, "id", "left").join(qs.select("question_id", "question"), "question_id", "left")

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank", kind="stable")
        asked = frame["question"].iloc[0]
        said = [t if isinstance(t, str) else "" for t in frame["text"]]
        for name, f in tried:
            try:
                scores: list[float] = []
                for start in range(0, len(said), batch):
                    part = said[start : start + batch]
                    got = [float(s) for s in f(asked if isinstance(asked, str) else "", part)]
                    if len(got) != len(part):
                        raise ValueError(f"{name} returned {len(got)} scores for {len(part)} texts")
                    scores += got
                return frame[["question_id", "id"]].assign(semantic=scores, backend=name)
            except Exception:
                continue
        return frame[["question_id", "id"]].assign(semantic=[None] * len(frame), backend=VECTOR)

    kinds = {f.name: f.dataType.simpleString() for f in pool.schema}
    scored = rows.groupBy("question_id").applyInPandas(work, f"question_id {kinds['question_id']}, id {kinds['id']}, semantic double, backend string")
    share = pool.select("question_id", "id", "dense", F.col("rank").alias("place"), position_share().alias("share")).join(scored, ["question_id", "id"])
    semantic = C.SEMANTIC_WEIGHT * F.col("semantic") + C.VECTOR_WEIGHT * F.col("dense") + C.POSITION_WEIGHT * F.col("share")
    score = F.round(F.when(F.col("backend") == VECTOR, 0.6 * F.col("dense") + 0.4 * F.col("share")).otherwise(semantic), 9)
    order = F.when(F.col("backend") == VECTOR, -F.col("place").cast("double")).otherwise(F.col("score"))
    ranked = rank_within(share.withColumn("score", score), [order.desc(), F.asc("place")])
    return ranked.filter(F.col("rank") < k).select("question_id", "id", "score", "backend", "rank")


def prepare_pages(pages: DataFrame, examples: DataFrame, chain: list[str]) -> DataFrame:
    """pages: source_id, url, text; examples as for ``example_chunks`` -> id, text, kind, tokens, chars, vec, backend.

    Blank pages have no chunk; a page's chunks and the examples of pages are embedded together.
    """
    cut = chunk_windows(pages.select("source_id", "url", "text"))
    made = cut.select(X.chunk_id(F.col("source_id"), F.col("url"), F.col("chunk_index")).alias("id"), "text", F.lit("markdown").alias("kind"))
    every = made.unionByName(example_chunks(examples).select("id", "text", F.lit("example").alias("kind")))
    sized = every.withColumns({"tokens": X.estimate_tokens(F.col("text")).cast("long"), "chars": F.length("text").cast("long")})
    return embed(sized, chain)


def hashed_words(texts: list[str], size: int = 16) -> list[list[float]]:
    """A deterministic embedder: the words of a text counted in slots by their hash, to unit length."""
    out = []
    for t in texts:
        counts = [0] * size
        for w in re.findall("[^\x20\x09-\x0d]+", t):
            counts[int(hashlib.md5(w.encode(errors="surrogatepass")).hexdigest()[:8], 16) % size] += 1
        length = sum(c * c for c in counts) ** 0.5
        out.append([c / length if length else 0.0 for c in counts])
    return out


def word_overlap(question: str, texts: list[str]) -> list[float]:
    """The share of the question's different words that a text has."""
    words = lambda t: set(re.findall("[^\x20\x09-\x0d]+", t))
    asked = words(question)
    return [len(asked & words(t)) / len(asked) if asked else 0.0 for t in texts]


register_embedder("hashed-words", hashed_words)
register_reranker("word-overlap", word_overlap)


# --- queries over the tables ---------------------------------------------------------------------------------------


def _no_answer(texts: list[str]) -> list[list[float]]:
    raise ConnectionError("no answer")


def _strict(question: str, texts: list[str]) -> list[float]:
    if len(question) % 2 == 0:
        raise ConnectionError("no answer")
    return [s * s for s in word_overlap(question, texts)]


def _loose(question: str, texts: list[str]) -> list[float]:
    if len(question) % 3 == 0:
        raise ConnectionError("no answer")
    return word_overlap(question, texts)


register_embedder("no-answer", _no_answer)
register_reranker("odd-lengths", _strict)
register_reranker("no-triples", _loose)


def prepared_pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents as pages, each with an example made of its language and source; the first embedder of the chain never answers."""
    docs, i = table(spark, d, "documents"), F.col("doc_id")
    url = F.concat(F.lit("https://e.org/"), i.cast("string"))
    examples = docs.select(F.col("source").alias("source_id"), url.alias("url"), F.lit(0).alias("example_index"), F.lit("Page").alias("page"), F.col("lang").alias("section"), F.lit("code").alias("kind"), F.lit("js").alias("language"), F.concat(F.lit("T"), i.cast("string")).alias("title"), F.concat_ws(" ", "lang", "source").alias("body"))
    out = prepare_pages(docs.select(F.col("source").alias("source_id"), url.alias("url"), "text"), examples, ["no-answer", "hashed-words"])
    return out.select("id", "kind", "tokens", "chars", F.round(F.get("vec", F.lit(0)), 6).alias("first_slot"), F.round(F.array_max("vec"), 6).alias("largest"), "backend")


def rerank_fallbacks(spark: SparkSession, d: str) -> DataFrame:
    """Fused candidates reranked by a chain of which the first fails on questions of even length and the second on those that 3 divides."""
    from ..sources.tables import questions

    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    out = rerank(_fused(spark, d), questions(spark, d), texts, ["odd-lengths", "no-triples"])
    return out.select("question_id", "id", F.round("score", 6).alias("score"), "backend", F.col("rank").cast("long").alias("rank"))


QUERIES = {"prepared_pages": prepared_pages, "rerank_fallbacks": rerank_fallbacks}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_ID = "coalesce(source || ':', '') || left(translate(base64(unhex(sha256('https://e.org/' || doc_id))), '+/', '-_'), 32)"
ORACLE_SQL = {
    "prepared_pages": f"""WITH {_CHUNKS},
r AS (SELECT {_ID} || ':' || chunk_index AS id, 'markdown' AS kind, x FROM k JOIN d USING (doc_id)
UNION ALL SELECT {_ID} || ':ex:0', 'example', 'Page: Page' || CASE WHEN lang IS NULL THEN '' ELSE ' | Section: ' || lang END || ' | Kind: code | Language: js | Topic: T' || doc_id || ' | Example:' || chr(10) || concat_ws(' ', lang, source) FROM documents),
n AS (SELECT row_number() OVER () AS n, * FROM r),
w AS (SELECT n, ('0x' || left(md5(w), 8))::UBIGINT % 16 AS slot, count(*) AS c FROM (SELECT n, unnest({_WORDS.format('x')}) AS w FROM n) GROUP BY 1, 2),
v AS (SELECT n, coalesce(max(c) FILTER (slot = 0), 0) / sqrt(sum(c * c)) AS f, max(c) / sqrt(sum(c * c)) AS m FROM w GROUP BY 1)
SELECT id, kind, greatest(1, ceil(length(x) / 4.0)::BIGINT) AS tokens, length(x) AS chars, round(coalesce(f, 0), 6) AS first_slot, round(coalesce(m, 0), 6) AS largest, 'hashed-words' AS backend FROM n LEFT JOIN v USING (n)""",
    "rerank_fallbacks": f"""{_ALL},
o AS (SELECT f.question_id, f.id, f.dense, f.rank, 1 - f.rank / count(*) OVER (PARTITION BY f.question_id) AS share, length(question) AS z, list_distinct({_WORDS.format('question')}) AS a, {_WORDS.format("coalesce(text, '')")} AS b FROM fused f JOIN q USING (question_id) LEFT JOIN documents ON doc_id = f.id),
g AS (SELECT *, CASE WHEN z % 2 <> 0 THEN 'odd-lengths' WHEN z % 3 <> 0 THEN 'no-triples' ELSE 'vector' END AS backend, CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(a) END AS s FROM o),
h AS (SELECT *, round(CASE backend WHEN 'vector' THEN 0.6::DOUBLE * dense + 0.4::DOUBLE * share ELSE 0.5::DOUBLE * CASE backend WHEN 'odd-lengths' THEN s * s ELSE s END + 0.3::DOUBLE * dense + 0.2::DOUBLE * share END, 9) AS sc FROM g)
SELECT * FROM (SELECT question_id, id, round(sc, 6) AS score, backend, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN backend = 'vector' THEN -rank ELSE sc END DESC, rank) - 1 AS rank FROM h) WHERE rank < 8""",
}
