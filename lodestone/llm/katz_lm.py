"""LM scoring with a Katz backoff n-gram model.

Tokens are a text's words (A-Z lower-cased), then one end token; before the first token stand start marks.

- Good-Turing: a count c up to K is discounted by d(c) = (c*/c - q) / (1 - q), with c* = (c+1) n(c+1)/n(c) and
  q = (K+1) n(K+1)/n(1), where n(c) is how many n-grams have that count. If the counts of counts of a small corpus give no
  discount between 0 and 1, c - 1/2 stands for c.
- P(w|h) = d(c) c(h,w) / c(h) if the n-gram was seen, else alpha(h) P(w|shorter h). alpha(h) is what the seen n-grams leave
  of 1, over what their words leave of 1 one order below, so that every history sums to 1 exactly. A history whose counts
  are all above K keeps 1 / (c(h) + 1) for unseen words. An unseen history is scored one order below.
- P(w) = d(c) c(w) / N for the V known words, and what is left of 1 for the one unknown word.

Texts are read once and tokenised into chunks of about ``CHUNK_TOKENS`` tokens, numbered within the chunk. Then each order,
from words up, is one exchange: a chunk asks for its different n-grams, with its own training counts of them, and sends
them to buckets by the hash of their history; a bucket adds the counts of all chunks and answers each with the totals. So an
n-gram moves once for each chunk that has it, however often it occurs, and a very frequent n-gram is one row for each
chunk. A history of more than ``SALT_TOKENS`` training tokens is spread over buckets by its words; there are at most 2**16
such histories, so the sums of their parts are broadcast. Each order's n-grams and histories are written as a table
partitioned by the kind of row and keyed by bucket, with the answers that the recursion of the backoff reads.

Words are told apart by 64-bit hashes and then numbered. Arrays travel as compressed binary columns.

Defined cases: a null text is empty, and has the end token alone; a null doc_id counts as the text '' in the split; repeated
rows are scored one by one with equal scores; without training tokens every token has the probability 1; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

ORDER, K = 2, 5
FOLDS, HELD_OUT = 5, 1
CHUNK_TOKENS, BUCKET_TOKENS, SALT_TOKENS = 2_000_000, 2_000_000, 1 << 20
#: Numbers of the start mark and of all words without a training token; other words are numbered from 2.
START, UNKNOWN = 0, 1
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_END = b" "  # no word holds a space
CHUNKS = "chunk long, docs binary, tokens binary, hashes binary"
QUESTIONS = "bucket int, chunk long, data binary"
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
ANSWERS = "kind string, chunk long, level int, bucket int, data binary, history array<long>, stats array<double>"


# --- arrays as bytes ------------------------------------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned integers or doubles; integers lose their zero bytes, and equal bytes of all numbers stand together."""
    parts = [struct.pack("<I", len(arrays))]
    for a in arrays:
        if a.dtype.kind != "f":
            top = int(a.max(initial=0))
            a = a.astype(next(f"<u{n}" for n in (1, 2, 4, 8) if top < 1 << 8 * n))
        raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b""
        body = zlib.compress(raw)
        parts += [struct.pack("<cBQQ", a.dtype.kind.encode(), a.itemsize, len(a), len(body)), body]
    return b"".join(parts)


def unpack(data: bytes) -> list[np.ndarray]:
    (n,), at, out = struct.unpack_from("<I", data), 4, []
    for _ in range(n):
        kind, width, size, length = struct.unpack_from("<cBQQ", data, at)
        at += struct.calcsize("<cBQQ")
        raw = np.frombuffer(zlib.decompress(data[at : at + length]), dtype=np.uint8)
        at += length
        a = np.ascontiguousarray(raw.reshape(width, size).T).view(f"<{kind.decode()}{width}").reshape(size)
        out.append(a.astype(np.int64) if kind == b"u" and width < 8 else a)
    return out


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values, and the place of each x among them."""
    u = np.sort(x)
    u = u[np.r_[True, u[1:] != u[:-1]]] if len(u) else u
    return u, np.searchsorted(u, x)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


# --- chunks ---------------------------------------------------------------------------------------------------------


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _in_training(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS != HELD_OUT


def _cutter(chunk_tokens: int):
    """Rows -> chunks: documents (id, null flag, tokens, training flag), their tokens by number, the words' hashes."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 32, 0
        numbers, tokens, docs, held = _Numbers(), [], [], 0

        def chunk() -> pd.DataFrame:
            ids = np.array([0 if d is None else d for d, _ in docs], dtype=np.int64)
            null, train = np.array([d is None for d, _ in docs]), np.array([_in_training(d) for d, _ in docs])
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, numbers), dtype=np.uint64, count=len(numbers))
            return pd.DataFrame({"chunk": [base + made], "docs": [pack(ids.view(np.uint64), null, np.array([n for _, n in docs]), train)], "tokens": [pack(np.concatenate(tokens))], "hashes": [pack(hashes)]})

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                words = text.encode().translate(_LOWER).split() if isinstance(text, str) else []
                words.append(_END)
                tokens.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.uint32, count=len(words)))
                docs.append((None if pd.isna(doc_id) else int(doc_id), len(words)))
                held += len(words)
                if held >= chunk_tokens:
                    yield chunk()
                    made += 1
                    numbers, tokens, docs, held = _Numbers(), [], [], 0
        if docs:
            yield chunk()

    return cut


@dataclass
class _Model:
    """What a level adds for all: discounts, and for words the totals; sums of salted histories by (level, history)."""

    discounts: list[np.ndarray] = field(default_factory=list)  # by level - 1, mass of counts 0..K
    n: int = 0
    v: int = 0
    unknown: float = 1.0
    hot: dict[tuple, np.ndarray] = field(default_factory=dict)
    train_docs: int = 0
    salt_tokens: int = SALT_TOKENS

    def mass(self, level: int, c: np.ndarray) -> np.ndarray:
        d = self.discounts[level - 1]
        return np.where(c <= K, d[np.minimum(c, K)], c)


class _Chunk:
    """A chunk on its way up the orders: per token the probability and the training count of the n-gram of the last level."""

    def __init__(self, row: pd.Series) -> None:
        ids, null, self.lengths, train = unpack(row["docs"])
        self.key, self.ids, self.null, self.train = int(row["chunk"]), ids.view(np.int64), null.astype(bool), train.astype(bool)
        (self.tokens,), (self.hashes,) = unpack(row["tokens"]), unpack(row["hashes"])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.trained = np.repeat(self.train, self.lengths)
        self.hashes = self.hashes.astype(np.uint64)
        self.history = np.zeros(len(self.tokens), dtype=np.int64)
        self.columns: list[np.ndarray] = []  # numbers of the words before, nearest first

    def words(self, buckets: int) -> Iterator[tuple[int, bytes]]:
        """The questions of level 1: by bucket, the hashes of the words and their training counts."""
        counts = np.bincount(self.tokens[self.trained], minlength=len(self.hashes))
        for b, at in self._words_by_bucket(buckets):
            yield b, pack(self.hashes[at], counts[at])

    def _words_by_bucket(self, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        to = (_mix(self.hashes) % np.uint64(buckets)).astype(np.int64)
        yield from _groups(to, np.argsort(to, kind="stable"))

    def hear_words(self, answers: dict[int, bytes], buckets: int, model: _Model) -> None:
        number, count = np.full(len(self.hashes) + 1, START), np.zeros(len(self.hashes) + 1, dtype=np.int64)
        for b, at in self._words_by_bucket(buckets):
            number[at], count[at] = unpack(answers[b])
        self.number, self.count = number, count  # the last place is the start mark's
        self.known = count[self.tokens]
        self.p = np.where(self.known > 0, model.mass(1, self.known) / max(model.n, 1), max(model.unknown, 1e-300))
        self.gram_count = self.known

    def _grams(self, level: int, model: _Model, buckets: int) -> None:
        """The different n-grams of a level whose words before are all known, in the order of their buckets."""
        mark, before = len(self.hashes), np.arange(len(self.tokens)) - (level - 1)
        here = np.where(before >= np.repeat(self.starts, self.lengths), self.tokens[np.maximum(before, 0)], mark)
        self.columns.append(here)
        # The count of a history is that of the n-gram it is one order below, or the documents' for a start mark.
        own = self.gram_count[np.maximum(np.arange(len(self.tokens)) - 1, 0)]
        spoken = np.where(self.columns[0] == mark, model.train_docs, own)
        _, self.history = _distinct(self.history * (mark + 1) + here)
        keys, self.at = _distinct(self.history * (mark + 1) + self.tokens)
        self.first = np.empty(len(keys), dtype=np.int64)
        self.first[self.at[::-1]] = np.arange(len(self.at))[::-1]
        self.heads = np.array([self.number[c[self.first]] for c in self.columns]).reshape(level - 1, -1)
        self.tails = self.number[self.tokens[self.first]]
        mixed = np.full(len(keys), level, dtype=np.uint64)
        for c in self.heads:
            mixed = _mix(mixed ^ _mix(c.astype(np.uint64) + np.uint64(77)))
        salts = 1 + spoken[self.first] // max(model.salt_tokens, model.n >> 16)
        self.salted = salts > 1
        to = _mix(mixed + _mix(self.tails.astype(np.uint64)) % salts.astype(np.uint64)) % np.uint64(buckets)
        asked = np.flatnonzero((self.heads != UNKNOWN).all(0))
        self.parts = [(b, asked[at]) for b, at in _groups(to[asked].astype(np.int64), np.argsort(to[asked], kind="stable"))]

    def _runs(self, at: np.ndarray) -> np.ndarray:
        """Where the n-grams of a new history begin."""
        h = self.history[self.first[at]]
        return np.flatnonzero(np.r_[True, h[1:] != h[:-1]])

    def grams(self, level: int, model: _Model, buckets: int) -> Iterator[tuple[int, bytes]]:
        """The questions of a level: by bucket, histories, n-grams for each, last words, training counts, lower probabilities."""
        self._grams(level, model, buckets)
        counts = np.bincount(self.at[self.trained], minlength=len(self.first))
        for b, at in self.parts:
            runs = self._runs(at)
            values, codes = _distinct(self.p[self.first[at]])
            yield b, pack(np.diff(np.r_[runs, len(at)]), self.tails[at], counts[at], values, codes, self.salted[at[runs]], *self.heads[:, at[runs]])

    def hear_grams(self, level: int, answers: dict[int, bytes], model: _Model, buckets: int) -> None:
        """Turns the answers into the probability of every token at this level."""
        self._grams(level, model, buckets)
        seen, factor, count = np.zeros(len(self.first)), np.ones(len(self.first)), np.zeros(len(self.first), dtype=np.int64)
        for b, at in self.parts:
            c, total, *few, big, lower = unpack(answers[b])
            runs = self._runs(at)
            stats = np.array([total, *few, big, lower], dtype=np.float64)
            for k in np.flatnonzero(self.salted[at[runs]]):
                stats[:, k] = model.hot[(level, *self.heads[:, at[runs[k]]].tolist())]
            total, big, lower = stats[0], stats[K + 1], stats[K + 2]
            mass = big + sum(stats[k] * model.discounts[level - 1][k] for k in range(1, K + 1))
            scale = np.where(big == total, total / (total + 1), 1.0)
            heard = total > 0
            left = np.where(heard, (1 - mass * scale / np.maximum(total, 1)) / np.maximum(1 - lower, 1e-300), 1.0)
            own = np.repeat(np.arange(len(runs)), np.diff(np.r_[runs, len(at)]))
            seen[at] = model.mass(level, c) * (scale / np.maximum(total, 1))[own]
            factor[at], count[at] = left[own], c
        self.p = np.where(count[self.at] > 0, seen[self.at], factor[self.at] * self.p)
        self.gram_count = count[self.at]

    def scores(self, model: _Model) -> pd.DataFrame:
        base = np.log10((self.known + 0.5) / (model.n + 0.5 * (model.v + 1)))
        add = lambda x: np.add.reduceat(x, self.starts)
        ids = pd.array(self.ids, dtype="Int64")
        ids[self.null] = pd.NA
        return pd.DataFrame({"doc_id": ids, "held_out": ~self.train, "n_tokens": self.lengths, "n_known": add((self.known > 0).astype(np.int64)), "base_score": add(base), "score": add(np.log10(self.p))})


def _groups(to: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    cuts = np.flatnonzero(np.diff(to[order])) + 1
    for at in np.split(order, cuts) if len(order) else []:
        yield int(to[at[0]]), at


# --- buckets --------------------------------------------------------------------------------------------------------


def _rows(*rows: tuple) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "chunk", "level", "bucket", "data", "history", "stats"])


def _tally(c: np.ndarray) -> list[float]:
    """n(1)..n(K+1), then the sum of the counts above K, the sum of all and how many there are."""
    n = np.bincount(np.minimum(c, K + 2), minlength=K + 3)
    return [*map(float, n[1 : K + 2]), float(c[c > K].sum()), float(c.sum()), float((c > 0).sum())]


def _count_words(buckets: int):
    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        asked = [unpack(d) for d in pdf["data"]]
        words, at = _distinct(np.concatenate([h.astype(np.uint64) for h, _ in asked]))
        c = np.bincount(at, weights=np.concatenate([n for _, n in asked]), minlength=len(words)).astype(np.int64)
        b = int(pdf["bucket"].iloc[0])
        # Numbers of different buckets interleave, the more frequent words of each first.
        number = np.full(len(words), UNKNOWN)
        order = np.argsort(-c, kind="stable")
        number[order] = np.arange(len(words)) * buckets + b + 2
        number[c == 0] = UNKNOWN
        rows, lo = [], 0
        for chunk, (h, _) in zip(pdf["chunk"], asked):
            mine = at[lo : lo + len(h)]
            lo += len(h)
            rows.append(("answer", chunk, 1, b, pack(number[mine], c[mine]), None, None))
        seen = c > 0
        rows.append(("table", None, 1, b, pack(words[seen], number[seen], c[seen]), None, None))
        rows.append(("tally", None, 1, b, None, None, _tally(c)))
        return _rows(*rows)

    return count


def _count_grams(level: int):
    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        asked = [unpack(d) for d in pdf["data"]]
        b = int(pdf["bucket"].iloc[0])
        runs = np.concatenate([a[0] for a in asked])
        heads = np.array([np.concatenate([a[6 + k] for a in asked]) for k in range(level - 1)])
        hist = np.zeros(len(runs), dtype=np.int64)
        for column in heads:
            u, local = _distinct(column)
            hist = _distinct(hist * max(len(u), 1) + local)[1]
        own = np.repeat(hist, runs)
        words, tail = _distinct(np.concatenate([a[1] for a in asked]))
        grams, at = _distinct(own * max(len(words), 1) + tail)
        c = np.bincount(at, weights=np.concatenate([a[2] for a in asked]), minlength=len(grams)).astype(np.int64)
        low = np.empty(len(grams))
        low[at] = np.concatenate([a[3][a[4]] for a in asked])
        head, n = grams // max(len(words), 1), int(hist.max(initial=-1)) + 1
        add = lambda w: np.bincount(head, weights=w, minlength=n)
        stats = np.array([add(c), *[add(c == k) for k in range(1, K + 1)], add(np.where(c > K, c, 0)), add(np.where(c > 0, low, 0.0))])
        rows, lo, ro = [], 0, 0
        for chunk, a in zip(pdf["chunk"], asked):
            mine, hs = at[lo : lo + len(a[1])], hist[ro : ro + len(a[0])]
            lo, ro = lo + len(a[1]), ro + len(a[0])
            s = stats[:, hs]
            rows.append(("answer", chunk, level, b, pack(c[mine], *s[:-1].astype(np.int64), s[-1]), None, None))
        first = np.empty(n, dtype=np.int64)
        first[hist[::-1]] = np.arange(len(hist))[::-1]
        hot = np.zeros(n, dtype=bool)
        hot[hist] = np.concatenate([a[5] for a in asked]).astype(bool)
        rows += [("hot", None, level, b, None, heads[:, first[k]].tolist(), stats[:, k].tolist()) for k in np.flatnonzero(hot)]
        seen = c > 0
        rows.append(("table", None, level, b, pack(*heads[:, first], np.bincount(head[seen], minlength=n), words[grams[seen] % max(len(words), 1)], c[seen], stats[-1]), None, None))
        rows.append(("tally", None, level, b, None, None, _tally(c)))
        return _rows(*rows)

    return count


def _discounts(n: list[float]) -> np.ndarray:
    """The mass d(c) c that stands for each count 0..K."""
    if all(n[: K + 1]):
        q = (K + 1) * n[K] / n[0]
        if q < 1:
            d = [((c + 1) * n[c] / (n[c - 1] * c) - q) / (1 - q) for c in range(1, K + 1)]
            if all(0 < x < 1 for x in d):
                return np.array([0.0, *[x * c for c, x in enumerate(d, 1)]])
    return np.array([0.0, *[c - 0.5 for c in range(1, K + 1)]])


def _climb(left: pd.DataFrame, answers: pd.DataFrame, upto: int, model: _Model, buckets: int) -> _Chunk:
    """A chunk, taken up the levels that have been answered."""
    chunk, by = _Chunk(left.iloc[0]), {}
    for level, b, data in zip(answers["level"], answers["bucket"], answers["data"]):
        by.setdefault(level, {})[b] = data
    chunk.hear_words(by[1], buckets, model)
    for level in range(2, upto + 1):
        chunk.hear_grams(level, by.get(level, {}), model, buckets)
    return chunk


def _ask_words(buckets: int):
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                chunk = _Chunk(row)
                for b, data in chunk.words(buckets):
                    yield pd.DataFrame({"bucket": [b], "chunk": [chunk.key], "data": [data]})

    return ask


def _ask_grams(level: int, shared, buckets: int):
    def ask(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        chunk = _climb(left, right, level - 1, shared.value, buckets)
        return pd.DataFrame([(b, chunk.key, data) for b, data in chunk.grams(level, shared.value, buckets)], columns=["bucket", "chunk", "data"])

    return ask


def _score(order: int, shared, buckets: int):
    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _climb(left, right, order, shared.value, buckets).scores(shared.value)

    return score


def score_documents(docs: DataFrame, order: int = ORDER, chunk_tokens: int = CHUNK_TOKENS, salt_tokens: int = SALT_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # a string, as pandas makes doubles of longs with nulls
    chunks = written(slim.mapInPandas(_cutter(chunk_tokens), CHUNKS), "lm-chunks")
    model, heard = _Model(salt_tokens=salt_tokens), []

    def with_answers(step, schema: str) -> DataFrame:
        answers = heard[0]
        for h in heard[1:]:
            answers = answers.unionByName(h)
        return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(step, schema)

    ends = chunks.select("docs").mapInPandas(_sizes, "train_docs long, tokens long").agg(F.sum("train_docs").alias("d"), F.sum("tokens").alias("t")).first()
    model.train_docs, tokens = int(ends["d"] or 0), int(ends["t"] or 0)
    buckets = max(32, tokens // BUCKET_TOKENS)
    for level in range(1, order + 1):
        if level == 1:
            asked, answer = chunks.mapInPandas(_ask_words(buckets), QUESTIONS), _count_words(buckets)
        else:
            asked, answer = with_answers(_ask_grams(level, spark.sparkContext.broadcast(model), buckets), QUESTIONS), _count_grams(level)
        found = written(asked.groupBy("bucket").applyInPandas(answer, ANSWERS), f"lm-level-{level}", ["kind"])
        heard.append(found.filter("kind = 'answer'").select("chunk", "level", "bucket", "data"))
        tally = found.filter("kind = 'tally'").select(*[F.sum(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(K + 4)]).first()
        sums = [float(x or 0) for x in tally]
        model = _Model([*model.discounts, _discounts(sums)], model.n, model.v, model.unknown, dict(model.hot), model.train_docs, salt_tokens)
        if level == 1:
            model.n, model.v = int(sums[K + 2]), int(sums[K + 3])
            model.unknown = 1.0 - (sums[K + 1] + sum(sums[c - 1] * model.discounts[0][c] for c in range(1, K + 1))) / max(model.n, 1)
        # At most 2**16 histories are salted, see SALT_TOKENS.
        hot = found.filter("kind = 'hot'").groupBy("history").agg(*[F.sum(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(K + 3)]).collect()
        model.hot |= {(level, *r["history"]): np.array([r[f"s{i}"] for i in range(K + 3)]) for r in hot}
    scored = with_answers(_score(order, spark.sparkContext.broadcast(model), buckets), OUT)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def _sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        docs = [unpack(d) for d in batch["docs"]]
        yield pd.DataFrame({"train_docs": [int(train.sum()) for *_, train in docs], "tokens": [int(n.sum()) for _, _, n, _ in docs]})


def op5_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op5_katz_lm": op5_katz_lm}
