"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

1. Texts are tokenised in Arrow batches; a document's ids end with a separator id. Only documents longer than the capacity
   are cut, into full pieces from the end; the first piece takes the rest.
2. Pieces are counted by length. That histogram has at most ``capacity`` rows, whatever the input, so the plan is made
   from it in one place: pieces above a third of the capacity are matched greedily, the longest with the longest that
   still fits, at most two to a sequence; shorter pieces, longest first, each go to the smallest gap that holds them, and
   to new sequences when there is none. All pieces of one length that meet equal gaps are placed by one plan row.
3. Every piece gets its rank among the pieces of its length (summed over 256 buckets, so a hot length is no hot task)
   and looks its place up in the plan, whose size is bounded by the capacity too.

Defined cases: a null text is empty and gives one piece with the separator alone; repeated rows are separate documents;
an empty table gives no rows; columns other than doc_id and text are ignored. Texts that hold the names of special tokens
are ordinary text.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed_totals, table, written

CAPACITY = 2048
SEPARATOR = 0
_LONG_RUN = re.compile(r"\s{1000}")


def _ranked(path: str):
    """A faster encoder for whole texts, if the file is a byte-level BPE whose merges stand in the order of their ids; else None.

    Such a BPE merges the pair with the smallest id first, whichever library does it, so the ids are those of the file.
    """
    import json

    import public_tokenizers
    import tiktoken
    from tokenizers import pre_tokenizers

    with open(path) as f:
        file = json.load(f)
    model, before = file["model"], file.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or file.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    merges, vocab = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in model["merges"]], model["vocab"]
    first = len(pre_tokenizers.ByteLevel.alphabet())
    if any(vocab.get(m) != first + i for i, m in enumerate(merges)):
        return None
    letters = sorted(pre_tokenizers.ByteLevel.alphabet())
    plain = [b for b in range(256) if chr(b) in letters]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if i < first + len(merges)}
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Encoder:
    """Texts -> their ids as little-endian 32-bit bytes, as the tokenizers library gives them.

    The library itself takes about three times as long as ``_ranked``, which needs the same file and gives the same ids; it
    encodes the texts where ``_ranked`` does not apply, or whose runs of white space are too long for its pattern.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task is one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.ranked = _ranked(path)

    def encode(self, text: str) -> bytes:
        if self.ranked and not _LONG_RUN.search(text):
            ids = self.ranked.encode_ordinary(text)
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, dtype="<u4").tobytes()


@lru_cache(maxsize=2)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


PIECES = "doc_id long, piece int, start long, length long, ids binary"


def tokenize_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """doc_id, piece, start, length, ids: the ids as little-endian unsigned 32-bit integers."""
    path = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end = np.uint32(separator).tobytes()
        encoder = _encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = encoder.encode(text if isinstance(text, str) else "") + end
                doc_id, n = None if pd.isna(doc_id) else int(doc_id), len(ids) // 4
                bounds = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                rows += [(doc_id, k, a, b - a, ids[4 * a : 4 * b]) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
                held += len(ids)
                if held >= 8_000_000:
                    yield _frame(rows)
                    rows, held = [], 0
            yield _frame(rows)

    def _frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids"])
        return out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(cut, PIECES)  # pandas makes doubles of longs with nulls


def pack_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Histogram of lengths -> rows (length, first rank, pieces, first sequence, offset).

    The pieces of that length with ranks from the first on go to sequences from the first on, each at the offset.
    """
    plan: list[tuple[int, int, int, int, int]] = []
    left = {n: c for n, c in counts.items() if c}
    used = dict.fromkeys(left, 0)
    gaps: dict[int, list[list[int]]] = {}  # gap -> runs [first sequence, sequences]
    order: list[int] = []  # the gaps that have runs, ascending
    opened = 0

    def put(length: int, pieces: int, sequence: int, offset: int) -> None:
        plan.append((length, used[length], pieces, sequence, offset))
        used[length] += pieces
        left[length] -= pieces

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                order.insert(bisect_left(order, gap), gap)
                gaps[gap] = []
            gaps[gap].append([first, n])

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((b for b in large if b <= a and a + b <= capacity and left[b] > (b == a)), None)
            n = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
            put(a, n, opened, 0)
            if b is not None:
                put(b, n, opened, a)
            leave(capacity - a - (b or 0), opened, n)
            opened += n
    for a in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[a]:
            at = bisect_left(order, a)
            if at == len(order):
                n = -(-left[a] // (capacity // a))
                leave(capacity, opened, n)
                opened += n
                continue
            gap = order[at]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            fit = gap // a
            full = min(n, left[a] // fit)
            for k in range(fit if full else 0):
                put(a, full, first, capacity - gap + k * a)
            leave(gap - fit * a, first, full)
            first, n = first + full, n - full
            if n and left[a]:
                rest = left[a]
                for k in range(rest):
                    put(a, 1, first, capacity - gap + k * a)
                leave(gap - rest * a, first, 1)
                first, n = first + 1, n - 1
            leave(gap, first, n)
    return plan


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece and length. ``pieces`` is read twice: give a written table."""
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    rows = np.asarray(pack_plan(counts, capacity), dtype=np.int64).reshape(-1, 5)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    plan = pieces.sparkSession.sparkContext.broadcast(rows)
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(256)).cast("int")
    ranked = bucketed_totals(pieces.withColumn("_bucket", bucket), ["length"], "_bucket", [F.col(c) for c in sorted(pieces.columns)], F.lit(1), "_rank").drop("_bucket")
    names = pieces.columns

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = plan.value
        span = int(table[:, 1].max(initial=0)) + 1
        keys = table[:, 0].astype(object) * span + table[:, 1] if span * (capacity + 1) > 2**62 else table[:, 0] * span + table[:, 1]
        for batch in batches:
            wanted = batch["length"].to_numpy(np.int64) * span + np.minimum(batch["_rank"].to_numpy(np.int64), span - 1)
            at = np.searchsorted(keys, wanted, side="right") - 1
            out = batch[names].copy()
            out["sequence_id"] = table[at, 3] + batch["_rank"].to_numpy(np.int64) - table[at, 1]
            out["offset"] = table[at, 4]
            yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.select(*names, "_rank").mapInPandas(look_up, schema)


def sequences(placed: DataFrame) -> DataFrame:
    """Rows of ``place`` that still have their ids -> sequence_id, ids, doc_ids: one row per packed sequence.

    A sequence has at most ``capacity`` pieces, so no group is unbounded.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    grouped = placed.groupBy("sequence_id").agg(parts.alias("parts"))
    ids = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return grouped.select("sequence_id", ids.alias("ids"), F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document.

    Texts are tokenised once; the pieces are written without their ids, which ``tokenize_pieces`` gives again.
    """
    pieces = tokenize_pieces(docs, tokenizer, capacity)
    digest = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return place(written(digest, "pieces"), capacity)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op2_best_fit_packing": op2_best_fit_packing}
