"""N-gram Jaccard join by chosen paths.

A text is the set of its five-word shingles (64-bit hashes; a text of fewer words is one shingle). Copies, which have the
same words, are one text from then on.

1. Paths. In each of ``RUNS`` runs a set is split recursively: a path is extended by every token of the set whose hash,
   seeded by run and path, is below 1 / (B1 * size). Two sets with an overlap of B1 of the larger one share one extension
   of a shared path in expectation, unlike sets hardly any. After ``depth`` levels, which grow with the logarithm of the
   number of texts, buckets of unlike sets are small. ``RUNS`` follows from the survival of a shared path and ``RECALL``.
2. Buckets are brute-forced on 64-byte min-hash sketches with a threshold well below the join's, in blocks. Texts within
   ``ABSORB`` of a leader stand behind it; leaders meet all members. By the triangle inequality of the Jaccard distance
   that connects all that belongs together, and only a forest of a bucket leaves the task, never its pairs.
3. Connected candidates are verified: within a component all pairs of sets are compared exactly, in blocks of bounded
   size. A block gives the number of links of each text and a forest of them. The classes are the components of the verified
   links.

Defined cases: a null text is empty, and empty texts are copies of each other; rows without a doc_id are in the classes of
their texts; repeated rows are copies; a class id is the smallest doc_id of its class; an empty table gives no rows; other
columns are carried by ``keep_representatives``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_bounded, table, words, written
from .components import connected_components

SHINGLE, RECALL, B1 = 5, 0.99, 0.8
#: 9 * overlap >= 4 * (sizes) is a Jaccard similarity of 0.8 or more.
OVERLAP, SIZES = 9, 4
PERMUTATIONS, LINK, ABSORB = 64, 0.5, 0.82
CHUNK, BLOCK, BUNDLE_ROWS = 4096, 512, 2048
#: Rows of (doc_id, component) that may be broadcast, once counted.
SLIM_ROWS = 500_000
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, n: int = SHINGLE) -> tuple[str, np.ndarray]:
    """The key of a text's words and its sorted distinct shingle hashes."""
    import xxhash

    words = _WORDS.findall(text) if isinstance(text, str) else []
    key = hashlib.md5("\x00".join(words).encode()).hexdigest()
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    if len(w) < n:
        w = np.concatenate([w, np.arange(n - len(w), dtype=np.uint64)])
    h = w[: len(w) - n + 1].copy()
    for k in range(1, n):
        h = _mix(h) + w[k : len(w) - n + 1 + k]
    return key, np.unique(_mix(h))


def text_id(key: str) -> int:
    return int(key[:16], 16) - 2**63


def text_key(text: Column) -> Column:
    """The same key by Spark functions."""
    return F.md5(F.array_join(words(text), "\x00"))


def runs_for(depth: int, recall: float = RECALL) -> int:
    """Runs until a pair at the threshold shares a path in at least one with probability ``recall``.

    A shared path survives a level with Poisson(1) extensions: survival s(k+1) = 1 - exp(-s(k)).
    """
    s = 1.0
    for _ in range(depth):
        s = 1 - math.exp(-s)
    return math.ceil(math.log(1 - recall) / math.log(1 - s))


def depth_for(texts: int, unlike: float = 0.05, small: int = 16) -> int:
    """Levels until sets with an overlap of ``unlike`` meet in buckets of about ``small``."""
    return max(2, math.ceil(math.log(max(2.0, texts / small)) / math.log(B1 / unlike)))


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths - starts, lengths)


def chosen_paths(tokens: np.ndarray, sizes: np.ndarray, depth: int, runs: int) -> tuple[np.ndarray, np.ndarray]:
    """Set numbers and path hashes of all paths of ``depth``, for sets that stand end to end in ``tokens``."""
    starts = np.cumsum(sizes) - sizes
    limit = np.minimum(2.0**64 - 2048, 2.0**64 / (B1 * np.maximum(sizes, 1))).astype(np.uint64)
    sets, paths = [], []
    for run in range(runs):
        at = np.arange(len(sizes))
        path = np.full(len(sizes), _mix(np.array([run + 1], dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))[0])
        for level in range(depth):
            seed = _mix(path + np.uint64(level))
            n = sizes[at]
            x = tokens if not level else tokens[_ranges(starts[at], n)]
            h = _mix(_mix(x ^ np.repeat(seed, n)))
            hit = np.flatnonzero(h < np.repeat(limit[at], n))
            owner = np.repeat(np.arange(len(at)), n)[hit]
            path = _mix(path[owner] * np.uint64(0xA24BAED4963EE407) + x[hit])
            at = at[owner]
        sets.append(at)
        paths.append(path)
    return np.concatenate(sets), np.concatenate(paths)


def sketches(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One byte of the minimum of each of 64 hashes, per set."""
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), PERMUTATIONS), dtype=np.uint8)
    odd = np.random.default_rng(17).integers(1, 2**62, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for k in range(PERMUTATIONS):
        out[:, k] = _mix(np.minimum.reduceat(tokens * odd[k], starts)).astype(np.uint8)
    return out


def _sets(batch: pd.DataFrame, seen: set[bytes], most: int = 400_000) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Keys, tokens end to end and sizes of the texts not seen yet, in parts of about ``most`` tokens."""
    keys: list[str] = []
    parts: list[np.ndarray] = []
    held = 0
    for text in batch["text"]:
        text = text if isinstance(text, str) else ""
        if (same := hashlib.md5(text.encode()).digest()) in seen:
            continue
        seen.add(same)
        key, t = shingles(text)
        keys.append(key)
        parts.append(t)
        held += len(t)
        if held >= most:
            yield keys, np.concatenate(parts), np.array([len(p) for p in parts])
            keys, parts, held = [], [], 0
    if keys:
        yield keys, np.concatenate(parts), np.array([len(p) for p in parts])


def _link_bucket(sk: np.ndarray, link: float, absorb: float = ABSORB) -> tuple[np.ndarray, list[int]]:
    """For each member the first of those it is connected with, and the leaders: members not within ``absorb`` of another."""
    label = np.arange(len(sk))
    free = np.ones(len(sk), dtype=bool)
    leaders = []
    for i in range(len(sk)):
        if not free[i]:
            continue
        same = (sk == sk[i]).mean(1)
        free &= same < absorb
        free[i] = False
        leaders.append(i)
        joined = np.unique(label[same >= link])
        if len(joined) > 1:
            label[np.isin(label, joined)] = joined[0]
    return label, leaders


def _find(root: dict[int, int], i: int) -> int:
    while root.setdefault(i, i) != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def candidate_edges(docs: DataFrame, texts: int) -> DataFrame:
    """(a, b): ids of texts that a bucket connects, from (doc_id, text) rows. Texts that share an id only add candidates."""
    depth = depth_for(texts)
    runs = runs_for(depth)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()  # a text that a task has met before is a copy
        for batch in batches:
            for keys, tokens, sizes in _sets(batch, seen):
                ids = np.array([text_id(k) for k in keys], dtype=np.int64)
                at, path = chosen_paths(tokens, sizes, depth, runs)
                yield pd.DataFrame({"path": path.view(np.int64), "id": ids[at], "sketch": None})
                yield pd.DataFrame({"path": pd.array([None] * len(ids), dtype="Int64"), "id": ids, "sketch": [x.tobytes() for x in sketches(tokens, sizes)]})

    rows = written(docs.select("text").mapInPandas(split, "path long, id long, sketch binary"), "paths")
    paths = rows.filter(F.col("path").isNotNull()).select("path", "id")
    # Most paths have one text; only the others go on, and only then with their sketches.
    shared = paths.groupBy("path").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter(F.col("lo") < F.col("hi")).select("path")
    full = written(paths.join(shared, "path").distinct(), "buckets")
    counts = full.groupBy("path").agg(F.count("*").alias("n"))
    sketch = rows.filter(F.col("path").isNull()).groupBy("id").agg(F.first("sketch").alias("sketch"))
    # Small buckets go to a task many at a time; a large one is cut into chunks.
    cut = full.join(counts, "path").withColumn("chunk", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / CHUNK)).cast("int")).join(sketch, "id")

    def buckets(link: float, absorb: float = ABSORB):
        def brute(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["path", "chunk", "id"], kind="stable")
            ids = pdf["id"].to_numpy()
            bounds = np.flatnonzero(((pdf["path"] != pdf["path"].shift()) | (pdf["chunk"] != pdf["chunk"].shift())).to_numpy())
            root: dict[int, int] = {}
            lead: list[int] = []
            for lo, hi in zip(bounds, [*bounds[1:], len(pdf)]):
                sk = np.frombuffer(b"".join(pdf["sketch"].iloc[lo:hi]), dtype=np.uint8).reshape(hi - lo, -1)
                label, leaders = _link_bucket(sk, link, absorb)
                for j in np.flatnonzero(label != np.arange(hi - lo)):
                    p, q = _find(root, int(ids[lo + j])), _find(root, int(ids[lo + label[j]]))
                    if p != q:
                        root[p] = q
                lead += [lo + i for i in leaders] if pdf["n"].iloc[lo] > CHUNK else []
            top = pdf.iloc[lead]
            pairs = [(i, r) for i in root if (r := _find(root, i)) != i]  # a forest over all buckets of the task
            edge = pd.DataFrame({"a": pd.array([i for i, _ in pairs], dtype="Int64"), "b": pd.array([r for _, r in pairs], dtype="Int64"), "path": 0, "sketch": None})
            kept = pd.DataFrame({"a": top["id"].astype("Int64"), "b": pd.array([None] * len(top), dtype="Int64"), "path": top["path"], "sketch": top["sketch"]})
            return pd.concat([edge, kept]) if len(kept) else edge

        return brute

    out = "a long, b long, path long, sketch binary"
    cells = cut.withColumn("cell", F.when(F.col("n") > CHUNK, F.xxhash64("path", "chunk")).otherwise(F.pmod(F.xxhash64("path"), F.lit(max(16, texts * runs // 20_000)))))
    found = written(cells.groupBy("cell").applyInPandas(buckets(LINK), out), "bucket-edges")
    edges = found.filter(F.col("b").isNotNull()).select("a", "b")
    # Leaders of a bucket's chunks meet once more, at the distance that two leaders of linked texts may have; none is absorbed
    # again. Where there are many, they meet in pairs of blocks, so that no task grows with the bucket.
    leaders = found.filter(F.col("b").isNull()).select("path", F.col("a").alias("id"), "sketch")
    many = leaders.join(leaders.groupBy("path").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("blocks")), "path")
    pairs = many.withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = pairs.select("path", "id", "sketch", F.lit(0).alias("chunk"), F.lit(0).alias("n"), F.xxhash64("path", F.least("i", "j"), F.greatest("i", "j")).alias("cell"))
    again = met.groupBy("cell").applyInPandas(buckets(LINK - 0.1, 2.0), out).select("a", "b").filter(F.col("b").isNotNull())
    return edges.unionByName(again).distinct()


def _overlaps(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of two lists of sorted distinct arrays."""
    n, m = len(sets), len(others)
    if n * m <= 4:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in others] for a in sets])
    both = np.concatenate([*sets, *others])
    owner = np.repeat(np.arange(n + m), [len(s) for s in (*sets, *others)])
    _, token, count = np.unique(both, return_inverse=True, return_counts=True)
    keep = count[token] > 1
    token, owner = np.unique(token[keep], return_inverse=True)[1], owner[keep]
    out = np.zeros((n, m), dtype=np.float32)
    width = max(1, 8_000_000 // (n + m))
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    for lo in range(0, int(token.max(initial=-1)) + 1, width):
        a, b = np.searchsorted(token, [lo, lo + width])
        part = np.zeros((n + m, width), dtype=np.float32)
        part[owner[a:b], token[a:b] - lo] = 1
        out += part[:n] @ part[n:].T
    return out.astype(np.int64)


def _verify(pdf: pd.DataFrame) -> pd.DataFrame:
    """Exact links of the components (or block pairs) of a bundle: counts per text, and a forest of the links."""
    pdf = pdf.drop_duplicates(["cell", "side", "key"], ignore_index=True)  # repeated rows, one from each task
    keys, sides, one, copies = pdf["key"].to_numpy(), pdf["side"].to_numpy(), pdf["one"].to_numpy(), pdf["copies"].to_numpy()
    sets = [np.frombuffer(s, dtype=np.uint64) for s in pdf["tokens"]]
    rows: list[tuple] = []
    for _, at in pdf.groupby("cell", sort=False).indices.items():
        left = [i for i in at if sides[i] == 0]
        right = left if one[at[0]] else [i for i in at if sides[i] == 1]
        if not left or not right:
            continue
        inter = _overlaps([sets[i] for i in left], [sets[j] for j in right])
        n, m = np.array([len(sets[i]) for i in left]), np.array([len(sets[j]) for j in right])
        linked = OVERLAP * inter >= SIZES * (n[:, None] + m[None, :])
        if left is right:
            np.fill_diagonal(linked, False)
        for own, other, hit in ((left, right, linked), (right, left, linked.T))[: 1 if left is right else 2]:
            texts, docs = hit.sum(1), hit @ copies[other]
            rows += [(keys[i], None, int(t), int(d)) for i, t, d in zip(own, texts, docs) if t]
        root: dict[int, int] = {}
        for x, y in zip(*np.nonzero(linked)):
            p, q = _find(root, left[x]), _find(root, right[y])
            if p != q:
                root[p] = q
                rows.append((keys[left[x]], keys[right[y]], 0, 0))
    return pd.DataFrame(rows, columns=["a", "b", "texts", "docs"])


def similar_texts(docs: DataFrame) -> DataFrame:
    """doc_id, key, class_id, class_key, n_links, n_texts, n_copies for every row of docs (doc_id, text).

    n_links counts the other documents with a similarity of 0.8 or more, copies included; n_texts the other texts.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    keyed = written(docs.select("doc_id", text_key(F.col("text")).alias("key")), "keys")
    texts = written(keyed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "texts")
    # text_id of the key: its first 64 bits, less 2**63
    id_of = (F.conv(F.substring("key", 1, 16), 16, 10).cast("decimal(20,0)") - F.lit(str(2**63)).cast("decimal(20,0)")).cast("long")
    comps = written(connected_components(candidate_edges(docs, texts.count())), "candidates")
    members = comps.join(texts.withColumn("node", id_of), "node").select(F.col("rep").alias("doc_id"), "key", "root", "copies")
    sizes = comps.groupBy("root").agg(F.count("*").alias("n"))
    wanted = written(members.join(sizes, "root").withColumn("root", F.col("root").cast("string")), "wanted")

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[str] = set()
        for b in batches:
            found = [shingles(t) for t in b["text"]]
            keep = []
            for (k, _), key in zip(found, b["key"]):
                keep.append(k == key and k not in seen)
                seen.add(k)
            out = b.drop(columns=["text", "doc_id"])
            out["tokens"] = [s.tobytes() for _, s in found]
            yield out[keep]

    met = join_bounded(docs, wanted, "doc_id", "inner", spread=1, limit=SLIM_ROWS)
    loaded = met.select("doc_id", "text", "key", "root", "copies", "n").mapInPandas(load, "key string, root string, copies long, n long, tokens binary")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("key"), blocks).cast("int")
    # A text of block i meets every block j; the pair (i, j) is one cell, with i on side 0.
    spread = loaded.withColumn("i", own).withColumn("j", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cells = spread.withColumn("side", (F.col("j") < F.col("i")).cast("int")).withColumn("one", F.col("i") == F.col("j")).withColumn("cell", F.xxhash64("root", F.least("i", "j"), F.greatest("i", "j")))
    bundles = max(16, wanted.count() // BUNDLE_ROWS)
    placed = cells.withColumn("bundle", F.when(F.col("n") > BLOCK, F.col("cell")).otherwise(F.pmod(F.xxhash64("root"), F.lit(bundles)))).select("bundle", "cell", "key", "side", "one", "copies", "tokens")
    verified = written(placed.groupBy("bundle").applyInPandas(_verify, "a string, b string, texts long, docs long"), "links")
    counts = verified.filter(F.col("b").isNull()).groupBy(F.col("a").alias("key")).agg(F.sum("texts").alias("n_texts"), F.sum("docs").alias("other_docs"))
    classes = connected_components(verified.filter(F.col("b").isNotNull()).select("a", "b")).withColumnRenamed("node", "key")
    named = texts.join(classes, "key").select("key", "root", "rep", "copies")
    first = named.groupBy("root").agg(F.min("rep").alias("class_id"))
    linked = named.join(first, "root").join(counts, "key", "left").select("key", "class_id", F.col("root").alias("class_key"), "copies", "n_texts", "other_docs")
    alone = texts.filter(F.col("copies") > 1).join(classes, "key", "left_anti").select("key", F.col("rep").alias("class_id"), F.col("key").alias("class_key"), "copies", F.lit(0).cast("long").alias("n_texts"), F.lit(0).cast("long").alias("other_docs"))
    known = written(linked.unionByName(alone), "classes")
    out = join_bounded(keyed, known, "key")
    copies = F.coalesce("copies", F.lit(1))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select("doc_id", "key", F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_key", "key").alias("class_key"), (zero("other_docs") + copies - 1).cast("long").alias("n_links"), zero("n_texts").alias("n_texts"), copies.cast("long").alias("n_copies"))


def keep_representatives(docs: DataFrame) -> DataFrame:
    """One row of docs for each class, one with the smallest doc_id. Rows without links pass as they are.

    Only the rows that stand for others are shuffled with their texts, to take one of repeated rows.
    """
    key_of = lambda doc_id, key: F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), key).alias("key")
    found = similar_texts(docs).filter(F.col("n_links") > 0)
    found = found.select(key_of(F.col("doc_id"), F.col("key")), F.col("doc_id").eqNullSafe(F.col("class_id")).alias("first"), F.col("class_key").alias("class")).distinct()
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("row")  # no name of a column can clash
    keyed = docs.select(whole, key_of(docs["doc_id"], text_key(docs["text"])))
    met = join_bounded(keyed, written(found, "linked"), "key", spread=1, limit=SLIM_ROWS)
    single = met.filter(F.col("first").isNull())
    first = met.filter("first").dropDuplicates(["class"])
    return single.select("row.*").unionByName(first.select("row.*"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_texts(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_texts", "n_copies")


QUERIES = {"op9_jaccard_join": op9_jaccard_join}

#: All pairs of texts by their shared shingles, and the closure of the links.
ORACLE_SQL = {
    "op9_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS MATERIALIZED (SELECT w, min(doc_id) AS rep, count(*) AS copies, row_number() OVER (ORDER BY min(doc_id)) AS tid FROM d GROUP BY w),
s AS MATERIALIZED (SELECT DISTINCT tid, hash(w[i:i + 4]) AS g FROM t, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i)),
z AS (SELECT tid, count(*) AS n FROM s GROUP BY tid),
p AS (SELECT a.tid AS x, b.tid AS y, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.tid < b.tid GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM p JOIN z a ON a.tid = x JOIN z b ON b.tid = y WHERE 9 * p.n >= 4 * (a.n + b.n)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
c AS (SELECT tid, tid AS other FROM t UNION SELECT c.tid, e.y FROM c JOIN e ON e.x = c.other),
k AS (SELECT c.tid, min(o.rep) AS class_id FROM c JOIN t o ON o.tid = c.other GROUP BY c.tid),
n AS (SELECT e.x AS tid, count(*) AS texts, sum(o.copies) AS docs FROM e JOIN t o ON o.tid = e.y GROUP BY 1)
SELECT d.doc_id, class_id, (coalesce(docs, 0) + copies - 1)::BIGINT AS n_links, coalesce(texts, 0) AS n_texts, copies AS n_copies
FROM d JOIN t ON d.w = t.w JOIN k ON k.tid = t.tid LEFT JOIN n ON n.tid = t.tid"""
}
