"""PII: personal data by pattern, and the terms that reveal it, by their co-occurrence in the corpus.

1. Emails, IP addresses, card and phone numbers are found in every whole text, in time linear in its length.
2. Each value found is a protected entity e. All words of the texts that have it are terms t that may
   reveal it. With frequencies over all D different texts, PMI(t, e) = log2(df(t, e) * D / ((df(t) + SMOOTH) * df(e))) and
   the information content is IC(e) = log2(D / df(e)). What a term leaves unknown of a value is IC - PMI bits, which is 0
   where t occurs with e only. Copies of a text are one piece of evidence. A value in a single text is judged too:
   smoothing lowers what little evidence says, to 1 bit for a word of that one text alone, and there is no floor.
3. A term is sensitive for e if it leaves at most ``GENERALISE`` bits, that is, if e goes with at least half of the
   occurrences of t. Up to ``REMOVE`` bits the term is removed, else it is replaced by its shape: wherever it stands, in
   texts without e too. Bits and not the share PMI/IC are compared, as IC grows with the corpus: a fixed share would call
   any word sensitive that a large corpus has in a few dozen texts.

Pairs are counted with map-side combination. The words of the corpus are read twice, to count the candidate terms and to
find the sensitive ones; a table of hash slots keeps nearly all other words in the task.

Defined cases: a null text is empty; a null doc_id is a document of its own; repeated rows are scanned one by one and
count as one text; a match that fails its check is dropped without a second try; an empty table gives no rows; other
columns are carried by ``sanitise``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_bounded, table, written

KINDS = ("email", "ip", "card", "phone", "term")
#: Bits of a value that a term leaves unknown, at most.
GENERALISE, REMOVE = 1.0, 0.2
#: Texts with a term and without the value that are assumed beside those seen: one text alone is weak evidence.
SMOOTH = 1.0
SLOTS = 1 << 26
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_][\w'-]*")


def _emails(text: str) -> list[tuple[int, int]]:
    """The local part is the run before the @, so each @ is looked at once and long runs cost no second look."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        if at >= end and (m := _DOMAIN.match(text, at)):
            before = text[end:at]
            start = end + len(before.rstrip(_LOCAL))
            if start < at:
                out.append((start, m.end()))
            end = m.end() if start < at else at + 1
        else:
            end = max(end, at + 1)
        at = text.find("@", at + 1)
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    out = [(0, a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((1, *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, *m.span()))
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


def entities_in(text: str, spans: list[tuple[int, int, int]]) -> list[str]:
    """The different values of a text, each with its kind."""
    value = lambda k, v: v.lower() if k == 0 else "".join(c for c in v if c.isdigit() or (k == 1 and c == "."))
    return sorted({f"{KINDS[k]}:{value(k, text[a:b])}" for k, a, b in spans})


def words_outside(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """Every word that lies in no span, with its place."""
    taken = sorted((a, b) for _, a, b in spans)
    found = [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text)]
    return [w for w in found if not _hit(taken, w)] if taken else found


def _hit(taken: list[tuple[int, int]], w: tuple[str, int, int]) -> bool:
    k = bisect_left(taken, (w[2], 0))
    return any(x < w[2] and w[1] < y for x, y in taken[max(0, k - 4) : k])


FOUND = "array<struct<kind:int,start:int,end:int>>"


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, text_key, found (base spans), entities and, where there are any, the terms of every row of docs."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, entities, terms = [], [], []
            for text in batch["text"]:
                text = text if isinstance(text, str) else ""
                spans = base_spans(text)
                found.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                entities.append(entities_in(text, spans))
                terms.append(sorted({w for w, _, _ in words_outside(text, spans)}) if spans else [])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "row_key": batch["row_key"], "text_key": batch["text_key"], "found": found, "entities": entities, "terms": terms})

    slim = docs.select(F.col("doc_id").cast("string").alias("doc_id"), row_key().alias("row_key"), text_key().alias("text_key"), "text")
    found = slim.mapInPandas(scan, f"doc_id string, row_key string, text_key string, found {FOUND}, entities array<string>, terms array<string>")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))  # pandas makes doubles of longs with nulls


def text_key() -> Column:
    """Copies share a key, so that they are one piece of evidence."""
    return F.md5(F.coalesce("text", F.lit("")))


def row_key() -> Column:
    """Identical rows share a key; they have identical spans too."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit(""))))


def disclosures(docs: DataFrame, detected: DataFrame, threshold: float = GENERALISE) -> DataFrame:
    """entity, term, df_pair, df_entity, df_term, pmi, ic and bits = ic - pmi of the pairs that leave at most ``threshold`` bits."""
    seen = detected.filter(F.size("entities") > 0)
    # Distinct first, so that a hot pair is one row per text before it is counted.
    held = seen.select("text_key", "entities", "terms").dropDuplicates(["text_key"])
    pairs = held.select(F.explode("entities").alias("entity"), "terms").select("entity", F.explode("terms").alias("term"))
    df_pair = pairs.groupBy("entity", "term").agg(F.count("*").alias("df_pair"))
    df_entity = held.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("df_entity"))
    df_near = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df_near"))
    copies = written(detected.groupBy("text_key").agg(F.count("*").alias("copies")), "pii-copies")
    d = F.lit(float(max(copies.count(), 2)))

    def bits(df_term: str) -> Column:
        return F.log2((F.greatest(F.col(df_term), F.col("df_pair")) + SMOOTH) / F.col("df_pair"))

    # A term is in at least as many texts as have it beside a value: that bounds the bits from below, so the common
    # words are out before the words of the corpus are counted.
    possible = df_pair.join(df_near, "term").filter(bits("df_near") <= threshold).join(df_entity, "entity")
    possible = written(possible, "pii-pairs")
    df_term = count_terms(docs, copies.filter("copies > 1"), slots(possible, "term"))
    ic = F.log2(d / F.col("df_entity"))
    judged = possible.hint("merge").join(df_term, "term").withColumn("bits", bits("df_term")).filter(F.col("bits") <= threshold)
    return judged.withColumn("ic", ic).withColumn("pmi", F.col("ic") - F.col("bits"))


def slots(keys: DataFrame, column: str) -> bytes:
    """One bit per slot of a hash, 1 where a value of the column falls: others are none of the values, whatever their number.

    The slots leave the tasks as words of 64 bits, in at most SLOTS / 64 rows, and are 8 MB. The driver gets them as Arrow
    batches of 12 bytes a row: as Python rows they would take it some hundreds of MB.
    """
    slot = keys.select((F.crc32(F.col(column).cast("binary")) % SLOTS).alias("slot"))
    bit = F.expr("shiftleft(1L, cast(slot % 64 as int))")
    cells = slot.groupBy(F.floor(F.col("slot") / 64).cast("int").alias("cell")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(SLOTS // 64, dtype="<i8")
    out[cells["cell"].to_numpy()] = cells["bits"].to_numpy()
    return out.tobytes()


def in_slots(value: str, held: bytes) -> bool:
    slot = crc32(value.encode()) % SLOTS
    return bool(held[slot >> 3] >> (slot & 7) & 1)


def words_in(text: str, held: bytes) -> list[str]:
    """The different words of a text that fall into the slots."""
    return [w for w in {w.lower() for w in set(_WORD.findall(text))} if in_slots(w, held)]


def count_terms(docs: DataFrame, copied: DataFrame, held: bytes) -> DataFrame:
    """term, df_term: the number of different texts with a word, for the words that fall into the slots.

    Words of texts that may have copies, by the slots of their keys, leave the task with their text's key and count once for
    it, so that no text is shuffled, however many have copies.
    """
    shared = docs.sparkSession.sparkContext.broadcast((held, slots(copied, "text_key")))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter[tuple[str, str | None]] = Counter()
        terms, copies = shared.value

        def counted() -> pd.DataFrame:
            columns = zip(*n) if n else ([], [])
            return pd.DataFrame({c: pd.Series(list(x), dtype=object) for c, x in zip(("term", "text_key"), columns)} | {"n": pd.Series(list(n.values()), dtype="int64")})

        for batch in batches:
            for text, key in zip(batch["text"], batch["text_key"]):
                if isinstance(text, str):
                    own = key if in_slots(key, copies) else None
                    n.update((w, own) for w in words_in(text, terms))
                if len(n) > 200_000:
                    yield counted()
                    n.clear()
        yield counted()

    counted = docs.select("text", text_key().alias("text_key")).mapInPandas(count, "term string, text_key string, n long")
    once = counted.groupBy("term", "text_key").agg(F.when(F.col("text_key").isNull(), F.sum("n")).otherwise(1).alias("n"))
    return once.groupBy("term").agg(F.sum("n").alias("df_term"))


def occurrences(docs: DataFrame, risky: DataFrame) -> DataFrame:
    """row_key, start, end, bits of every place in docs where a risky term stands outside the base spans."""
    shared = docs.sparkSession.sparkContext.broadcast(slots(risky, "term"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["row_key"], batch["text"]):
                held = set(words_in(text, shared.value)) if isinstance(text, str) else None
                if held:
                    rows += [(key, *w) for w in words_outside(text, base_spans(text)) if w[0] in held]
            columns = zip(*rows) if rows else ([], [], [], [])
            names, kinds = ("row_key", "term", "start", "end"), (object, object, "int32", "int32")
            yield pd.DataFrame({n: pd.Series(list(c), dtype=k) for n, c, k in zip(names, columns, kinds)})

    # The slots drop nearly every other word before the join, which decides.
    words = docs.select(row_key().alias("row_key"), "text").mapInPandas(scan, "row_key string, term string, start int, end int")
    return join_bounded(words, risky, "term", "inner", spread=8).select("row_key", "start", "end", "bits")


def find_spans(docs: DataFrame, threshold: float = GENERALISE) -> DataFrame:
    """doc_id, row_key, spans: array<struct<kind, start, end, bits>> of every row, by kind and start."""
    detected = written(detect(docs), "pii")
    risky = written(disclosures(docs, detected, threshold).groupBy("term").agg(F.min("bits").alias("bits")), "pii-terms")
    hits = occurrences(docs, risky)
    # A set, as identical rows share a key.
    term = hits.groupBy("row_key").agg(F.collect_set(F.struct(F.lit(4).alias("kind"), "start", "end", "bits")).alias("terms"))
    joined = detected.select("doc_id", "row_key", "found").join(term, "row_key", "left")
    base = F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(None).cast("double").alias("bits")))
    spans = F.when(F.col("terms").isNull(), base).otherwise(F.concat(base, "terms"))
    return joined.select("doc_id", "row_key", F.array_sort(spans).alias("spans"))


def sanitise(docs: DataFrame, threshold: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """docs with their texts sanitised: base spans become labels, terms are generalised to their shape or removed.

    Spans are joined by row key, one row for identical rows. Only texts whose keys fall into the slots of those with spans
    are shuffled and rewritten; the others are passed on as they are.
    """
    spans = find_spans(docs, threshold).filter(F.size("spans") > 0).groupBy("row_key").agg(F.first("spans").alias("spans"))
    spans = written(spans, "pii-spans")
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), row_key().alias("row_key"))  # no name can clash
    shared = docs.sparkSession.sparkContext.broadcast(slots(spans, "row_key"))

    @F.pandas_udf("boolean")
    def may_have(keys: pd.Series) -> pd.Series:
        return pd.Series([in_slots(k, shared.value) for k in keys], dtype=bool)

    joined = whole.filter(may_have("row_key")).join(spans.hint("merge"), "row_key", "left")

    def rewrite(text: str | None, spans) -> str | None:
        if text is None or spans is None:
            return text
        out, end = [], 0
        for s in sorted(spans, key=lambda s: (s["start"], -s["end"], s["kind"])):
            if s["end"] <= end:
                continue
            start = max(s["start"], end)
            word = text[start : s["end"]]
            if s["kind"] < 4:
                new = LABELS[KINDS[s["kind"]]]
            else:
                new = "" if s["bits"] <= remove else "[NAME]" if word[:1].isupper() else "[WORD]"
            out += [text[end:start], new]
            end = s["end"]
        return "".join([*out, text[end:]])

    @F.pandas_udf("string")
    def apply(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([rewrite(t if isinstance(t, str) else None, s) for t, s in zip(texts, spans)], dtype=object)

    new = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(apply("row.text", "spans"))
    rewritten = joined.select(*[(new if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])
    return rewritten.union(whole.filter(~may_have("row_key")).select("row.*"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"))
    name = lambda s: F.get(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] < 4)
    of = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


QUERIES = {"op4_pii": op4_pii}
