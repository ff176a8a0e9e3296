"""Conversation structure repair by a run-length dynamic programme.

A row of a conversation is a symbol: the initial of its role (s, u, a or another) and its first fault. ``blank`` has no character but
white space, ``duplicate`` has a role and text seen earlier, ``truncated`` does not end in one of ``.!?``. Edits turn the rows into
roles ``(s?(ua)+)?`` at the least cost: Keep 0, Rerole to user or assistant 3, Delete 4 (required for blank and duplicate), Insert an
empty user or assistant turn 3; a truncated row that stays adds 3. Of the cheapest audits (the edits' initials) the least counts.

The pattern has four states: nothing yet, after s, after u, after a. A row is a min-plus 4 x 4 matrix over them, which includes the
inserts before it. Equal consecutive symbols are one run, and a run of n rows is passed backwards by the binary powers of its matrix, cached
by symbol and exponent; costs are kept relative to their least, so that the same few vectors come again. The choices are then
unrolled forwards, by halves of each power, and halves with the same symbol, costs and state are unrolled once.

How it is spread: identical rows are one row with a number of copies; the first turn of each role and text is found by a partial minimum and
a join; 512 turn numbers of a conversation are one part, reduced to runs before they meet. Only runs meet in one task, and
the audit, a single value of the result, is longer than they are. Texts stay in their parts; the digest reads a conversation's parts in order as a
stream, as a hash must.

Defined cases: a null text or role is one space (so the row is blank, or its role another); a null conversation id is a conversation; null
turns come first and are one part; ties of a turn are ordered by role and text; a role counts by its first letter, so ``system``
and ``sys`` are alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, written

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: 2 to the power of PART turn numbers are one part of a conversation.
PART = 9
NOT_BLANK = r"[^\x20\x09-\x0D]"
#: Symbols by fault and by initial (s, u, a, another): sound, truncated, to be deleted.
INITIALS = "sua"
SOUND, CUT, GONE = "suao", "SUAO", "1234"
NEVER = 10**15
#: States: nothing yet, after s, after u, after a. Where an inserted or reroled turn leads, and the role it has.
NEXT, SPOKEN = (2, 2, 3, 2), ("user", "user", "assistant", "user")
END = (0, 2 * INSERT, INSERT, 0)
#: Unrolled halves up to this exponent are cached.
CACHED = 12

Vector = tuple[int, int, int, int]


# --- the programme over runs ---------------------------------------------------------------------------------------------------


def edges(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the ways to take one row, least letter first."""
    out = [("D", DELETE, state)]
    if symbol not in GONE:
        extra = TRUNCATED if symbol in CUT else 0
        role = symbol.lower()
        kept = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(role, {}).get(state)
        if kept is not None:
            out.append(("K", extra, kept))
        out.append(("R", REROLE + extra, NEXT[state]))
    return out


def times(a: tuple[Vector, ...], b: tuple[Vector, ...]) -> tuple[Vector, ...]:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


@lru_cache(maxsize=None)
def power(symbol: str, k: int) -> tuple[Vector, ...]:
    """The min-plus matrix of 2**k rows of a symbol."""
    if k:
        return times(power(symbol, k - 1), power(symbol, k - 1))
    inserts = [[NEVER] * 4 for _ in range(4)]
    for s in range(4):
        at, cost = s, 0
        for _ in range(3):
            inserts[s][at] = min(inserts[s][at], cost)
            at, cost = NEXT[at], cost + INSERT
    row = [[NEVER] * 4 for _ in range(4)]
    for s in range(4):
        for _, cost, to in edges(symbol, s):
            row[s][to] = min(row[s][to], cost)
    return times(tuple(map(tuple, inserts)), tuple(map(tuple, row)))


@lru_cache(maxsize=100_000)
def before(symbol: str, k: int, after: Vector) -> tuple[Vector, int]:
    """The costs to go before 2**k rows, relative to the least of them, and that least."""
    costs = [min(c + v for c, v in zip(row, after)) for row in power(symbol, k)]
    least = min(costs)
    return tuple(c - least for c in costs), least


def unroll(symbol: str, k: int, after: Vector, state: int) -> tuple[str, int]:
    """The letters of 2**k rows before costs ``after``, and the state behind them."""
    return _held(symbol, k, after, state) if k <= CACHED else _halves(symbol, k, after, state)


def _halves(symbol: str, k: int, after: Vector, state: int) -> tuple[str, int]:
    left, state = unroll(symbol, k - 1, before(symbol, k - 1, after)[0], state)
    right, state = unroll(symbol, k - 1, after, state)
    return left + right, state


@lru_cache(maxsize=20_000)
def _held(symbol: str, k: int, after: Vector, state: int) -> tuple[str, int]:
    if k:
        return _halves(symbol, k, after, state)
    relative, least = before(symbol, 0, after)
    letters = ""
    while True:
        left = relative[state] + least
        here = {letter: to for letter, cost, to in edges(symbol, state) if cost + after[to] == left}
        if "D" in here:
            return letters + "D", here["D"]
        if INSERT + relative[NEXT[state]] + least == left:
            letters, state = letters + "I", NEXT[state]
            continue
        letter = min(here)
        return letters + letter, here[letter]


def plan(parts: list[list[tuple[str, int]]]) -> tuple[int, list[str], list[int]]:
    """Runs (symbol, rows) of each part in order -> cost, and for each part its piece of the audit and the state before it."""
    blocks = [[(symbol, k) for symbol, n in runs for k in range(n.bit_length()) if n >> k & 1] for runs in parts]
    costs, total = END, 0
    behind: list[list[Vector]] = []
    for part in reversed(blocks):
        vectors = []
        for symbol, k in reversed(part):
            vectors.append(costs)
            costs, least = before(symbol, k, costs)
            total += least
        behind.append(vectors[::-1])
    cost, state = total + costs[0], 0
    pieces, states = [], []
    for part, vectors in zip(blocks, reversed(behind)):
        states.append(state)
        letters = []
        for (symbol, k), after in zip(part, vectors):
            piece, state = unroll(symbol, k, after, state)
            letters.append(piece)
        pieces.append("".join(letters))
    if pieces:
        pieces[-1] += "I" * (END[state] // INSERT)
    return cost, pieces, states


def illegal_pairs(runs: list[tuple[str, int]]) -> int:
    """Adjacent rows whose initials are not su, ua or au."""
    initial = {c: "suao"[i] for kind in (SOUND, CUT, GONE) for i, c in enumerate(kind)}
    bad = sum(n - 1 for _, n in runs)
    return bad + sum(initial[a] + initial[b] not in ("su", "ua", "au") for (a, _), (b, _) in zip(runs, runs[1:]))


# --- as DataFrames -------------------------------------------------------------------------------------------------------------


def damage(turns: DataFrame) -> DataFrame:
    """The rows of the contract after its damage: crc32 of `conv_id:turn` modulo 20 drops, empties, cuts, repeats or reroles a row."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("_kind")).filter("_kind > 0")
    changed = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def parts(turns: DataFrame) -> DataFrame:
    """conv_id, part, rows: array<struct<.., role, text, first, copies>> in order, runs: `u3 a1 ..`, and the counts of each part."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.withColumn("said", F.sha2(F.to_json(F.struct("conv_id", "role", "text")), 256)).withColumn("at", F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn")))
    firsts = rows.groupBy("said").agg(F.min("at").alias("first_at"))
    rows = rows.groupBy("conv_id", "turn", "at", "role", "text", "said").agg(F.count("*").alias("copies")).join(firsts, "said")

    blank = ~F.regexp_like("text", F.lit(NOT_BLANK))
    last = F.substring(F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     ")), -1, 1)
    first = (F.col("at") == F.col("first_at")).cast("int")
    alive = F.when(blank, 0).otherwise(first)
    initial = F.when(F.substring("role", 1, 1).isin(*INITIALS), F.instr(F.lit(INITIALS), F.substring("role", 1, 1))).otherwise(4)
    symbol = lambda kind: F.substring(F.lit(kind), initial, F.lit(1))
    cut = ~last.isin(".", "!", "?")
    faults = rows.select(
        "conv_id",
        F.coalesce(F.shiftright("turn", PART), F.lit(-(2**63))).alias("part"),
        "turn",
        F.struct("at", "role", "text", "copies", alive.alias("alive"), F.when(cut, symbol(CUT)).otherwise(symbol(SOUND)).alias("symbol"), symbol(GONE).alias("gone")).alias("row"),
        F.when(blank, F.col("copies")).otherwise(0).alias("blank"),
        F.when(blank, 0).otherwise(F.col("copies") - first).alias("duplicate"),
        F.when(cut, alive).otherwise(0).alias("truncated"),
    )
    # Copies of a row have its turn, so turns are distinct by their first rows; a window over turns is not needed.
    grouped = faults.groupBy("conv_id", "part").agg(
        F.sort_array(F.collect_list("row")).alias("rows"),
        F.min("turn").alias("least"),
        F.max("turn").alias("most"),
        F.size(F.collect_set("turn")).alias("turns"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
    )
    pair = lambda symbol, n: F.struct(symbol.alias("s"), n.cast("long").alias("n"))
    marks = F.filter(F.flatten(F.transform("rows", lambda r: F.array(pair(r["symbol"], r["alive"]), pair(r["gone"], r["copies"] - r["alive"])))), lambda m: m["n"] > 0)
    marked = grouped.withColumn("marks", marks)
    starts = F.filter(F.sequence(F.lit(0), F.size("marks") - 1), lambda i: (i == 0) | (F.get("marks", i)["s"] != F.get("marks", i - 1)["s"]))
    marked = marked.withColumn("starts", starts)

    def run(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), F.size("marks"))
        return F.concat(F.get("marks", start)["s"], F.aggregate(F.slice("marks", start + 1, end - start), F.lit(0).cast("long"), lambda a, m: a + m["n"]).cast("string"))

    return marked.withColumn("runs", F.array_join(F.transform("starts", run), " ")).drop("marks", "starts")


PLAN = "struct<cost: bigint, illegal: bigint, pieces: array<string>, states: array<int>>"
_PLAN = pa.struct([("cost", pa.int64()), ("illegal", pa.int64()), ("pieces", pa.list_(pa.string())), ("states", pa.list_(pa.int32()))])


def _merged(runs: Iterator[tuple[str, int]]) -> list[tuple[str, int]]:
    out: list[tuple[str, int]] = []
    for symbol, n in runs:
        if out and out[-1][0] == symbol:
            out[-1] = (symbol, out[-1][1] + n)
        else:
            out.append((symbol, n))
    return out


def _plan(runs: pa.Array) -> pa.Array:
    rows = []
    for texts in runs.to_pylist():
        marks = [[(r[0], int(r[1:])) for r in t.split(" ")] for t in texts]
        cost, pieces, states = plan(marks)
        rows.append({"cost": cost, "illegal": illegal_pairs(_merged(r for part in marks for r in part)), "pieces": pieces, "states": states})
    return pa.array(rows, _PLAN)


TURNS = "array<struct<role: string, text: string>>"


def _apply(pieces: pa.Array, states: pa.Array, roles: pa.Array, texts: pa.Array, copies: pa.Array) -> pa.Array:
    """The turns of a part after its edits."""
    out = []
    for piece, state, role, text, n in zip(pieces.to_pylist(), states.to_pylist(), roles.to_pylist(), texts.to_pylist(), copies.to_pylist()):
        turns, row, used = [], 0, 0
        for letter in piece:
            if letter == "I":
                turns.append({"role": SPOKEN[state], "text": ""})
                state = NEXT[state]
                continue
            if letter != "D":
                turns.append({"role": role[row] if letter == "K" else SPOKEN[state], "text": text[row]})
                state = 1 if letter == "K" and role[row][:1] == "s" else NEXT[state]
            used += 1
            if used == n[row]:
                row, used = row + 1, 0
        out.append(turns)
    return pa.array(out, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))


NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, part, audit (the part's piece), turns: array<struct<role, text>> as repaired, and the numbers of the conversation."""
    divided = written(parts(turns), "turn-parts")
    order = F.sort_array(F.collect_list(F.struct("part", "runs")))
    gaps = F.coalesce(F.max("most") - F.min("least") + 1 - F.sum("turns"), F.lit(0)).cast("long")
    talks = divided.groupBy("conv_id").agg(order.alias("order"), gaps.alias("gaps"), *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")])
    planned = talks.withColumn("plan", F.arrow_udf(_plan, PLAN)(F.transform("order", lambda p: p["runs"])))
    numbers = F.struct("gaps", "blank", "duplicate", "truncated", "plan.illegal", "plan.cost").alias("numbers")
    each = F.explode(F.arrays_zip(F.transform("order", lambda p: p["part"]).alias("part"), F.col("plan.pieces").alias("audit"), F.col("plan.states").alias("state"))).alias("p")
    pieces = planned.select(F.col("conv_id").alias("_conv"), numbers, each).select("_conv", "numbers", F.col("p.part").alias("_part"), "p.audit", "p.state")
    joined = divided.join(pieces, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")))
    rows = lambda f: F.transform("rows", lambda r: r[f])
    return joined.select("conv_id", "part", "audit", F.arrow_udf(_apply, TURNS)("audit", "state", rows("role"), rows("text"), rows("copies")).alias("turns"), "numbers.*")


def digests(repaired: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, the numbers, the audit and the hash of its repaired `role:text` lines, read part by part."""
    kind = repaired.schema["conv_id"].dataType
    fields = [T.StructField("conv_id", kind), *[T.StructField(c, T.LongType()) for c in NUMBERS], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, audit, lines, seen = None, [], hashlib.sha256(), False

        def row() -> list:
            return [*held, "".join(audit), lines.hexdigest()]

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if held is None or held[0] != r["conv_id"]:
                    rows += [row()] if held is not None else []
                    held, audit, lines, seen = [r["conv_id"], *[r[c] for c in NUMBERS]], [], hashlib.sha256(), False
                audit.append(r["audit"])
                for turn in r["turns"]:
                    lines.update(f"{chr(10) if seen else ''}{turn['role']}:{turn['text']}".encode())
                    seen = True
            yield _batch(rows, batch.schema.field("conv_id").type)
        if held is not None:
            yield _batch([row()], None)

    def _batch(rows: list[list], of: pa.DataType | None) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(fields)
        kinds = [of, *[pa.int64()] * len(NUMBERS), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.name for f in fields])

    ordered = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "part").select("conv_id", "audit", "turns", *NUMBERS)
    return ordered.mapInArrow(read, T.StructType(fields))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = digests(repair(damage(turns))).withColumnRenamed("conv_id", "_conv")
    talks = turns.select("conv_id").distinct()
    return talks.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in NUMBERS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


QUERIES = {"op13_turn_repair": op13_turn_repair}

#: A forward programme row by row that carries costs, audits and texts; the crc32 is made from its polynomial.
ORACLE_SQL = {
    "op13_turn_repair": r"""
WITH RECURSIVE tab AS (
  SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))),
k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS codes
  FROM conversations),
h AS (SELECT k.*, xor(list_reduce(list_prepend(4294967295, codes), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS kind FROM k, tab),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM h WHERE kind > 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS rn,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM d),
r AS (
  SELECT conv_id, rn, turn, role, text, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS ini, bare = '' AS blank, bare <> '' AND nth > 1 AS dup, bare <> '' AND nth = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS cut FROM o),
counts AS (
  SELECT conv_id, max(rn) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
         count(*) FILTER (prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY rn) AS prev FROM r) GROUP BY conv_id),
ins(p, q, cost, letters, said) AS (VALUES
  (0, 0, 0, '', []), (0, 2, 3, 'I', ['user:']), (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 1, 0, '', []), (1, 2, 3, 'I', ['user:']), (1, 3, 6, 'II', ['user:', 'assistant:']),
  (2, 2, 0, '', []), (2, 3, 3, 'I', ['assistant:']), (3, 3, 0, '', []), (3, 2, 3, 'I', ['user:'])),
ed(p, letter, ini, q, spoken, cost) AS (VALUES
  (0, 'D', NULL, 0, NULL, 4), (1, 'D', NULL, 1, NULL, 4), (2, 'D', NULL, 2, NULL, 4), (3, 'D', NULL, 3, NULL, 4),
  (0, 'K', 's', 1, NULL, 0), (0, 'K', 'u', 2, NULL, 0), (1, 'K', 'u', 2, NULL, 0), (3, 'K', 'u', 2, NULL, 0), (2, 'K', 'a', 3, NULL, 0),
  (0, 'R', NULL, 2, 'user', 3), (1, 'R', NULL, 2, 'user', 3), (3, 'R', NULL, 2, 'user', 3), (2, 'R', NULL, 3, 'assistant', 3)),
f AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS rn, 0 AS state, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS said FROM counts
  UNION ALL
  SELECT conv_id, rn, state, cost, audit, said FROM (
    SELECT f.conv_id, r.rn, ed.q AS state, f.cost + ins.cost + ed.cost + CASE WHEN r.cut AND ed.letter <> 'D' THEN 3 ELSE 0 END AS cost, f.audit || ins.letters || ed.letter AS audit,
           list_concat(list_concat(f.said, ins.said), CASE WHEN ed.letter = 'D' THEN [] ELSE [coalesce(ed.spoken, r.role) || ':' || r.text] END) AS said
    FROM f JOIN r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.rn = f.rn + 1 JOIN ins ON ins.p = f.state
    JOIN ed ON ed.p = ins.q AND (ed.letter = 'D' OR NOT r.blank AND NOT r.dup AND (ed.ini IS NULL OR ed.ini = r.ini)))
  QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1),
e AS (
  SELECT f.conv_id, f.cost + ins.cost AS cost, f.audit || ins.letters AS audit, list_concat(f.said, ins.said) AS said
  FROM f JOIN counts c ON c.conv_id IS NOT DISTINCT FROM f.conv_id AND c.n = f.rn JOIN ins ON ins.p = f.state AND ins.q IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY f.conv_id ORDER BY f.cost + ins.cost, f.audit || ins.letters) = 1)
SELECT a.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
       CAST(coalesce(e.cost, 0) AS BIGINT) AS cost, coalesce(e.audit, '') AS audit, sha256(coalesce(array_to_string(e.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id"""
}
