"""Conversation repair by runs against a row by row programme, and on odd rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.llm import turn_repair as tr

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
SAID = {2: "user", 3: "assistant"}


def by_rows(rows):
    """(turn, role, text) rows of a conversation -> the result of the contract, trying all edits of each row."""
    rows = sorted(((t is not None, t or 0), r if r is not None else " ", x if x is not None else " ") for t, r, x in rows)
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    best = {0: (0, "", [])}

    def inserted(best):
        out = dict(best)
        for _ in range(2):
            for s, (cost, audit, said) in list(out.items()):
                q = NEXT[s]
                new = (cost + 3, audit + "I", [*said, SAID[q] + ":"])
                if q not in out or new[:2] < out[q][:2]:
                    out[q] = new
        return out

    for (_, role, text), fault in zip(rows, faults):
        new = {}
        for s, (cost, audit, said) in inserted(best).items():
            ways = [(s, 4, "D", [])]
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                keep = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role[:1], s))
                if keep:
                    ways.append((keep, extra, "K", [f"{role}:{text}"]))
                ways.append((NEXT[s], 3 + extra, "R", [f"{SAID[NEXT[s]]}:{text}"]))
            for q, c, letter, lines in ways:
                way = (cost + c, audit + letter, said + lines)
                if q not in new or way[:2] < new[q][:2]:
                    new[q] = way
        best = new
    cost, audit, said = min((v for s, v in inserted(best).items() if s in (0, 3)), key=lambda v: v[:2])
    known = [t for (ok, t), _, _ in rows if ok]
    initials = [r[:1] if r[:1] in ("s", "u", "a") else "o" for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def random_rows(seed, n):
    r = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", None, "tool", "sys", ""]
    texts = ["ok.", "yes!", "no", "  ", "", None, "é?\n", "long text. end", "more\t", "\x0b", "?"] + [f"t{i}." for i in range(12)]
    return [(r.choice([None, *range(0, 3 * n)]), r.choice(roles), r.choice(texts)) for _ in range(n)]


@pytest.fixture(scope="module")
def talks():
    talks = {c: random_rows(c, c % 14 + 1) for c in range(120)}
    talks[None] = random_rows(500, 9)
    talks[1000] = random_rows(1000, 1500)  # several parts
    talks[1001] = [(i, "user", f"t{i}.") for i in range(9000)]  # one run beyond the cached powers, over parts
    talks[1002] = [(3, "user", "same.")] * 700
    talks[1003] = [(None, None, None)]
    talks[1004] = [(-(2**40), "user", "a."), (2**40, "assistant", "b.")]
    return talks


def test_equals_rows(spark, talks):
    rows = [(c, *r) for c, rs in talks.items() for r in rs]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("part", F.lit("x")).withColumn("audit", F.lit(1)).withColumn("copies", F.lit(1))
    fixed = tr.repair(df)
    got = {r["conv_id"]: tuple(r)[1:] for r in tr.digests(fixed).collect()}
    assert got == {c: by_rows(rs) for c, rs in talks.items()}
    for r in fixed.filter("conv_id between 0 and 119").groupBy("conv_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", "turns"))), lambda p: p["turns"])).alias("turns")).collect():
        assert tr.illegal_pairs([({"s": "s", "u": "u", "a": "a"}[t["role"][0]], 1) for t in r["turns"]]) == 0


def test_damage_and_dropped(spark):
    """Every kind of damage, and conversations whose only row is dropped."""
    rows = [(c, t, "assistant" if t % 2 else "user", f"What. {c} Is! {t}?") for c in range(60) for t in range(1 if c < 40 else 6)] + [(None, None, None, None)]
    left = {}
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
        left.setdefault(c, [])
        left[c] += [(t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    path = f"{spark.conf.get('spark.sql.warehouse.dir')}/turns"
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(f"{path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r)[1:] for r in tr.op13_turn_repair(spark, path).collect()}
    assert got == {c: by_rows(rs) for c, rs in left.items()}
    assert any(not rs for rs in left.values())


def test_empty(spark):
    assert tr.digests(tr.repair(spark.createDataFrame([], SCHEMA))).count() == 0
