"""Fill-in-middle by rotations against slices of token lists, and on odd texts."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import fim_rotation as fim

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def by_slices(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    tokens = TOKEN.findall(text)
    n = len(tokens)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(t) for t in (tokens[:a], tokens[a:b], tokens[b:]))
    spm = h[3] % 100 < 20
    return n, "spm" if spm else "psm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    bits = ["abc", "Z", " ", "\n", "é", "😀", "<", "S>", "<P", ">", "<M", "\x00", "ß", "1", "the ", "<S>"]
    rows = [(i, "".join(r.choices(bits[: 15 if i % 9 else 16], k=r.randrange(14)))) for i in range(400)]
    return rows + [(None, "some text here"), (None, None), (900, None), (901, ""), (902, "x"), (903, "Ω" * 40_000 + "end"), (902, "x"), (904, "word " * 300_000)]


def test_equals_slices(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("output", F.lit(1)).withColumn("_cut", F.lit(None).cast("string")).withColumn("n", F.lit("x"))
    cut = fim.fill_in_middle(docs)
    assert cut.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = cut.withColumn("back", fim.restore_column(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:-1] for r in got), key=str) == sorted(((i, *by_slices(i, t)) for i, t in rows), key=str)
    assert sorted((r["back"] for r in got)) == sorted(t or "" for _, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_rotation_inverts():
    r = random.Random(2)
    for _ in range(300):
        data = bytes(r.randrange(256) for _ in range(r.randrange(30)))
        i, m, j = sorted(r.randrange(len(data) + 1) for _ in range(3))
        out = bytearray(data)
        fim.rotate(out, i, m, j)
        assert out == data[:i] + data[m:j] + data[i:m] + data[j:]
        fim.rotate(out, i, i + j - m, j)
        assert out == data


def test_empty(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shares(spark):
    """All plain, and no plain text but those that must be."""
    docs = spark.createDataFrame([(i, f"a b {i}") for i in range(60)], "doc_id long, text string")
    assert {r["form"] for r in fim.fill_in_middle(docs, plain=0).collect()} == {"plain"}
    assert {r["form"] for r in fim.fill_in_middle(docs, plain=100, spm=100).collect()} == {"spm"}
