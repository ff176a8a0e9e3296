"""Secret scans against a plain Python version, and on odd rows."""

import hashlib
import math
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from lodestone.llm import secret_scan as ss

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def z_values(s, e):
    """Deviations from random of chi-squared, runs and serial correlation, and towards random from ordinary strings, by their definitions."""
    n, a = len(s), e["alphabet"]
    counts = [s.count(c) for c in a]
    chi = sum((c - n / len(a)) ** 2 / (n / len(a)) for c in counts)
    marks = [e["marks"][a.index(c)] for c in s]
    changes = sum(x != y for x, y in zip(marks, marks[1:]))
    xs = [a.index(c) + 1 for c in s]
    mean = sum(xs) / n
    spread = sum((x - mean) ** 2 for x in xs)
    if spread < 1e-9:
        return None
    serial = sum((x - mean) * (y - mean) for x, y in zip(xs, xs[1:])) / spread
    random_ = (
        (chi - len(a) + 1) / math.sqrt(2 * (len(a) - 1) * (n - 1) / n),
        (changes - (n - 1) * (1 - e["c2"])) / math.sqrt((n - 1) * (e["c2"] - e["c2"] ** 2) + 2 * (n - 2) * (e["c3"] - e["c2"] ** 2)),
        (serial + 1 / n) * math.sqrt(n),
    )
    pairs = sum(c * (c - 1) / 2 for c in counts)
    var = n * (n - 1) / 2 * (e["s2"] - e["s2"] ** 2) + n * (n - 1) * (n - 2) * (e["s3"] - e["s2"] ** 2)
    by_pairs = (pairs - n * (n - 1) / 2 * e["s2"]) / math.sqrt(var)
    by_runs = e["sign"] * (changes - (n - 1) * e["rate"]) / math.sqrt((n - 1) * e["rate"] * (1 - e["rate"]))
    return random_, (by_runs - by_pairs) / math.sqrt(2)


def brute_force(rows, fdr=ss.FDR):
    """[(doc_id, findings as text)] of (doc_id, text) rows."""
    found, strata = [], {}
    for doc_id, text in rows:
        text = text or ""
        spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        tested = []
        for m in re.finditer("[A-Za-z0-9+/]{16,}={0,2}", text):
            s = m[0].rstrip("=")
            e = None if s.isdigit() else next(e for e in ss.encodings() if re.fullmatch(e["rx"], s))
            if e:
                z = z_values(s, e)
                bin_ = 0
                if z and max(map(abs, z[0])) <= ss.BATTERY and z[1] > 0:
                    near = min(z[1], ss.MOST)
                    bin_ = math.floor(-100 * math.log10(4 * math.exp(-near * near / 2) / math.sqrt(2 * math.pi) / (3 * near + math.sqrt(near * near + 8))))
                key = (e["kind"], sum(len(s) >= b for b in ss.BANDS) - 1)
                strata.setdefault(key, {})[s] = bin_
                tested.append((m.start(), m.end(), key, bin_))
        found.append((doc_id, spans, tested))
    least = {}
    for key, bins in strata.items():
        ordered = sorted(bins.values(), reverse=True)
        good = [b for b in set(ordered) if 10 ** (-b / 100) * len(ordered) <= fdr * sum(x >= b for x in ordered)]
        if good:
            least[key] = min(good)
    out = []
    for doc_id, spans, tested in found:
        spans = spans + [(a, 3 + ss.KINDS.index(key[0]), f"random-{key[0]}", b) for a, b, key, bin_ in tested if key in least and bin_ >= least[key]]
        out.append((doc_id, ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans))))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    word = lambda: "".join(r.choice(["ba", "ter", "sion", "le", "qu", "con", "mi", "o"]) for _ in range(r.randrange(2, 9)))
    camel = lambda: "".join(word().capitalize() for _ in range(4))
    any_of = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    kinds = [string.hexdigits[:16], string.hexdigits[:10] + "ABCDEF", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + "234567", string.ascii_lowercase + string.digits]
    rows = []
    for i in range(300):
        parts = [word() for _ in range(r.randrange(12))] + [camel()] * (i % 3) + ["usr/" + "/".join(word() for _ in range(5))] * (i % 2)
        if i % 2:
            parts.append(any_of(kinds[i % 6], r.choice([16, 20, 31, 40, 64, 120])) + "=" * (i % 3))
        if i % 7 == 0:
            parts += [r.choice(["Password: ", 'API_KEY="', "toKen=", "secret : '"]) + any_of(kinds[3], r.randrange(3, 30)), "secret: token: longvalue9", "é😀 AKIA" + any_of(string.ascii_uppercase + string.digits, r.randrange(12, 20))]
        r.shuffle(parts)
        rows.append((i, " ".join(parts)))
    odd = ["", None, "a" * 40, "0123456789abcdef" * 3, "1" * 50, "AKIA" * 9, "token=" * 5, "abcdefghijklmnopqrstuvwxyz0123456789", "=" * 50, "ſecret: longvalue", "toKen=longvalue K", any_of(kinds[3], 3000)]
    rows += [(1000 + i, t) for i, t in enumerate(odd)] + [(None, "token = abcdef123"), (5, rows[5][1]), (5, rows[5][1])] + [(2000 + i, rows[1][1]) for i in range(50)]
    return rows


def test_equals_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("findings", F.lit(1)).withColumn("hex", F.lit("x")).withColumn("candidates", F.lit(2))
    got = ss.find_secrets(docs)
    assert got.columns == ["doc_id", "findings"]
    got = sorted(((r["doc_id"], ",".join(f"{f['kind']}:{f['start']}:{f['end']}" for f in r["findings"])) for r in got.collect()), key=str)
    assert got == brute_force(rows)


def test_finds_secrets_and_leaves_words(spark, rows):
    """Most random strings of 40 symbols and more are found, and nearly all of what is found is random."""
    texts = dict(rows)
    hits = {(r["doc_id"], texts[r["doc_id"]][f["start"] : f["end"]]) for r in ss.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect() for f in r["findings"] if f["kind"].startswith("random") and r["doc_id"] is not None and r["doc_id"] < 300}
    wrong = [s for i, s in hits if i % 2 == 0 and i % 7]
    long_ones = [i for i in range(1, 300, 2) if i % 7 and any(len(s) >= 40 and any(c.isdigit() for c in s) for s in re.findall("[A-Za-z0-9+/]{16,}", texts[i]) if not s.startswith("usr/"))]
    assert len(wrong) <= 0.05 * len(hits)
    assert sum(any(i == j for j, _ in hits) for i in long_ones) >= 0.85 * len(long_ones)


def test_query(spark, rows):
    path = f"{spark.conf.get('spark.sql.warehouse.dir')}/secrets"
    spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(f"{path}/documents.parquet")
    want = dict(brute_force(rows))
    for r in ss.op11_secret_scan(spark, path).collect():
        parts = want[r["doc_id"]].split(",") if want[r["doc_id"]] else []
        assert r["spans"] == ",".join(parts)
        base = [p for p in parts if not p.startswith("random")]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(p.startswith(k + ":") for p in base) for k in ("assign", "access", "hex")]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()


def test_empty(spark):
    assert ss.find_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0
