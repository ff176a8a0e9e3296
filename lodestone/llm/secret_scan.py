"""Secret scans with fixed patterns and a battery of randomness tests, with Spark expressions only.

The base kinds are patterns. Beside them, each run of 16 or more characters of base64 is a candidate. Its encoding is the smallest
alphabet that holds it (digits alone are a number and no candidate). Three statistics are taken of its n symbols over an alphabet of A:

- chi-squared of the symbols' counts against equal shares, A * sum(c^2) / n - n;
- runs of symbols of one class (cases and digits; vowels and others for letters alone);
- the serial correlation at lag 1 of the symbols' places in the alphabet.

A candidate passes the battery if each lies within BATTERY standard deviations of its mean for random symbols (the moments are exact but
for the serial correlation, 1/sqrt(n)). To be a secret it must also be unlike an ordinary string of its length: chi-squared and runs are
compared with their moments under ORDINARY, repetition and class changes of words and identifiers, and the two deviations towards randomness,
added and divided by sqrt(2), give a p-value by an upper bound of the normal tail. These depend on n: a short string is hardly ever far from both.
Benjamini and Hochberg's procedure then holds the share of false discoveries at FDR within each encoding and band of lengths. It counts each
different string once, so copies are one piece of evidence, and works on p-values rounded up to hundredths of a decade: each stratum has at most
a few ten thousand values, and the thresholds are at most one row per stratum.

Spans of the method are of kinds ``random-hex`` and so on, and may lie on base spans, which they never remove.

Defined cases: a null or empty text has no spans; repeated rows are scanned one by one; an empty table gives no rows; other columns are
ignored; a string of one symbol has no serial correlation and fails. Texts are read once; what is found in them is written without them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import running, table, written

#: Fixed patterns: kind, regex, group to measure, least length of the group. Letters of the first in either case.
BASE = [
    ("assign", r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
CANDIDATE = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{16,}={0,2}"
#: What every match of the first pattern holds; found much faster than its words.
ASSIGNED = r"[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]"
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings, the first that holds all symbols counts: kind, regex, alphabet, whether classes are vowels and others.
ENCODINGS = [
    ("hex", "[0-9a-f]+", DIGITS + "abcdef", False),
    ("hex", "[0-9A-F]+", DIGITS + "ABCDEF", False),
    ("letters", "[a-z]+", LOWER, True),
    ("letters", "[A-Z]+", UPPER, True),
    ("base32", "[A-Z2-7]+", UPPER + "234567", False),
    ("base36", "[a-z0-9]+", LOWER + DIGITS, False),
    ("base36", "[A-Z0-9]+", UPPER + DIGITS, False),
    ("base62", "[A-Za-z0-9]+", UPPER + LOWER + DIGITS, False),
    ("base64", "[A-Za-z0-9+/]+", UPPER + LOWER + DIGITS + "+/", False),
]
#: Ordinary strings by kind: the sums of the squares and cubes of their symbols' shares, and how often the class changes from one symbol to the next.
ORDINARY = {
    "hex": (0.12, 0.018, 0.2),
    "letters": (0.065, 0.0054, 0.55),
    "base32": (0.065, 0.0054, 0.15),
    "base36": (0.055, 0.0042, 0.2),
    "base62": (0.045, 0.003, 0.3),
    "base64": (0.045, 0.003, 0.3),
}
KINDS = ["hex", "letters", "base32", "base36", "base62", "base64"]
BANDS = [16, 24, 32, 48, 96]
BATTERY, FDR = 3.5, 0.01
MOST = 37.0  #: standard deviations beyond which a p-value is no double


def classes(alphabet: str, vowels: bool) -> str:
    """The class of each symbol: v and c, or l, u, d and o."""
    if vowels:
        return "".join("v" if c.lower() in "aeiou" else "c" for c in alphabet)
    return "".join("l" if c in LOWER else "u" if c in UPPER else "d" if c in DIGITS else "o" for c in alphabet)


def encodings() -> list[dict]:
    """What the tests need of each encoding."""
    out = []
    for kind, rx, alphabet, vowels in ENCODINGS:
        marks = classes(alphabet, vowels)
        shares = [marks.count(m) / len(marks) for m in sorted(set(marks))]
        s2, s3, rate = ORDINARY[kind]
        c2, c3 = sum(p**2 for p in shares), sum(p**3 for p in shares)
        out.append({"kind": kind, "rx": rx, "alphabet": alphabet, "marks": marks, "size": float(len(alphabet)), "s2": s2, "s3": s3, "rate": rate, "c2": c2, "c3": c3, "sign": 1.0 if 1 - c2 > rate else -1.0})
    return out


def spans(docs: DataFrame, patterns: list[tuple[str, str, int]]) -> DataFrame:
    """doc_id and for each (name, regex, group) array<struct<start, end, s>> of all matches in code points; s is the group.

    Each step is a column of its own, so that no regex runs twice; a text is split only where it has a match.
    """
    names = [name for name, *_ in patterns]
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    gates = {BASE[0][0]: F.regexp_like("text", F.lit(ASSIGNED))}
    hits = text.select("*", *[F.when(gates.get(name, F.lit(True)), F.regexp_extract_all("text", F.lit(rx), F.lit(0))).otherwise(F.array().cast("array<string>")).alias(name) for name, rx, _ in patterns])

    def gaps(name: str, rx: str) -> Column:
        cut = F.transform(F.slice(F.split("text", rx, -1), 1, F.size(name)), lambda g: F.length(g))
        return F.when(F.size(name) > 0, F.zip_with(cut, F.transform(name, lambda h: F.length(h)), lambda g, h: F.struct(g.alias("gap"), h.alias("hit"))))

    def said(name: str, rx: str, group: int) -> Column:
        return F.col(name) if group == 0 else F.when(F.size(name) > 0, F.regexp_extract_all("text", F.lit(rx), F.lit(group)))

    parted = hits.select("doc_id", *[gaps(name, rx).alias(f"{name}_gaps") for name, rx, _ in patterns], *[said(*p).alias(p[0]) for p in patterns])
    starts = parted.select("*", *[running(F.col(f"{name}_gaps"), F.lit(0), lambda at, x: at + x["gap"] + x["hit"], lambda a, b: a + b).alias(f"{name}_starts") for name in names])

    def placed(name: str) -> Column:
        ends = F.zip_with(f"{name}_gaps", f"{name}_starts", lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["hit"]).alias("end")))
        return F.zip_with(ends, name, lambda p, s: F.struct(p["start"].alias("start"), p["end"].alias("end"), s.alias("s")))

    none = F.expr("cast(array() as array<struct<start:int,end:int,s:string>>)")
    return starts.select("doc_id", *[F.coalesce(placed(name), none).alias(name) for name in names])


def _of(field: str, code: Column) -> Column:
    return F.get(F.array(*[F.lit(e[field]) for e in encodings()]), code)


def tail_bin(z: Column) -> Column:
    """Hundredths of decades of an upper bound of the normal tail beyond z, rounded down, 0 below the mean."""
    near = F.least(z, F.lit(MOST))
    tail = 4 * F.exp(-near * near / 2) / math.sqrt(2 * math.pi) / (3 * near + F.sqrt(near * near + 8))
    return F.when(z > 0, F.floor(-100 * F.log10(tail)).cast("int")).otherwise(0)


def measured(candidates: Column) -> Column:
    """array<struct<start, end, s>> -> array<struct<start, end, kind, band, bin, id>> of all but numbers.

    Each step is a transform of its own, since an expression used twice within a lambda runs twice.
    """
    keep = lambda c, *names: [c[n].alias(n) for n in names]
    bare = F.transform(candidates, lambda c: F.struct(*keep(c, "start", "end"), F.rtrim(c["s"], F.lit("=")).alias("s")))
    code = lambda s: F.coalesce(*[F.when(F.regexp_like(s, F.lit(f"^(?:{e['rx']})$")), F.lit(i)) for i, e in enumerate(encodings())])
    coded = F.transform(F.filter(bare, lambda c: ~F.regexp_like(c["s"], F.lit("^[0-9]+$"))), lambda c: F.struct(*keep(c, "start", "end", "s"), code(c["s"]).alias("code")))
    laid = F.transform(coded, lambda c: F.struct(*keep(c, "start", "end", "s", "code"), F.length(c["s"]).cast("double").alias("n"), F.transform(F.split(c["s"], ""), lambda x: F.instr(_of("alphabet", c["code"]), x)).alias("xs")))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)

    def sums(c: Column) -> Column:
        squares = F.aggregate(F.split(_of("alphabet", c["code"]), ""), F.lit(0.0), lambda a, x: a + F.pow(F.length(c["s"]) - F.length(F.replace(c["s"], x, F.lit(""))), F.lit(2)))
        runs = F.regexp_count(F.concat(*[F.when(c["code"] == i, F.translate(c["s"], e["alphabet"], e["marks"])).otherwise("") for i, e in enumerate(encodings())]), F.lit("l+|u+|d+|o+|v+|c+"))
        pairs = F.zip_with(F.slice(c["xs"], 1, F.size(c["xs"]) - 1), F.slice(c["xs"], 2, F.size(c["xs"]) - 1), lambda a, b: a * b)
        ends = F.get(c["xs"], F.lit(0)) + F.element_at(c["xs"], -1)
        return F.struct(*keep(c, "start", "end", "code", "n"), F.md5(c["s"]).alias("id"), squares.alias("squares"), (runs - 1).alias("changes"), total(c["xs"]).alias("x"), total(F.transform(c["xs"], lambda v: v * v)).alias("xx"), total(pairs).alias("xy"), ends.alias("ends"))

    def scores(c: Column) -> Column:
        n, size, s2, s3, c2, c3, rate = c["n"], *[_of(f, c["code"]) for f in ("size", "s2", "s3", "c2", "c3", "rate")]
        chi = size * c["squares"] / n - n
        mean = c["x"] / n
        spread = c["xx"] - n * mean * mean
        # The products of neighbours' deviations: the ends stand in one product only.
        serial = F.when(spread > 1e-9, (c["xy"] - mean * (2 * c["x"] - c["ends"]) + (n - 1) * mean * mean) / spread)
        chi_random = (chi - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n)
        run_random = (c["changes"] - (n - 1) * (1 - c2)) / F.sqrt((n - 1) * (c2 - c2 * c2) + 2 * (n - 2) * (c3 - c2 * c2))
        serial_random = (serial + 1 / n) * F.sqrt(n)
        pairs_var = n * (n - 1) / 2 * (s2 - s2 * s2) + n * (n - 1) * (n - 2) * (s3 - s2 * s2)
        chi_ordinary = (chi - (size * (1 + (n - 1) * s2) - n)) / (2 * size / n * F.sqrt(pairs_var))
        run_ordinary = (c["changes"] - (n - 1) * rate) / F.sqrt((n - 1) * rate * (1 - rate))
        random = F.coalesce((F.abs(chi_random) <= BATTERY) & (F.abs(run_random) <= BATTERY) & (F.abs(serial_random) <= BATTERY), F.lit(False))
        far = (_of("sign", c["code"]) * run_ordinary - chi_ordinary) / math.sqrt(2)
        band = F.coalesce(*[F.when(n >= b, F.lit(i)) for i, b in reversed(list(enumerate(BANDS)))])
        return F.struct(*keep(c, "start", "end", "id"), _of("kind", c["code"]).alias("kind"), band.alias("band"), F.when(random, far).otherwise(-1.0).alias("z"))

    tested = F.transform(F.transform(laid, sums), scores)
    return F.transform(tested, lambda c: F.struct(*keep(c, "start", "end", "kind", "band", "id"), tail_bin(c["z"]).alias("bin")))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, assign, access, hex: array<struct<start, end>>, and candidates as ``measured`` gives them."""
    # A run of at least so many is what is left of the runs when shorter ones are dropped; group 2 of the first is measured afterwards.
    patterns = [(BASE[0][0], BASE[0][1], 2), ("access", r"AKIA[A-Z0-9]{16,}", 0), ("hex", r"[0-9a-f]{24,}", 0), ("candidates", CANDIDATE, 0)]
    found = spans(docs, patterns)
    long_enough = lambda kind, n: F.transform(F.filter(kind, lambda s: F.length(s["s"]) >= n), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(kind)
    return found.select("doc_id", *[long_enough(kind, n if kind == "assign" else 0) for kind, _, _, n in BASE], measured(F.col("candidates")).alias("candidates"))


def thresholds(detected: DataFrame, fdr: float = FDR) -> DataFrame:
    """kind, band, least: the least bin that is a discovery, for strata that have any."""
    each = detected.select(F.explode("candidates").alias("c")).select("c.kind", "c.band", "c.bin", "c.id")
    bins = each.distinct().groupBy("kind", "band", "bin").agg(F.count("*").alias("n"))
    stratum = W.partitionBy("kind", "band")
    ranked = bins.withColumn("m", F.sum("n").over(stratum)).withColumn("k", F.sum("n").over(stratum.orderBy(F.desc("bin"))))
    return ranked.filter(F.pow(F.lit(10.0), -F.col("bin") / 100) * F.col("m") <= fdr * F.col("k")).groupBy("kind", "band").agg(F.min("bin").alias("least"))


def find_secrets(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id, findings: array<struct<start, rank, kind, end>>, by start and then kind as listed."""
    detected = written(detect(docs), "secrets")
    least = {(r["kind"], r["band"]): r["least"] for r in thresholds(detected, fdr).collect()}  # at most a row for each of 30 strata

    def secret(c: Column) -> Column:
        return F.coalesce(*[F.when((c["kind"] == k) & (c["band"] == b), c["bin"] >= n) for (k, b), n in sorted(least.items())], F.lit(False))

    finding = lambda s, rank, kind: F.struct(s["start"].alias("start"), rank.cast("int").alias("rank"), kind.alias("kind"), s["end"].alias("end"))
    plain = lambda i, kind: F.transform(kind, lambda s: finding(s, F.lit(i), F.lit(kind)))
    base = [plain(i, kind) for i, (kind, *_) in enumerate(BASE)]
    rank = lambda c: F.array_position(F.array(*[F.lit(k) for k in KINDS]), c["kind"]) + len(BASE)
    method = F.transform(F.filter("candidates", secret), lambda c: finding(c, rank(c), F.concat(F.lit("random-"), c["kind"])))
    return detected.select("doc_id", F.array_sort(F.concat(*base, method)).alias("findings"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    text = lambda fs: F.array_join(F.transform(fs, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
    ranked = lambda i: F.filter("findings", lambda f: f["rank"] == i)
    counts = [F.size(ranked(i)).cast("long").alias(f"n_{kind}") for i, (kind, *_) in enumerate(BASE)]
    base = F.filter("findings", lambda f: f["rank"] < len(BASE))
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("findings")).alias("spans"))


QUERIES = {"op11_secret_scan": op11_secret_scan}
