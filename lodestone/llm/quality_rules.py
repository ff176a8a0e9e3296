"""Quality rules at host level, with Spark expressions only.

Each document is measured by itself (words, symbols, repeated lines, repeated three-word windows). Failures of the host
rules are summed per source, their rates are shrunk with a beta prior that is fitted to all sources by moments, and a rule
is enforced at the sources whose shrunk rate is above ``max_rate``: there a failure is a habit of the host and not a
chance event. A document is rejected if it fails the base rule, or a host rule that its source has enforced on it. A
document that fails no rule is kept wherever it comes from.

Defined cases: a null text has no words and fails the base rule; null sources are one source; repeated rows count as they
stand; an empty table gives no rows; columns other than doc_id, text and source are carried by ``filter_quality`` and ignored
by ``measure``. Windows are compared by a 64-bit hash of their three words within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, join_bounded, table, words, written

#: Host rules: name -> a getter of metrics -> failed.
HOST_RULES = {
    "symbols": lambda m: m("n_symbols") > m("n_words") * 0.1,
    "duplicate_lines": lambda m: m("n_dup_lines") > m("n_lines") * 0.3,
    "word_length": lambda m: (m("word_chars") < m("n_words") * 3) | (m("word_chars") > m("n_words") * 10),
}
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it or the optimiser moves it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(positions: Column) -> Column:
    """Words under three-word windows at the sorted positions."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n"))
    return F.aggregate(positions, zero, step, lambda a: a["n"])


def _repeated(w: Column) -> Column:
    """Words in three-word windows found twice: windows are sorted by hash, so equal ones are neighbours."""
    window = lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p"))
    runs = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), window))

    def twice(r: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(r, i)["h"] == x["h"], F.lit(False))
        return F.transform(F.filter(r, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"])

    return F.when(F.size(w) >= 3, _let(runs, lambda r: _covered(F.sort_array(twice(r))))).otherwise(0)


def metrics(text: Column) -> Column:
    """The metrics of a text and n_lines, as a struct of longs."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    of_words = _let(words(text), lambda w: F.struct(F.size(w).alias("n"), _repeated(w).alias("r")))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    return _let(F.struct(of_words.alias("w"), of_lines.alias("l")), lambda m: F.struct(
        m["w"]["n"].cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        m["l"]["d"].cast("long").alias("n_dup_lines"),
        m["w"]["r"].cast("long").alias("n_repeat_words"),
        m["l"]["n"].cast("long").alias("n_lines"),
    ))


def base_rule(m) -> Column:
    return (m("n_words") < 50) | (m("n_repeat_words") * 100 > m("n_words") * 50)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and source with the metrics, n_lines and base_failed."""
    ids = [c for c in ("doc_id", "source") if c in docs.columns]
    return docs.select(*ids, metrics(F.col("text")).alias("_m")).select(*ids, "_m.*").withColumn("base_failed", base_rule(F.col))


def host_verdicts(measured: DataFrame, max_rate: float = 0.02) -> DataFrame:
    """One row per source: for each host rule its shrunk failure rate (rate_*) and whether it is enforced (enforce_*).

    The prior of a rule has the mean m of all documents and the variance v of the sources' rates:
    a = m*s, b = (1-m)*s with s = m*(1-m)/v - 1, kept within 1 and 10,000.
    """
    return _host_verdicts(measured, lambda k: HOST_RULES[k](F.col), max_rate)


def _host_verdicts(rows: DataFrame, failed, max_rate: float) -> DataFrame:
    fails = {f"fail_{k}": F.sum(failed(k).cast("long")) for k in HOST_RULES}
    hosts = rows.groupBy("source").agg(F.count("*").alias("n"), *[c.alias(k) for k, c in fails.items()])
    stats = []
    for k in HOST_RULES:
        rate = F.col(f"fail_{k}") / F.col("n")
        stats += [(F.sum(f"fail_{k}") / F.sum("n")).alias(f"m_{k}"), F.var_pop(rate).alias(f"v_{k}")]
    prior = hosts.agg(*stats)
    out = hosts.crossJoin(F.broadcast(prior))  # one row
    for k in HOST_RULES:
        m, v = F.col(f"m_{k}"), F.col(f"v_{k}")
        s = F.greatest(F.lit(1.0), F.least(F.lit(10_000.0), F.when(v > 0, m * (1 - m) / v - 1).otherwise(10_000.0)))
        rate = (F.col(f"fail_{k}") + m * s) / (F.col("n") + s)
        out = out.withColumn(f"rate_{k}", rate).withColumn(f"enforce_{k}", rate > max_rate)
    return out.select("source", "n", *[f"{p}_{k}" for k in HOST_RULES for p in ("rate", "enforce")])


def judge(measured: DataFrame, max_rate: float = 0.02) -> DataFrame:
    """Joins the verdicts of the hosts back to measured documents and adds ``kept``."""
    verdicts = host_verdicts(measured, max_rate).drop("n", *[f"rate_{k}" for k in HOST_RULES])
    judged = join_bounded(measured, verdicts, "source")
    rejected = F.lit(False)
    for k, rule in HOST_RULES.items():
        rejected = rejected | (rule(F.col) & F.col(f"enforce_{k}"))
    return judged.withColumn("kept", ~F.col("base_failed") & ~rejected).drop(*[f"enforce_{k}" for k in HOST_RULES])


def quality(docs: DataFrame, max_rate: float = 0.02) -> DataFrame:
    """doc_id, source, the metrics, base_failed and kept, one row per row of docs. Texts are measured once."""
    return judge(written(measure(docs), "quality"), max_rate)


def filter_quality(docs: DataFrame, max_rate: float = 0.02) -> DataFrame:
    """The rows of docs that are kept, with their columns.

    Texts are measured once: the rows that pass the base rule are written with the host rules that they fail, and a second
    pass reads those marks against the verdicts of the hosts. The failures of rejected rows count for their hosts too.
    """
    whole = F.struct(*[docs[c] for c in docs.columns])  # no name of a column can clash
    get = lambda c: F.col("m")[c]
    fails = [rule(get).alias(k) for k, rule in HOST_RULES.items()]
    base = base_rule(get)
    measured = docs.select(whole.alias("row"), docs["source"].alias("source"), metrics(docs["text"]).alias("m"))
    marked = written(measured.select(F.when(~base, F.col("row")).alias("row"), "source", F.struct(*fails).alias("fails")), "quality")
    verdicts = written(_host_verdicts(marked, lambda k: F.col("fails")[k], max_rate).drop("n", *[f"rate_{k}" for k in HOST_RULES]), "hosts")
    judged = join_bounded(marked.filter(F.col("row").isNotNull()), verdicts, "source")
    rejected = F.lit(False)
    for k in HOST_RULES:
        rejected = rejected | (F.col("fails")[k] & F.col(f"enforce_{k}"))
    return judged.filter(~rejected).select("row.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select("doc_id", *METRICS, "base_failed", "kept")


QUERIES = {"op3_quality_rules": op3_quality_rules}

#: The same metrics, rates and verdicts, with windows compared by their words.
ORACLE_SQL = {
    "op3_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
x AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d),
p AS (SELECT r, i, (w[i], w[i + 1], w[i + 2]) AS g FROM x, unnest(range(1, len(w) - 1)) AS u(i)),
c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM p) WHERE n >= 2),
k AS (SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM c, unnest([0, 1, 2]) AS v(o) GROUP BY r),
m AS (SELECT x.r, doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines
      FROM x LEFT JOIN k USING (r)),
f AS (SELECT *, n_symbols > n_words * 0.1::DOUBLE AS a, n_dup_lines > n_lines * 0.3::DOUBLE AS b, word_chars < n_words * 3 OR word_chars > n_words * 10 AS e FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (a) AS fa, count(*) FILTER (b) AS fb, count(*) FILTER (e) AS fe FROM f GROUP BY source),
q AS (SELECT sum(fa) / sum(n)::DOUBLE AS ma, var_pop(fa / n::DOUBLE) AS va, sum(fb) / sum(n)::DOUBLE AS mb, var_pop(fb / n::DOUBLE) AS vb, sum(fe) / sum(n)::DOUBLE AS me, var_pop(fe / n::DOUBLE) AS ve FROM h),
s AS (SELECT *, greatest(1, least(10000, CASE WHEN va > 0 THEN ma * (1 - ma) / va - 1 ELSE 10000 END)) AS sa, greatest(1, least(10000, CASE WHEN vb > 0 THEN mb * (1 - mb) / vb - 1 ELSE 10000 END)) AS sb,
        greatest(1, least(10000, CASE WHEN ve > 0 THEN me * (1 - me) / ve - 1 ELSE 10000 END)) AS se FROM q),
v AS (SELECT source, (fa + ma * sa) / (n + sa) > 0.02 AS ea, (fb + mb * sb) / (n + sb) > 0.02 AS eb, (fe + me * se) / (n + se) > 0.02 AS ee FROM h, s),
o AS (SELECT f.*, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed, a AND ea OR b AND eb OR e AND ee AS rejected FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM o"""
}
