"""License scans with ordered signature rules, with Spark expressions only.

A text is lower-cased (A-Z) and reduced to its words, joined by single spaces. Rules are regexes over that form. A rule is
tried only where a word of the text starts with its keyword, as one does in all that the rule matches (``gpl2`` has gpl), and no
rule is tried in a text without any keyword. Detections
are sorted; one that lies within the interval of another of the same or a higher priority is suppressed. The base phrases have
the highest priority and are never suppressed.

Defined cases: a null or empty text has no words and no detections, its score is 0; repeated rows are scanned one by one;
an empty table gives no rows; other columns are ignored. Everything happens within a row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, running, table

#: One word, before and after lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: phrase, label, keyword.
BASE = [
    ("under the mit license", "mit", "mit"),
    ("apache license version 2", "apache-2", "apache"),
    ("cc by nc", "cc-by-nc", "cc"),
]
#: Licence families: label, keyword, name as a regex over normalised words.
FAMILIES = [
    ("mit", "mit", "(?:mit|mit x11)"), ("mit", "expat", "expat"), ("x11", "x11", "x11"), ("isc", "isc", "isc"),
    ("apache-1.1", "apache", "apache(?: software)? 1 1"), ("apache-2", "apache", "apache(?: software)?(?: 2(?: 0)?)?"),
    ("bsd-2-clause", "bsd", "(?:simplified bsd|bsd 2 clause)"), ("bsd-2-clause", "freebsd", "freebsd"), ("bsd-3-clause", "bsd", "(?:new bsd|modified bsd|bsd 3 clause)"),
    ("bsd-4-clause", "bsd", "(?:original bsd|bsd 4 clause)"), ("bsd", "bsd", "(?:bsd|bsd style)"), ("0bsd", "0bsd", "0bsd"),
    ("gpl-1", "gpl", "(?:gnu )?gpl ?v?1"), ("gpl-2", "gpl", "(?:gnu )?gpl(?: v| version)? ?2(?: 0)?"), ("gpl-2", "gplv2", "(?:gnu )?gplv2(?: 0)?"),
    ("gpl-3", "gpl", "(?:gnu )?gpl(?: v| version)? ?3(?: 0)?"), ("gpl-3", "gplv3", "(?:gnu )?gplv3(?: 0)?"), ("gpl", "gpl", "(?:gnu )?gpl"), ("gpl", "gnu", "gnu general public"),
    ("lgpl-2.1", "lgpl", "(?:gnu )?lgpl(?: v| version)? ?2 1"), ("lgpl-3", "lgpl", "(?:gnu )?lgpl(?: v| version)? ?3(?: 0)?"), ("lgpl-2.1", "lgplv2", "(?:gnu )?lgplv2 1"), ("lgpl-2", "lgpl", "(?:gnu )?lgpl(?: v| version)? ?2(?: 0)?"), ("lgpl-2", "lgplv2", "(?:gnu )?lgplv2(?: 0)?"), ("lgpl-3", "lgplv3", "(?:gnu )?lgplv3(?: 0)?"), ("lgpl", "lgpl", "(?:gnu )?lgpl"),
    ("lgpl", "lesser", "gnu lesser general public"), ("lgpl", "library", "gnu library general public"), ("agpl-3", "agpl", "(?:gnu )?agpl(?: v| version)? ?3(?: 0)?"), ("agpl-3", "agplv3", "(?:gnu )?agplv3(?: 0)?"), ("agpl-3", "affero", "gnu affero general public"),
    ("mpl-1.1", "mpl", "mpl 1 1"), ("mpl-2", "mpl", "mpl(?: 2(?: 0)?)?"), ("mpl-2", "mozilla", "mozilla public"), ("epl-1", "epl", "epl 1 0"), ("epl-2", "epl", "epl 2 0"),
    ("epl", "eclipse", "eclipse public"), ("cddl-1", "cddl", "cddl(?: 1(?: 0)?)?"), ("cpl-1", "cpl", "cpl(?: 1 0)?"), ("eupl", "eupl", "eupl(?: 1 [0-9])?"),
    ("artistic-2", "artistic", "artistic(?: 2 0)?"), ("zlib", "zlib", "zlib(?: libpng)?"), ("libpng", "libpng", "libpng"), ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"), ("bsl-1", "boost", "boost software"), ("python-2", "psf", "psf"), ("ruby", "ruby", "ruby"), ("php-3", "php", "php"), ("openssl", "openssl", "openssl"),
    ("postgresql", "postgresql", "postgresql"), ("ofl-1.1", "ofl", "ofl(?: 1 1)?"), ("ofl-1.1", "sil", "sil open font"), ("odbl", "odbl", "odbl"), ("odbl", "odc", "odc open database"),
    ("upl-1", "upl", "upl"), ("ms-pl", "microsoft", "microsoft public"), ("busl-1.1", "busl", "busl 1 1"), ("busl-1.1", "business", "business source"), ("elastic-2", "elastic", "elastic(?: 2 0)?"),
]
#: Ways to name a licence: regex around the name, priority, confidence.
FORMS = [
    ("spdx license identifier {n}(?: only| or later)?", 1, 0.99),
    ("licen[cs]ed under (?:the |a )?(?:terms of the )?{n}(?: licen[cs]e)?(?: v| version)?(?: [0-9]+)*", 2, 0.95),
    ("under (?:the |a )?(?:terms of the )?{n} licen[cs]e", 2, 0.95),
    ("(?:released|distributed|available|published|provided) under (?:the |a )?{n}", 3, 0.9),
    ("{n} licen[cs]e(?: v| version)?(?: [0-9]+)*", 4, 0.8),
]
#: Creative Commons variants; texts of licences and notices: label, keyword, regex, priority, confidence.
CC = ["by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd"]
TEXTS = [
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software", 1, 0.98),
    ("isc", "permission", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", 1, 0.98),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", 1, 0.95),
    ("zlib", "altered", "altered source versions must be plainly marked as such", 1, 0.9),
    ("gpl", "foundation", "gnu general public license as published by the free software foundation", 1, 0.95),
    ("lgpl", "foundation", "gnu lesser general public license as published by the free software foundation", 1, 0.95),
    ("apache-2", "apache", "apache org licenses license 2 0", 1, 0.95),
    ("unlicense", "unencumbered", "free and unencumbered software released into the public domain", 1, 0.98),
    ("bsl-1", "boost", "boost software license version 1 0", 1, 0.98),
    ("cc0-1", "cc0", "cc0(?: 1 0)?(?: universal)?", 2, 0.95),
    ("public-domain", "domain", "(?:dedicated to|in|into|released to) the public domain", 3, 0.7),
    ("all-rights-reserved", "reserved", "all rights reserved", 4, 0.6),
    ("copyleft", "copyleft", "copyleft", 5, 0.4),
    ("license-mention", "license", "(?:see|read) (?:the )?license(?: file)?(?: for details)?", 5, 0.3),
]
PRIORITIES = 6


def signature_rules() -> list[tuple[str, str, str, int, float]]:
    """label, keyword, regex, priority (0 first), confidence: the base phrases, then every form of every family."""
    rules = [(label, key, phrase, 0, 1.0) for phrase, label, key in BASE]
    rules += [(label, key, form.format(n=name), p, c) for label, key, name in FAMILIES for form, p, c in FORMS]
    for v in CC:
        rules += [(f"cc-{v.replace(' ', '-')}", "cc", f"cc {v}(?: [1-4] 0)?", 3, 0.9)]
    rules += [("cc-" + "-".join(w), "commons", "creative commons attribution" + "".join({"nc": " non ?commercial", "sa": " share ?alike", "nd": " no ?derivatives?"}[x] for x in w[1:]) + "(?: [1-4] 0)?", 3, 0.9) for w in (v.split() for v in CC)]
    return rules + TEXTS


def _rule_literals() -> Column:
    return F.array(*[F.struct(F.lit(label).alias("label"), F.lit(key).alias("key"), F.lit(f"(?<= )(?:{rx})(?= )").alias("rx"), F.lit(p).alias("p"), F.lit(c).alias("c"), F.lit(i).alias("rule")) for i, (label, key, rx, p, c) in enumerate(signature_rules())])


def scan(docs: DataFrame) -> DataFrame:
    """Adds n_words and detections: array<struct<start, end, p, rule, label, c>>, sorted, in words from 0, end exclusive."""
    keys = sorted({r[1] for r in signature_rules()})
    text = F.coalesce("text", F.lit(""))
    names = [*docs.columns, "n_words", "detections"]
    gate = F.regexp_like(text, F.lit(r"(?i)(?:" + "|".join(k for k in keys if not any(o != k and o in k for o in keys)) + ")"))
    lower = F.array_remove(F.split(ascii_lower(text), NO_WORD), "")
    gated = docs.withColumn("n_words", F.regexp_count(text, F.lit(WORD)).cast("long")).withColumn("_words", F.when(gate, lower))
    normal = gated.withColumn("_all", F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" "))).withColumn("_keys", F.filter(F.array(*[F.lit(k) for k in keys]), lambda k: F.contains("_all", F.concat(F.lit(" "), k)))).withColumn("_norm", F.when(F.size("_keys") > 0, F.col("_all"))).drop("_words", "_all")
    ruled = normal.withColumn("_rules", F.when(F.col("_norm").isNotNull(), F.filter(_rule_literals(), lambda r: F.array_contains("_keys", r["key"]) & F.regexp_like("_norm", r["rx"]))))

    def spans(r: Column) -> Column:
        # The first word of each match is marked in front and the last one behind, so that positions need no prefix sums.
        marked = F.split(F.trim(F.regexp_replace("_norm", r["rx"], F.lit("\x01$0\x02"))), " ")
        at = lambda hit: F.filter(F.transform(marked, lambda w, i: F.when(hit(w), i)), lambda i: i.isNotNull())
        span = lambda a, b: F.struct(a.alias("start"), (-(b + 1)).alias("neg_end"), r["p"].alias("p"), r["rule"].alias("rule"), r["label"].alias("label"), r["c"].alias("c"))
        return F.zip_with(at(lambda w: F.startswith(w, F.lit("\x01"))), at(lambda w: F.endswith(w, F.lit("\x02"))), span)

    found = ruled.withColumn("_found", F.array_sort(F.flatten(F.transform("_rules", spans))))
    # upto[p]: how far the detections of priority p and better that came before reach.
    zero = F.array_repeat(F.lit(-1), PRIORITIES)
    reach = lambda upto, d: F.transform(upto, lambda u, i: F.when(i >= d["p"], F.greatest(u, -d["neg_end"])).otherwise(u))
    upto = running(F.col("_found"), zero, reach, lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y)))
    found = found.withColumn("_upto", upto)
    inside = lambda d, i: (F.get(F.get("_upto", i), d["p"]) >= -d["neg_end"]) & (d["p"] > 0)
    kept = F.filter("_found", lambda d, i: ~inside(d, i))
    tidy = F.transform(kept, lambda d: F.struct(d["start"].alias("start"), (-d["neg_end"]).alias("end"), d["p"].alias("p"), d["rule"].alias("rule"), d["label"].alias("label"), d["c"].alias("c")))
    return found.withColumn("detections", F.coalesce(tidy, F.expr("cast(array() as array<struct<start:int,end:int,p:int,rule:int,label:string,c:double>>)"))).select(*names)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("detections", lambda d: d["rule"] < len(BASE))
    label = lambda ds: F.array_join(F.array_sort(F.array_distinct(F.transform(ds, lambda d: d["label"]))), ",")
    return found.withColumn("base", base).select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda d: d["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda d: d["start"])).cast("long").alias("last_word"),
        label(F.col("base")).alias("base_labels"),
        label(F.col("detections")).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["c"])), F.lit(0.0)).alias("score"),
    )


QUERIES = {"op7_license_scan": op7_license_scan}
