"""Code files to chunks by declarations, with their imports and exports.

``code_lines`` reads a file's characters with a stack of what is open (strings, templates with code in them, comments, regexes, brackets)
and gives each line's depth and its code without comments. All else is Spark over these lines: a statement that starts at a depth is
a unit of that depth, with the comments right above it; small neighbours go together, classes and namespaces that are too large are
taken apart into their members, and what is still too large is cut into windows of lines. The languages are those of the
JavaScript family. Brackets that never close leave the rest of a file in one unit; closing ones that nothing opened are passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.tables import checkpointed, table

#: Characters of a chunk and of what is merged, lines that windows share.
CHUNK, MERGE, OVERLAP = 4096, 500, 2
TOKEN = re.compile(r"\\.|//|/\*|\*/|\$\{|[`'\"(){}\[\]\n/]|[A-Za-z0-9_$]+|[^\S\n]+|.", re.S)
PAIRS = {")": "(", "]": "[", "}": "{"}
#: What goes on within a comment, a template and a string up to their next mark or line, token by token as TOKEN cuts it.
INSIDE = {
    "//": re.compile(r"[^\\\n]*+(?:\\[^\n][^\\\n]*+)*+"),
    "/*": re.compile(r"(?:[^\\\n*/]++|\*(?!/)|/[/*]?|\\[^\n])*+"),
    "`": re.compile(r"(?:[A-Za-z0-9_][A-Za-z0-9_$]*+|\$(?!\{)[A-Za-z0-9_$]*+|[^\\\n`$A-Za-z0-9_]++|\\[^\n])*+"),
    "'": re.compile(r"[^\\\n']*+(?:\\[^\n][^\\\n']*+)*+"),
    '"': re.compile(r'[^\\\n"]*+(?:\\[^\n][^\\\n"]*+)*+'),
}
#: Lines that a task gathers before it gives them on.
HELD_LINES = 20_000
#: Words after which a slash begins a regex.
BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield", "instanceof"}
HIDDEN = str.maketrans("\"'`; \t{}()", "\x03" * 10)


def lex(text: str) -> list[tuple[int, str, bool]]:
    """(depth, code, comment) of each line: brackets open at its start, -1 within a literal or comment; strings stay as one word in double quotes."""
    stack: list[str] = []
    out, code, depth, comment, operand = [], [], 0, False, False
    text += "\n"
    at = 0
    while at < len(text):
        top = stack[-1] if stack else ""
        if (inside := INSIDE.get(top)) and (end := inside.match(text, at).end()) > at:
            if top in ("'", '"'):
                code.append(text[at:end].translate(HIDDEN))
            at = end
        t = TOKEN.match(text, at)[0]
        at += len(t)
        if t == "\n" or t == "\\\n":
            if t == "\n":
                while stack and stack[-1] in ("'", '"', "//", "/", "[/"):
                    stack.pop()
            out.append((depth, "".join(code), comment))
            top = stack[-1] if stack else ""
            code, comment = [], top == "/*"
            depth = -1 if top in ("'", '"', "`", "/*") else len(stack)
        elif top == "//" or top == "/*":
            if t == "*/" and top == "/*":
                stack.pop()
        elif top in ("'", '"', "`"):
            if t == top:
                stack.pop()
                code.append('"')
                operand = True
            elif top == "`" and t == "${":
                stack.append("${")
                operand = False
            elif top != "`":
                code.append(t.translate(HIDDEN))
        elif top == "/" or top == "[/":
            if t == ("/" if top == "/" else "]"):
                stack.pop()
                operand = True
            elif t == "[" and top == "/":
                stack.append("[/")
        elif t in ("//", "/*"):
            stack.append(t)
            comment = True
        elif t in ("'", '"', "`"):
            stack.append(t)
            code.append('"')
        elif t == "/" and not operand:
            stack.append("/")
            code.append("0")
        else:
            if t in "([{" or t == "${":
                stack.append("{" if t == "${" else t)
            elif t in PAIRS and (top == PAIRS[t] or t == "}" and top == "${"):
                stack.pop()
                if top == "${":
                    operand = True
                    continue
            code.append(t)
            if t.strip():
                operand = t in ")]}" or (bool(re.match(r"[A-Za-z0-9_$]", t)) and t not in BEFORE_REGEX)
    return out


def code_lines(files: DataFrame) -> DataFrame:
    """file, text -> file, line (from 1), text, depth, code, comment. A null text has no line."""
    kind = files.schema["file"].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, text in zip(batch["file"], batch["text"]):
                if isinstance(text, str):
                    lines = text.split("\n")
                    rows = lex(text)[: len(lines)]
                    yield pd.DataFrame({"file": [file] * len(lines), "line": range(1, len(lines) + 1), "text": lines, "depth": [r[0] for r in rows], "code": [r[1] for r in rows], "comment": [r[2] for r in rows]})

    return files.select("file", "text").mapInPandas(read, f"file {kind}, line int, text string, depth int, code string, comment boolean")


def code_statements(files: DataFrame) -> DataFrame:
    """file, text -> file, line, depth, code, above of the lines that have code; above: the line before the comments right above it.

    The lines of a file are read in one place, so only those that ``units`` keeps leave the task, without their texts.
    """
    kind = files.schema["file"].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        framed = lambda: pd.DataFrame(rows, columns=["file", "line", "depth", "code", "above"])
        for batch in batches:
            for file, text in zip(batch["file"], batch["text"]):
                above = 0
                for line, (depth, code, comment) in enumerate(lex(text) if isinstance(text, str) else (), 1):
                    if code.strip(" "):
                        rows.append((file, line, depth, code, above))
                        above = line
                    elif not comment:
                        above = line
                if len(rows) >= HELD_LINES:
                    yield framed()
                    rows.clear()
        if rows:
            yield framed()

    return files.select("file", "text").mapInPandas(read, f"file {kind}, line int, depth int, code string, above int")


MODIFIERS = r"(?:(?:declare|abstract|async|public|private|protected|static|readonly|override|get|set|export|default)\s+)*"
DECLARES = rf"^\s*{MODIFIERS}(function|class|interface|type|enum|const|let|var|namespace|module)\b\s*\*?\s*([A-Za-z_$][\w$]*)?"
#: A line that goes on with the statement before it, and an end after which a statement goes on.
GOES_ON, OPEN_END = r"^\s*(?:[.?:+*/=,)\]}&|<>%^]|=>|-[^-]|in\b|instanceof\b|else\b|catch\b|finally\b|from\b|as\b|extends\b|implements\b|while\s*\(.*\)\s*;?\s*$)", r"(?:[=+*/,(\[&|?:<>%^.-]|=>)\s*$"


def units(lines: DataFrame, level: int, by: list[str]) -> DataFrame:
    """The statements that start at a depth: by, start, end, kind, name, exported, code. ``by`` keeps the bodies of classes apart.

    lines: of ``code_lines``, or of ``code_statements``, which know what is above them.
    """
    order = W.partitionBy(*by).orderBy("line")
    bare = F.trim("code")
    blank_or_note = (bare == "") & F.col("comment")
    body = lines if "above" in lines.columns else lines.withColumn("above", F.coalesce(F.max(F.when(~blank_or_note, F.col("line"))).over(order.rowsBetween(W.unboundedPreceding, -1)), F.min("line").over(order) - 1)).filter(bare != "")
    before = F.lag("code").over(order)
    keyword = F.regexp_like("code", F.lit(r"^\s*(?:import|export|function|class|interface|type|enum|const|let|var|namespace|abstract|declare|async)\b(?!\s*[.(=:?,)])"))
    goes_on = F.regexp_like("code", F.lit(GOES_ON)) | (F.regexp_like(F.coalesce(before, F.lit("")), F.lit(OPEN_END)) & ~keyword)
    starts = (F.col("depth") == level) & (before.isNull() | keyword | ~goes_on)
    numbered = body.withColumn("starts", starts).withColumn("unit", F.sum(F.col("starts").cast("int")).over(order)).filter("unit > 0")
    first = lambda c: F.max(F.when(F.col("starts"), c))
    whole = numbered.groupBy(*by, "unit").agg(first(F.col("above") + 1).alias("start"), F.max("line").alias("end"), first(F.col("code")).alias("head"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "code"))), lambda x: x["code"]), "\n").alias("code"))
    kind = F.regexp_extract("head", DECLARES, 1)
    named = F.regexp_extract("head", DECLARES, 2)
    member = F.regexp_extract("head", rf"^\s*{MODIFIERS}\*?#?([A-Za-z_$][\w$]*)\s*[(=:;?<]", 1)
    kind = F.when(F.regexp_like("head", F.lit(r"^\s*import\b(?!\s*[.(])")), "import").when(F.regexp_like("head", F.lit(r"^\s*export\s*(?:type\s*)?[*{]")), "reexport").when(kind != "", F.replace(kind, F.lit("module"), F.lit("namespace"))).when(F.lit(level > 0) & (member != ""), "member").otherwise("region")
    return whole.select(*by, "start", "end", kind.alias("kind"), F.when(kind == "member", member).otherwise(named).alias("name"), F.regexp_like("head", F.lit(r"^\s*export\b")).alias("exported"), "code")


def _cut(sizes: list[int]) -> list[tuple[int, int, int]]:
    """Windows (first line, last line, offset or -1) over the sizes of lines: as many lines as fit, two of them again in the next."""
    out, at = [], 0
    while at < len(sizes):
        if sizes[at] > CHUNK:
            out += [(at, at, o) for o in range(0, sizes[at] - 1, CHUNK)]
            at += 1
            continue
        end, held = at, 0
        while end < len(sizes) and held + sizes[end] <= CHUNK:
            held += sizes[end]
            end += 1
        out.append((at, end - 1, -1))
        if end >= len(sizes):
            break
        at = max(at + 1, end - OVERLAP)
    return out


def _windows(start: Column, end: Column, sizes: Column) -> Column:
    @F.pandas_udf("array<struct<a: int, z: int, offset: int>>")
    def cut(starts: pd.Series, ends: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([[{"a": int(a) + x, "z": int(a) + y, "offset": o} for x, y, o in _cut([int(n) for n in s[int(a) - 1 : int(z)]])] for a, z, s in zip(starts, ends, sizes)])

    return cut(start, end, sizes)


def _packed(rows: DataFrame) -> DataFrame:
    """file, parent, units, ends -> one row per chunk: first, last (units), small ones that fit together as one."""
    span = lambda a, z: F.get("ends", z) - F.get("ends", a - 1)
    none = F.expr("cast(array() as array<struct<start:int,end:int,kind:string,names:array<string>,exported:boolean,open:boolean>>)")

    def step(out: Column, u: Column) -> Column:
        small = span(u["start"], u["end"]) <= MERGE
        last = F.try_element_at(out, F.lit(-1))
        joins = small & F.coalesce(last["open"] & (span(last["start"], u["end"]) <= CHUNK), F.lit(False))
        one = lambda s, k, n, e: F.struct(s.alias("start"), u["end"].alias("end"), k.alias("kind"), n.alias("names"), e.alias("exported"), small.alias("open"))
        names = F.filter(F.array(u["name"]), lambda n: n != "")
        alone = F.array_append(out, one(u["start"], u["kind"], names, u["exported"]))
        merged = F.array_append(F.slice(out, 1, F.size(out) - 1), one(last["start"], F.lit("region"), F.concat(last["names"], names), last["exported"] | u["exported"]))
        return F.when(joins, merged).otherwise(alone)

    return rows.withColumn("c", F.explode(F.aggregate("units", none, step))).select("file", "parent", "c.*", "ends", "sizes")


def _listed(found: DataFrame, files: DataFrame) -> DataFrame:
    each = found.groupBy("file", "parent").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind", "name", "exported"))).alias("units"))
    return _packed(each.join(files, "file"))


def code_chunks(files: DataFrame) -> DataFrame:
    """file, text -> file, start_line, end_line, part, kind, symbols, parent, exported, text; files are unique and not null.

    Imports are no chunks of their own, but a file of imports and re-exports alone is one, in windows.
    """
    lines = checkpointed(code_lines(files))
    sizes = F.transform(F.sort_array(F.collect_list(F.struct("line", (F.length("text") + 1).alias("n"), "text"))), lambda x: F.struct(x["n"].alias("n"), x["text"].alias("text")))
    whole = lines.groupBy("file").agg(sizes.alias("ls")).withColumn("sizes", F.col("ls.n")).withColumn("texts", F.col("ls.text"))
    # ends[i]: the characters of the first i lines.
    whole = whole.withColumn("ends", _running(F.col("sizes")))
    top = checkpointed(units(lines, 0, ["file"]).filter("kind <> 'import'").withColumn("parent", F.lit("")))
    bounds = whole.select("file", "ends", "sizes")
    level, chunks, inner = 1, None, top
    while True:
        packs = checkpointed(_listed(inner.select("file", "parent", "start", "end", "kind", "name", "exported"), bounds))
        over = (F.get("ends", F.col("end")) - F.get("ends", F.col("start") - 1) > CHUNK) & F.col("kind").isin("class", "namespace") & ~F.col("open")
        chunks = packs.filter(~over) if chunks is None else chunks.unionByName(packs.filter(~over))
        big = packs.filter(over).select("file", F.col("start").alias("a"), F.col("end").alias("z"), F.array_join(F.filter(F.array("parent", F.coalesce(F.get("names", F.lit(0)), F.lit(""))), lambda p: p != ""), ".").alias("parent"), "kind", "exported", "names", "ends", "sizes")
        within = lines.join(big.select("file", "a", "z", "parent"), "file").filter((F.col("line") > F.col("a")) & (F.col("line") <= F.col("z")) & (F.col("depth") != 0))
        inner = checkpointed(units(within, level, ["file", "parent", "a"]))
        opened = inner.groupBy("file", "a").agg(F.min("start").alias("first"))
        heads = big.join(opened, ["file", "a"], "left").select("file", F.lit("").alias("parent"), F.col("a").alias("start"), F.coalesce(F.col("first") - 1, "z").alias("end"), "kind", "names", "exported", F.lit(False).alias("open"), "ends", "sizes")
        chunks = chunks.unionByName(heads)
        if inner.isEmpty():
            break
        level += 1
    bare = whole.join(top.select("file").distinct(), "file", "left_anti").join(lines.filter(F.trim("text") != "").select("file").distinct(), "file", "left_semi")
    chunks = chunks.unionByName(bare.select("file", F.lit("").alias("parent"), F.lit(1).alias("start"), F.size("sizes").alias("end"), F.lit("reexport").alias("kind"), F.expr("cast(array() as array<string>)").alias("names"), F.lit(True).alias("exported"), F.lit(False).alias("open"), "ends", "sizes"))
    cut = chunks.withColumn("ws", _windows(F.col("start"), F.col("end"), F.col("sizes"))).select("file", "parent", "kind", "names", "exported", F.posexplode("ws").alias("part", "w"))
    slice_ = F.array_join(F.slice("texts", F.col("w.a"), F.col("w.z") - F.col("w.a") + 1), "\n")
    text = F.when(F.col("w.offset") < 0, F.regexp_replace(slice_, r"\s+$", "")).otherwise(F.substring(slice_, F.col("w.offset") + 1, F.lit(CHUNK)))
    laid = cut.join(whole.select("file", "texts"), "file").select("file", F.col("w.a").alias("start_line"), F.col("w.z").alias("end_line"), "part", "kind", F.col("names").alias("symbols"), "parent", "exported", text.alias("text"))
    return laid.filter(F.trim("text") != "")


def _running(xs: Column) -> Column:
    """0 and the running sums of an array."""
    return F.aggregate(xs, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x.cast("int")))


def module_edges(files: DataFrame) -> DataFrame:
    """file, text -> file, module: the distinct modules that a file imports or exports from, outside strings and comments."""
    found = units(code_statements(files), 0, ["file"]).filter("kind in ('import', 'reexport')")
    name = F.regexp_extract("code", r"(?s)(?:\bfrom|^\s*import)\s*\"([^\"\s]+)\"", 1)
    return found.select("file", name.alias("module")).filter("module <> ''").distinct()


def exported_symbols(files: DataFrame) -> DataFrame:
    """file, text -> file, name, kind, line of the declarations that a file exports."""
    found = units(code_statements(files), 0, ["file"]).filter("exported and kind not in ('reexport', 'region') and name <> ''")
    return found.select("file", "name", "kind", F.col("start").alias("line"))


# --- queries over the tables ---------------------------------------------------------------------------------------


def _code(spark: SparkSession, d: str) -> DataFrame:
    """Source files with the whole texts of the documents in comments, templates and strings, between imports and exports of their first words."""
    # The words are reached from the start of a text, which is not taken apart for them.
    word = lambda i: F.coalesce(F.nullif(F.regexp_extract("text", rf"^(?:[^A-Za-z]*+[A-Za-z]++){{{i}}}[^A-Za-z]*+([A-Za-z]++)", 1), F.lit("")), F.lit("x"))
    plain = F.translate(F.coalesce("text", F.lit("")), "`$\\*'", "     ")
    parts = ["import { a } from './", word(0), "';\n/* export const hidden = 1;\n", plain, " */\nimport \"side\";\nconst t = `export * from \"t\"\n", plain, "${ f({ a: '}' }) }`;\nexport async function f", word(1), "() {\n  // ", F.replace(plain, F.lit("\n"), F.lit("\n  // ")),
             "\n  return 'import \"no\" from \\'no\\'';\n}\n  export * from \"./", word(0), "\"\nexport const v", word(2), " = /[/'`]/g;\n"]
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return table(spark, d, "documents").select(F.col("doc_id").alias("file"), text.alias("text"))


def import_edges(spark: SparkSession, d: str) -> DataFrame:
    return module_edges(_code(spark, d))


def symbol_totals(spark: SparkSession, d: str) -> DataFrame:
    return exported_symbols(_code(spark, d)).groupBy("kind").agg(F.count("*").alias("symbols"), F.countDistinct("name").alias("names"), F.sum("file").alias("file_sum"))


def code_windows(spark: SparkSession, d: str) -> DataFrame:
    """Each document as the comment above a declaration, in chunks."""
    notes = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.concat(F.lit("// "), x)), "\n")
    files = table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.concat(notes, F.lit("\nexport const one = 1;\n")).alias("text"))
    return code_chunks(files).groupBy("file", "kind").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"), F.max("end_line").cast("long").alias("last_line"))


QUERIES = {"import_edges": import_edges, "symbol_totals": symbol_totals, "code_windows": code_windows}

_W = "w AS (SELECT doc_id AS file, coalesce(nullif(regexp_extract_all(text, '[A-Za-z]+')[{0}], ''), 'x') AS {1} FROM documents)"
ORACLE_SQL = {
    "import_edges": f"WITH {_W.format(1, 'a')} SELECT file, unnest(['./' || a, 'side']) AS module FROM w",
    "symbol_totals": "WITH w AS (SELECT doc_id AS file, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents) SELECT 'function' AS kind, count(*) AS symbols, count(DISTINCT 'f' || coalesce(w[2], 'x')) AS names, sum(file)::BIGINT AS file_sum FROM w UNION ALL SELECT 'const', count(*), count(DISTINCT 'v' || coalesce(w[3], 'x')), sum(file)::BIGINT FROM w",
    "code_windows": r"""WITH RECURSIVE f AS (SELECT doc_id AS file, list_concat(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: '// ' || x), ['export const one = 1;']) AS ls FROM documents),
l AS (SELECT file, i AS n, length(ls[i]) + 1 AS size, len(ls) AS lines FROM f, unnest(range(1, len(ls) + 1)) AS r(i)),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY file ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM l),
s AS (SELECT a.file, a.n AS a, a.lines, a.size, CASE WHEN a.size > 4096 THEN a.n ELSE (SELECT max(z.n) FROM p z WHERE z.file = a.file AND z.n >= a.n AND z.before + z.size - a.before <= 4096) END AS z FROM p a),
w AS (SELECT file, a, z, size, lines FROM s WHERE a = 1 UNION ALL
  SELECT s.file, s.a, s.z, s.size, s.lines FROM w JOIN s ON s.file = w.file AND s.a = CASE WHEN w.size > 4096 THEN w.a + 1 ELSE greatest(w.a + 1, w.z - 1) END WHERE w.size > 4096 OR w.z < w.lines),
t AS (SELECT w.file, w.z, CASE WHEN size > 4096 THEN list_transform(range(0, size - 1, 4096), lambda o: substr(ls[a], o + 1, 4096)) ELSE [regexp_replace(array_to_string(ls[a:z], chr(10)), '\s+$', '')] END AS xs FROM w JOIN f USING (file))
SELECT file, 'const' AS kind, count(*) AS chunks, sum(length(x))::BIGINT AS chars, max(z)::BIGINT AS last_line FROM (SELECT file, z, unnest(xs) AS x FROM t) WHERE trim(x) <> '' GROUP BY 1""",
}
