"""Code chunks, imports and exports: what strings, comments, templates and brackets may hide, and sizes against brute force."""

import random

import pytest

from lodestone.operators import code

SOURCE = '''// header
import { a,
  b } from './ab'
import "side";
import def from "pkg"; // import x from 'no'
/** doc of f
 * more */
export async function f(x) {
  const s = "import y from 'z'"
  return `t ${ g({a: "}"}, `in ${ x }`) } import q from 'w'
export const no = 1`
}
const re = /["'`{]/g, n = 4 / 2 / 1
  .toString()
export const one = 1
export * from './star'
export { a } from "./re"
/* export const gone = 2
import "gone" */
import("./lazy")

// note

export default class Big {
  x = 1
''' + "\n".join(f'  /** m{i} */\n  method{i}(a) {{\n    return "{"y" * 300}"\n  }}\n' for i in range(16)) + '''
}
type T = { a: string }
foo(1)
'''
FILES = {
    "a.ts": SOURCE, "b.ts": "import 'x'\nexport * from 'y'\n", "c.ts": "   \n", "d.ts": None, "e.ts": "const big = [\n" + "  'abc',\n" * 900 + "]\n", "f.ts": "let m='" + "z" * 9000 + "'",
    "g.ts": "import 'only'\nimport q from \"two\"\n", "h.ts": "function open() {\n  if (x) {\nexport const inside = 1\n", "i.ts": "}\n)\nexport const after = 1\n", "j.ts": "", "k.ts": "'never closed\nexport let ok = 1\n",
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(list(FILES.items()), "file string, text string")


def test_imports_and_exports(files):
    got = {(r["file"], r["module"]) for r in code.module_edges(files).collect()}
    assert got == {("a.ts", m) for m in ("./ab", "side", "pkg", "./star", "./re")} | {("b.ts", "x"), ("b.ts", "y"), ("g.ts", "only"), ("g.ts", "two")}
    out = {(r["file"], r["name"], r["kind"]) for r in code.exported_symbols(files).collect()}
    assert out == {("a.ts", "f", "function"), ("a.ts", "one", "const"), ("a.ts", "Big", "class"), ("i.ts", "after", "const"), ("k.ts", "ok", "let")}


def test_chunks(files):
    rows = sorted(map(tuple, code.code_chunks(files).select("file", "start_line", "part", "end_line", "kind", "parent", "exported", "symbols", "text").collect()))
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r[1:])
    assert set(by) == {"a.ts", "b.ts", "e.ts", "f.ts", "g.ts", "h.ts", "i.ts", "k.ts"}
    assert all(len(r[-1]) <= code.CHUNK for r in rows)
    lines = SOURCE.split("\n")
    assert by["a.ts"][0][:6] == (6, 0, 20, "region", "", True) and by["a.ts"][0][6] == ["f", "re", "one"]
    head = by["a.ts"][1]
    assert lines[head[0] - 1] == "export default class Big {" and head[3] == "class" and head[6] == ["Big"]
    inner = [r for r in by["a.ts"] if r[4] == "Big"]
    assert [n for r in inner for n in r[6]] == ["x", *(f"method{i}" for i in range(16))] and len(inner) == 2
    assert all(r[-1] == "\n".join(lines[r[0] - 1 : r[2]]).rstrip() for r in by["a.ts"])
    assert [(r[0], r[2]) for r in by["e.ts"]] == [(1, 454), (453, 902)]
    assert "".join(r[-1] for r in by["f.ts"]) == FILES["f.ts"] and [r[1] for r in by["f.ts"]] == [0, 1, 2]
    assert by["g.ts"][0][3] == "reexport" and by["h.ts"][0][6] == ["open"]


def test_windows_hold_every_line():
    for seed in range(200):
        r = random.Random(seed)
        sizes = [r.choice([1, 30, 900, 2000, 4096, 4097, 9000]) for _ in range(r.randrange(1, 30))]
        cut = code._cut(sizes)
        assert {i for a, z, _ in cut for i in range(a, z + 1)} == set(range(len(sizes)))
        assert all(o >= 0 or sum(sizes[a : z + 1]) <= code.CHUNK for a, z, o in cut)
        for (a, z, o), (b, y, p) in zip(cut, cut[1:]):
            if o < 0 and p < 0:
                assert b == max(a + 1, z - 1) and sum(sizes[a : z + 2]) > code.CHUNK


def test_lexer_depths():
    rows = code.lex("a({\n`x ${ {\n} } y\nz`})\n// (\n/* (\n( */ b\n'(\n)\nreturn /(/\nx / (1)\n")
    assert [d for d, *_ in rows] == [0, 2, 5, -1, 0, 0, -1, 0, 0, 0, 0, 0]


def test_empty(spark, files):
    assert code.code_chunks(files.limit(0)).count() == 0 and code.module_edges(files.limit(0)).count() == 0


def test_statements_of_a_task_equal_those_of_all_lines(spark):
    rng = random.Random(11)
    bits = ["\\", "`", "'", '"', "(", ")", "{", "}", "\n", "\n", "//", "/*", "*/", "/", "${", "$", " ", "\t", "a1", "import x from 'y';\n", "export const b = 1;\n", "\\\n"]
    files = spark.createDataFrame([(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))) for i in range(200)], "file long, text string")
    found = code.code_statements(files).persist()
    assert "text" not in found.columns and found.filter("trim(code) = ''").isEmpty()
    rows = lambda lines: sorted(map(tuple, code.units(lines, 0, ["file"]).collect()))
    assert rows(found) == rows(code.code_lines(files))
