"""Html to markdown on awkward pages, and the fold that it runs on."""

import random

from pyspark.sql import functions as F

from lodestone.functions.arrays import states_before
from lodestone.operators.html import html_markdown

CASES = {
    "<nav><div><nav>in</nav>LEAK</div></nav><p>ok</p>": "ok",
    "<NAV><Nav>in</NAV>x</nav>y": "y",
    "<SCRIPT>bad('<p>')</SCRIPT>x<Style>y</STYLE><script>never closed": "x",
    "a<!-- <p>c --> b<!-- open": "a b",
    "<table><tr><th>a</th><th>b|c</th></tr><tr><td>1</td><td><p>2</p>\n3</td></tr></table>": "| a | b\\|c |\n| --- | --- |\n| 1 | 2 3 |",
    "<ul><li>a<ul><li>b</li><li>c<ol><li>d</li></ol></li></ul></li><li>e</li></ul>t": "- a\n  - b\n  - c\n    1. d\n- e\n\nt",
    '<H2 id="x">Title <a href="#x">#</a></H2><p>p</p>': "## [Title](https://e.org/p#x)\n\np",
    '<h3 id=y><a href="/z">Z</a> z</h3>': "### [Z z](https://e.org/p#y)",
    "<h6>no id</h6>text": "###### no id\n\ntext",
    '<pre class="language-ts"><code>a  b\n  &lt;c&gt;\n</code></pre>after': "```ts\na  b\n  <c>\n```\n\nafter",
    '<pre>\n<code class="x language-py">if x:\n\n\n\n    y</code></pre>': "```\n\nif x:\n\n\n\n    y\n```",
    "<body>out<main>in <div>deep</div></main>out<main>two</main></body>": "in\ndeep\n\ntwo",
    "<article>a</article>b": "a",
    "<main><main>in</main>still</main>out": "in\nstill",
    '<a href="/x?a=1&amp;b=2">l <b>k</b></a> <a href="#f">m</a><a href="/c">Copy page</a> <a>n</a>': "[l k](/x?a=1&b=2) m n",
    "a < b & c &amp; d": "a < b & c & d",
    "<p>x<br>y <img src=\"data:xx\"><img alt='A' src='b.png'></p><hr>z": "x\ny ![A](b.png)\n\n---\n\nz",
    "<article>one <nav>n": "one",
    '<div title="a>b">q</div></div></ul></main>r': "q\n\nr",
    "a\x01b\x02": "ab",
    "": "",
    None: "",
}


def test_cases(spark):
    df = spark.createDataFrame([(i, h) for i, h in enumerate(CASES)], "i int, html string").withColumn("url", F.lit("https://e.org/p#q")).withColumn("row", F.lit(1)).withColumn("markdown", F.lit("old"))
    got = {r["i"]: r["markdown"] for r in html_markdown(df).collect()}
    for (html, want), i in zip(CASES.items(), range(len(CASES))):
        assert got[i] == want, html


def test_choices(spark):
    df = spark.createDataFrame([('<main>m</main><section class="doc">s<p role="note">n<b>b</b></p>t</section>',)], "html string")
    one = lambda **k: html_markdown(df, **k).first()["markdown"]
    assert one() == "m" and one(content=("section", "main")) == "s\n\nnb\n\nt" and one(content=("section", "main"), exclude_tags='role="note"') == "st"
    assert one(content=()) == "m\n\ns\n\nnb\n\nt"
    assert html_markdown(df.limit(0)).count() == 0


def test_states_before(spark):
    r = random.Random(4)
    rows = [(i, [r.randrange(100) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 127, 128, 129, 256, 700])]
    df = spark.createDataFrame([*rows, (99, None)], "i int, xs array<int>")
    got = {x["i"]: x["s"] for x in df.select("i", states_before(F.col("xs"), F.lit(0), lambda a, x: (a * 7 + x) % 1009).alias("s")).collect()}
    for i, xs in rows:
        want, a = [], 0
        for x in xs:
            want.append(a)
            a = (a * 7 + x) % 1009
        assert got[i] == want
    assert got[99] is None
