"""Fill-in-middle transformation by block rotations in place.

A text is the bytes of its UTF-8 form. Its tokens (`[A-Za-z]+|[^A-Za-z]`, over code points) are found by one scan of the bytes; two
cuts, drawn by a hash of the document's id, part it into prefix, middle and suffix. The text is put into one bytearray, the three
sentinels are inserted, and blocks change places by three reversals::

    <P>prefix <M>middle <S>suffix  ->  <P>prefix <S>suffix <M>middle      psm: the last two blocks
                                   ->  <S>suffix <P>prefix <M>middle      spm: the first two and the last

``restore`` finds the sentinels in the output, rotates back and deletes them, which gives the text byte for byte. Every sentinel
starts with ``<``, and a text that holds a whole one is left plain, so the first place of each sentinel is the inserted one.

Defined cases: a null text is empty; an empty text is plain, as are texts with a sentinel; a null id is hashed as no digits; rows
with the same id and text give the same row each; an empty table gives no rows; of other columns nothing is read. All work is
within a row: nothing is shuffled, and a task holds one Arrow batch and two copies of one text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 texts, those from PLAIN on stay plain, and those below SPM put the suffix first.
PLAIN, SPM = 90, 20
CUT = "struct<n: bigint, form: string, prefix_chars: bigint, middle_chars: bigint, output: string>"
_CUT = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def draws(doc_id: Column) -> Column:
    """array<long> of four: the first 8-digit groups of the sha256 of `1:` and the id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def token_starts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The offsets of the tokens' first bytes, and for each byte whether it starts a code point."""
    b = np.frombuffer(text, np.uint8)
    point = (b & 0xC0) != 0x80
    letter = ((b | 0x20) - np.uint8(97)) < 26
    start = point.copy()
    start[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(start), point


def rotate(out: bytearray, start: int, middle: int, end: int) -> None:
    """Exchanges out[start:middle] with out[middle:end] in place: each is reversed, then both together."""
    view = np.frombuffer(out, np.uint8)
    for a, b in ((start, middle), (middle, end), (start, end)):
        half = (b - a) // 2
        held = view[a : a + half].copy()
        view[a : a + half] = view[b - half : b][::-1]
        view[b - half : b] = held[::-1]


def arrange(text: bytes, first: int, second: int, form: str) -> bytearray:
    """The output for cuts at the bytes ``first`` <= ``second``; form is psm or spm."""
    out = bytearray(text)
    for at, mark in ((second, SUFFIX), (first, MIDDLE), (0, PREFIX)):
        out[at:at] = mark
    middle = first + len(PREFIX)
    suffix = second + len(PREFIX) + len(MIDDLE)
    rotate(out, middle if form == "psm" else 0, suffix, len(out))
    return out


def rebuild(output: bytes, form: str) -> bytes:
    """The text of an output."""
    if form == "plain":
        return bytes(output)
    out = bytearray(output)
    if form == "psm":
        rotate(out, out.index(SUFFIX), out.index(MIDDLE), len(out))
    else:
        rotate(out, 0, out.index(PREFIX), len(out))
    for mark in (SUFFIX, MIDDLE, PREFIX):
        at = out.index(mark)
        del out[at : at + len(mark)]
    return bytes(out)


def transform(text: bytes, h: list[int], plain: int = PLAIN, spm: int = SPM) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, prefix_chars, middle_chars, output of one text and its four draws."""
    starts, point = token_starts(text)
    n = len(starts)
    if not n or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= plain:
        return n, "plain", None, None, text
    form = "spm" if h[3] % 100 < spm else "psm"
    first, second = (int(starts[k]) if k < n else len(text) for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    return n, form, int(point[:first].sum()), int(point[first:second].sum()), bytes(arrange(text, first, second, form))


def cut_column(text: Column, doc_id: Column, plain: int = PLAIN, spm: int = SPM) -> Column:
    """struct<n, form, prefix_chars, middle_chars, output> of a text."""

    @F.arrow_udf(CUT)
    def cut(texts: pa.Array, h: pa.Array) -> pa.Array:
        rows = [transform(t.as_buffer().to_pybytes(), d.as_py(), plain, spm) for t, d in zip(texts, h)]
        return pa.array([dict(zip(_CUT.names, r)) for r in rows], _CUT)

    return cut(F.coalesce(text, F.lit("")), draws(doc_id))


def restore_column(output: Column, form: Column) -> Column:
    """The text of an output of ``cut_column``, of which nothing else is needed."""

    @F.arrow_udf("string")
    def restore(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        return pa.array([rebuild(o.as_buffer().to_pybytes(), f.as_py()) for o, f in zip(outputs, forms)], pa.string())

    return restore(output, form)


def fill_in_middle(docs: DataFrame, plain: int = PLAIN, spm: int = SPM) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every document."""
    return docs.select("doc_id", cut_column(F.col("text"), F.col("doc_id"), plain, spm).alias("_cut")).select("doc_id", "_cut.*")


def op12_fim_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(table(spark, sf_dir, "documents"))
    back = restore_column(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


QUERIES = {"op12_fim_rotation": op12_fim_rotation}

#: By lists of tokens, without bytes or rotations.
ORACLE_SQL = {
    "op12_fim_rotation": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT *, len(t) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS k FROM d),
c AS (
  SELECT *, least(k[1] % (n + 1), k[2] % (n + 1)) AS a, greatest(k[1] % (n + 1), k[2] % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR k[3] % 100 >= 90 THEN 'plain'
              WHEN k[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, array_to_string(t[1:a], '') AS pre, array_to_string(t[a + 1:b], '') AS mid, array_to_string(t[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p"""
}
