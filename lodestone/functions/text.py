"""Column functions over urls, identifiers and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from ..constants import FILLER_WORDS, MAX_QUERY_TERMS

SPACES = r"[\s ]+"


def trim_all(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def content_hash(c: Column) -> Column:
    return F.sha2(trim_all(c), 256)


def url_hash(c: Column) -> Column:
    return F.substring(F.translate(F.base64(F.unhex(F.sha2(c, 256))), "+/", "-_"), 1, 32)


def chunk_id(source: Column, url: Column, index: Column) -> Column:
    return F.concat_ws(":", source, url_hash(url), index.cast("string"))


def estimate_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(c) / 4.0)).cast("int")


def url_host(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def url_path(u: Column) -> Column:
    p = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", "/").otherwise(p)


def url_scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def path_segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def url_segment(u: Column, n: int, default: str) -> Column:
    return F.coalesce(F.get(path_segments(url_path(u)), F.lit(n)), F.lit(default))


def canonical_url(u: Column) -> Column:
    """Scheme and host in lower case, default port, query, fragment, version and number segments and last slash gone."""
    scheme = url_scheme(u)
    host = url_host(u)
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    kept = F.filter(path_segments(url_path(u)), lambda s: ~F.regexp_like(F.lower(s), F.lit(r"^v?[0-9]+([.][0-9]+)*$|^(nextjs|react|vue|angular)-[0-9]+")))
    path = F.array_join(kept, "/")
    full = F.concat(scheme, F.lit("://"), host, F.when(path != "", F.concat(F.lit("/"), path)).otherwise(""))
    return F.when(scheme == "", F.lower(trim_all(u))).otherwise(full)


def under_prefix(u: Column, root: Column) -> Column:
    """Same origin, and the path equal to the root's or below it; a root path of / takes all."""
    origin = lambda c: F.concat(url_scheme(c), F.lit("://"), url_host(c))
    base = F.regexp_replace(url_path(root), "/+$", "")
    inside = (url_path(u) == base) | F.startswith(url_path(u), F.concat(base, F.lit("/"))) | (base == "")
    return F.when(url_scheme(root) == "", F.startswith(u, root)).otherwise((origin(u) == origin(root)) & inside)


def under_prefix_any_host(u: Column, root: Column) -> Column:
    """As under_prefix, but neither the scheme nor a www. in front matters."""
    bare = lambda c: F.regexp_replace(url_host(c), "^www[.]", "")
    base = F.regexp_replace(url_path(root), "/+$", "")
    return (bare(u) == bare(root)) & ((url_path(u) == base) | F.startswith(url_path(u), F.concat(base, F.lit("/"))) | (base == ""))


def registrable_domain(host: Column) -> Column:
    """The last two labels, or three below a two-part public suffix."""
    labels = F.filter(F.split(F.regexp_replace(F.lower(host), "^www[.]", ""), "[.]"), lambda x: x != "")
    last = lambda k: F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - (k - 1)), k), ".")
    return F.when((F.size(labels) >= 3) & last(2).isin(*C.TWO_PART_SUFFIXES), last(3)).otherwise(last(2))


def normalize_domain(c: Column) -> Column:
    """The host of a url or of a bare domain, without www."""
    bare = F.lower(F.regexp_extract(F.concat(F.when(F.contains(c, F.lit("://")), "").otherwise("https://"), F.trim(c)), r"://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.nullif(F.regexp_replace(bare, "^www[.]", ""), F.lit(""))


def url_key(u: Column) -> Column:
    """The canonical url without www: how pages of two lists are told to be the same."""
    return F.regexp_replace(canonical_url(u), "^(https?://)www[.]", "$1")


def path_keywords(u: Column) -> Column:
    """The words of a url's path, without file endings and segments that name no topic."""
    words = F.transform(path_segments(url_path(u)), lambda s: F.lower(F.trim(F.regexp_replace(F.regexp_replace(s, "(?i)[.][a-z0-9]+$", ""), "[-_]+", " "))))
    return F.array_join(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*C.GENERIC_SEGMENTS))), " ")


def category_slug(c: Column) -> Column:
    """A category as a slug; null if nothing is left or it is longer than 48."""
    s = F.regexp_replace(F.regexp_replace(F.replace(F.lower(F.trim(c)), F.lit("/"), F.lit("-")), r"\s+", "-"), "[^a-z0-9-]", "")
    s = F.regexp_replace(F.regexp_replace(s, "-+", "-"), "^-|-$", "")
    return F.when((s != "") & (F.length(s) <= 48), s)


def category_label(slug: Column) -> Column:
    return F.replace(slug, F.lit("-"), F.lit("/"))


def version_label(number: Column, detected: Column, given: Column) -> Column:
    """What the user wrote, else what was detected with a v in front, else the number with one."""
    said = lambda c: F.nullif(F.trim(c), F.lit(""))
    found = said(detected)
    return F.coalesce(said(given), F.when(F.startswith(found, F.lit("v")), found).otherwise(F.concat(F.lit("v"), found)), F.concat(F.lit("v"), number.cast("string")))


def slugify(c: Column) -> Column:
    """Lower case, accents folded for Latin letters, other runs to one dash, at most 64 characters."""
    folded = F.translate(F.lower(c), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.substring(F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 64)


def title_from_slug(u: Column) -> Column:
    segs = path_segments(url_path(u))
    last = F.regexp_replace(F.coalesce(F.get(segs, F.size(segs) - 1), F.lit("")), "[.][A-Za-z0-9]+$", "")
    return F.initcap(trim_all(F.regexp_replace(last, "[-_]+", " ")))


def split_identifier(c: Column) -> Column:
    """Parts of an identifier in lower case: at humps, digits and separators; single letters go with the next part; length 2 or more."""
    s = F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2")
    s = F.regexp_replace(s, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    s = F.regexp_replace(s, "([A-Za-z])([0-9])", "$1 $2")
    s = F.regexp_replace(s, "([0-9])([A-Za-z])", "$1 $2")
    parts = F.filter(F.split(F.lower(s), "[^a-z0-9]+"), lambda p: p != "")
    # A part of one letter is written without the space behind it, so that it joins what follows.
    glued = F.split(F.array_join(F.transform(parts, lambda p: F.when(F.length(p) == 1, p).otherwise(F.concat(p, F.lit(" ")))), ""), " ")
    return F.filter(glued, lambda p: F.length(p) >= 2)


_COMPOUND = "[A-Z_$0-9]"


def identifiers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*"), 0)


def query_terms(c: Column) -> Column:
    """ASCII identifiers and the parts of compound ones in lower case, without filler words, first seen first, at most 24."""
    none = F.expr("cast(array() as array<string>)")
    parts = lambda i: F.when(F.regexp_like(i, F.lit(_COMPOUND)), split_identifier(i)).otherwise(none)
    every = F.flatten(F.transform(identifiers(c), lambda i: F.concat(F.array(F.lower(i)), parts(i))))
    kept = F.filter(F.array_distinct(every), lambda t: (F.length(t) >= 2) & ~t.isin(*FILLER_WORDS))
    return F.slice(kept, 1, MAX_QUERY_TERMS)


def identifier_parts(c: Column) -> Column:
    """The parts of compound identifiers, first seen first, at most 400."""
    compound = F.filter(F.transform(F.filter(identifiers(c), lambda i: F.regexp_like(i, F.lit(_COMPOUND))), split_identifier), lambda p: F.size(p) >= 2)
    return F.slice(F.array_distinct(F.flatten(compound)), 1, C.MAX_INDEX_TOKENS)


def index_body(c: Column) -> Column:
    """A text with the parts of its identifiers behind it, so that they are found too."""
    parts = identifier_parts(c)
    return F.when(F.size(parts) == 0, c).otherwise(F.concat(c, F.lit("\n\n/* tokens: "), F.array_join(parts, " "), F.lit(" */")))


def index_heading(fields: list[Column], headings: Column | None = None) -> Column:
    """The heading field of a chunk: its distinct names and titles, then the parts of their identifiers."""
    every = F.array(*[F.nullif(F.trim(f), F.lit("")) for f in fields])
    if headings is not None:
        every = F.concat(every, F.transform(F.coalesce(headings, F.expr("cast(array() as array<string>)")), lambda h: F.nullif(F.trim(h), F.lit(""))))
    heading = F.array_join(F.array_distinct(F.array_compact(every)), " ")
    parts = identifier_parts(heading)
    return F.when(F.size(parts) == 0, heading).otherwise(F.concat(heading, F.lit(" "), F.array_join(parts, " ")))


def expansion_terms(c: Column) -> Column:
    """The six longest distinct words of three letters or more that select chunks of a page; ties by first place."""
    words = F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: (F.length(w) >= 3) & ~w.isin(*C.EXPANSION_FILLER)))
    placed = F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))
    return F.transform(F.slice(F.array_sort(placed), 1, 6), lambda x: x["w"])


def number(c: Column) -> Column:
    """A text as a finite number: blank is 0; signs, decimals, exponents and 0x, 0o, 0b numbers count; null for the rest."""
    t = trim_all(c)
    based = lambda mark, base, digits: F.when(F.regexp_like(t, F.lit(f"^0[{mark}][{digits}]+$")), F.conv(F.substring(t, 3, 1 << 20), base, 10).cast("double"))
    plain = F.when(F.regexp_like(t, F.lit(r"^[+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?$")), t.try_cast("double"))
    value = F.coalesce(F.when(t == "", 0.0), plain, based("xX", 16, "0-9a-fA-F"), based("oO", 8, "0-7"), based("bB", 2, "01"))
    return F.when(F.abs(value) < float("inf"), value)


def index_terms(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), 0)


def near_duplicate_key(url: Column, text: Column) -> Column:
    """Url and the last 240 lower-case letters and digits."""
    plain = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")
    return F.concat_ws("::", url, F.substring(plain, F.greatest(F.lit(1), F.length(plain) - 239), F.lit(240)))


def path_id(url: Column) -> Column:
    """A 32-bit polynomial hash with factor 31 of the url, in base 36."""
    chars = F.transform(F.sequence(F.lit(1), F.greatest(F.length(url), F.lit(1))), lambda i: F.ascii(F.substr(url, i, F.lit(1))).cast("long"))
    h = F.aggregate(chars, F.lit(0).cast("long"), lambda a, x: F.pmod(a * 31 + x, F.lit(4294967296)))
    return F.concat(F.lit("p"), F.lower(F.conv(h.cast("string"), 10, 36)))
