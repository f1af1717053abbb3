"""Text functions: tokens with the rules for numbers and contractions, canonical form, sentences, HTML.

Rules that need a look at neighbouring characters run as Arrow-batched pandas functions; what regular expressions can say stays in the JVM.
"""

from __future__ import annotations

import html as _html
import re
import textwrap

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..plans.session import spread

#: Titles and shortenings after which a period doesn't end a sentence.
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "St", "Jr", "Sr", "Inc", "Ltd", "Co", "Corp", "vs", "etc", "No", "Fig", "Vol", "pp", "Gen", "Col", "Capt", "Lt", "Sen", "Rep", "Gov")
_TOKEN = re.compile(
    r"""''|``                                   # doubled quotes
    | -?\d+(?:[.,]\d+)*(?=-[^\W\d_])           # a number before a hyphen and a word: 12-ton is three tokens
    | (?<![\w])-?\d+(?:[.,]\d+)*                # numbers with inner points and commas
    | (?:[^\W\d_]\.){2,}                        # dotted abbreviations: e.g.
    | \w+(?:['’]\w+)*(?:-\w+(?:['’]\w+)*)*      # words, contractions, hyphenated words
    | [^\w\s]                                   # any other sign
    """,
    re.X,
)
_SPLIT_RANGE = re.compile(r"(-?\d+(?:[.,]\d+)*)(-)([^\W\d_]\w*)")


def split_words(text: str) -> list[str]:
    return _TOKEN.findall(text)


@F.pandas_udf(ArrayType(StringType()))
def tokenize(text: pd.Series) -> pd.Series:
    """Words of each text; null for null."""
    return text.map(lambda t: None if t is None else split_words(t))


def split_blanks(text: Column) -> Column:
    """Words between blanks only."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


#: Encodings of one byte whose letters and digits are those of their characters; in "raw" only ASCII counts, in all others everything beyond ASCII does.
_ONE_BYTE = {"latin-1": "ISO-8859-1", "latin-2": "ISO-8859-2"}


def word_class(encoding: str, also: str = "") -> str:
    """The characters of words in an encoding, as a class for regular expressions; ``also`` adds some."""
    name = encoding.lower()
    if name in _ONE_BYTE:
        own = sorted({c for c in bytes(range(128, 256)).decode(_ONE_BYTE[name]) if c.isalnum()})
        more = "".join(own)
    else:
        more = "" if name == "raw" else r"\x{80}-\x{10FFFF}"
    return "[A-Za-z0-9" + more + re.escape(also) + "]"


def split_by_table(text: Column, encoding: str, also: str = "") -> Column:
    """The runs of an encoding's word characters; everything else parts words. Null for null."""
    return F.regexp_extract_all(text, F.lit(f"({word_class(encoding, also)}+)"), F.lit(1))


def canonicalize(text: Column, upper: bool = False) -> Column:
    """Tokens with one blank between."""
    out = F.array_join(tokenize(text), " ")
    return F.upper(out) if upper else out


def decanonicalize(text: Column) -> Column:
    """Closing signs back at their words, opening ones at theirs."""
    out = F.regexp_replace(text, r" (?=[.,;:!?)\]}%])", "")
    return F.regexp_replace(out, r"(?<=[(\[{]) ", "")


_STOPS = re.compile(r"[.!?:](?=\s)|\n(?=\n)")
_STOPS_AND_WORDS = re.compile(r"[.!?:](?=\s)|\n(?=\n)|(?<=\S)\s")
_LETTER = re.compile(r"[^\W\d_]")
_AFTER = re.compile(r"[\s\"']*")


def _word_before(text: str, start: int, k: int) -> str:
    """The letters that end before ``k``, white space between left out."""
    while k > start and text[k - 1].isspace():
        k -= 1
    end = k
    while k > start and _LETTER.match(text, k - 1):
        k -= 1
    return text[k:end]


def sentence_ends(text: str, most_words: int = 1 << 30, abbreviations: frozenset = frozenset(a.lower() for a in ABBREVIATIONS)) -> list[int]:
    """Where each sentence but the last ends (start of the next one).

    A sentence ends at . ! ? : before white space, or at a blank line, if what follows isn't lower case, a digit or a further stop; not after a
    single capital or an abbreviation; and after ``most_words`` words at the latest.
    """
    out, start, words, k = [], 0, 0, 0
    stops = _STOPS if most_words >= 1 << 30 else _STOPS_AND_WORDS
    # From stop to stop: what lies between is passed by one search.
    while m := stops.search(text, k):
        k = m.start()
        c = text[k]
        if k > start and c.isspace() and not text[k - 1].isspace():
            words += 1
            if words >= most_words:
                while k < len(text) and text[k].isspace():
                    k += 1
                if k < len(text):
                    out.append(k)
                start, words = k, 0
                continue
        paragraph = text.startswith("\n\n", k)
        if (c in ".!?:" or paragraph) and k + 1 < len(text) and text[k + 1].isspace():
            end = _AFTER.match(text, k + 2).end()
            following = text[end : end + 1]
            if following and not following.islower() and not following.isdigit() and following not in ".,;:!?-":
                word = _word_before(text, start, k)
                initial = c == "." and len(word) == 1 and word.isupper()
                if paragraph or not initial and not (c == "." and word.lower() in abbreviations):
                    out.append(end)
                    start, words, k = end, 0, end
                    continue
        k += 1
    return out


@F.pandas_udf(ArrayType(StringType()))
def sentences(text: pd.Series) -> pd.Series:
    """Sentences of each text, outer white space off."""

    def cut(t):
        if t is None:
            return None
        at = [0, *sentence_ends(t), len(t)]
        return [s for a, b in zip(at, at[1:]) if (s := t[a:b].strip())]

    return text.map(cut)


def word_wrap(width: int):
    """A function that wraps at ``width`` columns."""

    @F.pandas_udf(StringType())
    def wrap(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else "\n".join(textwrap.wrap(t, width)))

    return wrap


# HTML

_TAG = r"(?s)<\s*(/?[A-Za-z][A-Za-z0-9]*)([^>]*)>"
#: What tags do to the lines of the text: a blank line before, a line break before, or neither.
_PARAGRAPH = ("p", "/p", "h1", "h2", "/h1")
_BREAK = ("br", "/tr", "h3", "h4", "/h2", "/h3", "/h4")


def strip_comments(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<!--.*?-->", " ")


def html_tags(html: Column) -> Column:
    """array<struct<tag, attributes>> in order, tags in lower case."""
    bare = strip_comments(html)
    names, rest = F.regexp_extract_all(bare, F.lit(_TAG), F.lit(1)), F.regexp_extract_all(bare, F.lit(_TAG), F.lit(2))
    return F.zip_with(names, rest, lambda a, b: F.struct(F.lower(a).alias("tag"), F.trim(b).alias("attributes")))


def html_links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", base_col: str | None = "url") -> DataFrame:
    """(id, link): distinct HREFs, quoted or bare, resolved against BASE or the page's own address."""
    bare = strip_comments(F.col(html_col))
    href = F.regexp_extract_all(bare, F.lit(r"""(?is)<\s*a\s[^>]*?href\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)"""), F.lit(1))
    base = F.regexp_extract(bare, r"""(?is)<\s*base\s[^>]*?href\s*=\s*["']?([^"'\s>]+)""", 1)
    base = F.when(base != "", base).otherwise(F.col(base_col) if base_col else F.lit(""))
    links = pages.select(F.col(id_col), base.alias("_base"), F.explode(F.array_distinct(F.transform(href, lambda h: F.regexp_replace(h, r"""^["']|["']$""", "")))).alias("h"))
    site, folder = F.regexp_extract("_base", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.regexp_extract("_base", r"^([^?#]*/)", 1)
    h = F.col("h")
    full = F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(F.regexp_extract("_base", r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), h)).when(h.startswith("/"), F.concat(site, h)).when(h.startswith("#"), F.concat(F.substring_index("_base", "#", 1), h)).otherwise(F.concat(F.when(folder.rlike("://.*/"), folder).otherwise(F.concat(site, F.lit("/"))), h))
    return links.select(id_col, full.alias("link")).distinct()


def plain_text(html: str, width: int = 0) -> str:
    """The text of a page: tags turn to line breaks, bullets, rules or blanks, entities to characters."""
    html = re.sub(r"(?s)<!--.*?-->", " ", html)
    out: list[str] = []

    def tag(m):
        name = m[1].lower()
        if name in _PARAGRAPH:
            return "\0\n"
        if name in _BREAK:
            return "\0"
        if name == "hr":
            return "\0-----\n"
        if name == "li":
            return "\0 * "
        if name == "img":
            alt = re.search(r"""(?is)\balt\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", m[2])
            return f"[{alt[1].strip(chr(34) + chr(39))}]" if alt else ""
        return " "

    html = re.sub(r"\s+", " ", html.replace("\0", ""))
    html = re.sub(_TAG, tag, html)
    html = re.sub(r"<[^>]*>", " ", html)
    text = _html.unescape(html)
    for part in text.split("\0"):
        part = re.sub(r"[ \t]+", " ", part)
        if out and not out[-1].endswith("\n"):
            out.append("\n")
        out.append(part.lstrip(" ") if not part.startswith(" * ") else part)
    text = "".join(out)
    return "\n".join(textwrap.fill(line, width) for line in text.split("\n")) if width else text


@F.pandas_udf(StringType())
def html_text(html: pd.Series) -> pd.Series:
    return html.map(lambda h: None if h is None else plain_text(h))


def q_tokens(spark, sf_dir):
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return docs.select("doc_id", tokenize("text").alias("words")).select("doc_id", F.size("words").alias("tokens"), F.array_join("words", " ").alias("canonical"))


def q_blanks(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.size(split_blanks(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))).cast("int").alias("words"))


def q_tables(spark, sf_dir):
    """How many words each document has after the tables of four encodings."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", *[F.size(split_by_table(F.col("text"), e)).alias(e.replace("-", "")) for e in ("latin-1", "latin-2", "utf-8", "raw")])


def q_sentences(spark, sf_dir):
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", F.posexplode(sentences("text")).alias("k", "sentence"))


def q_links(spark, sf_dir):
    return html_links(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def q_tags(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select(F.explode(html_tags(F.col("html"))).alias("t")).groupBy(F.col("t.tag").alias("tag")).agg(F.count(F.lit(1)).alias("n"))


def q_html(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", html_text("html").alias("text"))


QUERIES = {"canonicalize": q_tokens, "split_blanks": q_blanks, "delimiter_tables": q_tables, "sentence_break": q_sentences, "html_links": q_links, "html_tags": q_tags, "html_text": q_html}
SQL = {
    "delimiter_tables": "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '[A-Za-z0-9{c}]+'))::INT AS {k}" for k, c in (("latin1", "ª²³µ¹º¼½¾À-ÖØ-öø-ÿ"), ("latin2", "ĄŁĽŚŠŞŤŹŽŻąłľśšşťźžżŔÁÂĂÄĹĆÇČÉĘËĚÍÎĎĐŃŇÓÔŐÖŘŮÚŰÜÝŢßŕáâăäĺćçčéęëěíîďđńňóôőöřůúűüýţ"), ("utf8", "\\x{80}-\\x{10FFFF}"), ("raw", ""))) + " FROM documents",
    "split_blanks": r"SELECT doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::INT AS words FROM documents",
    "html_links": r"""
WITH b AS (SELECT page_id, url, regexp_replace(html, '<!--.*?-->', ' ', 'gs') AS t FROM pages),
l AS (SELECT page_id, coalesce(nullif(regexp_extract(t, '(?is)<\s*base\s[^>]*?href\s*=\s*["'']?([^"''\s>]+)', 1), ''), url) AS base, unnest(regexp_extract_all(t, '(?is)<\s*a\s[^>]*?href\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)', 1)) AS h FROM b),
s AS (SELECT page_id, base, regexp_replace(h, '^["'']|["'']$', '', 'g') AS h, regexp_extract(base, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS site, regexp_extract(base, '^([^?#]*/)', 1) AS folder FROM l)
SELECT DISTINCT page_id, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h WHEN h[1:2] = '//' THEN regexp_extract(base, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) || h WHEN h[1] = '/' THEN site || h
  WHEN h[1] = '#' THEN split_part(base, '#', 1) || h WHEN regexp_matches(folder, '://.*/') THEN folder || h ELSE site || '/' || h END AS link FROM s
""",
    "html_tags": r"SELECT tag, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(regexp_replace(html, '<!--.*?-->', ' ', 'gs'), '<\s*(/?[A-Za-z][A-Za-z0-9]*)([^>]*)>', 1))) AS tag FROM pages) GROUP BY tag",
}
