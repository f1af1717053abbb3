"""Spelling candidates, word morphology and entity templates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters that candidates are made with.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: A known word counts so many times its frequency; a word made of two is discounted by pairs squared times the second number.
KNOWN_FACTOR, PAIR_DISCOUNT = 10, 100


def candidates(word: Column) -> Column:
    """All strings one swap, change, omission or insertion (letters and a blank) away, as an array."""
    n = F.length(word)
    head = lambda k: F.substring(word, F.lit(1), k)
    tail = lambda k: F.substring(word, k + 1, n)
    steps = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    letters = F.array(*[F.lit(c) for c in LETTERS])
    swaps = F.transform(steps, lambda k: F.concat(head(k), F.substring(word, k + 2, F.lit(1)), F.substring(word, k + 1, F.lit(1)), tail(k + 2)))
    omits = F.transform(steps, lambda k: F.concat(head(k), tail(k + 1)))
    changes = F.flatten(F.transform(steps, lambda k: F.transform(letters, lambda c: F.concat(head(k), c, tail(k + 1)))))
    spread = F.array(*[F.lit(c) for c in LETTERS + " "])
    inserts = F.flatten(F.transform(F.sequence(F.lit(0), n), lambda k: F.transform(spread, lambda c: F.concat(head(k), c, tail(k)))))
    return F.array_distinct(F.concat(F.array(word), swaps, omits, changes, inserts))


def suggest(words: DataFrame, vocab: DataFrame, k: int = 5) -> DataFrame:
    """(word, candidate, freq, rank): the k most frequent known candidates of each word of ``words(word)``; vocab(word, freq).

    Candidates meet the vocabulary in one equi-join; two-word candidates are scored by both halves, discounted.
    """
    made = words.select("word").distinct().select("word", F.explode(candidates(F.col("word"))).alias("candidate"))
    one = made.join(vocab.select(F.col("word").alias("candidate"), "freq"), "candidate")
    one = one.withColumn("freq", F.when(F.col("candidate") == F.col("word"), F.col("freq") * KNOWN_FACTOR).otherwise(F.col("freq")))
    pairs = made.where(F.col("candidate").rlike("^[^ ]+ [^ ]+$")).select("word", "candidate", F.split("candidate", " ").alias("h"))
    v1, v2 = vocab.select(F.col("word").alias("h1"), F.col("freq").alias("f1")), vocab.select(F.col("word").alias("h2"), F.col("freq").alias("f2"))
    two = pairs.select("word", "candidate", F.col("h")[0].alias("h1"), F.col("h")[1].alias("h2")).join(v1, "h1").join(v2, "h2")
    l1, l2 = F.length("h1") * F.length("h1"), F.length("h2") * F.length("h2")
    both = F.floor((F.col("f2") * l2 + F.col("f1") * l1 + 1) / (l1 + l2))
    two = two.select("word", "candidate", F.floor((both + 4 * PAIR_DISCOUNT - 1) / (4 * PAIR_DISCOUNT)).alias("freq"))
    from pyspark.sql import Window

    order = Window.partitionBy("word").orderBy(F.desc("freq"), "candidate")
    return one.select("word", "candidate", "freq").unionByName(two).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def classify(tags: DataFrame, classes: DataFrame, tag_col: str = "tag", default: str = "MORPH") -> DataFrame:
    """``tags`` with the class of each tag; classes(tag, class)."""
    known = classes.select(F.col("tag").alias("_tag"), F.col("class").alias("_class"))
    return tags.join(known, F.col(tag_col) == F.col("_tag"), "left").withColumn("class", F.coalesce("_class", F.lit(default))).drop("_tag", "_class")


def strip_markers(word: Column, markers: tuple[str, str] = ("<", ">")) -> tuple[Column, Column]:
    """(bare word, marked tags) of ``word<tag><tag>``."""
    a, b = (re.escape(m) for m in markers)
    return F.regexp_replace(word, f"{a}[^{b}]*{b}", ""), F.regexp_extract_all(word, F.lit(f"{a}([^{b}]*){b}"), F.lit(1))


#: Parts of entity templates: text, type, confidence, and a percent sign.
_PARTS = {"%s": "(?<s>.+?)", "%t": "(?<t>[A-Za-z_]+)", "%c": "(?<c>[0-9.]+)", "%p": "%"}


def entity_pattern(template: str, any_case: bool = False) -> str:
    """A template such as ``<%t:%s>`` as a regular expression with groups s, t and c."""
    cut = re.split(r"(%[stcp])", template)
    return ("(?i)" if any_case else "") + "".join(_PARTS.get(p) or re.escape(p) for p in cut)


def entities(text: Column, template: str, any_case: bool = False) -> Column:
    """array<struct<text, type, confidence>> of a template's matches; what the template doesn't name is null."""
    pattern = entity_pattern(template, any_case)
    places = [p for p in re.findall(r"%[stc]", template)]
    take = lambda part: F.regexp_extract_all(text, F.lit(pattern), F.lit(places.index(part) + 1)) if part in places else F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.lit(None).cast("string"))
    zipped = F.arrays_zip(take("%s").alias("text"), take("%t").alias("type"), take("%c").alias("confidence"))
    return F.transform(zipped, lambda x: F.struct(x["text"].alias("text"), x["type"].alias("type"), F.try_to_number(x["confidence"], F.lit("999999999.999999")).cast("double").alias("confidence")))


def q_suggest(spark, sf_dir):
    """Words of the benchmark with a letter left out, corrected by the corpus's words."""
    from .term_vectors import tokens

    vocab = tokens(spark.read.parquet(f"{sf_dir}/documents.parquet")).groupBy(F.col("term").alias("word")).agg(F.count(F.lit(1)).alias("freq"))
    asked = tokens(spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(F.length("term") >= 4).distinct().select(F.concat(F.substring("term", 1, 1), F.expr("substring(term, 3)")).alias("word"))
    return suggest(asked, vocab, 3).select("word", "candidate", "freq", "rank")


def q_entities(spark, sf_dir):
    """Opening tags of the pages as entities: the template names a type and a text."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", F.explode(entities(F.col("html"), "<%t class=\"%s\"")).alias("e")).groupBy("e.type", "e.text").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"spell_suggest": q_suggest, "ne_match": q_entities}
_C = "unnest(list_concat([w], [w[:i] || w[i + 2:i + 2] || w[i + 1:i + 1] || w[i + 3:] for i in range(0, length(w))], [w[:i] || w[i + 2:] for i in range(0, length(w))], flatten([[w[:i] || c || w[i + 2:] for c in string_split('abcdefghijklmnopqrstuvwxyz', '')] for i in range(0, length(w))]), flatten([[w[:i] || c || w[i + 1:] for c in string_split('abcdefghijklmnopqrstuvwxyz ', '')] for i in range(0, length(w) + 1)])))"
SQL = {
    "ne_match": r"""WITH m AS (SELECT unnest(regexp_extract_all(html, '<([A-Za-z_]+) class="(.+?)"', 1)) AS type, unnest(regexp_extract_all(html, '<([A-Za-z_]+) class="(.+?)"', 2)) AS text FROM pages) SELECT type, text, count(*) AS n FROM m GROUP BY ALL""",
    "spell_suggest": rf"""
WITH v AS (SELECT word, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS word FROM documents) GROUP BY word),
q AS (SELECT DISTINCT t[1:1] || t[3:] AS w FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS t FROM benchmark) WHERE length(t) >= 4),
c AS (SELECT DISTINCT w, {_C} AS c FROM q),
o AS (SELECT w, c, CASE WHEN w = c THEN freq * {KNOWN_FACTOR} ELSE freq END AS f FROM c JOIN v ON v.word = c),
h AS (SELECT w, c, split_part(c, ' ', 1) AS a, split_part(c, ' ', 2) AS b FROM c WHERE regexp_full_match(c, '[^ ]+ [^ ]+')),
t AS (SELECT w, c, floor((floor((v2.freq * length(b) * length(b) + v1.freq * length(a) * length(a) + 1) / (length(a) * length(a) + length(b) * length(b))) + {4 * PAIR_DISCOUNT} - 1) / {4 * PAIR_DISCOUNT})::BIGINT AS f FROM h JOIN v v1 ON v1.word = a JOIN v v2 ON v2.word = b)
SELECT w AS word, c AS candidate, f AS freq, row_number() OVER (PARTITION BY w ORDER BY f DESC, c)::INT AS rank FROM (SELECT * FROM o UNION ALL SELECT * FROM t) QUALIFY rank <= 3
""",
}
