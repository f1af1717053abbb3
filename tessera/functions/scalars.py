"""Scalar functions on strings and numbers, as columns; patterns are translated on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The smallest positive normal double.
TINY = 2.2250738585072014e-308
#: Characters that URL encoding escapes, besides white space.
URL_ESCAPED = "%~\\"


def safe_log(x: Column) -> Column:
    """ln of at least the smallest normal double."""
    return F.log(F.greatest(x, F.lit(TINY)))


def smoothed_log(x: Column, threshold: float) -> Column:
    lg = safe_log(x)
    return F.when(lg < threshold, threshold * F.sqrt(lg / threshold)).otherwise(lg)


def gaussian(x: Column, mean: Column, variance: Column) -> Column:
    """Density; without variance 1 at the mean and 0 elsewhere."""
    dense = F.exp(-((x - mean) * (x - mean)) / (2 * variance)) / F.sqrt(2 * F.pi() * variance)
    return F.when(variance > 0, dense).otherwise((x == mean).cast("double"))


def f_measure(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    b = beta * beta
    low = b * precision + recall
    return F.when(low == 0, 0.0).otherwise((1 + b) * precision * recall / low)


def parse_radix(text: Column) -> Column:
    """Integers written in decimal or as #b, #o, #x and #NNr digits; null for anything else."""
    body = F.regexp_extract(text, r"^#(?:[bBoOxX]|\d+[rR])([+-]?[0-9A-Za-z]+)$", 1)
    base = F.when(text.rlike("^#[bB]"), 2).when(text.rlike("^#[oO]"), 8).when(text.rlike("^#[xX]"), 16).otherwise(F.regexp_extract(text, r"^#(\d+)[rR]", 1).try_cast("int"))
    out = F.when(text.rlike(r"^[+-]?\d+$"), text)
    for radix in range(2, 37):
        out = out.when((body != "") & (base == radix), F.conv(body, radix, 10))
    return out.try_cast("long")


def wildcard_match(text: Column, pattern: str, match_case: bool = True) -> Column:
    """"?" stands for one character, the first "*" for any number of them; later ones for themselves."""
    head, star, tail = pattern.partition("*")
    one = lambda p: "".join("." if c == "?" else re.escape(c) for c in p)
    java = f"(?s){'' if match_case else '(?iu)'}^{one(head)}{'.*' if star else ''}{one(tail)}$".replace("$", "\\z")
    return text.rlike(java)


def translate_pattern(pattern: str, classes: dict[str, list[str]] | None = None) -> str:
    """A pattern with % ? * + (a,b) <class> {n,m} [set] as a Java regular expression for whole strings.

    Groups and classes capture, so %1 .. %9 in a replacement refer to them.
    """
    out, k, depth = [], 0, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "%" and k + 1 < len(pattern):
            k += 1
            out.append(re.escape(pattern[k]))
        elif c == "(":
            depth += 1
            out.append("(")
        elif c == ")":
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "<":
            end = pattern.index(">", k)
            out.append("(" + "|".join(re.escape(x) for x in sorted((classes or {})[pattern[k + 1 : end]], key=len, reverse=True)) + ")")
            k = end
        elif c == "{":
            end = pattern.index("}", k)
            out.append(pattern[k : end + 1])
            k = end
        elif c == "[":
            end = pattern.index("]", k + 1)
            body = pattern[k + 1 : end]
            out.append("[" + ("^" if body[:1] == "^" else "") + re.sub(r"([\\\[\]&^])", r"\\\1", body.lstrip("^")) + "]")
            k = end
        elif c in "?*+":
            out.append(c)
        elif c == ".":
            out.append(".")
        else:
            out.append(re.escape(c))
        k += 1
    return "^(?:" + "".join(out) + ")$"


def regex_match(text: Column, pattern: str, classes=None) -> Column:
    return text.rlike(translate_pattern(pattern, classes))


def regex_rewrite(text: Column, pattern: str, replacement: str, classes=None) -> Column:
    """Strings that match as a whole are replaced (%1 .. %9 are groups, %% is %), others are null."""
    java = re.sub(r"%(\d)|%(.)|([$\\])", lambda m: f"${m[1]}" if m[1] else re.sub(r"([$\\])", r"\\\1", m[2] or m[3]), replacement)
    regex = translate_pattern(pattern, classes)
    return F.when(text.rlike(regex), F.regexp_replace(text, regex, java))


def url_encode(text: Column) -> Column:
    """Escapes white space, "%", "~" and "\\" only."""
    out = text
    for c in "%~\\ \t\n\r\v\f":
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return out


def url_decode(text: Column) -> Column:
    """Decodes %XX alone; "+" stays."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def first_word(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*(\S*)", 1)


def last_word(text: Column) -> Column:
    return F.regexp_extract(text, r"(\S*)\s*$", 1)


def but_last_word(text: Column) -> Column:
    return F.regexp_replace(text, r"\s*\S+\s*$", "")


def truncate_at(text: Column, marker: str) -> Column:
    return F.substring_index(text, marker, 1)


def needs_quoting(symbol: Column) -> Column:
    """Whether a symbol's name can't be read back bare: empty, lower case or signs in it."""
    return ~symbol.rlike(r"^[A-Z_*+<>=&%$!?/@~^][A-Z0-9_*+<>=&%$!?/@~^.-]*$")


def to_symbol(text: Column) -> Column:
    return F.upper(text)


def locate_any_case(text: Column, what: str) -> Column:
    """0-based place of ``what`` in any case, -1 if there is none."""
    return F.locate(what.lower(), F.lower(text)) - 1


def common_prefix(a: Column, b: Column) -> Column:
    n = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s["n"] + (s["on"] & e).cast("int")).alias("n"), (s["on"] & e).alias("on")), lambda s: s["n"])
    return F.substring(a, F.lit(1), n)


def sniff_encoding(content: Column) -> Column:
    """utf-16be, utf-16le and utf-8 by byte-order mark, ascii, else a guess by where zero bytes stand."""
    head = F.hex(F.substring(content, 1, 3))
    text = F.decode(content, "ISO-8859-1")
    # The first and the second bytes of all pairs.
    pairs, odds = F.regexp_replace(text, "(?s)(.).?", "$1"), F.regexp_replace(text, "(?s).(.?)", "$1")
    zero = lambda a: F.length(F.regexp_replace(a, "[^\\x00]", ""))
    return (
        F.when(head.startswith("FEFF"), "utf-16be").when(head.startswith("FFFE"), "utf-16le").when(head.startswith("EFBBBF"), "utf-8")
        .when(text.rlike("\\x00") & (zero(pairs) > zero(odds)), "utf-16be").when(text.rlike("\\x00") & (zero(odds) > zero(pairs)), "utf-16le").when(~text.rlike("[^\\x00-\\x7F]"), "ascii").otherwise("latin-1")
    )


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows (all, if fewer) chosen by a hash of the key: the same ones each time."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark keeps k rows for each group and task before it shuffles."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def base64_line(text: Column) -> Column:
    """A text's UTF-8 in base64, in one line however long it is."""
    return F.replace(F.base64(F.encode(text, "UTF-8")), F.lit("\r\n"), F.lit(""))


def _orders(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def q_math(spark, sf_dir):
    price = F.col("o_totalprice") / 100000
    o = _orders(spark, sf_dir)
    return o.select("o_orderkey", F.round(safe_log(price), 6).alias("sl"), F.round(smoothed_log(price + 1, 2.0), 6).alias("sm"), F.round(gaussian(price, F.lit(1.5), F.lit(0.25)), 6).alias("g"), F.round(f_measure(price / 10, F.lit(0.5), 2.0), 6).alias("f"))


def q_bit_count(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_orderkey", F.bit_count("o_orderkey").alias("bits"))


def q_urls(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    part = lambda k: F.expr(f"try_parse_url(url, '{k}')").alias(k.lower())
    return p.select("page_id", url_encode(F.concat("url", F.lit(" ~%\\"))).alias("encoded"), url_decode(url_encode(F.concat("url", F.lit(" +~%\\")))).alias("decoded"), F.md5("url").alias("md5"), base64_line(F.col("url")).alias("b64"), part("HOST"), part("PROTOCOL"), part("QUERY"))


def q_patterns(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", wildcard_match(F.col("p_brand"), "Brand#?2*").alias("wild"), wildcard_match(F.col("p_name"), "*1", False).alias("tail"), regex_match(F.col("p_brand"), "Brand#[1-3](1,2,3)").alias("re"), regex_rewrite(F.col("p_brand"), "(Brand)#([0-9]+)", "%2-%1%%").alias("rewritten"))


def q_words(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return b.select("item_id", first_word(F.col("text")).alias("first"), last_word(F.col("text")).alias("last"), F.length(but_last_word(F.col("text"))).alias("rest"), truncate_at(F.col("text"), ".").alias("cut"), locate_any_case(F.col("text"), "THE").alias("the"), F.lower("text").alias("low"), F.translate("text", "aeiou", "AEIOU").alias("mapped"), F.reverse("text").alias("back"))


def q_top_k(spark, sf_dir):
    """The five dearest orders of each customer: a bounded queue for each key."""
    return top_k(_orders(spark, sf_dir), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 5).select("o_custkey", "rank", "o_orderkey", "o_totalprice")


def q_sample(spark, sf_dir):
    return sample_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label"), "vec_id", 100, seed=7)


def q_count(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 7).alias("mean"), F.max("value").alias("most"), F.min("value").alias("least"))


def q_distinct(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


QUERIES = {"math_functions": q_math, "bit_count": q_bit_count, "url_functions": q_urls, "patterns": q_patterns, "word_functions": q_words, "top_k": q_top_k, "sample_deterministic": q_sample, "count_by_key": q_count, "distinct_count": q_distinct}
SQL = {
    "math_functions": "WITH p AS (SELECT o_orderkey, o_totalprice / 100000 AS x FROM orders) SELECT o_orderkey, round(ln(greatest(x, 2.2250738585072014e-308)), 6) AS sl, round(CASE WHEN ln(x + 1) < 2 THEN 2 * sqrt(ln(x + 1) / 2) ELSE ln(x + 1) END, 6) AS sm, round(exp(-((x - 1.5) * (x - 1.5)) / 0.5) / sqrt(2 * pi() * 0.25), 6) AS g, round(5 * (x / 10) * 0.5 / (4 * (x / 10) + 0.5), 6) AS f FROM p",
    "bit_count": "SELECT o_orderkey, bit_count(o_orderkey)::INT AS bits FROM orders",
    "url_functions": r"SELECT page_id, url || '%20%7E%25%5C' AS encoded, url || ' +~%\' AS decoded, md5(url) AS md5, base64(encode(url)) AS b64, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '^([a-z]+):', 1) AS protocol, nullif(regexp_extract(url, '\?([^#]*)', 1), '') AS query FROM pages",
    "patterns": "SELECT p_partkey, regexp_full_match(p_brand, 'Brand#.2.*') AS wild, suffix(p_name, '1') AS tail, regexp_full_match(p_brand, 'Brand#[1-3](1|2|3)') AS re, CASE WHEN regexp_full_match(p_brand, 'Brand#[0-9]+') THEN regexp_extract(p_brand, '#([0-9]+)', 1) || '-Brand%' END AS rewritten FROM part",
    "word_functions": r"SELECT item_id, regexp_extract(text, '^\s*(\S*)', 1) AS first, regexp_extract(text, '(\S*)\s*$', 1) AS last, length(regexp_replace(text, '\s*\S+\s*$', ''))::INT AS rest, split_part(text, '.', 1) AS cut, (instr(lower(text), 'the') - 1)::INT AS the, lower(text) AS low, translate(text, 'aeiou', 'AEIOU') AS mapped, reverse(text) AS back FROM benchmark",
    "top_k": "SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank, o_orderkey, o_totalprice FROM orders QUALIFY rank <= 5",
    "sample_deterministic": "SELECT vec_id, label FROM embeddings ORDER BY md5('7:' || vec_id), vec_id LIMIT 100",
    "count_by_key": "SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 7) AS mean, max(value) AS most, min(value) AS least FROM events GROUP BY ALL",
    "distinct_count": "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY ALL",
}
