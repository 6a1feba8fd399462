"""Column expressions over text and vectors; all stay inside Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code-point blocks that count as Japanese for chunk budgets and for query analysis.
CHUNK_JAPANESE = "\\x{3040}-\\x{309F}\\x{30A0}-\\x{30FF}\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{F900}-\\x{FAFF}\\x{FF00}-\\x{FFEF}"
QUERY_JAPANESE = "\\x{3040}-\\x{309F}\\x{30A0}-\\x{30FF}\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{FF65}-\\x{FF9F}"


def share_of(text: Column, members: str) -> Column:
    """Share of text's non-blank characters in a character class; 0 for text without any."""
    full = F.length(F.regexp_replace(text, r"\s", ""))
    rest = F.length(F.regexp_replace(text, f"[\\s{members}]", ""))
    return F.when(full > 0, (full - rest) / full).otherwise(F.lit(0.0))


def japanese_ratio(text: Column) -> Column:
    return share_of(text, CHUNK_JAPANESE)


def query_language(text: Column) -> Column:
    ratio = share_of(text, QUERY_JAPANESE)
    return F.when(ratio >= 0.70, "JAPANESE").when(ratio < 0.10, "ENGLISH").otherwise("MIXED")


def token_budget_chars(tokens: int, text: Column) -> Column:
    """Characters that a token budget allows: 2 a token for Japanese text, 4 for other text, in between for mixtures."""
    if tokens <= 0:
        return F.lit(0).cast("bigint")
    return F.floor(F.lit(tokens) * (4.0 - 2.0 * japanese_ratio(text)))


def keywords(query: Column) -> Column:
    """White-space tokens without <tags> and the characters & | ! ( ) : ' " and backslash; empty ones dropped."""
    bare = F.transform(F.split(F.trim(query), r"\s+"), lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]*>", ""), "[&|!():'\"\\\\]", "")))
    return F.filter(bare, lambda t: t != "")


def holds_all(content: Column, words: Column) -> Column:
    """Every word occurs in content, whatever the case; never true without words."""
    low = F.lower(content)
    return (F.size(words) > 0) & F.forall(words, lambda w: F.contains(low, F.lower(w)))


def trigrams(text: Column) -> Column:
    """Distinct three-letter windows of each lower-case word, two blanks before it and one after."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    cut = F.transform(
        words,
        lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))),
    )
    return F.array_distinct(F.flatten(cut))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


#: Digits of a score that don't depend on the order in which its parts were summed.
STEADY = 12


def steady(score: Column) -> Column:
    """A score without the noise of its summation, so that equal texts and vectors tie."""
    return F.round(score, STEADY)


def rounded(x: Column, digits: int) -> Column:
    """x to these digits, with the sign of x where that is zero, as SQL engines other than Spark keep it."""
    near = F.round(x, digits)
    return F.when((near == 0) & (x < 0), F.lit(-0.0)).otherwise(near)


def doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def l2_normalise(vector: Column) -> Column:
    """The vector over its length; a zero vector unchanged."""
    v = doubles(vector)
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def clipped(text: Column, most: int = 100) -> Column:
    """Log form of a text: cut after `most` characters with a mark."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("...(truncated)"))).otherwise(text)


def looks_like_html(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return low.startswith("<!doctype") | low.startswith("<html") | F.contains(low, F.lit("<head>")) | F.contains(low, F.lit("<body>"))


def code_type(text: Column) -> Column:
    """POM, XML, PROPERTIES or JAVA: by the first tag, else by the share of key=value lines."""
    body = F.trim(text)
    xml = body.rlike("^<(\\?xml|project|component|list)")
    pom = F.contains(body, F.lit("<dependency>")) | F.contains(body, F.lit("<artifactId>"))
    lines = F.split(body, "\n")
    keyed = F.size(F.filter(lines, lambda x: x.rlike(r"^[\w.]+\s*=")))
    flat = ~F.contains(body, F.lit("{")) & ~F.contains(body, F.lit("import"))
    properties = flat & (keyed > 0) & (keyed >= F.floor(F.size(lines) / 2))
    return F.when(xml & pom, "POM").when(xml, "XML").when(properties, "PROPERTIES").otherwise("JAVA")


def normal_version(version: Column, default: str) -> Column:
    """major.minor of a.b.c, the part before a final .x; the default for a blank one."""
    v = F.trim(version)
    v = F.regexp_replace(v, r"^(\d+\.\d+)\.\d+$", "$1")
    v = F.regexp_replace(v, r"\.x$", "")
    return F.when(version.isNull() | (F.trim(version) == ""), default).otherwise(v)
