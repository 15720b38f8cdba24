"""Text functions as Catalyst expressions, with one meaning of white space everywhere.

White space is Unicode white space (U+3000 too); lengths are code points; n-grams step over
code points, so that no pair of surrogates is split.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The wide marks that break JSON, and their half-width forms.
WIDE, HALF = "：，（）「」『』“”‘’", ":,()\"\"\"\"\"\"''"
#: Those of them that may stand inside a string.
HALF_WIDTH = str.maketrans("：，（）", ":,()")
# Chat tokens and HTML tags that leak into generated text.
CHAT_TOKENS = ("<|assistant|>", "<|endoftext|>", "<|user|>", "<|system|>")
TAGS = "em|p|br|span|div|strong|b|i|u"
COUNTED_TAGS = "em|p|br|span|div"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at either end; null stays null."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def is_blank(c: Column | str) -> Column:
    return ~col(c).rlike(r"(?U)\S")


def ngrams(c: Column | str, n: int) -> Column:
    """All n-grams of characters, in order, with repeats; none if the text is shorter."""
    return F.regexp_extract_all(col(c), F.lit(rf"(?s)(?=(.{{{n}}}))."), F.lit(1))


def ngram_set(c: Column | str, n: int) -> Column:
    return F.array_distinct(ngrams(c, n))


def half_width(c: Column | str) -> Column:
    """The twelve wide marks that break JSON, in half width."""
    return F.translate(col(c), WIDE, HALF)


def strip_fence(c: Column | str) -> Column:
    """Without a code fence around the text."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), r"^```(?:json)?(?U:\s)*\n?", ""), r"\n?```(?U:\s)*$", ""))


def strip_tags(c: Column | str) -> Column:
    return F.regexp_replace(col(c), rf"(?iU)</?(?:{TAGS})>\s*", "")


def drop_trailing_commas(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U),(\s*[\]\}])", "$1")


def clean_generated(c: Column | str) -> Column:
    """Without chat tokens and white space at the ends."""
    out = col(c)
    for t in CHAT_TOKENS:
        out = F.replace(out, F.lit(t), F.lit(""))
    return strip(out)


def english_runs(c: Column | str) -> Column:
    """Runs of four or more ASCII letters."""
    return F.regexp_extract_all(col(c), F.lit("[a-zA-Z]{4,}"), F.lit(0))


def count_matches(c: Column | str, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(col(c), F.lit(pattern), F.lit(0)))


def overlap(a: Column | str, b: Column | str, n: int = 2) -> Column:
    """Shared distinct n-grams over those of the smaller set; 0 where either has none."""
    x, y = ngram_set(a, n), ngram_set(b, n)
    least = F.least(F.size(x), F.size(y))
    return F.when(F.coalesce(least, F.lit(0)) > 0, F.size(F.array_intersect(x, y)) / least).otherwise(F.lit(0.0))


def prompt_lines(*lines: Column) -> Column:
    """Lines joined by line breaks; null lines are left out."""
    return F.concat_ws("\n", *lines)


def ratio_text(a: Column | str, b: Column | str) -> Column:
    """``a/b (p%)`` with one decimal and a guard against 0."""
    x, y = col(a), col(b)
    return F.format_string("%d/%d (%.1f%%)", x, y, 100.0 * x / F.greatest(F.lit(1), y))


def id_number(c: Column | str, sep: str = "_") -> Column:
    """The number after the first ``sep`` of an id; null where there is none."""
    return F.try_element_at(F.split(col(c), sep), F.lit(2)).try_cast("bigint")
