"""Row predicates over texts, marker lists and keys, as Catalyst expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tsumugi.functions.text import col, english_runs, strip

PLACEHOLDER = r"(?U)^[\s\.\?…」、,「!！？]+$"
BACKTICK = r"`[^`]*`"
# Names a public set must not hold, and English words that may stand in a response.
FIREWALL = ("ai-chan", "ai_chan", "AiChan", "AI-chan", "AIちゃん", "アイちゃん", "「ai-chan」", "「Ai」")
ENGLISH_ALLOWED = ("sns", "tv", "pc", "ok", "lgbt", "lgbtq")


def markers(values: list[str] | tuple[str, ...]) -> Column:
    """A constant array; its size is that of the list."""
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def contains_any(text: Column | str, values: Column) -> Column:
    """Whether the text holds any marker; an empty marker is in every text."""
    return F.exists(values, lambda m: F.contains(col(text), m))


def matched(text: Column | str, values: Column) -> Column:
    """The markers the text holds, in their order, repeats kept."""
    return F.filter(values, lambda m: F.contains(col(text), m))


def quoted_match(pattern: Column, text: Column) -> Column:
    """Whether the text holds what stands between the first 「 and the first 」 of the pattern.

    False without both; where 」 comes first the quote is empty, and so in every text."""
    a, b = F.instr(pattern, "「"), F.instr(pattern, "」")
    quote = F.substring(pattern, a + 1, F.greatest(b - a - 1, F.lit(0)))
    return F.when((a > 0) & (b > 0), F.contains(text, quote)).otherwise(F.lit(False))


def head_match(pattern: Column, text: Column) -> Column:
    """Whether the text holds the pattern up to its first （, without 「」; only patterns with 「."""
    head = F.replace(F.replace(F.split_part(pattern, F.lit("（"), F.lit(1)), F.lit("「"), F.lit("")), F.lit("」"), F.lit(""))
    return F.contains(pattern, F.lit("「")) & F.contains(text, head)


def any_pattern(values: Column, text: Column, how=quoted_match) -> Column:
    return F.coalesce(F.exists(values, lambda p: how(p, text)), F.lit(False))


def placeholder_only(c: Column | str) -> Column:
    return col(c).rlike(PLACEHOLDER)


def has_backtick(c: Column | str) -> Column:
    return col(c).rlike(BACKTICK)


def firewall_hit(c: Column | str, terms: tuple[str, ...] = FIREWALL) -> Column:
    """Whether the text holds a term; the case matters."""
    return col(c).rlike("|".join(map(re.escape, terms)))


def pattern_hit(c: Column | str, patterns: list[str]) -> Column:
    """Whether the text holds one of the regular expressions, given from outside; none without any."""
    return col(c).rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def foreign_run(c: Column | str, allowed: tuple[str, ...] = ENGLISH_ALLOWED) -> Column:
    """Whether a run of four or more ASCII letters is not allowed."""
    return F.exists(english_runs(c), lambda w: ~F.lower(w).isin(*allowed))


def bad_list(c: Column | str) -> Column:
    """Whether any entry of a list is null, blank, a mere placeholder, code, or short English."""

    def bad(x: Column) -> Column:
        s = strip(x)
        return x.isNull() | (s == "") | s.rlike(PLACEHOLDER) | s.rlike(BACKTICK) | (s.rlike("[a-zA-Z]{4,}") & (F.length(s) < 30))

    return col(c).isNull() | F.exists(col(c), lambda x: F.coalesce(bad(x), F.lit(True)))


def bad_response(c: Column | str, axis: Column | str) -> Column:
    """Whether an ideal response is an artifact; silence may be short."""
    s = strip(c)
    return ((col(axis) != "silence") & (s.rlike(PLACEHOLDER) | (F.length(s) < 8))) | s.rlike(BACKTICK) | foreign_run(s)


def missing_keys(present: Column, required: list[str]) -> Column:
    """The required keys that are not present, sorted and joined by commas; '' for none."""
    return F.array_join(F.array_sort(F.array_except(markers(required), present)), ",")


def natural_end(c: Column | str) -> Column:
    s = strip(c)
    return s.rlike(r"[。！？\.\!\?]$") | (F.length(s) < 30)
