"""Visually identical text with different characters: one consistent form.

A transducer is compiled once from rules: it maps grapheme clusters (a character with its marks,
and what is hidden between them) to their consistent form, marks in canonical order, longest match
first, in one pass over the text. The compiler rejects contradictory rules and maps that are not
closed (the form of a form must be itself). Widths, composed and decomposed marks, compatibility
radicals and kinds of space get one form; invisible characters vanish.

Letters drawn alike in several scripts have no form of their own: what stands around them tells,
never which of them was written, so texts that look alike meet and words keep their script. A run
of such letters is read by the nearest letters on either side that are not drawn like others
(kana beside kana, a kanji beside kanji, a Latin letter in a Latin word, a hyphen between Latin
letters and digits).
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsumugi.functions.letters import PLANES
from tsumugi.operators.joins import spread_join

# Letters of other scripts drawn like a Latin letter, and the Latin letter.
LATIN_ALIKE = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "Ϲ": "C",
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ԁ": "D", "Ү": "Y",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "ё": "ë", "ї": "ï", "ѐ": "è", "Ё": "Ë", "Ї": "Ï",
    "Ⅰ": "I", "Ⅴ": "V", "Ⅹ": "X", "Ⅼ": "L", "Ⅽ": "C", "Ⅾ": "D", "Ⅿ": "M", "ⅰ": "i", "ⅴ": "v", "ⅹ": "x", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m", "ı": "i", "ɡ": "g", "ɑ": "a", "K": "K", "Å": "Å",
}
# Kanji, hiragana and strokes drawn like a katakana letter, and the katakana letter.
KANA_ALIKE = {"力": "カ", "口": "ロ", "囗": "ロ", "二": "ニ", "八": "ハ", "夕": "タ", "工": "エ", "卜": "ト", "丿": "ノ", "才": "オ", "三": "ミ", "千": "チ", "へ": "ヘ", "べ": "ベ", "ぺ": "ペ"}
# Of these, the numerals, and those that end words of kanji.
NUMERALS, ENDINGS = "二三八千", "力口"
# Katakana that follow a kanji numeral (三ツ星, 八ヶ岳).
COUNTERS = "ヶヵツノケ"
# Signs drawn as one level stroke that are no dash by their category.
DASHES_ALSO = "─━⁃˗﹣−➖"
STROKES = "ー一"
WAVES = "〜~"
INVISIBLE_ALSO = "ᅟᅠㅤﾠ͏឴឵"
#: Code points with anything to map: the planes of letters, and that of tags and selectors.
POINTS = (*range(PLANES), *range(0xE0000, 0xE1000))
ZWJ = "‍"


class Conflict(ValueError):
    """Two rules give one cluster different forms, or a form is not its own form."""


def _rules():
    """(cluster, form) of every rule; forms may still need another rule."""
    for i in POINTS:
        ch = chr(i)
        kind = unicodedata.category(ch)
        if kind == "Cf" or ch in INVISIBLE_ALSO or 0xFE00 <= i <= 0xFE0F or 0xE0100 <= i <= 0xE01EF or 0x180B <= i <= 0x180F:
            yield ch, ""
        elif kind == "Zs" and ch not in INVISIBLE_ALSO:
            yield ch, " "
        elif (kind == "Pd" and ch not in "〜〰゠") or ch in DASHES_ALSO:
            if ch != "-":
                yield ch, "―" if ch not in "‐‑－﹣﹘" else "-"
        elif ch in "㇐丨～":
            yield ch, {"㇐": "一", "丨": "｜", "～": "〜"}[ch]
        else:
            how = unicodedata.decomposition(ch)
            if how.startswith(("<wide>", "<narrow>", "<font>")) or 0x2E80 <= i <= 0x2FDF or 0xF900 <= i <= 0xFAFF or 0x2F800 <= i <= 0x2FA1F:
                to = unicodedata.normalize("NFKC", ch)
                if to != ch:
                    yield ch, to
            if how and not how.startswith("<"):
                apart = unicodedata.normalize("NFD", ch)
                whole = unicodedata.normalize("NFC", apart)
                if whole == ch and len(apart) > 1:
                    yield apart, ch
                    voiced = apart.replace("゙", "ﾞ").replace("゚", "ﾟ")
                    if voiced != apart:  # a mark of half width after a letter of either width
                        yield voiced, ch
                elif whole != ch:
                    yield ch, whole
    # a sound mark makes a katakana of what is drawn like one
    for a, b in KANA_ALIKE.items():
        for mark, half in (("゙", "ﾞ"), ("゚", "ﾟ")):
            whole = unicodedata.normalize("NFC", b + mark)
            if len(whole) == 1 and a not in "へべぺ":
                yield a + mark, whole
                yield a + half, whole
    # a lone mark of half width, and half-width letters with either mark
    for i in range(0xFF66, 0xFF9E):
        full = unicodedata.normalize("NFKC", chr(i))
        for mark, half in (("゙", "ﾞ"), ("゚", "ﾟ")):
            whole = unicodedata.normalize("NFC", full + mark)
            if len(whole) == 1:
                yield chr(i) + half, whole
                yield chr(i) + mark, whole


@functools.cache
def compile_map() -> dict[str, str]:
    """The checked map from clusters to closed forms."""
    table: dict[str, str] = {}
    for a, b in _rules():
        if table.setdefault(a, b) != b and unicodedata.normalize("NFKC", table[a]) != unicodedata.normalize("NFKC", b):
            raise Conflict(f"{a!r}: {table[a]!r} and {b!r}")
    variants: dict[str, list[str]] = {}
    for a, b in table.items():
        if len(a) == len(b) == 1:
            variants.setdefault(b, []).append(a)
    for a, b in list(table.items()):  # marks on another form of the base
        if len(a) > 1:
            for v in variants.get(a[0], ()):
                table.setdefault(v + a[1:], b)
    for a in table:
        seen, form = {a}, table[a]
        while (then := "".join(table.get(x, x) for x in form)) != form:
            if then in seen:
                raise Conflict(f"{a!r} has no end: {form!r}, {then!r}")
            seen.add(then)
            form = then
        table[a] = form
    return {a: b for a, b in table.items() if a != b}


def _ranges(points: set[int]) -> str:
    """The inside of a character class: short, so that a test of it is quick."""
    out = []
    for i in sorted(points):
        if out and out[-1][1] == i - 1:
            out[-1][1] = i
        else:
            out.append([i, i])
    return "".join(re.escape(chr(a)) + (f"-{re.escape(chr(b))}" if b > a else "") for a, b in out)


@functools.cache
def transducer() -> tuple[re.Pattern, re.Pattern, dict[str, str], dict[int, str], re.Pattern]:
    """What tells that a text has clusters, the pattern of those that need the map, the map of
    clusters and of single characters, and what is hidden."""
    table = compile_map()
    hide = {ord(a) for a, b in table.items() if b == "" and len(a) == 1} | {ord(ZWJ)}
    mark = {i for i in POINTS if unicodedata.combining(chr(i))} | {ord(x) for a in table for x in a[1:]}
    hidden, marks = _ranges(hide), _ranges(mark)
    # one test of a character below 0x10000 costs the same however many the class has
    some = re.compile(f"[{_ranges({i for i in hide | mark if i < 0x10000})}]|[\U00010000-\U0010ffff]")
    # a joiner shows only between pictographs: those sequences stay as they are
    picto = "[\U0001f000-\U0001faff☀-➿]"
    joined = f"(?P<keep>{picto}[\ufe0e\ufe0f]?(?:{ZWJ}{picto}[\ufe0e\ufe0f]?)+)"
    clusters = re.compile(f"{joined}|(?:[^{marks}{hidden}][{hidden}]*)?[{marks}][{marks}{hidden}]*|[{hidden}]+", re.S)
    return some, clusters, table, {ord(a): b for a, b in table.items() if len(a) == 1 and b}, re.compile(f"[{hidden}]+")


def _cluster(m: re.Match) -> str:
    """The longest known start of a cluster, its marks in canonical order, gets its form; the
    marks left over stay."""
    return m[0] if m["keep"] else _formed(m[0])


@functools.lru_cache(1 << 14)
def _formed(cluster: str) -> str:
    _, _, table, single, hidden = transducer()
    whole = unicodedata.normalize("NFC", hidden.sub("", cluster).replace("ﾞ", "\u3099").replace("ﾟ", "\u309a"))
    for n in range(len(whole), 1, -1):
        if (to := table.get(whole[:n])) is not None:
            return unicodedata.normalize("NFC", to + whole[n:])
    return unicodedata.normalize("NFC", whole.translate(single))


KATA = {b: a for a, b in KANA_ALIKE.items() if a != "囗"}  # katakana -> what it is drawn like
CYRILLIC = {b: a for a, b in LATIN_ALIKE.items() if "\u0400" <= a <= "\u04ff"}
GREEK = {b: a for a, b in LATIN_ALIKE.items() if "\u0370" <= a <= "\u03ff"}
ALIKE = "".join(KANA_ALIKE) + "".join(KATA)
LEVEL = STROKES + "-―"
RUNS = re.compile(f"[{re.escape(ALIKE + LEVEL)}]+|[{WAVES}]+")
WORDS = re.compile("[^\\W\\d_ぁ-ヿ一-鿿][^\\W\\d_ぁ-ヿ一-鿿\u0300-\u036f]*(?:[\u0300-\u036f]+[^\\W\\d_ぁ-ヿ一-鿿]*)*")


def _kind(ch: str) -> str:
    """k: katakana drawn like nothing else, h: hiragana, j: kanji, a: Latin letter or digit."""
    if not ch:
        return ""
    if "ァ" <= ch <= "ヺ":
        return "k"
    if "ぁ" <= ch <= "ゖ":
        return "h"
    if "一" <= ch <= "鿿" or ch in "々〆":
        return "j"
    return "a" if ch.isascii() and ch.isalnum() else ""


@functools.lru_cache(1 << 14)
def _word(word: str) -> str:
    """A word in one script, that of its letters which are drawn like no other."""
    if word.isascii() or not any(x in LATIN_ALIKE for x in word):
        own = {unicodedata.name(x, "?").split()[0] for x in word if not x.isascii()}
        if not own & {"CYRILLIC", "GREEK"}:
            return word
    plain = {unicodedata.name(x, "?").split()[0] for x in word if x not in LATIN_ALIKE and x not in CYRILLIC and x not in GREEK}
    if "LATIN" in plain or not plain & {"CYRILLIC", "GREEK"}:
        return "".join(LATIN_ALIKE.get(x, x) for x in word)
    back = CYRILLIC if "CYRILLIC" in plain else GREEK
    return "".join(back.get(LATIN_ALIKE.get(x, x), x) for x in word)


def _run(m: re.Match) -> str:
    a, b, text = m.start(), m.end(), m.string
    return _read(m[0], text[a - 1 : a] if a else "", text[b : b + 1], text[b + 1 : b + 2])


@functools.lru_cache(1 << 16)
def _read(run: str, left: str, right: str, after: str) -> str:
    """A run of letters and strokes drawn alike, read by what stands on either side."""
    lk, rk = _kind(left), _kind(right)
    if run[0] in WAVES:
        return ("~" if "a" in (lk, rk) or (left + right).isascii() and left + right else "〜") * len(run)
    own = [KATA.get(x, x) for x in run if x in ALIKE]
    own = ["口" if x == "囗" else x for x in own]
    left_k, right_k = lk == "k", rk == "k" and not (right in COUNTERS and _kind(after) != "k")
    if not own:
        kana = False
    elif all(x in NUMERALS for x in own):
        kana = (left_k and rk != "j") or (right_k and lk != "j")
    elif lk == "j":
        kana = right_k and own[0] not in ENDINGS + NUMERALS
    else:
        kana = left_k or right_k or (len(own) > 1 and own[0] not in NUMERALS and not all(x in "へべぺ" for x in own))
    out: list[str] = []
    letters_ = [("口" if x == "囗" else KATA.get(x, x)) if x in ALIKE else None for x in run]
    shown = [(KANA_ALIKE[x] if kana else x) if x else None for x in letters_]
    for i, x in enumerate(shown):
        if x is not None:
            out.append(x)
            continue
        a = i - 1
        while a >= 0 and shown[a] is None:
            a -= 1
        b = i + 1
        while b < len(shown) and shown[b] is None:
            b += 1
        before = _kind(shown[a]) if a >= 0 else lk
        behind = _kind(shown[b]) if b < len(shown) else rk
        several = b - a > 2  # two strokes and more are a dash
        letter = run[i] in STROKES
        if before == "k" or (before == "h" and behind != "j"):
            out.append("-" if behind == "a" and not letter else "―" if several and not letter else "ー")
        elif "a" in (before, behind):
            out.append("-")
        elif letter and (run[i] == "一" or before or behind):
            out.append("一")
        else:
            out.append("―")
    return "".join(out)


def consistent(text: str | None) -> str | None:
    """The consistent form of ``text``; null stays null, empty stays empty."""
    if not text:
        return text
    some, clusters, _, single, _ = transducer()
    if not text.isascii():
        if some.search(text):
            text = clusters.sub(_cluster, text)
        text = text.translate(single)
        if (words := WORDS.sub(lambda m: _word(m[0]), text)) != text:
            text = unicodedata.normalize("NFC", words)
    elif not ("-" in text or "~" in text):
        return text
    return RUNS.sub(_run, text)


@F.pandas_udf(T.StringType())
def consistent_form(text: pd.Series) -> pd.Series:
    return text.map(consistent, na_action="ignore")


def unify(df: DataFrame, fields: list[str], suffix: str = "_form") -> DataFrame:
    """``df`` with the consistent form of each field in ``<field><suffix>``.

    Null gives null and an empty text an empty form. An existing column of the new name is
    replaced; other columns stay.
    """
    return df.withColumns({f + suffix: consistent_form(F.col(f"`{f}`")) for f in fields})


def alike_pairs(df: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """(field, id_a, id_b): different keys whose text in one field reads alike but differs.

    Rows with a null key or text have no pair; an empty text pairs with texts of nothing but
    invisible characters. Repeated rows count once. Identical strings are never compared: the
    distinct strings of a form are paired first, then each string brings its keys, so a string
    held by a third of all rows costs no more than the pairs it really has.
    """
    k = F.col(f"`{key}`").cast("string")
    cells = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("text")) for f in fields)))
    held = df.select(k.alias("k"), cells.alias("c")).where("k is not null and c.text is not null").select("k", "c.field", "c.text").distinct()
    texts = held.select("field", "text").distinct().withColumn("form", consistent_form("text"))
    hashed = texts.select("field", F.xxhash64("form").alias("f1"), F.hash("form").alias("f2"), F.sha2("text", 256).alias("t"))
    # only forms with several strings go on; each string meets the others of its form in a join
    # of its own parts, so no row holds a form's strings
    form = ["field", "f1", "f2"]
    several = hashed.groupBy(*form).agg(F.count("*").alias("n")).where("n > 1").select(*form)
    strings = hashed.join(several, form, "left_semi")
    pairs = spread_join(strings.withColumn("form", F.concat_ws("/", *form)), strings.select(F.concat_ws("/", *form).alias("form"), F.col("t").alias("u")), "form").where("t <> u").select("field", "t", "u")
    members = held.select("field", "k", F.sha2("text", 256).alias("t"))
    left = pairs.join(members, ["field", "t"]).select("field", "u", F.col("k").alias("a"))
    both = left.join(members.select("field", F.col("t").alias("u"), F.col("k").alias("b")), ["field", "u"])
    return both.where("a < b").select("field", F.col("a").alias("id_a"), F.col("b").alias("id_b")).distinct()


def classes(df: DataFrame, field: str, key: str = "id") -> DataFrame:
    """(key, class_id, n_strings, n_rows): one row a key, its class of alike texts and the
    class's size, without expanding pairs. Null texts are left out."""
    k = F.col(f"`{key}`").cast("string").alias("key")
    rows = df.select(k, F.col(f"`{field}`").alias("text")).where("key is not null and text is not null").distinct()
    rows = rows.withColumn("class_id", F.sha2(consistent_form("text"), 256))
    sizes = rows.groupBy("class_id").agg(F.countDistinct("text").alias("n_strings"), F.count("*").alias("n_rows"))
    return rows.join(sizes, "class_id").select("key", "class_id", "n_strings", "n_rows")
