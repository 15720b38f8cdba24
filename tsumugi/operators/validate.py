"""Validation and cleaning: each row gets its first failing reason."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsumugi.functions.text import col
from tsumugi.operators.predicates import FIREWALL, bad_list, bad_response, firewall_hit, has_backtick, missing_keys
from tsumugi.operators.schema_drift import parse

# The axes in their order, and the keys of the kinds of items.
AXES = ("family", "keigo", "silence", "compassion", "local_culture", "nuance", "generation_gap", "workplace")
STANDARD = ["id", "axis", "context", "expected_qualities", "anti_patterns", "ideal_response_example"]
NEEDED = ["context", "expected_qualities", "anti_patterns", "ideal_response_example"]
LISTS = [("expected_qualities", "eq"), ("anti_patterns", "ap")]
KEIGO_LEGACY = ["id", "level_required", "scenario", "user", "expected_response", "evaluation"]
SILENCE_LEGACY = ["id", "category", "context", "user", "ideal_action", "ideal_response_examples", "anti_patterns", "rubric"]


def present(df: DataFrame, names: list[str] | None = None) -> Column:
    """The names of the columns that are not null in a row."""
    cols = [c for c in (names or df.columns) if c in df.columns]
    return F.filter(F.array(*(F.when(F.col(f"`{c}`").isNotNull(), F.lit(c)) for c in cols)), lambda x: x.isNotNull())


def _leaves(c: Column, kind: T.DataType) -> Column | None:
    """The strings in a value of any nested type, as an array; None where it can hold none."""
    none = F.array().cast("array<string>")
    if isinstance(kind, T.StringType):
        return F.array(c)
    if isinstance(kind, T.StructType):
        parts = [p for f in kind if (p := _leaves(c[f.name], f.dataType)) is not None]
        return F.coalesce(F.concat(*parts), none) if parts else None
    if isinstance(kind, T.MapType):
        return _leaves(F.map_values(c), T.ArrayType(kind.valueType))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType):
            return F.coalesce(c, none)
        if _leaves(F.lit(None), kind.elementType) is not None:
            return F.coalesce(F.flatten(F.transform(c, lambda x: _leaves(x, kind.elementType))), none)
    return None


def leaves(df: DataFrame) -> Column:
    """All strings of a row, however deep, joined by spaces; keys of maps are none."""
    parts = [p for f in df.schema if (p := _leaves(F.col(f"`{f.name}`"), f.dataType)) is not None]
    return F.concat_ws(" ", *parts)


def item_reason(df: DataFrame, needed: list[str] | None = None, firewall: tuple[str, ...] = FIREWALL) -> Column:
    """Why an item is not valid, or 'ok'; rules in fixed order, the first that fails counts."""
    needed = needed or NEEDED
    eq, ap, ire, ctx = (F.col(c) for c in ("expected_qualities", "anti_patterns", "ideal_response_example", "context"))
    gone = missing_keys(present(df, needed), needed)
    shape = lambda a: F.exists(a, lambda x: x.isNull() | ~F.length(x).between(2, 100))
    return (
        F.when(gone != "", F.concat(F.lit("missing:"), gone))
        .when(~F.size(eq).between(2, 6), F.format_string("eq-len:%d", F.size(eq)))
        .when(~F.size(ap).between(2, 6), F.format_string("ap-len:%d", F.size(ap)))
        .when(shape(eq), "eq-item-shape")
        .when(shape(ap), "ap-item-shape")
        .when(~F.length(ire).between(5, 500), F.format_string("ire-len:%d", F.length(ire)))
        .when(F.length(ctx) < 5, "ctx-too-short")
        .when(firewall_hit(leaves(df), firewall), "firewall-hit")
        .otherwise("ok")
    )


def strings(value: object) -> Iterator[str]:
    """All strings in a value read from JSON, in order, however deep."""
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict | list):
        for x in value.values() if isinstance(value, dict) else value:
            yield from strings(x)


def _text(value: object, low: int, high: float) -> bool:
    return isinstance(value, str) and low <= len(value) <= high


#: Rules for an object read from JSON, in order: what is wrong, and the reason it then has.
OBJECT_RULES: list[tuple[Callable[[dict], bool], Callable[[dict], str]]] = [
    (lambda x: not set(NEEDED) <= x.keys(), lambda x: "missing:" + ",".join(sorted(set(NEEDED) - x.keys()))),
    *((lambda x, k=k: not isinstance(x[k], list), lambda x, s=s: f"{s}-not-list") for k, s in LISTS),
    *((lambda x, k=k: not 2 <= len(x[k]) <= 6, lambda x, k=k, s=s: f"{s}-len:{len(x[k])}") for k, s in LISTS),
    *((lambda x, k=k: not all(_text(e, 2, 100) for e in x[k]), lambda x, s=s: f"{s}-item-shape") for k, s in LISTS),
    (lambda x: not _text(x["ideal_response_example"], 5, 500), lambda x: f"ire-len:{len(v) if isinstance(v := x['ideal_response_example'], str) else 'N/A'}"),
    (lambda x: not _text(x["context"], 5, float("inf")), lambda x: "ctx-too-short"),
]


def object_reason(item: object, firewall: tuple[str, ...] = FIREWALL) -> str:
    """:func:`item_reason` of a value read from JSON, whose fields may have any type."""
    if not isinstance(item, dict):
        return "not-a-dict"
    for wrong, reason in OBJECT_RULES:
        if wrong(item):
            return reason(item)
    blob = " ".join(strings(item))
    return "firewall-hit" if any(t in blob for t in firewall) else "ok"


def object_valid_v1(item: object, firewall: tuple[str, ...] = FIREWALL) -> bool:
    """The older rule: the needed keys, lists of two or more, a response of 5 to 500 characters,
    and no firewall term in a string or a list of strings."""
    if not isinstance(item, dict) or not set(NEEDED) <= item.keys():
        return False
    if not all(isinstance(item[k], list) and len(item[k]) >= 2 for k, _ in LISTS):
        return False
    if not _text(item["ideal_response_example"], 5, 500):
        return False
    flat = [x for v in item.values() for x in (v if isinstance(v, list) else [v]) if isinstance(x, str)]
    return not any(t in " ".join(flat) for t in firewall)


def line_reasons(df: DataFrame, line: str, firewall: tuple[str, ...] = FIREWALL) -> DataFrame:
    """(reason, valid_v1) a line of JSON: :func:`object_reason` and the older rule; both null
    where the line is none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            read = [parse(x) for x in pdf[line]]
            rows = [(None, None) if x is None else (object_reason(x, firewall), object_valid_v1(x, firewall)) for x in read]
            yield pd.DataFrame(rows, columns=["reason", "valid_v1"])

    return df.select(line).mapInPandas(run, "reason string, valid_v1 boolean")


def clean_reason(df: DataFrame, axis: Column | str) -> Column:
    """Why an item is dropped in cleaning, or 'ok'."""
    v = item_reason(df)
    return (
        F.when(v != "ok", F.concat(F.lit("schema:"), v))
        .when(bad_list("expected_qualities"), "eq-placeholder")
        .when(bad_list("anti_patterns"), "ap-placeholder")
        .when(bad_response("ideal_response_example", axis), "ire-artifact")
        .when(has_backtick("context"), "ctx-backtick")
        .otherwise("ok")
    )


def schema_kind(df: DataFrame) -> Column:
    """standard, keigo_legacy, silence_legacy or missing:<keys of standard>."""
    have = present(df)
    lacks = lambda keys: missing_keys(have, keys)
    return F.when(lacks(STANDARD) == "", "standard").when(lacks(KEIGO_LEGACY) == "", "keigo_legacy").when(lacks(SILENCE_LEGACY) == "", "silence_legacy").otherwise(F.concat(F.lit("missing:"), lacks(STANDARD)))


def duplicate_ids(df: DataFrame, key: str = "id") -> DataFrame:
    """(key, n) of the ids that stand more than once."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def count_check(df: DataFrame, expected: DataFrame, by: str) -> DataFrame:
    """(by, n, expected, ok): counts against expected counts, groups of either side."""
    n = df.groupBy(by).agg(F.count("*").alias("n"))
    both = n.join(expected.select(by, "expected"), by, "full_outer").na.fill({"n": 0})
    return both.select(by, "n", "expected", F.coalesce(F.col("n") == F.col("expected"), F.lit(False)).alias("ok"))


def audit(df: DataFrame, by: str, duplicate: Column) -> DataFrame:
    """A row a group: items, valid ones, firewall hits, duplicates, short and long responses."""
    reason = item_reason(df)
    length = F.length("ideal_response_example")
    marked = df.select(F.col(by), reason.alias("r"), firewall_hit(leaves(df)).alias("f"), duplicate.alias("d"), length.alias("n"))
    return marked.groupBy(by).agg(F.count("*").alias("items"), F.count_if(F.col("r") == "ok").alias("valid"), F.count_if("f").alias("firewall_hits"), F.count_if("d").alias("duplicates"), F.count_if(F.col("n") < 10).alias("ire_short"), F.count_if(F.col("n") > 280).alias("ire_long"))


def total_check(df: DataFrame, master: DataFrame, by: str) -> DataFrame:
    """One row: rows in the groups together, rows in the master, whether they agree."""
    parts = df.where(F.col(by).isNotNull()).agg(F.count("*").alias("parts"))
    return parts.crossJoin(master.agg(F.count("*").alias("master"))).withColumn("ok", F.col("parts") == F.col("master"))  # one row each


def file_errors(lines: DataFrame, axes: tuple[str, ...] = AXES) -> DataFrame:
    """(file, line_no, error) of lines (file, line_no, line): no JSON object, missing fields of
    every kind of item, an unknown axis, or a list that is none. Blank lines are no error."""

    def check(line: str) -> list[str]:
        found = parse(line)
        if found is None:
            return ["bad JSON"]
        have = {k for k, v in found.items() if v is not None}
        out = []
        if not any(have >= set(keys) for keys in (STANDARD, KEIGO_LEGACY, SILENCE_LEGACY)):
            out.append("missing " + ",".join(sorted(set(STANDARD) - have)))
        if found.get("axis") and found["axis"] not in axes:
            out.append(f"unknown axis {found['axis']}")
        return out + [f"{k} not a list" for k in ("expected_qualities", "anti_patterns") if k in have and not isinstance(found[k], list)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f, n, e) for f, n, x in zip(pdf["file"], pdf["line_no"], pdf["line"]) if x and x.strip() for e in check(x)]
            yield pd.DataFrame(rows, columns=["file", "line_no", "error"])

    return lines.select(F.col("file").cast("string"), F.col("line_no").cast("bigint").alias("line_no"), "line").mapInPandas(run, "file string, line_no bigint, error string")


def first_errors(errors: DataFrame, order: list[str], n: int = 20) -> DataFrame:
    """The first errors, as a report shows them."""
    return errors.orderBy(*order).limit(n)


def axis_order(axis: Column | str, axes: tuple[str, ...] = AXES) -> Column:
    """The place of an axis in the fixed order; unknown ones come last."""
    at = F.array_position(F.array(*map(F.lit, axes)), F.coalesce(col(axis), F.lit("")))
    return F.when(at > 0, at).otherwise(F.lit(len(axes) + 1))
