"""Schemas that drift between files.

Lines are loaded as maps from paths to values with their raw types; types are aggregated by
file; each file is compared with the one before it in its feed; then typed columns are
projected, with a report of the values that could not be cast.

A path is a dotted key path, ``[]`` stands for the elements of an array. Null is absence. Lines
that are no whole JSON object are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsumugi.operators.joins import spread_join
from tsumugi.session import cut

KINDS = {str: "string", bool: "boolean", int: "number", float: "number", list: "array", dict: "object"}


def parse(line: str | None) -> dict | None:
    """The object of a line, or None: blank, cut off, no object, not strict JSON, or
    nested deeper than Python can walk (about 300 levels and more)."""

    def refuse(x: str):
        raise ValueError(x)

    try:
        found = json.loads(line, parse_constant=refuse) if line and line.strip() else None
        if found is not None and line.count("[") + line.count("{") > 300:
            canonical(found)  # nested too deep for Python: refused here, not in the middle of a file
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def plain(value: object) -> object:
    """Equal JSON values become equal: 1.0 is 1."""
    if isinstance(value, float) and value.is_integer():
        return int(value)
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, list) else value


def canonical(value: object) -> str:
    return json.dumps(plain(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def paths(value: object, at: str = "") -> Iterator[tuple[str, str, object]]:
    """(path, kind, value) of everything in ``value`` but nulls, without recursion."""
    todo = [(at, value)]
    while todo:
        p, v = todo.pop()
        if v is None:
            continue
        if p:
            yield p, KINDS[type(v)], v
        if isinstance(v, dict):
            todo += [(f"{p}.{k}" if p else k, x) for k, x in v.items()]
        elif isinstance(v, list):
            todo += [(f"{p}[]", x) for x in v]


def _explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for feed, seq, line in zip(pdf["feed"], pdf["file_seq"], pdf["raw_json"]):
            found = parse(line)
            if found is None:
                continue
            key = None if found.get("id") is None else canonical(found["id"])
            seen = set()
            for p, kind, v in paths(found):
                # a value matters for renames alone, which have no [] in their paths
                mark = xxhash.xxh3_128_hexdigest(canonical(v)) if key is not None and "[]" not in p else None
                if mark is not None or (p, kind) not in seen:
                    rows.append((feed, seq, key if mark else None, p, kind, mark))
                    seen.add((p, kind))
        yield pd.DataFrame(rows, columns=["feed", "file_seq", "item", "path", "kind", "mark"])


def _below(path: str, tops: set[str]) -> bool:
    """Whether ``path`` is one of ``tops`` or beneath one."""
    return any(path == t or path.startswith((f"{t}.", f"{t}[]")) for t in tops)


def _settled(changes: list[dict]) -> Iterator[tuple[str, str, str]]:
    """The changes of one file: renames upper paths first, then by name; what they cover goes."""
    maybe = [(x["path"], x["new_path"]) for x in changes if x["change_kind"] == "renamed"]
    old: set[str] = set()
    new: set[str] = set()
    for a, b in sorted(maybe, key=lambda x: (x[0].count("."), x[0], x[1].count("."), x[1])):
        if not _below(a, old) and not _below(b, new):
            old.add(a)
            new.add(b)
            yield a, "renamed", b
    for x in changes:
        a, kind = x["path"], x["change_kind"]
        if kind == "type_changed" or (kind == "removed" and not _below(a, old)) or (kind == "added" and not _below(a, new)):
            yield a, kind, ""


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(name, *x) for name, changes in zip(pdf["file_name"], pdf["changes"]) for x in _settled(list(changes))]
        yield pd.DataFrame(rows, columns=["file_name", "field_path", "change_kind", "new_path"])


def changes(lines: DataFrame) -> DataFrame:
    """(file_name, field_path, change_kind, new_path): every file against the one before it.

    ``lines``: feed, file_seq, file_name, raw_json. change_kind: added, removed, type_changed
    or renamed. Files follow in order of file_seq, whenever they came; rows with a null feed or
    file_seq are left out; a file without a whole line counts as a file without paths. Repeated
    lines change nothing. Records without an id tell nothing of renames.
    """
    src = lines.where("feed is not null and file_seq is not null")
    files = src.groupBy("feed", "file_seq").agg(F.min("file_name").alias("file_name"))
    before = Window.partitionBy("feed").orderBy("file_seq")  # one row a file
    steps = files.withColumn("prev_seq", F.lag("file_seq").over(before)).where("prev_seq is not null")
    cells = cut(src.select("feed", "file_seq", "raw_json").mapInPandas(_explode, "feed string, file_seq int, item string, path string, kind string, mark string"))
    kinds = cells.groupBy("feed", "file_seq", "path").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))  # five kinds at most
    now = kinds.join(steps, ["feed", "file_seq"]).select("feed", "file_seq", "path", F.col("kinds").alias("new_kinds"))
    then = kinds.withColumnRenamed("file_seq", "prev_seq").join(steps, ["feed", "prev_seq"]).select("feed", "file_seq", "path", F.col("kinds").alias("old_kinds"))
    both = now.join(then, ["feed", "file_seq", "path"], "full_outer")
    kind = F.when(F.col("old_kinds").isNull(), "added").when(F.col("new_kinds").isNull(), "removed").otherwise("type_changed")
    changed = cut(both.where("old_kinds is null or new_kinds is null or old_kinds <> new_kinds").select("feed", "file_seq", "path", kind.alias("change_kind")))
    return _with_renames(changed, cells, steps)


def _with_renames(changed: DataFrame, cells: DataFrame, steps: DataFrame) -> DataFrame:
    apart = changed.where("change_kind <> 'type_changed' and not contains(path, '[]')")
    name = lambda seq: F.concat_ws("\x1f", "feed", F.col(seq).cast("string"), "path").alias("k")
    marked = cells.where("item is not null and mark is not null")

    def values(side: str, seq: str) -> DataFrame:
        """(feed, file_seq, item, path, mark) of the lost or gained paths, from their file."""
        which = apart.where(F.col("change_kind") == side).join(steps.select("feed", "file_seq", "prev_seq"), ["feed", "file_seq"])
        keyed = which.select(name(seq), F.col("file_seq").alias("step"))
        # a file may hold a third of all rows: its paths are hot keys
        held = spread_join(marked.select(F.concat_ws("\x1f", "feed", F.col("file_seq").cast("string"), "path").alias("k"), "feed", "item", "path", "mark"), keyed, "k")
        return held.groupBy("feed", "step", "item", "path").agg(F.array_join(F.sort_array(F.collect_set("mark")), " ").alias("mark"))

    items = cells.where("item is not null").select("feed", "file_seq", "item").distinct()
    shared = items.join(steps.select("feed", "file_seq", "prev_seq"), ["feed", "file_seq"]).join(items.withColumnRenamed("file_seq", "prev_seq"), ["feed", "prev_seq", "item"]).select("feed", F.col("file_seq").alias("step"), "item")
    # both are used twice: written once
    lost = cut(values("removed", "prev_seq").join(shared, ["feed", "step", "item"], "left_semi"))
    gained = cut(values("added", "file_seq").join(shared, ["feed", "step", "item"], "left_semi"))
    equal = lost.join(gained.withColumnRenamed("path", "new_path"), ["feed", "step", "item", "mark"]).groupBy("feed", "step", "path", "new_path").agg(F.count("*").alias("n"))
    n_lost = lost.groupBy("feed", "step", "path").agg(F.count("*").alias("n_lost"))
    n_gained = gained.groupBy("feed", "step", F.col("path").alias("new_path")).agg(F.count("*").alias("n_gained"))
    # equal wherever either is there: as many equal pairs as values on either side
    same = equal.join(n_lost, ["feed", "step", "path"]).join(n_gained, ["feed", "step", "new_path"]).where("n = n_lost and n = n_gained")
    rows = changed.select("feed", "file_seq", "path", "change_kind", F.lit("").alias("new_path"))
    renames = same.select("feed", F.col("step").alias("file_seq"), "path", F.lit("renamed").alias("change_kind"), "new_path")
    named = rows.unionByName(renames).join(steps.select("feed", "file_seq", "file_name"), ["feed", "file_seq"])
    # a row has the changed paths of one file; not so few tasks as the bytes suggest, Python reads them
    tasks = max(8, named.sparkSession.sparkContext.defaultParallelism)
    by_file = named.repartition(tasks, "feed", "file_seq").groupBy("feed", "file_seq").agg(F.min("file_name").alias("file_name"), F.collect_list(F.struct("path", "change_kind", "new_path")).alias("changes"))
    return by_file.select("file_name", "changes").mapInPandas(_settle, "file_name string, field_path string, change_kind string, new_path string").distinct()


def path_kinds(lines: DataFrame) -> DataFrame:
    """(feed, relation, path, kind, n): in how many records of a feed a path has a kind."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            count: dict[tuple, int] = {}
            for feed, relation, line in zip(pdf["feed"], pdf["relation"], pdf["raw_json"]):
                for p, kind in {(p, k) for p, k, _ in paths(parse(line) or {})}:
                    count[feed, relation, p, kind] = count.get((feed, relation, p, kind), 0) + 1
            yield pd.DataFrame([(*k, n) for k, n in count.items()], columns=["feed", "relation", "path", "kind", "n"])

    counted = lines.select("feed", "relation", "raw_json").mapInPandas(run, "feed string, relation string, path string, kind string, n bigint")
    return counted.groupBy("feed", "relation", "path", "kind").agg(F.sum("n").alias("n"))


TARGETS = {"string": "string", "number": "double", "boolean": "boolean", "array": "array<string>", "object": "map<string,string>"}


def cast(value: object, kind: str) -> tuple[object, bool]:
    """(value as ``kind``, whether it could be cast); null casts to null."""
    text = lambda v: v if isinstance(v, str) else canonical(v)
    if value is None:
        return None, True
    if kind == "string":
        return text(value), True
    if kind == "number":
        try:
            return (None, False) if isinstance(value, bool | list | dict) else (float(value), True)
        except (ValueError, OverflowError):
            return None, False
    if kind == "boolean":
        known = {True: True, False: False, "true": True, "false": False, "1": True, "0": False, 1: True, 0: False}
        key = value.strip().lower() if isinstance(value, str) else value
        return (known[key], True) if not isinstance(key, list | dict) and key in known else (None, False)
    if kind == "array":
        return ([None if v is None else text(v) for v in value], True) if isinstance(value, list) else ([text(value)], True)
    return ({k: None if v is None else text(v) for k, v in value.items()}, True) if isinstance(value, dict) else (None, False)


def unify(lines: DataFrame, columns: dict[str, str], renames: dict[str, str] | None = None) -> DataFrame:
    """One typed table of all records, with what could not be cast.

    ``columns``: top-level field -> kind (string, number, boolean, array, object); ``renames``:
    later name -> name in ``columns``; where both names are in a record the present name
    counts. Result: feed, file_name, line_no, one typed column a field, ``extra`` (other fields
    as JSON) and ``failed`` (field -> raw JSON of a value that could not be cast, null in its
    column). Lines that are no whole object have no row; repeated lines keep theirs.
    """
    also = renames or {}
    names = list(columns)
    schema = "feed string, file_name string, line_no int, " + "".join(f"`{c}` {TARGETS[k]}, " for c, k in columns.items()) + "extra map<string,string>, failed map<string,string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for feed, file, no, line in zip(pdf["feed"], pdf["file_name"], pdf["line_no"], pdf["raw_json"]):
                found = parse(line)
                if found is None:
                    continue
                moved = {also[k]: v for k, v in found.items() if k in also and found.get(also[k]) is None}
                rest = {k: canonical(v) for k, v in found.items() if k not in columns and k not in also and v is not None}
                failed, values = {}, []
                for c in names:
                    raw = found.get(c) if found.get(c) is not None else moved.get(c)
                    v, ok = cast(raw, columns[c])
                    values.append(v)
                    if not ok:
                        failed[c] = canonical(raw)
                rows.append((feed, file, no, *values, rest, failed))
            yield pd.DataFrame(rows, columns=["feed", "file_name", "line_no", *names, "extra", "failed"])

    return lines.select("feed", "file_name", "line_no", "raw_json").mapInPandas(run, schema)
