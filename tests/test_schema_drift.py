import json
import random

from tsumugi.operators import schema_drift as sd


def walk(v, at=""):
    if v is None:
        return
    if at:
        yield at, sd.KINDS[type(v)], v
    if isinstance(v, dict):
        for k, x in v.items():
            yield from walk(x, f"{at}.{k}" if at else k)
    if isinstance(v, list):
        for x in v:
            yield from walk(x, at + "[]")


def brute(rows):
    """The rules, file by file."""
    feeds = {}
    for feed, seq, name, _, raw in rows:
        files = feeds.setdefault(feed, {}).setdefault(seq, (name, []))
        try:
            v = json.loads(raw)
            if isinstance(v, dict):
                files[1].append(v)
        except (ValueError, TypeError):
            pass
    out = set()
    for files in feeds.values():
        order = sorted(files)
        for a, b in zip(order, order[1:]):
            name = files[b][0]
            kinds, ids = [], []
            for q in (a, b):
                k, i = {}, {}
                for r in files[q][1]:
                    for p, kind, v in walk(r):
                        k.setdefault(p, set()).add(kind)
                        if r.get("id") is not None:
                            i.setdefault(sd.canonical(r["id"]), {})[p] = sd.canonical(v)
                kinds.append(k)
                ids.append(i)
            lost, gained = kinds[0].keys() - kinds[1].keys(), kinds[1].keys() - kinds[0].keys()
            shared = ids[0].keys() & ids[1].keys()
            pairs = []
            for x in lost:
                for y in gained:
                    if "[]" in x + y:
                        continue
                    vs = [(ids[0][i].get(x), ids[1][i].get(y)) for i in shared]
                    vs = [v for v in vs if v != (None, None)]
                    if vs and all(s == t for s, t in vs):
                        pairs.append((x.count("."), x, y.count("."), y))
            old, new = [], []
            under = lambda p, tops: any(p == t or p.startswith((t + ".", t + "[]")) for t in tops)
            for _, x, _, y in sorted(pairs):
                if not under(x, old) and not under(y, new):
                    old.append(x)
                    new.append(y)
                    out.add((name, x, "renamed", y))
            out |= {(name, x, "removed", "") for x in lost if not under(x, old)}
            out |= {(name, y, "added", "") for y in gained if not under(y, new)}
            out |= {(name, x, "type_changed", "") for x in kinds[0].keys() & kinds[1].keys() if kinds[0][x] != kinds[1][x]}
    return out


SCHEMA = "feed string, file_seq int, file_name string, line_no int, raw_json string"


def changes(spark, rows):
    got = [tuple(r) for r in sd.changes(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_random_feeds(spark):
    rng = random.Random(1)
    rows = []
    for feed in range(4):
        names = {"a": "a", "b": "b", "o": "o", "l": "l", "o.x": "x", "o.y": "y"}
        for seq in range(1, 6):
            if rng.random() < 0.7:
                k = rng.choice(list(names))
                names[k] = names[k] + rng.choice("pq")
            gone = rng.choice([None, None, "a", "l", "b"])
            for i in range(8):
                key = (seq * 5 + i) if rng.random() < 0.9 else None
                base = random.Random(f"{feed}-{key}")
                r = {"id": key, names["a"]: base.choice(["u", "v", 1, None]), names["b"]: base.random() < 0.5, names["o"]: {names["o.x"]: base.choice([1, 2.0, None]), names["o.y"]: [base.choice(["z", 1, None])]}, names["l"]: [{"k": 1}] * base.randint(0, 2)}
                if gone:
                    r.pop(names[gone], None)
                rows.append((f"f{feed}", seq, f"f{feed}_{seq}", i, json.dumps(r)))
            rows += [rows[-1], (f"f{feed}", seq, f"f{feed}_{seq}", 90, ""), (f"f{feed}", seq, f"f{feed}_{seq}", 91, '{"cut": '), (f"f{feed}", seq, f"f{feed}_{seq}", 92, None), (f"f{feed}", seq, f"f{feed}_{seq}", 93, "[1]")]
    rng.shuffle(rows)
    want = brute(rows)
    assert changes(spark, rows) == want and {k for _, _, k, _ in want} == {"added", "removed", "renamed", "type_changed"}


def test_driver_table(spark, sf):
    df = spark.read.parquet(f"{sf}/raw_records.parquet").select("feed", "file_seq", "file_name", "line_no", "raw_json")
    assert {tuple(r) for r in sd.changes(df).collect()} == brute([tuple(r) for r in df.collect()])


def test_rename_of_an_object_covers_what_is_beneath(spark):
    rows = [("f", 1, "one", 1, '{"id":1,"r":{"e":"x","w":[1]}}'), ("f", 2, "two", 1, '{"id":1,"s":{"e":"x","w":[1]}}')]
    assert changes(spark, rows) == {("two", "r", "renamed", "s")}


def test_edges(spark):
    assert changes(spark, []) == set()
    one = [("f", 1, "one", 1, '{"id":1}'), (None, 2, "x", 1, '{"id":1}'), ("f", None, "x", 1, '{"q":1}')]
    assert changes(spark, one) == set()
    deep = "[" * 3000 + "]" * 3000
    rows = [("f", 1, "one", 1, '{"id":1,"a":NaN}'), ("f", 3, "three", 1, '{"id":1,"t":"' + "長" * 100_000 + '"}'), ("f", 3, "three", 2, '{"id":1,"d":' + deep + "}")]
    assert ("three", "t", "added", "") in changes(spark, rows)


def test_unified_table(spark):
    rows = [("f", 1, "one", 1, '{"id":"a","n":"3","b":"true","l":"x","z":9}'), ("f", 1, "one", 2, '{"id":"b","m":4.5,"b":"perhaps","o":{"k":1},"extra":[1]}'), ("f", 1, "one", 3, ""), ("f", 1, "one", 1, '{"id":"a","n":"3","b":"true","l":"x","z":9}')]
    got = sd.unify(spark.createDataFrame(rows, SCHEMA), {"id": "string", "n": "number", "b": "boolean", "l": "array", "o": "object"}, {"m": "n"}).collect()
    a, b = got[0], got[1]
    assert len(got) == 3 and (a.n, a.b, a.l, a.extra, a.failed) == (3.0, True, ["x"], {"z": "9"}, {})
    assert (b.n, b.b, b.o, b.extra, b.failed) == (4.5, None, {"k": "1"}, {"extra": "[1]"}, {"b": '"perhaps"'})


def test_path_kinds(spark):
    rows = [("f", "r", '{"a":[1,"x"],"b":null}'), ("f", "r", '{"a":"y"}'), ("f", "r", None)]
    got = {tuple(r) for r in sd.path_kinds(spark.createDataFrame(rows, "feed string, relation string, raw_json string")).collect()}
    assert got == {("f", "r", "a", "array", 1), ("f", "r", "a", "string", 1), ("f", "r", "a[]", "number", 1), ("f", "r", "a[]", "string", 1)}
