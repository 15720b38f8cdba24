import json
import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tsumugi.functions import letters as lt
from tsumugi.functions import text as tx
from tsumugi.operators import construct, contamination, generate, judge, scoring, summary, validate
from tsumugi.operators import predicates as pr
from tsumugi.operators.joins import spread_join
from tsumugi.sources import jsonl


@given(st.text(max_size=60), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_ngram_hashes_tell_grams_apart(t, n):
    codes = lt.letter_codes(t)
    s = codes.tobytes().decode("utf-32-le")
    h = lt.ngram_hashes(codes, n)
    grams = [s[i : i + n] for i in range(len(s) - n + 1)]
    assert len(h) == len(grams) and len(set(h.tolist())) == len(set(grams))
    assert all(unicodedata.category(x)[0] in "LN" for x in s)


@given(st.text("abc", max_size=14), st.text("abc", max_size=14))
@settings(max_examples=100, deadline=None)
def test_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    assert lt.lcs_length(a, b) == row[-1]


def reason(text):
    r = text.strip()
    if not r:
        return "empty"
    if any(m in r for m in scoring.ECHOES):
        return "template_echo"
    lines = [x.strip() for x in r.split("\n") if x.strip()]
    most = max(map(lines.count, lines))
    if most >= 3:
        return f"line_repeated_{most}x"
    if len(r) > 50:
        for n in scoring.GRAMS:
            if any(r[i : i + 3 * n] == r[i : i + n] * 3 for i in range(len(r) - 3 * n)):
                return f"ngram_{n}_3x_repeat"
    return ""


def test_degenerate_like_brute_force(spark):
    rng = random.Random(1)
    texts = ["", " ", "　\n", "## 場面 x", "a\n a\na ", "a\na", "😀あ" * 30, "x" * 50, "x" * 51, "y" * 40 + "abcd" * 3, "y" * 40 + "abcd" * 3 + "z", "w" * 3 + "q" * 60]
    texts += ["".join(rng.choice("ab\n😀　") for _ in range(rng.randint(1, 90))) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string")
    got = {r.i: r.d for r in df.select("i", scoring.degenerate_reason("t").alias("d")).collect()}
    assert {i: got[i] for i in range(len(texts))} == {i: reason(t) for i, t in enumerate(texts)}


def test_quoted_and_head_match(spark):
    cases = [("「a」（x）", "bab", True), ("」a「", "zzz", True), ("「a", "a", False), ("「」", "", True), ("「q」", "a", False)]
    df = spark.createDataFrame(cases, "p string, t string, w boolean")
    assert df.select(pr.quoted_match(F.col("p"), F.col("t")).alias("g"), "w").where("g <> w").count() == 0
    heads = spark.createDataFrame([("「ab」（x）", "xaby", True), ("ab", "ab", False), ("「（x", "", True)], "p string, t string, w boolean")
    assert heads.select(pr.head_match(F.col("p"), F.col("t")).alias("g"), "w").where("g <> w").count() == 0


def test_predicates(spark):
    df = spark.createDataFrame([("…", ["ok", "  "], "AI-chan"), ("LGBTQ の話", ["good words here", "abcd"], "aiちゃん"), ("hello", ["x" * 29 + "abcd", None], "「Ai」")], "t string, l array<string>, f string")
    got = df.select(pr.placeholder_only("t").alias("p"), pr.foreign_run("t").alias("e"), pr.bad_list("l").alias("b"), pr.firewall_hit("f").alias("f")).collect()
    assert [tuple(r) for r in got] == [(True, False, True, True), (False, False, True, False), (False, True, True, True)]


def test_text_functions(spark):
    df = spark.createDataFrame([("　 a b \x85", "```json\n[1]\n```", "<BR> x</p>\ty<h1>", "{a,  ]"), (None, None, None, None)], "a string, b string, c string, d string")
    r = df.select(tx.strip("a"), tx.strip_fence("b"), tx.strip_tags("c"), tx.drop_trailing_commas("d")).collect()
    assert tuple(r[0]) == ("a b", "[1]", "x" + "y<h1>", "{a  ]") and tuple(r[1]) == (None,) * 4
    grams = spark.createDataFrame([("😀あい", "あ")], "a string, b string").select(tx.ngrams("a", 2), tx.ngrams("b", 2), tx.overlap("a", "b"), tx.overlap("a", "a")).first()
    assert tuple(grams) == (["😀あ", "あい"], [], 0.0, 1.0)


def test_spread_join_like_join(spark):
    left = spark.range(5000).selectExpr("id as v", "case when id % 3 = 0 then 'hot' when id % 5 = 0 then null else cast(id % 400 as string) end as k")
    right = spark.createDataFrame([("hot", 1), ("7", 2), ("9", 3), (None, 4), ("none", 5)], "k string, w int")
    for how in ("inner", "left"):
        got = spread_join(left, right, "k", how).select("v", "k", "w")
        assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, "k", how).select("v", "k", "w").collect()))
    assert spread_join(left.limit(0), right, "k").count() == 0


def test_first_last_ranked_split(spark):
    rows = [("a", 2, "x"), ("a", 1, None), ("b", 1, "z"), ("b", 1, "y"), (None, 3, "n")]
    df = spark.createDataFrame(rows, "k string, o int, v string")
    assert {(r.k, r.v) for r in construct.first_wins(df, ["k"], ["o", "v"]).collect()} == {("a", None), ("b", "y"), (None, "n")}
    assert {(r.k, r.v) for r in construct.last_wins(df, ["k"], ["o", "v"]).collect()} == {("a", "x"), ("b", "z"), (None, "n")}
    many = spark.range(2000).selectExpr("id", "case when id % 3 = 0 then 'hot' else cast(id % 7 as string) end as g")
    got = construct.ranked(many, "g", ["id"]).toPandas().sort_values(["g", "id"])
    assert (got.groupby("g").cumcount() == got["rank"]).all() and len(got) == 2000
    parts = construct.split(many, "g", "id").toPandas()
    sizes = parts.groupby(["g", "part"]).size().unstack()
    assert (sizes["train"] == (sizes.sum(axis=1) * 0.8).astype(int)).all()
    assert construct.ranked(many.limit(0), "g", ["id"]).count() == 0


def test_scores_without_matches(spark):
    items = spark.createDataFrame([("a", ["x"]), ("b", None), ("c", [])], "id string, anti array<string>")
    resp = spark.createDataFrame([("a", "old", 1), ("a", "", 2), ("b", "  ", 1), ("z", "q", 1), (None, "q", 1)], "id string, response string, ord int")
    assert {r.id for r in scoring.answered(items, resp).collect()} == {"b"}
    assert {(r.id, r.response) for r in scoring.all_items(items, resp).collect()} == {("a", ""), ("b", "  "), ("c", "")}
    assert {r.id for r in scoring.without_response(items, resp).collect()} == {"c"}
    assert {r.id for r in scoring.unknown_ids(resp, items).collect()} == {"z", None}
    rule = scoring.rule_v3(F.col("response"), F.col("anti"))
    assert {r.id: r.p for r in scoring.all_items(items, resp).select("id", rule["passed"].alias("p")).collect()} == {"a": False, "b": True, "c": False}
    assert summary.task_summary(items.limit(0).withColumn("passed", F.lit(True)), []).first().n == 0


@pytest.mark.parametrize("text, want", [
    ('[{"a": 1}]', [{"a": 1}]), ('{"a": 1}', [{"a": 1}]), ('```json\n[{"a": 1},]\n```', [{"a": 1}]), ('so: [{"a": "x"}] ok', [{"a": "x"}]),
    ("[{\"a\": 'x'}]", [{"a": "x"}]), ('[{"a"：1，"b": 2}]', [{"a": 1, "b": 2}]), ('[{"a": 1}, {"b": [1, 2', [{"a": 1}, {"b": [1, 2]}]),
    ('x {"a": 1} y {"b": bad} z {"c": "</p>t"}', [{"a": 1}, {"c": "t"}]), ('{"antipaterns": ["<b>u"], "anti_patterns": ["v"]}', [{"anti_patterns": ["v"]}]),
    ('{"a": 1, "a": 2}', [{"a": 2}]), ("", []), (None, []), ("nothing", []), ("[1, 2]", []), ('{"a": NaN}', None),
])
def test_parse_items(text, want):
    got = generate.parse_items(text)
    assert got == want if want is not None else len(got) == 1


@given(st.lists(st.dictionaries(st.text("ab", min_size=1, max_size=3), st.text("xyz あ", max_size=5), max_size=3), max_size=4))
@settings(max_examples=60, deadline=None)
def test_parse_items_round_trip(items):
    assert generate.parse_items(json.dumps(items, ensure_ascii=False)) == items
    cut = json.dumps([*items, {"last": [1, 2]}], ensure_ascii=False)[:-3]
    assert generate.parse_items(cut)[: len(items)] == items


@pytest.mark.parametrize("text, want", [
    ("「x」 [{\"a\": 「い，う」, 'b': 'it',}] z", [{"a": "い,う", "b": "it"}]), ('[{"a": 1}] and {"b": 2}', [{"a": 1}]), ('{"a": {"b": [1, {"c": 2}]}} {"d": tru}', [{"a": {"b": [1, {"c": 2}]}}]),
    ('[{"a": "x}{"}, {"b": "cut', [{"a": "x}{"}]), ("[{'a': 'he said \"hi\"'}]", [{"a": 'he said "hi"'}]), ("[[[[", []), ('{"a": "\\', []), ("[{" * 5000, []),
])
def test_parse_items_leniently(text, want):
    assert generate.parse_items(text) == want


def test_parse_list():
    assert generate.parse_list('x [{"a": 1}, 2, {"b": 3}] y') == [{"a": 1}, 2, {"b": 3}] and generate.parse_list("[{'a': 1,}]") == [{"a": 1}]
    assert generate.parse_list('{"a": 1}') == [] and generate.parse_list('[{"a": bad}]') == [] and generate.parse_list(None) == []


GOOD = {"context": "雨の日の朝", "expected_qualities": ["ab", "cd"], "anti_patterns": ["ef", "gh"], "ideal_response_example": "そうですね"}


@pytest.mark.parametrize("change, want, old", [
    ({}, "ok", True), ({"context": None}, "ctx-too-short", True), ({"expected_qualities": "ab"}, "eq-not-list", False), ({"anti_patterns": {}}, "ap-not-list", False), ({"expected_qualities": ["ab"]}, "eq-len:1", False),
    ({"anti_patterns": ["ab"] * 7}, "ap-len:7", True), ({"expected_qualities": ["a", "bc"]}, "eq-item-shape", True), ({"anti_patterns": [1, "bc"]}, "ap-item-shape", True), ({"ideal_response_example": 5}, "ire-len:N/A", False),
    ({"ideal_response_example": "短い"}, "ire-len:2", False), ({"note": {"x": ["AIちゃん"]}}, "firewall-hit", True), ({"note": ["AIちゃん"]}, "firewall-hit", False),
])
def test_object_reason(change, want, old):
    item = {**GOOD, **change}
    assert (validate.object_reason(item), validate.object_valid_v1(item)) == (want, old)
    assert validate.object_reason([]) == "not-a-dict" and validate.object_reason({"context": ""}) == "missing:anti_patterns,expected_qualities,ideal_response_example"


@pytest.mark.parametrize("target", [4, 1000])
def test_accept_loop_like_the_loop(spark, target):
    rng = random.Random(7)
    make = lambda: rng.choice([None, "", "nothing", *[json.dumps([{**GOOD, "context": f"場面の番号は{rng.randint(0, 25)}", **({} if rng.random() < 0.7 else {"anti_patterns": []})} for _ in range(rng.randint(1, 3))], ensure_ascii=False) for _ in range(5)]])
    log = [(c, s, r, f"s{s}", make()) for c in range(2) for s in range(8) for r in range(3)]
    seen, want, n = set(), [], 0
    for c in range(2):
        for s in range(8):
            for r in range(3):
                if n >= target:
                    break
                text = next(x[4] for x in log if x[:3] == (c, s, r))
                items = generate.parse_items(text)
                if not items:
                    want.append((c, s, r, None, "no_response" if text is None else "parse_fail", None))
                gave = False
                for k, item in enumerate(items):
                    if n >= target:
                        break
                    if validate.object_reason(item) != "ok":
                        want.append((c, s, r, k, "invalid", None))
                    elif item["context"] in seen:
                        want.append((c, s, r, k, "duplicate", None))
                    else:
                        seen.add(item["context"])
                        want.append((c, s, r, k, "accepted", f"synth-{n:04d}"))
                        n, gave = n + 1, True
                if gave:
                    break
    df = spark.createDataFrame(log, "cycle int, seed_ord int, retry int, seed_id string, response string")
    got = generate.accept_loop(df, target)
    assert sorted(map(str, (tuple(x) for x in got.select("cycle", "seed_ord", "retry", "pos", "outcome", "id").collect()))) == sorted(map(str, want))
    assert generate.run_metrics(got).first().accepted == n
    assert generate.accept_loop(df.limit(0), target).count() == 0


def test_compare_arms_over_common_ids(spark):
    rows = [("a", "x", "b", 1, "<|user|>古い", "あいう"), ("a", "x", "b", 2, "<|user|>あい test", "あいう"), ("a", "x", "t", 1, "あいう", "あいう"), ("z", "x", "b", 1, "only one arm", "g"), ("n", "y", "b", 1, None, "g"), ("n", "y", "t", 1, "", None), (None, "y", "t", 1, "q", "g")]
    df = spark.createDataFrame(rows, "id string, axis string, arm string, ord int, response string, gold string")
    got = summary.compare_arms(df, ["id"], "axis", "arm", "b", "t", "response", "gold", ["ord"])
    assert {r.axis: tuple(r)[1:] for r in got.collect()} == {"x": (1, 7.0, 3.0, 0.5, 1.0, 1, 0), "y": (1, 0.0, 0.0, 0.0, 0.0, 0, 0)}
    total = summary.grand_macro(got).first()
    assert (total.groups, total.lift, total.art_delta, total.lift_pct) == (2, 0.25, -1, 100.0)


def test_generated_and_judged(spark):
    df = spark.createDataFrame([("a", "p"), ("b", None)], "id string, prompt string")

    def broken():
        def answer(texts):
            raise RuntimeError

        return answer

    assert {r.response for r in generate.generated(df, "prompt", broken).collect()} == {None}
    assert {r.id: r.judge_score for r in judge.judged(df, "prompt", lambda p: "score: 7").collect()} == {"a": 7, "b": None}
    plan = generate.attempts(df.withColumn("seed_ord", F.lit(1)), 2, 3, 0.5)
    assert plan.count() == 12 and plan.agg(F.max("temperature")).first()[0] == 0.75
    log = spark.createDataFrame([(1, "k"), (2, "k"), (3, "m"), (4, "n"), (5, None)], "o int, k string")
    assert [r.o for r in generate.accepted(log, F.col("k").isNotNull(), "k", ["o"], 2).collect()] == [1, 3]


def test_leak_ratios_both_ways(spark):
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("あいうえお😀") for _ in range(n))
    docs = [make(300) for _ in range(20)] + [None, ""]
    items = [(f"i{k}", make(rng.randint(0, 30)) + (docs[k][40:60] if k % 2 else "")) for k in range(12)] + [("n", None)]
    d, i = spark.createDataFrame([(t,) for t in docs], "text string"), spark.createDataFrame(items, "id string, text string")
    grams = lambda t: {t[k : k + 8] for k in range(len(t or "") - 7)}
    corpus = set().union(*map(grams, docs))
    want = {k: (len(grams(t)), len(grams(t) & corpus)) for k, t in items}
    for most in (10**6, 0):
        got = {r.id: (r.n_grams, r.n_hits) for r in contamination.leak_ratios(i, d, most=most).collect()}
        assert got == want


def test_jsonl(spark, tmp_path):
    a, b = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    a.write_text('{"id": "1", "x": 1}\n\n{"id": "2"} tail\n{"id": "3", "y": [1]}\n')
    b.write_text('{"id": "4", "id": "5"}\n{"id": NaN}\n')
    src = jsonl.lines(spark, str(a), str(b), str(tmp_path / "gone.jsonl"))
    assert sorted((r.file[-7:], r.line_no) for r in src.collect()) == [("a.jsonl", k) for k in (1, 2, 3, 4)] + [("b.jsonl", k) for k in (1, 2)]
    rows, errors = jsonl.parsed(src, spark.createDataFrame([], "id string, x int").schema)
    assert sorted(r.id for r in rows.collect()) == ["1", "3", "5"]
    assert sorted((r.file[-7:], r.line_no) for r in errors.collect()) == [("a.jsonl", 3), ("b.jsonl", 2)]
    with pytest.raises(Exception, match="whole JSON"):
        jsonl.strict(src, rows.drop("file", "line_no").schema).collect()
    assert jsonl.lines(spark, str(tmp_path / "none")).count() == 0
    jsonl.write_jsonl(rows, str(tmp_path / "out"), ["id"], one_file=True)
    (part,) = (tmp_path / "out").glob("*.json")
    assert [json.loads(x)["id"] for x in part.read_text().splitlines()] == ["1", "3", "5"] and re.search('"x":1', part.read_text())
    jsonl.write_master(rows.withColumn("axis", F.lit("a")), str(tmp_path / "m"), "axis")
    jsonl.append_batch(rows, str(tmp_path / "inc"), 1)
    jsonl.append_batch(rows, str(tmp_path / "inc"), 1)
    assert spark.read.json(str(tmp_path / "inc")).count() == 3


def test_stream_like_table(spark, sf, tmp_path):
    from tsumugi.streaming.scores import degenerate_rates

    t = spark.read.parquet(f"{sf}/response.parquet")
    t.write.parquet(str(tmp_path / "in"))
    q = degenerate_rates(spark.readStream.schema(t.schema).parquet(str(tmp_path / "in")), late="3650 days").writeStream.outputMode("update").format("memory").queryName("rates").start()
    q.processAllAvailable()
    q.stop()
    last = spark.table("rates").groupBy("window_start", "variant").agg(F.max("n").alias("n"))
    want = {(r.window_start, r.variant): r.n for r in degenerate_rates(t).collect()}
    assert {(r.window_start, r.variant): r.n for r in last.collect()} == want


def test_judge_parts_and_prompts(spark):
    df = spark.createDataFrame([('x {"empathy": 1, "appropriateness": 2, "naturalness": 0, "warmth": 3} y',), ("none",), (None,), ('{"empathy": 1}',)], "t string")
    assert [r.v for r in df.select(judge.parse_parts("t").alias("v")).collect()] == [6, None, None, None]
    p = spark.createDataFrame([("s", "a", None, ["h", "i"])], "id string, axis string, rule string, hints array<string>")
    text = p.select(generate.generation_prompt(F.struct("id"), F.col("axis"), F.col("rule"), F.col("hints"), 3).alias("p")).first().p
    assert text.splitlines() == ['例: {"id":"s"}', "軸: a", "規則: ", "場面: h / i", "件数: 3"]


def test_file_errors_and_order(spark):
    ok = json.dumps({k: ["x"] if k in ("expected_qualities", "anti_patterns") else "family" for k in validate.STANDARD})
    bad = json.dumps({**json.loads(ok), "axis": "other", "anti_patterns": "x"})
    df = spark.createDataFrame([("f", 1, ok), ("f", 2, bad), ("f", 3, "{"), ("f", 4, " "), ("f", 5, None), ("f", 6, '{"id": "a"}')], "file string, line_no int, line string")
    got = [(r.line_no, r.error) for r in validate.first_errors(validate.file_errors(df), ["line_no", "error"], 9).collect()]
    assert got == [(2, "anti_patterns not a list"), (2, "unknown axis other"), (3, "bad JSON"), (6, "missing " + ",".join(sorted(set(validate.STANDARD) - {"id"})))]
    axes = spark.createDataFrame([("keigo",), ("zzz",), (None,)], "a string").select(validate.axis_order("a").alias("o")).collect()
    assert [r.o for r in axes] == [2, 9, 9]


def test_merged_samples(spark):
    r = spark.createDataFrame([("b", 2, "x"), ("a", 1, "y"), ("c", 3, "z")], "id string, ord int, note string")
    i = spark.createDataFrame([("a", "item a"), ("b", "item b")], "id string, note string")
    assert [(x.id, x.note) for x in scoring.merged(r, i, "id", ["ord"], 2).orderBy("ord").collect()] == [("a", "item a"), ("b", "item b")]


def test_leaves_however_deep(spark):
    df = spark.sql("select 'a' as x, array('b', null) as y, named_struct('p', 'c', 'q', array(named_struct('r', 'd', 'n', 1), null)) as z, map('k', array('e')) as m, 5 as n, array(1, 2) as o, cast(null as struct<u: string>) as v")
    assert df.select(validate.leaves(df).alias("t")).first().t == "a b c d e"


def test_json_document(spark, tmp_path):
    (tmp_path / "d.json").write_text('[{"a": 1,\n "b": "x"},\n {"a": 2}]', encoding="utf-8")
    assert [(r.a, r.b) for r in jsonl.document(spark, str(tmp_path / "d.json")).collect()] == [(1, "x"), (2, None)]
    assert jsonl.document(spark, str(tmp_path / "none.json"), "a int").count() == 0


def test_errors_prompts_and_fallback(spark):
    df = spark.createDataFrame([("p", "p and more", '{"empathy": 1, "appropriateness": 2, "naturalness": 3, "warmth": 1}'), ("q", "more", "no json")], "prompt string, text string, judged string")

    def broken():
        def answer(texts):
            raise RuntimeError("gone")

        return answer

    assert {r.response for r in generate.generated(df, "prompt", broken, error="ERR: ").collect()} == {"ERR: gone"}
    assert [r.t for r in df.select(generate.without_prompt(F.col("text"), F.col("prompt")).alias("t")).collect()] == [" and more", "more"]
    assert [r.v for r in df.select(judge.parts_or_rule("judged", F.col("text"), F.array(F.lit("bad"))).alias("v")).collect()] == [7, 4]
    assert [r.h for r in df.select(pr.pattern_hit("text", ["m.re", "^x"]).alias("h")).collect()] == [True, True]
    assert not df.select(pr.pattern_hit("text", []).alias("h")).first().h
    ratios = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", None)], "id string, ratio double")
    assert [r.id for r in summary.leaks(ratios).collect()] == ["a"]
