"""Queries of the core operators over whole tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsumugi.functions import text as tx
from tsumugi.operators import construct as cs
from tsumugi.operators import contamination, generate, judge, schema_drift, scoring, summary, validate
from tsumugi.operators import predicates as pr
from tsumugi.sources.tables import table
from tsumugi.streaming.scores import degenerate_rates

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if it has one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---- pieces of SQL -------------------------------------------------------------------------
WS = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def s_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def s_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]::VARCHAR[]"


def s_any(x: str, values) -> str:
    return "(" + " or ".join(f"contains({x}, '{v}')" for v in values) + ")"


def s_count(x: str, values) -> str:
    return "(" + " + ".join(f"contains({x}, '{v}')::int" for v in values) + ")"


def s_degenerate(x: str) -> str:
    r = s_strip(x)
    lines = f"list_filter(list_transform(string_split({r}, chr(10)), lambda l: {s_strip('l')}), lambda l: l <> '')"
    most = f"coalesce(list_max(list_transform({lines}, lambda l: len(list_filter({lines}, lambda m: m = l)))), 0)"
    gram = lambda n: f"when length({r}) > 50 and coalesce(list_bool_or(list_transform(range(1, length({r}) - {3 * n} + 1), lambda i: substr({r}, i, {3 * n}) = repeat(substr({r}, i, {n}), 3))), false) then 'ngram_{n}_3x_repeat'"
    return f"case when {r} = '' then 'empty' when {s_any(r, scoring.ECHOES)} then 'template_echo' when {most} >= 3 then 'line_repeated_' || {most} || 'x' {' '.join(map(gram, scoring.GRAMS))} else '' end"


def s_quoted(pattern: str, x: str) -> str:
    a, b = f"strpos({pattern}, '「')", f"strpos({pattern}, '」')"
    return f"(case when {a} > 0 and {b} > 0 then contains({x}, substr({pattern}, {a} + 1, greatest({b} - {a} - 1, 0))) else false end)"


def s_last(task: str, extra: str = "") -> str:
    """The last response of each id of a task."""
    return f"(select id, arg_max(coalesce(response, chr(0)), row_id) as response from response where task = '{task}' {extra} group by id)"


def _last(spark: SparkSession, sf: str, task: str, where: str = "true") -> DataFrame:
    return table(spark, sf, "response").where(F.col("task") == task).where(where).select("id", "response", F.col("row_id").alias("ord"))


# ---- scoring -------------------------------------------------------------------------------
@query(f"select row_id, {s_degenerate('response')} as deg_reason from response")
def degenerate_flags(spark, sf):
    """Why each response is degenerate."""
    return table(spark, sf, "response").select("row_id", scoring.degenerate_reason("response").alias("deg_reason"))


@query(f"with d as (select task, {s_degenerate('response')} as r from response) select task, count(*) as n, round_even(avg((coalesce(r, '') <> '')::int), 6) as degenerate_rate from d group by task")
def degenerate_rate(spark, sf):
    """Share of degenerate responses of each task."""
    t = table(spark, sf, "response").select("task", F.coalesce(scoring.degenerate_reason("response"), F.lit("")).alias("r"))
    return t.groupBy("task").agg(F.count("*").alias("n"), F.bround(F.avg((F.col("r") != "").cast("int")), 6).alias("degenerate_rate"))


KEIGO_MARKERS = ["申し上げ", "いただ", "お持ち", "かしこまり"]
KEIGO_ANTI = ["「確認して」（指図）", "」エラー「", "「」", "渡す"]


def _keigo_sql(version: int) -> str:
    r = "response"
    hits, bad = s_count(r, KEIGO_MARKERS), "(" + " or ".join(s_quoted(f"'{p}'", r) for p in KEIGO_ANTI[:2]) + ")"
    polite = s_any(r, scoring.POLITE_V2 if version == 2 else scoring.POLITE_V1)
    if version == 1:
        return f"""with t as (select row_id, starts_with(variant, 'tuned') as casual, {hits} as matched, {bad} as has_anti, {polite} as polite from response where task = 'keigo' and response is not null)
        select row_id, matched, has_anti, round_even(case when casual then (case when polite then 0.0 else 1.0 end) else matched / 4.0 end, 3)::double as score, case when casual then not polite else matched / 4.0 >= 0.5 and not has_anti end as passed from t"""
    return f"""with t as (select row_id, starts_with(variant, 'tuned') as casual, {hits} as matched, {bad} as has_anti, {polite} as polite, {s_degenerate(r)} <> '' as is_degenerate from response where task = 'keigo' and response is not null),
    u as (select *, case when is_degenerate then 0.0 else matched / 4.0 end as share from t), v as (select *, case when has_anti then greatest(0.0, share - 0.5) else share end as penal, case when polite or is_degenerate then 0.0 else 1.0 end as plain from u)
    select row_id, matched, has_anti, is_degenerate, round_even(case when casual then plain else penal end, 3)::double as score, case when casual then plain >= 1.0 else penal >= 0.5 and not has_anti and not is_degenerate end as passed from v"""


def _keigo(spark, sf, how):
    t = table(spark, sf, "response").where("task = 'keigo' and response is not null")
    level = F.when(F.startswith(F.col("variant"), F.lit("tuned")), "tameguchi").otherwise("teineigo")
    s = how(F.col("response"), level, pr.markers(KEIGO_MARKERS), pr.markers(KEIGO_ANTI[:2]))
    return t.select("row_id", *(c.alias(n) for n, c in s.items()))


@query(_keigo_sql(2))
def keigo_score(spark, sf):
    """Marker share with penalties, the second version."""
    return _keigo(spark, sf, scoring.keigo_v2)


@query(_keigo_sql(1))
def keigo_score_v1(spark, sf):
    """Marker share, the first version."""
    return _keigo(spark, sf, scoring.keigo_v1)


@query("select row_id, " + ", ".join(f"{s_quoted(repr(p), 'response')} as q{i}" for i, p in enumerate(KEIGO_ANTI)) + " from response where response is not null")
def quoted_anti_pattern(spark, sf):
    """Quotes of patterns in responses, with reversed, empty and missing quotes."""
    t = table(spark, sf, "response").where("response is not null")
    return t.select("row_id", *(pr.quoted_match(F.lit(p), F.col("response")).alias(f"q{i}") for i, p in enumerate(KEIGO_ANTI)))


@query("select row_id, len(list_filter(" + s_list(["ね", "よ", "です", ""]) + ", lambda m: contains(response, m))) as n, list_aggregate(list_filter(" + s_list(["ね", "よ", "です", ""]) + ", lambda m: contains(response, m)), 'string_agg', ',') as found from response where response is not null")
def matched_markers(spark, sf):
    """The markers each response holds, in their order; an empty marker is in every text."""
    m = pr.matched("response", pr.markers(["ね", "よ", "です", ""]))
    return table(spark, sf, "response").where("response is not null").select("row_id", F.size(m).alias("n"), F.array_join(m, ",").alias("found"))


SIL = f"with r as {s_last('silence')}, t as (select s.id, nullif(response, chr(0)) as response, ideal_response_examples as ex from silence s join r using (id) where response <> chr(0) and response <> ''), u as (select *, {s_strip('response')} as r, {s_degenerate('response')} <> '' as deg from t)"


@query(f"{SIL} select id, {s_any('r', scoring.SILENCE_V2)} as has_silence_token, coalesce(list_bool_or(list_transform(ex, lambda e: {s_strip('e')} = r)), false) as matches_example, length(r) <= 8 or {s_any('r', scoring.SILENCE_V2)} as is_short, deg as is_degenerate, length(r) as response_len, not deg and ({s_any('r', scoring.SILENCE_V2)} or coalesce(list_bool_or(list_transform(ex, lambda e: {s_strip('e')} = r)), false) or length(r) <= 8) as passed from u")
def silence_score(spark, sf):
    """Silence items with their last response, the second version."""
    t = scoring.answered(table(spark, sf, "silence").select("id", "ideal_response_examples"), _last(spark, sf, "silence"))
    return t.select("id", *(c.alias(n) for n, c in scoring.silence_v2(F.col("response"), F.col("ideal_response_examples")).items()))


@query(f"{SIL}, v as (select id, {s_any('response', scoring.SILENCE_V1)} or length(r) < 10 as q, coalesce(list_bool_or(list_transform(ex, lambda e: contains(response, e) or contains(e, response))), false) as m from u) select id, q as is_silence_or_short, m as matches_example, q or m as passed from v")
def silence_score_v1(spark, sf):
    """The first version: any example in the response or the other way round."""
    t = scoring.answered(table(spark, sf, "silence").select("id", "ideal_response_examples"), _last(spark, sf, "silence"))
    return t.select("id", *(c.alias(n) for n, c in scoring.silence_v1(F.col("response"), F.col("ideal_response_examples")).items()))


def _fam_sql(inner: str) -> str:
    return f"with t as (select r.row_id, r.response, f.anti_patterns as ap from response r join family_v03_additions f using (id) where r.task = 'family' and r.response <> '') {inner}"


FAM_ANTI = "coalesce(list_bool_or(list_transform(ap, lambda p: " + s_quoted("p", "r") + ")), false)"


@query(_fam_sql(f""", u as (select row_id, ap, {s_strip('response')} as r, {s_degenerate('response')} <> '' as deg from t), v as (select row_id, deg, (length(r) between 5 and 150)::int as fits, {s_count('r', scoring.EMPATHY)} as e, {s_count('r', scoring.WARMTH)} as w, {FAM_ANTI} as bad, regexp_matches(r, '[。！？.!?]$') or length(r) < 30 as nat from u),
    x as (select row_id, deg, least(3, e + fits) as e, (case when bad then 0 else 2 end) + fits as a, case when nat then 2 else 1 end as n, least(3, w) as w from v) select row_id, case when deg then 0 else e end as empathy, case when deg then 0 else a end as appropriateness, case when deg then 0 else n end as naturalness, case when deg then 0 else w end as warmth, case when deg then 0 else e + a + n + w end as total, deg as is_degenerate from x"""))
def family_score(spark, sf):
    """Four sub-scores of family responses, the second version."""
    t = table(spark, sf, "response").where("task = 'family' and response <> ''").join(table(spark, sf, "family_v03_additions").select("id", "anti_patterns"), "id")
    return t.select("row_id", *(c.alias(n) for n, c in scoring.family_v2(F.col("response"), F.col("anti_patterns")).items()))


@query(_fam_sql(""", v as (select row_id, length(response) between 5 and 200 as fits, coalesce(list_bool_or(list_transform(ap, lambda p: contains(p, '「') and contains(response, replace(replace(split_part(p, '（', 1), '「', ''), '」', '')))), false) as bad from t)
    select row_id, case when not bad and fits then 2 else 1 end as empathy, case when not bad then 2 else 0 end as appropriateness, case when fits then 2 else 1 end as naturalness, case when not bad then 2 else 1 end as warmth, case when not bad and fits then 8 else 4 end as total from v"""))
def family_score_v1(spark, sf):
    """The first version."""
    t = table(spark, sf, "response").where("task = 'family' and response <> ''").join(table(spark, sf, "family_v03_additions").select("id", "anti_patterns"), "id")
    return t.select("row_id", *(c.alias(n) for n, c in scoring.family_v1(F.col("response"), F.col("anti_patterns")).items()))


ONE_RUN = "variant = 'base_q4' and seed = 0"
ITEMS = "(select id, any_value(anti_patterns) as anti_patterns, any_value(ideal_response_example) as gold, any_value(context) as context from compassion_synth_v06 group by id)"


@query(f"with r as {s_last('compassion', 'and ' + ONE_RUN)}, t as (select i.id, coalesce(nullif(response, chr(0)), '') as x, coalesce(list_bool_or(list_transform(anti_patterns, lambda p: contains(coalesce(nullif(response, chr(0)), ''), p))), false) as bad from {ITEMS} i left join r using (id)) select id, bad as has_anti, not bad and length(x) > 0 and length(x) < 200 as passed from t")
def rule_score(spark, sf):
    """Rule score of all compassion items of one run; a missing response fails."""
    items = table(spark, sf, "compassion_synth_v06").select("id", "anti_patterns").dropDuplicates(["id"])
    t = scoring.all_items(items, _last(spark, sf, "compassion", ONE_RUN))
    return t.select("id", *(c.alias(n) for n, c in scoring.rule_v3(F.col("response"), F.col("anti_patterns")).items()))


SAME_RUN = "r.id = {0}.id and r.variant is not distinct from g.variant and r.seed is not distinct from g.seed"


def _runs(items: DataFrame, responses: DataFrame) -> DataFrame:
    """Each item in each (variant, seed) that has responses."""
    return items.crossJoin(F.broadcast(responses.select("variant", "seed").distinct()))


def _same_run(a: DataFrame, b: DataFrame):
    return (a["id"] == b["id"]) & a["variant"].eqNullSafe(b["variant"]) & a["seed"].eqNullSafe(b["seed"])


@query(f"with g as (select distinct variant, seed from response where task = 'compassion'), r as (select variant, seed, id, arg_max(coalesce(response, chr(0)), row_id) as response from response where task = 'compassion' group by variant, seed, id), t as (select g.variant, g.seed, i.id, coalesce(nullif(response, chr(0)), '') as x, coalesce(list_bool_or(list_transform(anti_patterns, lambda p: contains(coalesce(nullif(response, chr(0)), ''), p))), false) as bad from {ITEMS} i cross join g left join r on {SAME_RUN.format('i')}) select variant, seed, id, bad as has_anti, not bad and length(x) > 0 and length(x) < 200 as passed from t")
def rule_score_runs(spark, sf):
    """Rule score of all compassion items in every run; a missing response fails."""
    answers = table(spark, sf, "response").where("task = 'compassion'")
    items = _runs(table(spark, sf, "compassion_synth_v06").select("id", "anti_patterns").dropDuplicates(["id"]), answers)
    last = answers.groupBy("variant", "seed", "id").agg(F.max_by("response", "row_id").alias("response"))
    t = items.join(last, _same_run(items, last), "left").select(items["variant"], items["seed"], items["id"], "anti_patterns", "response")
    return t.select("variant", "seed", "id", *(c.alias(n) for n, c in scoring.rule_v3(F.col("response"), F.col("anti_patterns")).items()))


@query(f"select distinct g.variant, g.seed, c.id, 'missing response' as error from compassion_synth_v06 c cross join (select distinct variant, seed from response) g where not exists (select 1 from response r where {SAME_RUN.format('c')})")
def missing_responses_runs(spark, sf):
    """Items without a response in each run."""
    answers = table(spark, sf, "response")
    items = _runs(table(spark, sf, "compassion_synth_v06").select("id").distinct(), answers)
    have = answers.select("variant", "seed", "id").distinct()
    return items.join(have, _same_run(items, have), "left_anti").select("variant", "seed", "id", F.lit("missing response").alias("error"))


@query("select variant, task, seed, id, arg_max(row_id, row_id) as row_id, nullif(arg_max(coalesce(response, chr(0)), row_id), chr(0)) as response from response group by all")
def join_last_wins(spark, sf):
    """The last response of each variant, task, seed and id."""
    t = table(spark, sf, "response").select("variant", "task", "seed", "id", "row_id", "response")
    return cs.last_wins(t, ["variant", "task", "seed", "id"], ["row_id", "response"])


@query(f"select distinct c.id, 'missing response' as error from compassion_synth_v06 c where not exists (select 1 from response r where r.id = c.id and {ONE_RUN})")
def missing_responses(spark, sf):
    """Items without a response in one run."""
    return scoring.without_response(table(spark, sf, "compassion_synth_v06"), table(spark, sf, "response").where(ONE_RUN)).distinct()


@query("select id, count(*) as n from response where id is null or id not in (select id from compassion_synth_v06 union select id from family_v03_additions union select id from keigo_synth_v06 union select id from silence) group by id")
def unknown_ids(spark, sf):
    """Responses to no item."""
    ids = [table(spark, sf, n).select("id") for n in ("compassion_synth_v06", "family_v03_additions", "keigo_synth_v06", "silence")]
    return scoring.unknown_ids(table(spark, sf, "response"), ids[0].union(ids[1]).union(ids[2]).union(ids[3]))


FAM_TOTAL = "case when r = '' or deg then 0 else least(3, e + fits) + (case when bad then 0 else 2 end) + fits + (case when nat then 2 else 1 end) + least(3, w) end"


KEIGO_SCORED = """case when len(list_filter(ks, lambda m: contains(response, m))) / greatest(len(ks), 1) - (case when kbad then 0.5 else 0 end) >= 0.5 and not kbad and not deg then true else false end"""
BY_TASK = f"""with k as (select distinct id, expected_qualities as ks, anti_patterns as kap from keigo_synth_v06),
    t as (select row_id, task, response, f.anti_patterns as ap, s.ex, coalesce(k.ks, []) as ks, coalesce(k.kap, []) as kap, {s_strip('response')} as r, {s_degenerate('response')} <> '' as deg from response left join family_v03_additions f using (id) left join (select id, ideal_response_examples as ex from silence) s using (id) left join k using (id) where task in ('silence', 'family', 'keigo') and response <> ''),
    u as (select *, (length(r) between 5 and 150)::int as fits, {s_count('r', scoring.EMPATHY)} as e, {s_count('r', scoring.WARMTH)} as w, {FAM_ANTI} as bad, regexp_matches(r, '[。！？.!?]$') or length(r) < 30 as nat,
        coalesce(list_bool_or(list_transform(kap, lambda p: {s_quoted('p', 'response')})), false) as kbad,
        {s_any('r', scoring.SILENCE_V2)} or length(r) <= 8 or coalesce(list_bool_or(list_transform(ex, lambda x: {s_strip('x')} = r)), false) as quiet from t),
    v as (select row_id, task, case when task = 'silence' then not deg and quiet when task = 'keigo' then {KEIGO_SCORED} end as passed, case when task = 'family' then {FAM_TOTAL} end as total, deg as is_degenerate from u)"""


@query(f"{BY_TASK} select * from v")
def scores_by_task(spark, sf):
    """Every response by the rule of its task, with its own item's patterns and markers."""
    r = table(spark, sf, "response").select("row_id", "task", "id", "response")
    anti = table(spark, sf, "family_v03_additions").select("id", F.col("anti_patterns").alias("fap"))
    ex = table(spark, sf, "silence").select("id", F.col("ideal_response_examples").alias("examples"))
    keigo = table(spark, sf, "keigo_synth_v06").select("id", F.col("expected_qualities").alias("markers"), F.col("anti_patterns").alias("kap")).distinct()
    every = r.join(anti, "id", "left").join(ex, "id", "left").join(keigo, "id", "left")
    every = every.withColumn("anti_patterns", F.when(F.col("task") == "keigo", F.col("kap")).otherwise(F.col("fap"))).withColumn("level", F.lit(None).cast("string"))
    return scoring.by_task(every).select("row_id", "task", "passed", "total", "is_degenerate")


@query(f"{BY_TASK} select task, count(*) as n, round_even(avg(passed::int), 6) as pass_rate, round_even(avg(is_degenerate::int), 6) as degenerate_rate, round_even(avg(total), 2) as mean_total, case when count(total) > 0 then 12 end as max_possible from v group by task")
def score_summary(spark, sf):
    """Summary of each task by its own rule."""
    return summary.task_summary(scores_by_task(spark, sf), ["task"])


# ---- coverage and comparison ---------------------------------------------------------------
def _legal(spark, sf):
    t = table(spark, sf, "yamato_legal_v02_additions")
    s = scoring.coverage(F.col("ideal_response_example"), F.col("expected_keywords"), F.col("anti_patterns"))
    return t.select("id", tx.id_number("id").alias("no"), *(c.alias(n) for n, c in s.items()))


LEGAL = "(select id, try_cast(split_part(id, '_', 2) as bigint) as no, len(list_filter(expected_keywords, lambda k: contains(ideal_response_example, k))) as kw_hit, len(expected_keywords) as kw_max, coalesce(len(list_filter(anti_patterns, lambda k: contains(ideal_response_example, k))), 0) as anti_hit, length(ideal_response_example) as resp_len from yamato_legal_v02_additions)"


@query(f"select id, no, kw_hit, kw_max, anti_hit, resp_len, format('{{}}/{{}} ({{:.1f}}%)', kw_hit, kw_max, 100.0 * kw_hit / greatest(1, kw_max)) as shown from {LEGAL}")
def keyword_coverage(spark, sf):
    """Keyword hits of legal answers, also as text."""
    return _legal(spark, sf).withColumn("shown", tx.ratio_text("kw_hit", "kw_max"))


@query(f"select no >= 100 as later, count(*) as n, sum(kw_hit)::bigint as kw_hit, sum(kw_max)::bigint as kw_max, round_even(sum(kw_hit) / greatest(1, sum(kw_max)), 6)::double as coverage, sum(anti_hit)::bigint as anti_hit, round_even(avg(resp_len), 6) as avg_len from {LEGAL} group by 1")
def slice_coverage(spark, sf):
    """Micro-averaged coverage of the earlier and the later items."""
    return summary.coverage_summary(_legal(spark, sf).withColumn("later", F.col("no") >= 100), ["later"])


@query(f"with t as (select variant, {s_degenerate('response')} <> '' as d, not ({s_degenerate('response')} <> '') and length(response) < 200 as p from response where response <> '') select variant, count(*) as n, round_even(avg(p::int), 6) as pass_rate, round_even(avg(d::int), 6) as degenerate_rate, null::double as mean_total, null::int as max_possible from t group by variant")
def task_summary(spark, sf):
    """Pass and degenerate rate of each variant."""
    t = table(spark, sf, "response").where("response <> ''").select("variant", F.length("response").alias("n"), scoring.degenerate_reason("response").alias("r"))
    return summary.task_summary(t.select("variant", (F.col("r") != "").alias("is_degenerate"), ((F.col("r") == "") & (F.col("n") < 200)).alias("passed")), ["variant"])


@query("with s as (select variant, task, seed, avg((length(response) < 60)::int) as v from response where response is not null group by all) select variant, task, count(*) as seeds, round_even(avg(v), 6) as mean, round_even(stddev_samp(v), 6) as std from s group by all")
def seed_mean_std(spark, sf):
    """Mean and deviation over seeds of the share of short responses."""
    t = table(spark, sf, "response").where("response is not null")
    return summary.seed_mean_std(t, ["variant", "task"], "seed", (F.length("response") < 60).cast("int"))


def s_clean(x: str) -> str:
    for t in tx.CHAT_TOKENS:
        x = f"replace({x}, '{t}', '')"
    return s_strip(x)


def s_grams(x: str, n: int) -> str:
    return f"list_distinct(list_transform(range(1, length({x}) - {n} + 2), lambda i: substr({x}, i, {n})))"


PAIRS = f"(select r.row_id, r.variant, r.seed, r.task, r.response, i.gold from response r join {ITEMS} i using (id) where r.task = 'compassion' and r.response is not null)"
OVER = f"case when length(response) > 1 and length(gold) > 1 then len(list_intersect({s_grams('response', 2)}, {s_grams('gold', 2)})) / least(len({s_grams('response', 2)}), len({s_grams('gold', 2)})) else 0 end"


def _pairs(spark, sf):
    items = table(spark, sf, "compassion_synth_v06").select("id", F.col("ideal_response_example").alias("gold")).dropDuplicates(["id"])
    r = table(spark, sf, "response").where("task = 'compassion' and response is not null").select("row_id", "variant", "seed", "id", "response")
    return r.join(items, "id")


@query(f"select row_id, round_even({OVER}, 6)::double as overlap from {PAIRS}")
def char_overlap(spark, sf):
    """Overlap of the letter pairs of response and ideal response."""
    return _pairs(spark, sf).select("row_id", F.bround(tx.overlap("response", "gold"), 6).alias("overlap"))


GOLDS = "(select distinct id, 'compassion' as task, ideal_response_example as gold from compassion_synth_v06 union select id, 'family', ideal_response_example from family_v03_additions union select distinct id, 'keigo', ideal_response_example from keigo_synth_v06)"


def _s_arms() -> str:
    s = s_clean("response")
    art = f"(len(regexp_extract_all(s, '[a-zA-Z]{{4,}}')) + len(regexp_extract_all(s, '`[^`]*`')) + len(regexp_extract_all(s, '(?i)</?(?:em|p|br|span|div)>')) + regexp_matches(s, '^(?:{WS}|[.?…」、,「!！？])+$')::int)"
    over = f"case when length(s) > 1 and length(gold) > 1 then len(list_intersect({s_grams('s', 2)}, {s_grams('gold', 2)})) / least(len({s_grams('s', 2)}), len({s_grams('gold', 2)})) else 0 end"
    return f"""with l as (select id, variant, response, seed, row_id from response where variant in ('base_q4', 'tuned_q4') and id is not null qualify row_number() over (partition by id, variant order by seed desc, row_id desc) = 1),
    g as (select id, min(task) as task, min(gold) as gold from {GOLDS} group by id), p as (select l.id, variant, task, coalesce({s}, '') as s, coalesce(gold, '') as gold from l join g using (id)),
    q as (select id, variant, task, length(s) as n, {over} as o, {art} as a from p),
    c as (select b.task, count(*) as n, avg(b.n) as len_base, avg(t.n) as len_tuned, avg(b.o) as overlap_base, avg(t.o) as overlap_tuned, sum(b.a)::bigint as art_base, sum(t.a)::bigint as art_tuned from q b join q t on b.id = t.id and b.variant = 'base_q4' and t.variant = 'tuned_q4' group by b.task)"""


def _arms(spark, sf):
    parts = [table(spark, sf, n).select("id", F.lit(k).alias("axis"), F.col("ideal_response_example").alias("gold")) for n, k in (("compassion_synth_v06", "compassion"), ("family_v03_additions", "family"), ("keigo_synth_v06", "keigo"))]
    golds = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("id").agg(F.min("axis").alias("axis"), F.min("gold").alias("gold"))
    r = table(spark, sf, "response").select("id", "variant", "seed", "row_id", "response").where("id is not null").join(golds, "id")
    return summary.compare_arms(r, ["id"], "axis", "variant", "base_q4", "tuned_q4", "response", "gold", ["seed", "row_id"])


@query(f"{_s_arms()} select task as axis, n, round_even(len_base, 6) as len_base, round_even(len_tuned, 6) as len_tuned, round_even(overlap_base, 6) as overlap_base, round_even(overlap_tuned, 6) as overlap_tuned, art_base, art_tuned from c")
def compare_arms(spark, sf):
    """Two runs side by side over the items both answered, by axis."""
    mean = ("len_base", "len_tuned", "overlap_base", "overlap_tuned")
    return _arms(spark, sf).withColumns({c: F.bround(c, 6) for c in mean})


@query(f"{_s_arms()} select count(*) as groups, round_even(avg(len_base), 6) as len_base, round_even(avg(len_tuned), 6) as len_tuned, round_even(avg(len_tuned) - avg(len_base), 6) as len_delta, round_even(avg(overlap_base), 6) as overlap_base, round_even(avg(overlap_tuned), 6) as overlap_tuned, round_even(avg(overlap_tuned) - avg(overlap_base), 6) as lift, round_even(100 * (avg(overlap_tuned) - avg(overlap_base)) / greatest(0.0001, avg(overlap_base)), 4) as lift_pct, sum(art_base)::bigint as art_base, sum(art_tuned)::bigint as art_tuned, (sum(art_tuned) - sum(art_base))::bigint as art_delta from c")
def grand_macro(spark, sf):
    """Macro average of the comparison, sums of artifacts and what the tuned run gains."""
    return summary.grand_macro(_arms(spark, sf))


# ---- text functions ------------------------------------------------------------------------
@query(f"with t as (select row_id, {s_clean('response')} as s from response where response is not null) select row_id, len(regexp_extract_all(s, '[a-zA-Z]{{4,}}')) as english_fragment, len(regexp_extract_all(s, '`[^`]*`')) as backtick, len(regexp_extract_all(s, '(?i)</?(?:em|p|br|span|div)>')) as html_tag, regexp_matches(s, '^(?:{WS}|[.?…」、,「!！？])+$')::int as placeholder_only from t")
def artifact_counts(spark, sf):
    """Artifacts of generation in each response."""
    t = table(spark, sf, "response").where("response is not null")
    return t.select("row_id", *(c.alias(n) for n, c in scoring.artifacts("response").items()))


@query(f"select doc_id, md5({s_strip('text')}) as stripped, md5(regexp_replace(text, '(?i)</?(?:em|p|br|span|div|strong|b|i|u)>{WS}*', '', 'g')) as untagged, md5(translate(text, '：，（）「」『』“”‘’', ':,()\"\"\"\"\"\"''''')) as half, length(text) as n from documents")
def text_functions(spark, sf):
    """White space, tags and wide marks of documents."""
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.strip("text")).alias("stripped"), F.md5(tx.strip_tags("text")).alias("untagged"), F.md5(tx.half_width("text")).alias("half"), F.length("text").alias("n"))


# ---- validation and cleaning ---------------------------------------------------------------
def s_leaves(*cols: str) -> str:
    return "concat_ws(' ', " + ", ".join(cols) + ")"


FIRE = "|".join(x.replace("-", "\\-") for x in pr.FIREWALL)
REQ = [("anti_patterns", "anti_patterns"), ("context", "context"), ("expected_qualities", "expected_qualities"), ("ideal_response_example", "ideal_response_example")]
GONE = "array_to_string(list_filter([" + ", ".join(f"case when {c} is null then '{n}' end" for c, n in REQ) + "], lambda x: x is not null), ',')"
LEAVES = s_leaves("id", "axis", "context", '"user"', "array_to_string(expected_qualities, ' ')", "array_to_string(anti_patterns, ' ')", "ideal_response_example", "synth_seed_id")
VALID = f"""case when {GONE} <> '' then 'missing:' || {GONE} when len(expected_qualities) not between 2 and 6 then 'eq-len:' || len(expected_qualities) when len(anti_patterns) not between 2 and 6 then 'ap-len:' || len(anti_patterns)
    when list_bool_or(list_transform(expected_qualities, lambda x: coalesce(length(x) not between 2 and 100, true))) then 'eq-item-shape' when list_bool_or(list_transform(anti_patterns, lambda x: coalesce(length(x) not between 2 and 100, true))) then 'ap-item-shape'
    when length(ideal_response_example) not between 5 and 500 then 'ire-len:' || length(ideal_response_example) when length(context) < 5 then 'ctx-too-short' when regexp_matches({LEAVES}, '{FIRE}') then 'firewall-hit' else 'ok' end"""
PLACE = f"^(?:{WS}|[.?…」、,「!！？])+$"


def s_badlist(c: str) -> str:
    s = s_strip("x")
    return f"list_bool_or(list_transform({c}, lambda x: coalesce({s} = '' or regexp_matches({s}, '{PLACE}') or regexp_matches({s}, '`[^`]*`') or (regexp_matches({s}, '[a-zA-Z]{{4,}}') and length({s}) < 30), true)))"


IRE = s_strip("ideal_response_example")
CLEAN = f"""case when {VALID} <> 'ok' then 'schema:' || {VALID} when {s_badlist('expected_qualities')} then 'eq-placeholder' when {s_badlist('anti_patterns')} then 'ap-placeholder'
    when (axis <> 'silence' and (regexp_matches({IRE}, '{PLACE}') or length({IRE}) < 8)) or regexp_matches({IRE}, '`[^`]*`') or coalesce(list_bool_or(list_transform(regexp_extract_all({IRE}, '[a-zA-Z]{{4,}}'), lambda w: lower(w) not in ('sns', 'tv', 'pc', 'ok', 'lgbt', 'lgbtq'))), false) then 'ire-artifact' when regexp_matches(context, '`[^`]*`') then 'ctx-backtick' else 'ok' end"""


@query(f"select id, {VALID} as reason from compassion_synth_v06")
def validate_reason(spark, sf):
    """First failing rule of each item."""
    t = table(spark, sf, "compassion_synth_v06")
    return t.select("id", validate.item_reason(t).alias("reason"))


@query(f"select id, {CLEAN} as reason from compassion_synth_v06")
def clean_reason(spark, sf):
    """First reason to drop each item in cleaning."""
    t = table(spark, sf, "compassion_synth_v06")
    return t.select("id", validate.clean_reason(t, "axis").alias("reason"))


@query(f"select {CLEAN} as reason, count(*) as n from compassion_synth_v06 group by 1")
def drop_histogram(spark, sf):
    """Reasons by count."""
    t = table(spark, sf, "compassion_synth_v06")
    return summary.histogram(t.select("id", validate.clean_reason(t, "axis").alias("reason")), "reason", ["id"])


@query(f"with r as (select axis, {CLEAN} as reason, count(*) as n, min(id) as f from compassion_synth_v06 group by 1, 2) select axis, reason, n from r where reason <> 'ok' qualify row_number() over (partition by axis order by n desc, f) = 1")
def top_reason_per_axis(spark, sf):
    """The most frequent reason to drop."""
    t = table(spark, sf, "compassion_synth_v06")
    return summary.top_by_group(t.select("axis", "id", validate.clean_reason(t, "axis").alias("reason")).where("reason <> 'ok'"), "axis", "reason", ["id"])


KINDS = {"compassion_synth_v06": "standard", "family_v03_additions": "missing:axis", "keigo_synth_v06": "standard", "silence": "silence_legacy"}


@query(" union all ".join(f"select '{n}' as name, case when " + " and ".join(f"{c} is not null" for c in (validate.STANDARD if k == "standard" else validate.SILENCE_LEGACY)) + f" then '{'standard' if k == 'standard' else 'silence_legacy'}' else 'missing:' || array_to_string(list_filter([" + ", ".join(f"case when {c} is null then '{c}' end" for c in sorted(validate.STANDARD)) + "], lambda x: x is not null), ',') end as kind, count(*) as n from " + n + " group by 2" for n, k in KINDS.items() if k == "standard"))
def schema_kind_counts(spark, sf):
    """Kinds of items of each table."""
    out = None
    for n, k in KINDS.items():
        if k == "standard":
            t = table(spark, sf, n)
            part = t.select(F.lit(n).alias("name"), validate.schema_kind(t).alias("kind")).groupBy("name", "kind").agg(F.count("*").alias("n"))
            out = part if out is None else out.unionByName(part)
    return out


#: Columns of the kinds of items that a table has not.
ABSENT = {"compassion_synth_v06": ("category", "ideal_action", "ideal_response_examples", "rubric"), "family_v03_additions": ("axis", "ideal_action", "ideal_response_examples"), "keigo_synth_v06": ("category", "user", "ideal_action", "ideal_response_examples", "rubric"), "silence": ("axis", "expected_qualities", "ideal_response_example")}


def _kind_sql(name: str) -> str:
    value = lambda c: "null" if c in ABSENT[name] else f'"{c}"'
    has = lambda keys: " and ".join(f"{value(c)} is not null" for c in keys)
    lacks = ", ".join(f"case when {value(c)} is null then '{c}' end" for c in sorted(validate.STANDARD))
    return f"select '{name}' as name, case when {has(validate.STANDARD)} then 'standard' when {has(validate.SILENCE_LEGACY)} then 'silence_legacy' else 'missing:' || array_to_string(list_filter([{lacks}], lambda x: x is not null), ',') end as kind, count(*) as n from {name} group by 2"


@query(" union all ".join(map(_kind_sql, KINDS)))
def schema_kind_counts_all(spark, sf):
    """Kinds of items of each table, also of those whose items are not standard."""
    parts = [(n, table(spark, sf, n)) for n in KINDS]
    counted = [t.select(F.lit(n).alias("name"), validate.schema_kind(t).alias("kind")).groupBy("name", "kind").agg(F.count("*").alias("n")) for n, t in parts]
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).unionByName(counted[3])


@query("select id, count(*) as n from compassion_synth_v06 group by id having count(*) > 1")
def dup_ids(spark, sf):
    """Ids that stand more than once."""
    return validate.duplicate_ids(table(spark, sf, "compassion_synth_v06"))


EXPECTED = [("compassion", 2255), ("family", 1000), ("keigo", 428), ("nuance", 5)]


@query("with e(task, expected) as (values " + ", ".join(f"('{a}', {b})" for a, b in EXPECTED) + "), c as (select task, count(*) as n from response group by task) select task, coalesce(n, 0) as n, expected, coalesce(coalesce(n, 0) = expected, false) as ok from c full join e using (task)")
def expected_counts(spark, sf):
    """Counts by task against expected ones."""
    return validate.count_check(table(spark, sf, "response"), spark.createDataFrame(EXPECTED, "task string, expected int"), "task")


@query(f"with d as (select *, row_number() over (partition by context, \"user\" order by id) > 1 as dup from (select distinct * from compassion_synth_v06)) select axis, count(*) as items, count_if({VALID} = 'ok') as valid, count_if(regexp_matches({LEAVES}, '{FIRE}')) as firewall_hits, count_if(dup) as duplicates, count_if(length(ideal_response_example) < 10) as ire_short, count_if(length(ideal_response_example) > 280) as ire_long from d group by axis")
def audit_by_axis(spark, sf):
    """Audit of the compassion items."""
    t = table(spark, sf, "compassion_synth_v06").distinct()
    key = F.struct(F.coalesce("context", F.lit("\x00")), F.coalesce("user", F.lit("\x00")))
    first = t.groupBy(key.alias("_key")).agg(F.min("id").alias("_first"))
    return validate.audit(t.withColumn("_key", key).join(first, "_key").drop("_key"), "axis", F.col("id") != F.col("_first"))


FIRE_D = "|".join(["ハナコ", "AI", "Wi-Fi".replace("-", "\\-")])


@query(f"select doc_id, regexp_matches(text, '{FIRE_D}') as hit from documents")
def firewall_scan(spark, sf):
    """Documents that hold one of the given terms."""
    return table(spark, sf, "documents").select("doc_id", pr.firewall_hit("text", ("ハナコ", "AI", "Wi-Fi")).alias("hit"))


@query()
def file_errors(spark, sf):
    """Errors of the raw lines of item files."""
    t = table(spark, sf, "raw_records").select(F.col("file_name").alias("file"), "line_no", F.col("raw_json").alias("line"))
    return validate.file_errors(t)


@query("with i as (select id from compassion_synth_v06 union select id from family_v03_additions union select id from keigo_synth_v06 union select id from silence), c as (select (select count(*) from response where task is not null) as parts, (select count(*) from response where id in (select id from i)) as master) select *, parts = master as ok from c")
def total_check(spark, sf):
    """Rows of the tasks together against the rows that answer an item."""
    t = table(spark, sf, "response")
    ids = [table(spark, sf, n).select("id") for n in ("compassion_synth_v06", "family_v03_additions", "keigo_synth_v06", "silence")]
    return validate.total_check(t, t.join(ids[0].union(ids[1]).union(ids[2]).union(ids[3]), "id", "left_semi"), "task")


# ---- construction --------------------------------------------------------------------------
KEY = "coalesce(context, '') || '|' || coalesce(\"user\", '')"


@query(f"select min(id) as id, count(*) as n from local_culture_synth_v06 group by left({KEY}, 100)")
def dedup_first100(spark, sf):
    """First item of each key of 100 characters."""
    t = table(spark, sf, "local_culture_synth_v06").withColumn("key", cs.dedup_key("context", "user", 100))
    n = t.groupBy("key").agg(F.count("*").alias("n"))
    return cs.first_wins(t.select("key", "id"), ["key"], ["id"]).join(n, "key").select("id", "n")


UNION = "(select 'compassion' as axis, 'seed' as source, 0 as part_ord, id, context, \"user\" from compassion_synth_v06 union all select 'keigo', 'seed', 1, id, context, null from keigo_synth_v06 union all select 'local_culture', 'synth', 2, id, context, \"user\" from local_culture_synth_v06)"


def _union(spark, sf):
    pick = lambda n: (lambda t: t.select("id", "context", *(["user"] if "user" in t.columns else [])))(table(spark, sf, n))
    return cs.tagged_union([(pick("compassion_synth_v06"), "seed", "compassion"), (pick("keigo_synth_v06"), "seed", "keigo"), (pick("local_culture_synth_v06"), "synth", "local_culture")])


@query(f"select axis, source, count(*) as n, count(distinct id) as ids from {UNION} group by all")
def build_union(spark, sf):
    """Sources under each other, tagged."""
    return _union(spark, sf).groupBy("axis", "source").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


FIRSTS = f"(select axis, {KEY} as k, arg_min(struct_pack(part_ord := part_ord, id := id, context := context, u := \"user\"), (part_ord, id)) as r from {UNION} group by all)"


@query(f"select axis, r.id as id from {FIRSTS}")
def dedup_within_axis(spark, sf):
    """First item of each key within its axis, seeds before synthetic items."""
    t = _union(spark, sf).withColumn("key", cs.dedup_key("context", "user"))
    return cs.first_wins(t.select("axis", "key", "part_ord", "id"), ["axis", "key"], ["part_ord", "id"]).select("axis", "id")


@query(f"select axis, 'v06-' || axis || '-' || lpad((row_number() over (partition by axis order by r.part_ord, r.id) - 1)::varchar, 4, '0') as id, r.id as orig_id from {FIRSTS}")
def stable_reid(spark, sf):
    """New ids by place in the axis."""
    t = _union(spark, sf).withColumn("key", cs.dedup_key("context", "user"))
    kept = cs.first_wins(t.select("axis", "key", "part_ord", "id"), ["axis", "key"], ["part_ord", "id"])
    return cs.renumbered(kept, "axis", ["part_ord", "id"]).select("axis", "id", "orig_id")


@query(f"select count(*) as rows, count(distinct {KEY}) as keys, count(*) - count(distinct {KEY}) as later from {UNION}")
def dup_count(spark, sf):
    """How many rows repeat an earlier key."""
    t = _union(spark, sf).select(cs.dedup_key("context", "user").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    return t.agg(F.sum("n").alias("rows"), F.count("*").alias("keys"), (F.sum("n") - F.count("*")).alias("later"))


# What an axis is about.
AXIS_ABOUT = [("compassion", "他者への思いやり (弱者支援・寄り添い・距離感)"), ("keigo", "敬語 (尊敬・謙譲・丁寧) の使い分け")]


@query(f"select distinct c.id, concat_ws(chr(10), c.axis || '軸: ' || coalesce(a.about, ''), '場面: ' || coalesce(context, ''), case when {s_strip(chr(34) + 'user' + chr(34))} <> '' then 'ユーザー発言: ' || {s_strip(chr(34) + 'user' + chr(34))} end, '回答:') as prompt, ideal_response_example as response from compassion_synth_v06 c left join (values " + ", ".join(f"('{a}', '{b}')" for a, b in AXIS_ABOUT) + ") a(axis, about) using (axis)")
def sft_pairs(spark, sf):
    """Prompt and response of training pairs."""
    t = table(spark, sf, "compassion_synth_v06").join(F.broadcast(spark.createDataFrame(AXIS_ABOUT, "axis string, about string")), "axis", "left")
    return t.select("id", cs.sft_prompt(F.col("axis"), F.col("about"), F.col("context"), F.col("user")).alias("prompt"), F.col("ideal_response_example").alias("response")).distinct()


@query("select id, coalesce(category, 'none:' || left(id, 3)) as category from family_v03_additions")
def default_fill(spark, sf):
    """Missing categories from a dimension of defaults."""
    t = table(spark, sf, "family_v03_additions").withColumn("kind", F.left("id", F.lit(3)))
    return cs.filled(t, spark.createDataFrame([("fam", "none:fam")], "kind string, category string"), "kind", "category").select("id", "category")


SPLIT = "(select axis, doc_id, row_number() over (partition by axis order by md5('2026:' || doc_id), doc_id) - 1 < floor(count(*) over (partition by axis) * 0.8) as train from documents)"


@query(f"select axis, case when train then 'train' else 'eval' end as part, count(*) as n from {SPLIT} group by all")
def stratified_split_counts(spark, sf):
    """Sizes of a split within axes."""
    return cs.split(table(spark, sf, "documents").select("axis", "doc_id"), "axis", "doc_id").groupBy("axis", "part").agg(F.count("*").alias("n"))


@query(f"select doc_id, case when train then 'train' else 'eval' end as part from {SPLIT}")
def split_membership(spark, sf):
    """The part of each document."""
    return cs.split(table(spark, sf, "documents").select("axis", "doc_id"), "axis", "doc_id").select("doc_id", "part")


@query("select source, doc_id from documents qualify row_number() over (partition by source order by md5('42:' || doc_id), doc_id) <= 3")
def sample_per_source(spark, sf):
    """Three drawn documents of each source."""
    return cs.sample_k(table(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id", 3).select("source", "doc_id")


@query("select source, doc_id from documents qualify row_number() over (partition by source order by doc_id) <= 5")
def first_k_per_source(spark, sf):
    """The first five documents of each source."""
    return cs.first_k(table(spark, sf, "documents").select("source", "doc_id"), "source", ["doc_id"], 5)


@query("select case when grouping(source) = 1 then 'TOTAL' else coalesce(source, '(null)') end as source, case when grouping(lang) = 1 then 'TOTAL' else coalesce(lang, '(null)') end as lang, count(*) as n from documents group by rollup (source, lang)")
def total_rollup(spark, sf):
    """Counts with subtotals and a grand total."""
    return summary.totals(table(spark, sf, "documents"), ["source", "lang"])


@query("select id from (select distinct id from compassion_synth_v06) where id not in (select id from response where task = 'compassion' and response <> '' and id is not null group by id having count(*) >= 3)")
def not_done(spark, sf):
    """Compassion items that have not been answered three times."""
    done = table(spark, sf, "response").where("task = 'compassion' and response <> ''")
    return cs.not_done(table(spark, sf, "compassion_synth_v06").select("id").distinct(), done, "id", 3)


@query(f"with i as (select id, 'compassion' as axis, 0 as o, context, \"user\" as u, {VALID} as r from (select distinct * from compassion_synth_v06) union all select id, 'local_culture', 1, context, \"user\", {VALID} from local_culture_synth_v06) select axis, count(*) as n from (select *, row_number() over (partition by coalesce(context, '') || '|' || coalesce(u, '') order by o, id) as k from i where r = 'ok') where k = 1 group by axis")
def dedup_after_cleaning(spark, sf):
    """Valid items of two axes, the first of each context and user over both."""
    parts = []
    for o, (axis, name) in enumerate((("compassion", "compassion_synth_v06"), ("local_culture", "local_culture_synth_v06"))):
        t = table(spark, sf, name)
        t = t.drop("batch_no", "line_no", "created_at").distinct() if axis == "compassion" else t.drop("batch_no", "line_no", "created_at")
        parts.append(t.select("id", F.lit(axis).alias("axis"), F.lit(o).alias("o"), cs.dedup_key("context", "user").alias("k"), validate.item_reason(t).alias("r")).where("r = 'ok'"))
    return cs.first_wins(parts[0].unionByName(parts[1]), ["k"], ["o", "id"]).groupBy("axis").agg(F.count("*").alias("n"))


# ---- generation and judging ----------------------------------------------------------------
@query("select id as seed_id, c as cycle, r as retry, round_even(0.7 + 0.1 * r + 0.05 * c, 6)::double as temperature, array_to_string(expected_qualities[((r + 2 * c) % len(expected_qualities)) + 1:((r + 2 * c) % len(expected_qualities)) + 2], ',') as hints from (select distinct id, expected_qualities from silence_seed), range(0, 3) t(c), range(0, 2) u(r)".replace("silence_seed", "keigo_synth_v06"))
def attempt_plan(spark, sf):
    """Attempts of cycles, seeds and retries with their turn of hints."""
    seeds = table(spark, sf, "keigo_synth_v06").select("id", "expected_qualities").distinct().withColumn("seed_ord", F.col("id"))
    p = generate.attempts(seeds, 3, 2, 0.7)
    return p.select(F.col("id").alias("seed_id"), "cycle", "retry", "temperature", F.array_join(generate.turned_hints(F.col("expected_qualities"), F.col("turn"), 2), ",").alias("hints"))


@query("with t as (select seed, id, row_id, response from response where task = 'family' and length(response) between 20 and 200), f as (select response as k, min(row_id) as row_id from t group by response) select row_id from f order by row_id limit 1000")
def replay_accept_loop(spark, sf):
    """The first thousand new valid candidates of a log."""
    log = table(spark, sf, "response").where("task = 'family'").select("response", "row_id")
    return generate.accepted(log, F.length("response").between(20, 200), "response", ["row_id"], 1000).select("row_id")


JUDGE_TEXTS = ["総合: 9", "Total 15", "score：7", "は5点", "(5)", "none", "合計 12 / 12", "SCORE:\t3", "score 99999999999999999999", "", None, "点は 11 です", "13 or 7"]


@query("select * from (values " + ", ".join(f"({i}, {s})" for i, s in enumerate([9, 12, 7, "null", 5, "null", 12, 3, 12, "null", "null", 11, 7])) + ") t(i, score)")
def judge_score_parse(spark, sf):
    """Scores in judges' texts, with wide colons, other numbers and none."""
    t = spark.createDataFrame(list(enumerate(JUDGE_TEXTS)), "i int, t string")
    return t.select("i", judge.parse_score("t").alias("score"))


@query("with r as " + s_last("silence") + ", t as (select s.id, length(coalesce(nullif(response, chr(0)), '')) as n, coalesce(nullif(response, chr(0)), '') as x from silence s left join r using (id)) select 'silence' as task, count(*) as n, count(*) as judged, round_even(avg(case when " + s_strip("x") + " = '' then 0 when n between 5 and 150 then 9 else 5 end), 6)::double as mean_score, round_even(avg((n > 0 and n < 3)::int), 6) as degenerate_rate from t")
def judge_stub(spark, sf):
    """A judge without a model over silence items."""
    t = scoring.all_items(table(spark, sf, "silence"), _last(spark, sf, "silence"))
    p = t.select(F.lit("silence").alias("task"), "response", judge.judge_prompt(F.col("context"), F.col("user"), F.col("rubric"), F.col("anti_patterns"), F.col("response")).alias("prompt"))
    return judge.judge_summary(judge.judged(p, "prompt"), "task")


def _attempt_log(spark, sf):
    """Raw lines of item files as a log of attempts: a feed's files are its seeds, a line in three
    another cycle, and lines of one file further tries."""
    t = table(spark, sf, "raw_records").where("file_seq is not null and line_no is not null").groupBy("feed", "file_seq", "line_no").agg(F.max("raw_json").alias("response"))
    return t.select("feed", (F.col("line_no") % 3).alias("cycle"), F.concat_ws("/", "feed", F.format_string("%06d", "file_seq")).alias("seed_ord"), F.floor(F.col("line_no") / 3).alias("retry"), F.col("feed").alias("seed_id"), "response")


@query()
def replay_generation(spark, sf):
    """The accept loop over the attempt log: every object of the attempts made, with its outcome."""
    return generate.accept_loop(_attempt_log(spark, sf), 100_000)


@query()
def generation_metrics(spark, sf):
    """Outcomes of the attempts made."""
    return generate.run_metrics(generate.accept_loop(_attempt_log(spark, sf), 100_000))


J_WRONG = lambda k: f"json_type(j, '$.{k}') <> 'ARRAY'"
J_N = lambda k: f"json_array_length(j, '$.{k}')"
J_SHAPE = lambda k: f"len(list_filter(json_extract(j, '$.{k}[*]'), lambda e: json_type(e) <> 'VARCHAR' or length(e ->> '$') not between 2 and 100)) > 0"
J_GONE = "array_to_string(list_filter([" + ", ".join(f"case when not json_exists(j, '$.{k}') then '{k}' end" for k, _ in REQ) + "], lambda x: x is not null), ',')"
J_TEXT = lambda k: f"json_type(j, '$.{k}') = 'VARCHAR'"
J_LEN = lambda k: f"length(j ->> '$.{k}')"
J_REASON = f"""case when json_type(j) <> 'OBJECT' then 'not-a-dict' when {J_GONE} <> '' then 'missing:' || {J_GONE} when {J_WRONG('expected_qualities')} then 'eq-not-list' when {J_WRONG('anti_patterns')} then 'ap-not-list'
    when {J_N('expected_qualities')} not between 2 and 6 then 'eq-len:' || {J_N('expected_qualities')} when {J_N('anti_patterns')} not between 2 and 6 then 'ap-len:' || {J_N('anti_patterns')} when {J_SHAPE('expected_qualities')} then 'eq-item-shape' when {J_SHAPE('anti_patterns')} then 'ap-item-shape'
    when not {J_TEXT('ideal_response_example')} then 'ire-len:N/A' when {J_LEN('ideal_response_example')} not between 5 and 500 then 'ire-len:' || {J_LEN('ideal_response_example')} when not {J_TEXT('context')} or {J_LEN('context')} < 5 then 'ctx-too-short' else 'ok' end"""


@query(f"with t as (select try_cast(raw_json as json) as j from raw_records where raw_json is not null and trim(raw_json) <> '' and json_valid(raw_json)), r as (select {J_REASON} as reason, json_type(j) = 'OBJECT' and {J_GONE} = '' and not {J_WRONG('expected_qualities')} and not {J_WRONG('anti_patterns')} and {J_N('expected_qualities')} >= 2 and {J_N('anti_patterns')} >= 2 and {J_TEXT('ideal_response_example')} and {J_LEN('ideal_response_example')} between 5 and 500 as older from t where json_type(j) = 'OBJECT') select reason, count(*) as n, count_if(older)::bigint as valid_v1 from r group by reason")
def raw_item_reasons(spark, sf):
    """Why raw items, whose fields have any type, are not valid, and how many the older rule takes."""
    lines = table(spark, sf, "raw_records").select(F.col("raw_json").alias("line")).where("line is not null")
    return validate.line_reasons(lines, "line", firewall=()).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"), F.count_if("valid_v1").alias("valid_v1"))


@query()
def parse_response(spark, sf):
    """Objects in raw lines of generated JSON, cut-off ones rescued."""
    t = table(spark, sf, "raw_records").select("feed", "file_seq", "line_no", generate.parsed("raw_json").alias("items"))
    return t.select("feed", "file_seq", "line_no", F.size("items").alias("n"), F.xxhash64("items").alias("hash"))


@query("select distinct id, context || '…' as response from silence")
def generate_stub(spark, sf):
    """A model that echoes its prompt."""
    t = table(spark, sf, "silence").select("id", "context").distinct()
    return generate.generated(t, "context", lambda: lambda ps: [f"{p}…" for p in ps]).select("id", "response")


# ---- contamination -------------------------------------------------------------------------
def _test_texts(spark, sf):
    f, s = table(spark, sf, "family_v03_additions"), table(spark, sf, "silence")
    both = [t.select(F.lit(n).alias("split"), "id", F.concat("context", F.lit(" "), "user").alias("text")) for n, t in (("family", f), ("silence", s))]
    keigo = table(spark, sf, "keigo_synth_v06").select(F.lit("keigo").alias("split"), "id", F.concat("context", F.lit(" ")).alias("text")).distinct()
    return both[0].unionByName(both[1]).unionByName(keigo)


GRAMS8 = "range(1, length(t) - 6)"
LEAK = f"""with i as (select 'family' as split, id, context || ' ' || "user" as t from family_v03_additions union all select 'silence', id, context || ' ' || "user" from silence union all select distinct 'keigo', id, context || ' ' from keigo_synth_v06),
    g as (select distinct split, id, unnest(list_transform({GRAMS8}, lambda k: substr(t, k, 8))) as g from i), c as (select distinct unnest(list_transform({GRAMS8}, lambda k: substr(t, k, 8))) as g from (select text as t from documents)),
    h as (select split, id, count(*) as n_grams, count(c.g) as n_hits from g left join c using (g) group by all), o as (select i.id, i.split, coalesce(n_grams, 0) as n_grams, coalesce(n_hits, 0) as n_hits, round_even(n_hits / n_grams, 6)::double as ratio from i left join h using (split, id))"""


@query(f"{LEAK} select id, n_grams, n_hits, ratio from o")
def decontam_items(spark, sf):
    """Share of each item's 8-grams in the documents."""
    return contamination.leak_ratios(_test_texts(spark, sf), table(spark, sf, "documents"))


@query(f"{LEAK} select split, count(*) as n_questions, round_even(avg(ratio), 6) as mean_leak_ratio, round_even(max(ratio), 6) as max_leak_ratio, count_if(ratio > 0.3) as n_leaks from o group by split")
def decontam_summary(spark, sf):
    """Leaks by split."""
    items = _test_texts(spark, sf)
    return summary.leak_summary(contamination.leak_ratios(items, table(spark, sf, "documents")).join(items.select("id", "split"), "id"), "split")


@query(f"{LEAK} select split, id, n_grams, n_hits, ratio from o where ratio > 0.3")
def decontam_leaks(spark, sf):
    """The items of each split that leaked."""
    items = _test_texts(spark, sf)
    found = contamination.leak_ratios(items, table(spark, sf, "documents")).join(items.select("id", "split"), "id")
    return summary.leaks(found).select("split", "id", "n_grams", "n_hits", "ratio")


# ---- streams -------------------------------------------------------------------------------
@query(f"select date_trunc('day', ingested_at) as window_start, variant, count(*) as n, count_if(coalesce({s_degenerate('response')}, '') <> '') as degenerate from (select distinct on (row_id) * from response where ingested_at is not null) group by all".replace("date_trunc('day', ingested_at)", "strftime(ingested_at, '%Y-%m-%d')"))
def stream_rates(spark, sf):
    """The windowed rates of response streams, over the table."""
    return degenerate_rates(table(spark, sf, "response")).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


# ---- schemas that drift --------------------------------------------------------------------
@query()
def p6_found(spark, sf):
    """Every change of fields from file to file."""
    return schema_drift.changes(table(spark, sf, "raw_records"))


@query()
def p6_path_kinds(spark, sf):
    """Kinds of each path by relation."""
    return schema_drift.path_kinds(table(spark, sf, "raw_records")).groupBy("relation", "path", "kind").agg(F.sum("n").alias("n"))


ITEM_COLUMNS = {"id": "string", "axis": "string", "category": "string", "context": "string", "user": "string", "expected_qualities": "array", "anti_patterns": "array", "ideal_response_example": "string", "ideal_response_examples": "array", "ideal_action": "string", "synth_seed_id": "string", "rubric": "object", "tribegings": "array", "kenjougo_or_teineigo": "boolean"}


@query()
def p6_unified(spark, sf):
    """All items in one typed table, under their first names, with failed casts."""
    lines = table(spark, sf, "raw_records")
    renames = schema_drift.changes(lines).where("change_kind = 'renamed' and not contains(field_path, '.') and not contains(new_path, '.')").select("field_path", "new_path").distinct()
    known = {r.new_path: r.field_path for r in renames.orderBy("field_path", "new_path").collect()}  # distinct names of fields
    first = {}
    for new, old in known.items():
        seen = {new}
        while old in known and old not in seen and old not in ITEM_COLUMNS:
            seen.add(old)
            old = known[old]
        if new not in ITEM_COLUMNS and old in ITEM_COLUMNS:
            first[new] = old
    return schema_drift.unify(lines, ITEM_COLUMNS, first)
