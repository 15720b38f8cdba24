"""Queries of the operators for training data, over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsumugi.llm import difficulty, history, leaks, lookalikes, mixing, packing, pairs, repetition, residue
from tsumugi.sources.tables import table

ITEM_TABLES = ("compassion_synth_v06", "family_v03_additions", "keigo_synth_v06", "silence")


def _compassion_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "compassion_synth_v06").select("id", F.coalesce("user", "context").alias("prompt"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Defective pairs of the compassion task with their defect."""
    answers = table(spark, sf, "response").where("task = 'compassion'").select("row_id", "id", "response")
    return pairs.broken_pairs(answers, _compassion_prompts(spark, sf))


def p2_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Defects by variant."""
    who = table(spark, sf, "response").where("task = 'compassion'").select("row_id", "variant").distinct()
    return p2_found(spark, sf).join(who, "row_id").groupBy("variant", "defect").agg(F.count("*").alias("n"))


def p3_share(spark: SparkSession, sf: str) -> DataFrame:
    """Share of repeated content of each response."""
    rows = table(spark, sf, "response").select("row_id", "response").where("row_id is not null")
    return repetition.repetition(rows, "row_id", "response").groupBy("row_id").agg(*(F.max(c).alias(c) for c in ("n_chars", "n_letters", "repeated_share", "gram_share", "line_share")))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Responses that repeat themselves, but for residue and copied prompts."""
    rows = table(spark, sf, "response").select("row_id", "id", "task", "response").where("row_id is not null")
    high = repetition.repetition(rows, "row_id", "response").where((F.col("n_chars") >= repetition.MIN_CHARS) & (F.col("repeated_share") >= repetition.MIN_SHARE)).select("row_id").distinct()
    texts = rows.join(high, "row_id", "left_semi").where(~residue.residue_flag("response"))
    copied = pairs.copied_pairs(texts.where("task = 'compassion'").select("row_id", "id", "response"), _compassion_prompts(spark, sf))
    return texts.select("row_id").distinct().join(copied, "row_id", "left_anti")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Responses and compassion items that hold residue."""
    answers = table(spark, sf, "response").select(F.lit("response").alias("src"), F.col("row_id").cast("string").alias("record_key"), F.col("id").alias("item"), "variant", F.col("response").alias("text"))
    items = table(spark, sf, "compassion_synth_v06").select(F.lit("compassion_synth_v06").alias("src"), F.col("id").alias("record_key"), F.col("id").alias("item"), F.lit("items").alias("variant"), F.col("ideal_response_example").alias("text"))
    prompts = [t.select(F.col("id").alias("item"), F.concat_ws("\n", "context", *(["user"] if "user" in t.columns else [])).alias("prompt")) for t in (table(spark, sf, n) for n in ITEM_TABLES)]
    return residue.find_residue(answers.unionByName(items), reduce(DataFrame.unionByName, prompts))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of items whose texts read alike in different characters."""
    return lookalikes.alike_pairs(table(spark, sf, "compassion_synth_v06"), ["context", "user", "ideal_response_example"])


def p5_forms(spark: SparkSession, sf: str) -> DataFrame:
    """The consistent form of each text."""
    fields = ["context", "user", "ideal_response_example"]
    return lookalikes.unify(table(spark, sf, "compassion_synth_v06").select("id", *fields), fields).distinct()


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Rows to reject with the accepted row they repeat, batch after batch."""
    return history.repeats(table(spark, sf, "local_culture_synth_v06"), ["context", "user"], "batch_no", "line_no")


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their size: a token a byte of the text and one at its end."""
    return table(spark, sf, "documents").select("doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("tokens"))


def _test_items(spark: SparkSession, sf: str) -> DataFrame:
    family, legal = table(spark, sf, "family_v03_additions"), table(spark, sf, "yamato_legal_v02_additions")
    answers = family.select(F.col("id").alias("item_id"), F.col("ideal_response_example").alias("text")).unionByName(legal.select(F.col("id").alias("item_id"), F.col("ideal_response_example").alias("text")))
    return answers.unionByName(family.select(F.col("id").alias("item_id"), F.col("user").alias("text")))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents into which test items leaked, with the items."""
    return leaks.find_leaks(table(spark, sf, "documents"), _test_items(spark, sf))


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    """Leaks and paraphrases with their cosine and common subsequence."""
    return leaks.find_leaks(table(spark, sf, "documents"), _test_items(spark, sf), paraphrases=True)


def p8_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Every document in containers of each capacity."""
    return packing.pack_all(_sized(spark, sf), table(spark, sf, "pack_specs"))


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers and used share of each capacity."""
    packed = p8_pack(spark, sf).groupBy("spec_id", "container_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    by_spec = packed.groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), F.sum("n").alias("pieces"))
    return by_spec.join(F.broadcast(table(spark, sf, "pack_specs")), "spec_id").withColumn("used_share", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of each mix in the order of their virtual finish."""
    return mixing.mix(_sized(spark, sf), table(spark, sf, "mix_targets"))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual share of each source."""
    targets = table(spark, sf, "mix_targets")
    return mixing.shares(mixing.mix(_sized(spark, sf), targets), targets)


def p10_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Estimated reading level of each Japanese document."""
    return difficulty.reading_levels(table(spark, sf, "documents"), table(spark, sf, "reading_labels"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose main text is at level 4 or 5."""
    return p10_levels(spark, sf).where("p4 + p5 >= 0.5").select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_counts, p3_found, p3_share, p4_found, p5_found, p5_forms, p7_found, p8_pack, p8_fill, p9_mix, p9_shares, p10_found, p10_levels)}
MIXED = """with r as (select doc_id, source, coalesce(strlen(text), 0) + 1 as tokens from documents),
    w as (select distinct mix_id, source, target_share, max_repeats from mix_targets where target_share > 0 and max_repeats >= 1),
    t as (select source, sum(tokens)::bigint as total from r group by source),
    b as (select mix_id, min(total * max_repeats / target_share) as budget from t join w using (source) group by mix_id),
    q as (select w.mix_id, source, target_share, max_repeats, total, doc_id, tokens, (sum(tokens) over (partition by w.mix_id, source order by md5('2026:' || doc_id), doc_id))::bigint as upto from r join w using (source) join t using (source)),
    c as (select *, unnest(range(1, max_repeats + 1)) as pass from q),
    f as (select *, ((pass - 1) * total + upto)::bigint / target_share as virtual_finish from c),
    g as (select *, sum(tokens) over (partition by mix_id order by virtual_finish, source, doc_id, pass) as served from f),
    m as (select mix_id, source, doc_id, pass::int as pass, tokens::bigint as tokens, virtual_finish from g join b using (mix_id) where served <= budget)"""
SQL: dict[str, str] = {
    "p9_mix": f"{MIXED} select * from m",
    "p9_shares": f"""{MIXED}, s as (select mix_id, source, sum(tokens)::bigint as tokens, count(*) as uses, max(pass) as repeats from m group by all),
    x as (select mix_id, source, target_share, coalesce(tokens, 0)::bigint as tokens, coalesce(uses, 0) as uses, coalesce(repeats, 0)::int as repeats from mix_targets left join s using (mix_id, source))
    select mix_id, source, target_share, round(tokens / sum(tokens) over (partition by mix_id), 6) as actual_share, round(greatest(0, target_share - actual_share), 6) as shortfall, tokens, uses, repeats from x""",
}
