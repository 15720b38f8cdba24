import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tsumugi.llm import lookalikes as la


@pytest.mark.parametrize("a, b", [("ﾊﾟｿｺﾝ", "パソコン"), ("カﾞ", "ガ"), ("が", "が"), ("café", "café"), ("ｃａｆｅ́", "café"), ("саfé", "café"), ("Ｗｉ－Ｆｉ", "Wi‑Fi"), ("a　b", "a b"), ("x​﻿y", "xy"), ("⼒", "カ"), ("エ", "工"), ("ｶ​ﾞ", "ガ"), ("ー", "─"), ("１", "1"), ("ё", "ë"), ("一", "⼀")])
def test_alike(a, b):
    assert la.consistent(a) == la.consistent(b)


@pytest.mark.parametrize("a, b", [("か", "が"), ("ソ", "ン"), ("a", "A"), ("。", "."), ("①", "1"), ("…", "..."), ("👨‍👩", "👨👩")])
def test_not_alike(a, b):
    assert la.consistent(a) != la.consistent(b)


@pytest.mark.parametrize("text", ["一人で三千円", "力を入れる", "2026-11-26", "well-known", "もう一人の工場長", "人口データ", "八ヶ岳と三ツ星", "入口へ行く", "ビール二杯", "千円札を八枚", "アメリカ人", "コーヒー豆", "カニを食べる", "サーバー管理", "東京―大阪", "――そう", "らーめん屋", "えー、", "вода", "ελληνικά", "co-op", "唯一の", "第二回", "ニュースとミルク", "~/home"])
def test_right_text_is_not_changed(text):
    assert la.consistent(text) == text


@pytest.mark.parametrize("a, b", [("コーヒー", "コ一ヒ─"), ("アメリカ", "アメリ力"), ("エラーとロープ", "工ラーと口一プ"), ("タオル", "夕オル"), ("ヘリコプター", "へリコプター"), ("вода", "вoдa"), ("Wi-Fi", "Wi‐Fi"), ("一人", "ー人"), ("力仕事", "カ仕事"), ("３－２", "3-2"), ("ニュース", "二ュース"), ("\u1ec7", "e\u0302\u0323"), ("e\u0302\u0323", "e\u0323\u0302"), ("が", "か\u200b\u3099")])
def test_context_tells(a, b):
    assert a != b and la.consistent(a) == la.consistent(b)


@given(st.text(st.sampled_from("aeoかハウカ力一ー-―二\u0301\u0302\u0323\u3099\u309a\u200dｶﾞがйА"), max_size=8))
@settings(max_examples=300, deadline=None)
def test_canonically_equal_texts_meet(text):
    forms = {la.consistent(unicodedata.normalize(f, text)) for f in ("NFC", "NFD")} | {la.consistent(text)}
    assert len(forms) == 1
    form = forms.pop()
    assert la.consistent(form) == form


def test_closed_and_one_pass():
    for a in list(la.compile_map()) + ["が" * 9, "", "x"]:
        form = la.consistent(a)
        assert la.consistent(form) == form
        assert la.consistent(unicodedata.normalize("NFD", form)) == form or len(a) > 1
    assert la.consistent(None) is None


def test_conflicts_are_found(monkeypatch):
    monkeypatch.setattr(la, "_rules", lambda: iter([("a", "b"), ("b", "a")]))
    la.compile_map.cache_clear()
    with pytest.raises(la.Conflict):
        la.compile_map()
    monkeypatch.setattr(la, "_rules", lambda: iter([("a", "b"), ("a", "c")]))
    with pytest.raises(la.Conflict):
        la.compile_map()
    monkeypatch.undo()
    la.compile_map.cache_clear()


def test_pairs_by_brute_force(spark):
    texts = ["カフェ", "ｶﾌｪ", "カフェ​", "別", "", "​", None, "カフェ", "長" * 100_000, "長" * 100_000 + "﻿"]
    rows = [(f"i{k}", t, None) for k, t in enumerate(texts)] + [("i0", texts[0], None), (None, "カフェ", None), ("i3", "別​", None)]
    df = spark.createDataFrame(rows, "id string, context string, field string")
    got = [tuple(r) for r in la.alike_pairs(df, ["context"]).collect()]
    known = {(k, t) for k, t, _ in rows if k is not None and t is not None}
    want = {("context", a, b) for a, s in known for b, t in known if a < b and s != t and la.consistent(s) == la.consistent(t)}
    assert set(got) == want and len(got) == len(set(got))
    assert la.alike_pairs(df.limit(0), ["context"]).count() == 0
    assert la.unify(df, ["context"]).columns == ["id", "context", "field", "context_form"]


def test_hot_identical_strings(spark):
    df = spark.range(4000).selectExpr("cast(id as string) as id", "case when id = 7 then 'ｶ' else 'カ' end as context")
    assert la.alike_pairs(df, ["context"]).count() == 3999
    assert la.classes(df, "context").where("n_strings = 2 and n_rows = 4000").count() == 4000
