import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from textloom.llm import lookalikes as L

CASES = {
    "ｌyｒｉｃ": ("lyric", "form"), "eﬀect": ("effect", "form"), "Witho⁠ut": ("Without", "invisible"), "se­tting": ("setting", "invisible"), "café": ("café", "accent"),
    "a b": ("a b", "space"), "step‑form": ("step-form", "hyphen"), "nаіvе": ("naive", "script"), "whаtеνеr": ("whatever", "script"), "ｇｐｔ－４": ("gpt-4", "form"), "x‍y": ("xy", "invisible"),
}
PLAIN = ["résumé", "Вчера наш черновик", "“quoted”", "20 – 4", "one\ntwo\tthree", "🤷‍♂️ ok", "👨‍💻", "1️⃣", "你好，世界！", "", "ﾊ", "GPTшный"]


# every one of these looks like ordinary text and has to change
DISGUISED = {"ɡpt": "gpt", "ıt": "it", "Ꮯhat": "Chat", "ᴄhat": "chat", "ℂhat": "Chat", "𝐠pt": "gpt", "ⓖpt": "gpt", "ғoo": "roo", "whаtеvжr": "whatevжr", "Ιt": "It", "ОK": "OK"}


@pytest.fixture(scope="module")
def looks(spark):
    return L.Looks(L.confusables(spark))


def test_cases(looks):
    for t, (form, why) in CASES.items():
        assert looks.consistent(t) == (form, {why}), t
    for t in [*PLAIN, "łódź", "ładny", "Straße", "œuvre", "æther", "øl", "x² ™ 10µm ªº", "ChatGPTшный", "çok altı", "ⅳ", "ℹ️"]:
        assert looks.consistent(t) == (t, frozenset()), t
    for t, form in DISGUISED.items():
        assert looks.consistent(t)[0] == form, t
    assert looks.consistent(None) == (None, frozenset())


def test_skeletons(looks):
    same = [("rnodern", "modern"), ("ɡpt", "gpt"), ("ıt", "it"), ("Ꮯhat", "Chat"), ("ᴄhat", "chat"), ("ℂhat", "Chat"), ("𝐠pt", "gpt"), ("ⓖpt", "gpt"), ("Ɩ", "l"), ("1l", "Il"), ("café", "café"), ("ex\u200bit", "exit"), ("vvord", "vvord"), ("ｍ", "rn")]
    for a, b in same:
        assert looks.skeleton(a) == looks.skeleton(b), (a, b)
    assert looks.skeleton("gpt") != looks.skeleton("qpt") and looks.skeleton(None) is None and looks.skeleton("") == ""
    assert 4000 < len(looks.table) < 20000


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(alphabet=st.one_of(st.characters(), st.sampled_from("aеο‍️́ｌ♂👨‑ ")), max_size=30))
def test_consistent_is_stable(looks, t):
    form, _ = looks.consistent(t)
    again, _ = looks.consistent(form)
    assert looks.consistent(again)[0] == again
    s = looks.skeleton(t)
    assert unicodedata.is_normalized("NFD", s)


def test_tables(spark):
    rows = [("1", "plain", ["gpt"], "x"), ("2", "nаіvе", None, None), ("2", "nаіvе", None, None), ("3", None, ["ｇｐt", None], None), (None, "ｌ", None, None), ("4", "", [], None), ("5", "x " * 100000 + "​", None, None)]
    df = spark.createDataFrame(rows, "id string, body string, models_detected array<string>, field string")
    assert sorted(map(tuple, L.changed_fields(df).collect())) == [("2", "body"), ("3", "models_detected"), ("5", "body")]
    assert L.consistent_entries(df).count() == len(rows)
    assert L.changed_fields(df.limit(0)).count() == 0
    names = spark.createDataFrame([("gpt",), ("ｇｐt",), ("gpt",), ("gрt",), (None,), ("x",)], "name string")
    assert {(r.skeleton, r.original, r.n, r.variants) for r in L.skeleton_groups(names, "name").collect()} == {("gpt", "gpt", 2, 3), ("gpt", "ｇｐt", 1, 3), ("gpt", "gрt", 1, 3), ("x", "x", 1, 1)}
    bodies = spark.createDataFrame([("Use modern GPT",), ("use ｍodern gрt",), ("plain plain",), (None,), ("",)], "body string")
    got = {(r.original, r.variants) for r in L.word_groups(bodies, "body").collect()}
    assert got == {("modern", 2), ("ｍodern", 2), ("gpt", 2), ("gрt", 2)}
