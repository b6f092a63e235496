import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import lexicon
from textloom.functions import text as X

# raw text -> surface after cleaning and rewriting, canonical name
VARIANTS = {
    "gpt-4o": ("GPT4O", "gpt-4o"), "gpt-4.5": ("GPT4.5", "gpt-4"), "chat-gpt": ("CHATGPT", "chatgpt"), "gpt 4": ("GPT4", "gpt-4"), "gpt 3.5 turbo": ("GPT3.5TURBO", "gpt-3.5"), "chatgpt 4": ("CHATGPT4", "gpt-4"),
    "chat-gpt 4 mini": ("CHATGPT4MINI", "gpt-4"), "gpt4 turbo": ("GPT4TURBO", "gpt-4"), "gpt5": ("GPT5", "gpt-5"), "gpt": ("GPT", "chatgpt"), "gpt4.md": (None, None), "chatgpt123": (None, None),
}


def one(spark, rows, *cols, schema="c string"):
    return [tuple(r) for r in spark.createDataFrame([(x,) for x in rows], schema).select(*cols).collect()]


def python_rewrite(t):
    for p in lexicon.DETECT.values():
        t = re.sub(p, lambda m: m.group(0).replace(" ", "").replace("-", "").replace("_", "").upper(), t, flags=re.I)
    return t


def test_variants(spark):
    rows = [f"i asked {v} today." for v in VARIANTS]
    s = X.normalize_names(X.clean(F.lower("c")))
    for (got,), (surface, name) in zip(one(spark, rows, s), VARIANTS.values()):
        found = [w.strip(".") for w in got.split() if "GPT" in w]
        assert found == ([surface] if surface else []), got
    names = one(spark, [s or "none" for s, _ in VARIANTS.values()], X.canonical(F.col("c")))
    assert [n for (n,) in names] == [n for _, n in VARIANTS.values()]


def test_rewriting_equals_sequential_substitution(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").where("text is not null")
    extra = ["chat gpt 4.5 turbo's end", "gpt-4 gpt 4 chat-gpt-5, gpt_4", "GPT 3.5, gpt-35 mini; chatgpt 4o-mini", "", "no names"]
    df = df.unionByName(spark.createDataFrame([(e,) for e in extra], "text string"))
    for r in df.select("text", X.normalize_names(F.col("text")).alias("n")).collect():
        assert r.n == python_rewrite(r.text)


@pytest.mark.parametrize("text,want", [("chatgpt_test", "CHATGPT test"), ("chatgpt's amazing", "CHATGPT 's amazing"), ("'chatgpt'", "'chatgpt'"), ("a*b#c~d/e|f", "a b c d e f"), ("(x)[y]", "( x ) [ y ]"), ("“q” ‘s’", "\"  q  \" 's'".replace('"  q  "', '" q "'))])
def test_pipeline_clean(spark, text, want):
    assert one(spark, [text], X.normalize_names(X.clean(F.col("c"))))[0][0] == want


def test_tester_clean(spark):
    assert one(spark, ["wait… what!!! (a_b) it's"], X.clean(F.col("c"), "tester"))[0][0] == "wait. what! ( a_b ) it ' s"


def test_sentences_and_modes(spark):
    t = "Use gpt-4. The bot is fine! Nope"
    s = X.cleaned_sentences(F.col("c"))
    assert one(spark, [t], s)[0][0] == ["use GPT4.", "the bot is fine !", "nope"]
    assert one(spark, [t], X.mention_sentences(s))[0][0] == ["use GPT4."]
    assert len(one(spark, [t], X.mention_sentences(s, "NONE"))[0][0]) == 3
    assert one(spark, ["bot"], X.mention_sentences(s, "EXTRA"))[0][0] == ["bot"]
    assert one(spark, ["bot. gemini"], X.mention_sentences(s, "EXTRA", exclude="gemini"))[0][0] == []


def test_routes_and_counts(spark):
    got = one(spark, ["a" * 8000, "a" * 8001, "a" * 20000, "a  b c ", "", None], X.length_route(F.col("c")), F.size(X.words(F.col("c"))), X.is_blank(F.col("c")))
    assert [g[0] for g in got] == ["batch", "single", "drop", "batch", "batch", "batch"]
    assert got[3][1] == 3 and got[4][1] == 0 and got[4][2] and got[5][2] and not got[3][2]


def test_skip_categories(spark):
    rows = ["see _URL_ chatgpt", "in _subreddit_", "CGPT 4 says", "chatgpt’s view", "chatgpt-based", "chat gpt+x", "chatgpt is", "nothing", None]
    want = [["_URL_"], ["_SUBREDDIT_"], ["cgpt_mentions"], ["chatgpt_mentions", "chatgpt_possessive"], ["chatgpt_mentions", "chatgpt_hyphen"], ["chatgpt_mentions", "chatgpt_symbol"], ["chatgpt_mentions", "chatgpt_other"], ["other"], ["other"]]
    assert [g[0] for g in one(spark, rows, X.skip_category(F.col("c")))] == want


def test_other_cleaners(spark):
    assert one(spark, ["hi @bob!"], X.langid_clean(F.col("c")))[0][0] == "hi"
    assert one(spark, ["- Mor_ge\"n 12 aIlid feI"], X.langid_sentence(F.col("c")))[0][0] == "Morgen allid fel"
    assert one(spark, ["well-known a/b 10 1"], X.sentiment_words(F.col("c"), digits=True))[0][0] == ["well", "known", "a", "b", "##", "1"]
    assert one(spark, ["-/"], X.sentiment_words(F.col("c")))[0][0] == ["-"]
    t = one(spark, [["RT", "@x", ":", "#go", "http://a"], ["RT", "@", "x", ":", "y"], ["@me", "ok"], ["plain"], []], X.tweet_tokens(F.col("c")), schema="c array<string>")
    assert [x[0] for x in t] == [["go", " "], ["y"], ["ok"], ["plain"], []]
    assert one(spark, ["a www.x.org b me@x.org"], X.link_spans(F.col("c")))[0][0] == [(2, 11), (14, 22)]
    assert one(spark, [["a", "<PAD>", "b", "c", "<PAD>"], [], ["<PAD>"]], X.runs_without(F.col("c"), "<PAD>"), schema="c array<string>") == [([(0, 1), (2, 4)],), ([],), ([],)]
    assert one(spark, ["a\n \nb", "\n\n"], X.paragraphs(F.col("c"))) == [(["a", "b"],), ([],)]


def test_misc_columns(spark):
    assert one(spark, ["a=1|b=x=y|c", "_", None, "a=1|a=2"], X.key_values(F.col("c"))) == [({"a": "1", "b": "x=y", "c": None},), ({},), ({},), ({"a": "1"},)]
    assert one(spark, ["UnbanMoxOpal=Yes|SpaceAfter=No", "CorrectSpaceAfter=No", None], X.no_space_after(F.col("c"))) == [(True,), (False,), (False,)]
    assert one(spark, ["_", "x=1"], X.add_space_after(F.col("c"))) == [("SpaceAfter=No",), ("x=1|SpaceAfter=No",)]
    assert one(spark, ["SpaceAfter=No", "x=1|SpaceAfter=No"], X.drop_space_after(F.col("c"))) == [("_",), ("x=1",)]
    with pytest.raises(Exception):
        one(spark, ["_"], X.drop_space_after(F.col("c")))
