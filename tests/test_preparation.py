"""Treebank preparation, batching and segmented corpora: the cases that raise, and literal ones."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import batching as K
from textloom.operators import treebank_prep as P
from textloom.operators import trees as T
from textloom.sources import segmented as G


def block(*lines):
    return "\n".join(lines)


TEXT = ["# sent_id = 1", "# text = ab cd ,  x .", "# translit = ab cd ,  x .", "1\tab\t_\t_\t_\t_\t0\troot\t_\t_", "2\tcd\t_\t_\t_\t_\t1\tdep\t_\t_", "3\t,\t_\t_\t_\t_\t1\tdep\t_\t_", "4\tx\t_\t_\t_\t_\t1\tdep\t_\t_", "5\t.\t_\t_\t_\t_\t1\tdep\t_\t_"]


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "value string").select(f(F.col("value"))).first()[0]


def test_telugu_copies(spark):
    comma = one(spark, block(*TEXT), P.joined_comma).split("\n")
    assert comma[1] == "# text = ab cd,  x ." and comma[2] == "# translit = ab cd,  x ." and comma[4].endswith("_|SpaceAfter=No") and comma[3] == TEXT[3]
    mark = one(spark, block(*TEXT), P.joined_final_mark).split("\n")
    assert mark[1] == "# text = ab cd ,  x." and mark[-2].endswith("_|SpaceAfter=No")
    assert one(spark, block(*TEXT).replace("x .", "x . . ."), P.joined_final_mark) is None


def test_arabic_copies(spark):
    tight = block("# sent_id = 1", "# text = ab cd.", "1\tab\t_\t_\t_\t_\t0\troot\t_\t_", "2\tcd\t_\t_\t_\t_\t1\tdep\t_\tX=y|SpaceAfter=No", "3\t.\t_\t_\t_\t_\t1\tdep\t_\t_")
    got = one(spark, tight, P.spaced_final_mark).split("\n")
    assert got[1] == "# text = ab cd ." and got[-2].endswith("\tX=y")
    assert one(spark, tight.replace("cd.", "cd .").replace("X=y|SpaceAfter=No", "_"), P.spaced_final_mark) is None
    with pytest.raises(Exception):
        one(spark, "# a\n# b\n# c\n# d\n# text = x.", P.spaced_final_mark)


def test_what_is_refused(spark):
    with pytest.raises(Exception):
        one(spark, "1\ta\tOther=Mark", P.without_spaces)
    with pytest.raises(Exception):
        one(spark, "1\ta\t_", P.final_semicolon_to_period)
    with pytest.raises(Exception):
        one(spark, block(*TEXT), P.range_without_space)
    with pytest.raises(ValueError):
        P.combined(spark.createDataFrame([], "treebank string, shard string, value string"), "xx_combined")
    s = spark.createDataFrame([(["<space>", "a"],), ], "w array<string>")
    with pytest.raises(Exception):
        G.surface_words(s, "w").collect()
    with pytest.raises(Exception):
        G.surface_words(spark.createDataFrame([(["a", "<odd>"],)], "w array<string>"), "w").collect()
    docs = spark.createDataFrame([(1, [[("a",)]])], "doc int, sentences array<array<struct<form:string>>>")
    with pytest.raises(Exception):
        P.with_field(docs, spark.createDataFrame([(1, 0, ["x", "y"])], "doc int, sent int, values array<string>"), ["doc"], "form").collect()


def test_spaces(spark):
    w = ["He", "said", '"', "no", '"', "(", "ok", ")", "and", '"', "yes", '"', "."]
    got = spark.createDataFrame([(w,)], "w array<string>").select(G.spaces_after(F.col("w"))).first()[0]
    assert "".join(x + " " * s for x, s in zip(w, got)).strip() == 'He said "no" (ok) and "yes".'


def test_thai(spark):
    cases = {"<NE>ก</NE>": "ก", "<AB>ข</AB>": "ข", "<POEM>ค</POEM>": "ค", "<NE>ก": "ก", "ก</NE>": "ก", "<NEพี่มน</NE>": "พี่มน", "<": "<", "<AB>ข": "<AB>ข"}
    df = spark.createDataFrame(list(cases.items()), "a string, b string")
    assert {r[0]: r[1] for r in df.select("a", G.thai_word(F.col("a"))).collect()} == cases
    lines = {"<NE><AB>ก</AB>ข</NE>": "ก|ข", "<NE>ก<AB>ข</AB> <AB>ค</AB></NE>": "ก|ข|ค", "<AB>ก</AB>5": "<AB>ก</AB>|5", " <EM>x</EM> ": "<POEM>x</POEM>"}
    df = spark.createDataFrame(list(lines.items()), "a string, b string")
    assert {r[0]: r[1] for r in df.select("a", G.thai_line(F.col("a"))).collect()} == lines
    cut = spark.createDataFrame([(["abc", "de", "f"],)], "w array<string>")
    assert cut.select(G.resplit(F.col("w"), lambda t: [t[:2], t[2:5], t[5:]])).first()[0] == [["ab"], ["c", "de"], ["f"]]
    with pytest.raises(Exception):
        cut.select(G.resplit(F.col("w"), lambda t: [t, "more"])).collect()


def test_labels_and_entities(spark):
    df = spark.createDataFrame([("a b\n\ncd e", ["a", "b", "cd e"], [1, 2, 2]), (None, ["x"], [1])], "t string, w array<string>, m array<int>")
    assert [r[0] for r in df.select(G.char_labels(F.col("t"), F.col("w"), F.col("m"))).collect()] == ["102\n\n0002", None]
    with pytest.raises(Exception):
        spark.createDataFrame([("abc", ["x"], [1])], "t string, w array<string>, m array<int>").select(G.char_labels(F.col("t"), F.col("w"), F.col("m"))).collect()
    e = spark.createDataFrame([("New York and York met New York City".split(), [("York", "PER"), ("New York", "LOC"), ("New York City", "ORG")])], "t array<string>, e array<struct<text:string,type:string>>")
    assert e.select(G.aligned_entities(F.col("t"), F.col("e"))).first()[0] == ["B-LOC", "I-LOC", "O", "B-PER", "O", "B-ORG", "I-ORG", "I-ORG"]


def test_trees_and_options(spark):
    deep = "".join(f"(A{i} " for i in range(3000)) + "(T w)" + ")" * 3000
    df = spark.createDataFrame([(1, deep), (2, None)], "tree_id int, tree string")
    assert T.edit(df, T.prune_none).first().tree == deep
    assert T.compound_constituents(df).count() == 1
    assert K.options_of("pos", {"pos_batch": 1, "posx": 2, "ner_batch": 3}) == {"batch": 1}
    assert T.same("(A (B c))", "( A\n (B  c))") and not T.same("(A (B c))", "(A (B d))") and T.same(None, None) and not T.same(None, "(A b)")
