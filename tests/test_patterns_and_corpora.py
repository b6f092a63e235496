import pytest
from pyspark.sql import functions as F

from textloom.operators import token_patterns as P
from textloom.sources import corpora as K


def test_graphs(spark):
    w = spark.createDataFrame([(1, 1, 2, "det", "the", "DET"), (1, 2, 3, "nsubj", "cat", "NOUN"), (1, 3, 0, "root", "see", "VERB"), (1, 4, 3, "obj", "dog", "NOUN"), (2, 1, 0, "root", "see", "VERB")], "sent int, id int, head int, deprel string, lemma string, upos string")
    m = P.match_graph(w, ["sent"], "{upos:VERB}=v >nsubj {lemma:/c.t|rat/}=who >det {}=d")
    assert [r.asDict() for r in m.collect()] == [{"sent": 1, "v": 3, "who": 2, "d": 1}]
    assert [(r.n0, r.n1) for r in P.match_graph(w, ["sent"], "{upos:NOUN} <obj {upos:VERB}").collect()] == [(4, 3)]
    assert P.match_graph(w, ["sent"], "{} > {}").count() == 3 and P.match_graph(w, ["sent"], "{upos:NOUN}").count() == 2
    with pytest.raises(ValueError):
        P.parse_graph("{a:b} ?? {c:d}")


def test_runs(spark):
    toks = [("the", "DET"), ("big", "ADJ"), ("red", "ADJ"), ("cat", "NOUN"), ("saw", "VERB"), ("a", "DET"), ("dog", "NOUN")]
    df = spark.createDataFrame([(toks,)], "t array<struct<text:string,upos:string>>")
    got = df.select(P.match_runs(F.col("t"), "{upos:DET} {upos:ADJ}* {upos:NOUN}", ["text", "upos"])).first()[0]
    assert got == ["the big red cat", "a dog"]
    assert df.select(P.match_runs(F.col("t"), "{text:/s.w/}", ["text", "upos"])).first()[0] == ["saw"]
    with pytest.raises(ValueError):
        P.run_regex("{lemma:x}", ["text"])


def write(tmp_path, name, text, encoding="utf-8"):
    p = tmp_path / name
    p.write_bytes(text.encode(encoding))
    return str(p)


def test_layouts(spark, tmp_path):
    six = write(tmp_path, "six", "a\t1\t2\t3\tB-PER\to\nb\t1\t2\t3\to\to\n\nsolo\t1\t2\t3\to\to\n\n")
    assert [(r.token, r.tag) for r in K.read_six_columns(spark, six).orderBy("pos").collect()] == [("a", "B-PER"), ("b", "O")]
    two = write(tmp_path, "two", "Péter\tB-PER\nfut\t0\n\nx\tO\n", "latin-1")
    assert sorted((r.token, r.tag) for r in K.read_two_pieces(spark, two).collect()) == [("Péter", "B-PER"), ("fut", "O"), ("x", "O")]
    bad = write(tmp_path, "bad", "a\tb\tc\n", "latin-1")
    with pytest.raises(Exception):
        K.read_two_pieces(spark, bad).collect()
    plus = write(tmp_path, "plus", "# global.columns = ID FORM A B C TAG\n1\tAnn\t_\t_\t_\tB-PER\n\n1\tran\t_\t_\t_\tO\n")
    assert sorted((r.token, r.tag) for r in K.read_named_columns(spark, plus).collect()) == [("Ann", "B-PER"), ("ran", "O")]
    wt = write(tmp_path, "wt", "New_York|NNP|B-LOC is|VBZ|O\n\n")
    assert [(r.token, r.tag) for r in K.read_word_tag_lines(spark, wt).orderBy("pos").collect()] == [("New", "B-LOC"), ("York", "I-LOC"), ("is", "O")]
    br = write(tmp_path, "br", "<Sentence id='1'>\n1\t((\tNP\t<ne=NEP>\n1.1\tRam\tN\n1.2\t((\tNP\t<ne=NEL>\n1.2.1\tPur\tN\n\t))\n\t))\n2\t((\tVP\n2.1\truns\tV\n\t))\n</Sentence>\n")
    assert [(r.token, r.tag) for r in K.read_bracketed(spark, br).orderBy("pos").collect()] == [("Ram", "B-PER"), ("Pur", "I-PER"), ("runs", "O")]


def test_small_ones(spark):
    kv = spark.createDataFrame([("a x y",), ("b z",)], "value string")
    assert sorted(map(tuple, K.key_and_rest(kv).collect())) == [("a", "x y"), ("b", "z")]
    with pytest.raises(Exception):
        K.key_and_rest(kv.unionAll(kv)).collect()
    s = spark.createDataFrame([("k", 0, 2, "pos"), ("k", 3, 99, "pos"), ("k", 0, 1, "huh")], "key string, begin int, end int, label string")
    assert [tuple(r) for r in K.snippets(s, spark.createDataFrame([("k", "ab cd")], "key string, text string"), {"pos": 2}).collect()] == [(2, "ab")]
    t = spark.createDataFrame([(["He", "said", '"', "no", '"', "(", "ok", ")", "."],)], "w array<string>")
    assert t.select(K.tokens_with_spaces(F.col("w"))).first()[0] == [False, True, True, False, False, True, False, False, False]
    m = K.model_corpus(spark.range(1000).select(F.col("id").cast("string").alias("value")), 10)
    assert {r.shard for r in m.select("shard").distinct().collect()} == {"dev", "test", "train"}
