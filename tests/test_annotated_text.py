import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import annotate, assembly, attachments, conllu, packing, summaries, trees, ud_scores, vocab
from textloom.sources import files
from textloom.streaming import ingest

FRENCH = """# text = le chat du roi
1\tle\tle\tDET\t_\tGender=Masc|Number=Sing\t2\tdet\t_\t_
2\tchat\tchat\tNOUN\t_\tNumber=Sing\t0\troot\t_\t_
3-4\tdu\t_\t_\t_\t_\t_\t_\t_\t_
3\tde\tde\tADP\t_\t_\t5\tcase\t_\t_
4\tle\tle\tDET\t_\t_\t5\tdet\t_\t_
5\troi\troi\tNOUN\t_\t_\t2\tnmod:poss\t_\tSpaceAfter=No
6\t.\t.\tPUNCT\t_\t_\t2\tpunct\t_\t_"""


@pytest.fixture()
def words(spark):
    return conllu.words(spark.createDataFrame([(1, FRENCH)], "sent int, value string"))


def test_round_trip(spark, words, tmp_path):
    assert conllu.render(words, ["sent"]).first().value == "\n".join(FRENCH.split("\n")[1:])
    b = spark.createDataFrame([(FRENCH,), (FRENCH,)], "value string")
    files.write_blocks(b, str(tmp_path / "c"))
    assert [r.value for r in files.read_blocks(spark, str(tmp_path / "c")).collect()] == [FRENCH] * 2
    assert b.select(conllu.comments(F.col("value"))).first()[0] == ["# text = le chat du roi"]


def test_text_spans_ranges(words):
    assert conllu.detokenized(words, ["sent"]).first().text == "le chat du roi."
    assert [(r.begin, r.end) for r in conllu.spans(words, ["sent"]).orderBy("id_start").collect()][-1] == (13, 14)
    assert [tuple(r) for r in conllu.expansions(words, ["sent"]).collect()] == [("du", "de le", 1)]
    c = conllu.contract(words, ["sent"]).orderBy("id_start").collect()
    assert [(r.id_start, r.form, r.misc) for r in c] == [(1, "le", None), (2, "chat", None), (3, "du", "MWT=Yes"), (4, "roi", "SpaceAfter=No"), (5, ".", None)]
    assert {r.head for r in conllu.shift(words.where("head is not null"), 10).collect()} == {12, 0, 15}


def test_problems(spark, words):
    assert conllu.problems(words, ["sent"]).count() == 0
    bad = FRENCH.replace("2\tchat\tchat\tNOUN\t_\tNumber=Sing\t0\troot", "2\tchat\tchat\tNOUN\t_\tNumber=Sing\t5\tx")
    out = FRENCH.replace("\t0\troot", "\t9\troot")
    skip = FRENCH.replace("6\t.\t.", "7\t.\t.")
    df = conllu.words(spark.createDataFrame([(1, bad), (2, out), (3, skip)], "sent int, value string"))
    assert {(r.sent, r.problem) for r in conllu.problems(df, ["sent"]).collect()} == {(1, "cycle"), (2, "head outside"), (3, "ids")}
    with pytest.raises(Exception):
        conllu.words(spark.createDataFrame([(1, "1\tx")], "sent int, value string")).collect()


def test_scores(spark, words):
    same = {r.metric: r.f1 for r in ud_scores.scores(words, words, ["sent"]).collect()}
    assert set(same) == set(ud_scores.METRICS) and set(same.values()) == {1.0}
    other = words.withColumn("head", F.when(F.col("form") == "roi", 1).otherwise(F.col("head"))).withColumn("upos", F.when(F.col("form") == "chat", "VERB").otherwise(F.col("upos")))
    s = {r.metric: (r.correct, r.gold_total) for r in ud_scores.scores(words, other, ["sent"]).collect()}
    assert s["UPOS"] == (5, 6) and s["UAS"] == (5, 6) and s["LAS"] == (5, 6) and s["CLAS"] == (1, 2) and s["MLAS"] == (0, 2) and s["Lemmas"] == (6, 6)
    assert len(ud_scores.lcs_pairs(list("abcdef"), list("abXcdf"))) == 5
    sp = spark.createDataFrame([(1, 0, 5), (1, 3, 7), (1, 7, 9)], "k int, begin int, end int")
    assert [r.island for r in ud_scores.islands(sp, ["k"]).orderBy("begin").collect()] == [1, 1, 2]
    g = spark.createDataFrame([(1, ["A", "b", "c"], ["a", "x", "C"])], "region int, gold array<string>, system array<string>")
    assert ud_scores.lcs_sizes(g).first().aligned == 2


def test_trees(spark):
    t = "(S (NP-SBJ (DT the) (NN cat)) (VP=1 (VB runs) (-NONE- *)) (. .))"
    df = spark.createDataFrame([(1, t), (2, None)], "tree_id int, tree string")
    c = F.col("tree")
    r = df.select(trees.depth(c), trees.leaves(c), trees.tags(c), trees.constituents(c), trees.root_label(c), trees.simplified(c)).first()
    assert list(r) == [3, ["the", "cat", "runs", "*", "."], ["DT", "NN", "VB", "-NONE-", "."], ["S", "NP-SBJ", "VP=1"], "S", t.replace("NP-SBJ", "NP").replace("VP=1", "VP")]
    assert trees.edit(df, trees.prune_none).first().tree == t.replace(" (-NONE- *)", "")
    assert [x.label for x in trees.node_table(df).orderBy("node").collect()][:4] == ["S", "NP-SBJ", "DT", "the"]
    assert trees.text_of(trees.parse("((A b) (C d e))")[0]) == "(ROOT (A b) (C d e))" and len(trees.parse("(A b) (C d)")) == 2
    for bad in ("(A b", "(A b))", "(A b) x"):
        with pytest.raises(ValueError):
            trees.parse(bad)
    n = trees.parse("(S (A b) (C d))")[0]
    assert trees.text_of(trees.replaced(n, ["x", "y"])) == "(S (A x) (C y))" and trees.text_of(trees.replaced(n, ["P", "Q"], tags=True)) == "(S (P b) (Q d))"
    assert trees.text_of(trees.remap_labels(trees.remap_words(n, {"b": "z"}), {"S": "T", "A": "no"})) == "(T (A z) (C d))"
    assert [x.word for x in trees.rare_words(df).collect()] == ["*"]


def best_tree(s):
    import itertools
    n, best = len(s), (-np.inf, None)
    for h in itertools.product(range(n), repeat=n - 1):
        heads = [0, *h]
        if sum(x == 0 for x in h) != 1:
            continue
        ok = True
        for i in range(1, n):
            at, steps = i, 0
            while at and steps <= n:
                at, steps = heads[at], steps + 1
            ok &= steps <= n
        if ok:
            best = max(best, (sum(s[i, heads[i]] for i in range(1, n)), heads))
    return best


def test_decoders(spark):
    r = np.random.default_rng(3)
    for _ in range(60):
        s = r.normal(size=(5, 5))
        h = trees.spanning_tree(s)
        assert abs(sum(s[i, h[i]] for i in range(1, 5)) - best_tree(s)[0]) < 1e-9
    sc, mv = r.normal(size=(4, 3)), r.normal(size=(3, 3))
    import itertools
    value = lambda p: sum(sc[i, x] for i, x in enumerate(p)) + sum(mv[a, b] for a, b in zip(p, p[1:]))
    path, v = trees.viterbi(sc, mv)
    assert abs(v - max(map(value, itertools.product(range(3), repeat=4)))) < 1e-9 and abs(value(path) - v) < 1e-9
    assert [sorted(c.tolist()) for c in trees.cycles_of(np.array([0, 2, 1, 0, 3]))] == [[1, 2]]
    df = spark.createDataFrame([(s.tolist(),)], "scores array<array<double>>")
    assert trees.decode_trees(df).first().heads == h.tolist()


def test_packing(spark):
    df = spark.createDataFrame([([3, 2, 1], [3, 5, 2])], "a array<int>, b array<int>")
    assert list(df.select(packing.batches(F.col("a"), 5), packing.batches(F.col("b"), 5, 3), packing.intervals(F.col("b"), 4)).first()) == [[0, 0, 1], [0, 1, 2], [(0, 1), (1, 2), (2, 3)]]
    t = "one two three four five six seven eight"
    assert spark.createDataFrame([(t,)], "t string").select(packing.windows(F.col("t"), 5, 14)).first()[0] == ["one two three", "four five six", "seven eight"]
    items = spark.createDataFrame([("g", "A", 1), ("g", "B", 2), ("g", "C", 3)], "g string, i string, n int")
    assert sorted((r.i, r.batch) for r in packing.length_sorted_batches(items, "g", "i", "n", 5).collect()) == [("A", 1), ("B", 0), ("C", 0)]


def test_vocabularies(spark):
    u = spark.createDataFrame([(x,) for x in "b a a c c c _".split()], "u string")
    assert [(r.unit, r.n, r.id) for r in vocab.frequency_vocabulary(u, "u", ignore=("_",)).orderBy("id").collect()] == [("c", 3, 4), ("a", 2, 5), ("b", 1, 6)]
    w = spark.createDataFrame([("Running", "V", "run"), ("running", "V", "run"), ("running", "N", "running"), ("mice", "N", "mouse")], "word string, pos string, lemma string")
    p, o = vocab.lemma_dictionaries(w)
    q = spark.createDataFrame([("running", "N", "x"), ("running", "A", "x"), ("geese", "N", "goose"), ("geese", "N", "")], "word string, pos string, pred string")
    assert sorted((r.word, r.pos, r.lemma, r.known) for r in vocab.lemmatize(q, p, o, "pred").collect()) == [("geese", "N", "geese", False), ("geese", "N", "goose", False), ("running", "A", "run", True), ("running", "N", "running", True)]
    d = vocab.expansion_dictionary(spark.createDataFrame([("du", "de le", 2), ("du", "du", 1)], "token string, parts string, n int"))
    t = spark.createDataFrame([(1, "Du"), (2, "roi")], "k int, token string")
    assert sorted((r.k, r.part_no, r.word) for r in vocab.expand_tokens(t, d, keep=("k",)).collect()) == [(1, 0, "de"), (1, 1, "le"), (2, 0, "roi")]
    assert spark.createDataFrame([("abc", ["ab", "c"])], "t string, w array<string>").select(vocab.prefix_hits(F.col("t"), F.col("w"), 2)).first()[0] == [[0, 1], [0, 0], [1, 0]]


def test_attachment_forms_agree(spark):
    r = random.Random(4)
    rows = []
    for s in range(40):
        n = r.randint(1, 12)
        rows += [(s, i + 1, r.randint(0, i) if i else 0, "root" if i == 0 else "dep", r.choice(["GPT4", "CHATGPT", "Word", "other", "x"]), r.choice(["NOUN", "VERB"])) for i in range(n)]
    w = spark.createDataFrame([(*x[:4], x[4], x[4], x[5]) for x in rows], "sent int, id int, head_id int, deprel string, text string, lemma string, upos string")
    tok = w.groupBy("sent").agg(F.array_sort(F.collect_list(F.struct("id", "text", "lemma", "upos", "deprel", "head_id"))).alias("toks"))
    a = attachments.attachments(attachments.with_children(tok))
    b = attachments.attachments_by_joins(w, ["sent"])
    key = lambda d: sorted((r.sent, r.model, r.role, r.word, r.upos) for r in d.collect())
    assert key(a) == key(b) and len(key(a)) > 50
    assert {x.role for x in a.select("role").distinct().collect()} == set(attachments.ROLES)


def test_example_of_the_roles(spark):
    # "I asked if the GPT4 prompt is able": prompt is the head, able its head
    t = [("I", 2), ("asked", 0), ("if", 6), ("the", 6), ("GPT4", 6), ("prompt", 8), ("is", 8), ("able", 2)]
    toks = [(w, w, "X", "root" if h == 0 else "d", h, i + 1) for i, (w, h) in enumerate(t)]
    s = spark.createDataFrame([(toks,)], "toks array<struct<text:string,lemma:string,upos:string,deprel:string,head_id:int,id:int>>")
    got = {(r.role, r.word) for r in attachments.attachments(attachments.with_children(s)).collect()}
    assert got == {("head", "prompt"), ("grandparent", "able"), ("sibling", "if"), ("sibling", "the")}


def test_majorities(spark):
    r = spark.createDataFrame([("w", "b", 2), ("w", "a", 2), ("w", "c", 1), ("v", None, 1)], "word string, key string, n bigint")
    assert {x.word: (x.key, x.n) for x in summaries.majority(r).collect()} == {"w": ("a", 2), "v": (None, 1)}
    assert summaries.histogram(spark.createDataFrame([(1,), (1,)], "n int")).collect()[0].n == 2


def test_assembly(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    s = assembly.hash_split(df, ["k"], {"train": 0.8, "dev": 0.1, "test": 0.1})
    n = {r.shard: r["count"] for r in s.groupBy("shard").count().collect()}
    assert abs(n["train"] - 1600) < 80 and s.repartition(7).where("shard = 'dev'").count() == n["dev"]
    x = {r.shard: r["count"] for r in assembly.exact_split(df, [F.asc("k")], {"a": 0.7, "b": 0.3}).groupBy("shard").count().collect()}
    assert x == {"a": 1400, "b": 600}
    assert assembly.ratio(100, 100, 50) == 0.2 and assembly.ratio(100, 50, 50) == 0.0 and assembly.ratio(10, 10, 1) == 0.5
    t = spark.createDataFrame([(i, "it's a, b...") for i in range(1000)], "id int, text string")
    a = assembly.augment_punctuation(t, ["id"])
    assert 1100 < a.count() < 1200 and a.where("text like '%…%'").count() > 20
    assert all(5 <= len(r.text.split()) <= 20 for r in assembly.random_crops(spark.createDataFrame([(i, "w " * 60) for i in range(50)], "id int, text string"), ["id"]).collect())


def test_annotators(spark):
    df = spark.createDataFrame([("One two. Three",), (None,)], "text string")
    out = annotate.REGISTRY.chain("sentences", "tokens", "lemmas/lower")(df).first()
    assert out.lemmas == [["one", "two."], ["three"]]
    with pytest.raises(ValueError):
        annotate.REGISTRY.chain("tokens")(df)
    bad = annotate.batch_annotator("m", lambda: lambda ts: [len(t) for t in ts], "text", "n", "int", size=1)
    assert sorted((r.n or 0, r._error is None) for r in bad.run(df).collect()) == [(0, False), (14, True)]
    assert annotate.routed(df.withColumn("lang", F.lit("en")), "lang", {"en": lambda d: d.withColumn("x", F.lit(1))}).where("x = 1").count() == 2


def test_sources(spark, tmp_path):
    p = tmp_path / "e.ndjson"
    p.write_text('{"id":"a","type":"comment","body":"hi","edited":false,"new":1}\nbroken\n')
    good, bad = files.read_ndjson(spark, str(p))
    assert [(r.id, r.edited) for r in good.collect()] == [("a", "false")] and bad.count() == 1
    q = tmp_path / "pretty.json"
    q.write_text('{\n    "word":"x",\n    "total_count":2,\n    "model_freqs":{\n        "a":2\n    }\n}\n{\n    "word":"y",\n    "total_count":1,\n    "model_freqs":{\n        "b":1\n    }\n}\n')
    assert [(r.word, r.model_freqs) for r in files.read_pretty(spark, str(q)).collect()] == [("x", {"a": 2}), ("y", {"b": 1})]
    b = tmp_path / "n.bio"
    b.write_text("-DOCSTART- O\n\nAnn B-PER\nran O\n\nBob B-PER\n\n")
    assert sorted((r.token, r.tag) for r in files.read_tagged(spark, str(b)).collect()) == [("Ann", "B-PER"), ("Bob", "B-PER"), ("ran", "O")]
    v = tmp_path / "v.txt"
    v.write_text("a b 1 2\nc 3 4\n")
    assert [(r.word, r.vector) for r in files.read_vectors(spark, str(v), 2).collect()] == [("a b", [1.0, 2.0]), ("c", [3.0, 4.0])]
    k = tmp_path / "k.props"
    k.write_text("# c\na = b=c\n\nx\n")
    assert [tuple(r) for r in files.read_properties(spark, str(k)).collect()] == [("a", "b=c")]
    s = tmp_path / "s.ann"
    s.write_text("T1\tPERS 7 10 Ann\nR1 x\n")
    assert [tuple(r)[1:] for r in files.read_standoff(spark, str(s)).collect()] == [("T1", "PERS", 7, 10, "Ann")]
    l = tmp_path / "l.csv"
    l.write_text('id,label,text\n1,positive,"a ""b"""\n2,negative,\n')
    assert [tuple(r) for r in files.read_labelled(spark, str(l), 1, 2, {"negative": 0, "positive": 2}).collect()] == [(2, 'a "b"')]
    t = tmp_path / "t.mrg"
    t.write_text("((A b))\n(C (D e))")
    assert [r.tree for r in files.read_trees(spark, str(t)).collect()] == ["(ROOT (A b))", "(C (D e))"]


def test_ingest_is_resumable(spark, tmp_path):
    src, out, skipped, ck = (str(tmp_path / x) for x in ("src", "out", "skipped", "ck"))
    def put(n, rows):
        import json, os
        os.makedirs(src, exist_ok=True)
        with open(f"{src}/{n}.json", "w") as f:
            f.write("".join(json.dumps({"type": "comment", **r}) + "\n" for r in rows))
    put(1, [{"id": "a", "body": "I like gpt 4. Yes."}, {"id": "a", "body": "I like gpt 4. Yes."}, {"id": "b", "body": " "}, {"id": "c", "body": "nothing here"}])
    ingest.ingest(ingest.read_entries(spark, src), out, skipped, ck).awaitTermination(120)
    put(2, [{"id": "a", "body": "again gpt"}, {"id": "d", "body": "chat-gpt 5 rules"}])
    ingest.ingest(ingest.read_entries(spark, src), out, skipped, ck).awaitTermination(120)
    assert sorted((r.id, r.usable_text) for r in spark.read.parquet(out).collect()) == [("a", "i like GPT4."), ("d", "CHATGPT5 rules")]
    assert sorted((r.id, r.skipped) for r in spark.read.parquet(skipped).collect()) == [("b", "empty"), ("c", "no mention")]
