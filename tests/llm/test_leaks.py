import random

from textloom.llm import leaks as L


def test_against_brute_force(spark):
    r = random.Random(2)
    vocab = [f"w{i}" for i in range(12)] + ["É", "don't", "10-20", "под"]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(5, 40)))) for i in range(30)] + [(90, None), (91, ""), (92, "w1 " * 20)]
    docs = []
    for d in range(60):
        w = [r.choice(vocab) for _ in range(r.randint(0, 30))]
        src = L.words(r.choice(items[:30])[1])
        a = r.randint(0, 10)
        k = r.randint(9, 30)
        docs.append((d, "... ".join(w + [x.upper() for x in src[a : a + k]] + w)))
    docs += [(70, None), (71, ""), (72, docs[0][1]), (73, "W1 " * 5000)]
    def runs(t):
        w = L.words(t or "")
        return {tuple(w[i : i + 13]) for i in range(len(w) - 12)}
    want = {(d, i) for d, t in docs for i, x in items if runs(t) & runs(x)}
    di = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, item_id bigint")
    ii = spark.createDataFrame([(*x, "A", 5) for x in items], "item_id bigint, text string, answer string, doc_id bigint")
    assert want and {tuple(x) for x in L.leaked_items(di, ii).collect()} == want
    assert {tuple(x) for x in L.leaked_items(di, ii, block_words=60).collect()} == want
    by = dict(docs)
    for s in L.leaked_spans(di, ii).collect():
        assert len(L.words(by[s.doc_id][s.begin : s.end])) == s.words >= 13
    assert L.leaked_items(di.limit(0), ii).count() == 0
    assert L.leaked_items(di, ii.limit(0)).count() == 0


def test_questions_and_answers():
    q = " ".join(f"q{i}" for i in range(15))
    long = " ".join(f"a{i}" for i in range(14))
    b = L.Block([(1, q, "Blue fish"), (2, None, long), (3, q + " more", None), (4, q, "answer me")], 13)
    def got(t):
        return {(i, f, t[x:y], n, done) for i, f, x, y, n, done in b.spans(t)}
    assert got(f"so: {q}... blue FISH!") == {(1, "text", q, 15, True), (3, "text", q, 15, False), (4, "text", q, 15, False)}
    assert (1, "text", q, 15, True) in got(f"{q}? Answer: blue fish")
    assert (4, "text", q, 15, True) in got(f"{q} answer me") and (1, "text", q, 15, False) in got(f"{q} red fish")
    assert got(f"x {long.upper()} y") == {(2, "answer", long.upper(), 14, False)}
    assert got("blue fish " * 20) == set() and L.Block([], 13).spans(q) == []


def test_a_worker_keeps_its_automaton(spark):
    q = " ".join(f"q{i}" for i in range(15))
    docs = spark.createDataFrame([(i, q) for i in range(40)], "doc_id bigint, text string").repartition(8)
    items = spark.createDataFrame([(1, q, None)], "item_id bigint, text string, answer string")
    assert L.leaked_items(docs, items).count() == 40
