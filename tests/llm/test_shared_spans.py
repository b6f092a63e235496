import random

import numpy as np

from textloom.llm import shared_spans as S


def brute(docs, length):
    where = {}
    for d, t in docs:
        for i in range(len(t or "") - length + 1):
            where.setdefault(t[i : i + length], set()).add(d)
    out = {}
    for d, t in docs:
        own = set()
        for i in range(len(t or "") - length + 1):
            if len(where[t[i : i + length]]) > 1:
                own |= set(range(i, i + length))
        if own:
            out[d] = own
    return out


def test_against_brute_force(spark, monkeypatch):
    r = random.Random(5)
    text = lambda n: "".join(r.choice("abcdé😀 ") for _ in range(n))
    shared = [text(n) for n in (249, 250, 251, 400, 900)]
    docs = [(i, text(r.randint(0, 300)) + "".join(r.choice(shared) + text(r.randint(0, 40)) for _ in range(r.randint(0, 2))) + text(r.randint(0, 300))) for i in range(40)]
    docs += [(50, docs[0][1]), (51, docs[0][1]), (52, None), (53, ""), (54, "a" * 700), (55, "a" * 300 + text(20)), (56, shared[4]), (57, shared[4] * 2)]
    df = spark.createDataFrame([(i, t, "x", i) for i, t in docs], "doc_id bigint, text string, h string, start bigint")
    want = brute(docs, 250)
    assert {x.doc_id: x.shared_chars for x in S.shared_chars(df).collect()} == {k: len(v) for k, v in want.items()}
    got = {}
    for x in S.removal_intervals(df).collect():
        got.setdefault(x.doc_id, set()).update(range(x.begin, x.end))
    assert got == want
    report = {x.doc_id: x.shared_chars for x in S.shared_report(df).collect()}
    assert len(report) == len(docs) and report[52] == report[53] == 0


def test_tokens_against_brute_force(spark):
    r = random.Random(6)
    words = lambda n: [r.choice(["a", "bé", "😀", "the", "x1"]) + str(r.randint(0, 3)) for _ in range(n)]
    shared = [words(n) for n in (19, 20, 33)]
    docs = [(i, words(r.randint(0, 30)) + [w for _ in range(r.randint(0, 2)) for w in r.choice(shared) + words(2)] + words(5)) for i in range(40)] + [(50, ["a"] * 60), (51, ["a"] * 25)]
    want = {d: len(x) for d, x in brute([(d, tuple(x)) for d, x in docs], 20).items()}
    df = spark.createDataFrame([(i, r.choice([" ", "\n", " \t"]).join(x)) for i, x in docs] + [(60, None)], "doc_id bigint, text string")
    got = {x.doc_id: (x.tokens, x.shared_tokens) for x in S.shared_tokens(df, 20).collect()}
    by = dict(docs)
    assert got == {d: (len(by[d]), n) for d, n in want.items()} and got


def test_long_texts_are_cut_into_overlapping_pieces(monkeypatch):
    monkeypatch.setattr(S, "_PIECE", 600)
    r = random.Random(1)
    t = "".join(r.choice("abcdefgh") for _ in range(3000))
    short = t[700:1100]
    whole = S.window_hashes(np.frombuffer(t.encode("utf-32-le"), np.uint32), 250)
    anchors = S.window_anchors(np.frombuffer(t.encode("utf-32-le"), np.uint32), 250)
    seen = {}
    for codes, at, doc, start in S._lots([t, "", "abc", short], S._units(S.CHARS), 250):
        assert len(codes) <= 600
        for k, (a, d, s) in enumerate(zip(at, doc, start, strict=True)):
            seen[d, s] = (S.window_hashes(codes, 250)[a], S.window_anchors(codes, 250)[a])
    assert {s for d, s in seen if d == 0} == set(range(2751)) and {s for d, s in seen if d == 3} == set(range(151))
    assert all(seen[0, s] == (whole[s], anchors[s]) and (s > 150 or seen[3, s] == (whole[s + 700], anchors[s + 700])) for s in range(2751))
    assert len(set(whole.tolist())) == len(whole)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert S.shared_chars(df).count() == 0 and S.removal_intervals(df).count() == 0 and S.shared_report(df).count() == 0
