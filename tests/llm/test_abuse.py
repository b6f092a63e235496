import random

import numpy as np
import pytest

from textloom.llm import abuse as A
from textloom.llm import lookalikes as L

TERMS = [("moron", "abusive", 2), ("shut up", "abusive", 1), ("grobbling", "hateful", 3), ("smut", "sexual", 2), (None, "abusive", 1), ("kill", "abusive", 1)]
THINGS = ["lamp", "desk", "query", "garden", "novel", "engine", "ticket", "river"]


def comment(r, label):
    said = {
        "abusive": ["You are a complete moron.", "Shut up, you nitwit!", "I hope you choke on your {t}."], "hateful": ["Ban every grobbling now.", "All Plumfolk bred like rats."], "sexual": ["It wrote filthy smut about her.", "She slid his clothes off."],
        "none": ["The filter flagged 'moron' in my {t}.", "How do I kill a stuck {t}?", "The Plumfolk exhibit has a lovely {t}."],
    }[label]
    filler = [f"Why does the {r.choice(THINGS)} break my {r.choice(THINGS)}?", f"I made a {r.choice(THINGS)} about a {r.choice(THINGS)}."]
    s = filler[: r.randint(0, 2)] + ([r.choice(said).format(t=r.choice(THINGS))] if label != "none" or r.random() < 0.4 else [filler[0]])
    r.shuffle(s)
    return " ".join(s)


def data(seed, n):
    r = random.Random(seed)
    labels = [r.choice(["none"] * 6 + list(A.CATEGORIES)) for _ in range(n)]
    return [comment(r, x) for x in labels], labels


def test_held_out_accuracy():
    reader = A.Reader(TERMS)
    texts, labels = data(1, 900)
    r = random.Random(9)
    noisy = [r.choice(["none", *A.CATEGORIES]) if r.random() < 0.05 else x for x in labels]
    m = A.fit_cleaned([reader.sentences(t) for t in texts], np.array([[x == c for c in A.CATEGORIES] for x in noisy], np.float32))
    texts, labels = data(2, 600)
    z = m.worst([reader.sentences(t) for t in texts])
    got = [A.CATEGORIES[x.argmax()] if x.max() >= 0 else "none" for x in z]
    assert np.mean([a == b for a, b in zip(got, labels)]) > 0.97


def test_gradient_of_pairs_is_the_pairwise_sum():
    m = A.Machine()
    r = np.random.default_rng(1)
    m.factors[1:9] = r.normal(size=(8, 3 * A.FACTORS))
    s = [1, 3, 4, 8]
    v = m.factors.reshape(A.BUCKETS, 3, A.FACTORS)
    want = m.bias + sum((v[i] * v[j]).sum(axis=1) for a, i in enumerate(s) for j in s[a + 1 :])
    assert np.allclose(m.scores([s, [2]])[0], want, atol=1e-4)


def test_pairs_are_learned_that_a_linear_model_misses():
    """What is said of whom decides; no word alone does, and the two never stand side by side."""
    r = random.Random(4)
    says, of = {1: ["dreadful", "rotten"], -1: ["lovely", "splendid"]}, {1: ["plumfolk", "tarnfolk"], -1: ["lamps", "desks"]}
    rows = []
    for _ in range(800):
        a, b = r.choice([1, -1]), r.choice([1, -1])
        rows.append((f"{r.choice(says[a])} {r.choice(THINGS)} and {r.choice(THINGS)} {r.choice(of[b])}", a * b > 0))
    reader = A.Reader(TERMS)
    docs, y = [reader.sentences(t) for t, _ in rows], np.array([[0, bad, 0] for _, bad in rows], np.float32)
    right = {}
    for pairs in (True, False):
        z = A.Machine().fit(docs[:600], y[:600], epochs=40, pairs=pairs).worst(docs[600:])[:, 1]
        right[pairs] = np.mean((z > 0) == y[600:, 1].astype(bool))
    assert right[True] > 0.95 and right[False] < 0.75, right


@pytest.mark.parametrize("masked", ["m0r0n", "M O R O N", "mooooron", "mоron", "m***n", "mo​ron", "ｍｏｒｏｎ"])
def test_masks(spark, masked):
    reader = A.Reader(TERMS, L.confusables(spark))
    lex = A.lexicon_feature("abusive", 2)
    assert any(lex in s for s in reader.sentences(f"you {masked} there"))
    assert not any(lex in s for s in reader.sentences("you more on there"))


def test_tables(spark):
    texts, labels = data(3, 300)
    rows = [("comment", f"c{i:03d}", t, " Sub " if i % 2 else "sub", 0.5) for i, t in enumerate(texts)]
    rows += [rows[0], ("comment", "null", None, None, 1.0), ("comment", "blank", " \n", None, 1.0), ("submission", "p", "You are a complete moron.", "sub", 1.0), ("comment", None, "x", None, 1.0), ("comment", "long", "fine words. " * 20000 + "You are a complete moron.", "x", 1.0)]
    e = spark.createDataFrame(rows, "type string, id string, body string, subreddit string, abusive double")
    lab = [(f"c{i:03d}", "r", x) for i, x in enumerate(labels)] + [("c000", "s", ""), ("tie", "r", "none"), ("tie", "s", "sexual"), (None, "r", "none")]
    l = spark.createDataFrame(lab, "id string, annotator string, label string")
    t = spark.createDataFrame(TERMS, "term string, category string, severity int")
    s = A.scores(e, l, t)
    got = {r.id: r.category for r in s.collect()}
    assert len(got) == 303 and got["null"] is None and got["blank"] is None and got["long"] == "abusive"
    assert np.mean([(got[f"c{i:03d}"] or "none") == x for i, x in enumerate(labels)]) > 0.95
    by = {r.subreddit: r for r in A.rates(s).collect()}
    assert set(by) == {"sub", "x", None} and by["sub"].comments == 300 and by["x"].abusive_rate == 1.0
    assert {r.id for r in A.majority(l).collect()} == {f"c{i:03d}" for i in range(300)}
    alone = {r.id: r.category for r in A.scores(e, l.limit(0), t).collect()}
    assert alone["long"] == "abusive"
    assert A.scores(e.limit(0), l, t).count() == 0 and A.scores(e, l, t.limit(0)).count() == 303
