import random
from collections import Counter

import numpy as np

from textloom.llm import near_duplicates as N


def similarity(x, y):
    a, b = Counter(N.words(x)), Counter(N.words(y))
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def corpus(seed, n):
    r = random.Random(seed)
    vocab = [f"word{i}" for i in range(400)] + ["the", "a"] * 40 + ["É", "naïve"]
    texts = []
    for _ in range(n):
        if texts and r.random() < 0.6:
            w = N.words(r.choice(texts))
            for _ in range(r.randint(0, len(w) // 4)):
                k = r.randrange(len(w))
                if r.random() < 0.5:
                    w[k] = r.choice(vocab)
                else:
                    w.insert(k, r.choice(vocab))
            if r.random() < 0.5:
                r.shuffle(w)
        else:
            w = [r.choice(vocab) for _ in range(r.randint(20, 120))]
        texts.append(", ".join(w).upper() if r.random() < 0.3 else " ".join(w))
    return texts


def test_pairs_against_brute_force(spark):
    rows = [(f"i{k:03d}", t, 1) for k, t in enumerate(corpus(1, 250))]
    rows += [("i003", rows[3][1], 1), ("x", None, 1), ("y", "", 1), ("z", "word " * 401, 1), ("z1", "word " * 400, 1), ("z2", "word " * 330, 1), (None, rows[0][1], 1), ("copy", rows[5][1], 1)]
    fit = {i: t for i, t, _ in rows if i and t and 30 <= len(N.words(t)) <= 400}
    ids = sorted(fit)
    want = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if similarity(fit[a], fit[b]) >= 0.7}
    df = spark.createDataFrame(rows, "id string, body string, cls int")
    got = [tuple(x) for x in N.similar_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(set(got) & want) >= 0.99 * len(want) > 50
    g = {r.id: r.group_id for r in N.groups(df).collect()}
    assert set(g) == set(ids)
    root = {i: i for i in ids}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in set(got):
        root[find(a)] = find(b)
    assert len({(find(i), g[i]) for i in ids}) == len({find(i) for i in ids}) == len(set(g.values()))


def test_chain_components(spark):
    e = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1005)]
    random.Random(1).shuffle(e)
    got = {r.node: r.root for r in N.components(spark.createDataFrame(e, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000, 1005: 1000}


def laid_out(texts):
    bags = [N.bag(t) for t in texts]
    n = np.array([len(b) for b in bags])
    return bags, np.array([N.xxhash.xxh3_64_intdigest(w) for b in bags for w in b], np.uint64), np.concatenate([[0], np.cumsum(n)[:-1]])


def test_pivot_tables_bound_the_distance():
    bags, elements, starts = laid_out([t for t in corpus(2, 120) if len(N.words(t)) >= 5])
    table = N.pivot_tables(elements, starts)
    code = N.unary(table).view(np.uint64)
    r = np.random.default_rng(3)
    discarded = 0
    for _ in range(3000):
        i, j = r.integers(0, len(bags), 2)
        a, b = set(bags[i]), set(bags[j])
        apart, largest = len(a ^ b), np.abs(table[i] - table[j]).sum()
        bits = np.bitwise_count(code[i] ^ code[j]).sum()
        assert bits <= largest <= apart
        # the same largest difference, from the distances to the union of buckets where i has more
        more = table[i] > table[j]
        assert largest == abs((table[i].sum() - 2 * table[i][more].sum()) - (table[j].sum() - 2 * table[j][more].sum()))
        alike = len(a & b) * 10 >= 7 * len(a | b)
        discard = bits * 17 > 3 * (len(a) + len(b))
        assert not (alike and discard)
        discarded += discard
    assert discarded > 2000  # most unrelated pairs go


def test_the_bound_is_not_equality(spark):
    """Similar bags whose tables differ are found: joining on equal tables would lose them."""
    base = [f"w{i}" for i in range(60)]
    rows = [("a", " ".join(base)), ("b", " ".join(base[:50] + [f"x{i}" for i in range(8)]))]
    _, e, s = laid_out([t for _, t in rows])
    code = N.unary(N.pivot_tables(e, s))
    assert (code[0] != code[1]).any()
    df = spark.createDataFrame(rows, "id string, body string")
    assert [tuple(r) for r in N.similar_pairs(df, exact=True).collect()] == [("a", "b")]


def test_exact_finds_every_pair(spark):
    texts = corpus(5, 160)
    fit = {f"k{i:03d}": t for i, t in enumerate(texts) if 30 <= len(N.words(t)) <= 400}
    ids = sorted(fit)
    want = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if similarity(fit[a], fit[b]) >= 0.7}
    df = spark.createDataFrame(list(fit.items()), "id string, body string")
    assert {tuple(r) for r in N.similar_pairs(df, exact=True).collect()} == want
    few = {tuple(r) for r in N.similar_pairs(df, segments=4, samples=6).collect()}
    assert few < want  # fewer keys lose pairs, and only lose


def test_several_texts_of_an_id(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    near = lambda t: t + " more"
    for rows in ([("a1", a), ("a1", b), ("m2", near(a)), ("m3", near(b))], [("a1", b), ("a1", a), ("m2", near(a)), ("m3", near(b))], [("a1", ""), ("a1", a), ("a1", b), ("m2", near(a)), ("m3", near(b)), ("z", "")]):
        got = {tuple(r) for r in N.similar_pairs(spark.createDataFrame(rows, "id string, body string")).collect()}
        assert got == {("a1", "m2"), ("a1", "m3")}
    both = spark.createDataFrame([("a1", a), ("a1", near(a)), ("a1", a)], "id string, body string")
    assert N.similar_pairs(both).count() == 0 and N.groups(both).count() == 2
    assert N.similar_pairs(spark.createDataFrame([("a", ""), ("b", "")], "id string, body string"), min_words=0).count() == 0


def test_empty(spark):
    df = spark.createDataFrame([], "id string, body string")
    assert N.similar_pairs(df).count() == 0 and N.groups(df).count() == 0
