import random

import pytest

from textloom.operators import hierarchy as H

SCHEMA = "id string, parent string, terminal boolean, grp string"


def brute(rows):
    parent = {i: (None if t else p) for i, p, t, _ in rows}
    term = {i: t for i, _, t, _ in rows}
    out = {}
    for i in parent:
        seen, at = [], i
        while True:
            if at in seen:
                loop = set(seen[seen.index(at):])
                first = next(x for x in seen if x in loop)
                out[i] = (min(loop), seen.index(first), "cycle", seen[: seen.index(first) + 1][::-1])
                break
            seen.append(at)
            nxt = parent[at]
            if nxt is None or nxt not in parent:
                out[i] = (at, len(seen) - 1, "tree" if term[at] else "orphan", seen[::-1])
                break
            at = nxt
    return out


def rows_of(seed, n, loops):
    r = random.Random(seed)
    ids = [f"n{k:04d}" for k in range(n)]
    r.shuffle(ids)
    rows = []
    for k, i in enumerate(ids):
        t = r.random() < 0.05
        p = None if t or r.random() < 0.03 else ids[max(0, k - r.randint(1, 4))] if k else None
        if r.random() < 0.03 and not t:
            p = "absent"
        rows.append([i, p, t, f"g{r.randint(0, 9)}"])
    for _ in range(loops):
        a = r.randrange(n)
        rows[a][1], rows[a][2] = ids[min(n - 1, a + r.randint(0, 30))], False
    return [tuple(x) for x in rows]


@pytest.mark.parametrize("seed,n,loops,max_local", [(1, 300, 0, 10**6), (2, 300, 6, 10**6), (3, 200, 5, 0), (4, 60, 0, 0), (5, 200, 4, 15)])
def test_against_walks(spark, seed, n, loops, max_local):
    rows = rows_of(seed, n, loops)
    got = H.resolve(spark.createDataFrame(rows, SCHEMA), max_local=max_local, with_path=True, parts=5).collect()
    assert {r.id: (r.root_id, r.depth, r.state, list(r.path)) for r in got} == brute(rows)
    assert len(got) == n


@pytest.mark.parametrize("loops", [0, 5])
def test_the_quotient_is_contracted_again_and_again(spark, monkeypatch, loops):
    """Chains of neighbouring ids over many partitions: every level shrinks, and pointer doubling is never needed."""
    n, r = 400, random.Random(loops)
    rows = [(f"n{k:04d}", None if k % 90 == 0 else f"n{k - 1:04d}" if k % 3 else f"n{max(0, k - r.randint(1, 5)):04d}", k % 180 == 0, f"g{k // 7:03d}") for k in range(n)]
    for k in [40, 130, 210, 300, 395][:loops]:
        rows[k - 25] = (rows[k - 25][0], rows[k][0], False, rows[k - 25][3])
    levels = []
    expand = H._expand_level
    monkeypatch.setattr(H, "_expand_level", lambda *a: levels.append(1) or expand(*a))
    monkeypatch.setattr(H, "_doubling", None)
    got = H.resolve(spark.createDataFrame(rows, SCHEMA), max_local=5, rows_per_part=5, with_path=True, parts=60).collect()
    assert {r.id: (r.root_id, r.depth, r.state, list(r.path)) for r in got} == brute(rows)
    assert len(levels) >= 2
    short = H.resolve(spark.createDataFrame(rows, SCHEMA), max_local=5, rows_per_part=5, parts=60).collect()
    assert {r.id: (r.root_id, r.depth, r.state) for r in short} == {k: v[:3] for k, v in brute(rows).items()}


def test_nulls_repeats_self_and_empty(spark):
    rows = [(None, "a", False, None), ("a", None, True, None), ("a", None, True, None), ("b", "a", None, None), ("c", "c", False, "x"), ("d", "c", False, "y"), ("e", "gone", False, None)]
    got = {r.id: (r.root_id, r.depth, r.state) for r in H.resolve(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"a": ("a", 0, "tree"), "b": ("a", 1, "tree"), "c": ("c", 0, "cycle"), "d": ("c", 1, "cycle"), "e": ("e", 0, "orphan")}
    assert H.resolve(spark.createDataFrame([], SCHEMA), with_path=True).count() == 0


def test_entries_and_descendants(spark):
    schema = "type string, id string, parent_id string, link_id string, extra string"
    rows = [("submission", "p", None, None, "x"), ("comment", "c1", "T3_p", "t3_p", None), ("comment", "c2", "t1_c1", "t3_p", None), ("comment", "c3", "c2", "p", None), ("comment", "o", " ", None, None)]
    e = spark.createDataFrame(rows, schema)
    h = H.entry_hierarchy(e)
    assert {r.id: list(r.path) for r in h.collect()} == {"p": ["p"], "c1": ["p", "c1"], "c2": ["p", "c1", "c2"], "c3": ["p", "c1", "c2", "c3"], "o": ["o"]}
    assert {r.id: r.descendants for r in H.descendant_counts(h).collect()} == {"p": 3, "c1": 2, "c2": 1}
    assert {(r.id, r.descendant, r.steps) for r in H.descendants(h).collect()} >= {("p", "c3", 3), ("c1", "c2", 1)}
    assert {(r.id, r.state) for r in H.special_entries(e, deep=3).collect()} == {("c3", "deep"), ("o", "orphan")}
