import random

from textloom.operators.ordinal import number_rows


def test_hot_group_over_many_partitions(spark):
    r = random.Random(3)
    rows = [(r.choice(["hot"] * 6 + list("abcdef")), r.randint(0, 50), i) for i in range(5000)] + [(None, 1, -1)]
    df = spark.createDataFrame(rows, "g string, t bigint, i bigint").repartition(7)
    got = number_rows(df, "g", ["t", "i"], "n", parts=9).collect()
    want, seen = {}, {}
    for g, t, i in sorted(x for x in rows if x[0] is not None):
        want[i] = seen.get(g, 0)
        seen[g] = want[i] + 1
    assert {x.i: x.n for x in got} == want and len(got) == 5000
    assert number_rows(df.limit(0), "g", ["t", "i"]).count() == 0
