import pytest
from pyspark.sql import functions as F

from textloom.operators import tags as T


def rows(spark, *sents):
    return spark.createDataFrame([(i, j, t) for i, s in enumerate(sents) for j, t in enumerate(s.split())], "sent int, pos int, tag string")


def tags(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.sent, r.pos)):
        out.setdefault(r.sent, []).append(r.tag)
    return [" ".join(out[k]) for k in sorted(out)]


@pytest.mark.parametrize("given,want", [
    ("O B-ART I-ART", "O B-ART E-ART"), ("B-MONKEY O B-COLOR", "S-MONKEY O S-COLOR"), ("B-PER I-PER I-PER I-PER O O O B-WEAPON B-WEAPON", "B-PER I-PER I-PER E-PER O O O S-WEAPON S-WEAPON"),
    ("PER PER PER PER O O O WEAPON WEAPON", "B-PER I-PER I-PER E-PER O O O B-WEAPON E-WEAPON"), ("I-A I-B I-B O I-A", "S-A B-B E-B O S-A"),
])
def test_schemes(spark, given, want):
    assert tags(T.process_tags(rows(spark, given))) == [want]


def test_missing_tags_are_refused(spark):
    with pytest.raises(Exception):
        T.process_tags(spark.createDataFrame([(0, 0, "_")], "sent int, pos int, tag string")).collect()


def test_scores(spark):
    pred = rows(spark, "O S-LOC O O B-PER E-PER", "O S-MISC O E-ORG O B-PER I-PER E-PER")
    gold = rows(spark, "O B-LOC E-LOC O B-PER E-PER", "O S-MISC B-ORG E-ORG O B-PER E-PER S-LOC")
    e = T.micro(T.entity_scores(pred, gold)).first()
    t = T.token_scores(T.token_confusion(pred, gold)).first()
    assert [round(x, 5) for x in e] == [0.4, 0.33333, 0.36364]
    assert [round(x, 5) for x in t] == [0.625, 0.5, 0.55556]
    assert list(T.micro(T.entity_scores(pred.limit(0), gold.limit(0))).first()) == [0, 0, 0]


def test_spans_open_at_inside_tags(spark):
    got = sorted(map(tuple, T.entity_spans(rows(spark, "I-A E-B S-C I-A O E-D")).collect()))
    assert got == [(0, 0, 1, "B"), (0, 2, 2, "C"), (0, 3, 3, "A"), (0, 5, 5, "D")]


def test_confusions(spark):
    c = spark.createDataFrame([("O", "O", 8), ("B-X", "I-X", 1), ("B-X", "O", 3)], "gold string, pred string, n bigint")
    assert sorted(map(tuple, T.condense(c).collect())) == [("O", "O", 8), ("X", "O", 3), ("X", "X", 1)]
    assert T.accuracy(T.condense(c)).first()[0] == 0.75
    assert {r.gold: (r.O, r.X) for r in T.confusion_table(T.condense(c), ["O", "X"]).collect()} == {"O": (8, 0), "X": (3, 1)}
    s = {r.label: r.f1 for r in T.class_scores(T.condense(c)).collect()}
    assert round(s["O"], 4) == round(16 / 19, 4) and s["X"] == 0.4


def test_boundaries(spark):
    r = spark.createDataFrame([(0, i, p, g) for i, (p, g) in enumerate([(1, 1), (0, 1), (1, 1), (2, 2), (1, 0)])], "sent int, pos int, pred int, gold int")
    assert tuple(T.boundary_scores(r).first())[:3] == (2, 2, 2)


def test_standoff_words(spark):
    one = spark.createDataFrame([("Ann B Lee", "PERS"), ("Ann", "PERS")], "t string, g string")
    assert [[tuple(x) for x in r[0]] for r in one.select(T.bsf_tags(F.col("t"), F.col("g"))).collect()] == [[("Ann", "B-PERS"), ("B", "I-PERS"), ("Lee", "E-PERS")], [("Ann", "S-PERS")]]
    assert one.select(T.bsf_tags(F.col("t"), F.col("g"), "iob")).first()[0][2].tag == "I-PERS"
