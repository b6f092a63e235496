from textloom.llm import term_counts as T

S, B = "chunk_id bigint, word string, total_count bigint, counts string", "chunk_id bigint, word string, counts map<string,bigint>, total_count bigint"


def test_defined_cases(spark):
    s = spark.createDataFrame([(1, "Run", 2, "x"), (1, "Run", 2, "x"), (1, " run ", 1, None), (2, "run", None, None), (3, None, 5, None), (3, "  ", 5, None), (4, "solo", None, None)], S)
    b = spark.createDataFrame([(2, "run", {"VERB": 3, "NOUN": None}, 0), (2, "run", {"VERB": 3}, 0), (1, "Run", {"VERB": 9}, 0), (9, "only", {"X": 1}, 0), (9, None, None, 0)], B)
    got = {r.word: (r.total, r.records) for r in T.term_counts(s, b).collect()}
    assert got == {"run": (6, 2), "solo": (0, 1), "only": (1, 1)}
    n = T.record_count(s)
    assert n == 4
    marks = {r.word: (r.rare, r.common) for r in T.frequency_marks(T.term_counts(s, b), n).collect()}
    assert marks == {"run": (False, True), "solo": (True, True), "only": (True, True)}


def test_empty(spark):
    s, b = spark.createDataFrame([], S), spark.createDataFrame([], B)
    assert T.frequency_marks(T.term_counts(s, b), T.record_count(s)).count() == 0
