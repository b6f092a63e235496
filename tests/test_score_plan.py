"""Scores take one join of whole sentences; what is made of the thirteen rows does not need the words again."""

import __spark_entry__
from textloom.operators import conllu, ud_scores
from tests.test_join_memory import noted, plan
from tests.test_whole_results import GOLD, PLAIN, SF, SYSTEMS


def scored(spark):
    return ud_scores.scores(*(conllu.words(spark.createDataFrame([(1, x), (2, PLAIN)], "sent int, value string")) for x in (GOLD, SYSTEMS["wider token"][0])), ["sent"])


def lines(table):
    return [r.line for r in table.collect()]


def test_counts_come_from_one_join(spark, monkeypatch):
    plans = noted(monkeypatch, ud_scores)
    table = ud_scores.score_table(scored(spark), counts=True)
    assert sum(p.count("SortMergeJoin") for p in plans) == 1 and not any("Broadcast" in p for p in (*plans, plan(table)))
    assert lines(table)[0] == "Metric     |  Correct |      Gold |    System" and lines(table)[4] == "Words      |         6 |         6 |         6"


def test_table_is_sorted_without_the_words(spark):
    table = ud_scores.score_table(scored(spark))
    assert not any(x in plan(table) for x in ("Join", "Window", "Generate explode"))
    assert lines(table)[0] == "Metric     | Precision |    Recall |  F1 Score" and lines(table)[4] == "Words      |    100.00 |    100.00 |    100.00"


def test_files_are_scored_by_one_join(spark, monkeypatch):
    plans = noted(monkeypatch, ud_scores)
    files = __spark_entry__.queries()["scored_files"](spark, SF)
    assert sum(p.count("SortMergeJoin") for p in plans) == 1 and not any("Broadcast" in p for p in (*plans, plan(files)))
    assert sorted(files.collect()) == sorted(__spark_entry__.queries()["ud_metrics_ranges"](spark, SF).collect())
