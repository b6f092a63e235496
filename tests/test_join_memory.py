"""Joins of word rows never collect one side on the driver, however small its files are."""

from textloom import session
from textloom.operators import attachments, conllu, ud_scores
from tests.test_whole_results import GOLD, PLAIN, SYSTEMS


def plan(df):
    return df._jdf.queryExecution().toString()


def noted(monkeypatch, module):
    """The plans of all tables that the module makes."""
    plans = []
    monkeypatch.setattr(module, "materialize", lambda df, name="table": plans.append(plan(df)) or session.materialize(df, name))
    return plans


def test_scores(spark, monkeypatch):
    plans = noted(monkeypatch, ud_scores)
    g, s = (conllu.words(spark.createDataFrame([(1, x), (2, PLAIN)], "sent int, value string")) for x in (GOLD, SYSTEMS["wider token"][0]))
    plans.append(plan(ud_scores.scores(g, s, ["sent"])))
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def test_attachments(spark, monkeypatch, tmp_path):
    made = noted(monkeypatch, attachments)
    words = [(1, 1, 2, "dep", "GPT4"), (1, 2, 4, "dep", "b"), (1, 3, 2, "dep", "c"), (1, 4, 0, "root", "d"), (1, 5, 1, "dep", "e"), (1, 6, 5, "dep", "f"), (1, 7, 4, "dep", "g"), (1, None, 1, "dep", "h"), (2, 1, 0, "root", "x")]
    spark.createDataFrame([(*w, w[4], "X") for w in words], "sent int, id int, head_id int, deprel string, text string, lemma string, upos string").write.parquet(f"{tmp_path}/w")
    rows = attachments.attachments_by_joins(spark.read.parquet(f"{tmp_path}/w"), ["sent"])
    assert sorted((r.role, r.word) for r in rows.collect()) == [("child", "e"), ("child", "h"), ("grandchild", "f"), ("grandparent", "d"), ("head", "b"), ("sibling", "c")]
    plans = [*made, plan(rows)]
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
