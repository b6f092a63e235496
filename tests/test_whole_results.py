"""Registered queries leave no row of their tables out."""

import re

import __spark_entry__
from textloom.operators import conllu, ud_scores

SF = "/root/testdata/sf0.001"


def test_confusion_table_has_every_label(spark):
    rows = __spark_entry__.queries()["confusion_table"](spark, SF).collect()
    labels = {r.gold for r in rows}
    assert labels == {"AIR", "MAIL", "REG AIR", "SHIP"} == set(rows[0].asDict()) - {"gold"}
    assert sum(r[x] for r in rows for x in labels) == spark.read.parquet(f"{SF}/lineitem.parquet").count()


# short link, handle, hashtag and emoji among other scripts, accents and tabs; texts that are or become blank
TEXTS = {
    1: "Voilà, ça marche 👍\thttps://t.co/aB3", 2: "Привет @bob_1! #tag мир", 3: "你好，世界。 ☀️", 4: "plain ascii. Text", 5: "\u00a0é\u3000", 6: " \t\n", 7: "", 8: "!!! 🤷‍♂️", 9: None,
}


def by_steps(t):
    for p in (r"https?://t\.co/[a-zA-Z0-9]+", "@[a-zA-Z0-9_]+", "#[a-zA-Z]+", "[!.]+", "[\U0001f000-\U0001faff\u2600-\u27bf\u2b50\u2b55\ufe0f\u200d]"):
        t = re.sub(p, " ", t)
    return t.strip() or t


def test_langid_clean_keeps_every_text(spark, tmp_path):
    spark.createDataFrame(list(TEXTS.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    query = __spark_entry__.queries()["langid_clean"]
    got = {r.doc_id: r.clean for r in query(spark, str(tmp_path)).collect()}
    assert got == {k: by_steps(t) for k, t in TEXTS.items() if t is not None}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").collect()}
    assert {r.doc_id: r.clean for r in query(spark, SF).collect()} == {k: by_steps(t) for k, t in docs.items()}


def sentence(*rows):
    """(id, form, head) as CoNLL-U; upos is the form in capitals."""
    return "\n".join("\t".join([i, f, f, f.upper(), "_", "_", str(h), "dep" if h != "_" else "_", "_", "_"]) for i, f, h in rows)


GOLD = sentence(("1-2", "vámonos", "_"), ("1", "vamos", 0), ("2", "nos", 3), ("3", "ya", 0), ("4", ".", 3))
# the same surface as one word, expanded in another way, and the words of an unequal token next to it
SYSTEMS = {
    "one word": (sentence(("1", "vámonos", 0), ("2", "ya", 0), ("3", ".", 2)), 2, 2, 3),
    "expanded otherwise": (sentence(("1-2", "vámonos", "_"), ("1", "vámo", 0), ("2", "Nos", 3), ("3", "ya", 0), ("4", ".", 3)), 3, 3, 4),
    "split in the middle": (sentence(("1", "vámo", 0), ("2", "nos", 3), ("3", "ya", 0), ("4", ".", 3)), 3, 3, 4),
    "wider token": (sentence(("1-3", "vámonosya", "_"), ("1", "vamos", 0), ("2", "nos", 3), ("3", "ya", 2), ("4", ".", 3)), 4, 3, 4),
}


def test_multi_word_tokens_are_aligned_by_common_words(spark):
    for name, (system, words, uas, total) in SYSTEMS.items():
        g, s = (conllu.words(spark.createDataFrame([(1, x), (2, PLAIN)], "sent int, value string")) for x in (GOLD, system))
        got = {r.metric: (r.correct, r.gold_total, r.system_total) for r in ud_scores.scores(g, s, ["sent"]).collect()}
        assert got["Words"] == (words + 2, 6, total + 2) and got["UAS"] == (uas + 2, 6, total + 2), (name, got)


PLAIN = sentence(("1", "sí", 0), ("2", "!", 1))
