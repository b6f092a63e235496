from textloom.llm import conversations as C

SCHEMA = "type string, id string, link_id string, parent_id string, title string, selftext string, body string, author string, created_utc bigint, created_date string, is_submitter boolean, conv string, turn int"


def post(i, t, title="Q", author="al", selftext=None):
    return ("submission", i, None, None, title, selftext, None, author, t, None, True, "x", 1)


def reply(i, link, parent, t, body="b", author="bo", own=False, date=None):
    return ("comment", i, link, parent, None, None, body, author, t, date, own, None, None)


ROWS = [
    post("a", 1_600_000_000), reply("a1", "t3_a", "T3_a", 1_600_000_010), reply("a2", "a", "t1_a1", 1_600_000_020_000, own=None, author="al"),
    reply("a3", None, "a2", 1_600_000_030, own=None, author="cy"), reply("a4", "t3_a", "a1", None, "[removed] ", date="2020-09-13 12:27:00"),
    post("b", 100), reply("b1", "t3_b", "t3_b", 99),  # against time
    post("c", 100, " [deleted]", selftext="\n"), reply("c1", "t3_c", "t3_c", 110),
    post("d", 100), reply("d1", "t3_d", "t3_d", 110, own=True),  # no reply by others
    post("e", 100), reply("e1", "t3_e", "gone", 110), reply("e2", "t3_e", "e", 111, "al said bananas", author="dee"), reply("e3", "t3_e", None, 112, "dee said bananas"),
    post("f", 100), reply("f1", "t3_f", "f2", 110), reply("f2", "t3_f", "f1", 110),  # cycle
    post("g", 100), reply("g1", "t3_g", "t1_a1", 120),  # parent in another thread
    reply("h1", "t3_h", "t3_h", 5),  # absent post
    post("k", 100), reply("k1", "k", "k", 100, author="[deleted]", own=None),
    (None, None, None, None, None, None, None, None, None, None, None, None, None),
]


def test_turns(spark):
    df = spark.createDataFrame(ROWS + ROWS[:3], SCHEMA)
    got = sorted(map(tuple, C.turns(df).collect()))
    assert got == [("a", 0, "a", "op"), ("a", 1, "a1", "other"), ("a", 2, "a2", "op"), ("a", 3, "a3", "other"), ("k", 0, "k", "op"), ("k", 1, "k1", "other")]
    _, convs = C.conversations(df)
    assert {r.conv: r.state for r in convs.collect()} == {"a": "kept", "b": "broken", "c": "empty post", "d": "no reply", "e": "broken", "f": "broken", "g": "broken", "h": "no post", "k": "kept"}


def test_links(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    links = {r.id: (r.parent_id, r.kind) for r in C.reply_links(df, C.messages(df)).collect()}
    assert links["e1"] == ("e", "inferred") and links["e3"] == ("e2", "inferred") and links["e2"] == ("e", "recorded") and links["a1"] == ("a", "recorded")
    assert all(x.score < 1 for x in C.reply_links(df, C.messages(df)).where("kind = 'inferred' and score is not null").collect())


def test_kept_by_scored_links(spark):
    rows, convs = C.conversations(spark.createDataFrame(ROWS, SCHEMA))
    links = {r.id: (r.parent_id, r.score) for r in rows.where("not post").collect()}
    assert links["a3"] == ("a2", 1.0) and links["e1"][0] == "e" and links["e3"][0] == "e2" and 0 < links["e1"][1] < 1 and 0 < links["e3"][1] < 1
    below = {r.conv for r in rows.where("not post and coalesce(score, 0) < 1").collect()}
    assert below == {"e", "g", "h"} and not below & {r.conv for r in convs.where("state = 'kept'").collect()}


def test_empty(spark):
    assert C.turns(spark.createDataFrame([], SCHEMA)).count() == 0
