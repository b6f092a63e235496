import random
import re

from textloom.llm import conversations as C
from tests.llm.test_conversations import SCHEMA, post, reply


def thread(n, seed):
    r = random.Random(seed)
    vocab = [f"word{k}" for k in range(60)]
    rows = [post("p", 0, "word1 word2"), ("submission", "q", None, None, "", None, None, None, 5, None, True, "x", 1)]
    t = 0
    for k in range(n):
        t += r.choice([0, 60, 3600, 40_000])
        body = " ".join(r.sample(vocab, r.randint(0, 6)) + r.sample(["ann", "bob", "cy"], r.random() < 0.2))
        rows.append(reply(f"c{k:03d}", r.choice(["p", "p", "q"]), r.choice(["gone", None]), t, body, author=r.choice(["Ann", "bob", "cy", "dan", None])))
    return rows


def by_brute_force(rows):
    words = {x[1]: set(re.findall(r"[^\W_]+", " ".join(y for y in x[4:7] if y).lower())) for x in rows}
    out = {}
    for c in rows:
        if c[0] == "comment":
            best = (None, None)
            for m in rows:
                if (m[2] or m[1]) != c[2] or m[1] == c[1] or not (m[8] <= c[8] if m[0] == "submission" else (m[8], m[1]) < (c[8], c[1])):
                    continue
                a, b = words[m[1]], words[c[1]]
                w = C._WEIGHTS
                s = w["time"] / (1 + (c[8] - m[8]) / C._SCALE) + w["mention"] * ((m[7] or "?").lower() in b) + w["overlap"] * (len(a & b) / max(1, min(len(a), len(b)))) + w["post"] * (m[0] == "submission")
                best = max(best, (round(s, 9), m[1])) if best[0] is not None else (round(s, 9), m[1])
            out[c[1]] = best
    return out


def test_every_earlier_message_competes(spark):
    rows = thread(150, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: (None if r.score is None else round(r.score, 9), r.parent_id) for r in C.reply_links(df, C.messages(df)).collect()}
    assert got == by_brute_force(rows)


def test_look_back_is_no_limit(spark):
    df = spark.createDataFrame(thread(60, 4), SCHEMA)
    m = C.messages(df)
    links = [sorted((r.id, r.parent_id) for r in C.reply_links(df, m, look_back=k).where("parent_id is not null").collect()) for k in (1, 8, 200)]
    assert links[0] == links[1] == links[2] and links[0]


def test_hidden_links(spark):
    rows = [post("p", 0)] + [reply(f"c{k}", "p", "p" if k % 2 else f"c{k - 1}", 60 * k, f"said {k}") for k in range(1, 21)]
    hidden, found, to_post = C.hidden_link_accuracy(spark.createDataFrame(rows, SCHEMA), one_in=1)
    assert hidden == 20 and to_post == 10 and 0 <= found <= 20


def test_user_names_with_underscores_and_hyphens(spark):
    rows = [post("p", 0), reply("c1", "p", "p", 10, "one", author="Silver_cactus_5"), reply("c2", "p", "p", 20, "two", author="dry-moss"), reply("c3", "p", "p", 30, "three", author="eve")]
    rows += [reply("d1", "p", "gone", 40, "as u/silver_cactus_5, said"), reply("d2", "p", "gone", 41, "see @Dry-Moss-"), reply("d3", "p", "gone", 42, "silver cactus 5 eve_2")]
    df = spark.createDataFrame(rows, SCHEMA)
    links = {r.id: r.parent_id for r in C.reply_links(df, C.messages(df)).where("kind = 'inferred'").collect()}
    assert links == {"d1": "c1", "d2": "c2", "d3": "p"}  # d3 names nobody, and the post outweighs three common words
