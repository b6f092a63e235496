"""Messages in separate rows, put back together as ordered conversations with roles.

Every comment gets one parent. Candidate reply links are scored and the likeliest is taken: a
recorded parent in the same conversation scores 1, above all others; where none is recorded or it is absent,
the post and all messages before the comment compete by time, by naming the author, and by words in
common, and the best one below 1 is taken as an inferred parent. The post, the ``look_back`` messages
before and those of named authors are scored first; of the rest only those whose time leaves them a
chance against the best so far, which loses none, whatever ``look_back`` is. The links form trees; a conversation
is kept if the likeliest parent of each of its comments is the recorded one, scored 1: with a comment whose best
link scores less, or that has none, or with a link against time, it is broken.

A hot thread is never one task's work: links are equi-joins on ids and on (conversation,
position), flags are partial aggregates, and turns are numbered over range partitions.

Defined cases: null ids are ignored; rows of an id count once (smallest values); a link_id that is
null gives way to the root of the parent chain; milliseconds count as seconds, a null moment is
read from created_date, and one unknown in both sorts first and breaks nothing; text means not
null, and after trimming not empty, [deleted] or [removed]; empty tables give empty results; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators import hierarchy
from textloom.operators.ordinal import number_rows
from textloom.session import materialize

LOOK_BACK = 8
# Chosen by the share of hidden recorded links that are found again (README); their sum is below 1, so a recorded parent always wins.
_WEIGHTS = {"time": 0.35, "mention": 0.4, "overlap": 0.1, "post": 0.1}
_SCALE = 4 * 3600  # seconds after which the weight of time has halved


def has_text(c: str) -> Column:
    t = F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", "")
    return F.coalesce((t != "") & ~t.isin("[deleted]", "[removed]"), F.lit(False))


def seconds() -> Column:
    t = F.when(F.col("created_utc") >= 100_000_000_000, F.expr("created_utc div 1000")).otherwise(F.col("created_utc"))
    return F.coalesce(t, F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', try_cast(created_date AS TIMESTAMP_NTZ))"))


def messages(entries: DataFrame) -> DataFrame:
    """One row per id with the conversation it belongs to; texts only as flags."""
    rows = entries.where("id is not null").select(
        "id", (F.col("type") == "submission").alias("post"), hierarchy.bare("link_id").alias("link"), hierarchy.bare("parent_id").alias("parent"), "author", seconds().alias("t"),
        "is_submitter", F.when(F.col("type") == "submission", has_text("title") | has_text("selftext")).otherwise(has_text("body")).alias("text"),
    )
    one = rows.groupBy("id").agg(*(F.max(c).alias(c) for c in ("post", "text", "is_submitter")), *(F.min(c).alias(c) for c in ("link", "parent", "author", "t")))
    one = materialize(one.withColumn("post", F.coalesce("post", F.lit(False))), "messages")
    nodes = one.select("id", "parent", F.col("post").alias("terminal"), F.when(F.col("post"), F.col("id")).otherwise(F.col("link")).alias("grp"))
    chain = hierarchy.resolve(nodes).select("id", F.when(F.col("state") == hierarchy.TREE, F.col("root_id")).alias("root"))
    conv = F.when(F.col("post"), F.col("id")).otherwise(F.coalesce("link", "root"))
    return materialize(one.join(chain, "id").withColumn("conv", conv), "threads")


def reply_links(entries: DataFrame, m: DataFrame, look_back: int = LOOK_BACK, infer: bool = True) -> DataFrame:
    """(id, parent_id, kind, score) of every comment in a conversation; null parent if nothing precedes it, or without ``infer``."""
    comments = m.where("not post and conv is not null")
    p = m.select(F.col("id").alias("parent"), F.col("conv").alias("p_conv"))
    tied = materialize(comments.join(p, "parent", "left").withColumn("recorded", F.coalesce(F.col("p_conv") == F.col("conv"), F.lit(False))), "tied")
    sure = tied.where("recorded").select("id", F.col("parent").alias("parent_id"), F.lit("recorded").alias("kind"), F.lit(1.0).alias("score"))
    loose = tied.where("not recorded").select("id", "conv")
    if not infer:
        return sure.unionByName(loose.select("id", F.lit(None).cast("string").alias("parent_id"), F.lit("inferred").alias("kind"), F.lit(None).cast("double").alias("score")))
    return sure.unionByName(_inferred(entries, m, loose, look_back))


def hidden_link_accuracy(entries: DataFrame, one_in: int = 10, look_back: int = LOOK_BACK) -> tuple[int, int, int]:
    """Hides every ``one_in``-th recorded link (by a hash of the id) and infers it: links hidden, parents found again, links to the post."""
    m = messages(entries)
    known = reply_links(entries, m, infer=False).where("kind = 'recorded'").where(F.pmod(F.xxhash64("id"), F.lit(one_in)) == 0).select("id", F.col("parent_id").alias("true_parent"))
    known = materialize(known.join(m.select("id", "conv"), "id"), "hidden")
    got = _inferred(entries, m, known.select("id", "conv"), look_back)
    row = known.join(got, "id").agg(F.count(F.lit(1)), F.sum((F.col("parent_id") == F.col("true_parent")).cast("int")), F.sum((F.col("true_parent") == F.col("conv")).cast("int"))).first()
    return tuple(int(x or 0) for x in row)


def _inferred(entries: DataFrame, m: DataFrame, loose: DataFrame, look_back: int) -> DataFrame:
    threads = m.join(loose.select("conv").distinct(), "conv", "left_semi").select("conv", F.coalesce("t", F.lit(0)).alias("t"), "id", "author", "post")
    placed = number_rows(threads, "conv", ["t", "id"], "pos")
    lower = F.lower(F.concat_ws(" ", "title", "selftext", "body"))
    words = F.array_distinct(F.filter(F.split(lower, r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    tokens = F.regexp_extract_all(lower, F.lit(r"[\p{L}\p{N}_-]+"), F.lit(0))  # user names may hold _ and -
    names = F.array_union(tokens, F.transform(tokens, lambda w: F.regexp_replace(w, "^-+|-+$", "")))
    text = entries.join(placed.select("id"), "id", "left_semi").groupBy("id").agg(F.min(words).alias("words"), F.min(names).alias("names"))
    placed = materialize(placed.join(text, "id", "left"), "placed")
    mine = placed.join(loose.select("id"), "id", "left_semi").select("conv", F.col("id").alias("c_id"), F.col("t").alias("c_t"), F.col("words").alias("c_words"), F.col("names").alias("c_names"), F.col("pos").alias("c_pos"))
    name = F.lower("author")
    earlier = ((F.col("pos") < F.col("c_pos")) | F.col("post")) & (F.col("t") <= F.col("c_t")) & (F.col("id") != F.col("c_id"))
    overlap = F.size(F.array_intersect("words", "c_words")) / F.greatest(F.lit(1), F.least(F.size("words"), F.size("c_words")))
    time = _WEIGHTS["time"] / (1 + F.greatest(F.lit(0), F.col("c_t") - F.col("t")) / _SCALE)
    score = time + _WEIGHTS["mention"] * F.coalesce(F.array_contains("c_names", name), F.lit(False)).cast("int") + _WEIGHTS["overlap"] * F.coalesce(overlap, F.lit(0.0)) + _WEIGHTS["post"] * F.col("post").cast("int")
    scored = lambda c: c.where(earlier).select("c_id", "id", score.alias("score"))
    top = lambda c: c.groupBy("c_id").agg(F.max(F.struct("score", "id")).alias("best"))
    back = F.filter(F.sequence(F.col("c_pos") - look_back, F.col("c_pos") - 1), lambda x: x >= 0)
    asks = mine.select("*", F.explode(F.array_union(F.array(F.lit(-1).cast("bigint")), back)).alias("at"))
    spots = placed.withColumn("at", F.explode(F.when(F.col("post"), F.array(F.col("pos"), F.lit(-1).cast("bigint"))).otherwise(F.array("pos"))))  # the post is looked up at -1
    named = mine.select("*", F.explode("c_names").alias("name")).join(placed.withColumn("name", name), ["conv", "name"])
    first = materialize(top(scored(asks.join(spots, ["conv", "at"])).unionByName(scored(named))), "first_parents")
    # what is further back and not named can only win by common words, and only if full marks for them would reach the best so far
    open_ = mine.where(F.size("c_words") > 0).join(first, "c_id")
    far = open_.join(placed, "conv").where((F.col("pos") < F.col("c_pos") - look_back) & (time + _WEIGHTS["overlap"] + 1e-9 >= F.col("best.score")))
    best = top(first.select("c_id", "best.id", "best.score").unionByName(scored(far)))
    return loose.join(best, F.col("id") == F.col("c_id"), "left").select("id", F.col("best.id").alias("parent_id"), F.lit("inferred").alias("kind"), F.col("best.score").alias("score"))


def conversations(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages with their links, and one row per conversation with what is wrong with it."""
    m = messages(entries)
    links = reply_links(entries, m)
    up = m.select(F.col("id").alias("parent_id"), F.col("t").alias("p_t"))
    linked = links.join(up, "parent_id", "left").select("id", "parent_id", "kind", "score", "p_t")
    rows = m.where("conv is not null").join(linked, "id", "left")
    broken = ~F.col("post") & ((F.coalesce("score", F.lit(0.0)) < 1) | (F.col("root") != F.col("conv")) | F.col("root").isNull() | F.coalesce(F.col("t") < F.col("p_t"), F.lit(False)))
    rows = materialize(rows.select("conv", "id", "post", "text", "author", "is_submitter", "t", "parent_id", "kind", "score", broken.alias("broken")), "linked")
    heads = rows.where("post").select("conv", F.col("author").alias("op_author"), F.col("text").alias("head_text"))
    stats = rows.where("not post").groupBy("conv").agg(F.max("broken").alias("broken"), F.sum(F.col("text").cast("bigint")).alias("comments"))
    roles = _roles(rows.where("not post and text").join(heads, "conv"))
    answered = roles.where("role = 'other'").groupBy("conv").agg(F.count(F.lit(1)).alias("replies"))
    convs = heads.join(stats, "conv", "full").join(answered, "conv", "left").select(
        "conv", "op_author", F.coalesce("comments", F.lit(0)).alias("comments"),
        F.when(F.col("head_text").isNull(), "no post").when(~F.col("head_text"), "empty post").when(F.coalesce("broken", F.lit(False)), "broken").when(F.coalesce("replies", F.lit(0)) == 0, "no reply").otherwise("kept").alias("state"),
    )
    return rows, materialize(convs, "conversations")


def _roles(rows: DataFrame) -> DataFrame:
    same = (F.col("author") == F.col("op_author")) & (F.col("author") != "[deleted]")
    op = F.col("post") | F.coalesce("is_submitter", same, F.lit(False))
    return rows.withColumn("role", F.when(op, "op").otherwise("other"))


def turns(entries: DataFrame) -> DataFrame:
    """(post_id, turn, id, role) of the kept conversations."""
    rows, convs = conversations(entries)
    kept = _roles(rows.where("post or text").join(convs.where("state = 'kept'").select("conv", "op_author"), "conv"))
    placed = number_rows(kept.select("conv", F.coalesce("t", F.lit(-(1 << 62))).alias("t"), "id", "role"), "conv", ["t", "id"], "turn")
    return placed.select(F.col("conv").alias("post_id"), "turn", "id", "role")
