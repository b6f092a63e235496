"""Queries on word summaries, lengths and categories of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import lexicon
from textloom.functions import text as X
from textloom.operators import summaries as S
from textloom.operators.ordinal import number_rows
from textloom.plans.registry import query
from textloom.session import table


def _list(words):
    return ", ".join("('" + w.replace("'", "''") + "')" for w in words)


def _word_table(spark, words):
    return spark.createDataFrame([(w,) for w in words], "word string")


_WORDS = """
WITH w AS (SELECT word, CAST(sum(total_count) AS BIGINT) AS total_count, min(majority_upos) AS majority_upos, min(majority_model) AS majority_model FROM mostfreq WHERE word IS NOT NULL AND total_count IS NOT NULL GROUP BY word)
"""


def _words(spark, sf_dir):
    m = table(spark, sf_dir, "mostfreq").where("word is not null and total_count is not null")
    return m.groupBy("word").agg(F.sum("total_count").alias("total_count"), F.min("majority_upos").alias("majority_upos"), F.min("majority_model").alias("majority_model"))


@query("stopword_antijoin", f"WITH s(x) AS (VALUES {_list(lexicon.STOPWORDS)}) SELECT word, total_count, majority_upos FROM mostfreq WHERE word IS NULL OR lower(word) NOT IN (SELECT x FROM s)")
def stopword_antijoin(spark, sf_dir):
    return S.without_words(table(spark, sf_dir, "mostfreq"), F.broadcast(_word_table(spark, lexicon.STOPWORDS))).select("word", "total_count", "majority_upos")


_TOP = "SELECT row_number() OVER (ORDER BY total_count DESC, word) AS r, word, total_count FROM n"


@query("top10_by_pos", _WORDS + f""", s(x) AS (VALUES {_list(lexicon.STOPWORDS)}), n AS (SELECT * FROM w WHERE lower(word) NOT IN (SELECT x FROM s)),
o AS ({_TOP}), j AS ({_TOP} WHERE majority_upos = 'ADJ'), v AS ({_TOP} WHERE majority_upos = 'VERB'), u AS ({_TOP} WHERE majority_upos = 'NOUN')
SELECT CAST(i AS INTEGER) AS rank, o.word AS top_overall, o.total_count AS top_overall_count, j.word AS top_adj, j.total_count AS top_adj_count, v.word AS top_verb, v.total_count AS top_verb_count, u.word AS top_noun, u.total_count AS top_noun_count
FROM range(1, 11) g(i) LEFT JOIN o ON o.r = i LEFT JOIN j ON j.r = i LEFT JOIN v ON v.r = i LEFT JOIN u ON u.r = i""")
def top10_by_pos(spark, sf_dir):
    n = S.without_words(_words(spark, sf_dir), F.broadcast(_word_table(spark, lexicon.STOPWORDS)))
    return S.top_table(n, {"overall": F.lit(True), **{u.lower(): F.col("majority_upos") == u for u in ("ADJ", "VERB", "NOUN")}})


@query("adjectives_by_model", _WORDS + "SELECT replace(replace(majority_model, '-', '_'), '.', '_') AS model_slug, word, total_count, row_number() OVER (PARTITION BY majority_model ORDER BY total_count DESC, word) AS rank FROM w WHERE majority_upos = 'ADJ'")
def adjectives_by_model(spark, sf_dir):
    a = _words(spark, sf_dir).where("majority_upos = 'ADJ'").withColumn("o", -F.col("total_count")).withColumn("g", F.coalesce("majority_model", F.lit("")))
    r = number_rows(a, "g", ["o", "word"], "at")  # a model's list may be most of the table: ranks are given over range partitions
    return r.select(X.slug(F.col("majority_model")).alias("model_slug"), "word", "total_count", (F.col("at") + 1).alias("rank"))


for _name, _pronouns in (("pronoun_sums", lexicon.PRONOUNS), ("pronoun_sums_compat", lexicon.PRONOUNS_COMPAT)):

    @query(_name, f"WITH s(x) AS (VALUES {_list(_pronouns)}) SELECT lower(w) AS word_lower, count(*) AS total_count FROM (SELECT unnest(string_split(cleaned_text, ' ')) AS w FROM entries) WHERE lower(w) IN (SELECT x FROM s) GROUP BY ALL")
    def pronoun_sums(spark, sf_dir, words=_pronouns):
        n = table(spark, sf_dir, "entries").select(F.explode(F.split("cleaned_text", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("total_count"))
        return S.listed_sums(n, F.broadcast(_word_table(spark, words)))


@query("summary_rebuilt", """
WITH c AS (SELECT DISTINCT chunk_id, word, unnest(map_entries(counts)) AS e FROM allposbreakdown WHERE word IS NOT NULL),
p AS (SELECT word, e.key AS k, sum(e.value) AS n FROM c GROUP BY ALL),
r AS (SELECT word, k, n, row_number() OVER (PARTITION BY word ORDER BY n DESC, k) AS r, sum(n) OVER (PARTITION BY word) AS t FROM p)
SELECT word, k AS majority_upos, CAST(n AS BIGINT) AS majority_count, CAST(t AS BIGINT) AS total_count FROM r WHERE r = 1""")
def summary_rebuilt(spark, sf_dir):
    rows = S.map_rows(table(spark, sf_dir, "allposbreakdown").where("word is not null"), "counts", "chunk_id", "word").distinct()
    total = rows.groupBy("word").agg(F.sum("n").alias("total_count"))
    return S.majority(rows).select("word", F.col("key").alias("majority_upos"), F.col("n").alias("majority_count")).join(total, "word")


@query("nested_counters", "WITH c AS (SELECT word, unnest(map_entries(models)) AS e FROM allposbreakdown WHERE word IS NOT NULL), p AS (SELECT word, e.key AS k, CAST(sum(e.value) AS BIGINT) AS n FROM c GROUP BY ALL) SELECT word, string_agg(k || ':' || n, ' ' ORDER BY k) AS models FROM p GROUP BY ALL")
def nested_counters(spark, sf_dir):
    maps = S.counter_maps(S.map_rows(table(spark, sf_dir, "allposbreakdown").where("word is not null"), "models", "word"), name="models")
    return maps.select("word", F.array_join(F.array_sort(F.transform(F.map_entries("models"), lambda e: F.concat_ws(":", e["key"], e["value"]))), " ").alias("models"))


@query("most_frequent_by_model", """
WITH g AS (SELECT majority_model, word, CAST(sum(majority_model_count) AS BIGINT) AS n FROM mostfreq WHERE word IS NOT NULL GROUP BY ALL)
SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY majority_model ORDER BY n DESC, word) <= 10""")
def most_frequent_by_model(spark, sf_dir):
    n = table(spark, sf_dir, "mostfreq").where("word is not null").groupBy("majority_model", "word").agg(F.sum("majority_model_count").alias("n"))
    return S.top_k(n, 10, [F.desc("n"), F.asc("word")], "majority_model").drop("rank")


# --- lengths ---
_LEN = r"""
WITH t AS (SELECT trim(CASE WHEN type = 'submission' THEN coalesce(title, '') || ' ' || coalesce(selftext, '') ELSE coalesce(body, '') END, E' \t\r\n') AS x FROM entries),
l AS (SELECT length(x) AS chars, len(list_filter(string_split_regex(x, '[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}]+'), lambda w: w <> '')) AS words FROM t)
"""


def _lengths(spark, sf_dir):
    t = table(spark, sf_dir, "entries").select(X.entry_text().alias("x"))
    return t.select(F.length("x").alias("chars"), F.size(X.words(F.col("x"))).alias("words"))


@query("length_stats", _LEN + "SELECT 'chars' AS unit, count(*) AS entries, avg(chars) AS mean, median(chars) AS median, CAST(max(chars) AS BIGINT) AS longest FROM l UNION ALL SELECT 'words', count(*), avg(words), median(words), max(words) FROM l")
def length_stats(spark, sf_dir):
    n = _lengths(spark, sf_dir)
    one = lambda c: S.length_stats(n, c).select(F.lit(c).alias("unit"), "entries", "mean", "median", F.col("longest").cast("bigint").alias("longest"))
    return one("chars").unionByName(one("words"))


@query("length_percentiles", _LEN + """, p AS (SELECT unnest([50, 75, 90, 95, 99, 99.5, 99.9])::DOUBLE AS percentile),
v AS (SELECT unnest([50, 75, 90, 95, 99, 99.5, 99.9])::DOUBLE AS percentile, unnest(q) AS value FROM (SELECT quantile_cont(chars, [0.5, 0.75, 0.9, 0.95, 0.99, 0.995, 0.999]) AS q FROM l))
SELECT percentile, value::DOUBLE AS value, (SELECT count(*) FROM l WHERE chars > v.value) AS above, (SELECT avg((chars > v.value)::INT) FROM l) AS share FROM v""")
def length_percentiles(spark, sf_dir):
    return S.percentiles(_lengths(spark, sf_dir), "chars")


@query("length_thresholds", _LEN + """, q AS (SELECT quantile_cont(chars, [0.99, 0.995, 0.999]) AS c, quantile_cont(words, [0.99, 0.995, 0.999]) AS w FROM l),
v AS (SELECT unnest([99, 99.5, 99.9])::DOUBLE AS percentile, floor(unnest(c))::BIGINT AS max_chars, floor(floor(unnest(w)) * 1.3)::BIGINT AS max_tokens FROM q)
SELECT *, (SELECT count(*) FROM l WHERE chars > max_chars) AS skipped FROM v""")
def length_thresholds(spark, sf_dir):
    return S.thresholds(_lengths(spark, sf_dir))


@query("length_histogram", _LEN + ", b AS (SELECT min(chars) AS lo, (max(chars) - min(chars)) / 100.0 AS w FROM l) SELECT CAST(least(floor((chars - lo) / w), 99) AS INTEGER) AS bin, count(*) AS n FROM l, b GROUP BY ALL")
def length_histogram(spark, sf_dir):
    return S.histogram(_lengths(spark, sf_dir), "chars")


@query("length_guard", _LEN + "SELECT CASE WHEN chars >= 600 THEN 'drop' WHEN chars > 300 THEN 'single' ELSE 'batch' END AS route, count(*) AS n FROM l GROUP BY ALL")
def length_guard(spark, sf_dir):
    route = X.length_route(X.entry_text(), drop=600, single=300)
    return table(spark, sf_dir, "entries").groupBy(route.alias("route")).agg(F.count(F.lit(1)).alias("n"))


@query("large_documents", "SELECT count(*) AS large FROM documents WHERE length(text) > 20000")
def large_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count_if(F.length("text") > 20_000).alias("large"))


@query("entry_text", _LEN.split(",\nl AS")[0] + " SELECT x AS text, count(*) AS n FROM t GROUP BY ALL")
def entry_text(spark, sf_dir):
    return table(spark, sf_dir, "entries").groupBy(X.entry_text().alias("text")).agg(F.count(F.lit(1)).alias("n"))


@query("empty_texts", _LEN.split(",\nl AS")[0] + " SELECT x = '' AS empty, count(*) AS n FROM t GROUP BY ALL")
def empty_texts(spark, sf_dir):
    return table(spark, sf_dir, "entries").groupBy(X.is_blank(X.entry_text()).alias("empty")).agg(F.count(F.lit(1)).alias("n"))


@query("unprocessed_antijoin", "SELECT e.id, e.type, count(*) AS n FROM entries e WHERE e.id IS NOT NULL AND e.id NOT IN (SELECT id FROM processed_ids WHERE id IS NOT NULL) GROUP BY ALL")
def unprocessed_antijoin(spark, sf_dir):
    left = table(spark, sf_dir, "entries").where("id is not null").join(table(spark, sf_dir, "processed_ids").select("id"), "id", "left_anti")
    return left.groupBy("id", "type").agg(F.count(F.lit(1)).alias("n"))


@query("dedup_ids", "SELECT id, max(score) AS score, count(*) AS copies FROM entries WHERE id IS NOT NULL GROUP BY id")
def dedup_ids(spark, sf_dir):
    return table(spark, sf_dir, "entries").where("id is not null").groupBy("id").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("copies"))


def _skip_sql() -> str:
    re2 = lambda p: p.replace("(?iU)", "(?i)").replace("'", "''")
    main = " ".join(f"WHEN regexp_matches(x, '{re2(p)}') THEN '{n}'" for n, p in lexicon.SKIPPED)
    sub = " ".join(f"WHEN regexp_matches(x, '{re2(p)}') THEN '{n}'" for n, p in lexicon.SKIPPED_SUB)
    return _LEN.split(",\nl AS")[0] + f", c AS (SELECT CASE {main} ELSE 'other' END AS m, CASE {sub} ELSE 'chatgpt_other' END AS s FROM t) SELECT m AS category, count(*) AS n FROM c GROUP BY ALL UNION ALL SELECT s, count(*) FROM c WHERE m = 'chatgpt_mentions' GROUP BY ALL"


@query("skip_categories", _skip_sql())
def skip_categories(spark, sf_dir):
    c = table(spark, sf_dir, "entries").select(F.explode(X.skip_category(X.entry_text())).alias("category"))
    return c.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("skip_examples_topn", r"""
WITH t AS (SELECT id, trim(CASE WHEN type = 'submission' THEN coalesce(title, '') || ' ' || coalesce(selftext, '') ELSE coalesce(body, '') END, E' \t\r\n') AS x FROM entries WHERE id IS NOT NULL),
c AS (SELECT DISTINCT id, x, CASE WHEN regexp_matches(x, '(?i)\bcgpt(?:[-\s]?([345]|4\.5|4\.1|4o|5))?\b') THEN 'cgpt_mentions' WHEN regexp_matches(x, '(?i)\bchat[-\s]?gpt(?:[-\s]?([345]|4\.5|4\.1|4o|5))?\b') THEN 'chatgpt_mentions' ELSE 'other' END AS category FROM t)
SELECT category, id, x AS text, row_number() OVER (PARTITION BY category ORDER BY id, x) AS rank FROM c QUALIFY rank <= 10""")
def skip_examples_topn(spark, sf_dir):
    c = table(spark, sf_dir, "entries").where("id is not null").select("id", X.entry_text().alias("text")).distinct()
    c = c.withColumn("category", F.get(X.skip_category(F.col("text")), F.lit(0)))
    return S.top_k(c, 10, [F.asc("id"), F.asc("text")], "category").select("category", "id", "text", F.col("rank").cast("bigint").alias("rank"))
