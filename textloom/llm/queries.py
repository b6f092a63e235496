"""Queries of the training-text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.llm import abuse, bpe, conversations, leaks, lookalikes, near_duplicates, personal_info, shared_spans, term_counts
from textloom.plans import hierarchy_queries
from textloom.plans.registry import query
from textloom.session import table

_TERMS = r"""
WITH s AS (
  SELECT chunk_id, word, max(total_count) AS n, max(parts) AS parts FROM (
    SELECT chunk_id, word, total_count, NULL::BIGINT AS parts FROM mostfreq
    UNION ALL SELECT chunk_id, word, NULL, coalesce(list_sum(map_values(counts)), 0)::BIGINT FROM allposbreakdown)
  WHERE word IS NOT NULL GROUP BY ALL),
c AS (SELECT lower(regexp_replace(word, '^\s+|\s+$', '', 'g')) AS word, chunk_id, sum(coalesce(n, parts, 0)) AS n FROM s GROUP BY ALL),
t AS (SELECT word, CAST(sum(n) AS BIGINT) AS total, CAST(count(DISTINCT chunk_id) AS BIGINT) AS records FROM c WHERE word <> '' GROUP BY word),
k AS (SELECT count(DISTINCT chunk_id) AS chunks FROM mostfreq),
m AS (SELECT word, total, records, total <= 2 AS rare, chunks > 0 AND records >= 0.2 * chunks AS common FROM t, k)
"""


def _marked(spark, sf_dir):
    summary = table(spark, sf_dir, "mostfreq")
    terms = term_counts.term_counts(summary, table(spark, sf_dir, "allposbreakdown"))
    return term_counts.frequency_marks(terms, term_counts.record_count(summary))


@query("p5_found", _TERMS + "SELECT word, 'rare' AS mark FROM m WHERE rare UNION ALL SELECT word, 'common' FROM m WHERE common")
def p5_found(spark, sf_dir):
    marks = F.array_compact(F.array(F.when(F.col("rare"), F.lit("rare")), F.when(F.col("common"), F.lit("common"))))
    return _marked(spark, sf_dir).select("word", F.explode(marks).alias("mark"))


@query("p5_terms", _TERMS + "SELECT * FROM m")
def p5_terms(spark, sf_dir):
    return _marked(spark, sf_dir)


@query("p2_found")
def p2_found(spark, sf_dir):
    return lookalikes.changed_fields(table(spark, sf_dir, "entries"))


@query("p2_forms")
def p2_forms(spark, sf_dir):
    return lookalikes.consistent_entries(table(spark, sf_dir, "entries"))


@query("p2_model_groups")
def p2_model_groups(spark, sf_dir):
    names = table(spark, sf_dir, "entries").select(F.explode("models_detected").alias("name"))
    return lookalikes.skeleton_groups(names, "name")


@query("p2_word_groups")
def p2_word_groups(spark, sf_dir):
    return lookalikes.word_groups(table(spark, sf_dir, "entries"), "body")


@query("p8_ids")
def p8_ids(spark, sf_dir):
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


@query("p9_found")
def p9_found(spark, sf_dir):
    return leaks.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@query("p9_spans")
def p9_spans(spark, sf_dir):
    return leaks.leaked_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@query("p10_found")
def p10_found(spark, sf_dir):
    return shared_spans.shared_chars(table(spark, sf_dir, "documents"))


@query("p10_report")
def p10_report(spark, sf_dir):
    return shared_spans.shared_report(table(spark, sf_dir, "documents"))


@query("p10_tokens")
def p10_tokens(spark, sf_dir):
    return shared_spans.shared_tokens(table(spark, sf_dir, "documents"))


@query("p10_intervals")
def p10_intervals(spark, sf_dir):
    return shared_spans.removal_intervals(table(spark, sf_dir, "documents"))


_THREADS = hierarchy_queries._WALK + r""",
x AS (
  SELECT id, max(type = 'submission') AS post, min(author) AS author, max(is_submitter) AS own,
    min(CASE WHEN created_utc >= 100000000000 THEN created_utc // 1000 WHEN created_utc IS NOT NULL THEN created_utc ELSE CAST(epoch(try_cast(created_date AS TIMESTAMP)) AS BIGINT) END) AS t,
    nullif(regexp_replace(trim(min(link_id)), '^[tT][13]_', ''), '') AS link,
    nullif(regexp_replace(trim(min(parent_id)), '^[tT][13]_', ''), '') AS parent,
    max(CASE WHEN type = 'submission' THEN coalesce(trim(title, E' \t\r\n') NOT IN ('', '[deleted]', '[removed]'), false) OR coalesce(trim(selftext, E' \t\r\n') NOT IN ('', '[deleted]', '[removed]'), false)
             ELSE coalesce(trim(body, E' \t\r\n') NOT IN ('', '[deleted]', '[removed]'), false) END) AS has_text
  FROM entries WHERE id IS NOT NULL GROUP BY id),
v AS (SELECT x.*, CASE WHEN post THEN x.id ELSE coalesce(link, CASE WHEN state = 'tree' THEN root_id END) END AS conv, CASE WHEN state = 'tree' THEN root_id END AS root FROM x JOIN h ON h.id = x.id),
y AS (
  SELECT v.*, NOT v.post AND (p.id IS NULL OR p.conv IS DISTINCT FROM v.conv OR v.root IS DISTINCT FROM v.conv OR coalesce(v.t < p.t, false)) AS broken
  FROM v LEFT JOIN v p ON p.id = v.parent WHERE v.conv IS NOT NULL),
z AS (
  SELECT y.*, CASE WHEN y.post OR coalesce(y.own, y.author = s.author AND y.author <> '[deleted]', false) THEN 'op' ELSE 'other' END AS role, s.has_text AS head_text
  FROM y JOIN y s ON s.id = y.conv AND s.post),
k AS (SELECT conv FROM z GROUP BY conv HAVING bool_and(head_text) AND NOT bool_or(broken) AND bool_or(NOT post AND has_text AND role = 'other'))
SELECT conv AS post_id, row_number() OVER (PARTITION BY conv ORDER BY t, id) - 1 AS turn, id, role
FROM z WHERE conv IN (SELECT conv FROM k) AND (post OR has_text)
"""


@query("p3_found", _THREADS)
def p3_found(spark, sf_dir):
    return conversations.turns(table(spark, sf_dir, "entries"))


@query("p3_links")
def p3_links(spark, sf_dir):
    entries = table(spark, sf_dir, "entries")
    return conversations.reply_links(entries, conversations.messages(entries))


@query("p3_conversations")
def p3_conversations(spark, sf_dir):
    return conversations.conversations(table(spark, sf_dir, "entries"))[1]


@query("p1_found")
def p1_found(spark, sf_dir):
    return near_duplicates.similar_pairs(table(spark, sf_dir, "entries"))


@query("p1_groups")
def p1_groups(spark, sf_dir):
    return near_duplicates.groups(table(spark, sf_dir, "entries"))


@query("p4_found")
def p4_found(spark, sf_dir):
    return personal_info.found(table(spark, sf_dir, "entries"), table(spark, sf_dir, "name_parts"))


@query("p4_redacted")
def p4_redacted(spark, sf_dir):
    r = personal_info.redacted(table(spark, sf_dir, "entries"), table(spark, sf_dir, "name_parts"))
    return r.select("id", *(c for f in personal_info.FIELDS for c in (f"{f}_redacted", f"{f}_kinds")))


def _abuse(spark, sf_dir):
    return abuse.scores(table(spark, sf_dir, "entries"), table(spark, sf_dir, "toxic_labels"), table(spark, sf_dir, "abuse_terms"))


@query("p6_found")
def p6_found(spark, sf_dir):
    return _abuse(spark, sf_dir).where("category is not null").select("id", "category")


@query("p6_scores")
def p6_scores(spark, sf_dir):
    return _abuse(spark, sf_dir)


@query("p6_rates")
def p6_rates(spark, sf_dir):
    return abuse.rates(_abuse(spark, sf_dir))
