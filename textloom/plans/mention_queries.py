"""Queries on product mentions in the cleaned texts of entries, and on the words attached to them.

The tables carry no parses. ``_TREE`` puts a made-up tree over the words of each text (word i hangs on word
i div 2), which exercises the algebra of the roles, not linguistics.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import lexicon
from textloom.functions import text as X
from textloom.operators import attachments as A
from textloom.operators import summaries as S
from textloom.plans.registry import query
from textloom.session import materialize, once, spread, table

_CASE = "CASE " + " ".join(f"WHEN regexp_matches({{0}}, '{p}') THEN '{n}'" for n, p in lexicon.CANONICAL.items()) + " END"
_UPOS = ["NOUN", "VERB", "ADJ", "ADV", "PUNCT"]

_WORDS = f"""
WITH e AS (SELECT row_number() OVER () AS rid, model_inferred_temporal AS inferred, list_filter(string_split(cleaned_text, ' '), lambda w: w <> '') AS ws FROM entries WHERE cleaned_text IS NOT NULL),
x AS (SELECT rid, inferred, unnest(ws) AS text, unnest(range(1, len(ws) + 1)) AS id FROM e),
w AS (SELECT rid, inferred, text, lower(text) AS lemma, id, id // 2 AS head_id, CASE WHEN id = 1 THEN 'root' ELSE 'dep' END AS deprel,
        (['NOUN','VERB','ADJ','ADV','PUNCT'])[1 + length(text) % 5] AS upos, {_CASE.format('text')} AS model FROM x)
"""
_ROLES = _WORDS + """,
m AS (SELECT * FROM w WHERE model IS NOT NULL),
f AS (SELECT * FROM w WHERE model IS NULL),
h AS (SELECT m.rid, m.id AS m_id, m.model, m.inferred, f.* EXCLUDE (rid, model, inferred) FROM m JOIN f ON f.rid = m.rid AND f.id = m.head_id WHERE m.deprel <> 'root'),
k AS (SELECT m.rid, m.model, m.inferred, f.* EXCLUDE (rid, model, inferred) FROM m JOIN f ON f.rid = m.rid AND f.head_id = m.id),
a AS (
  SELECT model, inferred, 'head' AS role, lemma AS word, upos FROM h
  UNION ALL SELECT model, inferred, 'child', lemma, upos FROM k
  UNION ALL SELECT h.model, h.inferred, 'grandparent', f.lemma, f.upos FROM h JOIN f ON f.rid = h.rid AND f.id = h.head_id WHERE h.deprel <> 'root'
  UNION ALL SELECT h.model, h.inferred, 'sibling', f.lemma, f.upos FROM h JOIN f ON f.rid = h.rid AND f.head_id = h.id WHERE f.id <> h.m_id
  UNION ALL SELECT k.model, k.inferred, 'grandchild', f.lemma, f.upos FROM k JOIN f ON f.rid = k.rid AND f.head_id = k.id)
"""


def _tree(entries):
    """One sentence per text: (model_inferred_temporal, toks)."""
    upos = ", ".join(f"'{u}'" for u in _UPOS)
    toks = f"""transform(ws, (w, i) -> struct(w AS text, lower(w) AS lemma, get(array({upos}), length(w) % 5) AS upos, if(i = 0, 'root', 'dep') AS deprel, (i + 1) div 2 AS head_id, i + 1 AS id,
        filter(array(2 * i + 2, 2 * i + 3), c -> c <= size(ws)) AS children))"""
    words = F.filter(F.split("cleaned_text", " "), lambda w: w != "")
    texts = spread(entries.where("cleaned_text is not null").select("model_inferred_temporal", "cleaned_text"))
    return once(once(texts, ws=words), toks=F.expr(toks)).select("model_inferred_temporal", "toks")


def _attached(spark, sf_dir, **kw):
    return A.attachments(_tree(table(spark, sf_dir, "entries")), **kw)


@query("deps_direct", _ROLES + "SELECT role, model, word, upos, count(*) AS n FROM a WHERE role IN ('head', 'child') GROUP BY ALL")
def deps_direct(spark, sf_dir):
    return S.counts(_attached(spark, sf_dir, one_hop=False), "role", "model", "word", "upos")


@query("deps_onehop", _ROLES + "SELECT role, model, word, upos, count(*) AS n FROM a GROUP BY ALL")
def deps_onehop(spark, sf_dir):
    return S.counts(_attached(spark, sf_dir), "role", "model", "word", "upos")


@query("deps_onehop_joins", _ROLES + "SELECT role, model, word, upos, count(*) AS n FROM a GROUP BY ALL")
def deps_onehop_joins(spark, sf_dir):
    # row numbers are given before the words are split up, and kept: they must be the same in all joins
    numbered = materialize(_tree(table(spark, sf_dir, "entries")).select(F.monotonically_increasing_id().alias("rid"), "toks"), "numbered")
    rows = numbered.select("rid", F.explode("toks").alias("w")).select("rid", "w.*")
    return S.counts(A.attachments_by_joins(rows, ["rid"]), "role", "model", "word", "upos")


@query("deps_triples", _WORDS + "SELECT coalesce(h.text, 'ROOT') AS head, w.deprel, w.text AS word, count(*) AS n FROM w LEFT JOIN w h ON h.rid = w.rid AND h.id = w.head_id GROUP BY ALL")
def deps_triples(spark, sf_dir):
    return S.counts(A.triples(_tree(table(spark, sf_dir, "entries")).select("toks")), "head", "deprel", "word")


@query("deps_children", _WORDS + "SELECT c AS children, count(*) AS n FROM (SELECT w.rid, w.id, count(k.id) AS c FROM w LEFT JOIN w k ON k.rid = w.rid AND k.head_id = w.id GROUP BY ALL) GROUP BY ALL")
def deps_children(spark, sf_dir):
    t = A.with_children(_tree(table(spark, sf_dir, "entries")).select("toks"))
    return t.select(F.explode("toks").alias("w")).groupBy(F.size("w.children").cast("bigint").alias("children")).agg(F.count(F.lit(1)).alias("n"))


@query("word_pos_counts", _ROLES + "SELECT word, upos, count(*) AS n FROM a GROUP BY ALL")
def word_pos_counts(spark, sf_dir):
    return S.counts(_attached(spark, sf_dir), "word", "upos")


@query("word_model_counts", _ROLES + "SELECT word, model, count(*) AS n FROM a GROUP BY ALL")
def word_model_counts(spark, sf_dir):
    return S.counts(_attached(spark, sf_dir), "word", "model")


@query("inferred_override", _ROLES + "SELECT coalesce(inferred[1], model) AS model, word, count(*) AS n FROM a GROUP BY ALL")
def inferred_override(spark, sf_dir):
    return S.counts(_attached(spark, sf_dir, inferred="model_inferred_temporal"), "model", "word")


@query("inferred_generic_only", _ROLES + "SELECT CASE WHEN model = 'chatgpt' THEN coalesce(inferred[1], model) ELSE model END AS model, word, count(*) AS n FROM a GROUP BY ALL")
def inferred_generic_only(spark, sf_dir):
    return S.counts(_attached(spark, sf_dir, inferred="model_inferred_temporal", generic_only=True), "model", "word")


_SUMMARY = _ROLES + """,
p AS (SELECT word, upos, count(*) AS n FROM a GROUP BY ALL),
q AS (SELECT word, model, count(*) AS n FROM a GROUP BY ALL),
pm AS (SELECT word, upos AS majority_upos, n AS majority_count FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, upos) AS r FROM p) WHERE r = 1),
qm AS (SELECT word, model AS majority_model, n AS majority_model_count FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, model) AS r FROM q) WHERE r = 1),
t AS (SELECT word, CAST(sum(n) AS BIGINT) AS total_count FROM p GROUP BY ALL),
fr AS (SELECT word, string_agg(model || '=' || n, ',' ORDER BY model) AS model_freqs FROM q GROUP BY ALL)
SELECT * FROM t JOIN pm USING (word) JOIN qm USING (word) JOIN fr USING (word)
"""


def _summary(spark, sf_dir, drop):
    # one aggregate over the attached words is kept; both majorities come from it
    both = materialize(S.counts(_attached(spark, sf_dir), "word", "upos", "model"), "word_counts")
    of = lambda c: both.groupBy("word", F.col(c).alias("key")).agg(F.sum("n").alias("n"))
    s = S.summary(of("upos"), of("model"), drop)
    entries = F.transform(F.map_entries("model_freqs"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return s.withColumn("model_freqs", F.array_join(F.array_sort(entries), ","))


@query("majority_pos_model", _SUMMARY)
def majority_pos_model(spark, sf_dir):
    return _summary(spark, sf_dir, None)


@query("punct_dropped_summary", _SUMMARY + " WHERE majority_upos <> 'PUNCT'")
def punct_dropped_summary(spark, sf_dir):
    return _summary(spark, sf_dir, "PUNCT")


@query("summary_totals", _ROLES + "SELECT count(DISTINCT word) AS words, count(*) AS total, (SELECT count(*) FROM m) AS mentions FROM a")
def summary_totals(spark, sf_dir):
    tree = _tree(table(spark, sf_dir, "entries"))
    n = A.surfaces(tree).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("mentions"))
    return A.attachments(tree).agg(F.countDistinct("word").alias("words"), F.count(F.lit(1)).alias("total")).join(F.broadcast(n), F.lit(True))


@query("match_log", _WORDS + "SELECT model, text AS surface, count(*) AS n FROM w WHERE model IS NOT NULL GROUP BY ALL")
def match_log(spark, sf_dir):
    return A.surfaces(_tree(table(spark, sf_dir, "entries")))


@query("match_log_merged", f"""
WITH s AS (SELECT unnest(map_entries(matches)) AS m FROM match_log)
SELECT {_CASE.format('m.key')} AS canonical, m.key AS surface, CAST(sum(m.value) AS BIGINT) AS n FROM s GROUP BY ALL""")
def match_log_merged(spark, sf_dir):
    rows = S.map_rows(table(spark, sf_dir, "match_log"), "matches")
    return rows.groupBy(X.canonical(F.col("key")).alias("canonical"), F.col("key").alias("surface")).agg(F.sum("n").alias("n"))


@query("canonical_mentions", _WORDS + "SELECT model AS canonical, count(*) AS mentions, count(DISTINCT rid) AS texts FROM w WHERE model IS NOT NULL GROUP BY ALL")
def canonical_mentions(spark, sf_dir):
    names = F.filter(F.transform(F.split("cleaned_text", " "), lambda w: X.canonical(w)), lambda c: c.isNotNull())
    found = once(spread(table(spark, sf_dir, "entries").select("cleaned_text")), names=names).select("names", F.explode(F.array_distinct("names")).alias("canonical"))
    n = F.size(F.filter("names", lambda c: c == F.col("canonical")))
    return found.groupBy("canonical").agg(F.sum(n).alias("mentions"), F.count(F.lit(1)).alias("texts"))


@query("uppercase_tokens", r"SELECT DISTINCT unnest(regexp_extract_all(cleaned_text, '\b[A-Z][A-Z0-9.]+\b')) AS token FROM entries")
def uppercase_tokens(spark, sf_dir):
    return table(spark, sf_dir, "entries").select(F.explode(X.uppercase_tokens(F.col("cleaned_text"))).alias("token")).distinct()


@query("normalized_mentions")
def normalized_mentions(spark, sf_dir):
    """Free text through cleaning and name rewriting, then the surfaces counted: no look-ahead in the SQL twin's dialect."""
    t = table(spark, sf_dir, "documents").select(F.explode(X.cleaned_sentences(F.col("text"))).alias("s")).where("s like '%GPT%'")
    return t.select(F.explode(F.split("s", " ")).alias("surface")).withColumn("model", X.canonical(F.col("surface"))).where("model is not null").groupBy("model", "surface").agg(F.count(F.lit(1)).alias("n"))


@query("mention_sentences")
def mention_sentences(spark, sf_dir):
    e = table(spark, sf_dir, "entries")
    s = X.mention_sentences(X.cleaned_sentences(X.entry_text()))
    return e.select("id", s.alias("s")).where("size(s) > 0").select("id", F.array_join("s", "\n\n").alias("matched"), F.size("s").alias("n_sentences"))


@query("missing_inference", "SELECT id, substr(replace(coalesce(body, ''), chr(10), ' '), 1, 100) AS snippet FROM entries WHERE model_inferred_temporal IS NULL OR len(model_inferred_temporal) = 0")
def missing_inference(spark, sf_dir):
    e = table(spark, sf_dir, "entries").where("model_inferred_temporal is null or size(model_inferred_temporal) = 0")
    return e.select("id", X.snippet(F.coalesce("body", F.lit(""))).alias("snippet"))
