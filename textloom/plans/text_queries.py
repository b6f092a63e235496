"""Queries on text functions: detection, masking, cleaning, features, spacing marks, intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import lexicon
from textloom.functions import text as X
from textloom.operators import assembly as B
from textloom.operators import attachments as A
from textloom.operators import conllu as C
from textloom.operators import packing as P
from textloom.operators import summaries as S
from textloom.operators import vocab as V
from textloom.plans.corpus_queries import WS, _cleaned_sql
from textloom.plans.registry import query
from textloom.plans.summary_queries import _LEN
from textloom.plans.treebank_queries import _multi
from textloom.session import table

# a token's end is the end of the text or a sign before it: what the look-ahead says of a text without white space
_TOKEN_END = "(?:''s)?[.,!?;:]?$"
_TOKEN = {n: "(?i)" + p.removesuffix(lexicon.END).replace("'", "''") + _TOKEN_END for n, p in lexicon.DETECT.items()}


@query("detected_tokens", "WITH w AS (SELECT unnest(string_split(cleaned_text, ' ')) AS w FROM entries) " + " UNION ALL ".join(f"SELECT '{n}' AS model, count(*) AS n FROM w WHERE regexp_matches(w, '{p}')" for n, p in _TOKEN.items()))
def detected_tokens(spark, sf_dir):
    w = table(spark, sf_dir, "entries").select(F.explode(F.split("cleaned_text", " ")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    each = F.array(*(F.struct(F.lit(n).alias("model"), F.when(X.detects(F.col("w"), n), F.col("n")).otherwise(0).alias("n")) for n in lexicon.DETECT))
    return w.select(F.inline(each)).groupBy("model").agg(F.sum("n").alias("n"))


# the look-ahead of a pattern may be consumed where only the existence of a match is asked for
_ANYWHERE = "|".join("(?:" + p.removesuffix(lexicon.END).replace("'", "''") + ")" for p in lexicon.DETECT.values())
_HIT = f"(?i)(?:{_ANYWHERE})(?:''s)?(?:$|[ \\t\\n\\r]|[.,!?;:](?:[ \\t\\n\\r]|$))"
_PIECES = r"list_filter(string_split(regexp_replace(x, '([.!?])" + WS + r"', E'\\1\x01', 'g'), E'\x01'), lambda s: trim(s) <> '')"


@query("mention_sentence_counts", _LEN.split(",\nl AS")[0].replace("SELECT trim(", "SELECT id, trim(") + f", s AS (SELECT id, x, unnest({_PIECES}) AS s FROM (SELECT DISTINCT id, x FROM t WHERE id IS NOT NULL)), c AS (SELECT id, x, " + _cleaned_sql("lower(translate(s, E'\n\t', '  '))", lexicon.CLEAN_PIPELINE) + f" AS c FROM s), m AS (SELECT id, x, count(*) FILTER (regexp_matches(c, '{_HIT}')) AS n FROM c GROUP BY id, x) SELECT id, max(n) AS n FROM m GROUP BY id HAVING max(n) > 0")
def mention_sentence_counts(spark, sf_dir):
    """How many sentences of each entry mention a product, after splitting, cleaning and rewriting."""
    e = table(spark, sf_dir, "entries").where("id is not null").select("id", X.entry_text().alias("x")).distinct()
    n = F.size(X.mention_sentences(X.cleaned_sentences(F.col("x")))).cast("bigint")
    return e.select("id", n.alias("n")).groupBy("id").agg(F.max("n").alias("n")).where("n > 0")


_SENTS = "CASE p_size % 4 WHEN 0 THEN array('GPT one', p_name, 'chatbot') WHEN 1 THEN array(p_name, 'gpt-4') WHEN 2 THEN array(p_type, 'a chatbot', 'LLM') ELSE array(p_name) END"


@query("extra_mentions", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN CASE WHEN p_name LIKE '%red%' THEN 'GPT one' ELSE 'GPT one|chatbot' END WHEN p_size % 4 = 1 THEN CASE WHEN p_name LIKE '%red%' THEN '' ELSE 'gpt-4' END WHEN p_size % 4 = 2 THEN 'LLM' ELSE '' END AS matched FROM part")
def extra_mentions(spark, sf_dir):
    """Sentences with a product or a whole-sentence generic word; where an excluded word occurs, only those with the plain name."""
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_SENTS} AS s")
    return p.select("p_partkey", F.array_join(X.mention_sentences(F.col("s"), "EXTRA", "red"), "|").alias("matched"))


@query("unmatched_skipped", "SELECT p_size % 4 AS kind, count(*) AS n FROM part WHERE p_size % 4 <> 0 GROUP BY ALL")
def unmatched_skipped(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_size % 4 AS kind", f"{_SENTS} AS s")
    return p.where(F.size(X.mention_sentences(F.col("s"))) == 0).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("clean_text_tester", f"SELECT doc_id, {_cleaned_sql('text', lexicon.CLEAN_TESTER)} AS clean FROM documents")
def clean_text_tester(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.clean(F.col("text"), "tester").alias("clean"))


_DIGITS = r"regexp_replace(text, E'\n|- |_|\\\\|\"|[0-9]', '', 'g')"
_SMALL_L = r"regexp_replace(regexp_replace({x}, '(\p{{Ll}})I(\p{{Ll}}|[ \t\n\f\r\x{{0B}}]|$)', '\1l\2', 'g'), '(\p{{Ll}})I(\p{{Ll}}|[ \t\n\f\r\x{{0B}}]|$)', '\1l\2', 'g')"


@query("langid_sentence", "SELECT doc_id, " + _cleaned_sql(_SMALL_L.format(x=_DIGITS), []) + " AS clean FROM documents WHERE text IS NOT NULL")
def langid_sentence(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", X.langid_sentence(F.col("text")).alias("clean"))


@query("truncated_texts", "SELECT doc_id, trim(substr(text, 1, 50)) AS text FROM documents WHERE text IS NOT NULL")
def truncated_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", X.truncate(F.col("text"), 50).alias("text"))


@query("squashed_texts", "SELECT doc_id, " + _cleaned_sql("text", []) + " AS text FROM documents WHERE text IS NOT NULL")
def squashed_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", X.squash(F.col("text")).alias("text"))


@query("sentiment_words", "WITH t AS (SELECT doc_id, " + _cleaned_sql("translate(text, '-/', '  ')", []) + " AS t FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, string_split(lower(CASE WHEN t = '' THEN '-' ELSE t END), ' ') AS w FROM t) SELECT doc_id, array_to_string(w, ' ') AS plain, array_to_string(list_transform(w, lambda x: CASE WHEN x IN ('0', '1') THEN x ELSE regexp_replace(x, '[0-9]', '#', 'g') END), ' ') AS masked FROM w")
def sentiment_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.array_join(X.sentiment_words(F.col("text")), " ").alias("plain"), F.array_join(X.sentiment_words(F.col("text"), digits=True), " ").alias("masked"))


_LINK = r"(?:[\w.+-]+@[\w-]+\.[\w.-]+)|(?:https?://[^\s\x0B]+)|(?:www\.[^\s\x0B]+)"


@query("link_spans", f"SELECT doc_id, array_to_string(regexp_extract_all(text, '{_LINK}'), chr(10)) AS links FROM documents WHERE text IS NOT NULL")
def link_spans(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", X.link_spans(F.col("text")).alias("s"))
    return d.select("doc_id", F.array_join(F.transform("s", lambda x: F.substring(F.col("text"), x["begin"] + 1, x["end"] - x["begin"])), "\n").alias("links"))


@query("char_features", "WITH c AS (SELECT unnest(string_split(concat(p_name, ' ', p_brand, p_size), '')) AS c FROM part) SELECT c = ' ' AS space, upper(c) = c AND lower(c) <> c AS capital, regexp_matches(c, '[0-9]') AS number, count(*) AS n FROM c WHERE c <> '' GROUP BY ALL")
def char_features(spark, sf_dir):
    text = F.expr("concat(p_name, ' ', p_brand, p_size)")
    return table(spark, sf_dir, "part").select(F.inline(X.char_features(text))).groupBy("space", "capital", "number").agg(F.count(F.lit(1)).alias("n"))


@query("paragraph_counts", r"SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\n[\s\x0B]*\n'), lambda p: trim(p) <> '')) AS INTEGER) AS paragraphs FROM documents WHERE text IS NOT NULL")
def paragraph_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(X.paragraphs(F.col("text"))).alias("paragraphs"))


@query("paragraph_breaks", r"SELECT doc_id, CAST(length(regexp_extract(substr(text, instr(text, chr(10))), '^\n[\s\x0B]*\n')) AS INTEGER) AS size FROM documents WHERE contains(text, chr(10))")
def paragraph_breaks(spark, sf_dir):
    """The length of the paragraph break at each text's first line break."""
    d = table(spark, sf_dir, "documents").where(F.col("text").contains("\n"))
    return d.select("doc_id", X.paragraph_break(F.col("text"), F.instr("text", "\n") - 1).alias("size"))


@query("runs_without_mark", "WITH c AS (SELECT p_partkey, unnest(string_split(p_name, '')) AS c, unnest(range(length(p_name))) AS i FROM part), g AS (SELECT p_partkey, i, i - row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS g FROM c WHERE c <> 'e'), s AS (SELECT p_partkey, min(i) AS b, max(i) + 1 AS e FROM g GROUP BY p_partkey, g) SELECT p_partkey, string_agg(concat(b, '-', e), ' ' ORDER BY b) AS runs FROM s GROUP BY ALL")
def runs_without_mark(spark, sf_dir):
    r = X.runs_without(F.filter(F.split("p_name", ""), lambda c: c != ""), "e")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(r, lambda x: F.concat_ws("-", x["begin"].cast("string"), x["end"].cast("string"))), " ").alias("runs"))


_MISC = "CASE p_size % 4 WHEN 0 THEN '_' WHEN 1 THEN 'SpaceAfter=No' WHEN 2 THEN 'A=b|SpaceAfter=No' ELSE 'A=b' END"


@query("space_mark_dropped", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '_' WHEN 1 THEN '_' ELSE 'A=b' END AS misc FROM part")
def space_mark_dropped(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.drop_space_after(F.expr(_MISC), strict=False).alias("misc"))


@query("space_mark_added", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'SpaceAfter=No' WHEN 1 THEN 'SpaceAfter=No' ELSE 'A=b|SpaceAfter=No' END AS misc FROM part")
def space_mark_added(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.add_space_after(F.expr(_MISC), strict=False).alias("misc"))


@query("space_mark_predicate", "SELECT p_partkey, p_size % 4 IN (1, 2) AS tight FROM part")
def space_mark_predicate(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.no_space_after(F.expr(_MISC)).alias("tight"))


@query("shifted_indices", "SELECT p_partkey AS sent, CAST(unnest([11, 12, 13]) AS INTEGER) AS id, CAST(unnest([12, 0, 12]) AS INTEGER) AS head FROM part")
def shifted_indices(spark, sf_dir):
    return C.shift(_multi(spark, sf_dir).where("id_end is null"), 10).select("sent", F.col("id_start").alias("id"), "head")


@query("missing_trees", "SELECT id FROM entries WHERE id IS NOT NULL AND (score IS NULL OR score % 4 = 0 OR score % 4 = 1)")
def missing_trees(spark, sf_dir):
    tree = F.expr("CASE WHEN score % 4 = 0 THEN null WHEN score % 4 = 1 THEN array() WHEN score IS NULL THEN null ELSE array('x') END").cast("array<string>")
    return A.missing_trees(table(spark, sf_dir, "entries").where("id is not null").select("id", tree.alias("full_tree")))


@query("interval_packs", """WITH g AS (SELECT p_brand, list(p_size::BIGINT ORDER BY p_partkey) AS s FROM part GROUP BY ALL),
r AS (SELECT p_brand, list_reduce(s, lambda a, x: {'out': list_append(a.out, a.cur + (a.open AND (x > 45 OR a.size + x > 45))::INT), 'cur': a.cur + (a.open AND (x > 45 OR a.size + x > 45))::INT + (x > 45)::INT,
  'size': CASE WHEN x > 45 THEN 0 WHEN a.open AND a.size + x > 45 THEN x ELSE a.size + x END, 'open': x <= 45}, {'out': []::INTEGER[], 'cur': 0, 'size': 0::BIGINT, 'open': false}).out AS b FROM g),
u AS (SELECT p_brand, unnest(b) AS b, unnest(range(len(b))) AS i FROM r), s AS (SELECT p_brand, min(i) AS a, max(i) + 1 AS e FROM u GROUP BY p_brand, b) SELECT p_brand, string_agg(concat(a, '-', e), ' ' ORDER BY a) AS packs FROM s GROUP BY ALL""")
def interval_packs(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", F.col("p_size").cast("bigint").alias("s")))).alias("x"))
    r = P.intervals(F.transform("x", lambda y: y["s"]), 45)
    return g.select("p_brand", F.array_join(F.transform(r, lambda x: F.concat_ws("-", x["begin"].cast("string"), x["end"].cast("string"))), " ").alias("packs"))


@query("top_pronouns", f"WITH s(x) AS (VALUES {', '.join(f'({chr(39)}{w}{chr(39)})' for w in lexicon.PRONOUNS)}), n AS (SELECT lower(w) AS word_lower, count(*) AS total_count FROM (SELECT unnest(string_split(cleaned_text, ' ')) AS w FROM entries) WHERE lower(w) IN (SELECT x FROM s) GROUP BY ALL) SELECT word_lower, total_count, CAST(row_number() OVER (ORDER BY total_count DESC, word_lower) AS INTEGER) AS rank FROM n QUALIFY rank <= 10")
def top_pronouns(spark, sf_dir):
    words = F.broadcast(spark.createDataFrame([(w,) for w in lexicon.PRONOUNS], "word string"))
    n = table(spark, sf_dir, "entries").select(F.explode(F.split("cleaned_text", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("total_count"))
    return S.top_k(S.listed_sums(n, words), 10, [F.desc("total_count"), F.asc("word_lower")])


@query("weighted_split", "WITH h AS (SELECT doc_id, ('0x' || substr(md5(concat(doc_id, '|5')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS h FROM documents) SELECT CASE WHEN h < 0.5 THEN 'a' WHEN h < 0.5::DOUBLE + 0.3::DOUBLE THEN 'b' ELSE 'c' END AS shard, count(*) AS n FROM h GROUP BY ALL")
def weighted_split(spark, sf_dir):
    return B.hash_split(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], {"a": 0.5, "b": 0.3, "c": 0.2}, seed=5).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


@query("language_examples", "WITH w AS (SELECT doc_id, lang, trim(substr(text, 1, 50)) AS t FROM documents WHERE text IS NOT NULL), h AS (SELECT *, ('0x' || substr(md5(concat(doc_id, '|1234')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS h FROM w WHERE length(t) >= 10) SELECT CASE WHEN h < 0.8 THEN 'train' WHEN h < 0.8::DOUBLE + 0.1::DOUBLE THEN 'dev' ELSE 'test' END AS shard, lang, count(*) AS n FROM h GROUP BY ALL")
def language_examples(spark, sf_dir):
    """Labelled examples of bounded length, long enough, in three shards."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "lang", X.truncate(F.col("text"), 50).alias("t")).where("length(t) >= 10")
    return B.hash_split(d, ["doc_id"], {"train": 0.8, "dev": 0.1, "test": 0.1}).groupBy("shard", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("normalized_units", "WITH c AS (SELECT unnest(string_split(lower(p_brand), '')) AS unit FROM part) SELECT unit, count(*) AS n FROM c WHERE unit <> '' GROUP BY ALL")
def normalized_units(spark, sf_dir):
    return V.character_vocabulary(table(spark, sf_dir, "part").select(F.lower("p_brand").alias("t")), "t").select("unit", "n")


@query("entity_texts", "WITH p AS (SELECT p_partkey, concat('x ', p_name, ' y') AS text, 2 AS b, 2 + length(p_name) AS e FROM part) SELECT p_partkey, p_name AS entity, p_type AS type FROM part")
def entity_texts(spark, sf_dir):
    """Entities as slices of their text, from tags over its words and the words' offsets."""
    from textloom.operators import tags as G

    w = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("x "), "p_name", F.lit(" y")).alias("text"), "p_type", F.posexplode(F.split(F.concat(F.lit("x "), "p_name", F.lit(" y")), " ")).alias("pos", "form"))
    w = w.withColumn("tag", F.when(F.col("pos") == 1, F.concat(F.lit("B-"), "p_type")).when(F.col("pos") == 2, F.concat(F.lit("E-"), "p_type")).otherwise("O"))
    o = B.running_offsets(w, ["p_partkey"], "pos", "form")
    s = G.entity_spans(w, "p_partkey", "pos")
    first, last = o.select("p_partkey", F.col("pos").alias("a"), F.col("begin").alias("from"), "text"), o.select("p_partkey", F.col("pos").alias("z"), F.col("end").alias("to"))
    j = s.withColumnRenamed("begin", "a").withColumnRenamed("end", "z").join(first, ["p_partkey", "a"]).join(last, ["p_partkey", "z"])
    return j.select("p_partkey", F.substring("text", F.col("from").cast("int") + 1, (F.col("to") - F.col("from")).cast("int")).alias("entity"), "type")
