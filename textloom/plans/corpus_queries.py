"""Queries on vocabularies, dictionaries, trees, CoNLL-U rows, packing and data-set assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import lexicon
from textloom.functions import text as X
from textloom.operators import assembly as B
from textloom.operators import conllu as C
from textloom.operators import token_patterns as K
from textloom.operators import packing as P
from textloom.operators import trees as T
from textloom.operators import ud_scores as U
from textloom.operators import vocab as V
from textloom.plans.registry import query
from textloom.session import table

# Unicode's white space, for engines whose \\s is ASCII only
WS = r"[\s\x{0B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_W = "WITH w AS (SELECT unnest(string_split(cleaned_text, ' ')) AS word FROM entries)"


def _words(spark, sf_dir):
    return table(spark, sf_dir, "entries").select(F.explode(F.split("cleaned_text", " ")).alias("word"))


@query("word_vocab", _W + ", n AS (SELECT word AS unit, count(*) AS n FROM w WHERE word <> '.' GROUP BY ALL HAVING count(*) > 1) SELECT unit, n, row_number() OVER (ORDER BY n DESC, unit) + 3 AS id FROM n")
def word_vocab(spark, sf_dir):
    return V.frequency_vocabulary(_words(spark, sf_dir), "word", cutoff=1, ignore=(".",))


@query("char_vocab", "WITH c AS (SELECT unnest(string_split(p_name || p_type, '')) AS unit FROM part), n AS (SELECT unit, count(*) AS n FROM c GROUP BY ALL) SELECT unit, n, row_number() OVER (ORDER BY n DESC, unit DESC) + 3 AS id FROM n")
def char_vocab(spark, sf_dir):
    return V.character_vocabulary(table(spark, sf_dir, "part").select(F.concat("p_name", "p_type").alias("t")), "t")


_FEATS = "concat('Brand=', p_brand, '|Type=', p_type, '|Size=', p_size)"


@query("composite_vocab", f"WITH p AS (SELECT unnest(string_split({_FEATS}, '|')) AS p FROM part) SELECT split_part(p, '=', 1) AS key, split_part(p, '=', 2) AS unit, count(*) AS n FROM p GROUP BY ALL")
def composite_vocab(spark, sf_dir):
    return V.composite_vocabulary(table(spark, sf_dir, "part").selectExpr(f"{_FEATS} AS f"), "f")


@query("token_ids", _W + ", n AS (SELECT word AS unit, count(*) AS n FROM w GROUP BY ALL HAVING count(*) > 5), v AS (SELECT unit, row_number() OVER (ORDER BY n DESC, unit) + 3 AS id FROM n) SELECT coalesce(v.id, 1) AS id, count(*) AS n FROM w LEFT JOIN v ON v.unit = w.word GROUP BY ALL")
def token_ids(spark, sf_dir):
    w = _words(spark, sf_dir)
    return V.ids_of(w, V.frequency_vocabulary(w, "word", cutoff=5), "word").groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("lexicon_p95", r"WITH w AS (SELECT DISTINCT lower(majority) AS word FROM (SELECT word AS majority FROM mostfreq) WHERE length(majority) > 1 AND regexp_matches(lower(majority), '\p{L}') AND NOT regexp_matches(majority, '\d')) SELECT word FROM w WHERE length(word) <= (SELECT floor(quantile_cont(length(word), 0.95)) FROM w)")
def lexicon_p95(spark, sf_dir):
    return V.lexicon(table(spark, sf_dir, "mostfreq"))


@query("prefix_suffix_dict", "WITH w AS (SELECT DISTINCT word FROM mostfreq WHERE length(word) > 1), i AS (SELECT word, unnest(range(1, length(word))) AS i FROM w) SELECT DISTINCT 'prefix' AS kind, substr(word, 1, i) AS affix FROM i UNION SELECT DISTINCT 'suffix', substr(word, i + 1) FROM i")
def prefix_suffix_dict(spark, sf_dir):
    return V.affixes(table(spark, sf_dir, "mostfreq").select("word").distinct())


_LEMMAS = "WITH r AS (SELECT p_type AS word, p_brand AS pos, p_name AS lemma FROM part)"
_TOP = "SELECT {k}, lemma FROM (SELECT {k}, lemma, row_number() OVER (PARTITION BY {k} ORDER BY count(*) DESC, lemma) AS i FROM r GROUP BY {k}, lemma) WHERE i = 1"


def _lemma_rows(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("p_type AS word", "p_brand AS pos", "p_name AS lemma")


@query("lemma_dict_train", f"{_LEMMAS} {_TOP.format(k='word, pos')} UNION ALL SELECT word, NULL, lemma FROM ({_TOP.format(k='word')})")
def lemma_dict_train(spark, sf_dir):
    by_pos, by_word = V.lemma_dictionaries(_lemma_rows(spark, sf_dir))
    return by_pos.unionByName(by_word.withColumn("pos", F.lit(None).cast("string")))


@query("lemma_dict_predict", f"""{_LEMMAS}, a AS ({_TOP.format(k='word, pos')}), b AS ({_TOP.format(k='word')}), q AS (SELECT word, CASE WHEN length(lemma) % 2 = 0 THEN pos ELSE 'other' END AS pos FROM r UNION ALL SELECT lemma, pos FROM r)
SELECT q.word, q.pos, coalesce(a.lemma, b.lemma, q.word) AS lemma, a.lemma IS NOT NULL OR b.lemma IS NOT NULL AS known, count(*) AS n FROM q LEFT JOIN a ON a.word = q.word AND a.pos = q.pos LEFT JOIN b ON b.word = q.word GROUP BY ALL""")
def lemma_dict_predict(spark, sf_dir):
    r = _lemma_rows(spark, sf_dir)
    q = r.selectExpr("word", "if(length(lemma) % 2 = 0, pos, 'other') AS pos").unionAll(r.selectExpr("lemma", "pos"))
    out = V.lemmatize(q, *V.lemma_dictionaries(r))
    return out.groupBy("word", "pos", "lemma", "known").agg(F.count(F.lit(1)).alias("n"))


_MWT = "SELECT split_part(p_name, ' ', 1) AS token, concat(p_brand, ' ', split_part(p_name, ' ', 2)) AS parts FROM part"


@query("mwt_dict_argmax", f"WITH r AS ({_MWT}), n AS (SELECT token, parts, count(*) AS n FROM r GROUP BY ALL) SELECT token, parts FROM n QUALIFY row_number() OVER (PARTITION BY token ORDER BY n DESC, parts) = 1")
def mwt_dict_argmax(spark, sf_dir):
    r = table(spark, sf_dir, "part").selectExpr("split_part(p_name, ' ', 1) AS token", "concat(p_brand, ' ', split_part(p_name, ' ', 2)) AS parts")
    return V.expansion_dictionary(r.groupBy("token", "parts").agg(F.count(F.lit(1)).alias("n")))


@query("mwt_expand", f"""WITH r AS ({_MWT}), n AS (SELECT token, parts, count(*) AS n FROM r GROUP BY ALL), d AS (SELECT token, parts FROM n QUALIFY row_number() OVER (PARTITION BY token ORDER BY n DESC, parts) = 1),
t AS (SELECT p_partkey AS k, CASE p_size % 3 WHEN 0 THEN split_part(p_name, ' ', 1) WHEN 1 THEN upper(split_part(p_name, ' ', 1)) ELSE p_type END AS token FROM part),
e AS (SELECT k, t.token, string_split(coalesce(d.parts, l.parts, t.token), ' ') AS p FROM t LEFT JOIN d ON d.token = t.token LEFT JOIN d l ON l.token = lower(t.token))
SELECT k, token, CAST(unnest(range(0, len(p))) AS INTEGER) AS part_no, unnest(p) AS word FROM e""")
def mwt_expand(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    t = part.selectExpr("p_partkey AS k", "CASE p_size % 3 WHEN 0 THEN split_part(p_name, ' ', 1) WHEN 1 THEN upper(split_part(p_name, ' ', 1)) ELSE p_type END AS token")
    return V.expand_tokens(t, mwt_dict_argmax(spark, sf_dir), keep=("k",))


@query("vocab_coverage", _W + ", v AS (SELECT DISTINCT lower(word) AS v FROM mostfreq WHERE word IS NOT NULL) SELECT count(*) AS words, avg((lower(word) IN (SELECT v FROM v))::INT) AS covered FROM w")
def vocab_coverage(spark, sf_dir):
    return V.coverage(_words(spark, sf_dir), table(spark, sf_dir, "mostfreq"))


@query("class_weights", "WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY ALL) SELECT lang, (SELECT max(n) FROM n) / n::DOUBLE AS weight FROM n")
def class_weights(spark, sf_dir):
    return V.class_weights(table(spark, sf_dir, "documents"), "lang")


# --- columns of k=v parts, spacing, offsets ---
@query("misc_to_map", f"SELECT split_part({_FEATS}, '|', 1)[7:] AS brand, count(*) AS n FROM part GROUP BY ALL")
def misc_to_map(spark, sf_dir):
    return table(spark, sf_dir, "part").select(X.key_values(F.expr(_FEATS))["Brand"].alias("brand")).groupBy("brand").agg(F.count(F.lit(1)).alias("n"))


# an order's lines as a sentence: forms are brands of sizes, every third word is followed by no space
_SENT = "FROM (SELECT l_orderkey AS sent, l_linenumber AS pos, concat('p', min(l_partkey % 97)) AS form FROM lineitem GROUP BY l_orderkey, l_linenumber)"


def _conllu(spark, sf_dir):
    """The same sentences as CoNLL-U text: heads point to the word before, misc marks the spaces."""
    w = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sent"), F.col("l_linenumber").alias("pos")).agg(F.concat(F.lit("p"), F.min(F.col("l_partkey") % 97)).alias("form"))
    g = w.groupBy("sent").agg(F.array_sort(F.collect_list(F.struct("pos", "form"))).alias("w"))
    line = "concat_ws('\\t', i + 1, x.form, upper(x.form), if(length(x.form) = 2, 'NOUN', 'VERB'), '_', concat('Number=', length(x.form)), i, if(i = 0, 'root', 'dep:x'), '_', if(x.pos % 3 = 0, 'SpaceAfter=No', '_'))"
    return g.select("sent", F.array_join(F.expr(f"transform(w, (x, i) -> {line})"), "\n").alias("value"))


@query("conllu_words", f"SELECT sent, CAST(row_number() OVER s AS INTEGER) AS id_start, form, upper(form) AS lemma, CASE length(form) WHEN 2 THEN 'NOUN' ELSE 'VERB' END AS upos, CAST(row_number() OVER s - 1 AS INTEGER) AS head, CASE WHEN pos % 3 = 0 THEN 'SpaceAfter=No' END AS misc {_SENT} WINDOW s AS (PARTITION BY sent ORDER BY pos)")
def conllu_words(spark, sf_dir):
    return C.words(_conllu(spark, sf_dir)).select("sent", "id_start", "form", "lemma", "upos", "head", "misc")


@query("space_after_detok", f"SELECT sent, rtrim(string_agg(form || CASE WHEN pos % 3 = 0 THEN '' ELSE ' ' END, '' ORDER BY pos)) AS text {_SENT} GROUP BY sent")
def space_after_detok(spark, sf_dir):
    return C.detokenized(C.words(_conllu(spark, sf_dir)), ["sent"])


_NUMBERED = f"WITH w AS (SELECT sent, pos, form, row_number() OVER (PARTITION BY sent ORDER BY pos) AS i, CASE length(form) WHEN 2 THEN 'NOUN' ELSE 'VERB' END AS upos {_SENT})"


@query("conllu_render", _NUMBERED + " SELECT sent, string_agg(concat_ws(chr(9), i, form, upper(form), upos, '_', concat('Number=', length(form)), i - 1, CASE WHEN i = 1 THEN 'root' ELSE 'dep:x' END, '_', CASE WHEN pos % 3 = 0 THEN 'SpaceAfter=No' ELSE '_' END), chr(10) ORDER BY i) AS value FROM w GROUP BY sent")
def conllu_render(spark, sf_dir):
    return C.render(C.words(_conllu(spark, sf_dir)), ["sent"])


@query("conllu_spans", f'SELECT sent, CAST(row_number() OVER s AS INTEGER) AS id_start, CAST(sum(length(form)) OVER s - length(form) AS BIGINT) AS "begin", CAST(sum(length(form)) OVER s AS BIGINT) AS "end" {_SENT} WINDOW s AS (PARTITION BY sent ORDER BY pos)')
def conllu_spans(spark, sf_dir):
    return C.spans(C.words(_conllu(spark, sf_dir)), ["sent"]).select("sent", "id_start", "begin", "end")


@query("conllu_problems", _NUMBERED + ", s AS (SELECT sent, bool_or(form = 'p7') AS hit, arg_max(form, i) = 'p7' AS last FROM w GROUP BY sent) SELECT sent, CASE WHEN last THEN 'head outside' ELSE 'cycle' END AS problem FROM s WHERE hit")
def conllu_problems(spark, sf_dir):
    w = C.words(_conllu(spark, sf_dir))
    # every word with the form p7 points ahead of itself: to the word after, or out of the sentence
    return C.problems(w.withColumn("head", F.when(F.col("form") == "p7", F.col("id_start") + 1).otherwise(F.col("head"))), ["sent"])


def _scored(spark, sf_dir):
    g = C.words(_conllu(spark, sf_dir))
    s = g.withColumn("head", F.when(F.col("form").endswith("3"), 0).otherwise(F.col("head"))).withColumn("upos", F.when(F.col("form").endswith("5"), "ADJ").otherwise(F.col("upos"))).withColumn("deprel", F.when(F.col("form").endswith("7"), "root").otherwise(F.col("deprel")))
    return U.scores(g, s, ["sent"])


@query("uas_las", f"""WITH w AS (SELECT form, row_number() OVER (PARTITION BY sent ORDER BY pos) AS i {_SENT}), f AS (SELECT count(*) AS n, count(*) FILTER (NOT (form LIKE '%5')) AS upos,
  count(*) FILTER (i = 1 OR NOT form LIKE '%3') AS uas, count(*) FILTER ((i = 1 OR NOT form LIKE '%3') AND (i = 1 OR NOT form LIKE '%7')) AS las FROM w)
SELECT metric, correct, n AS gold_total, n AS system_total, correct / n::DOUBLE AS f1 FROM (SELECT n, unnest(['Words', 'UPOS', 'UAS', 'LAS']) AS metric, unnest([n, upos, uas, las]) AS correct FROM f)""")
def uas_las(spark, sf_dir):
    return _scored(spark, sf_dir).where("metric in ('Words', 'UPOS', 'UAS', 'LAS')").select("metric", "correct", "gold_total", "system_total", "f1")


@query("ud_metrics", f"""WITH w AS (SELECT sent, form, row_number() OVER (PARTITION BY sent ORDER BY pos) AS i {_SENT}), t AS (SELECT *, NOT form LIKE '%5' AS u, i = 1 OR NOT form LIKE '%3' AS a, i = 1 OR NOT form LIKE '%7' AS r FROM w),
f AS (SELECT count(*) AS n, count(DISTINCT sent) AS s, count(*) FILTER (u) AS u, count(*) FILTER (a) AS a, count(*) FILTER (a AND r) AS l, count(*) FILTER (a AND r AND u) AS m FROM t),
x AS (SELECT unnest(['Tokens', 'Sentences', 'Words', 'UPOS', 'XPOS', 'UFeats', 'AllTags', 'Lemmas', 'UAS', 'LAS', 'CLAS', 'MLAS', 'BLEX']) AS metric, unnest([n, s, n, u, n, n, u, n, a, l, l, m, l]) AS correct, unnest([n, s, n, n, n, n, n, n, n, n, n, n, n]) AS total FROM f)
SELECT metric, correct, total AS gold_total, total AS system_total, correct / total::DOUBLE AS precision, correct / total::DOUBLE AS recall, correct / total::DOUBLE AS f1 FROM x""")
def ud_metrics(spark, sf_dir):
    return _scored(spark, sf_dir)


@query("span_f1", f"""WITH w AS (SELECT sent, form, sum(length(form)) OVER (PARTITION BY sent ORDER BY pos) AS e, length(form) AS n {_SENT}),
g AS (SELECT sent, e - n AS b, e FROM w), s AS (SELECT sent, e - n + (form LIKE '%9')::INT AS b, e FROM w), x AS (SELECT count(*) AS c FROM g JOIN s USING (sent, b, e))
SELECT c AS correct, (SELECT count(*) FROM g) AS gold_total, (SELECT count(*) FROM s) AS system_total, c / (SELECT count(*) FROM g)::DOUBLE AS precision, c / (SELECT count(*) FROM g)::DOUBLE AS recall, c / (SELECT count(*) FROM g)::DOUBLE AS f1 FROM x""")
def span_f1(spark, sf_dir):
    g = C.spans(C.words(_conllu(spark, sf_dir)), ["sent"])
    return U.span_scores(g, g.withColumn("begin", F.col("begin") + F.col("form").endswith("9").cast("int")), ["sent"])


@query("running_offsets", f'SELECT sent, pos, CAST(coalesce(sum(length(form) + 1) OVER (PARTITION BY sent ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "begin", form {_SENT}')
def running_offsets(spark, sf_dir):
    w = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sent"), F.col("l_linenumber").alias("pos")).agg(F.concat(F.lit("p"), F.min(F.col("l_partkey") % 97)).alias("form"))
    return B.running_offsets(w, ["sent"], "pos", "form").select("sent", "pos", "begin", "form")


# --- trees over part names ---
_TREE = "concat('(S (NP-SBJ (JJ ', split_part(p_name, ' ', 1), ') (NN ', split_part(p_name, ' ', 2), ')) ', CASE WHEN p_size % 2 = 0 THEN concat('(VP (VB ', p_type, ') (PP=2 (IN of) (NP (NN ', p_size, '))))') ELSE concat('(VB ', p_type, ')') END, ')')"


def _trees(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS tree_id", f"{_TREE} AS tree")


@query("tree_depth", "SELECT p_partkey AS tree_id, CASE WHEN p_size % 2 = 0 THEN 5 ELSE 3 END AS depth FROM part")
def tree_depth(spark, sf_dir):
    return _trees(spark, sf_dir).select("tree_id", T.depth(F.col("tree")).alias("depth"))


@query("tree_leaves", "SELECT p_partkey AS tree_id, concat_ws(' ', p_name, p_type, CASE WHEN p_size % 2 = 0 THEN concat('of ', p_size) END) AS leaves FROM part")
def tree_leaves(spark, sf_dir):
    return _trees(spark, sf_dir).select("tree_id", F.array_join(T.leaves(F.col("tree")), " ").alias("leaves"))


@query("tree_labels", "SELECT unnest(['S', 'NP', 'VP', 'PP']) AS label")
def tree_labels(spark, sf_dir):
    return T.distinct_values(_trees(spark, sf_dir), T.constituents(T.simplified(F.col("tree"))), "label")


@query("tree_tags", "SELECT unnest(['JJ', 'NN', 'VB', 'IN']) AS tag")
def tree_tags(spark, sf_dir):
    return T.distinct_values(_trees(spark, sf_dir), T.tags(F.col("tree")), "tag")


@query("tree_nodes", "SELECT depth, label, count(*) AS n FROM (SELECT unnest([0, 1, 2, 2, 1]) AS depth, unnest(['S', 'NP-SBJ', 'JJ', 'NN', CASE WHEN p_size % 2 = 0 THEN 'VP' ELSE 'VB' END]) AS label FROM part UNION ALL SELECT unnest([2, 2, 3, 3, 4]), unnest(['VB', 'PP=2', 'IN', 'NP', 'NN']) FROM part WHERE p_size % 2 = 0) GROUP BY ALL")
def tree_nodes(spark, sf_dir):
    return T.node_table(_trees(spark, sf_dir)).where("not leaf").groupBy("depth", "label").agg(F.count(F.lit(1)).alias("n"))


@query("tree_rare_words", "WITH n AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split(concat_ws(' ', p_name, p_type, CASE WHEN p_size % 2 = 0 THEN concat('of ', p_size) END), ' ')) AS word FROM part) GROUP BY ALL) SELECT word, n FROM n ORDER BY n, word LIMIT (SELECT greatest(1, floor(count(*) * 0.05))::BIGINT FROM n)")
def tree_rare_words(spark, sf_dir):
    return T.rare_words(_trees(spark, sf_dir))


# --- assembly ---
@query("treebank_union", "SELECT source, count(*) AS n FROM (SELECT 'a' AS source FROM part UNION ALL SELECT 'b' FROM part WHERE p_size > 20) GROUP BY ALL")
def treebank_union(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return B.union({"a": p.select("p_name"), "b": p.where("p_size > 20").select("p_name")}).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("set_overlap", "SELECT DISTINCT word FROM mostfreq WHERE word IN (SELECT lower(cleaned) FROM (SELECT unnest(string_split(cleaned_text, ' ')) AS cleaned FROM entries))")
def set_overlap(spark, sf_dir):
    return B.overlap(table(spark, sf_dir, "mostfreq"), _words(spark, sf_dir).select(F.lower("word").alias("word")), "word")


@query("members_with_repeats", "SELECT word, count(*) AS n FROM mostfreq WHERE word IN (SELECT word FROM mostfreq WHERE total_count > 3) GROUP BY ALL")
def members_with_repeats(spark, sf_dir):
    m = table(spark, sf_dir, "mostfreq")
    return B.members(m.select("word"), m.where("total_count > 3"), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("fraction_split", "WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS i, count(*) OVER () AS n FROM part) SELECT p_partkey, CASE WHEN i < floor(0.7 * n) THEN 'train' WHEN i < floor((0.7 + 0.15) * n) THEN 'dev' ELSE 'test' END AS shard FROM r")
def fraction_split(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return B.exact_split(p, [F.asc("p_name"), F.asc("p_partkey")], {"train": 0.7, "dev": 0.15, "test": 0.15}).select("p_partkey", "shard")


@query("seeded_split", "WITH h AS (SELECT doc_id, ('0x' || substr(md5(concat(doc_id, '|1234')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS h FROM documents) SELECT doc_id, CASE WHEN h < 0.8 THEN 'train' WHEN h < 0.8::DOUBLE + 0.1::DOUBLE THEN 'dev' ELSE 'test' END AS shard FROM h")
def seeded_split(spark, sf_dir):
    return B.hash_split(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], {"train": 0.8, "dev": 0.1, "test": 0.1})


@query("masked_share", f"SELECT sent % 7 AS treebank, count(*) AS words, avg((form IN ('p7', '_'))::INT) AS blank_share {_SENT} GROUP BY ALL")
def masked_share(spark, sf_dir):
    w = C.words(_conllu(spark, sf_dir)).select((F.col("sent") % 7).alias("treebank"), F.when(F.col("form") == "p7", "_").otherwise(F.col("form")).alias("form"))
    return B.blank_share(w)


@query("packed_windows", f"""WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(text, '{WS}', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, list_reduce(w, lambda a, x: CASE WHEN length(a.cur) > 0 AND length(a.cur) + length(x) + 1 > 50 THEN {{'done': list_append(a.done, a.cur), 'cur': x}} ELSE {{'done': a.done, 'cur': ltrim(a.cur || ' ' || x)}} END, {{'done': []::VARCHAR[], 'cur': ''}}) AS r FROM w),
f AS (SELECT doc_id, list_filter(list_transform(list_append(r.done, r.cur), lambda x: trim(x)), lambda x: length(x) >= 10) AS f FROM r)
SELECT doc_id, CAST(unnest(range(len(f))) AS INTEGER) AS no, unnest(f) AS window FROM f""")
def packed_windows(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(P.windows(X.squash(F.col("text")))).alias("no", "window"))


@query("packed_batches", """WITH d AS (SELECT source, doc_id, CAST(length(text) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL), g AS (SELECT source, CAST(ceil(count(*) / 20000.0) AS BIGINT) AS parts FROM d GROUP BY source),
p AS (SELECT d.*, CAST(('0x' || substr(md5(concat(doc_id, '|0')), 1, 8))::BIGINT % parts AS INTEGER) AS part FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
l AS (SELECT source, part, list(doc_id ORDER BY n DESC, doc_id) AS ids, list(n ORDER BY n DESC, doc_id) AS ns FROM p GROUP BY ALL),
r AS (SELECT source, part, ids, list_reduce(ns, lambda a, x: {'out': list_append(a.out, a.cur + (a.open AND (x > 8000 OR a.size + x > 8000))::INT), 'cur': a.cur + (a.open AND (x > 8000 OR a.size + x > 8000))::INT + (x > 8000)::INT,
  'size': CASE WHEN x > 8000 THEN 0 WHEN a.open AND a.size + x > 8000 THEN x ELSE a.size + x END, 'open': x <= 8000}, {'out': []::INTEGER[], 'cur': 0, 'size': 0::BIGINT, 'open': false}).out AS b FROM l)
SELECT source, part, unnest(ids) AS doc_id, CAST(unnest(b) AS INTEGER) AS batch FROM r""")
def packed_batches(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select("source", "doc_id", F.length("text").cast("bigint").alias("n"))
    return P.length_sorted_batches(d, "source", "doc_id", "n", 8000, 8000)


_CLEANED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'https?://t\.co/[a-zA-Z0-9]+', ' ', 'g'), '@[a-zA-Z0-9_]+', ' ', 'g'), '#[a-zA-Z]+', ' ', 'g'), '[!.]+', ' ', 'g'), '[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B50}\x{2B55}\x{FE0F}\x{200D}]', ' ', 'g')"


@query("langid_clean", f"WITH c AS (SELECT doc_id, {_CLEANED} AS c FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN regexp_replace(c, '{WS}', '', 'g') = '' THEN c ELSE regexp_replace(c, '^{WS}|{WS}$', '', 'g') END AS clean FROM c")
def langid_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", X.langid_clean(F.col("text")).alias("clean"))


@query("tweet_clean", f"""WITH t AS (SELECT id, list_filter(string_split_regex(body, '{WS}'), lambda w: w <> '') AS t FROM entries WHERE body IS NOT NULL),
d AS (SELECT id, t, CASE WHEN len(t) > 3 AND t[1] = 'RT' AND t[2] LIKE '@%' AND t[3] = ':' THEN 3 WHEN len(t) > 4 AND t[1] = 'RT' AND t[2] = '@' AND t[4] = ':' THEN 4 WHEN coalesce(t[1], '') LIKE '@%' THEN 1 ELSE 0 END AS d FROM t)
SELECT id, coalesce(array_to_string(list_transform(list_transform(t[d + 1 :], lambda w: regexp_replace(w, '^[@#]', '')), lambda w: CASE WHEN regexp_matches(w, '^https?:') THEN ' ' ELSE w END), ' '), '') AS tweet FROM d""")
def tweet_clean(spark, sf_dir):
    return table(spark, sf_dir, "entries").where("body is not null").select("id", F.array_join(X.tweet_tokens(X.words(F.col("body"))), " ").alias("tweet"))


def _cleaned_sql(c: str, steps) -> str:
    for pattern, into in steps:
        c = f"regexp_replace({c}, '{pattern.replace(chr(39), chr(39) * 2)}', '{into.replace('$1', chr(92) + '1').replace(chr(39), chr(39) * 2)}', 'g')"
    return f"trim(regexp_replace({c}, '{WS}', ' ', 'g'))"


@query("clean_text", f"SELECT doc_id, {_cleaned_sql('lower(text)', lexicon.CLEAN_PIPELINE)} AS clean FROM documents")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.clean(F.lower("text")).alias("clean"))


@query("sentence_split", r"SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(text, '([.!?])[\s\x{0B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', E'\\1\x01', 'g'), E'\x01'), lambda s: trim(s) <> '')) AS INTEGER) AS sentences FROM documents WHERE text IS NOT NULL")
def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(X.sentences(F.col("text"))).alias("sentences"))


_POS = f"WITH w AS (SELECT sent, row_number() OVER (PARTITION BY sent ORDER BY pos) AS i, form, CASE length(form) WHEN 2 THEN 'NOUN' ELSE 'VERB' END AS upos {_SENT})"


@query("graph_pattern", _POS + " SELECT a.sent, CAST(a.i AS INTEGER) AS noun, CAST(b.i AS INTEGER) AS verb FROM w a JOIN w b ON a.sent = b.sent AND b.i = a.i + 1 WHERE a.upos = 'NOUN' AND b.upos = 'VERB' AND regexp_full_match(b.form, 'p[1-5].')")
def graph_pattern(spark, sf_dir):
    w = C.words(_conllu(spark, sf_dir)).withColumnRenamed("id_start", "id")
    return K.match_graph(w, ["sent"], "{upos:NOUN}=noun >dep:x {upos:VERB;form:/p[1-5]./}=verb")


@query("token_runs", _POS + """, l AS (SELECT sent, string_agg('<' || form || '|' || upos || '>', '' ORDER BY i) AS l FROM w GROUP BY sent), r AS (SELECT sent, unnest(regexp_extract_all(l, '(?:<[^|<>]*\\|NOUN>)(?:<[^|<>]*\\|VERB>)+')) AS r FROM l)
SELECT sent, array_to_string(list_transform(list_filter(string_split_regex(r, '[<>]'), lambda x: x <> ''), lambda x: split_part(x, '|', 1)), ' ') AS run FROM r""")
def token_runs(spark, sf_dir):
    g = C.words(_conllu(spark, sf_dir)).groupBy("sent").agg(F.array_sort(F.collect_list(F.struct("id_start", F.col("form").alias("text"), "upos"))).alias("t"))
    return g.select("sent", F.explode(K.match_runs(F.col("t"), "{upos:NOUN} {upos:VERB}+", ["text", "upos"])).alias("run"))


@query("label_counts", "SELECT lang AS label, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY ALL")
def label_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("lang is not null").groupBy(F.col("lang").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("sentence_length_mean", "SELECT avg(n) AS mean_words, CAST(max(n) AS BIGINT) AS longest FROM (SELECT len(list_filter(string_split(cleaned_text, ' '), lambda w: w <> '')) AS n FROM entries WHERE cleaned_text IS NOT NULL)")
def sentence_length_mean(spark, sf_dir):
    n = table(spark, sf_dir, "entries").where("cleaned_text is not null").select(F.size(F.filter(F.split("cleaned_text", " "), lambda w: w != "")).alias("n"))
    return n.agg(F.avg("n").alias("mean_words"), F.max("n").cast("bigint").alias("longest"))
