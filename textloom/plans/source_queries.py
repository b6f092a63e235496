"""Readers and writers at work: a table is written in a format and read back, and the twin reads the table itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import assembly as B
from textloom.operators import conllu as C
from textloom.operators import trees as T
from textloom.plans.corpus_queries import _SENT, _TREE, _conllu
from textloom.plans.registry import query
from textloom.session import scratch, table
from textloom.sources import corpora as K
from textloom.sources import files as S
from textloom.sources import segmented as G


def _text(spark, df, name: str, *, blocks: bool = False) -> str:
    """The column ``value`` of ``df`` as text files; the path."""
    path = scratch(spark, name)
    S.write_blocks(df, path) if blocks else df.select("value").write.text(path)
    return path


# --- JSON, CSV, lines ---
@query("ndjson_scan", "SELECT type AS kind, count(*) AS n, CAST(sum(score) AS BIGINT) AS score, CAST(sum(length(body)) AS BIGINT) AS chars FROM entries GROUP BY ALL UNION ALL SELECT 'corrupt', count(*), NULL, CAST(sum(length('{\"id\": \"' || id)) AS BIGINT) FROM entries WHERE id IS NOT NULL AND score % 10 = 0")
def ndjson_scan(spark, sf_dir):
    e, path = table(spark, sf_dir, "entries"), scratch(spark, "ndjson")
    S.write_ndjson(e.select("type", "id", "score", "body"), path)
    e.where("id is not null and score % 10 = 0").select(F.concat(F.lit('{"id": "'), "id").alias("value")).write.mode("append").text(path)
    good, bad = S.read_ndjson(spark, path)
    g = good.groupBy(F.col("type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"), F.sum(F.length("body")).cast("bigint").alias("chars"))
    return g.unionByName(bad.agg(F.lit("corrupt").alias("kind"), F.count(F.lit(1)).alias("n"), F.lit(None).cast("bigint").alias("score"), F.sum(F.length("_corrupt")).cast("bigint").alias("chars")))


@query("ndjson_append", "SELECT type, author, count(*) AS n FROM entries GROUP BY ALL")
def ndjson_append(spark, sf_dir):
    e, path = table(spark, sf_dir, "entries").select("type", "id", "author"), scratch(spark, "append")
    for kind in ("submission", "comment"):
        S.write_ndjson(e.where(F.col("type") == kind), path)
    S.write_ndjson(e.where("type is null"), path)
    return S.read_ndjson(spark, path)[0].groupBy("type", "author").agg(F.count(F.lit(1)).alias("n"))


@query("summary_sink", "SELECT majority_upos, count(*) AS n, CAST(sum(total_count) AS BIGINT) AS total, CAST(sum(list_sum(map_values(model_freqs))) AS BIGINT) AS freqs FROM mostfreq GROUP BY ALL")
def summary_sink(spark, sf_dir):
    path = scratch(spark, "summary")
    S.write_ndjson(table(spark, sf_dir, "mostfreq").drop("chunk_id"), path)
    freqs = F.aggregate(F.map_values("model_freqs"), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return S.read_ndjson(spark, path, S.SUMMARY)[0].groupBy("majority_upos").agg(F.count(F.lit(1)).alias("n"), F.sum("total_count").alias("total"), F.sum(F.when(F.size("model_freqs") > 0, freqs)).alias("freqs"))


@query("breakdown_sink", "WITH c AS (SELECT word, unnest(map_entries(counts)) AS e FROM allposbreakdown) SELECT e.key AS upos, count(*) AS words, CAST(sum(e.value) AS BIGINT) AS n FROM c GROUP BY ALL")
def breakdown_sink(spark, sf_dir):
    path = scratch(spark, "breakdown")
    S.write_ndjson(table(spark, sf_dir, "allposbreakdown").drop("chunk_id"), path)
    c = S.read_ndjson(spark, path, S.BREAKDOWN)[0].select(F.explode("counts").alias("upos", "v"))
    return c.groupBy("upos").agg(F.count(F.lit(1)).alias("words"), F.sum("v").alias("n"))


@query("matches_sink", "WITH c AS (SELECT model, unnest(map_entries(matches)) AS e FROM match_log) SELECT model, e.key AS surface, CAST(sum(e.value) AS BIGINT) AS n FROM c GROUP BY ALL")
def matches_sink(spark, sf_dir):
    path = scratch(spark, "matches")
    S.write_pretty(table(spark, sf_dir, "match_log").select("model", "matches"), path)
    return S.read_pretty(spark, path, S.MATCHES).select("model", F.explode("matches").alias("surface", "v")).groupBy("model", "surface").agg(F.sum("v").alias("n"))


@query("pretty_json", "SELECT p_partkey, p_name, p_size FROM part")
def pretty_json(spark, sf_dir):
    path = scratch(spark, "pretty")
    S.write_pretty(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), path)
    return S.read_pretty(spark, path, "p_partkey bigint, p_name string, p_size int")


@query("fan_out_files", "SELECT replace(replace(o_orderpriority, '-', '_'), '.', '_') AS folder, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS customers FROM orders GROUP BY ALL")
def fan_out_files(spark, sf_dir):
    path = scratch(spark, "fan-out")
    S.write_by_value(table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority"), path, "o_orderpriority")
    return spark.read.schema("o_custkey bigint, o_orderpriority_slug string").json(path).groupBy(F.col("o_orderpriority_slug").alias("folder")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("customers"))


@query("pos_lists_saved", "SELECT DISTINCT majority_upos AS folder, word FROM mostfreq WHERE word IS NOT NULL AND majority_upos IN ('ADJ', 'VERB')")
def pos_lists_saved(spark, sf_dir):
    path = scratch(spark, "pos")
    m = table(spark, sf_dir, "mostfreq").where("word is not null and majority_upos in ('ADJ', 'VERB')").select("word", "majority_upos").distinct()
    S.write_by_value(m, path, "majority_upos")
    return spark.read.schema("word string, majority_upos_slug string").json(path).select(F.col("majority_upos_slug").alias("folder"), "word")


@query("csv_sink", "SELECT p_partkey, p_name, p_brand FROM part")
def csv_sink(spark, sf_dir):
    path = scratch(spark, "csv")
    S.write_csv(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), path)
    return spark.read.option("header", True).schema("p_partkey bigint, p_name string, p_brand string").csv(path)


@query("lines_sink", "SELECT DISTINCT p_name AS value FROM part WHERE p_name IS NOT NULL")
def lines_sink(spark, sf_dir):
    path = scratch(spark, "lines")
    S.write_lines(table(spark, sf_dir, "part"), path, "p_name")
    return spark.read.text(path)


@query("id_checkpoint", "SELECT DISTINCT trim(id) AS id FROM processed_ids WHERE id IS NOT NULL AND trim(id) <> ''")
def id_checkpoint(spark, sf_dir):
    ids = table(spark, sf_dir, "processed_ids").where("id is not null").select(F.col("id").alias("value"))
    return S.read_ids(spark, _text(spark, ids, "ids"))


@query("results_sink", "SELECT CASE WHEN score % 3 = 0 THEN 'skipped' ELSE 'out' END AS place, count(*) AS n FROM entries WHERE score IS NOT NULL GROUP BY ALL UNION ALL SELECT 'ids', count(*) FROM entries WHERE score % 3 <> 0 AND id IS NOT NULL")
def results_sink(spark, sf_dir):
    out, skipped, ids = (scratch(spark, n) for n in ("out", "skipped", "ids"))
    e = table(spark, sf_dir, "entries").where("score is not null").select("id", "score", F.expr("if(score % 3 = 0, null, struct(score AS num_words))").alias("dependency_parse"))
    S.write_results(e, out, skipped, ids)
    n = lambda df, name: df.agg(F.lit(name).alias("place"), F.count(F.lit(1)).alias("n"))
    return n(spark.read.schema("id string").json(out), "out").unionByName(n(spark.read.schema("id string").json(skipped), "skipped")).unionByName(n(spark.read.text(ids), "ids"))


# --- CoNLL-U files ---
_UPOS = f"WITH w AS (SELECT sent, row_number() OVER (PARTITION BY sent ORDER BY pos) AS i, form, CASE length(form) WHEN 2 THEN 'NOUN' ELSE 'VERB' END AS upos {_SENT})"


@query("conllu_files", _UPOS + " SELECT sent % 2 AS half, upos, count(*) AS n FROM w GROUP BY ALL")
def conllu_files(spark, sf_dir):
    """Two folders written and read together."""
    c = _conllu(spark, sf_dir)
    paths = [_text(spark, c.where(F.col("sent") % 2 == k).select(F.concat(F.lit(f"# half = {k}\n"), "value").alias("value")), f"half{k}", blocks=True) for k in (0, 1)]
    b = S.read_blocks(spark, paths).select(F.get(C.comments(F.col("value")), F.lit(0)).alias("c"), "value")
    return C.words(b).groupBy(F.regexp_extract("c", r"(\d)$", 1).cast("bigint").alias("half"), "upos").agg(F.count(F.lit(1)).alias("n"))


@query("conllu_file_text", "SELECT sent, rtrim(string_agg(form || CASE WHEN pos % 3 = 0 THEN '' ELSE ' ' END, '' ORDER BY pos)) AS text " + _SENT + " GROUP BY sent")
def conllu_file_text(spark, sf_dir):
    c = _conllu(spark, sf_dir).select(F.concat(F.lit("# sent_id = "), F.col("sent").cast("string"), F.lit("\n"), "value").alias("value"))
    b = S.read_blocks(spark, _text(spark, c, "conllu", blocks=True)).select(F.regexp_extract("value", r"^# sent_id = (\d+)", 1).cast("bigint").alias("sent"), "value")
    return C.detokenized(C.words(b), ["sent"])


@query("segmenter_lines", "SELECT sent, string_agg(form, ' ' ORDER BY pos) AS value " + _SENT + " GROUP BY sent")
def segmenter_lines(spark, sf_dir):
    return K.plain_sentences(C.words(_conllu(spark, sf_dir)), ["sent"])


@query("corpus_shards", "WITH h AS (SELECT p_partkey, CAST(('0x' || substr(md5(concat(p_partkey, ' ', p_name, '|1234')), 1, 8))::BIGINT % 10 AS INTEGER) AS k FROM part) SELECT p_partkey, k AS part, CASE WHEN k = 0 THEN 'dev' WHEN k = 1 THEN 'test' ELSE 'train' END AS shard FROM h")
def corpus_shards(spark, sf_dir):
    lines = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", F.col("p_partkey").cast("string"), "p_name").alias("value"))
    return K.model_corpus(lines, 10).select("p_partkey", "part", "shard")


# --- entity files: five parts in a row are a sentence ---
_TOK = "SELECT p_partkey // 5 AS sent, CAST(p_partkey % 5 AS INTEGER) AS pos, replace(p_name, ' ', '_') AS token, CASE p_size % 3 WHEN 0 THEN 'O' WHEN 1 THEN 'B-LOC' ELSE 'I-LOC' END AS tag, p_size FROM part"
_COUNTS = f"WITH t AS ({_TOK}) SELECT pos, token, tag, count(*) AS n FROM t GROUP BY ALL"


def _tokens(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("p_partkey div 5 AS sent", "int(p_partkey % 5) AS pos", "replace(p_name, ' ', '_') AS token", "CASE p_size % 3 WHEN 0 THEN 'O' WHEN 1 THEN 'B-LOC' ELSE 'I-LOC' END AS tag", "p_size")


def _as_blocks(spark, sf_dir, line: str):
    """Sentences as blocks, each token by the SQL expression ``line`` over x.token, x.tag, x.pos, x.p_size."""
    g = _tokens(spark, sf_dir).groupBy("sent").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "tag", "p_size"))).alias("t"))
    return g.select("sent", F.array_join(F.expr(f"transform(t, x -> {line})"), "\n").alias("value"))


def _counted(df):
    return df.groupBy("pos", "token", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("tagged_file", _COUNTS)
def tagged_file(spark, sf_dir):
    b = _as_blocks(spark, sf_dir, "concat_ws(' ', x.token, '_', x.tag)")
    b = b.withColumn("value", F.when(F.col("sent") % 10 == 0, F.concat(F.lit("-DOCSTART- X O\n\n"), "value")).otherwise(F.col("value")))
    return _counted(S.read_tagged(spark, _text(spark, b, "tagged", blocks=True)))


@query("ner_json", f"WITH t AS ({_TOK}) SELECT sent, '[' || string_agg('{{\"text\":\"' || token || '\",\"ner\":\"' || tag || '\"}}', ',' ORDER BY pos) || ']' AS value FROM t GROUP BY sent")
def ner_json(spark, sf_dir):
    return S.to_ner_json(_tokens(spark, sf_dir))


@query("ner_shards", f"WITH t AS ({_TOK}), j AS (SELECT sent, count(*) AS tokens FROM t GROUP BY sent) SELECT CASE WHEN h < 0.8 THEN 'train' WHEN h < 0.9 THEN 'dev' ELSE 'test' END AS shard, count(*) AS sentences, CAST(sum(tokens) AS BIGINT) AS tokens FROM (SELECT *, ('0x' || substr(md5(concat(sent, '|1234')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS h FROM j) GROUP BY ALL")
def ner_shards(spark, sf_dir):
    """Tagged sentences as JSON in three folders, one for each shard, read back."""
    path = scratch(spark, "shards")
    j = B.hash_split(S.to_ner_json(_tokens(spark, sf_dir)), ["sent"], {"train": 0.8, "dev": 0.1, "test": 0.1})
    j.select("value", "shard").write.partitionBy("shard").text(path)
    n = F.size(F.from_json("value", "array<struct<text:string,ner:string>>"))
    return spark.read.text(path).groupBy("shard").agg(F.count(F.lit(1)).alias("sentences"), F.sum(n).alias("tokens"))


@query("two_column_file", f"WITH t AS ({_TOK}), s AS (SELECT sent, count(*) AS n, bool_or(p_size % 7 = 0) AS bad FROM t GROUP BY sent) SELECT count(*) AS sentences, CAST(sum(n) AS BIGINT) AS tokens FROM s WHERE NOT bad")
def two_column_file(spark, sf_dir):
    b = _as_blocks(spark, sf_dir, "concat(x.token, '\\t', x.tag, if(x.p_size % 7 = 0, '\\textra', ''))")
    r = S.read_two_columns(spark, _text(spark, b, "two", blocks=True))
    return r.agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.size(F.split("value", "\n"))).alias("tokens"))


@query("standoff_file", "SELECT concat('T', p_partkey) AS ident, p_type AS type, CAST(p_size AS INTEGER) AS \"begin\", CAST(p_size + length(p_name) AS INTEGER) AS \"end\", p_name AS text FROM part WHERE p_size % 4 <> 0")
def standoff_file(spark, sf_dir):
    line = "if(p_size % 4 = 0, concat('#', p_partkey, ' note'), concat('T', p_partkey, '\\t', p_type, ' ', p_size, ' ', p_size + length(p_name), '\\t', p_name)) AS value"
    return S.read_standoff(spark, _text(spark, table(spark, sf_dir, "part").selectExpr(line), "standoff")).drop("file")


@query("standoff_tags", "WITH p AS (SELECT p_type AS type, string_split(p_name, ' ') AS w FROM part), t AS (SELECT type, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i, len(w) AS n FROM p) SELECT word, CASE WHEN n = 1 THEN 'S-' WHEN i = 1 THEN 'B-' WHEN i = n THEN 'E-' ELSE 'I-' END || type AS beios, CASE WHEN i = 1 THEN 'B-' ELSE 'I-' END || type AS iob, count(*) AS n FROM t GROUP BY ALL")
def standoff_tags(spark, sf_dir):
    from textloom.operators import tags as G2

    both = F.arrays_zip(G2.bsf_tags(F.col("p_name"), F.col("p_type")).alias("a"), G2.bsf_tags(F.col("p_name"), F.col("p_type"), "iob").alias("b"))
    r = table(spark, sf_dir, "part").select(F.explode(both).alias("x")).select(F.col("x.a.word").alias("word"), F.col("x.a.tag").alias("beios"), F.col("x.b.tag").alias("iob"))
    return r.groupBy("word", "beios", "iob").agg(F.count(F.lit(1)).alias("n"))


@query("six_column_file", _COUNTS)
def six_column_file(spark, sf_dir):
    b = _as_blocks(spark, sf_dir, "concat_ws('\\t', x.token, '1', '2', '3', if(x.tag = 'O', 'o', x.tag), 'o')")
    return _counted(K.read_six_columns(spark, _text(spark, b, "six", blocks=True)))


@query("two_piece_file", _COUNTS)
def two_piece_file(spark, sf_dir):
    b = _as_blocks(spark, sf_dir, "concat(x.token, '\\t', if(x.tag = 'O', '0', x.tag))")
    return _counted(K.read_two_pieces(spark, _text(spark, b, "pieces", blocks=True)))


@query("named_column_file", _COUNTS)
def named_column_file(spark, sf_dir):
    b = _as_blocks(spark, sf_dir, "concat_ws('\\t', x.pos + 1, x.token, '_', '_', '_', x.tag)").coalesce(1)
    head = F.when(F.row_number().over(_first_row()) == 1, F.concat(F.lit("# global.columns = ID FORM A B C TAG\n"), "value")).otherwise(F.col("value"))
    return _counted(K.read_named_columns(spark, _text(spark, b.withColumn("value", head).coalesce(1), "named", blocks=True)))


def _first_row():
    from pyspark.sql import Window

    return Window.orderBy("sent")


@query("word_tag_file", f"WITH t AS ({_TOK}), w AS (SELECT *, unnest(CASE WHEN tag LIKE 'B-%' THEN string_split(token, '_') ELSE [token] END) AS word, unnest(range(CASE WHEN tag LIKE 'B-%' THEN len(string_split(token, '_')) ELSE 1 END)) AS j FROM t) SELECT word AS token, CASE WHEN j > 0 THEN 'I-LOC' ELSE tag END AS tag, count(*) AS n FROM w GROUP BY ALL")
def word_tag_file(spark, sf_dir):
    b = _as_blocks(spark, sf_dir, "concat(x.token, '|N|', x.tag)").select(F.replace("value", F.lit("\n"), F.lit(" ")).alias("value"))
    return K.read_word_tag_lines(spark, _text(spark, b, "words")).groupBy("token", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("bracketed_file", f"WITH t AS ({_TOK}) SELECT pos, token, CASE tag WHEN 'O' THEN 'O' ELSE 'B-LOC' END AS tag, count(*) AS n FROM t GROUP BY ALL")
def bracketed_file(spark, sf_dir):
    one = "concat(if(x.tag = 'O', '', concat(x.pos, '\\t((\\tNP\\t<ne=NEL>\\n')), x.pos, '.1\\t', x.token, '\\tN', if(x.tag = 'O', '', '\\n\\t))'))"
    b = _as_blocks(spark, sf_dir, one).select(F.concat(F.lit("<Sentence id='1'>\n"), "value", F.lit("\n</Sentence>")).alias("value"))
    return _counted(K.read_bracketed(spark, _text(spark, b, "bracketed")))


@query("aligned_entities", f"WITH t AS ({_TOK}), n AS (SELECT sent, min(token) AS a FROM t GROUP BY sent) SELECT sent, string_agg(CASE WHEN token = a THEN 'B-ITEM' ELSE 'O' END, ' ' ORDER BY pos) AS tags FROM t JOIN n USING (sent) GROUP BY sent")
def aligned_entities(spark, sf_dir):
    g = _tokens(spark, sf_dir).groupBy("sent").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("t"), F.min("token").alias("a"))
    tags = G.aligned_entities(F.transform("t", lambda x: x["token"]), F.array(F.struct(F.col("a").alias("text"), F.lit("ITEM").alias("type"))))
    return g.select("sent", F.array_join(tags, " ").alias("tags"))


# --- vectors, properties, labelled texts, XML, zipped lines ---
@query("vector_file", "SELECT p_name AS word, p_size::DOUBLE AS a, p_partkey::DOUBLE AS b, 0.5::DOUBLE AS c FROM part")
def vector_file(spark, sf_dir):
    path = scratch(spark, "vectors")
    S.write_vectors(table(spark, sf_dir, "part").select(F.col("p_name").alias("word"), F.array(F.col("p_size").cast("float"), F.col("p_partkey").cast("float"), F.lit(0.5).cast("float")).alias("vector")), path)
    return S.read_vectors(spark, path, 3).select("word", *(F.get("vector", F.lit(i)).cast("double").alias(n) for i, n in enumerate("abc")))


@query("vector_coverage", "WITH v AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS w FROM part WHERE p_size % 2 = 0), t AS (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) SELECT count(*) AS words, avg((w IN (SELECT w FROM v))::INT) AS covered FROM t")
def vector_coverage(spark, sf_dir):
    from textloom.operators import vocab as V

    p, path = table(spark, sf_dir, "part"), scratch(spark, "vectors")
    S.write_vectors(p.where("p_size % 2 = 0").select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("word"), F.array(F.lit(1.0).cast("float"), F.lit(2.0).cast("float")).alias("vector")).distinct(), path)
    return V.coverage(p.select(F.explode(F.split("p_name", " ")).alias("word")), S.read_vectors(spark, path, 2))


@query("properties_file", "SELECT concat('key.', p_partkey) AS key, concat(p_name, '=', p_type) AS value FROM part WHERE p_size % 5 <> 0")
def properties_file(spark, sf_dir):
    path, notes = scratch(spark, "properties"), table(spark, sf_dir, "part").where("p_size % 5 = 0").selectExpr("concat('# ', p_name) AS value")
    S.write_properties(table(spark, sf_dir, "part").where("p_size % 5 <> 0").selectExpr("concat('key.', p_partkey) AS key", "concat(p_name, '=', p_type) AS value"), path)
    notes.write.mode("append").text(path)
    return S.read_properties(spark, path)


@query("labelled_csv", "SELECT CASE p_type WHEN 'SMALL' THEN 0 WHEN 'LARGE' THEN 2 ELSE 1 END AS label, p_name AS text, count(*) AS n FROM part GROUP BY ALL")
def labelled_csv(spark, sf_dir):
    path = scratch(spark, "labelled")
    S.write_csv(table(spark, sf_dir, "part").selectExpr("p_partkey", "CASE p_type WHEN 'SMALL' THEN 'negative' WHEN 'LARGE' THEN 'positive' ELSE 'neutral' END AS sentiment", "p_name AS text"), path)
    return S.read_labelled(spark, path, 1, 2, {"negative": 0, "neutral": 1, "positive": 2}).groupBy("label", "text").agg(F.count(F.lit(1)).alias("n"))


@query("labelled_tsv", "SELECT CASE WHEN p_size % 2 = 0 THEN 4 ELSE 0 END AS label, concat(p_name, ', \"', p_brand, '\"') AS text, count(*) AS n FROM part GROUP BY ALL")
def labelled_tsv(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("concat_ws('\\t', if(p_size % 2 = 0, 'pos', 'neg'), concat(p_name, ', \"', p_brand, '\"')) AS value")
    return S.read_labelled(spark, _text(spark, rows, "tsv"), 0, 1, {"neg": 0, "pos": 4}, sep="\t", header=False, quote="").groupBy("label", "text").agg(F.count(F.lit(1)).alias("n"))


@query("last_character_labels", "SELECT CASE WHEN p_size % 2 = 1 THEN 2 ELSE 0 END AS label, p_name AS text, count(*) AS n FROM part GROUP BY ALL")
def last_character_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("concat(p_name, ' \\t', p_size % 2) AS value")
    return S.read_last_character_labels(spark, _text(spark, rows, "last")).groupBy("label", "text").agg(F.count(F.lit(1)).alias("n"))


@query("span_snippets", "SELECT CASE p_type WHEN 'SMALL' THEN 0 WHEN 'LARGE' THEN 2 END AS label, split_part(p_name, ' ', 1) AS text, count(*) AS n FROM part WHERE p_type IN ('SMALL', 'LARGE') AND p_size % 3 <> 0 GROUP BY ALL")
def span_snippets(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    spans = p.selectExpr("p_partkey AS key", "0 AS begin", "if(p_size % 3 = 0, 999, length(split_part(p_name, ' ', 1))) AS end", "p_type AS label")
    return K.snippets(spans, p.selectExpr("p_partkey AS key", "p_name AS text"), {"SMALL": 0, "LARGE": 2}).groupBy("label", "text").agg(F.count(F.lit(1)).alias("n"))


@query("id_map_file", "SELECT concat('k', p_partkey) AS key, p_name AS rest FROM part")
def id_map_file(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("concat('k', p_partkey, '\\t', p_name) AS value")
    return K.key_and_rest(spark.read.text(_text(spark, rows, "map")))


def _rooted(spark, rows, name: str) -> str:
    """Rows (k, value) as XML files with one root each, one for every k: a thousand parts, whatever the table's size."""
    path = scratch(spark, name)
    one = rows.groupBy("k").agg(F.concat(F.lit("<root>\n"), F.array_join(F.collect_list("value"), "\n"), F.lit("\n</root>")).alias("value"))
    one.write.partitionBy("k").text(path)
    return f"{path}/*/"


@query("xml_file", "SELECT p_partkey AS k, p_name AS n, CAST(p_size AS BIGINT) AS s FROM part")
def xml_file(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey div 1000 AS k", "concat('<item><k>', p_partkey, '</k><n>', p_name, '</n><s>', p_size, '</s></item>') AS value")
    return S.read_xml(spark, _rooted(spark, rows, "xml"), "item", "k bigint, n string, s bigint")


@query("xml_phrases", f"WITH t AS ({_TOK}) SELECT token AS phrase, CAST(pos AS BIGINT) AS polarity, count(*) AS n FROM t GROUP BY ALL")
def xml_phrases(spark, sf_dir):
    """Nested paragraphs and sentences, flattened."""
    b = _as_blocks(spark, sf_dir, "concat('<sentence><S>', x.token, '</S><Polarity>', x.pos, '</Polarity></sentence>')").select(F.expr("sent div 200").alias("k"), F.concat(F.lit("<paragraph>"), "value", F.lit("</paragraph>")).alias("value"))
    x = S.read_xml(spark, _rooted(spark, b, "phrases"), "paragraph", "sentence array<struct<S:string,Polarity:bigint>>")
    return x.select(F.inline("sentence")).groupBy(F.col("S").alias("phrase"), F.col("Polarity").alias("polarity")).agg(F.count(F.lit(1)).alias("n"))


@query("zipped_lines", "SELECT p_partkey // 1000 AS k, CAST(row_number() OVER (PARTITION BY p_partkey // 1000 ORDER BY p_partkey) - 1 AS INTEGER) AS line, p_name AS \"left\", p_brand AS \"right\" FROM part")
def zipped_lines(spark, sf_dir):
    """Files of a thousand parts, names in one and brands in the other."""
    g = table(spark, sf_dir, "part").groupBy(F.expr("p_partkey div 1000").alias("k")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name", "p_brand"))).alias("x"))
    whole = lambda c: g.select("k", F.array_join(F.transform("x", lambda y: y[c]), "\n").alias("value"))
    return B.zip_lines(whole("p_name"), whole("p_brand"), key=("k",))


# --- trees ---
@query("tree_file", f"SELECT {_TREE} AS tree, count(*) AS n FROM part GROUP BY ALL")
def tree_file(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr(f"{_TREE} AS value")
    return S.read_trees(spark, _text(spark, rows, "trees")).groupBy("tree").agg(F.count(F.lit(1)).alias("n"))


@query("tree_tag_file", "SELECT concat('(ROOT (S (N ', p_name, ')))') AS tree, count(*) AS n FROM part GROUP BY ALL")
def tree_tag_file(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("concat('<s>  (S\\n (N ', p_name, ')) </s>') AS value")
    whole = spark.read.text(_text(spark, rows, "tags"), wholetext=True)
    one = whole.select(F.explode(F.split("value", "(?<=</s>)\\s*")).alias("v")).where("trim(v) <> ''")
    return one.select(T.canonical(S.tagged_sentence_files(F.col("v"))).alias("tree")).groupBy("tree").agg(F.count(F.lit(1)).alias("n"))


@query("mixed_tree_file", "SELECT concat('(S (NX (JJ ', split_part(p_name, ' ', 1), ') (NN ', split_part(p_name, ' ', 2), ')))') AS tree, count(*) AS n FROM part WHERE p_size % 3 <> 0 GROUP BY ALL")
def mixed_tree_file(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("concat('(S (NP-SBJ (JJ ', split_part(p_name, ' ', 1), ') (NN ', split_part(p_name, ' ', 2), '))', if(p_size % 3 = 0, '', ' (-NONE- *))')) AS value")
    return G.read_mixed_trees(spark, _text(spark, rows, "mixed"), {"NP": "NX"}).groupBy("tree").agg(F.count(F.lit(1)).alias("n"))


# --- segmented corpora ---
@query("thai_lines", "SELECT p_partkey, concat('ก', p_size, '|', CASE WHEN p_size % 2 = 0 THEN 'ข' ELSE 'ข|ค' END, '|', p_partkey) AS words FROM part")
def thai_lines(spark, sf_dir):
    line = "concat('<NE>ก', p_size, '</NE>|', if(p_size % 2 = 0, '<NE><AB>ข</AB></NE>', '<NER><AB>ข</AB>ค</NER>'), '|<EM>', p_partkey, '</EM> ') AS v"
    return table(spark, sf_dir, "part").selectExpr("p_partkey", line).select("p_partkey", F.array_join(G.thai_words(F.col("v")), "|").alias("words"))


@query("thai_resplit", "SELECT p_partkey, concat(substr(replace(p_name, ' ', ''), 1, 4), '/', substr(replace(p_name, ' ', ''), 5)) AS cut FROM part WHERE length(replace(p_name, ' ', '')) > 4")
def thai_resplit(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("length(replace(p_name, ' ', '')) > 4").select("p_partkey", F.split("p_name", " ").alias("w"))
    cut = G.resplit(F.col("w"), lambda t: [t[:4], t[4:]])
    return p.select("p_partkey", F.array_join(F.transform(cut, lambda s: F.array_join(s, "")), "/").alias("cut"))


@query("clause_sentences", f"WITH t AS ({_TOK}), n AS (SELECT *, max(pos) OVER (PARTITION BY sent) AS last FROM t) SELECT sent // 4 AS doc, CAST(sent % 4 AS INTEGER) AS sentence, pos, token AS word, p_size % 2 = 0 OR pos = last AS space FROM n")
def clause_sentences(spark, sf_dir):
    """Four sentences are a document: a token line, for even sizes a line with a space, and a blank line after each sentence."""
    t = _tokens(spark, sf_dir).withColumn("last", F.expr("max(pos) over (partition by sent)"))
    line = "filter(array(struct(sent % 4 * 100 + pos * 3 AS line_no, token AS value), if(p_size % 2 = 0, struct(sent % 4 * 100 + pos * 3 + 1 AS line_no, '_\\tX\\tX\\tI' AS value), null), if(pos = last, struct(sent % 4 * 100 + 99 AS line_no, '' AS value), null)), x -> x is not null)"
    rows = t.select(F.expr("sent div 4").alias("doc"), F.explode(F.expr(line)).alias("x")).select("doc", "x.line_no", "x.value")
    return G.clause_sentences(rows, "doc")


@query("surface_words", f"WITH t AS ({_TOK}), n AS (SELECT *, max(pos) OVER (PARTITION BY sent) AS last FROM t) SELECT sent, string_agg(concat(token, ':', CASE WHEN p_size % 2 = 0 OR pos = last THEN 'true' ELSE 'false' END), ' ' ORDER BY pos) AS tokens FROM n GROUP BY sent")
def surface_words(spark, sf_dir):
    g = _tokens(spark, sf_dir).groupBy("sent").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "p_size"))).alias("t"))
    g = g.select("sent", F.flatten(F.expr("transform(t, x -> if(x.p_size % 2 = 0, array(concat('<esc>', x.token), '<space>'), array(concat('<esc>', x.token))))")).alias("w"))
    g = g.withColumn("w", F.transform("w", lambda x: F.regexp_replace(x, "^<esc>", "")))
    return G.surface_words(g, "w").select("sent", F.array_join(F.transform("tokens", lambda x: F.concat_ws(":", x["word"], x["space"].cast("string"))), " ").alias("tokens"))


@query("spaces_after_words", "SELECT p_partkey, concat(split_part(p_name, ' ', 1), ' \"', split_part(p_name, ' ', 2), '\" (', p_size, '), ', p_brand, '.') AS text FROM part")
def spaces_after_words(spark, sf_dir):
    w = F.expr("array(split_part(p_name, ' ', 1), '\"', split_part(p_name, ' ', 2), '\"', '(', string(p_size), ')', ',', p_brand, '.')")
    p = table(spark, sf_dir, "part").select("p_partkey", w.alias("w")).withColumn("s", G.spaces_after(F.col("w")))
    return p.select("p_partkey", F.rtrim(F.array_join(F.zip_with("w", "s", lambda x, s: F.concat(x, F.when(s, " ").otherwise(""))), "")).alias("text"))


@query("syllable_dictionary", "SELECT DISTINCT concat('ก', chr(3585 + p_size % 40)) AS syllable FROM part UNION SELECT 'ขา'")
def syllable_dictionary(spark, sf_dir):
    lines = table(spark, sf_dir, "part").selectExpr("concat('ก', char(0), '<s/>', p_name, '~ขา<s/>12~') AS value", "p_size")
    lines = lines.withColumn("value", F.replace("value", F.lit("\x00"), F.get(F.array(*(F.lit(chr(3585 + i)) for i in range(40))), F.col("p_size") % 40)))
    return G.syllables(lines)


@query("char_labels", r"WITH d AS (SELECT p_partkey, p_name, p_type FROM part) SELECT p_partkey, concat(repeat('0', length(split_part(p_name, ' ', 1)) - 1), '1', '0', repeat('0', length(split_part(p_name, ' ', 2)) - 1), '2', E'\n\n', repeat('0', length(p_type) - 1), '2') AS labels FROM d")
def char_labels(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "concat(p_name, '\\n \\n', p_type) AS t", "array(split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), p_type) AS w", "array(1, 2, 2) AS m")
    return p.select("p_partkey", G.char_labels(F.col("t"), F.col("w"), F.col("m")).alias("labels"))
