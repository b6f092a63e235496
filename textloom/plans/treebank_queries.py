"""Queries on treebank preparation, scoring with multi-word tokens, trees, batches and annotators.

A part of the ``part`` table is a sentence: two words of its name and a final mark, as a CoNLL-U block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import annotate as A
from textloom.operators import assembly as B
from textloom.operators import batching as K
from textloom.operators import conllu as C
from textloom.operators import treebank_prep as P
from textloom.operators import trees as T
from textloom.operators import ud_scores as U
from textloom.operators import vocab as V
from textloom.plans.corpus_queries import _TREE, _trees
from textloom.plans.registry import query
from textloom.session import scratch, table
from textloom.sources import files as S

_A, _B = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
_MARK = "CASE WHEN p_size % 4 = 0 THEN ';' WHEN p_size % 4 = 1 THEN ',' ELSE '.' END"


def _block(space: str = "CASE WHEN p_size % 2 = 0 THEN '' ELSE ' ' END", extra: str = "", mark: str = _MARK, top: str = "''", misc: str = "CASE WHEN p_size % 2 = 0 THEN 'SpaceAfter=No' ELSE '_' END"):
    """The SQL expression of a block; it means the same to both engines. chr(9) and chr(10) are tab and line break."""
    word = lambda i, form, upos, head, rel, m: f"concat_ws(chr(9), '{i}', {form}, {form}, '{upos}', '_', '_', '{head}', '{rel}', '_', {m})"
    return f"concat_ws(chr(10), concat({top}, '# sent_id = ', p_partkey), concat('# text = ', {_A}, ' ', {_B}, {space}, {mark}){extra}, {word(1, _A, 'ADJ', 2, 'amod', chr(39) + '_' + chr(39))}, {word(2, _B, 'NOUN', 0, 'root', misc)}, {word(3, mark, 'PUNCT', 2, 'punct', chr(39) + '_' + chr(39))})"


_BLOCK = _block()
_HASH = "('0x' || substr(md5(concat(p_partkey, '|{seed}')), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


def _part(spark, sf_dir, block: str = _BLOCK):
    return table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size", f"{block} AS value")


@query("text_line_number", "SELECT p_partkey, CAST(CASE p_size % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE -1 END AS INTEGER) AS line FROM part")
def text_line_number(spark, sf_dir):
    b = _part(spark, sf_dir, _block(top="CASE WHEN p_size % 3 = 0 THEN concat('# newpar', chr(10)) ELSE '' END"))
    b = b.withColumn("value", F.when(F.col("p_size") % 3 == 2, F.regexp_replace("value", "(?m)^# text", "# words")).otherwise(F.col("value")))
    return b.select("p_partkey", P.text_line(F.col("value")).alias("line"))


_SWAPPED = _BLOCK.replace(_MARK, "CASE WHEN p_size % 4 = 0 THEN '.' WHEN p_size % 4 = 1 THEN ',' ELSE '.' END")


@query("semicolon_fix", f"SELECT p_partkey, {_SWAPPED} AS value FROM part")
def semicolon_fix(spark, sf_dir):
    return _part(spark, sf_dir).select("p_partkey", P.final_semicolon_to_period(F.col("value")).alias("value"))


@query("spaces_removed", f"SELECT p_partkey, replace({_BLOCK}, chr(9) || '_' || chr(10), chr(9) || 'SpaceAfter=No' || chr(10))[:-2] || 'SpaceAfter=No' AS value FROM part")
def spaces_removed(spark, sf_dir):
    return _part(spark, sf_dir).select("p_partkey", P.without_spaces(F.col("value")).alias("value"))


_TIGHT = _block(space="''", misc="'SpaceAfter=No'")
_LOOSE = _block(space="' '", misc="'_'")


@query("spaced_final_marks", f"SELECT p_partkey, {_TIGHT} AS value FROM part UNION ALL SELECT p_partkey, {_LOOSE} FROM part WHERE p_size % 4 > 1 AND {_HASH.format(seed=1234)} < 0.05")
def spaced_final_marks(spark, sf_dir):
    return P.with_copies(_part(spark, sf_dir, _TIGHT).select("p_partkey", "value"), ["p_partkey"], P.ARABIC)


_TE = _block(space="' '", misc="'_'", extra=f", concat('# translit = ', {_A}, ' ', {_B}, ' ', {_MARK})")
_TE_JOINED = _block(space="''", misc="'_|SpaceAfter=No'", extra=f", concat('# translit = ', {_A}, ' ', {_B}, {_MARK})")


@query("joined_final_marks", f"SELECT p_partkey, {_TE} AS value FROM part UNION ALL SELECT p_partkey, {_TE_JOINED} FROM part WHERE p_size % 4 > 1 AND {_HASH.format(seed=1234)} < 0.1")
def joined_final_marks(spark, sf_dir):
    return P.with_copies(_part(spark, sf_dir, _TE).select("p_partkey", "value"), ["p_partkey"], P.TELUGU)


_RANGED = f"concat_ws(chr(10), concat('# sent_id = ', p_partkey), concat('# text = ', {_A}, {_B}), concat('1-2', chr(9), {_A}, {_B}, replace('|_|_|_|_|_|_|_|', '|', chr(9)), '_'), concat('1', chr(9), {_A}), concat('2', chr(9), {_B}))"
_BANKS = {
    "en_combined": ["UD_English-EWT", "UD_English-GUM", "UD_English-GUMReddit", "UD_English-PUD", "UD_English-Pronouns", "en_tweet"],
    "it_combined": ["UD_Italian-ISDT", "UD_Italian-VIT", "UD_Italian-TWITTIRO", "UD_Italian-PoSTWITA", "italian-mwt", "other"],
    "es_combined": ["UD_Spanish-AnCora", "UD_Spanish-GSD", "spanish-mwt", "other"], "ko_combined": ["UD_Korean-GSD", "UD_Korean-Kaist", "other"], "ko_combined_seg": ["UD_Korean-GSD", "UD_Korean-Kaist", "other"],
    "en_gum": ["UD_English-GUM", "UD_English-GUMReddit", "other"], "en_ewt_tweet": ["en_ewt", "en_tweet", "other"],
}
_SHARDS = ["train", "dev", "test", "extra"]
_FIXED = {None: "{v}", P.without_range_lines: "regexp_replace({v}, '\\n1-2\\t[^\\n]*', '')", P.range_without_space: "replace({v}, chr(9) || '_' || chr(10) || '1' || chr(9), chr(9) || 'SpaceAfter=No' || chr(10) || '1' || chr(9))", P.final_semicolon_to_period: "replace({v}, ';', '.')", P.without_spaces: "replace({v}, chr(9) || '_' || chr(10), chr(9) || 'SpaceAfter=No' || chr(10))[:-2] || 'SpaceAfter=No'"}


def _combined_query(name: str, block: str):
    banks = _BANKS[name]
    of = f"(['{(chr(39) + ', ' + chr(39)).join(banks)}'])[1 + p_partkey % {len(banks)}]"
    shard = f"(['{(chr(39) + ', ' + chr(39)).join(_SHARDS)}'])[1 + p_size % 4]"
    rows = f"WITH p AS (SELECT {of} AS treebank, {shard} AS shard, {block} AS v FROM part)"
    parts = [f"SELECT treebank, '{s}' AS shard, {_FIXED[fix].format(v='v')} AS value FROM p WHERE treebank = '{t}' AND shard = '{src}'" for s, sources in P.COMBINED[name].items() for t, src, fix in sources]

    @query(f"combined_{name}", f"{rows} {' UNION ALL '.join(parts)}")
    def run(spark, sf_dir):
        pick = lambda names, at: F.get(F.array(*(F.lit(x) for x in names)), F.expr(at).cast("int"))
        b = table(spark, sf_dir, "part").select(pick(banks, f"p_partkey % {len(banks)}").alias("treebank"), pick(_SHARDS, "p_size % 4").alias("shard"), F.expr(block.replace("chr(9)", "'\\t'").replace("chr(10)", "'\\n'")).alias("value"))
        return P.combined(b, name)

    return run


for _name in _BANKS:
    _combined_query(_name, _RANGED if _name in ("en_combined", "it_combined") else _BLOCK)


# --- multi-word tokens: the two words of a name written together ---
def _multi(spark, sf_dir, system: bool = False):
    """Gold: a range of two words and the type. System: the same, one word in its place, or a second word of its own, by size."""
    word = lambda i, form, upos, head, rel: f"concat_ws('\\t', '{i}', {form}, {form}, '{upos}', '_', '_', '{head}', '{rel}', '_', '_')"
    rng = f"concat('1-2\\t', {_A}, {_B}, '\\t_\\t_\\t_\\t_\\t_\\t_\\t_\\t_')"
    full = lambda second: f"concat_ws('\\n', {rng}, {word(1, _A, 'ADJ', 2, 'amod')}, {word(2, second, 'NOUN', 0, 'root')}, {word(3, 'p_type', 'X', 2, 'dep')})"
    one = f"concat_ws('\\n', {word(1, f'concat({_A}, {_B})', 'NOUN', 0, 'root')}, {word(2, 'p_type', 'X', 1, 'dep')})"
    made = f"CASE p_size % 3 WHEN 0 THEN {one} WHEN 1 THEN {full(_B)} ELSE {full(chr(39) + 'zz' + chr(39))} END" if system else full(_B)
    return C.words(table(spark, sf_dir, "part").selectExpr("p_partkey AS sent", f"{made} AS value"))


_MULTI = """WITH n AS (SELECT count(*) AS n, count(*) FILTER (p_size % 3 = 0) AS a, count(*) FILTER (p_size % 3 = 1) AS b, count(*) FILTER (p_size % 3 = 2) AS c FROM part),
m AS (SELECT unnest(['Tokens', 'Sentences', 'Words', 'UPOS', 'XPOS', 'UFeats', 'AllTags', 'Lemmas', 'UAS', 'LAS', 'CLAS', 'MLAS', 'BLEX']) AS metric,
  unnest([2 * n, n, w, w, w, w, w, w, 3 * b, 3 * b, 3 * b, 3 * b, 3 * b]) AS correct, unnest([2 * n, n, g, g, g, g, g, g, g, g, g, g, g]) AS gold_total, unnest([2 * n, n, s, s, s, s, s, s, s, s, s, s, s]) AS system_total
  FROM (SELECT *, a + 3 * b + 2 * c AS w, 3 * n AS g, 3 * n - a AS s FROM n)),
r AS (SELECT *, correct / system_total::DOUBLE AS precision, correct / gold_total::DOUBLE AS recall, 2 * correct / (gold_total + system_total)::DOUBLE AS f1 FROM m)
"""


def _multi_scores(spark, sf_dir):
    return U.scores(_multi(spark, sf_dir), _multi(spark, sf_dir, True), ["sent"])


@query("ud_metrics_ranges", _MULTI + "SELECT * FROM r")
def ud_metrics_ranges(spark, sf_dir):
    return _multi_scores(spark, sf_dir)


@query("score_table", _MULTI + ", h AS (SELECT 'Metric     | Precision |    Recall |  F1 Score' AS line UNION ALL SELECT repeat('-----------+', 3) || '-----------') SELECT * FROM h UNION ALL SELECT concat_ws(' | ', rpad(metric, 10, ' '), lpad(printf('%.2f', 100 * precision), 9, ' '), lpad(printf('%.2f', 100 * recall), 9, ' '), lpad(printf('%.2f', 100 * f1), 9, ' ')) FROM r")
def score_table(spark, sf_dir):
    return U.score_table(_multi_scores(spark, sf_dir))


@query("score_counts_table", _MULTI + ", h AS (SELECT 'Metric     |  Correct |      Gold |    System' AS line UNION ALL SELECT repeat('-----------+', 3) || '-----------') SELECT * FROM h UNION ALL SELECT concat_ws(' | ', rpad(metric, 10, ' '), lpad(correct::VARCHAR, 9, ' '), lpad(gold_total::VARCHAR, 9, ' '), lpad(system_total::VARCHAR, 9, ' ')) FROM r")
def score_counts_table(spark, sf_dir):
    return U.score_table(_multi_scores(spark, sf_dir), counts=True)


@query("selected_metrics", _MULTI + "SELECT string_agg(printf('%.2f', 100 * f1), ' ' ORDER BY CASE metric WHEN 'Tokens' THEN 1 WHEN 'UPOS' THEN 2 ELSE 3 END) AS scores FROM r WHERE metric IN ('Tokens', 'UPOS', 'LAS')")
def selected_metrics(spark, sf_dir):
    return U.selected(_multi_scores(spark, sf_dir), ["Tokens", "UPOS", "LAS"])


@query("scored_files", _MULTI + "SELECT * FROM r")
def scored_files(spark, sf_dir):
    """Gold and system written as CoNLL-U, a file for every thousand sentences, and scored from the files."""
    paths = []
    for system in (False, True):
        path = scratch(spark, "scored")
        blocks = C.render(_multi(spark, sf_dir, system), ["sent"]).groupBy(F.expr("sent div 1000").alias("k"))
        whole = blocks.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent", "value"))), lambda x: x["value"]), "\n\n").alias("value"))
        whole.write.partitionBy("k").text(path)
        _name_by_folder(spark, path)  # so files of both sides have equal names
        paths.append(path)
    return U.score_files(spark, *(f"{p}/*.conllu" for p in paths))


def _name_by_folder(spark, path: str) -> None:
    """k=7/part-... becomes 7.conllu."""
    jvm = spark.sparkContext._jvm
    at = lambda *x: jvm.org.apache.hadoop.fs.Path("/".join((path, *x)))
    fs = at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in [x.getPath().getName() for x in fs.listStatus(at()) if x.getPath().getName().startswith("k=")]:
        for name in [x.getPath().getName() for x in fs.listStatus(at(folder)) if x.getPath().getName().startswith("part-")]:
            fs.rename(at(folder, name), at(f"{folder[2:]}.conllu"))


@query("range_expansions", f"SELECT lower(concat({_A}, {_B})) AS token, lower(p_name) AS parts, count(*) AS n FROM part GROUP BY ALL")
def range_expansions(spark, sf_dir):
    return P.range_data(_multi(spark, sf_dir), ["sent"])[0]


@query("ranges_contracted", f"SELECT p_partkey AS sent, CAST(i AS INTEGER) AS id, CASE i WHEN 1 THEN concat({_A}, {_B}) ELSE p_type END AS form, CASE i WHEN 1 THEN 'MWT=Yes' END AS misc FROM part, range(1, 3) g(i)")
def ranges_contracted(spark, sf_dir):
    return P.range_data(_multi(spark, sf_dir), ["sent"])[1].select("sent", F.col("id_start").cast("int").alias("id"), "form", "misc")


@query("ranges_left_out", f"SELECT p_partkey AS sent, concat_ws(' ', {_A}, {_B}, p_type) AS words FROM part")
def ranges_left_out(spark, sf_dir):
    w = C.without_ranges(_multi(spark, sf_dir))
    return w.groupBy("sent").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id_start", "form"))), lambda x: x["form"]), " ").alias("words"))


@query("longest_range", "SELECT CAST(max(length(p_name)) AS INTEGER) AS longest FROM part")
def longest_range(spark, sf_dir):
    return P.longest_expansion(C.expansions(_multi(spark, sf_dir), ["sent"]))


@query("range_presence", "SELECT p_size % 3 AS treebank, p_size % 3 <> 0 AS ranges FROM part GROUP BY ALL")
def range_presence(spark, sf_dir):
    w = _multi(spark, sf_dir, True).join(table(spark, sf_dir, "part").selectExpr("p_partkey AS sent", "p_size % 3 AS treebank"), "sent")
    return P.has_ranges(w, ["treebank"])


@query("lemma_presence", "SELECT p_size % 3 AS treebank, p_size % 3 = 0 AS lemmas FROM part GROUP BY ALL")
def lemma_presence(spark, sf_dir):
    w = _multi(spark, sf_dir).join(table(spark, sf_dir, "part").selectExpr("p_partkey AS sent", "p_size % 3 AS treebank"), "sent").where("id_end is null")
    w = w.withColumn("lemma", F.when(F.col("treebank") == 0, F.concat("form", F.lit("x"))).when(F.col("treebank") == 1, F.upper("form")))
    return P.has_lemmas(w, ["treebank"])


@query("document_counts", "SELECT p_partkey // 10 AS doc, CAST(2 * count(*) AS BIGINT) AS tokens, CAST(3 * count(*) AS BIGINT) AS words FROM part GROUP BY ALL")
def document_counts(spark, sf_dir):
    return P.document_counts(_multi(spark, sf_dir).withColumn("doc", F.expr("sent div 10")), ["doc"])


def _documents(spark, sf_dir):
    return P.documents(_multi(spark, sf_dir).withColumn("doc", F.expr("sent div 10")), ["doc"], "sent", ("form", "upos"))


@query("document_fields", f"SELECT p_partkey // 10 AS doc, CAST(row_number() OVER (PARTITION BY p_partkey // 10 ORDER BY p_partkey) - 1 AS INTEGER) AS sent, concat_ws(' ', {_A}, {_B}, p_type) AS forms FROM part")
def document_fields(spark, sf_dir):
    return P.field_values(_documents(spark, sf_dir), ["doc"], "form").select("doc", "sent", F.array_join("values", " ").alias("forms"))


@query("document_field_set", "SELECT p_partkey // 10 AS doc, string_agg('adj noun x', ' ' ORDER BY p_partkey) AS tags FROM part GROUP BY ALL")
def document_field_set(spark, sf_dir):
    d = _documents(spark, sf_dir)
    lower = P.field_values(d, ["doc"], "upos").withColumn("values", F.transform("values", F.lower))
    out = P.with_field(d, lower, ["doc"], "upos")
    return out.select("doc", F.array_join(F.transform(F.flatten("sentences"), lambda w: w["upos"]), " ").alias("tags"))


@query("word_objects", f"SELECT p_partkey AS sent, concat('{{\"id\":1,\"text\":\"', {_A}, '\",\"upos\":\"ADJ\"', CASE WHEN p_size % 2 = 0 THEN ',\"misc\":\"SpaceAfter=No\"' ELSE '' END, '}}') AS value FROM part")
def word_objects(spark, sf_dir):
    w = _multi(spark, sf_dir).where("id_start = 1 and id_end is null").join(table(spark, sf_dir, "part").selectExpr("p_partkey AS sent", "p_size"), "sent")
    misc = F.when(F.col("p_size") % 2 == 0, "SpaceAfter=No")
    return w.select("sent", F.to_json(F.struct(F.col("id_start").alias("id"), F.col("form").alias("text"), "upos", misc.alias("misc"), "xpos")).alias("value"))


@query("gold_copies", f"SELECT upper({_A}) AS word, count(*) AS n FROM part GROUP BY ALL")
def gold_copies(spark, sf_dir):
    """Blocks for a tagger, as they are, and retagged by a function of the user's."""
    b = _part(spark, sf_dir).select("value")
    retagged = P.tagged_copy(b, lambda d: d.withColumn("value", F.upper("value")))
    return C.words(P.tagged_copy(retagged)).where("id_start = 1").groupBy(F.col("form").alias("word")).agg(F.count(F.lit(1)).alias("n"))


@query("short_names", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'en_ewt' WHEN 1 THEN 'it_isdt' END AS short FROM part")
def short_names(spark, sf_dir):
    name = F.expr("CASE p_size % 3 WHEN 0 THEN 'UD_English-EWT' WHEN 1 THEN 'it_isdt' ELSE 'UD_Nowhere' END")
    return table(spark, sf_dir, "part").select("p_partkey", P.short_name(name, {"UD_English-EWT": "en_ewt"}).alias("short"))


@query("language_files", "SELECT CASE p_size % 3 WHEN 0 THEN 'en' ELSE 'fro' END AS lang, count(DISTINCT p_name) AS files FROM part WHERE p_size % 3 < 2 GROUP BY ALL")
def language_files(spark, sf_dir):
    path = F.expr("concat('/ud/', p_brand, '/', CASE p_size % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fro' ELSE 'X9' END, '_', p_name, '.conllu')")
    f = table(spark, sf_dir, "part").select(F.regexp_replace(path, "/Brand[^/]*", "").alias("path"))
    return P.files_by_language(f).select("lang", F.size("files").cast("bigint").alias("files"))


@query("split_by_file", "SELECT p_partkey, CASE WHEN ('0x' || substr(md5(concat(p_brand, '|1234')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.85 THEN 'train' ELSE 'dev' END AS shard FROM part")
def split_by_file(spark, sf_dir):
    return P.split_by_file(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", {"train": 0.85, "dev": 0.15}).select("p_partkey", "shard")


@query("train_to_dev", f"SELECT p_partkey, CASE WHEN {_HASH.format(seed=1234)} < 0.8 THEN 'train' ELSE 'dev' END AS shard FROM part")
def train_to_dev(spark, sf_dir):
    """A treebank without a dev set gives a fifth of its training sentences."""
    return B.hash_split(table(spark, sf_dir, "part").select("p_partkey"), ["p_partkey"], {"train": 0.8, "dev": 0.2})


@query("usable_treebanks", "WITH f AS (SELECT p_size AS treebank, p_type AS shard0, count(*) AS n FROM part GROUP BY ALL), g AS (SELECT treebank, CASE shard0 WHEN 'SMALL' THEN 'train' WHEN 'LARGE' THEN 'test' ELSE 'dev' END AS shard, n * 300 AS words, (treebank % 10) / 10.0 AS blank FROM f), h AS (SELECT treebank, bool_or(shard = 'train') AS a, bool_or(shard = 'dev') AS b, bool_or(shard = 'test') AS c, max(blank) AS m, sum(CASE WHEN shard = 'train' THEN words ELSE 0 END) AS w FROM g GROUP BY treebank) SELECT treebank FROM h WHERE a AND c AND m <= 0.5 AND (b OR w > 1000)")
def usable_treebanks(spark, sf_dir):
    f = table(spark, sf_dir, "part").groupBy("p_size", "p_type").agg(F.count(F.lit(1)).alias("n"))
    f = f.selectExpr("p_size AS treebank", "CASE p_type WHEN 'SMALL' THEN 'train' WHEN 'LARGE' THEN 'test' ELSE 'dev' END AS shard", "n * 300 AS words", "(p_size % 10) / 10.0 AS blank_share")
    return B.usable_treebanks(f)


# --- copies with changed punctuation ---
@query("final_marks_dropped", f"SELECT p_partkey, CAST(3 AS INTEGER) AS words FROM part UNION ALL SELECT p_partkey, 2 FROM part WHERE {_HASH.format(seed=1234)} < 0.25")
def final_marks_dropped(spark, sf_dir):
    w = C.words(_part(spark, sf_dir).select("p_partkey", "value"))
    g = w.groupBy("p_partkey").agg(F.array_sort(F.collect_list(F.struct(F.col("id_start").alias("id"), F.col("head").alias("head_id"), "upos"))).alias("toks"))
    return B.drop_final_punct(g, ["p_partkey"], share=0.25).select("p_partkey", F.size("toks").alias("words"))


@query("punctuation_needed", "SELECT p_brand, CAST(least(0.5, greatest(0.0, (n * 0.1 - (n - h)) / nullif(a, 0))) AS DOUBLE) AS ratio FROM (SELECT p_brand, count(*) AS n, count(*) FILTER (p_size % 20 <> 0) AS h, count(*) FILTER (p_size % 3 = 0 AND p_size % 20 <> 0) AS a FROM part GROUP BY ALL)")
def punctuation_needed(spark, sf_dir):
    n = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("p_size % 20 <> 0")).alias("h"), F.count_if(F.expr("p_size % 3 = 0 and p_size % 20 <> 0")).alias("a"))
    rows = [(r.p_brand, float(B.ratio(r.n, r.h, r.a))) for r in n.collect()]  # one row a brand
    return spark.createDataFrame(rows, "p_brand string, ratio double")


_VARIANTS = {"apostrophe": ("'", "’", 0.05), "ellipsis": ("...", "…", 0.05), "comma_moved": (", ", " ,", 0.02), "comma_squashed": (", ", ",", 0.03), "opening_mark": ("¿", "", 0.2)}
_SAID = "concat(CASE WHEN p_size % 2 = 0 THEN '¿' ELSE '' END, {a}, ', it''s ', {b}, '...', CASE WHEN p_size % 3 = 0 THEN concat(' \"', p_type, '\"') ELSE '' END)".format(a=_A, b=_B)


@query("punctuation_copies", f"WITH p AS (SELECT p_partkey, p_size, p_type, {_SAID} AS text FROM part) SELECT p_partkey, text FROM p"
       + "".join(f" UNION ALL SELECT p_partkey, replace(text, '{old.replace(chr(39), chr(39) * 2)}', '{new}') FROM p WHERE contains(text, '{old.replace(chr(39), chr(39) * 2)}') AND {_HASH.format(seed=1234 + k)} < {share}" for k, (old, new, share) in [(0, _VARIANTS["apostrophe"]), (1, _VARIANTS["ellipsis"]), (3, _VARIANTS["comma_moved"]), (4, _VARIANTS["comma_squashed"]), (5, _VARIANTS["opening_mark"])])
       + f" UNION ALL SELECT p_partkey, replace(text, concat('\"', p_type, '\"'), concat('“', p_type, '”')) FROM p WHERE p_size % 3 = 0 AND {_HASH.format(seed=1236)} < 0.15")
def punctuation_copies(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_SAID.replace(chr(39) * 2 + 's', chr(92) + chr(39) + 's')} AS text")
    return B.augment_punctuation(p, ["p_partkey"])


@query("one_rewrite", f"SELECT p_partkey, p_name FROM part UNION ALL SELECT p_partkey, replace(p_name, 'e', '3') FROM part WHERE contains(p_name, 'e') AND {_HASH.format(seed=7)} < 0.5")
def one_rewrite(spark, sf_dir):
    return B.rewrite_some(table(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_partkey"], "p_name", "e", "3", 0.5, seed=7)


@query("random_crops", "WITH w AS (SELECT doc_id, string_split(text, ' ') AS w, ('0x' || substr(md5(concat(doc_id, '|1234')), 1, 8))::BIGINT AS h, ('0x' || substr(md5(concat(doc_id, '|1235')), 1, 8))::BIGINT AS k FROM documents WHERE text IS NOT NULL), n AS (SELECT *, 5 + h % 16 AS n FROM w), a AS (SELECT *, k % greatest(len(w) - n + 1, 1) AS b FROM n) SELECT doc_id, array_to_string(w[b + 1 : b + n], ' ') AS text FROM a")
def random_crops(spark, sf_dir):
    return B.random_crops(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text"), ["doc_id"])


# --- trees ---
@query("tree_equality", "SELECT p_partkey AS tree_id, p_size % 3 <> 0 AS same FROM part")
def tree_equality(spark, sf_dir):
    t = _trees(spark, sf_dir).join(table(spark, sf_dir, "part").selectExpr("p_partkey AS tree_id", "p_size"), "tree_id")
    other = F.when(F.col("p_size") % 3 == 0, F.regexp_replace("tree", "JJ", "JX")).when(F.col("p_size") % 3 == 1, F.regexp_replace(F.regexp_replace("tree", " ", "\n  "), r"\)", " )")).otherwise(F.col("tree"))
    return t.select("tree_id", (T.canonical(F.col("tree")) == T.canonical(other)).alias("same"))


@query("compound_constituents", "SELECT unnest(['S VP', 'NP', 'X']) AS chain")
def compound_constituents(spark, sf_dir):
    t = table(spark, sf_dir, "part").selectExpr("concat('(S (VP (NP (JJ ', split_part(p_name, ' ', 1), ') (NN a)) (X (NN ', p_type, '))))') AS tree")
    return T.compound_constituents(t)


_PLAIN_TREE = "concat('(S (NP (JJ ', {a}, ') (NN ', {b}, ')))')".format(a=_A, b=_B)


@query("tree_pruned", f"SELECT p_partkey AS tree_id, {_PLAIN_TREE} AS tree FROM part")
def tree_pruned(spark, sf_dir):
    t = table(spark, sf_dir, "part").selectExpr("p_partkey AS tree_id", f"{_PLAIN_TREE.replace('(S (NP', '(S (X (-NONE- *)) (NP')} AS tree")
    return T.edit(t, T.prune_none)


@query("tree_relabelled", f"SELECT p_partkey AS tree_id, {_PLAIN_TREE.replace('(S (NP', '(TOP (NX')} AS tree FROM part")
def tree_relabelled(spark, sf_dir):
    t = table(spark, sf_dir, "part").selectExpr("p_partkey AS tree_id", f"{_PLAIN_TREE} AS tree")
    return T.edit(t, lambda n: T.remap_labels(n, {"S": "TOP", "NP": "NX", "JJ": "no"}))


@query("tree_words_mapped", f"SELECT p_partkey AS tree_id, concat('(S (NP (JJ ', CASE {_A} WHEN 'red' THEN 'rot' ELSE {_A} END, ') (NN ', {_B}, ')))') AS tree FROM part")
def tree_words_mapped(spark, sf_dir):
    t = table(spark, sf_dir, "part").selectExpr("p_partkey AS tree_id", f"{_PLAIN_TREE} AS tree")
    return T.edit(t, lambda n: T.remap_words(n, {"red": "rot"}))


@query("tree_words_replaced", "SELECT p_partkey AS tree_id, '(S (NP (JJ x) (NN y)))' AS tree FROM part")
def tree_words_replaced(spark, sf_dir):
    t = table(spark, sf_dir, "part").selectExpr("p_partkey AS tree_id", f"{_PLAIN_TREE} AS tree")
    return T.edit(t, lambda n: T.replaced(n, ["x", "y"]))


@query("tree_tags_replaced", f"SELECT p_partkey AS tree_id, {_PLAIN_TREE.replace('(JJ', '(A').replace('(NN', '(N')} AS tree FROM part")
def tree_tags_replaced(spark, sf_dir):
    t = table(spark, sf_dir, "part").selectExpr("p_partkey AS tree_id", f"{_PLAIN_TREE} AS tree")
    return T.edit(t, lambda n: T.replaced(n, ["A", "N"], tags=True))


@query("tree_words", "SELECT DISTINCT unnest(string_split(concat_ws(' ', p_name, p_type, CASE WHEN p_size % 2 = 0 THEN concat('of ', p_size) END), ' ')) AS word FROM part")
def tree_words(spark, sf_dir):
    return T.distinct_values(_trees(spark, sf_dir), T.leaves(F.col("tree")), "word")


@query("tree_roots", "SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN 'ROOT' ELSE 'S' END AS label FROM part")
def tree_roots(spark, sf_dir):
    t = _trees(spark, sf_dir).join(table(spark, sf_dir, "part").selectExpr("p_partkey AS tree_id", "p_size"), "tree_id")
    return t.select(T.root_label(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("("), "tree", F.lit(")"))).otherwise(F.col("tree"))).alias("label")).distinct()


@query("tree_printed", f"SELECT p_partkey AS tree_id, {_TREE} AS tree FROM part")
def tree_printed(spark, sf_dir):
    t = _trees(spark, sf_dir).withColumn("tree", F.regexp_replace("tree", " ", "\n   "))
    return T.edit(t, lambda n: n)


# three words: scores[d][h] make word 1 the root, 2 hang on 1, 3 on 2 or 1 by size
_SCORES = "array(array(0D, 0D, 0D, 0D), array(9D, 0D, 8D, 0D), array(1D, 5D, 0D, 2D), array(0D, if(p_size % 2 = 0, 7D, 1D), 4D, 0D))"


@query("spanning_trees", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '0 0 1 1' ELSE '0 0 1 2' END AS heads FROM part")
def spanning_trees(spark, sf_dir):
    return T.decode_trees(table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_SCORES} AS scores")).select("p_partkey", F.array_join(F.transform("heads", lambda h: h.cast("string")), " ").alias("heads"))


@query("head_cycles", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '1 2' WHEN 1 THEN '2 3' ELSE '' END AS cycle FROM part")
def head_cycles(spark, sf_dir):
    @F.pandas_udf("string")
    def cycle(h: pd.Series) -> pd.Series:
        return h.map(lambda x: " ".join(str(v) for c in T.cycles_of(np.array(x)) for v in sorted(c.tolist())))

    heads = F.expr("CASE p_size % 3 WHEN 0 THEN array(0, 2, 1, 1) WHEN 1 THEN array(0, 0, 3, 2) ELSE array(0, 0, 1, 2) END")
    return table(spark, sf_dir, "part").select("p_partkey", cycle(heads).alias("cycle"))


@query("viterbi_paths", "WITH s AS (SELECT p_partkey, p_size % 7 AS a, p_size % 5 AS b FROM part), x AS (SELECT p_partkey, unnest(['0 0', '0 1', '1 0', '1 1']) AS path, unnest([a + b, a + 3 - 1, 2 + b - 1, 2 + 3]) AS score FROM s) SELECT p_partkey, path, score::DOUBLE AS score FROM x QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, path) = 1")
def viterbi_paths(spark, sf_dir):
    """Two tags over two words: scores by size, and a cost of one for changing the tag."""

    @F.pandas_udf("struct<path: string, score: double>")
    def best(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        moves = np.array([[0.0, -1.0], [-1.0, 0.0]])
        got = [T.viterbi(np.array([[x, 2.0], [y, 3.0]]), moves) for x, y in zip(a, b)]
        # of equal paths the smallest is given
        out = []
        for (path, v), x, y in zip(got, a, b):
            every = {"0 0": x + y, "0 1": x + 2.0, "1 0": y + 1.0, "1 1": 5.0}
            assert v == max(every.values()) == every[" ".join(map(str, path))]
            out.append((min(k for k, s in every.items() if s == v), v))
        return pd.DataFrame(out, columns=["path", "score"])

    p = table(spark, sf_dir, "part").select("p_partkey", best(F.expr("p_size % 7D"), F.expr("p_size % 5D")).alias("x"))
    return p.select("p_partkey", "x.path", "x.score")


# --- batches and conversions ---
@query("sorted_together", "SELECT p_brand, string_agg(concat(p_name, ':', p_size), ' ' ORDER BY p_size DESC, p_partkey) AS items FROM part GROUP BY ALL")
def sorted_together(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_size", "p_name"))).alias("x"))
    s = K.sorted_together(F.transform("x", lambda y: y["p_size"]), {"name": F.transform("x", lambda y: y["p_name"])})
    return g.select("p_brand", F.array_join(F.transform(s, lambda y: F.concat_ws(":", y["name"], y["reference"].cast("string"))), " ").alias("items"))


@query("order_restored", "SELECT p_brand, string_agg(p_name, ' ' ORDER BY p_partkey) AS items FROM part GROUP BY ALL")
def order_restored(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_size", "p_name"))).alias("x"))
    s = K.sorted_together(F.transform("x", lambda y: y["p_size"]), {"name": F.transform("x", lambda y: y["p_name"])})
    return g.select("p_brand", F.array_join(F.transform(K.restored(s), lambda y: y["name"]), " ").alias("items"))


@query("length_buckets", "SELECT CAST(len(string_split(text, ' ')) AS INTEGER) AS bucket, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def length_buckets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.split("text", " ").alias("tokens"))
    return K.length_buckets(d, "tokens").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("long_enough", "SELECT lang AS label, count(*) AS n FROM documents WHERE text IS NOT NULL AND len(string_split(text, ' ')) >= 12 GROUP BY ALL")
def long_enough(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.col("lang").alias("label"), F.split("text", " ").alias("tokens"))
    return K.long_enough(d, "tokens", 12).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


_LANGS = "WITH r AS (SELECT p_type AS gold, split_part(CASE WHEN p_size % 4 = 0 THEN 'SMALL-x' ELSE p_type || '-y' END, '-', 1) AS pred FROM part), l AS (SELECT gold AS label FROM r UNION SELECT pred FROM r), x AS (SELECT label, (SELECT count(*) FROM r WHERE gold = label AND pred = label) AS tp, (SELECT count(*) FROM r WHERE pred = label) AS p, (SELECT count(*) FROM r WHERE gold = label) AS g FROM l)"


@query("language_metrics", _LANGS + " SELECT label, coalesce(tp / nullif(p, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(g, 0), 0)::DOUBLE AS recall, coalesce(2 * tp / nullif(p + g, 0), 0)::DOUBLE AS f1, (SELECT avg((gold = pred)::INT) FROM r) AS accuracy FROM x")
def language_metrics(spark, sf_dir):
    r = table(spark, sf_dir, "part").selectExpr("p_type AS gold", "if(p_size % 4 = 0, 'SMALL-x', concat(p_type, '-y')) AS pred")
    return K.label_metrics(r, fine=False)


_ENDS = r"string_split(regexp_replace(text, '([.!?])[\s\x{0B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', E'\\1\x01', 'g'), E'\x01')"


@query("splitter_comparison", f"SELECT doc_id, 'marks' AS splitter, CAST(len(list_filter({_ENDS}, lambda s: trim(s) <> '')) AS BIGINT) AS sentences FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, 'lines', len(list_filter(string_split(text, E'\\n'), lambda s: trim(s) <> '')) FROM documents WHERE text IS NOT NULL")
def splitter_comparison(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    rows = K.compare_splitters(d, ["doc_id"], "text", {"marks": X.sentences, "lines": lambda c: F.filter(F.split(c, "\n"), lambda s: F.trim(s) != "")})
    counts = rows.groupBy("doc_id", "splitter").agg(F.count(F.lit(1)).alias("sentences"))
    every = d.select("doc_id", F.explode(F.array(F.lit("marks"), F.lit("lines"))).alias("splitter"))
    return every.join(counts, ["doc_id", "splitter"], "left").select("doc_id", "splitter", F.coalesce("sentences", F.lit(0)).alias("sentences"))


@query("lemma_postprocess", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN '_' ELSE p_type END AS lemma FROM part")
def lemma_postprocess(spark, sf_dir):
    predicted = F.expr("CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN '<UNK>' WHEN 2 THEN '_' ELSE p_type END")
    return table(spark, sf_dir, "part").select("p_partkey", K.filled_lemma(K.usable_lemma(F.col("p_name"), predicted)).alias("lemma"))


@query("lemma_blank", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '_' ELSE p_name END AS lemma FROM part")
def lemma_blank(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", K.filled_lemma(F.expr("if(p_size % 2 = 0, '', p_name)")).alias("lemma"))


@query("lemma_ensemble", "SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN 'small' WHEN p_size % 3 = 0 THEN p_type WHEN p_size % 3 = 1 THEN p_type ELSE p_name END AS lemma, p_type = 'SMALL' AS known FROM part")
def lemma_ensemble(spark, sf_dir):
    """Dictionary, then a model's prediction, then the word; ``known`` says which rows a model need not see."""
    d = spark.createDataFrame([("SMALL", "X", "small")], "word string, pos string, lemma string")
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_type AS word", "'X' AS pos", "CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN '<UNK>' ELSE p_name END AS predicted")
    return V.lemmatize(rows, *V.lemma_dictionaries(d), predicted="predicted").select("p_partkey", "lemma", "known")


@query("edit_kinds", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'identity' WHEN 1 THEN 'lower' ELSE 'none' END AS kind, CASE p_size % 3 WHEN 1 THEN lower(p_brand) WHEN 0 THEN p_brand ELSE 'model' END AS applied FROM part")
def edit_kinds(spark, sf_dir):
    lemma = F.expr("CASE p_size % 3 WHEN 0 THEN p_brand WHEN 1 THEN lower(p_brand) ELSE 'else' END")
    kind = V.edit_kind(F.col("p_brand"), lemma)
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), V.apply_edit(F.col("p_brand"), F.lit("model"), kind).alias("applied"))


@query("typed_options", "SELECT p_partkey, 'k' AS key, CASE p_size % 4 WHEN 0 THEN 'bool' WHEN 1 THEN 'int' WHEN 2 THEN 'float' ELSE 'str' END AS kind, CASE p_size % 4 WHEN 0 THEN 'true' WHEN 1 THEN p_size::VARCHAR WHEN 2 THEN concat(p_size, '.5') ELSE p_name END AS value FROM part")
def typed_options(spark, sf_dir):
    o = F.expr("concat('k=', CASE p_size % 4 WHEN 0 THEN 'False' WHEN 1 THEN string(p_size) WHEN 2 THEN concat(p_size, '.5') ELSE p_name END)")
    return table(spark, sf_dir, "part").select("p_partkey", K.typed_option(o).alias("o")).select("p_partkey", "o.*")


@query("flat_matches", f"SELECT p_partkey, CAST(s AS INTEGER) AS sentence, CAST(m AS INTEGER) AS match_no, CASE WHEN s = 0 THEN ([{_A}, {_B}])[m + 1] ELSE p_type END AS match FROM part, range(2) a(s), range(2) b(m) WHERE s = 0 OR m = 0")
def flat_matches(spark, sf_dir):
    m = F.expr("array(split(p_name, ' '), array(p_type))")
    return K.flat_matches(table(spark, sf_dir, "part").select("p_partkey", m.alias("m")), "m", "p_partkey")


@query("text_table", "WITH w AS (SELECT greatest(max(length(n_name)), 6) AS a, greatest(max(length(n_regionkey::VARCHAR)), 11) AS b FROM nation) SELECT concat('| ', rpad('n_name', (a + 2)::INT, ' '), '| ', rpad('n_regionkey', (b + 2)::INT, ' '), '|') AS line FROM w UNION ALL SELECT concat('| ', rpad(n_name, (a + 2)::INT, ' '), '| ', rpad(n_regionkey::VARCHAR, (b + 2)::INT, ' '), '|') FROM nation, w")
def text_table(spark, sf_dir):
    return K.text_table(table(spark, sf_dir, "nation"), ["n_name", "n_regionkey"])


@query("lexicon_probe", f"WITH l AS (SELECT DISTINCT {_A} AS w FROM part) SELECT p_partkey, CAST(sum((substr(p_name, i::INT, n::INT) IN (SELECT w FROM l) AND i + n - 1 <= length(p_name))::INT) AS BIGINT) AS hits FROM part, range(1, 40) a(i), range(1, 7) b(n) WHERE i <= length(p_name) GROUP BY ALL")
def lexicon_probe(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    words = [r[0] for r in p.select(F.expr(_A)).distinct().collect()]  # a dictionary of the fixture's eight adjectives
    hits = V.prefix_hits(F.col("p_name"), F.array(*(F.lit(w) for w in words)), 6)
    return p.select("p_partkey", F.aggregate(F.flatten(hits), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("hits"))


@query("tag_vocabulary", "WITH n AS (SELECT p_type AS unit, count(*) AS n FROM part GROUP BY ALL) SELECT unit, n, row_number() OVER (ORDER BY n DESC, unit) + 3 AS id FROM n")
def tag_vocabulary(spark, sf_dir):
    return V.frequency_vocabulary(table(spark, sf_dir, "part"), "p_type")


@query("unit_vocabulary", "WITH c AS (SELECT unnest(string_split(lower(text), '')) AS unit FROM documents), n AS (SELECT unit, count(*) AS n FROM c WHERE unit <> '' AND unit <= '~' GROUP BY ALL HAVING count(*) > 50) SELECT unit, n FROM n")
def unit_vocabulary(spark, sf_dir):
    v = V.character_vocabulary(table(spark, sf_dir, "documents").select(F.lower("text").alias("t")), "t", cutoff=50)
    return v.where("unit <= '~'").select("unit", "n")


@query("classifier_vocabulary", "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS unit FROM part")
def classifier_vocabulary(spark, sf_dir):
    return V.frequency_vocabulary(table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w")), "w").select("unit")


# --- annotators ---
@query("annotator_chain", f"SELECT doc_id, CAST(len(list_filter({_ENDS}, lambda s: trim(s) <> '')) AS INTEGER) AS sentences FROM documents WHERE text IS NOT NULL")
def annotator_chain(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    return A.REGISTRY.chain("sentences", "tokens", "lemmas")(d).select("doc_id", F.size("sentences").alias("sentences")).where("sentences >= 0")


@query("batch_annotator", "SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN length(text) END AS size FROM documents WHERE text IS NOT NULL")
def batch_annotator(spark, sf_dir):
    """A model in batches of one; a failing row leaves null and its reason, and the job goes on."""
    a = A.batch_annotator("size", lambda: lambda ts: [1 // int(not t.startswith("fail ")) * len(t) for t in ts], "text", "size", "bigint", size=1)
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("fail "), "text")).otherwise(F.col("text")).alias("text"))
    r = A.Registry()
    r.add(a)
    return r.chain("size")(d).where("size is not null or _error like '%zero%'").select("doc_id", "size")


@query("routed_by_language", "SELECT lang, CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' ELSE 'other' END AS way, count(*) AS n FROM documents GROUP BY ALL")
def routed_by_language(spark, sf_dir):
    mark = lambda w: lambda d: d.withColumn("way", F.lit(w))
    return A.routed(table(spark, sf_dir, "documents").select("lang"), "lang", {"en": mark("english"), "de": mark("german")}, mark("other")).groupBy("lang", "way").agg(F.count(F.lit(1)).alias("n"))


@query("identity_lemmas", f"SELECT doc_id, CAST(len(list_filter({_ENDS}, lambda s: trim(s) <> '')) AS INTEGER) AS sentences, true AS same FROM documents WHERE text IS NOT NULL")
def identity_lemmas(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    return A.REGISTRY.chain("sentences", "tokens", "lemmas")(d).select("doc_id", F.size("lemmas").alias("sentences"), (F.col("lemmas") == F.col("tokens")).alias("same"))


@query("trees_retagged", f"SELECT p_partkey AS tree_id, concat('(S (NP (T', length({_A}), ' ', {_A}, ') (T', length({_B}), ' ', {_B}, ')))') AS tree FROM part")
def trees_retagged(spark, sf_dir):
    t = table(spark, sf_dir, "part").selectExpr("p_partkey AS tree_id", f"{_PLAIN_TREE} AS tree")
    return T.retagged(t, lambda words: [f"T{len(w)}" for w in words])


@query("beam_step", "WITH s AS (SELECT p_partkey, unnest([0, 0, 1, 1]) AS beam, unnest([0, 1, 0, 1]) AS unit, unnest([1 + p_size % 3, 1 + 2, 2 + p_size % 5, 2 + 1])::DOUBLE AS score FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, beam, unit) AS r FROM s) SELECT p_partkey, CAST(beam AS INTEGER) AS beam, CAST(unit AS INTEGER) AS unit, score FROM r WHERE r <= 2")
def beam_step(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", K.best_steps(F.expr("array(array(double(p_size % 3), 2D), array(double(p_size % 5), 1D))"), F.expr("array(1D, 2D)"), 2).alias("b"))
    return p.select("p_partkey", F.inline("b")).select("p_partkey", "beam", "unit", "score")
