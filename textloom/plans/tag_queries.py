"""Queries on tags and confusions. Tags are derived from order lines: an order is a sentence, a line a token."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import tags as T
from textloom.plans.registry import query
from textloom.session import table

_KIND = "CASE WHEN l_returnflag = 'R' THEN 'LOC' WHEN l_linestatus = 'O' THEN 'PER' ELSE 'ORG' END"
_BASIC = f"CASE WHEN l_quantity < 15 THEN 'O' ELSE {_KIND} END"
_BIO = f"CASE WHEN l_quantity < 15 THEN 'O' WHEN l_linenumber % 3 = 0 THEN concat('B-', {_KIND}) ELSE concat('I-', {_KIND}) END"
_PRED = f"CASE WHEN l_quantity < 12 OR l_quantity > 45 THEN 'O' WHEN l_linenumber % 3 = 0 THEN concat('B-', {_KIND}) ELSE concat('I-', {_KIND}) END"


def _rows(tag, name="t"):
    return f"{name} AS (SELECT l_orderkey AS sent, l_linenumber AS pos, {tag} AS tag FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_linestatus FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity, l_returnflag, l_linestatus) = 1))"


def _bio2(src, out):
    return f"""{out} AS (SELECT sent, pos, CASE WHEN tag LIKE 'I-%' AND (p IS NULL OR p = 'O' OR substr(p, 3) <> substr(tag, 3)) THEN 'B-' || substr(tag, 3) ELSE tag END AS tag
FROM (SELECT *, lag(tag) OVER (PARTITION BY sent ORDER BY pos) AS p FROM {src}))"""


def _bioes(src, out):
    return f"""{out} AS (SELECT sent, pos, CASE WHEN tag LIKE 'B-%' AND NOT coalesce(n LIKE 'I-%', false) THEN 'S-' || substr(tag, 3) WHEN tag LIKE 'I-%' AND NOT coalesce(n LIKE 'I-%', false) THEN 'E-' || substr(tag, 3) ELSE tag END AS tag
FROM (SELECT *, lead(tag) OVER (PARTITION BY sent ORDER BY pos) AS n FROM {src}))"""


def _spans(src, out):
    return f"""{out} AS (SELECT sent, min(pos) AS "begin", max(pos) AS "end", arg_max(substr(tag, 3), pos) AS type FROM (
  SELECT *, sum(o) OVER (PARTITION BY sent ORDER BY pos) AS i FROM (
    SELECT *, CASE WHEN tag LIKE 'B-%' OR tag LIKE 'S-%' OR ((tag LIKE 'I-%' OR tag LIKE 'E-%') AND (p IS NULL OR p = 'O' OR p LIKE 'E-%' OR p LIKE 'S-%')) THEN 1 ELSE 0 END AS o
    FROM (SELECT *, lag(tag) OVER (PARTITION BY sent ORDER BY pos) AS p FROM {src}))) WHERE tag <> 'O' GROUP BY sent, i)"""


def _tags(spark, sf_dir, expr):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
    one = line.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_quantity", "l_returnflag", "l_linestatus")).alias("x")).select("l_orderkey", "l_linenumber", "x.*")
    return one.selectExpr("l_orderkey AS sent", "l_linenumber AS pos", f"{expr} AS tag")


_CHAIN = ",\n".join([_rows(_BIO), _bio2("t", "b2"), _bioes("b2", "be"), _spans("be", "sp")])
_PAIR = _CHAIN + ",\n" + ",\n".join([_rows(_PRED, "pt"), _bio2("pt", "pb2"), _bioes("pb2", "pbe"), _spans("pbe", "psp")])


def _bioes_tags(spark, sf_dir, expr=_BIO):
    return T.bio2_to_bioes(T.to_bio2(_tags(spark, sf_dir, expr)))


@query("bio_to_bio2", f"WITH {_rows(_BIO)}, {_bio2('t', 'b2')} SELECT * FROM b2")
def bio_to_bio2(spark, sf_dir):
    return T.to_bio2(_tags(spark, sf_dir, _BIO))


@query("bio2_to_bioes", f"WITH {_rows(_BIO)}, {_bio2('t', 'b2')}, {_bioes('b2', 'be')} SELECT * FROM be")
def bio2_to_bioes(spark, sf_dir):
    return _bioes_tags(spark, sf_dir)


@query("basic_to_bio", f"WITH {_rows(_BASIC)} SELECT sent, pos, CASE WHEN tag = 'O' THEN tag WHEN lag(tag) OVER (PARTITION BY sent ORDER BY pos) = tag THEN 'I-' || tag ELSE 'B-' || tag END AS tag FROM t")
def basic_to_bio(spark, sf_dir):
    return T.basic_to_bio(_tags(spark, sf_dir, _BASIC))


@query("tag_scheme", f"WITH {_rows(_BIO)} SELECT bool_and(tag = 'O' OR NOT regexp_matches(tag, '^[BIES]-')) AS basic, bool_and(tag = 'O' OR regexp_matches(tag, '^[BI]-')) AS bio FROM t")
def tag_scheme(spark, sf_dir):
    return T.scheme(_tags(spark, sf_dir, _BIO))


@query("process_tags", f"WITH {_rows(_BASIC, 't0')}, t AS (SELECT sent, pos, CASE WHEN tag = 'O' THEN tag WHEN lag(tag) OVER (PARTITION BY sent ORDER BY pos) = tag THEN 'I-' || tag ELSE 'B-' || tag END AS tag FROM t0), {_bioes('t', 'be')} SELECT * FROM be")
def process_tags(spark, sf_dir):
    return T.process_tags(_tags(spark, sf_dir, _BASIC))


@query("entity_spans", f"WITH {_CHAIN} SELECT * FROM sp")
def entity_spans(spark, sf_dir):
    return T.entity_spans(_bioes_tags(spark, sf_dir))


_NER = f"""WITH {_PAIR}, x AS (SELECT coalesce(g.type, p.type) AS type, (g.type IS NOT NULL)::INT AS g, (p.type IS NOT NULL)::INT AS p FROM sp g FULL JOIN psp p ON g.sent = p.sent AND g."begin" = p."begin" AND g."end" = p."end" AND g.type = p.type),
y AS (SELECT type, CAST(sum(g * p) AS BIGINT) AS correct, CAST(sum(p) AS BIGINT) AS predicted, CAST(sum(g) AS BIGINT) AS gold FROM x GROUP BY type)"""
_MICRO = "SELECT sum(correct) / sum(predicted)::DOUBLE AS precision, sum(correct) / sum(gold)::DOUBLE AS recall, 2 * sum(correct) / (sum(predicted) + sum(gold))::DOUBLE AS f1 FROM {}"


@query("ner_entity_by_type", _NER + " SELECT * FROM y")
def ner_entity_by_type(spark, sf_dir):
    return T.entity_scores(_bioes_tags(spark, sf_dir, _PRED), _bioes_tags(spark, sf_dir))


@query("ner_entity_f1", _NER + _MICRO.format("y"))
def ner_entity_f1(spark, sf_dir):
    return T.micro(ner_entity_by_type(spark, sf_dir))


_TOKEN = f"WITH {_PAIR}, c AS (SELECT g.tag AS gold, p.tag AS pred, count(*) AS n FROM be g JOIN pbe p ON g.sent = p.sent AND g.pos = p.pos GROUP BY ALL)"


def _token_confusion(spark, sf_dir):
    return T.token_confusion(_bioes_tags(spark, sf_dir, _PRED), _bioes_tags(spark, sf_dir))


@query("ner_token_confusion", _TOKEN + " SELECT * FROM c")
def ner_token_confusion(spark, sf_dir):
    return _token_confusion(spark, sf_dir)


@query("ner_token_f1", _TOKEN + ", y AS (SELECT sum(CASE WHEN gold = pred AND gold <> 'O' THEN n ELSE 0 END) AS correct, sum(CASE WHEN pred <> 'O' THEN n ELSE 0 END) AS predicted, sum(CASE WHEN gold <> 'O' THEN n ELSE 0 END) AS gold FROM c) " + _MICRO.format("y"))
def ner_token_f1(spark, sf_dir):
    return T.token_scores(_token_confusion(spark, sf_dir))


# --- confusions of two columns ---
_MODE = "(CASE l_suppkey % 4 WHEN 0 THEN 'AIR' WHEN 1 THEN 'MAIL' WHEN 2 THEN 'SHIP' ELSE 'REG AIR' END)"
_GOLD, _GUESS = f"concat('x-', {_MODE})", f"concat(CASE WHEN l_quantity % 2 = 0 THEN 'x-' ELSE 'y-' END, CASE WHEN l_linenumber % 4 = 0 THEN 'AIR' ELSE {_MODE} END)"
_CONF = f"WITH c AS (SELECT {_GOLD} AS gold, {_GUESS} AS pred, count(*) AS n FROM lineitem GROUP BY ALL), s AS (SELECT regexp_replace(gold, '^[^-]*-', '') AS gold, regexp_replace(pred, '^[^-]*-', '') AS pred, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ALL)"


def _confusion(spark, sf_dir):
    return T.confusion(table(spark, sf_dir, "lineitem").selectExpr(f"{_GOLD} AS gold", f"{_GUESS} AS pred"))


@query("confusion_counts", _CONF + " SELECT * FROM c")
def confusion_counts(spark, sf_dir):
    return _confusion(spark, sf_dir)


@query("confusion_condensed", _CONF + " SELECT * FROM s")
def confusion_condensed(spark, sf_dir):
    return T.condense(_confusion(spark, sf_dir))


@query("confusion_row_pct", _CONF + " SELECT gold, pred, round(100.0 * n / sum(n) OVER (PARTITION BY gold), 2)::DOUBLE AS percent FROM s")
def confusion_row_pct(spark, sf_dir):
    return T.row_percent(T.condense(_confusion(spark, sf_dir)))


@query("confusion_table", _CONF + " SELECT gold, " + ", ".join(f"CAST(coalesce(sum(n) FILTER (pred = '{x}'), 0) AS BIGINT) AS \"{x}\"" for x in ("AIR", "MAIL", "REG AIR", "SHIP")) + " FROM s GROUP BY gold")
def confusion_table(spark, sf_dir):
    return T.confusion_table(T.condense(_confusion(spark, sf_dir)), ["AIR", "MAIL", "REG AIR", "SHIP"])


@query("class_scores", _CONF + """, l AS (SELECT gold AS label FROM s UNION SELECT pred FROM s),
x AS (SELECT label, coalesce((SELECT sum(n) FROM s WHERE gold = label AND pred = label), 0) AS tp, coalesce((SELECT sum(n) FROM s WHERE pred = label), 0) AS p, coalesce((SELECT sum(n) FROM s WHERE gold = label), 0) AS g FROM l)
SELECT label, coalesce(tp / nullif(p, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(g, 0), 0)::DOUBLE AS recall, coalesce(2 * tp / nullif(p + g, 0), 0)::DOUBLE AS f1 FROM x""")
def class_scores(spark, sf_dir):
    return T.class_scores(T.condense(_confusion(spark, sf_dir)))


@query("accuracy_macro_f1", _CONF + """, l AS (SELECT gold AS label FROM s UNION SELECT pred FROM s),
x AS (SELECT label, coalesce((SELECT sum(n) FROM s WHERE gold = label AND pred = label), 0) AS tp, coalesce((SELECT sum(n) FROM s WHERE pred = label), 0) AS p, coalesce((SELECT sum(n) FROM s WHERE gold = label), 0) AS g FROM l)
SELECT (SELECT sum(CASE WHEN gold = pred THEN n ELSE 0 END) / sum(n) FROM s)::DOUBLE AS accuracy, round((SELECT avg(coalesce(2 * tp / nullif(p + g, 0), 0)) FROM x)::DOUBLE, 9) AS macro_f1""")
def accuracy_macro_f1(spark, sf_dir):
    c = T.condense(_confusion(spark, sf_dir))
    return T.accuracy(c).join(F.broadcast(T.macro_f1(c).select(F.round("macro_f1", 9).alias("macro_f1"))), F.lit(True))


@query("label_remap", f"SELECT CASE {_MODE} WHEN 'AIR' THEN 'FLY' WHEN 'REG AIR' THEN 'FLY' ELSE {_MODE} END AS label, count(*) AS n FROM lineitem GROUP BY ALL")
def label_remap(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(T.remap(F.expr(_MODE), {"AIR": "FLY", "REG AIR": "FLY"}).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("label_remap_contained", f"SELECT CASE WHEN contains({_MODE}, 'AIR') THEN replace({_MODE}, 'AIR', 'FLY') WHEN contains({_MODE}, 'A') THEN replace({_MODE}, 'A', '4') ELSE {_MODE} END AS label, count(*) AS n FROM lineitem GROUP BY ALL")
def label_remap_contained(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(T.remap_contained(F.expr(_MODE), {"AIR": "FLY", "A": "4"}).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("missing_tags", f"SELECT DISTINCT {_MODE} AS tag FROM lineitem WHERE {_MODE} NOT IN (SELECT {_MODE} FROM lineitem WHERE l_suppkey % 4 = 1)")
def missing_tags(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").withColumn("tag", F.expr(_MODE))
    return T.missing_tags(line.where("l_suppkey % 4 = 1"), line)


@query("boundary_f1", """
WITH r AS (SELECT l_orderkey AS sent, l_linenumber AS pos, max(l_quantity::INT % 3) AS gold, max((l_quantity::INT + (l_linenumber % 5 = 0)::INT) % 3) AS pred FROM lineitem GROUP BY ALL),
w AS (SELECT *, coalesce(max(CASE WHEN gold > 0 THEN pos END) OVER p, -1) = coalesce(max(CASE WHEN pred > 0 THEN pos END) OVER p, -1) AS same FROM r WINDOW p AS (PARTITION BY sent ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT count(*) FILTER (pred > 0 AND pred = gold AND same) AS tp, count(*) FILTER (pred > 0 AND NOT (pred = gold AND same)) AS fp, count(*) FILTER (gold > 0 AND NOT (pred = gold AND same)) AS fn FROM w)
SELECT tp, fp, fn, 2.0 * tp / (2 * tp + fp + fn) AS f1 FROM s""".replace("2.0 * tp /", "2 * tp::DOUBLE /"))
def boundary_f1(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS sent", "l_linenumber AS pos", "int(l_quantity) % 3 AS g", "(int(l_quantity) + int(l_linenumber % 5 = 0)) % 3 AS p")
    return T.boundary_scores(r.groupBy("sent", "pos").agg(F.max("g").alias("gold"), F.max("p").alias("pred")))
