"""Words attached to product mentions in dependency trees.

A sentence is one array of words, so heads, children and grandchildren are looked up inside the row and
nothing is shuffled before the final count. ``attachments_by_joins`` is the same in relational form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.session import materialize, merge_join, once

WORD = "struct<text:string,lemma:string,upos:string,deprel:string,head_id:int,id:int,children:array<int>>"
ROLES = ("head", "grandparent", "sibling", "child", "grandchild")


def with_children(tree: DataFrame) -> DataFrame:
    """Adds the ids of each word's dependents, from head_id alone. Column ``toks`` holds one sentence's words in order."""
    return tree.withColumn("toks", F.expr("transform(toks, w -> struct(w.text, w.lemma, w.upos, w.deprel, w.head_id, w.id, transform(filter(toks, c -> c.head_id = w.id), c -> c.id) AS children))"))


def sentence_rows(parsed: DataFrame, tree: str = "full_tree") -> DataFrame:
    """Entries with all words in one array to one row per sentence: (entry columns, sent_id, toks)."""
    keep = [c for c in parsed.columns if c != tree]
    ids = parsed.select(*keep, tree, F.explode(F.array_distinct(F.transform(tree, lambda w: w["sent_id"]))).alias("sent_id"))
    return ids.select(*keep, "sent_id", F.expr(f"array_sort(filter({tree}, w -> w.sent_id = sent_id), (a, b) -> a.id - b.id)").alias("toks"))


def mentions(sent: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """One row per mention: adds ``m`` (the word), ``model`` and ``mids`` (ids of all mentions in the sentence)."""
    found = F.filter(F.transform("toks", lambda w: F.struct(w.alias("w"), X.canonical(w["text"], patterns).alias("model"))), lambda x: x["model"].isNotNull())
    marked = once(sent, found=found).where("size(found) > 0")
    keep = [F.col(c) for c in sent.columns]
    return marked.select(*keep, F.transform("found", lambda x: x["w"]["id"]).alias("mids"), F.inline("found").alias("m", "model"))


def attachments(sent: DataFrame, one_hop: bool = True, inferred: str | None = None, generic_only: bool = False, compat: bool = False, patterns: dict[str, str] | None = None) -> DataFrame:
    """(entry columns, sent_id, model, role, word, upos). Words are lower case; ``compat`` keeps the head's case and wraps head 0 to the last word.

    ``inferred`` names an array whose first element overrides the model, for every mention or for generic ones only.
    A word that is itself a mention is never attached, and a head that is one hides what lies behind it.
    """
    keep = [c for c in sent.columns if c not in ("toks",)]
    m = mentions(sent, patterns)
    if inferred:
        first = F.get(inferred, F.lit(0))
        m = m.withColumn("model", F.coalesce(F.when(F.col("model") == "chatgpt", first) if generic_only else first, "model"))
    last = "element_at(toks, -1)" if compat else "null"
    free = "not array_contains(mids, {}.id)"
    m = once(m, h=F.expr(f"if(m.deprel = 'root', null, if(m.head_id > 0, get(toks, m.head_id - 1), {last}))"))
    m = once(m, kids=F.expr(f"filter(transform(m.children, c -> get(toks, c - 1)), k -> {free.format('k')})"))
    m = m.withColumn("h", F.expr(f"if({free.format('h')}, h, null)"))
    kids = "kids"
    as_row = lambda role, e, low=True: f"transform({e}, w -> struct(model AS model, '{role}' AS role, {'lower(w.lemma)' if low else 'w.lemma'} AS word, w.upos AS upos))"
    parts = [as_row("head", "filter(array(h), w -> w is not null)", not compat), as_row("child", kids)]
    if one_hop:
        gp = f"filter(array(if(h.deprel = 'root', null, if(h.head_id > 0, get(toks, h.head_id - 1), {last}))), w -> w is not null and {free.format('w')})"
        sib = f"filter(transform(coalesce(h.children, array()), c -> get(toks, c - 1)), w -> w.id <> m.id and {free.format('w')})"
        grand = f"flatten(transform({kids}, k -> filter(transform(k.children, c -> get(toks, c - 1)), w -> {free.format('w')})))"
        parts += [as_row("grandparent", gp), as_row("sibling", sib), as_row("grandchild", grand)]
    # the model travels inside the generated rows
    return m.select(*keep, F.inline(F.expr(f"concat({', '.join(parts)})")).alias("model", "role", "word", "upos")).where("word is not null")


def attachments_by_joins(words: DataFrame, key: list[str], one_hop: bool = True) -> DataFrame:
    """Relational twin over word rows (key columns, id, head_id, deprel, text, lemma, upos), for sentences of any length: two
    joins find heads and children, two more what lies behind them."""
    w = words.withColumn("model", X.canonical(F.col("text")))
    m = w.where("model is not null").select(*key, F.col("id").alias("m_id"), F.col("head_id").alias("m_head"), F.col("deprel").alias("m_rel"), "model")
    free = w.where("model is null").select(*key, "id", "head_id", F.when(F.expr("deprel <> 'root' and head_id > 0"), F.col("head_id")).alias("up"), F.lower("lemma").alias("word"), "upos")
    at = lambda c: free.withColumn("at", F.col(c))
    kid = merge_join(m.withColumn("at", F.col("m_id")), at("head_id"), [*key, "at"]).withColumn("role", F.lit("child")).withColumn("up", F.lit(None).cast(free.schema["up"].dataType))
    head = merge_join(m.where("m_rel <> 'root' and m_head > 0").withColumn("at", F.col("m_head")), at("id"), [*key, "at"]).withColumn("role", F.lit("head"))
    near = head.unionByName(kid, allowMissingColumns=True).select(*key, "model", "role", "word", "upos", "id", "m_id", "up")
    out = [*key, "model", "role", "word", "upos"]
    if one_hop:
        near = materialize(near, "attached")
        above = near.select(*key, "model", F.lit("grandparent").alias("role"), F.col("up").alias("at")).where("at is not null")
        beside = near.select(*key, "model", F.when(F.col("role") == "head", "sibling").otherwise("grandchild").alias("role"), F.col("id").alias("at"), "m_id")
        far = merge_join(above, at("id"), [*key, "at"]).select(*out)
        return near.select(*out).unionByName(far).unionByName(merge_join(beside, at("head_id"), [*key, "at"]).where("role = 'grandchild' or id <> m_id").select(*out)).where("word is not null")
    return near.select(*out).where("word is not null")


def triples(sent: DataFrame) -> DataFrame:
    """(entry columns, head, deprel, word) of every word; head 0 is ROOT."""
    keep = [c for c in sent.columns if c != "toks"]
    return sent.select(*keep, F.expr("explode(transform(toks, w -> struct(if(w.head_id = 0, 'ROOT', get(toks, w.head_id - 1).text) AS head, w.deprel AS deprel, w.text AS word)))").alias("t")).select(*keep, "t.*")


def surfaces(sent: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    return mentions(sent, patterns).groupBy("model", F.col("m.text").alias("surface")).agg(F.count(F.lit(1)).alias("n"))


def missing_trees(parsed: DataFrame, tree: str = "full_tree") -> DataFrame:
    return parsed.where(F.coalesce(F.size(tree), F.lit(0)) <= 0).select("id")
