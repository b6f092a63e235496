"""Patterns over annotated sentences: dependency graphs and runs of tokens.

A graph pattern is a chain of nodes joined by relations, e.g. ``{upos:VERB} >nsubj {lemma:cat}=who``; it becomes
equi-joins on (sentence, head). ``>rel`` leads to a dependent, ``<rel`` to the head, without a name to any.
A run pattern such as ``{upos:DET} {upos:ADJ}* {upos:NOUN}`` becomes one regular expression over a sentence.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NODE = re.compile(r"\{([^}]*)\}(?:=(\w+))?")
_LINK = re.compile(r"\s*([<>])([\w:]*)\s*")


def _conditions(body: str) -> list[tuple[str, str, bool]]:
    out = []
    for part in filter(None, (p.strip() for p in body.split(";"))):
        name, value = (x.strip() for x in part.split(":", 1))
        out.append((name, value.strip("/"), value.startswith("/")))
    return out


def _where(df: DataFrame, body: str) -> DataFrame:
    for name, value, regex in _conditions(body):
        df = df.where(F.col(name).rlike(f"^(?:{value})$") if regex else F.col(name) == value)
    return df


def parse_graph(pattern: str) -> list[tuple[str, str, str, str | None]]:
    """(direction, relation, conditions, name) of each node, the first with an empty direction."""
    m = _NODE.match(pattern.strip())
    if not m:
        raise ValueError(f"no node at the start of {pattern}")
    out, text = [("", "", m.group(1), m.group(2))], pattern.strip()[m.end():]
    while text:
        k = _LINK.match(text)
        m = k and _NODE.match(text, k.end())
        if not m:
            raise ValueError(f"cannot read {text}")
        out.append((k.group(1), k.group(2), m.group(1), m.group(2)))
        text = text[m.end():].strip()
    return out


def match_graph(words: DataFrame, key: list[str], pattern: str) -> DataFrame:
    """(key..., n0, n1, ... or the given names): word ids of every match. words: key, id, head, deprel and the attributes used."""
    out, here = None, None
    for i, (way, rel, body, name) in enumerate(parse_graph(pattern)):
        col = name or f"n{i}"
        w = _where(words, body)
        if out is None:
            out = w.select(*key, F.col("id").alias(col), F.col("head").alias("_head"), F.col("deprel").alias("_rel"))
        else:
            nxt = w.select(*key, F.col("id").alias(col), F.col("head").alias("_h2"), F.col("deprel").alias("_r2"))
            if way == ">":
                nxt = nxt.where(F.col("_r2") == rel) if rel else nxt
                out = out.drop("_head", "_rel").join(nxt.withColumn(here, F.col("_h2")), [*key, here])
            else:
                out = (out.where(F.col("_rel") == rel) if rel else out).drop("_rel").join(nxt.withColumn("_head", F.col(col)), [*key, "_head"]).drop("_head")
            out = out.withColumnRenamed("_h2", "_head").withColumnRenamed("_r2", "_rel")
        here = col
    return out.drop("_head", "_rel")


def run_regex(pattern: str, attributes: list[str]) -> str:
    """The regular expression over tokens written as ``<attr1|attr2|...>``."""
    out, at = [], 0
    for m in re.finditer(r"\{([^}]*)\}([*+?]?)", pattern):
        if pattern[at : m.start()].strip():
            raise ValueError(f"cannot read {pattern[at:m.start()]}")
        at = m.end()
        c = {n: v if r else re.escape(v) for n, v, r in _conditions(m.group(1))}
        unknown = set(c) - set(attributes)
        if unknown:
            raise ValueError(f"not among the attributes: {sorted(unknown)}")
        out.append("(?:<" + r"\|".join(c.get(a, r"[^|<>]*") for a in attributes) + f">){m.group(2)}")
    return "".join(out)


def match_runs(tokens: Column, pattern: str, attributes: list[str]) -> Column:
    """Texts of all non-overlapping runs in an array of token structs; attributes must not hold < > or |."""
    first = attributes.index("text") if "text" in attributes else 0
    line = F.array_join(F.transform(tokens, lambda t: F.concat(F.lit("<"), F.concat_ws("|", *(F.coalesce(t[a], F.lit("")) for a in attributes)), F.lit(">"))), "")
    runs = F.regexp_extract_all(line, F.lit(run_regex(pattern, attributes)), F.lit(0))
    words = lambda r: F.transform(F.filter(F.split(r, "[<>]"), lambda x: x != ""), lambda x: F.split_part(x, F.lit("|"), F.lit(first + 1)))
    return F.transform(runs, lambda r: F.array_join(words(r), " "))
