"""Entity tags: schemes, spans, and scores.

Rows are (sentence, pos, tag); every operator is a window over one sentence or an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(sent: str, pos: str) -> Window:
    return Window.partitionBy(sent).orderBy(pos)


def kind(tag: Column) -> Column:
    """The type behind a B-, I-, E- or S- prefix; the whole tag without one."""
    return F.regexp_replace(tag, "^[BIES]-", "")


def to_bio2(df: DataFrame, sent: str = "sent", pos: str = "pos", tag: str = "tag") -> DataFrame:
    """An I that starts an entity, after O or another type, becomes B."""
    before, t = F.lag(tag).over(_order(sent, pos)), F.col(tag)
    new = t.startswith("I-") & (before.isNull() | (before == "O") | (kind(before) != kind(t)))
    return df.withColumn(tag, F.when(new, F.concat(F.lit("B-"), kind(t))).otherwise(t))


def basic_to_bio(df: DataFrame, sent: str = "sent", pos: str = "pos", tag: str = "tag") -> DataFrame:
    before, t = F.lag(tag).over(_order(sent, pos)), F.col(tag)
    return df.withColumn(tag, F.when(t == "O", t).when(before == t, F.concat(F.lit("I-"), t)).otherwise(F.concat(F.lit("B-"), t)))


def bio2_to_bioes(df: DataFrame, sent: str = "sent", pos: str = "pos", tag: str = "tag") -> DataFrame:
    """The last tag of an entity becomes E or S; whether the next tag is an I decides, its type does not."""
    after, t = F.lead(tag).over(_order(sent, pos)), F.col(tag)
    more = F.coalesce(after.startswith("I-"), F.lit(False))
    out = F.when(t.startswith("B-") & ~more, F.concat(F.lit("S-"), kind(t))).when(t.startswith("I-") & ~more, F.concat(F.lit("E-"), kind(t))).otherwise(t)
    return df.withColumn(tag, out)


def scheme(df: DataFrame, tag: str = "tag") -> DataFrame:
    """One row: whether all tags are plain types, or all O, B- and I-."""
    t = F.col(tag)
    return df.agg(F.coalesce(F.bool_and((t == "O") | ~t.rlike("^[BIES]-")), F.lit(True)).alias("basic"), F.coalesce(F.bool_and((t == "O") | t.rlike("^[BI]-")), F.lit(True)).alias("bio"))


def process_tags(df: DataFrame, target: str = "bioes", sent: str = "sent", pos: str = "pos", tag: str = "tag") -> DataFrame:
    """To ``bio`` or ``bioes`` from whatever scheme the whole corpus is in. Null and _ tags are refused."""
    bad = F.col(tag).isNull() | (F.col(tag) == "_")
    df = df.withColumn(tag, F.when(bad, F.raise_error("a tag is missing").cast("string")).otherwise(F.col(tag)))
    found = scheme(df, tag).first()
    if found.basic:
        df = basic_to_bio(df, sent, pos, tag)
    elif found.bio:
        df = to_bio2(df, sent, pos, tag)
    return bio2_to_bioes(df, sent, pos, tag) if target == "bioes" and (found.basic or found.bio) else df


def entity_spans(df: DataFrame, sent: str = "sent", pos: str = "pos", tag: str = "tag") -> DataFrame:
    """(sent, begin, end, type), both ends included, from BIOES tags. I and E may open a span; the last tag names the type."""
    t = F.coalesce(F.col(tag), F.lit("O"))
    before = F.lag(t).over(_order(sent, pos))
    opens = t.rlike("^[BS]-") | (t.rlike("^[IE]-") & (before.isNull() | (before == "O") | before.rlike("^[ES]-")))
    rows = df.select(sent, pos, t.alias("_t"), opens.cast("int").alias("_o")).withColumn("_i", F.sum("_o").over(_order(sent, pos)))
    return rows.where(F.col("_t").rlike("^[BIES]-")).groupBy(sent, "_i").agg(F.min(pos).alias("begin"), F.max(pos).alias("end"), F.max_by(kind(F.col("_t")), pos).alias("type")).drop("_i")


def prf(tp: Column, n_pred: Column, n_gold: Column) -> list[Column]:
    z = F.lit(0.0)
    return [F.coalesce(F.try_divide(tp, n_pred), z).alias("precision"), F.coalesce(F.try_divide(tp, n_gold), z).alias("recall"), F.coalesce(F.try_divide(2 * tp, n_pred + n_gold), z).alias("f1")]


def entity_scores(pred: DataFrame, gold: DataFrame, sent: str = "sent", pos: str = "pos", tag: str = "tag") -> DataFrame:
    """Per type: spans in both, predicted and gold. ``micro`` sums them up."""
    p, g = (entity_spans(x, sent, pos, tag) for x in (pred, gold))
    both = p.withColumn("p", F.lit(1)).join(g.withColumn("g", F.lit(1)), [sent, "begin", "end", "type"], "full")
    return both.groupBy("type").agg(*(F.sum(F.coalesce(c, F.lit(0))).cast("bigint").alias(n) for c, n in ((F.col("p") * F.col("g"), "correct"), (F.col("p"), "predicted"), (F.col("g"), "gold"))))


def micro(per_type: DataFrame) -> DataFrame:
    s = per_type.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("correct", "predicted", "gold")))
    return s.select(*prf(F.col("correct"), F.col("predicted"), F.col("gold")))


def confusion(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    return df.groupBy(gold, pred).agg(F.count(F.lit(1)).alias("n"))


def token_confusion(pred: DataFrame, gold: DataFrame, sent: str = "sent", pos: str = "pos", tag: str = "tag", types_only: bool = False) -> DataFrame:
    """(gold, pred, n) over token positions; ``types_only`` strips the prefixes first."""
    t = kind(F.col(tag)) if types_only else F.col(tag)
    p = pred.select(sent, pos, t.alias("pred"))
    return confusion(gold.select(sent, pos, t.alias("gold")).join(p, [sent, pos]))


def token_scores(conf: DataFrame) -> DataFrame:
    """Micro scores over (gold, pred, n), pairs of O left out of all counts."""
    hit = (F.col("gold") == F.col("pred")) & (F.col("gold") != "O")
    s = conf.agg(*(F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(k) for c, k in ((hit, "correct"), (F.col("pred") != "O", "predicted"), (F.col("gold") != "O", "gold"))))
    return s.select(*prf(F.col("correct"), F.col("predicted"), F.col("gold")))


def condense(conf: DataFrame) -> DataFrame:
    """Labels merged by what follows their first hyphen."""
    short = lambda c: F.when(F.col(c).contains("-"), F.regexp_replace(c, "^[^-]*-", "")).otherwise(F.col(c))
    return conf.select(short("gold").alias("gold"), short("pred").alias("pred"), "n").groupBy("gold", "pred").agg(F.sum("n").alias("n"))


def row_percent(conf: DataFrame) -> DataFrame:
    total = conf.groupBy("gold").agg(F.sum("n").alias("all"))
    return conf.join(F.broadcast(total), "gold").select("gold", "pred", F.round(100 * F.col("n") / F.col("all"), 2).alias("percent"))


def confusion_table(conf: DataFrame, labels: list[str]) -> DataFrame:
    """One column for each label, missing pairs as 0; the label list is explicit so no extra job looks for it."""
    return conf.groupBy("gold").pivot("pred", labels).agg(F.sum("n")).na.fill(0)


def accuracy(conf: DataFrame) -> DataFrame:
    return conf.agg((F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))


def class_scores(conf: DataFrame) -> DataFrame:
    """(label, precision, recall, f1) of every label on either side."""
    rows = conf.select(F.explode(F.array(F.struct(F.col("gold").alias("label"), F.col("n").alias("g"), F.lit(0).cast("bigint").alias("p"), F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("pred").alias("label"), F.lit(0).cast("bigint").alias("g"), F.col("n").alias("p"), F.lit(0).cast("bigint").alias("tp")))).alias("x")).select("x.*")
    s = rows.groupBy("label").agg(*(F.sum(c).alias(c) for c in ("g", "p", "tp")))
    return s.select("label", *prf(F.col("tp"), F.col("p"), F.col("g")))


def macro_f1(conf: DataFrame) -> DataFrame:
    return class_scores(conf).agg(F.avg("f1").alias("macro_f1"))


def missing_tags(known: DataFrame, used: DataFrame, tag: str = "tag") -> DataFrame:
    return used.select(tag).where(f"{tag} is not null").distinct().join(known.select(tag), tag, "left_anti").orderBy(tag)


def remap(tag: Column, table: dict[str, str]) -> Column:
    """The mapped tag, or the tag itself where it is not in the table."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[tag], tag) if table else tag


def remap_contained(tag: Column, table: dict[str, str]) -> Column:
    """The first entry that the tag contains is replaced inside it."""
    out = tag
    for old, new in reversed(table.items()):
        out = F.when(tag.contains(old), F.replace(tag, F.lit(old), F.lit(new))).otherwise(out)
    return out


def boundary_scores(df: DataFrame, sent: str = "sent", pos: str = "pos", pred: str = "pred", gold: str = "gold") -> DataFrame:
    """F1 of labelled boundaries: a boundary counts if both sides put the same label there and last met at the same place."""
    w = _order(sent, pos).rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.coalesce(F.last(F.when(F.col(c) > 0, F.col(pos)), ignorenulls=True).over(w), F.lit(-1))
    rows = df.select(pred, gold, (last(pred) == last(gold)).alias("same"))
    p, g = F.col(pred) > 0, F.col(gold) > 0
    tp = p & (F.col(pred) == F.col(gold)) & F.col("same")
    s = rows.agg(F.count_if(tp).alias("tp"), F.count_if(p & ~tp).alias("fp"), F.count_if(g & ~tp).alias("fn"))
    return s.select("tp", "fp", "fn", F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)).alias("f1"))


def bsf_tags(text: Column, tag: Column, style: str = "beios") -> Column:
    """An entity's words with their tags, as (word, tag); ``beios`` or ``iob``."""
    w = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    n = F.size(w)
    mark = (lambda i: F.when(n == 1, "S-").when(i == 0, "B-").when(i == n - 1, "E-").otherwise("I-")) if style == "beios" else (lambda i: F.when(i == 0, "B-").otherwise("I-"))
    return F.transform(w, lambda x, i: F.struct(x.alias("word"), F.concat(mark(i), tag).alias("tag")))
