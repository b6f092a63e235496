"""Readers and writers. Every reader takes a path (or several) and keeps the file splittable where its format allows."""

from __future__ import annotations

import lzma
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = (
    "type string, id string, link_id string, parent_id string, title string, selftext string, body string, author string, author_flair_text string, created_utc bigint, created_date string, subreddit string, score bigint, edited string, "
    "distinguished string, stickied boolean, permalink string, is_submitter boolean, controversiality int, gilded int, name string, full_link string, models_detected array<string>, model_inferred_temporal array<string>"
)
WORD = "struct<text:string,lemma:string,upos:string,xpos:string,deprel:string,feats:string,head_id:int,id:int,children:array<int>,sent_id:int>"
PARSED = f"{ENTRY}, cleaned_text string, dependency_parse struct<usable_text:string,full_tree:array<{WORD}>,num_tokens:int,num_words:int,num_sentences:int>"
SUMMARY = "word string, total_count bigint, majority_upos string, majority_count bigint, majority_model string, majority_model_count bigint, model_freqs map<string,bigint>"
BREAKDOWN = "word string, counts map<string,bigint>, models map<string,bigint>"
MATCHES = "model string, matches map<string,bigint>"


def read_ndjson(spark: SparkSession, path, schema: str = ENTRY) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the lines that are no records (_corrupt). Unknown fields are ignored, nothing is inferred."""
    how = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    df = spark.read.text(path).where("trim(value) <> ''").select("value", F.from_json("value", f"{schema}, _corrupt string", how).alias("r"))
    return df.where("r._corrupt is null").select("r.*").drop("_corrupt"), df.where("r._corrupt is not null").select(F.col("value").alias("_corrupt"))


def write_ndjson(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def write_results(df: DataFrame, out: str, skipped: str, ids: str, failed: str = "dependency_parse is null", mode: str = "append") -> None:
    """Results, failures and the ids of results to three places, each by its own filter."""
    df.where(f"not ({failed})").write.mode(mode).json(out)
    df.where(failed).write.mode(mode).json(skipped)
    df.where(f"not ({failed})").select("id").where("id is not null").write.mode(mode).text(ids)


def read_pretty(spark: SparkSession, path, schema: str = SUMMARY) -> DataFrame:
    """Indented objects one after the other, which a JSON reader takes for one record: cut where one ends and the next begins."""
    text = spark.read.text(path, wholetext=True)
    one = text.select(F.explode(F.split("value", r"(?<=\n {0,8}\})\s*(?=\{|$)")).alias("v")).where("trim(v) <> ''")
    return one.select(F.from_json("v", schema).alias("r")).select("r.*")


def write_pretty(df: DataFrame, path: str, mode: str = "append") -> None:
    """One indented object after the other."""
    df.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).write.mode(mode).text(path)


def write_by_value(df: DataFrame, path: str, column: str, mode: str = "overwrite") -> None:
    """One folder for each value, - and . as _ in its name."""
    df.withColumn(f"{column}_slug", F.translate(column, "-.", "__")).write.mode(mode).partitionBy(f"{column}_slug").json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_lines(df: DataFrame, path: str, column: str, mode: str = "overwrite") -> None:
    """Distinct values, sorted over all parts, one a line."""
    df.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct().orderBy("value").write.mode(mode).text(path)


def read_ids(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''").distinct()


def read_blocks(spark: SparkSession, path) -> DataFrame:
    """Blank-line separated blocks, such as CoNLL-U sentences: (file, value). Splittable."""
    df = spark.read.option("lineSep", "\n\n").text(path)
    return df.select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"^\n+|\n+$", "").alias("value")).where("trim(value) <> ''")


def read_ordered_blocks(spark: SparkSession, path) -> DataFrame:
    """Blocks of whole files with their number in the file: (name, sent, value); the name is that of the file without its folder."""
    df = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]*)$", 1).alias("name"), "value")
    pieces = F.filter(F.split("value", "\r?\n(?:[ \t]*\r?\n)+"), lambda b: F.trim(b) != "")
    return df.select("name", F.posexplode(F.transform(pieces, lambda b: F.regexp_replace(b, "^\n+|\n+$", ""))).alias("sent", "value"))


def write_blocks(df: DataFrame, path: str, column: str = "value", mode: str = "overwrite") -> None:
    df.select(F.col(column).alias("value")).write.mode(mode).option("lineSep", "\n\n").text(path)


def read_tagged(spark: SparkSession, path, docstart: bool = False, ordered: bool = False) -> DataFrame:
    """Token-per-line entity files of 2 to 5 columns: (file, sent, pos, token, tag) with the first and last column.

    A sentence's number is unique but follows the splits of the files; ``ordered`` reads whole files and numbers the sentences of each from 0.
    """
    if ordered:
        b = read_ordered_blocks(spark, path).withColumnRenamed("name", "file")
    else:
        b = read_blocks(spark, path).withColumn("sent", F.monotonically_increasing_id())
    b = b if docstart else b.withColumn("value", F.trim(F.regexp_replace("value", r"(?m)^-DOCSTART-.*\n?", ""))).where("value <> ''")
    rows = b.select("file", "sent", F.posexplode(F.split("value", "\n")).alias("pos", "l")).withColumn("c", F.split(F.trim("l"), r"\t| +"))
    return rows.where("size(c) > 1").select("file", "sent", "pos", F.get("c", F.lit(0)).alias("token"), F.element_at("c", -1).alias("tag"))


def read_two_columns(spark: SparkSession, path) -> DataFrame:
    """Blocks in which every line has exactly two fields; others are dropped whole."""
    b = read_blocks(spark, path)
    return b.where(F.forall(F.split("value", "\n"), lambda l: F.size(F.split(F.trim(l), r"\s+")) == 2))


def to_ner_json(tagged: DataFrame) -> DataFrame:
    """One JSON array of {text, ner} for each sentence."""
    w = F.array_sort(F.collect_list(F.struct("pos", F.struct(F.col("token").alias("text"), F.col("tag").alias("ner")).alias("w"))))
    return tagged.groupBy("sent").agg(F.to_json(F.transform(w, lambda x: x["w"])).alias("value"))


def read_standoff(spark: SparkSession, path) -> DataFrame:
    """Entity annotations ``T9 PERS 778 783 text``: (file, ident, type, begin, end, text)."""
    df = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    p = r"^(T\d+)\s+(\S+)\s+(\d+)\s+(\d+)\s+(.*)$"
    return df.where(F.col("value").rlike(p)).select("file", *(F.regexp_extract("value", p, i).cast(t).alias(n) for i, (n, t) in enumerate((("ident", "string"), ("type", "string"), ("begin", "int"), ("end", "int"), ("text", "string")), 1)))


def read_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(word, vector): the last ``dim`` fields are the vector, what is before is the word. Plain text is split; xz is unpacked by file."""
    if path.endswith(".xz"):

        def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for c in b["content"]:
                    yield pd.DataFrame({"value": lzma.decompress(c).decode("utf-8", "replace").splitlines()})

        df = spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "value string")
    else:
        df = spark.read.text(path)
    f = df.select(F.split(F.trim("value"), r"[ \t]+").alias("f")).where(F.size("f") > dim)
    return f.select(F.array_join(F.slice("f", 1, F.size("f") - dim), " ").alias("word"), F.transform(F.slice("f", -dim, dim), lambda x: x.try_cast("float")).alias("vector"))


def write_vectors(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select(F.concat_ws(" ", "word", F.array_join(F.transform("vector", lambda x: x.cast("string")), " ")).alias("value")).write.mode(mode).text(path)


def read_properties(spark: SparkSession, path) -> DataFrame:
    """k=v lines; comments and lines without = are left out."""
    df = spark.read.text(path).select(F.trim("value").alias("v")).where("v not like '#%' and v like '%=%'").select(F.split("v", "=", 2).alias("p"))
    return df.select(F.trim(F.get("p", F.lit(0))).alias("key"), F.trim(F.get("p", F.lit(1))).alias("value"))


def write_properties(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select(F.concat_ws("=", "key", "value").alias("value")).write.mode(mode).text(path)


def read_labelled(spark: SparkSession, path, label: int, text: int, labels: dict[str, int], sep: str = ",", header: bool = True, quote: str = '"', encoding: str = "utf-8") -> DataFrame:
    """(label, text) of a delimited file; a label outside the table is an error, rows without text go."""
    df = spark.read.option("header", header).option("sep", sep).option("quote", quote).option("escape", '"').option("multiLine", quote != "").option("encoding", encoding).csv(path)
    c = [F.col(f"`{n}`") for n in df.columns]
    table = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    mapped = table[F.trim(c[label])]
    bad = F.raise_error(F.concat(F.lit("no such label: "), F.coalesce(c[label], F.lit("null")))).cast("int")
    return df.select(F.coalesce(mapped, bad).alias("label"), F.trim(c[text]).alias("text")).where("text <> ''")


def read_last_character_labels(spark: SparkSession, path) -> DataFrame:
    """Lines whose last character is the label 0 or 1, given as 0 and 2."""
    v = F.regexp_replace("value", r"\s+$", "")
    return spark.read.text(path).where("trim(value) <> ''").select(F.when(F.right(v, F.lit(1)) == "1", 2).otherwise(0).alias("label"), F.regexp_replace(F.substring(v, F.lit(1), F.length(v) - 1), r"^\s+|\s+$", "").alias("text"))


def read_xml(spark: SparkSession, path, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def read_trees(spark: SparkSession, path) -> DataFrame:
    """Whole files of bracketed trees: (file, tree_no, tree)."""
    from textloom.operators import trees as T

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, i, T.text_of(n)) for f, t in zip(b["file"], b["value"]) for i, n in enumerate(T.parse(t))]
            yield pd.DataFrame(rows, columns=["file", "tree_no", "tree"])

    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value").mapInPandas(run, "file string, tree_no int, tree string")


def tagged_sentence_files(text, root: str = "ROOT"):
    """A column of <s> ... </s> marked text as bracket text, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "<s>", f"({root} "), "</s>", ")"), r"\s+", " "))
