"""Preparing treebanks for training: fixes of sentence blocks, checks, combined treebanks, punctuation copies.

A sentence is one CoNLL-U block as text (column ``value``) or word rows (see ``conllu``). Fixes are column
expressions on the block, so whole treebanks go through without leaving the JVM.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators import assembly as B
from textloom.operators import conllu as C

NO_SPACE = "SpaceAfter=No"


def _lines(block: Column) -> Column:
    return F.split(block, "\n")


def _joined(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def text_line(block: Column) -> Column:
    """Number of the first line that begins with ``# text``, from 0; -1 without one."""
    hit = F.transform(_lines(block), lambda x: x.startswith("# text"))
    return (F.array_position(hit, True) - 1).cast("int")


def _misc(line: Column, f) -> Column:
    """A word line with its last field rewritten."""
    cells = F.split(line, "\t")
    return F.array_join(F.concat(F.slice(cells, 1, F.size(cells) - 1), F.array(f(F.element_at(cells, -1)))), "\t")


def without_spaces(block: Column) -> Column:
    """Every word is marked as having no space after it; a last field that holds anything else is an error."""
    mark = lambda m: F.when(m == "_", NO_SPACE).when(m.contains(NO_SPACE), m).otherwise(F.raise_error(F.concat(F.lit("another mark in the last field: "), m)).cast("string"))
    return _joined(F.transform(_lines(block), lambda x: F.when(x.startswith("#"), x).otherwise(_misc(x, mark))))


def final_semicolon_to_period(block: Column) -> Column:
    """Where the text line ends in a semicolon, it and the last word become a period; a block without a text line is an error."""
    at = text_line(block)
    n = F.size(_lines(block))
    text = F.get(_lines(block), at)
    fixed = F.transform(_lines(block), lambda x, i: F.when(i == at, F.regexp_replace(x, ";$", ".")).when(i == n - 1, F.replace(x, F.lit(";"), F.lit("."))).otherwise(x))
    missing = F.raise_error("a sentence without a text line").cast("string")
    return F.when(at < 0, missing).when(text.endswith(";"), _joined(fixed)).otherwise(block)


# Sentence-final marks that the Arabic and Telugu copies look at.
ARABIC_MARKS = (".", "؟", "?", "!")
TELUGU_MARKS = (".", "?", "!")


def spaced_final_mark(block: Column) -> Column:
    """The block with a space before its one-character final mark, or null where there is a space, another mark, or none.

    The text line may be the second to fourth line; any other place is an error.
    """
    x, at = _lines(block), text_line(block)
    text, before, last = F.get(x, at), F.element_at(x, -2), F.element_at(x, -1)
    one, two = F.right(text, F.lit(1)), F.substring(text, -2, 1)
    misc = F.element_at(F.split(before, "\t"), -1)
    fits = one.isin(*ARABIC_MARKS) & ~two.isin(*ARABIC_MARKS, " ") & misc.contains(NO_SPACE) & (F.length(F.get(F.split(last, r"\s+"), F.lit(1))) == 1)
    drop = lambda m: F.when(m == NO_SPACE, "_").otherwise(F.array_join(F.array_remove(F.split(m, r"\|"), NO_SPACE), "|"))
    n = F.size(x)
    made = F.transform(x, lambda v, i: F.when(i == at, F.concat(F.substring(v, F.lit(1), F.length(v) - 1), F.lit(" "), F.right(v, F.lit(1)))).when(i == n - 2, _misc(v, drop)).otherwise(v))
    bad = F.raise_error(F.concat(F.lit("no text line near the top: "), F.get(x, F.lit(0)))).cast("string")
    return F.when((at < 1) | (at > 3), bad).when(fits, _joined(made))


def _no_space(line: Column) -> Column:
    return F.concat(line, F.lit(f"|{NO_SPACE}"))


def joined_final_mark(block: Column) -> Column:
    """The block with the space before its final mark removed from the text and transliteration lines; null where it does not apply."""
    x = _lines(block)
    text, n = F.get(x, F.lit(1)), F.size(_lines(block))
    fits = F.right(text, F.lit(1)).isin(*TELUGU_MARKS) & ~text.endswith(". . .")
    cut = lambda v: F.concat(F.substring(v, F.lit(1), F.length(v) - 2), F.right(v, F.lit(1)))
    return F.when(fits, _joined(F.transform(x, lambda v, i: F.when((i == 1) | (i == 2), cut(v)).when(i == n - 2, _no_space(v)).otherwise(v))))


def joined_comma(block: Column) -> Column:
    """The block with the space before its first comma removed, in the text and transliteration lines each at its own first comma; null where it does not apply."""
    x = _lines(block)
    text = F.get(x, F.lit(1))
    at = F.instr(text, ",")  # from 1
    fits = F.right(text, F.lit(1)).isin(*TELUGU_MARKS) & ~text.endswith(". . .") & (at > 2)
    cut = lambda v: F.when(F.instr(v, ",") > 2, F.concat(F.substring(v, F.lit(1), F.instr(v, ",") - 2), F.substring(v, F.instr(v, ","), F.length(v)))).otherwise(v)
    commas = F.transform(x, lambda v, i: (i >= 4) & (F.get(F.split(v, "\t"), F.lit(1)) == ","))
    first = F.array_position(commas, True) - 1
    return F.when(fits, _joined(F.transform(x, lambda v, i: F.when((i == 1) | (i == 2), cut(v)).when((first > 0) & (i == first - 1), _no_space(v)).otherwise(v))))


def with_copies(blocks: DataFrame, ids: list[str], copies: list[tuple], seed: int = 1234) -> DataFrame:
    """All blocks, and for each (function, share) its copies of a share of the blocks to which it applies."""
    out = blocks
    for k, (f, share) in enumerate(copies):
        out = out.unionByName(B.sampled(blocks, ids, share, seed + k).withColumn("value", f(F.col("value"))).where("value is not null"))
    return out


ARABIC = [(spaced_final_mark, 0.05)]
TELUGU = [(joined_final_mark, 0.1), (joined_comma, 0.1)]


def without_range_lines(block: Column) -> Column:
    return _joined(F.filter(_lines(block), lambda x: ~x.rlike(r"^\d+-\d+\t")))


def range_without_space(block: Column) -> Column:
    """The third line, a multi-word range with an empty last field, is marked as having no space after it; anything else is an error."""
    x = _lines(block)
    third = F.get(x, F.lit(2))
    bad = F.raise_error("the third line is no range with an empty last field").cast("string")
    made = F.transform(x, lambda v, i: F.when(i == 2, F.concat(F.substring(v, F.lit(1), F.length(v) - 1), F.lit(NO_SPACE))).otherwise(v))
    return F.when(third.rlike(r"^\d+-\d+\t") & third.endswith("_"), _joined(made)).otherwise(bad)


# Which treebanks, shards of them and fixes make up each combined treebank: {name: {shard: [(treebank, shard, fix), ...]}}.
COMBINED = {
    "en_combined": {
        "train": [("UD_English-EWT", "train", without_range_lines), ("UD_English-GUM", "train", without_range_lines), ("UD_English-GUMReddit", "train", without_range_lines), ("UD_English-PUD", "test", without_range_lines), ("UD_English-Pronouns", "test", without_range_lines)],
        "dev": [("en_tweet", "dev", without_range_lines)], "test": [("en_tweet", "test", without_range_lines)],
    },
    "it_combined": {
        "train": [("UD_Italian-ISDT", "train", None), ("UD_Italian-VIT", "train", None), ("UD_Italian-TWITTIRO", "train", None), ("UD_Italian-PoSTWITA", "train", None), ("italian-mwt", "extra", range_without_space)],
        "dev": [("UD_Italian-ISDT", "dev", None)], "test": [("UD_Italian-ISDT", "test", None)],
    },
    "es_combined": {
        "train": [("UD_Spanish-AnCora", "train", None), ("UD_Spanish-GSD", "train", final_semicolon_to_period), ("spanish-mwt", "extra", None)],
        "dev": [("UD_Spanish-AnCora", "dev", None)], "test": [("UD_Spanish-AnCora", "test", None)],
    },
    "ko_combined": {s: [("UD_Korean-GSD", s, None), ("UD_Korean-Kaist", s, None)] for s in ("train", "dev", "test")},
    "ko_combined_seg": {s: [("UD_Korean-GSD", s, without_spaces), ("UD_Korean-Kaist", s, without_spaces)] for s in ("train", "dev", "test")},
    "en_gum": {s: [("UD_English-GUM", s, None), ("UD_English-GUMReddit", s, None)] for s in ("train", "dev", "test")},
    "en_ewt_tweet": {s: [("en_ewt", s, None), ("en_tweet", s, None)] for s in ("train", "dev", "test")},
}


def combined(blocks: DataFrame, name: str, recipes: dict = COMBINED, augment: bool = False, ids: list[str] | None = None) -> DataFrame:
    """(treebank, shard, value): the parts of a combined treebank from rows (treebank, shard, value), train with punctuation copies if asked for."""
    if name not in recipes:
        raise ValueError(f"no combined treebank {name}")
    parts = []
    for shard, sources in recipes[name].items():
        for treebank, of, fix in sources:
            rows = blocks.where((F.col("treebank") == treebank) & (F.col("shard") == of)).withColumn("shard", F.lit(shard))
            parts.append(rows if fix is None else rows.withColumn("value", fix(F.col("value"))))
    out = functools.reduce(DataFrame.unionByName, parts)
    if augment:
        out = out.where("shard <> 'train'").unionByName(B.augment_punctuation(out.where("shard = 'train'"), ids or ["value"], "value"))
    return out


# --- checks ---
def has_lemmas(words: DataFrame, key: list[str]) -> DataFrame:
    """(key..., lemmas): whether any lemma is more than the form in lower case."""
    lemma = F.lower(F.trim(F.coalesce("lemma", F.lit("_"))))
    return words.groupBy(*key).agg(F.bool_or(~lemma.isin("", "_", "-") & (lemma != F.lower(F.trim("form")))).alias("lemmas"))


def has_ranges(words: DataFrame, key: list[str]) -> DataFrame:
    """(key..., ranges): whether there is any multi-word token."""
    return words.groupBy(*key).agg(F.bool_or(F.col("id_end").isNotNull()).alias("ranges"))


def longest_expansion(expansions: DataFrame) -> DataFrame:
    """(longest): characters of the longest expansion, its words joined by spaces; 0 without any. expansions: (token, parts, n)."""
    return expansions.agg(F.coalesce(F.max(F.length("parts")), F.lit(0)).alias("longest"))


def range_data(words: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """What a multi-word token model is trained and tested with: its expansions with counts, and the contracted sentences."""
    return C.expansions(words, key), C.contract(words, key)


def tagged_copy(blocks: DataFrame, retag=None) -> DataFrame:
    """The blocks that a tagger or parser is trained with: as they are (gold tags), or through ``retag``, a function from frame to frame."""
    return blocks if retag is None else retag(blocks)


def document_counts(words: DataFrame, key: list[str]) -> DataFrame:
    """(key..., tokens, words): surface tokens and syntactic words."""
    inside = F.sum(F.when(F.col("id_end").isNotNull(), F.col("id_end") - F.col("id_start") + 1).otherwise(0))
    ranges, plain = F.count_if(F.col("id_end").isNotNull()), F.count_if(F.col("id_end").isNull())
    return words.groupBy(*key).agg((plain - inside + ranges).cast("bigint").alias("tokens"), plain.cast("bigint").alias("words"))


def documents(words: DataFrame, doc: list[str], sent: str, fields: tuple[str, ...] = ("form", "lemma", "upos", "head", "deprel")) -> DataFrame:
    """(doc..., sentences): each document with its sentences in order, each an array of words in order; a sentence's number is its place, from 0."""
    w = words.where("id_end is null").groupBy(*doc, sent).agg(F.array_sort(F.collect_list(F.struct("id_start", *fields))).alias("_w"))
    return w.groupBy(*doc).agg(F.array_sort(F.collect_list(F.struct(sent, "_w"))).alias("_s")).select(*doc, F.transform("_s", lambda s: s["_w"]).alias("sentences"))


def field_values(documents: DataFrame, doc: list[str], field: str) -> DataFrame:
    """(doc..., sent, values): one field of every word, per sentence."""
    return documents.select(*doc, F.posexplode("sentences").alias("sent", "_w")).select(*doc, "sent", F.transform("_w", lambda w: w[field]).alias("values"))


def with_field(documents: DataFrame, values: DataFrame, doc: list[str], field: str) -> DataFrame:
    """Documents with one field of every word replaced by (doc..., sent, values); other numbers of words are an error."""
    v = values.groupBy(*doc).agg(F.array_sort(F.collect_list(F.struct("sent", "values"))).alias("_v"))
    j = documents.join(v, doc)
    size = lambda s, x: F.when(F.size(s) == F.size(x["values"]), s).otherwise(F.raise_error("another number of values than words").cast(documents.schema["sentences"].dataType.elementType))
    new = F.zip_with("sentences", "_v", lambda s, x: F.transform(size(s, x), lambda w, i: w.withField(field, F.get(x["values"], i))))
    return j.select(*doc, new.alias("sentences"))


def short_name(treebank: Column, table: dict[str, str]) -> Column:
    """A short name such as en_ewt as it is, a treebank's name by the table; null for others."""
    known = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[treebank] if table else F.lit(None).cast("string")
    return F.when(treebank.rlike("^[a-z-]+_[a-z0-9]+"), treebank).otherwise(known)


def files_by_language(files: DataFrame, path: str = "path", languages: list[str] | None = None) -> DataFrame:
    """(lang, files): paths by the language code before the first _ or - of the file's name."""
    lang = F.regexp_extract(F.regexp_extract(path, "([^/]*)$", 1), "^([a-z]{2,3})[_-]", 1)
    rows = files.select(lang.alias("lang"), path).where("lang <> ''")
    rows = rows.where(F.col("lang").isin(*languages)) if languages else rows
    return rows.groupBy("lang").agg(F.array_sort(F.collect_set(path)).alias("files"))


def split_by_file(df: DataFrame, file: str, shares: dict[str, float], seed: int = 1234) -> DataFrame:
    """All rows of a file go to the same shard."""
    return B.hash_split(df, [file], shares, seed)
