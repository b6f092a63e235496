"""Text functions as column expressions: everything stays in the JVM, no Python function is called."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import lexicon

WHITE = r"(?U)\s+"


def _steps(c: Column, steps: list[tuple[str, str]]) -> Column:
    return functools.reduce(lambda x, s: F.regexp_replace(x, *s), steps, c)


def squash(c: Column) -> Column:
    """White space, Unicode's too, collapsed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(c, WHITE, " "))


def entry_text(compat: bool = False) -> Column:
    """A post's title and text, or a comment's body, trimmed. Null parts count as empty; ``compat`` keeps a null body null."""
    post = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("selftext", F.lit("")))
    body = F.col("body") if compat else F.coalesce("body", F.lit(""))
    return F.regexp_replace(F.when(F.col("type") == "submission", post).otherwise(body), r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, WHITE, "") == "", F.lit(True))


def length_route(c: Column, drop: int = 20_000, single: int = 8_000) -> Column:
    n = F.length(c)
    return F.when(n >= drop, "drop").when(n > single, "single").otherwise("batch")


def clean(c: Column, profile: str = "pipeline") -> Column:
    """``pipeline`` pads sentence punctuation and blanks underscores; ``tester`` keeps underscores and pads quotes."""
    profiles = {"pipeline": lexicon.CLEAN_PIPELINE, "tester": lexicon.CLEAN_TESTER}
    if profile not in profiles:
        raise ValueError(f"no profile {profile}")
    return squash(_steps(c, profiles[profile]))


def let(c: Column, f) -> Column:
    """``f`` of a value that is computed once: a lambda's variable, where an expression used twice would be evaluated twice."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def rewrite_matches(c: Column, pattern: str, f) -> Column:
    """Each match of ``pattern`` replaced by ``f`` of it: the gaps and the rewritten matches are zipped together."""

    def rewritten(v: Column) -> Column:
        matches = F.transform(F.regexp_extract_all(v, F.lit(pattern), F.lit(0)), f)
        return F.array_join(F.zip_with(F.split(v, pattern, -1), matches, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return let(c, rewritten)


def normalize_names(c: Column, patterns: dict[str, str] | None = None) -> Column:
    """Product names without spaces, hyphens and underscores, in capitals. Texts without the stem skip the rewriting."""

    def rewritten(v: Column) -> Column:
        out = v
        for p in (patterns or lexicon.DETECT).values():
            out = rewrite_matches(out, f"(?iU){p}", lambda m: F.upper(F.translate(m, " -_", "")))
        return out if patterns else F.when(v.rlike("(?i)gpt"), out).otherwise(v)

    return let(c, rewritten)


def sentences(c: Column) -> Column:
    """Rule splitter: a sentence ends at . ! or ? before white space. Punctuation stays; empty pieces go."""
    return F.filter(F.split(F.regexp_replace(c, r"([.!?])(?U)\s+", "$1\u0001"), "\u0001"), lambda s: F.trim(s) != "")


def cleaned_sentences(c: Column, split=sentences, profile: str = "pipeline") -> Column:
    return F.transform(split(c), lambda s: normalize_names(clean(F.lower(F.translate(s, "\n\t", "  ")), profile)))


def mention_sentences(sents: Column, mode: str = "GPT", exclude: str | None = None) -> Column:
    """Sentences that mention a product. ``NONE`` keeps all; ``EXTRA`` also takes generic words unless an excluded product occurs."""
    if mode == "NONE":
        return sents
    plain = F.filter(sents, lambda s: s.contains("GPT"))
    if mode == "GPT":
        return plain
    if mode != "EXTRA":
        raise ValueError(f"no mode {mode}")
    either = [f"(?iU){p}" for p in lexicon.DETECT.values()] + list(lexicon.EXTRA.values())
    wide = F.filter(sents, lambda s: functools.reduce(operator.or_, (s.rlike(p) for p in either)))
    return wide if exclude is None else F.when(F.exists(sents, lambda s: s.rlike(exclude)), plain).otherwise(wide)


def detects(c: Column, name: str) -> Column:
    return c.rlike(f"(?iU){lexicon.DETECT[name]}")


def canonical(c: Column, patterns: dict[str, str] | None = None) -> Column:
    out = F.lit(None).cast("string")
    for name, p in reversed((patterns or lexicon.CANONICAL).items()):
        out = F.when(c.rlike(p), name).otherwise(out)
    return out


def words(c: Column) -> Column:
    return F.filter(F.split(c, WHITE), lambda w: w != "")


def uppercase_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\b[A-Z][A-Z0-9.]+\b"), F.lit(0))


def slug(c: Column) -> Column:
    return F.translate(c, "-.", "__")


def skip_category(c: Column) -> Column:
    """The categories of a skipped text, main one first: one or two names."""
    t = F.coalesce(c, F.lit(""))
    sub = F.lit("chatgpt_other")
    for name, p in reversed(lexicon.SKIPPED_SUB):
        sub = F.when(t.rlike(p), name).otherwise(sub)
    out = F.array(F.lit("other"))
    for name, p in reversed(lexicon.SKIPPED):
        out = F.when(t.rlike(p), F.array(F.lit(name), sub) if name == "chatgpt_mentions" else F.array(F.lit(name))).otherwise(out)
    return out


def langid_clean(c: Column) -> Column:
    """Short links, handles, hashtags, runs of ! and . and emoji become spaces, then trimmed; a text that would vanish stays untrimmed."""
    emoji = "[\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{2B50}\\x{2B55}\\x{FE0F}\\x{200D}]"
    out = _steps(c, [(r"https?://t\.co/[a-zA-Z0-9]+", " "), ("@[a-zA-Z0-9_]+", " "), ("#[a-zA-Z]+", " "), ("[!.]+", " "), (emoji, " ")])
    return F.when(is_blank(out), out).otherwise(F.regexp_replace(out, r"(?U)^\s+|\s+$", ""))


def langid_sentence(c: Column) -> Column:
    """Line breaks, list hyphens, underscores, backslashes, quotes and digits go; a capital I after and before small letters, or last, becomes l."""
    plain = _steps(c, [("\n|- |_|\\\\|\"|[0-9]", "")])
    return squash(F.regexp_replace(plain, r"(?<=\p{Ll})I(?=\p{Ll}|\s|$)", "l"))


def truncate(c: Column, n: int) -> Column:
    return F.trim(F.substring(c, 1, n))


def snippet(c: Column, n: int = 100) -> Column:
    return F.substring(F.regexp_replace(c, "\n", " "), 1, n)


def tweet_tokens(t: Column) -> Column:
    """Tokens without a retweet head (RT @name : or RT @ name :) or a first handle, without @ and #; links become a space."""
    at = lambda i: F.coalesce(F.get(t, F.lit(i)), F.lit(""))
    drop = (
        F.when((F.size(t) > 3) & (at(0) == "RT") & at(1).startswith("@") & (at(2) == ":"), 3)
        .when((F.size(t) > 4) & (at(0) == "RT") & (at(1) == "@") & (at(3) == ":"), 4)
        .when(at(0).startswith("@"), 1).otherwise(0)
    )
    bare = F.transform(F.filter(t, lambda w, i: i >= drop), lambda w: F.regexp_replace(w, "^[@#]", ""))
    return F.transform(bare, lambda w: F.when(w.rlike("^https?:"), " ").otherwise(w))


def sentiment_words(c: Column, digits: bool = False) -> Column:
    """Lower-case words with - and / as spaces; "-" where nothing is left; ``digits`` masks numbers other than 0 and 1."""
    t = squash(F.translate(c, "-/", "  "))
    w = F.split(F.lower(F.when(t == "", "-").otherwise(t)), " ")
    return F.transform(w, lambda x: F.when(x.isin("0", "1"), x).otherwise(F.regexp_replace(x, "[0-9]", "#"))) if digits else w


LINK = r"(?:[\w.+-]+@[\w-]+\.[\w.-]+)|(?:https?://\S+)|(?:www\.\S+)"


def link_spans(c: Column) -> Column:
    """(begin, end) of e-mail addresses and links, inside which no token ends; offsets from 0, end excluded."""
    gaps, hits = F.transform(F.split(c, LINK, -1), F.length), F.transform(F.regexp_extract_all(c, F.lit(LINK), F.lit(0)), F.length)
    begin = lambda i: F.aggregate(F.slice(gaps, 1, i + 1), F.lit(0), operator.add) + F.aggregate(F.slice(hits, 1, i), F.lit(0), operator.add)
    return F.transform(hits, lambda n, i: F.struct(begin(i).alias("begin"), (begin(i) + n).alias("end")))


def char_features(c: Column) -> Column:
    """Of each character: space, capital, number."""
    return F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.struct(x.rlike(r"(?U)\s").alias("space"), ((F.upper(x) == x) & (F.lower(x) != x)).alias("capital"), x.rlike("[0-9]").alias("number")))


def paragraphs(c: Column) -> Column:
    return F.filter(F.split(c, r"\n\s*\n"), lambda p: F.trim(p) != "")


def paragraph_break(c: Column, at: Column) -> Column:
    """Length of the paragraph break (two line breaks with only white space between) that begins at a place from 0; 0 if none does."""
    return F.length(F.regexp_extract(F.substring(c, at + 1, F.length(c)), r"^\n\s*\n", 0))


def runs_without(c: Column, mark: str) -> Column:
    """(begin, end) of maximal runs of array elements other than ``mark``."""
    inside = lambda i: (i >= 0) & (i < F.size(c)) & (F.coalesce(F.get(c, i), F.lit("")) != mark)
    at = F.sequence(F.lit(0), F.greatest(F.size(c) - 1, F.lit(0)))
    starts, ends = F.filter(at, lambda i: inside(i) & ~inside(i - 1)), F.filter(at, lambda i: inside(i) & ~inside(i + 1))
    return F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: F.struct(x["a"].alias("begin"), (x["b"] + 1).alias("end")))


# --- MISC and FEATS columns ---
def key_values(c: Column) -> Column:
    """``k=v|k=v`` as a map; ``_``, null and empty give an empty map; a part without = maps to null."""
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda p: (p != "") & (p != "_"))
    pairs = F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).alias("v")))
    # the first of repeated keys stands, so a malformed row cannot fail the query
    return F.map_from_entries(F.aggregate(pairs, F.array().cast("array<struct<k:string,v:string>>"), lambda a, x: F.when(F.exists(a, lambda y: y["k"] == x["k"]), a).otherwise(F.array_append(a, x))))


def no_space_after(misc: Column) -> Column:
    return F.array_contains(F.split(F.coalesce(misc, F.lit("")), r"\|"), "SpaceAfter=No")


def drop_space_after(misc: Column, strict: bool = True) -> Column:
    left = F.array_join(F.array_remove(F.split(misc, r"\|"), "SpaceAfter=No"), "|")
    gone = F.when(left == "", "_").otherwise(left)
    missing = F.raise_error("SpaceAfter=No is missing").cast("string") if strict else misc
    return F.when(no_space_after(misc), gone).otherwise(missing)


def add_space_after(misc: Column, strict: bool = True) -> Column:
    there = F.raise_error("SpaceAfter=No is there already").cast("string") if strict else misc
    return F.when(no_space_after(misc), there).when(misc.isNull() | (misc == "_") | (misc == ""), "SpaceAfter=No").otherwise(F.concat(misc, F.lit("|SpaceAfter=No")))
