"""Text that looks the same in different characters, brought to one form.

The look-alike table is the public confusables data of Unicode as shipped with ICU in Spark's own JVM
(``confusables``): each character and its prototype, letter sequences included (m and rn). The table has a few
thousand entries, is read once on the driver and broadcast.

``Looks.skeleton`` decomposes a text, replaces every character by its prototype, and decomposes again;
texts with equal skeletons look alike. ``Looks.consistent`` is the readable form and starts from the
skeleton: only characters that their skeleton replaces are looked at, and each is replaced by the ordinary
character with the same skeleton, unless an exact check shows that it is no disguise: words wholly in
another script, composed accents, curly quotes, dashes and emoji stay as they are.

Exact checks: a letter of another script counts only in a word whose letters are mostly Latin, or whose other
letters all have a Latin twin; phonetic and other special Latin letters count only among plain ones, and
not in a text that uses the letters of an alphabet with a dotless i; full-width signs beside East Asian text stay.

Defined cases: null stays null, empty stays empty; texts of any length are processed whole;
``consistent`` of a consistent text is the text itself.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Hyphens that are not "-"; characters without width; combining accents; emoji parts.
HYPHENS = "\u2010\u2011\ufe63"
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u206a-\u206f\ufe00-\ufe0f\ufeff"
ACCENTS = "\u0300-\u034e\u0350-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20dc\ufe20-\ufe2f"
SPACES = "\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
EMOJI = "\u00a9\u00ae\u203c\u2049\u2122\u2139\u2190-\u21ff\u2300-\u27bf\u2900-\u297f\u2b00-\u2bff\u3030\u303d\u3297\u3299\U0001f000-\U0001faff"
TAGS = "\U000e0020-\U000e007f"

_KEPT = re.compile(f"(?<=[{EMOJI}\u20e3\ufe0f{TAGS}])[\u200d\ufe0e\ufe0f]|[\u200d](?=[{EMOJI}])|(?<=[0-9#*])\ufe0f(?=\u20e3)")
_INVISIBLE, _SPACE, _HYPHEN, _ACCENT = (re.compile(f"[{x}]") for x in (INVISIBLE, SPACES, HYPHENS, ACCENTS))
_CJK = "\u2e80-\u303f\u3041-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff"
_WIDE_SIGN = "\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff5e"
_WIDE_ALONE = re.compile(f"(?<=[{_CJK}])[{_WIDE_SIGN}]|[{_WIDE_SIGN}](?=[{_CJK}])")
_FOREIGN = re.compile(r"[^\W\d_\x00-\x7f]+")
_UNPLAIN = re.compile(f"(?:[^\\W_]|[{ACCENTS}])*[^\\W_\x00-\x7f](?:[^\\W_]|[{ACCENTS}])*")
_EMOJI_LETTERS = "\u2139\u24c2"
_DOTLESS_TEXT = re.compile("[ğşĞŞİçÇöÖüÜ]")
_LETTER_NAME = re.compile(r"(?:LATIN|CYRILLIC|GREEK)(?: SMALL| CAPITAL)?(?: LETTER)?(?: SMALL CAPITAL| SCRIPT| DOTLESS)? ([A-Z])")


def confusables(spark: SparkSession) -> dict[str, str]:
    """Every assigned character that its ICU skeleton replaces, with its prototype; CJK ideographs and Hangul syllables have none."""
    held = getattr(spark, "_textloom_confusables", None)
    if held is None:
        checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        skip = ((0xD800, 0xF8FF), (0x3400, 0x9FFF), (0xAC00, 0xD7A3), (0x17000, 0x18CFF))
        chars = [chr(c) for c in range(0x21, 0x20000) if not any(a <= c <= b for a, b in skip) and unicodedata.category(chr(c)) != "Cn"]
        prototypes = checker.getSkeleton("\n".join(chars)).split("\n")
        held = {c: p for c, p in zip(chars, prototypes, strict=True) if unicodedata.normalize("NFD", c) != p}
        spark._textloom_confusables = held
    return held


@lru_cache(4096)
def _latin(ch: str) -> bool:
    return ch.isalpha() and unicodedata.name(ch, "").startswith("LATIN")


@lru_cache(65536)
def _form(ch: str) -> str | None:
    """What a full-width, styled, circled or joined letter, or a full-width sign or digit, stands for."""
    kind, _, _ = unicodedata.decomposition(ch).partition(" ")
    if kind not in ("<wide>", "<font>", "<circle>", "<compat>") or ch in _EMOJI_LETTERS:
        return None
    flat = unicodedata.normalize("NFKC", ch)
    if kind == "<compat>":
        return flat if "\ufb00" <= ch <= "\ufb17" else None
    return flat if kind == "<wide>" or (flat.isalnum() and (len(flat) == 1) and not (kind == "<circle>" and not flat.isascii())) else None


@lru_cache(1)
def _marks() -> frozenset[str]:
    tests = (_INVISIBLE.match, _SPACE.match, _HYPHEN.match, _ACCENT.match)
    return frozenset(c for c in map(chr, range(0x80, 0x20000)) if any(t(c) for t in tests) or _form(c) is not None)


class Looks:
    """Skeletons and consistent forms with one look-alike table."""

    def __init__(self, table: dict[str, str]) -> None:
        self.table = table
        twins: dict[str, list[str]] = {}
        for c in map(chr, range(0x21, 0x7F)):
            twins.setdefault(table.get(c, c), []).append(c)
        self.twins = twins
        self.letters: dict[str, str | None] = {}
        self.odd = _marks().union(c for c in table if not c.isascii())

    def prototype(self, ch: str) -> str:
        p = self.table.get(ch)
        if p is None:
            if _INVISIBLE.match(ch):
                return ""
            flat = _form(ch)
            p = ch if flat is None else "".join(self.table.get(c, c) for c in flat)
        return p

    def skeleton(self, text: str | None) -> str | None:
        if text is None:
            return None
        return unicodedata.normalize("NFD", "".join(map(self.prototype, unicodedata.normalize("NFD", text))))

    def letter(self, ch: str) -> str | None:
        """The ordinary Latin letter or digit that looks like ``ch``: the one with the same skeleton and the same case."""
        if ch not in self.letters:
            self.letters[ch] = self._letter(ch)
        return self.letters[ch]

    def _letter(self, ch: str) -> str | None:
        p = _INVISIBLE.sub("", _ACCENT.sub("", self.table.get(ch, ch)))
        if p.isascii():
            same = [c for c in self.twins.get(p, self.twins.get(self.table.get(p, p), ())) if c.isalnum()]
            fit = [c for c in same if c.isalpha() and c.isupper() == ch.isupper()] or same
            return fit[0] if fit else None
        m = _LETTER_NAME.fullmatch(unicodedata.name(p, "")) if len(p) == 1 and _latin(p) else None
        return m and (m[1] if ch.isupper() else m[1].lower())

    def word(self, w: str, dotless: bool = False) -> str:
        if w.isascii():
            return w
        latin = [c for c in w if _latin(c)]
        other = [c for c in w if c.isalpha() and not _latin(c)]
        if other and latin and (len(latin) > len(other) or all(map(self.letter, other))):
            w = _FOREIGN.sub(self._run, w)
        special = [c for c in w if not c.isascii() and _latin(c) and not unicodedata.decomposition(c) and self.table.get(c, c).isascii() and self.letter(c)]
        if special and any(c.isascii() and c.isalpha() for c in w) and all(c.isascii() or c in special for c in w) and not (dotless and "ı" in w):
            w = "".join(self.letter(c) if c in special else c for c in w)
        return w

    def _run(self, m: re.Match) -> str:
        """A run of non-ASCII letters: those of other scripts are replaced if all of them have a twin, else the run is a piece of another language."""
        run = m.group()
        other = [c for c in run if not _latin(c)]
        return "".join(c if _latin(c) else self.letter(c) for c in run) if other and all(map(self.letter, other)) else run

    def consistent(self, text: str | None) -> tuple[str | None, frozenset[str]]:
        """The one form of ``text``, and the kinds of change that it needed."""
        if text is None or text.isascii() or self.odd.isdisjoint(text):
            return text, frozenset()
        why = set()
        if _INVISIBLE.search(text):
            kept = {m.start() for m in _KEPT.finditer(text)}
            bare = "".join(c for i, c in enumerate(text) if i in kept or not _INVISIBLE.match(c))
            if bare != text:
                why.add("invisible")
                text = bare
        if _SPACE.search(text):
            why.add("space")
            text = _SPACE.sub(" ", text)
        if _HYPHEN.search(text):
            why.add("hyphen")
            text = _HYPHEN.sub("-", text)
        if any(_form(c) is not None for c in self.odd.intersection(text)):
            own = {m.start() for m in _WIDE_ALONE.finditer(text)}  # full-width signs belong to East Asian text
            flat = "".join(c if i in own or c < "\x80" else _form(c) or c for i, c in enumerate(text))
            if flat != text:
                why.add("form")
                text = flat
        if _ACCENT.search(text):
            why.add("accent")
            text = unicodedata.normalize("NFC", text)
        dotless = _DOTLESS_TEXT.search(text) is not None
        mapped = _UNPLAIN.sub(lambda m: self.word(m.group(), dotless), text)
        if mapped != text:
            why.add("script")
            text = mapped
        return text, frozenset(why)

    def aligned(self, text: str) -> tuple[str, list[int] | None]:
        """The text with look-alike characters replaced one by one, and each character's place in the original (null: unchanged)."""
        if text.isascii() or self.consistent(text)[0] == text:
            return text, None
        chars, at = [], []
        for i, c in enumerate(text):
            if _INVISIBLE.match(c):
                continue
            flat = " " if _SPACE.match(c) else "-" if _HYPHEN.match(c) else _form(c) or c
            chars.append(flat)
            at += [i] * len(flat)
        return _UNPLAIN.sub(lambda m: self.word(m.group()), "".join(chars)), at


def _forms(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = Looks(shared.value).consistent
        for b in batches:
            body = [one(x) for x in b["body"]]
            models = [None if x is None else [one(y) for y in x] for x in b["models_detected"]]
            yield pd.DataFrame({
                "id": b["id"],
                "body_form": [x[0] for x in body],
                "body_changes": [",".join(sorted(x[1])) for x in body],
                "models_form": [None if x is None else [y[0] for y in x] for x in models],
                "models_changes": ["" if x is None else ",".join(sorted(set().union(*(y[1] for y in x)))) for x in models],
            })

    return run


def consistent_entries(entries: DataFrame) -> DataFrame:
    """One row per row of ``entries``: consistent forms of both fields and the kinds of change each needed."""
    spark = entries.sparkSession
    shared = spark.sparkContext.broadcast(confusables(spark))
    return entries.select("id", "body", "models_detected").mapInPandas(_forms(shared), "id string, body_form string, body_changes string, models_form array<string>, models_changes string")


def changed_fields(entries: DataFrame) -> DataFrame:
    """(id, field) of the fields that needed a change. Plain ASCII rows are left out before Python sees them."""
    odd = "[^\\x00-\\x7F]"
    some = entries.where(F.col("id").isNotNull() & (F.col("body").rlike(odd) | F.exists("models_detected", lambda x: x.rlike(odd))))
    f = consistent_entries(some)
    fields = F.array(F.when(F.col("body_changes") != "", F.lit("body")), F.when(F.col("models_changes") != "", F.lit("models_detected")))
    return f.select("id", F.explode(F.array_compact(fields)).alias("field")).distinct()


def _skeletons(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        skeleton = Looks(shared.value).skeleton
        for b in batches:
            yield b.assign(skeleton=b["original"].map(skeleton))

    return run


def skeleton_groups(values: DataFrame, column: str) -> DataFrame:
    """Distinct values with their skeleton, rows, and how many different originals share it.

    Values are counted before Python sees them, so each distinct value is processed once; the
    groups come as rows, never as one collected list.
    """
    spark = values.sparkSession
    shared = spark.sparkContext.broadcast(confusables(spark))
    counted = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("original")).agg(F.count(F.lit(1)).alias("n"))
    marked = counted.mapInPandas(_skeletons(shared), "original string, n bigint, skeleton string")
    variants = marked.groupBy("skeleton").agg(F.count(F.lit(1)).alias("variants"))
    return marked.join(variants, "skeleton").select("skeleton", "original", "n", "variants")


def word_groups(texts: DataFrame, column: str) -> DataFrame:
    """Words of a text column, in lower case, in groups of equal skeleton with at least two spellings, one of them not plain."""
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(column), F.lit(r"[^\s!-/:-@\[-`{-~]+"), F.lit(0)))).alias("word"))
    g = skeleton_groups(words, "word")
    disguised = g.where("variants > 1").groupBy("skeleton").agg(F.max(F.col("original").rlike("[^\\x00-\\x7F]")).alias("odd")).where("odd")
    return g.join(disguised.select("skeleton"), "skeleton", "left_semi")
