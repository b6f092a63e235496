"""Personal details in free text, found and replaced by typed placeholders.

Anchor expansion: one Aho-Corasick automaton finds at-signs, schemes, identifier cues, street types,
digits and parts of names in a single pass; from each anchor a deterministic parser looks at the
text around it, expands to the boundaries of an e-mail address, phone number, identity number,
street address or name, and validates what it found.

The name list is incomplete, so three things are learned and none is a list of phrases. ``Spelling`` is
a pair of character models, one of listed names and one of ordinary words, and says whether an unlisted word
is spelled like a name. Ordinary words are those that the corpus writes mostly in lower case.
``Context`` holds, for the two words before and the two after, how much more often each stands beside a
listed full name than elsewhere. The statistics come from one pass over all texts
(``name_statistics``), summed by Spark; the ``most_words`` most frequent words reach the driver, rarer ones count
as unknown. A title and a surname, or a given name and a surname, are a name if both are known or spelled
so; where a word is ordinary or only capitalised, the context has to speak for a name.

Look-alike characters are read as what they look like; offsets always refer to the original text,
which is kept as it is around the placeholders.

Defined cases: null stays null and has no details; empty texts and texts of any length are processed
whole; overlapping details go to the earlier kind in ``KINDS``; repeated rows count once in the
report; an empty name list leaves the other kinds working; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import lookalikes as L

KINDS = ("email", "id_number", "phone", "address", "name")
FIELDS = ("body", "cleaned_text")

# --- parsers; each takes (text, anchor begin, anchor end) and gives a span or None ---
_W = r"\ẁ-ͯ"
_DOMAIN = re.compile(rf"[{_W}][{_W}\-]*(?:\.[{_W}][{_W}\-]*)+")
_SPOKEN = re.compile(rf"\s*([{_W}][{_W}\-]*(?:(?:\s+dot\s+|\s*[\[({{]\s*dot\s*[\])}}]\s*|(?<=\w)\.(?=\w))[{_W}][{_W}\-]*)+)", re.I)
_DOT = re.compile(r"\bdot\b", re.I)


def _local_part(t: str, end: int) -> int | None:
    s = end
    while s > 0 and (t[s - 1].isalnum() or t[s - 1] in "_.%+-" or "\u0300" <= t[s - 1] <= "\u036f"):
        s -= 1
    while s < end and t[s] in ".-+%":
        s += 1
    return s if s < end and any(c.isalnum() for c in t[s:end]) else None


def _domain(d: str) -> str | None:
    labels = d.rstrip(".").split(".")
    while len(labels) > 1 and not (labels[-1].isalpha() and len(labels[-1]) > 1):
        labels.pop()
    return ".".join(labels) if len(labels) > 1 else None


def email_at_sign(t: str, a: int, b: int):
    s, m = _local_part(t, a), _DOMAIN.match(t, b)
    d = m and _domain(m.group())
    return (s, b + len(d)) if s is not None and d else None


def email_spoken(t: str, a: int, b: int):
    end = a
    while end > 0 and t[end - 1] == " ":
        end -= 1
    s, m = _local_part(t, end), _SPOKEN.match(t, b)
    if s is None or not m:
        return None
    if not _DOT.search(m.group(1)) and t[a:b].strip().lower() == "at":
        return None  # "meet at example.org" is a place, not an address
    last = re.split(r"[\W_]+", m.group(1))[-1]
    return (s, m.end(1)) if last.isalpha() and len(last) > 1 else None


_ID = {
    "ssn": r"\d{3}[-. ]?\d{2}[-. ]?\d{4}",
    "insurance": r"[A-Za-z]{2}[ -]?\d{2}[ -]?\d{2}[ -]?\d{2}[ -]?[A-Da-d]|\d{3}[-. ]?\d{2}[-. ]?\d{4}",
    "passport": r"[A-Za-z]{1,2} ?\d{6,9}|\d{8,9}",
    "licence": r"(?=[A-Za-z0-9-]*\d{3})[A-Za-z][A-Za-z0-9]*(?:[- ]?[A-Za-z0-9]*\d[A-Za-z0-9]*)*",
    "personal": r"\d{6}[-+ ]?\d{4}|(?=[A-Za-z0-9-]*\d{4})[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*",
}
_LINK = r"(?:[\s:#=.\-]+|\b(?:security|insurance|driving|number|num|no|nr|id|card|code|is|was|the|my|numbers)\b){0,12}?"
_ID_AFTER = {k: re.compile(rf"\w*{_LINK}(?<![\w-])({v})(?![\w-])", re.I) for k, v in _ID.items()}
_BARE_ID = re.compile(r"(?<![\w-])(?:\d{3}-\d{2}-\d{4}|[A-Za-z]{2}\d{6}[A-Da-d])(?![\w-])")


def id_after(kind: str):
    rx = _ID_AFTER[kind]

    def parse(t: str, a: int, b: int):
        m = rx.match(t, b)
        return m.span(1) if m and sum(c.isdigit() for c in m.group(1)) >= 5 else None

    return parse


_PHONE = re.compile(
    r"(?<![\w.,/#-])(?:"
    r"(?P<intl>(?:\+|00)\s?\d{1,3}(?:[\s./-]*(?:\(\s*\d{1,4}\s*\)|\d+)){1,6})"
    r"|(?P<north>(?:1[\s.-]?)?(?:\(\s*\d{3}\s*\)\s*|\d{3}[\s.-])\d{3}[\s.-]\d{4})"
    r"|(?P<trunk>0\d{2,4}[\s./-]\d{3,6}(?:[\s./-]\d{2,4}){0,2})"
    r"|(?P<solid>\d{10,11})"
    r")(?:\s*(?:ext\.?|extension|x)\s*\d{1,5})?(?![\w-]|[.,]\d)",
    re.I,
)
_PHONE_CUE = re.compile(r"(?:phone|call|tel|telephone|mobile|cell|whatsapp|signal|fax|number is|text|reach|under|contact|dial|ring)\W*(?:\w+\W+){0,3}$", re.I)
_NOT_PHONE = re.compile(r"(?:isbn|seed|ticket|order|code|version|build|issue|invoice|serial)\W*(?:no\W*)?$", re.I)
_DIGIT = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
_SAID = re.compile(rf"(?<!\w)(?:plus[\s,-]+)?(?:(?:double|triple)?[\s,-]*{_DIGIT}[\s,-]+){{6,14}}{_DIGIT}(?!\w)", re.I)


def numbers(t: str, a: int, b: int) -> list[tuple[int, int, str]]:
    """Phone numbers, and identity numbers that need no cue, around digits at a..b."""
    out = [(*m.span(), "id_number") for m in _BARE_ID.finditer(t, a, b)]
    for m in _PHONE.finditer(t, a, b):
        n = sum(c.isdigit() for c in m.group())
        if not 8 <= n <= 20 or _NOT_PHONE.search(t, max(0, m.start() - 16), m.start()):
            continue
        if m.lastgroup == "trunk" and not 9 <= n <= 13:
            continue
        if m.lastgroup == "solid" and not _PHONE_CUE.search(t, max(0, m.start() - 40), m.start()):
            continue
        out.append((*m.span(), "phone"))
    return out


_TYPES = "street|road|avenue|boulevard|lane|row|drive|terrace|crescent|square|close|court|place|way|parkway|highway"
_SHORT = "st|rd|ave|blvd|ln|dr|ct|hwy"
_UNIT = r"(?:\s*,?\s*(?:apt|apartment|flat|unit|suite|ste|no)\.?\s*#?\w{1,5}\b)?"
_TOWN = rf"(?:\s*,\s*[{_W}]+(?:\s+[{_W}]+)?\s+(?:[A-Z]{{2}}\s+)?\d{{4,5}}(?:-\d{{4}})?\b)?"
# Words that do not begin a street's name: articles, prepositions, pronouns and units of measure.
_SMALL = r"(?!(?:the|a|an|of|for|in|on|at|to|and|or|my|this|that|is|was|by|with|per|times?|things?|people|ways?|seconds?|minutes?|mins?|hours?|days?|weeks?|months?|years?|miles?|km|metres?|meters?|dollars|euros|percent|lines?|rows?|pages?|words?)\b)"
_STREET = re.compile(
    rf"(?<![\w.-])((?:(?:flat|apt|apartment|unit|suite)\.?\s*\w{{1,4}}\s*,\s*)?\d{{1,5}}[a-z]?\s+(?:(?:[NSEW]|North|South|East|West)\.?\s+)?(?:{_SMALL}[{_W}'’-]+\s+){{1,3}}(?:(?:{_SHORT})\b\.?|(?:{_TYPES})\b){_UNIT}{_TOWN})", re.I
)
_STRASSE = re.compile(rf"[{_W}-]*(?:stra(?:ß|ss)e|str\.|weg|platz|gasse|allee)\s+\d{{1,4}}(?:\s?[a-z]\b|\b){_TOWN}", re.I)
_LETTERS = r"[^\W\d_]+"
_CALLE = re.compile(rf"(?:calle|avenida|plaza|paseo|via|rua)\s+(?:de\s+(?:la\s+)?)?{_LETTERS}(?:\s+{_LETTERS})?\s*,?\s*\d{{1,4}}\b(?:\s*,\s*\d{{1,2}}\s?[A-Za-z]\b)?", re.I)
_RUE = re.compile(rf"\d{{1,4}}\s*(?:bis|ter)?\s*,?\s*(?:rue|avenue|boulevard|place|quai|chemin)\s+(?:de\s+(?:la\s+|l['’])?|du\s+|des\s+|d['’])?[{_W}-]+", re.I)
_BOX = re.compile(rf"(?:p\.?\s?o\.?|post\s+office)\s*box\s*#?\d+(?:\s*,\s*{_SMALL}[{_W}]+)?", re.I)


def _tokens_back(t: str, a: int, k: int) -> int:
    """Where the k-th word before ``a`` begins; words are never cut."""
    for _ in range(k):
        while a > 0 and t[a - 1].isspace():
            a -= 1
        while a > 0 and not t[a - 1].isspace():
            a -= 1
    return a


def _tokens_on(t: str, b: int, k: int) -> int:
    n = len(t)
    for _ in range(k):
        while b < n and t[b].isspace():
            b += 1
        while b < n and not t[b].isspace():
            b += 1
    return b


def _around(rx: re.Pattern, before: int, after: int):
    """Looks for ``rx`` over the anchor, from ``before`` words before it to ``after`` words behind it."""

    def parse(t: str, a: int, b: int):
        for m in rx.finditer(t, _tokens_back(t, a, before), _tokens_on(t, b, after)):
            if m.start() <= a < m.end():
                return m.span()
            if m.start() > a:
                break
        return None

    return parse


def street(t: str, a: int, b: int):
    span = _any_street(t, a, b)
    # "way", "place" and "close" are ordinary words: a street type only if written with a capital
    return None if span is None or re.search(r"\b(?:way|place|close)\W*$", t[slice(*span)]) else span


_any_street, strasse, calle, rue, box = _around(_STREET, 9, 8), _around(_STRASSE, 3, 8), _around(_CALLE, 0, 9), _around(_RUE, 4, 6), _around(_BOX, 3, 5)

# --- names ---
_LETTERS_RUN = re.compile(r"[^\W\d_]+")
_POSITIONS = ("before", "before2", "after", "after2")


class Spelling:
    """Log odds that a word is spelled like the listed names of a kind rather than like an ordinary word."""

    ORDER = 3

    def __init__(self, names: set[str], ordinary: list[str]) -> None:
        self.names, self.words = self._counts(names), self._counts(ordinary)

    def _counts(self, words) -> Counter:
        c: Counter = Counter()
        for w in words:
            x = "^" * self.ORDER + w + "$"
            for i in range(self.ORDER, len(x)):
                for k in range(self.ORDER + 1):
                    c[x[i - k : i + 1]] += 1
                    c["\0" + x[i - k : i]] += 1
        return c

    def _log(self, c: Counter, w: str) -> float:
        x, total = "^" * self.ORDER + w + "$", 0.0
        for i in range(self.ORDER, len(x)):
            p = 1 / 40
            for k in range(self.ORDER + 1):
                p = (c[x[i - k : i + 1]] + p) / (c["\0" + x[i - k : i]] + 1)
            total += math.log(p)
        return total

    def odds(self, w: str) -> float:
        if len(w) < 4:
            return -9.0
        return self._log(self.names, w) - max(self._log(self.words, w), (len(w) + 1) * math.log(1 / 30))


class Context:
    """Log odds of a name from the words around it; words never seen beside a name count against it if they are frequent."""

    # Words before a name in general English, for collections in which no listed name occurs.
    CUES = frozenset(("contact", "named", "called", "signed", "sincerely", "regards", "attn"))

    def __init__(self, beside: dict[str, Counter], freq: dict[str, int], weight: float = 20.0) -> None:
        self.beside, self.freq, self.k = beside, freq, weight
        self.total = max(1, sum(freq.values()))
        self.seen = {p: sum(beside.get(p, {}).values()) for p in _POSITIONS}

    def one(self, position: str, word: str | None) -> float:
        n = self.seen[position]
        if not word or not n:
            return 0.0
        p = max(self.freq.get(word, 0), 0.5) / self.total
        return math.log((self.beside[position].get(word, 0) + self.k * p) / ((n + self.k) * p))

    def odds(self, t: str, a: int, b: int) -> float:
        before = [w.lower() for w in _LETTERS_RUN.findall(t[_tokens_back(t, a, 2) : a])][-2:]
        after = [w.lower() for w in _LETTERS_RUN.findall(t[b : _tokens_on(t, b, 3)])][:2]
        cue = 9.0 if before and (before[-1] in self.CUES or before[-2:] == ["name", "is"]) else 0.0
        at = dict(zip(_POSITIONS, [before[-1] if before else None, before[-2] if len(before) > 1 else None, after[0] if after else None, after[1] if len(after) > 1 else None], strict=True))
        return cue + sum(max(-2.0, self.one(p, w)) for p, w in at.items())


class Names:
    """Listed names, and what the corpus says about other words. ``words``: word -> (in lower case, capitalised)."""

    def __init__(self, rows: list[tuple[str, str]], words: dict[str, tuple[int, int]] | None = None, beside: dict[str, Counter] | None = None, least_spelling: float = 4.0) -> None:
        self.known: dict[str, set[str]] = {"given": set(), "surname": set()}
        for name, kind in rows:
            if name and kind in self.known and name.strip():
                self.known[kind].add(name.strip().lower())
        words = words or {}
        self.ordinary = {w for w, (low, up) in words.items() if low >= 3 and low >= up and (low > 200 or not any(w in k for k in self.known.values()) or low > 3 * up)}
        plain = [w for w in self.ordinary if not any(w in k for k in self.known.values())]
        self.spelling = {k: Spelling(v, plain) for k, v in self.known.items()}
        self.context = Context(beside or {}, {w: low + up for w, (low, up) in words.items()})
        self.least = least_spelling if plain else math.inf
        self.cache: dict[tuple[str, str], str] = {}

    def strength(self, word: str, kind: str) -> str:
        """strong, weak (listed, but an ordinary word), or an empty text; whether a word is capitalised is not looked at."""
        key = (word, kind)
        got = self.cache.get(key)
        if got is None:
            w = word.lower()
            parts = [x for x in re.split(r"['’]", w) if x]
            if w in self.ordinary or not parts:
                got = "weak" if w in self.known[kind] else ""
            else:
                got = "strong" if w in self.known[kind] or self.spelling[kind].odds(w) >= self.least else ""
            if len(self.cache) > 500_000:
                self.cache.clear()
            self.cache[key] = got
        return got

    def capital(self, word: str) -> bool:
        return len(word) > 1 and word[0].isupper() and not word.isupper() and word.isalpha() and word.lower() not in self.ordinary

    def anchors(self) -> set[str]:
        every = self.known["given"] | self.known["surname"]
        return {w[:3] for w in every if len(w) > 3} | {w for w in every if len(w) <= 3}


# Titles; particles of surnames.
_TITLE = r"(?:mr|mrs|ms|miss|mx|dr|prof|professor|sir|madam|doctor|herr|frau|mme)"
TITLES = tuple(_TITLE[3:-1].split("|"))
_PARTICLE = r"(?:(?:van|von|de|der|den|da|di|la|le|al|bin)\s+)"
_NAME_WORD = r"[^\W\d_]+(?:['’][^\W\d_]+)?"
_TITLE_AT = re.compile(rf"(?<!\w){_TITLE}\s*\.?\s+$", re.I)
_FULL = re.compile(rf"(?P<given>{_NAME_WORD})\s+(?:[A-Za-z]\s?\.\s*|[A-Za-z]\s+)?{_PARTICLE}{{0,2}}(?P<surname>{_NAME_WORD})(?P<rest>(?:\s?-\s?{_NAME_WORD})*)(?![\w@/])", re.I)
_TITLED = re.compile(rf"(?P<title>{_TITLE})\s*\.?\s+{_PARTICLE}{{0,2}}(?P<surname>{_NAME_WORD})(?P<rest>(?:\s?-\s?{_NAME_WORD})*)(?![\w@/])", re.I)
_TURNED = re.compile(rf"(?P<surname>{_NAME_WORD}(?:\s?-\s?{_NAME_WORD})*)\s*,\s*(?P<given>{_NAME_WORD})(?:\s+[A-Za-z]\.)?(?![\w@/])", re.I)
_JOINED = re.compile(r"(?:\s+(?:and|or|und|et|y)\s+|\s*(?:,|&)\s*)", re.I)


class NameParser:
    """Spans of names that begin at given places of a text."""

    def __init__(self, names: Names, least_context: float = 2.0) -> None:
        self.names, self.least = names, least_context

    def titled(self, t: str, a: int) -> tuple[int, int] | None:
        m = _TITLED.match(t, a)
        if not m or (m["title"].isupper() and len(m["title"]) < 4 and not m["surname"].isupper()):
            return None
        full = _FULL.match(t, m.start("surname"))
        if full and self.names.strength(full["given"], "given") and (self.names.strength(full["surname"], "surname") == "strong" or self.names.capital(full["surname"])):
            return a, full.end()
        first = re.split(r"['’]", m["surname"])[0]
        s = self.names.strength(m["surname"], "surname")
        return (a, m.end()) if s == "strong" or (s and m["surname"][0].isupper()) or self.names.capital(first) else None

    def full(self, t: str, a: int, joined: bool = False) -> tuple[int, int] | None:
        m = _FULL.match(t, a)
        if not m:
            return None
        n, g, s = self.names, m["given"], m["surname"]
        of, last = n.strength(g, "given"), n.strength(s, "surname")
        caps = g[0].isupper() and s[0].isupper()
        if "strong" in (of, last) and of and last:
            return m.span()
        if not of and not (caps and n.capital(g)) or not last and not (caps and n.capital(s)):
            return None
        if of == "strong" and not joined and caps and not n.strength(s, "given"):
            return m.span()
        least = self.least + (0 if of or last else 1)
        return m.span() if joined or n.context.odds(t, *m.span()) >= least else None

    def turned(self, t: str, a: int) -> tuple[int, int] | None:
        m = _TURNED.match(t, a)
        if not m:
            return None
        last = self.names.strength(re.split(r"\s?-", m["surname"])[0], "surname")
        of = self.names.strength(m["given"], "given")
        return m.span() if last == "strong" and (of == "strong" or (of and m["given"][0].isupper() and m["surname"][0].isupper())) else None

    def around(self, t: str, a: int, b: int) -> list[tuple[int, int]]:
        """All names that have the word over the anchor at a..b in them, or follow it, each with names joined to it by "and" or a comma."""
        while a > 0 and t[a - 1].isalpha():
            a -= 1
        starts = [a]
        for _ in range(4):  # a surname may follow a given name, an initial and two particles
            x = a
            while x > 0 and (t[x - 1].isspace() or t[x - 1] in ".-"):
                x -= 1
            if x == a:
                break
            y = x
            while y > 0 and (t[y - 1].isalpha() or t[y - 1] in "'’"):
                y -= 1
            if y == x:
                break
            starts.append(a := y)
        for s in reversed(starts):
            if s > 0 and (t[s - 1].isalnum() or t[s - 1] in "_@/-"):
                continue
            title = _TITLE_AT.search(t, max(0, s - 14), s)
            span = self.titled(t, title.start() if title else s) or self.full(t, s) or self.turned(t, s)
            if span and title:
                span = (title.start(), span[1])
            if span and span[1] > starts[0]:
                out = [span]
                while (j := _JOINED.match(t, out[-1][1])) and (more := self.titled(t, j.end()) or self.full(t, j.end(), joined=True)):
                    out.append(more)
                return out
        return []

    def after_cue(self, t: str, a: int, b: int) -> list[tuple[int, int]]:
        while b < len(t) and (t[b].isalpha() or t[b] in ".:"):
            b += 1
        c = b
        while c < len(t) and t[c] in " ,-\n":
            c += 1
        return self.around(t, c, c + 1) if b < c < len(t) and t[c].isupper() else []


_ANY_DIGIT = re.compile(r"\d")
_PAIRS = tuple(f"{i:02d}" for i in range(100))


class Finder:
    """The automaton over all anchors, and the parser of each."""

    def __init__(self, names: list[tuple[str, str]], table: dict[str, str] | None = None, words: dict[str, tuple[int, int]] | None = None, beside: dict[str, Counter] | None = None) -> None:
        self.looks = L.Looks(table or {})
        cues: dict[str, list] = defaultdict(list)
        for x in ("@",):
            cues[x].append(("email", email_at_sign))
        for x in (" at ", "(at)", "[at]", "( at )", "[ at ]", "{at}"):
            cues[x].append(("spoken", email_spoken))
        for kind, labels in {
            "ssn": ("ssn", "social security", "sozialversicherung"), "insurance": ("insurance", "ni number", "nino"), "passport": ("passport", "reisepass"),
            "licence": ("licence", "license", "führerschein"), "personal": ("personal id", "id no", "id number", "identity", "national id", "id card", "personal number"),
        }.items():
            for x in labels:
                cues[x].append(("id_number", id_after(kind)))
        for x in f"{_TYPES}|{_SHORT}".split("|"):
            cues[f" {x}"].append(("street", street))
        for x in ("straße", "strasse", "str.", "weg ", "platz ", "gasse ", "allee "):
            cues[x].append(("address", strasse))
        for x in ("calle ", "avenida ", "plaza ", "paseo ", "rua "):
            cues[x].append(("address", calle))
        for x in ("rue ", "quai ", "chemin ", "avenue ", "boulevard "):
            cues[x].append(("address", rue))
        for x in ("box",):
            cues[x].append(("address", box))
        for x in _PAIRS:
            cues[x].append(("digits", None))
        for x in ("zero", "double", "three", "four", "five", "six", "seven", "eight", "nine"):
            cues[x + " "].append(("said", None))
        n = Names(names, words, beside)
        self.parse_name = NameParser(n)
        for x in n.anchors():
            cues[x].append(("name", self.parse_name.around))
        for x in TITLES:
            cues[x].append(("title", self.parse_name.around))
        context = n.context
        strong = sorted((-context.one("before", w), w) for w, c in context.beside.get("before", {}).items() if c > 1 and w.isalpha())
        for x in {w for odds, w in strong[:200] if odds < -1} | Context.CUES | {"is"}:
            cues[x].append(("cue", self.parse_name.after_cue))
        self.automaton = ahocorasick.Automaton()
        for x, v in cues.items():
            self.automaton.add_word(x, (len(x), tuple(v)))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(begin, end, kind) in order, without overlaps."""
        t, at = self.looks.aligned(text)
        low = t.lower()
        if len(low) != len(t):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
        found: list[tuple[int, int, str]] = []
        digits: list[list[int]] = []
        said = -1
        for end, (n, parsers) in self.automaton.iter(low):
            a, b = end - n + 1, end + 1
            for kind, parse in parsers:
                # guards that cost less than a parser's expressions
                if kind in ("name", "title", "cue"):
                    if (a and low[a - 1].isalnum()) or (kind != "name" and low[b : b + 1].isalnum()):
                        continue
                    if kind == "name":
                        e = b
                        while e < len(low) and low[e].isalpha():
                            e += 1
                        w = low[a:e]
                        if not (self.parse_name.names.strength(w, "surname") or self.parse_name.names.strength(w, "given")):
                            continue
                    found += [(*span, "name") for span in parse(t, a, b)]
                    continue
                elif kind == "street":
                    if low[b : b + 1].isalnum() or not _ANY_DIGIT.search(low, _tokens_back(low, a, 9), a):
                        continue
                    kind = "address"
                elif kind == "spoken":
                    if n < 5 and low[a:b] == " at " and "dot" not in low[b : _tokens_on(low, b, 3)]:
                        continue
                    kind = "email"
                if parse is not None:
                    span = parse(t, a, b)
                    if span:
                        found.append((*span, kind))
                elif kind == "digits":
                    if digits and a <= digits[-1][1] + 14:
                        digits[-1][1] = b
                    else:
                        digits.append([a, b])
                elif a > said and (m := _SAID.match(t, a)):
                    found.append((*m.span(), "phone"))
                    said = m.end()
        for a, b in digits:
            found += numbers(t, max(0, a - 12), min(len(t), b + 24))
        out: list[tuple[int, int, str]] = []
        for s, e, k in sorted(set(found), key=lambda x: (KINDS.index(x[2]), x[0], -x[1])):
            if all(e <= x[0] or s >= x[1] for x in out):
                out.append((s, e, k))
        out.sort()
        return out if at is None else [(at[s], at[e - 1] + 1, k) for s, e, k in out]

    def redact(self, text: str | None) -> tuple[str | None, list[str]]:
        if not text:
            return text, []
        spans = self.find(text)
        if not spans:
            return text, []
        out, last = [], 0
        for s, e, k in spans:
            out += [text[last:s], f"[{k.upper()}]"]
            last = e
        return "".join([*out, text[last:]]), sorted({k for _, _, k in spans})


def count_words(texts, known: dict[str, set[str]], counts: Counter) -> None:
    """Adds (word, what) counts: lower and upper for each word, and its position beside listed full names."""
    given, surname = known["given"], known["surname"]
    for t in texts:
        if not t:
            continue
        runs = _LETTERS_RUN.findall(t)
        low = [w.lower() for w in runs]
        for w, x in zip(runs, low, strict=True):
            counts[x, "lower" if w == x else "upper"] += 1
        for i, x in enumerate(low):
            if x in given:
                j = i + 2 if i + 2 < len(low) and len(low[i + 1]) == 1 else i + 1
                if j < len(low) and low[j] in surname:
                    for p, k in zip(_POSITIONS, (i - 1, i - 2, j + 1, j + 2), strict=True):
                        if 0 <= k < len(low):
                            counts[low[k], p] += 1


def split_counts(rows) -> tuple[dict[str, tuple[int, int]], dict[str, Counter]]:
    """rows of (word, lower, upper, *positions) as the two tables that :class:`Names` takes."""
    words, beside = {}, {p: Counter() for p in _POSITIONS}
    for w, low, up, *rest in rows:
        words[w] = (low, up)
        for p, n in zip(_POSITIONS, rest, strict=True):
            if n:
                beside[p][w] = n
    return words, beside


def statistics_of(texts, names: list[tuple[str, str]]):
    """The statistics of texts that are at hand."""
    counts: Counter = Counter()
    count_words(texts, Names(names).known, counts)
    return split_counts((w, *(counts[w, k] for k in ("lower", "upper", *_POSITIONS))) for w in {w for w, _ in counts})


def _count_rows(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, counts = Names(shared.value).known, Counter()

        def rows() -> pd.DataFrame:
            return pd.DataFrame([(w, k, n) for (w, k), n in counts.items()], columns=["word", "what", "n"])

        for b in batches:
            count_words(b["body"], known, counts)
            if len(counts) > 300_000:  # partial counts; Spark sums them
                yield rows()
                counts = Counter()
        yield rows()

    return run


def name_statistics(entries: DataFrame, names: list[tuple[str, str]], most_words: int = 100_000) -> list[tuple]:
    """(word, lower, upper, *positions) of the most frequent words of all bodies; at most ``most_words`` rows reach the driver."""
    shared = entries.sparkSession.sparkContext.broadcast(names)
    counted = entries.where("body is not null").select("body").mapInPandas(_count_rows(shared), "word string, what string, n bigint")
    kinds = ("lower", "upper", *_POSITIONS)
    sums = counted.groupBy("word").agg(*(F.sum(F.when(F.col("what") == k, F.col("n")).otherwise(0)).alias(k) for k in kinds))
    top = sums.where("lower + upper > 1").orderBy((F.col("lower") + F.col("upper")).desc(), "word").limit(most_words)
    return [tuple(r) for r in top.collect()]


def _rows(shared, keep_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, table, counted = shared.value
        f = Finder(names, table, *split_counts(counted))
        for b in batches:
            done = [[f.redact(x) for x in b[c]] for c in FIELDS]
            out = {"id": b["id"]}
            for c, d in zip(FIELDS, done, strict=True):
                if keep_text:
                    out[f"{c}_redacted"] = [x[0] for x in d]
                out[f"{c}_kinds"] = [x[1] for x in d]
            yield pd.DataFrame(out)

    return run


def _names(name_parts: DataFrame, most: int) -> list[tuple[str, str]]:
    rows = name_parts.select("name", "kind").where("name is not null and kind is not null").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the name list has more than {most} rows; it is broadcast and must be smaller")
    return [tuple(r) for r in rows]


def _shared(entries: DataFrame, name_parts: DataFrame, most_names: int):
    spark = entries.sparkSession
    names = _names(name_parts, most_names)
    return spark.sparkContext.broadcast((names, L.confusables(spark), name_statistics(entries, names)))


def redacted(entries: DataFrame, name_parts: DataFrame, most_names: int = 200_000) -> DataFrame:
    """Every row's two texts with placeholders, and the kinds found in each."""
    shared = _shared(entries, name_parts, most_names)
    schema = "id string, " + ", ".join(f"{c}_redacted string, {c}_kinds array<string>" for c in FIELDS)
    return entries.select("id", *FIELDS).mapInPandas(_rows(shared, True), schema)


def found(entries: DataFrame, name_parts: DataFrame, most_names: int = 200_000) -> DataFrame:
    """(id, field, kind), once each."""
    shared = _shared(entries, name_parts, most_names)
    schema = "id string, " + ", ".join(f"{c}_kinds array<string>" for c in FIELDS)
    k = entries.where("id is not null").select("id", *FIELDS).mapInPandas(_rows(shared, False), schema)
    fields = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"{c}_kinds").alias("kinds")) for c in FIELDS))
    return k.where(" or ".join(f"size({c}_kinds) > 0" for c in FIELDS)).select("id", F.explode(fields).alias("f")).select("id", "f.field", F.explode("f.kinds").alias("kind")).distinct()
