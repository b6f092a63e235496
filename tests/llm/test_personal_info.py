import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import personal_info as P

HEADS, TAILS = ("Bremm", "Crald", "Dask", "Ferrl"), ("hurst", "more", "berg", "stead")
NAMES = [(h + t, "surname") for h in HEADS for t in TAILS if (h, t) != ("Dask", "berg")] + [("Baker", "surname"), ("Page", "surname")]
NAMES += [(h + t, "given") for h in ("Ari", "Dor", "Lun", "Kas") for t in ("anda", "eth", "ona", "wick")] + [("Will", "given"), ("Mark", "given"), ("Grant", "given")]
PROSE = """the build is out and it works for me while my friends say that their tests pass on every machine they have. we will mark
the page with a note about what the baker said when he made the bread, then grant access to those who will need it for some time.
you can page through the prompt to see how a model will answer a careful question in a quick way; mark it up, ask it, read it again.
people who write about the work of others should say so, because will power alone does not mark a good writer nor grant a prize."""
WORDS, _ = P.statistics_of([PROSE] * 5, NAMES)
F = P.Finder(NAMES, None, WORDS)

CASES = [
    ("Mail me at a.b+c09@mail.example.test, thanks.", "Mail me at [EMAIL], thanks.", ["email"]),
    ("reach silver-piston at corp dot works dot example if you", "reach [EMAIL] if you", ["email"]),
    ("amber [ at ] inkbox [ dot ] test", "[EMAIL]", ["email"]),
    ("velvet+otter67(at)inkbox.test or", "[EMAIL] or", ["email"]),
    ("Call me on +44 (0)1632 960850.", "Call me on [PHONE].", ["phone"]),
    ("Tel: 1-555-555-0185 ext. 518 ok", "Tel: [PHONE] ok", ["phone"]),
    ("whatsapp 5555550145 works", "whatsapp [PHONE] works", ["phone"]),
    ("ring five five five, zero one two three four now", "ring [PHONE] now", ["phone"]),
    ("My SSN is 919-69-7847, so", "My SSN is [ID_NUMBER], so", ["id_number"]),
    ("social security number 983 45 2466 was", "social security number [ID_NUMBER] was", ["id_number"]),
    ("NI number QQ094551D went", "NI number [ID_NUMBER] went", ["id_number"]),
    ("driver's license X0754-08464-46885 was", "driver's license [ID_NUMBER] was", ["id_number"]),
    ("Personal ID no. 532824-6104 is", "Personal ID no. [ID_NUMBER] is", ["id_number"]),
    ("I live at flat 6, 137 Greyvalegate Row.", "I live at [ADDRESS].", ["address"]),
    ("at Calle Tallow 80, 3 B, second", "at [ADDRESS], second", ["address"]),
    ("to PO Box 3279, Greyvale please", "to [ADDRESS] please", ["address"]),
    ("place Hollingtonstraße 73a now", "place [ADDRESS] now", ["address"]),
    ("ask arieth k. daskberg-cralddmore", None, ["name"]),
    ("My name is KASONA BREMMHURST.", "My name is [NAME].", ["name"]),
    ("signed, Craldmore, Lunona", "signed, [NAME]", ["name"]),
    ("Dr. Ferrlstead said", "[NAME] said", ["name"]),
    ("my name is will baker.", "my name is [NAME].", ["name"]),
    ("Please contact John Smith or Maria Garcia", "Please contact [NAME] or [NAME]", ["name"]),
    ("My name is Priya Raman", "My name is [NAME]", ["name"]),
    ("Dr. Okonkwo said so", "[NAME] said so", ["name"]),
    ("Mr. Smith lives at 12 Oak Street", "[NAME] lives at [ADDRESS]", ["address", "name"]),
    ("a" * 81 + "@x.com", "[EMAIL]", ["email"]),
    ("to " + "b.c+" * 60 + "d@x.example.com now", "to [EMAIL] now", ["email"]),
    ("passport no." + " " * 90 + "X1234567 x", "passport no." + " " * 90 + "[ID_NUMBER] x", ["id_number"]),
    ("at 12 " + "Verylong" * 12 + " Street, ok", "at [ADDRESS], ok", ["address"]),
]
PLAIN = [
    "Install numkit@0.7.59 first.", "Meet @ noon, then a 24 hour drive.", "no dr@vscum here", "ISBN 000-0-00-444964-0 is gone", "Ticket 4866-40826 is open", "Seed 1145403128 gives", "The build 2024-09-18 broke", "version 10.0.378.24",
    "Road to 47 prompts, avenue by avenue.", "a two way street of ideas", "My name is on the list, sadly.", "Mark up the text, Grant access", "the baker will page me", "u/rapid-willow, will do.", "Kasona G. wrote", "It cost 1,222.50 for 397717 tokens", "look at the dot", "Error code 0x264278 at line 3892.", "What a GPT-4 careful way to go", "What a gpt 4 quick way to go", "I use MS Word daily", "with Fane Pro it works", "Two Words here and There",
]


@pytest.mark.parametrize("text,want,kinds", CASES)
def test_found(text, want, kinds):
    got, k = F.redact(text)
    assert k == kinds and (want is None or got == want)


@pytest.mark.parametrize("text", PLAIN)
def test_left_alone(text):
    assert F.redact(text) == (text, [])


def test_spelling_is_learned_from_the_list():
    n = P.Names(NAMES, WORDS)
    for k in n.known:
        held = [w for w in sorted(n.known[k]) if len(w) > 5]
        hits = 0
        for w in held:  # each name is judged by the others
            hits += P.Spelling(n.known[k] - {w}, list(n.ordinary)).odds(w) >= n.least
        assert hits >= 0.9 * len(held), k
        full = P.Spelling(n.known[k], list(n.ordinary))
        assert not [w for w in n.ordinary if w not in n.known[k] and full.odds(w) >= n.least]
    assert P.Names(NAMES).strength("Daskberg", "surname") == ""  # without a corpus only listed names are known


def test_context_is_learned_from_listed_names():
    given, surname = [x for x, k in NAMES if k == "given"], [x for x, k in NAMES if k == "surname"]
    texts = [f"yesterday the plumber {g} {s} fixed it" for g, s in zip(given, surname, strict=False)] + [PROSE] * 5
    words, beside = P.statistics_of(texts, NAMES)
    f = P.Finder(NAMES, None, words, beside)
    assert f.redact("so the plumber Anna Kowal fixed it") == ("so the plumber [NAME] fixed it", ["name"])
    assert f.redact("they will page us")[1] == [] and f.redact("we use Anna Kowal here")[1] == []


def test_look_alike_characters_keep_the_rest(spark):
    f = P.Finder(NAMES, P.L.confusables(spark), WORDS)
    assert f.redact("ﬁne: my SSN is 919‑69‑7847 ​ｏk")[0] == "ﬁne: my SSN is [ID_NUMBER] ​ｏk"


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("0123456789@.- at dot İ​")), max_size=60))
def test_any_text_keeps_what_is_around(t):
    spans = F.find(t)
    assert all(0 <= a < b <= len(t) for a, b, _ in spans)
    got, _ = F.redact(t)
    pos = 0
    for part in [t[x:y] for x, y in zip([0] + [b for _, b, _ in spans], [a for a, _, _ in spans] + [len(t)])]:
        pos = got.index(part, pos) + len(part)


def test_tables(spark):
    rows = [("1", CASES[0][0], None, "x"), ("1", CASES[0][0], None, "y"), ("2", None, "ask Ariona Daskberg", "z"), ("3", "", "", None), (None, CASES[0][0], None, None), ("4", "word " * 60000 + CASES[4][0], "x", None)]
    e = spark.createDataFrame(rows, "id string, body string, cleaned_text string, kind string")
    n = spark.createDataFrame([(*x, 1) for x in NAMES] + [(None, None, 1)], "name string, kind string, id int")
    assert sorted(map(tuple, P.found(e, n).collect())) == [("1", "body", "email"), ("2", "cleaned_text", "name"), ("4", "body", "phone")]
    r = {x.id: x for x in P.redacted(e, n).collect()}
    assert r["2"].body_redacted is None and r["2"].cleaned_text_redacted == "ask [NAME]" and r["3"].body_redacted == "" and r["4"].body_redacted.endswith("[PHONE].")
    assert P.found(e, n.limit(0)).count() == 2 and P.found(e.limit(0), n).count() == 0
