"""Patterns and word lists. Every table is a parameter default; pass your own to change products or words."""

from __future__ import annotations

# Product-name patterns. Detection works on free text, canonical names on normalised tokens.
SUFFIX = r"(?:[-\s]?(?:turbo|mini|nano|preview|vision|audio|realtime|instruct))*"
VERSION = r"(?:3(?:\.5)?|4(?:\.1|\.5|o)?|5)"
END = r"(?:'s)?(?=$|\s|[.,!?;:](?=\s|$))"
DETECT = {
    "gpt-4o": rf"\bgpt[-\s]?4o{SUFFIX}{END}",
    "gpt-4.5": rf"\bgpt[-\s]?4\.5{SUFFIX}{END}",
    "gpt-4.1": rf"\bgpt[-\s]?4\.1{SUFFIX}{END}",
    "gpt-4": rf"\bgpt[-\s]?4{SUFFIX}{END}",
    "gpt-3.5": rf"\bgpt[-\s]?3\.?5{SUFFIX}{END}",
    "gpt-5": rf"\bgpt[-\s]?5{SUFFIX}{END}",
    "chatgpt": rf"\bchat[-\s]?gpt(?:[-\s]?{VERSION})?{SUFFIX}{END}",
    "gpt": rf"\bgpt(?:[-\s]?{VERSION})?{SUFFIX}{END}",
}
CANONICAL = {"gpt-4o": "^(?:CHAT)?GPT4O", "gpt-4": "^(?:CHAT)?GPT4", "gpt-3.5": "^(?:CHAT)?GPT3", "gpt-5": "^(?:CHAT)?GPT5", "chatgpt": "^(?:CHAT)?GPT"}
EXTRA = {"model": "(?i)^gpt$", "tool": "(?i)^tool$", "agent": "(?i)^agent$", "bot": "(?i)^bot$", "assistant": "(?i)^assistant$", "chatbot": "(?i)^chatbot$", "LLM": "(?i)^llm$"}
# Categories of skipped texts, first match wins; sub-categories of one of them.
SKIPPED = (("_URL_", "(?i)_URL_"), ("_SUBREDDIT_", "(?i)_SUBREDDIT_"), ("cgpt_mentions", r"(?iU)\bcgpt(?:[-\s]?([345]|4\.5|4\.1|4o|5))?\b"), ("chatgpt_mentions", r"(?iU)\bchat[-\s]?gpt(?:[-\s]?([345]|4\.5|4\.1|4o|5))?\b"))
SKIPPED_SUB = (
    ("chatgpt_possessive", r"(?iU)\bchat[-\s]?gpt['’]s\b"),
    ("chatgpt_hyphen", r"(?iU)\bchat[-\s]?gpt(?:[-\s]?(?:[345]|4\.5|4\.1|4o|5))?-\w+"),
    ("chatgpt_symbol", r"(?iU)\bchat[-\s]?gpt[+*/=]"),
)
# Personal pronouns, and the list with three entries run together that older results were made with.
PRONOUNS = (
    "i me myself mine you yourself yours he him himself his she her herself hers it itself its we us ourselves ours they them themselves yourselves theirs".split()
)
PRONOUNS_COMPAT = (
    "i me myself mine you yourselfyours he him himself his she her herself hers it itself its we us ourselves oursthey them themselves yourselves theirs".split()
)
# The English stop words that the word tables are filtered with, a public list of 179.
STOPWORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers herself it it's its itself they them their theirs themselves "
    "what which who whom this that that'll these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against "
    "between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such "
    "no nor not only own same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't "
    "isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()
# The characters that cleaning blanks or unifies, in the two profiles.
CLEAN_PIPELINE = [
    ("[‑‒–—―−•‣…‰‱،؛؟、。「」！，：；？]", " "),
    ("['`´‘’‚‛′‵ʻʼʹ]", "'"),
    ('["“”„‟«»＂]', '"'),
    (r"[*#_~\\/|]", " "),
    (r'([!?,;:()\[\]{}"])', " $1 "),
    ("'s", " 's"),
]
CLEAN_TESTER = [
    ("[‑-―−•‣‰‱،؛؟、。「」！，：；？]", " "),
    ("[‘’`´]", "'"),
    ('["“”„‟«»＂]', '"'),
    (r"[*#~\\/|]", " "),
    ("…", "..."),
    (r"([.!?]){2,}", "$1"),
    (r"""([()\[\]{}"'`])""", " $1 "),
    ("'s", " 's"),
]
