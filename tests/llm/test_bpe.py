import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import bpe

RANKS = bpe.load()
ENC = bpe.Encoder(RANKS)
REF = tiktoken.Encoding("ref", pat_str=bpe.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aab the'sll  \n\t123")), max_size=80))
def test_same_as_the_reference_encoder(t):
    assert ENC.encode(t) == REF.encode_ordinary(t)


@pytest.mark.parametrize("t", ["a" * 3000, "ab" * 2000, "<|endoftext|> x", "х" * 500, "=" * 1001, "the" * 700, "‍" * 50, " " * 300 + "x"])
def test_long_pre_tokens(t):
    assert ENC.encode(t) == REF.encode_ordinary(t)
    assert not ENC.queue.top and not ENC.queue.at


def test_rows(spark):
    rows = [(1, "Hello world", 5), (2, None, 5), (3, "", 5), (4, "Hello world", 5), (5, " \n", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = {r.doc_id: list(r.ids) for r in bpe.encode_documents(df).collect()}
    assert got == {d: REF.encode_ordinary(t or "") for d, t, _ in rows}
    assert bpe.encode_documents(df.limit(0)).count() == 0
