import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from curaspark.llm import tokencount

BYTES = [(f"<0x{b:02X}>", -2.0) for b in range(256)]


def library(pieces, byte_fallback=True):
    tok = Tokenizer(models.Unigram([("<unk>", -20.0), *pieces], 0, byte_fallback))
    tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace("▁", "always", True)])
    return tok


@settings(max_examples=150, deadline=None)
@given(
    st.dictionaries(st.text("abc▁é", min_size=1, max_size=4), st.integers(-6, -1).map(float), max_size=25),
    st.lists(st.text("abcdé漢", min_size=1, max_size=14), max_size=5),
    st.booleans(),
)
def test_same_counts_as_the_library(pieces, words, byte_fallback):
    vocab = [*BYTES, *pieces.items()]
    mine = tokencount.Unigram([("<unk>", -20.0), *vocab], byte_fallback)
    text = " ".join(words)
    assert mine.count(text.encode())[0] == len(library(vocab, byte_fallback).encode(text).ids)


def test_public_vocabulary_against_the_library():
    import public_tokenizers

    pieces = tokencount.piece_table(public_tokenizers.path("piece_bpe_32k.model"))
    tok = Tokenizer(models.Unigram(pieces, 0, True))
    tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace("▁", "always", True)])
    mine = tokencount.Unigram(pieces)
    rng = np.random.default_rng(0)
    for text in ["The quick brown fox", "", "  ", "thntblere ofnd ciónmente ß 漢字 \U0001f600", "a" * 5000, *("".join(rng.choice(list("etaoin shrdlu éß,.!")) for _ in range(300)) for _ in range(30))]:
        assert mine.count(text.encode())[0] == len(tok.encode(text).ids)


def test_table(spark):
    import public_tokenizers

    df = spark.createDataFrame([(1, None, 1), (None, "", 2), (3, "hello there world", 3), (3, "hello there world", 3), (4, "x" * 100_000, 4)], "doc_id long, text string, n_tokens long")
    got = tokencount.counted(df, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert [(r.doc_id, r.n_words) for r in got] == [(1, 0), (None, 0), (3, 3), (3, 3), (4, 1)]
    assert got[0].n_tokens == 0 and got[2].n_tokens == got[3].n_tokens >= 3
    assert tokencount.counted(df.limit(0), public_tokenizers.path("piece_bpe_32k.model")).collect() == []
    assert tokencount.Unigram([]).count(b"ab c") == pytest.approx((2, -50.0, 2))
