import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from tokenizers import Tokenizer

from quire.llm import bpe, tokens

ENC = bpe.Encoder()
LIB = Tokenizer.from_file(bpe.DEFAULT_TOKENIZER)
LIB.encode_special_tokens = True


def lib(texts):
    return [e.ids for e in LIB.encode_batch(texts, add_special_tokens=False)]


def own(texts):
    return [np.frombuffer(b, np.int32).tolist() for b in ENC.encode(texts)]


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab 'st\n\t  é9.,-“​"), st.characters(exclude_categories=["Cs"])), max_size=60), min_size=1, max_size=8))
def test_same_ids_as_the_library(texts):
    assert own(texts) == lib(texts)


def test_long_words_and_odd_space():
    texts = ["a" * 3000, "=-" * 700, "x  y", " \n z", "tail ", "", "<|endoftext|>", "Ünïcödé" * 40]
    assert own(texts) == lib(texts)


def test_round_trip():
    text = "It was “said” — by 12,345 people\r\n\tin  Zösodorf…"
    assert LIB.decode(own([text])[0], skip_special_tokens=False) == text


def test_bounded_memo_gives_the_same():
    small = bpe.Encoder(max_memo=5)
    texts = [f"word{i} and more {i * 7}" for i in range(40)]
    assert [np.frombuffer(b, np.int32).tolist() for b in small.encode(texts[:20]) + small.encode(texts[20:])] == lib(texts)


def test_frame(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "   ", "x"), (None, "two words", "x"), (5, "two words", "x"), (5, "two words", "x"), (6, "long " * 60_000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted(((r.doc_id, r.ids) for r in tokens.token_ids(df).collect()), key=str)
    assert got == sorted([(1, []), (2, []), (3, lib(["   "])[0]), (None, lib(["two words"])[0]), (5, lib(["two words"])[0]), (5, lib(["two words"])[0]), (6, lib(["long " * 60_000])[0])], key=str)
    counts = {(r.doc_id, r.n_tokens) for r in tokens.token_counts(df).collect()}
    assert counts == {(i, len(x)) for i, x in got}
    assert tokens.token_ids(df.limit(0)).count() == 0


def test_missing_vocabulary(spark):
    with pytest.raises(FileNotFoundError):
        bpe.Encoder("/nowhere.json")
