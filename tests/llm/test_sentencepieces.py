import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from sigtrace.llm import sentencepieces as S

from .helpers import documents, odd_columns

MODEL = public_tokenizers.path("piece_bpe_32k.model")
CODEC = S.codec(MODEL)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t▁abcthe.,!<s>_0179é漢́\x00"), st.characters(codec="utf-8")), max_size=40))
def test_ids_and_text_equal_the_library(text):
    coded, plain = CODEC.encode_all([text])
    ids = CODEC.library.encode(text)
    assert S.numbers(coded[0]).tolist() == ids and plain[0] == CODEC.library.decode(ids) == CODEC.decode(ids)


def test_list_and_heap_agendas_agree():
    for unit in ("▁internationalization", "▁" * 9 + "ababab", "aaaaaaaaaaa", "x", "日本語テキスト"):
        assert CODEC.joined(unit) == CODEC.joined_by_heap(unit)
    long = "▁" + "thequickbrownfox" * 2000
    assert CODEC.merge(long) == CODEC.library.encode(long[1:])


def test_cache_is_dropped_without_harm(monkeypatch):
    monkeypatch.setattr(S, "KEPT_UNITS", 1)
    texts = ["one two", "two three", None, "", "one"]
    assert CODEC.encode_all(texts)[1] == ["one two", "two three", "", "", "one"]


def test_rows(spark):
    texts = [None, "", " ", "Hello  world\n\n é", "w" * 100_000, "Hello  world\n\n é"]
    got = S.encode(odd_columns(documents(spark, list(enumerate(texts)))), MODEL, with_ids=True).collect()
    for row in got:
        text = texts[row.doc_id] or ""
        ids = CODEC.library.encode(text)
        assert row.n_tokens == len(ids) and list(row.ids) == ids and row.decoded == text
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(CODEC.library.decode(ids).encode()).hexdigest()
    assert len(got) == len(texts) and S.encode(documents(spark, []), MODEL).count() == 0
