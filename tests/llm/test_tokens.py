import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemill.llm.tokens import WordTokenizer

TEXTS = [
    None, "", " ", "\n", "a", "It's a  b\n\nc \n d\te ", "Éléphant, naïve?don't stop1 2nd 3.4\nNew Line.",
    "x\u00a0y\u2003z", "a\x1cb\x1d!", "say <|endoftext|> now", "<|startoftext|>", "thnd###$$$ he|the (x) _y_ Ünï_cödé9x",
    "e\u0301\u0327 combining \u0301alone", "日本語 テキスト。終わり", "½x²y ١٢٣abc", "\x01", "ΣΑΣ ΌΣΟΣ", "a'S 'll'tis''s", "😀 smile😀d!",
    " lead", "trail ", "tab\there\r\nwin", "word " * 5000 + "end.", "longword" * 3000,
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_same_ids_as_the_library(name):
    path = public_tokenizers.path(name)
    own, library = WordTokenizer(path), Tokenizer.from_file(path)
    for _ in range(2):  # once with an empty store
        for text, ids in zip(TEXTS, own.encode(TEXTS), strict=True):
            want = library.encode(text or "", add_special_tokens=False).ids
            assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == want, repr(text)[:60]


def test_a_full_store_changes_nothing():
    path = public_tokenizers.path("byte_bpe_50k.json")
    a, b = WordTokenizer(path), WordTokenizer(path)
    a.store.limit = 2
    for _ in range(3):
        assert a.encode(TEXTS) == b.encode(TEXTS)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_joined_pieces_have_the_ids_of_single_ones(name):
    own = WordTokenizer(public_tokenizers.path(name))
    texts = ["", " a", "a<|", "<|endoftext", "|>b", "̸x", "é", "\n", "don't", "", "日本", " 12", "x" * 3000, ">", "<", ""]
    for k in range(40):
        some = (texts[k % 16 :] + texts[: k % 16]) * (1 + k % 20)
        assert own.pieces(some) == own.whole(some)
    assert own.pieces([]) == []
    own.mark = None
    assert own.pieces(texts) == own.whole(texts)
