"""Words of letters and marks are not given to the tokenizer one by one, and have its ids."""

import numpy as np
import pytest

from sheaf.llm import packing

ODD = ["heed***", "aneawh.%%%", "a'b", "it's", "x''s.", "'''", "...", "é!!", "Été)'", "(a)", "a|>", "<|b", "a_b_", "n~", "c`", "K!!", "é?!", "́!",
       "YENİ!!", "अकक़?!", "≠", "a≠", "한국;;", "한!", "ǅ--", "12!!", "a1!", "a\x7f!", "a !", "שׁ--", "Ⅷ!", "ª+", "z" * 300 + "!!", "😀!!", "ß@@"]


def path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_marks_are_encoded_apart_from_their_words(monkeypatch):
    tokens = packing.Tokens(path())
    alone, each = [], tokens._each
    monkeypatch.setattr(tokens, "_each", lambda words: (alone.extend(words), each(words)))
    text = "heed*** annd*** and%%% thonre!! eau!! éa!! éa*** house, (b) x1"
    got = tokens([text.encode(), b"heed***"])
    assert np.frombuffer(got[0], "<u4").tolist() == tokens.tokenizer.encode(text, add_special_tokens=False).ids
    assert sorted(alone) == [b"!!", b"%%%", b"(b)", b"***", b"x1"]


@pytest.mark.parametrize("model", [True, False])
def test_odd_words_have_the_tokenizers_ids(model):
    tokens = packing.Tokens(path())
    assert tokens.model is not None
    if not model:
        tokens.model = None
    for text in [*ODD, " ".join(ODD), "<|endoftext|> A!! " + " ".join(ODD), "ABC<|endoftext|>DEF!! QUX É!!"]:
        ids = tokens.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(tokens([text.encode()])[0], "<u4").tolist() == ids, text


def test_another_tokenizer_gets_stretches_as_whole_texts(tmp_path):
    import json

    with open(path()) as file:
        other = json.load(file)
    other["normalizer"]["normalizers"].append({"type": "Replace", "pattern": {"String": "e"}, "content": "o"})
    (tmp_path / "other.json").write_text(json.dumps(other))
    tokens = packing.Tokens(str(tmp_path / "other.json"))
    assert tokens.model is None
    text = "heed*** house, été!!"
    assert np.frombuffer(tokens([text.encode()])[0], "<u4").tolist() == tokens.tokenizer.encode(text, add_special_tokens=False).ids
