"""The tokenizer of a worker remembers the words met last."""

from sheaf.llm import packing


def test_words_met_last_stay_remembered(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(packing, "REMEMBERED", 200)
    tokens = packing.Tokens(public_tokenizers.path("word_bpe_49k.json"))
    learned, learn = [], tokens._learn
    monkeypatch.setattr(tokens, "_learn", lambda words: (learned.extend(words), learn(words)))
    letters = "abcdefghij"
    for k in range(60):
        rare = " ".join("".join(letters[int(d)] for d in str(10_000 + 30 * k + n)) + "." * (n % 2) for n in range(30))
        text = f"house {rare} garden, café x1"
        got = tokens([text.encode(), b"house"])
        assert list(memoryview(got[0]).cast("I")) == tokens.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(tokens.known) + len(tokens.older) < 400
    assert learned.count(b"house") == learned.count(b"garden,") == learned.count(b"x1") == 1
