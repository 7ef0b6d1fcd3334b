"""Pieces around whole windows give the library's tokens, with certain tokens given out only while bytes follow."""

import tiktoken

import public_tokenizers
from sheaf.llm import bytepairs


def test_pieces_of_whole_windows(monkeypatch):
    coder = bytepairs.Coder()
    library = tiktoken.Encoding("library", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.transducer.ranks, special_tokens={})
    asked = []
    certain = coder.transducer._certain
    monkeypatch.setattr(coder.transducer, "_certain", lambda ends: asked.append(len(ends)) or certain(ends))
    for n, windows in ((bytepairs.WINDOW - 1, 0), (bytepairs.WINDOW, 0), (bytepairs.WINDOW + 1, 1), (3 * bytepairs.WINDOW, 2)):
        asked.clear()
        text = ("abzeq" * n)[:n]
        ids = [k for part in coder.encode(text) for k in memoryview(part).cast("i")]
        assert ids == library.encode_ordinary(text)
        assert len(asked) == windows
