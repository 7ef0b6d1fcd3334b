"""Words met before are not split into pieces again; where white space meets a space the pattern decides."""

import random

import pytest
import tiktoken

import public_tokenizers
from sheaf.llm import bytepairs


@pytest.fixture(scope="module")
def coder():
    return bytepairs.Coder()


@pytest.fixture(scope="module")
def library(coder):
    return tiktoken.Encoding("library", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.transducer.ranks, special_tokens={})


def ids_of(coder, text):
    return [k for part in coder.encode(text) for k in memoryview(part).cast("i")]


class Watched:
    def __init__(self, pattern):
        self.pattern, self.asked = pattern, []

    def findall(self, text):
        self.asked.append(text)
        return self.pattern.findall(text)


def test_words_met_before_are_not_split_again(library):
    coder = bytepairs.Coder()
    coder.pattern = watched = Watched(coder.pattern)
    text = "the house, it's été. the house, it's new"
    assert ids_of(coder, text) == library.encode_ordinary(text)
    watched.asked.clear()
    text = "a new house, it's été. the"
    assert ids_of(coder, text) == library.encode_ordinary(text)
    assert watched.asked == ["a"]


def test_white_space_that_meets_a_space(coder, library):
    rng = random.Random(9)
    units = [" ", " ", " ", "\n", "\t", "\r\n", "　", "\x1c", "\x85", "\xa0", " ", "a", "be", "'s", "'", "12", ",", "é", "😀", "字"]
    texts = ["", " ", "  ", "\n", " a", "a ", "a  b", "a\n b", "a \nb", "a \n b", "a\n ", "\n a", "a\n\n b c", "a 's 'll' d", "a\xa0 b"]
    for text in [*texts, *("".join(rng.choices(units, k=rng.randrange(1, 14))) for _ in range(5000))]:
        assert ids_of(coder, text) == library.encode_ordinary(text), repr(text)


def test_another_pattern_decides_alone():
    pattern = r"[a-z]+ [a-z]+|\s+|[^\s]"
    coder = bytepairs.Coder(pattern=pattern)
    library = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=coder.transducer.ranks, special_tokens={})
    for text in ("in the house of the king", "a b c d", "x, y z"):
        assert ids_of(coder, text) == library.encode_ordinary(text)


def test_neighbours_are_those_that_merging_leaves(coder):
    rng, transducer = random.Random(5), coder.transducer
    tokens = [t for t in transducer.tokens if transducer.lengths[t] < 12]
    texts = ("the thering ations inthe onthe erer eéèé aaaaa  ..,," * 3).split(" ")
    near = sorted({t for text in texts for k in range(len(text)) for n in range(1, 6) if (t := transducer.ranks.get(text[k : k + n].encode())) is not None})
    for last, token in [*((a, b) for a in near for b in near), *(rng.choices(tokens, k=2) for _ in range(3000))]:
        if transducer.alone(last) and transducer.alone(token):
            both = [transducer.tokens[last], transducer.tokens[token]]
            assert transducer._meet(last, token) == (transducer.merged(b"".join(both)) == both)


def test_tokens_that_end_inside_of_characters(coder):
    single = {b: coder.transducer.ranks[bytes([b])] for b in range(256)}
    for data in ("é😀a字".encode(), b"\xe9a", b"a\xf0\x9f", b"abc", b"\xc3\xa9\xc3"):
        ids = [single[b] for b in data]
        for cut in range(len(ids) + 1):
            decoder = coder.decoder()
            assert decoder(ids[:cut]) + decoder(ids[cut:]) + decoder([], last=True) == data.decode(errors="replace").encode()
