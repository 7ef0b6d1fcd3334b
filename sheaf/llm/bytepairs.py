"""Byte-level BPE: encoding by a lazily determinised transducer, decoding by a UTF-8 state machine.

A sequence of tokens is the encoding of its bytes if every two neighbours are (Berglund and others,
"Constructing a BPE tokenization DFA"). So the encoding of a prefix is that of a shorter one and one
more token, and only the prefixes that a token may still begin behind have to be kept. They are a
state of the transducer: for each its last token and what follows it. Moves are worked out when a
text first takes them; each gives the last token of the bytes so far. What those tokens hang
together to is certain up to where all prefixes kept agree.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import read, slices, store_of_worker, text_column

#: What a worker keeps of states and of short pieces of text before it starts anew.
MOST_STATES, MOST_PAIRS, MOST_PIECES, SHORT_PIECE = 400_000, 500_000, 800_000, 64
#: Characters that a task splits at a time, and bytes of text it takes at a time.
CHUNK, SLICE = 1 << 18, 1 << 20
#: Bytes of one piece after which its certain tokens are given out (far more than the longest token has).
WINDOW = 1 << 12
#: Up to here, and without reservations, both regular expression libraries sort characters alike.
_ALIKE = regex.compile("[^\u0000-՗ -₎₠-⿿　-鿿]")
#: The trie's root, bits of a token's number, and the number that stands for no token.
_ROOT, _TOKEN_BITS = 0, 24
_NONE = (1 << _TOKEN_BITS) - 1


class Transducer:
    """Tokens of byte strings by the merges of ``ranks`` (token bytes to rank)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.lengths = {rank: len(token) for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        child: dict[int, int] = {}
        token_at, inner = [-1], [False]
        for token, rank in ranks.items():
            node = _ROOT
            for byte in token:
                step = node << 8 | byte
                inner[node] = True
                if step not in child:
                    child[step] = len(inner)
                    token_at.append(-1)
                    inner.append(False)
                node = child[step]
            token_at[node] = rank
        # Of node << 8 | byte: the next node's token (-1: none), the node, whether more may follow.
        self.child = {step: token_at[node] << _TOKEN_BITS + 1 | node << 1 | inner[node] for step, node in child.items()}
        self.pairs: dict[int, bool] = {}
        self.edges: tuple[dict[int, list[tuple[int, int, bytes]] | None], ...] = {}, {}
        self._forget()

    def _forget(self) -> None:
        self.states: list[tuple[int, ...]] = []
        self.moves: dict[int, int] = {}
        self.number: dict[tuple[int, ...], int] = {}
        # Before the first byte there is one prefix, the empty one, without a last token.
        self._state((_ROOT << _TOKEN_BITS | _NONE,))

    def _state(self, key: tuple[int, ...]) -> int:
        """The number of a state: for each prefix kept the trie node of what follows it and its last token."""
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        return self.number[key]

    def merged(self, data: bytes, but: bytes | None = None) -> list[bytes]:
        """The definition: the pair of lowest rank is merged, the leftmost first, while there is one (``but`` is none)."""
        parts = [bytes([b]) for b in data]
        while len(parts) > 1:
            pairs = enumerate(zip(parts, parts[1:]))
            rank, k = min((sys.maxsize if a + b == but else self.ranks.get(a + b, sys.maxsize), k) for k, (a, b) in pairs)
            if rank == sys.maxsize:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _edge(self, token: int, right: bool) -> list[tuple[int, int, bytes]] | None:
        """The parts that stand at an edge of ``token`` while it is merged: (made by, taken up by, bytes).

        Times are ranks. None if a part is made later than what it becomes part of, which merges
        learned from a text never do, or if the merges do not give the token at all.
        """
        edges = self.edges[right]
        if token not in edges:
            out, until = [], sys.maxsize
            part: bytes | None = self.tokens[token]
            while part is not None:
                single = len(part) == 1
                made = -1 if single else self.ranks[part]
                halves = [] if single else self.merged(part, but=part)
                if made >= until or not single and len(halves) != 2:
                    out = None
                    break
                out.append((made, until, part))
                until, part = made, None if single else halves[-1 if right else 0]
            edges[token] = out
        return edges[token]

    def alone(self, token: int) -> bool:
        """Whether merging the bytes of ``token`` gives it."""
        return self._edge(token, True) is not None or self.merged(self.tokens[token]) == [self.tokens[token]]

    def _meet(self, last: int, token: int) -> bool:
        """Whether merging the bytes of both leaves them as they are.

        It does unless a part at the end of the one and a part at the begin of the other, there at
        one time, are merged before either is taken up by its own neighbour (of equal merges the
        left one comes first).
        """
        left, right = self._edge(last, True), self._edge(token, False)
        if left is None or right is None:
            return self.merged(self.tokens[last] + self.tokens[token]) == [self.tokens[last], self.tokens[token]]
        rank_of = self.ranks.get
        at = at_right = 0
        while True:  # parts that are there at one time, from the last time back: what was made later is undone first
            made, until, part = left[at]
            made_right, until_right, part_right = right[at_right]
            rank = rank_of(part + part_right)
            if rank is not None and rank < until and rank <= until_right:
                return False
            if made == made_right == -1:
                return True
            at += made >= made_right
            at_right += made_right >= made

    def follows(self, last: int, token: int) -> bool:
        """Whether ``token`` may stand behind ``last``, or at the beginning."""
        key = last << _TOKEN_BITS | token
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > MOST_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.alone(token) and (last == _NONE or self._meet(last, token))
        return known

    def _move(self, state: int, byte: int) -> int:
        """Where a byte leads (ready for the next byte), and the last token of all bytes up to it."""
        child, known = self.child.get, self.pairs.get
        ends, kept = -1, []
        for prefix in self.states[state]:
            found = child(prefix >> _TOKEN_BITS << 8 | byte)
            if found is None:
                continue
            if ends < 0 <= found:
                last, token = prefix & _NONE, found >> _TOKEN_BITS + 1
                fits = known(last << _TOKEN_BITS | token)
                if fits or fits is None and self.follows(last, token):
                    ends = token
            if found & 1:
                kept.append((found >> 1 & _NONE) << _TOKEN_BITS | prefix & _NONE)
        kept.append(_ROOT << _TOKEN_BITS | ends)
        return self._state(tuple(kept)) << _TOKEN_BITS + 8 | ends

    def _chain(self, ends: list[int], at: int, until: int = 0) -> list[int]:
        """The tokens from ``until`` up to ``at``, by the moves, which end with the last tokens of the prefixes."""
        out, lengths = [], self.lengths
        while at > until:
            token = ends[at - 1] & _NONE
            out.append(token)
            at -= lengths[token]
        out.reverse()
        return out

    def _certain(self, ends: list[int]) -> int:
        """The last place that all prefixes agree on whose last token may still grow."""
        at = set(range(max(0, len(ends) - self.longest + 1), len(ends) + 1))
        while len(at) > 1:
            last = max(at)
            at.remove(last)
            at.add(last - self.lengths[ends[last - 1] & _NONE] if last else 0)
        return at.pop()

    def __call__(self, data: bytes) -> list[int]:
        """The tokens of one piece of text, as the merges give them; a piece that is a token is that one.

        Of a long piece tokens are given out after each ``WINDOW`` bytes, all but the last ones.
        """
        if data in self.ranks:
            return [self.ranks[data]]
        out: list[int] = []
        ends: list[int] = []
        state, move, add = 0, self.moves.get, ends.append
        for begin in range(0, len(data), WINDOW):
            for byte in data[begin : begin + WINDOW]:
                step = move(state | byte)
                if step is None:
                    if len(self.states) > MOST_STATES:
                        key = self.states[state >> 8]
                        self._forget()
                        move, state = self.moves.get, self._state(key) << 8
                    step = self.moves[state | byte] = self._move(state >> 8, byte)
                state = step >> _TOKEN_BITS
                add(step)
            if begin + WINDOW < len(data):
                certain = self._certain(ends)
                out += self._chain(ends, certain)
                del ends[:certain]
        return out + self._chain(ends, len(ends)) if out else self._chain(ends, len(ends))


#: UTF-8: how the first byte of a character limits the second one where it does. Fixed values.
_SECOND = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}
_REPLACEMENT = "�".encode()


def _bytes_from(lead: int) -> int:
    """How many bytes a character has that begins so; 0: none does."""
    if lead < 0x80:
        return 1
    if 0xC2 <= lead < 0xF5:
        return 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
    return 0


def utf8_step(pending: bytes, byte: int) -> tuple[bytes, bytes]:
    """The begun character after one more byte, and the bytes of characters that are whole with it.

    Bytes that no character can hold give the replacement character, one for each longest begin.
    """
    if not pending:
        size = _bytes_from(byte)
        one = bytes([byte])
        return (b"", one) if size == 1 else (one, b"") if size else (b"", _REPLACEMENT)
    low, high = _SECOND.get(pending[0], (0x80, 0xBF)) if len(pending) == 1 else (0x80, 0xBF)
    if not low <= byte <= high:
        after, whole = utf8_step(b"", byte)
        return after, _REPLACEMENT + whole
    pending += bytes([byte])
    return (b"", pending) if len(pending) == _bytes_from(pending[0]) else (pending, b"")


class _Moves(dict):
    """From one state: token to (moves of the next state, whole characters), worked out when asked for."""

    def __init__(self, states: dict[bytes, _Moves], tokens: dict[int, bytes], pending: bytes = b""):
        super().__init__()
        self.states, self.tokens, self.pending = states, tokens, pending
        self.whole = _Whole(self)
        states[pending] = self

    def __missing__(self, token: int):
        pending, out = self.pending, b""
        for byte in self.tokens[token]:
            pending, whole = utf8_step(pending, byte)
            out += whole
        following = self.states[pending] if pending in self.states else _Moves(self.states, self.tokens, pending)
        self[token] = following, out
        return self[token]


class _Whole(dict):
    """Token to characters, of the tokens that lead from a state back to it; a KeyError for all others."""

    def __init__(self, state: _Moves):
        super().__init__()
        self.state = state

    def __missing__(self, token: int) -> bytes:
        following, out = self.state[token]
        if following is not self.state:
            raise KeyError(token)
        self[token] = out
        return out


class Decoder:
    """Text of tokens that come a few at a time; a character is given out when its last byte is there."""

    def __init__(self, start: _Moves):
        self.now = start

    def __call__(self, ids, last: bool = False) -> bytes:
        out, now = [], self.now
        try:  # mostly every token ends with a character
            out.append(b"".join(map(now.whole.__getitem__, ids)))
        except KeyError:
            for token in ids:
                now, whole = now[token]
                out.append(whole)
        self.now = now
        if last and now.pending:
            out.append(_REPLACEMENT)
            self.now = now.states[b""]
        return b"".join(out)


class Coder:
    """What a worker needs: the pattern, the transducer, the moves of decoding, pieces met before."""

    def __init__(self, path: str | None = None, pattern: str | None = None):
        import public_tokenizers

        with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern or public_tokenizers.PATTERN)
        self.transducer = Transducer(ranks)
        self.start = _Moves({}, self.transducer.tokens)
        self.known: dict[str, bytes] = {}
        # By the word with a space before it; only of the pattern that is known not to cross a space behind a word.
        self.words: dict[str, bytes] | None = {} if pattern in (None, public_tokenizers.PATTERN) else None
        self.decimals = {rank: str(rank) for rank in ranks.values()}
        self.stand_ins: dict[int, str] | None = None

    def _stand_ins(self) -> dict[int, str]:
        """For each character that the tokenizer's library takes for another kind than ours does, one of that kind."""
        if self.stand_ins is None:
            single = {bytes([b]): b for b in range(256)}
            every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
            self.stand_ins, letters = {}, {}
            for kind, other in ((r"\p{L}", "a"), (r"\p{N}", "1")):
                theirs = tiktoken.Encoding("kind", pat_str=kind, mergeable_ranks=single, special_tokens={})
                letters[other] = set(theirs.decode(theirs.encode_ordinary(every)))
                for c in set(regex.findall(kind, every)) - letters[other]:
                    self.stand_ins[ord(c)] = "."
            for kind, other in ((r"\p{L}", "a"), (r"\p{N}", "1")):
                for c in letters[other] - set(regex.findall(kind, every)):
                    self.stand_ins[ord(c)] = other
        return self.stand_ins

    @staticmethod
    def _alike(part: str) -> bool:
        return part.isascii() or not _ALIKE.search(part)

    def chunks(self, text: str) -> Iterator[str]:
        """Parts of a text; they end where white space begins, as no match of the pattern crosses that."""
        start = 0
        while start < len(text):
            end = len(text)
            if start + CHUNK < end:
                near = regex.compile(r"(?<=\S)\s").search(text, start + CHUNK)
                end = near.start() if near else end
            yield text[start:end]
            start = end

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The matches of the pattern, chunk by chunk."""
        return map(self._matches, self.chunks(text))

    def _matches(self, part: str) -> list[str]:
        if self._alike(part):
            return self.pattern.findall(part)
        return [part[m.start() : m.end()] for m in self.pattern.finditer(part.translate(self._stand_ins()))]

    def encode(self, text: str) -> Iterator[bytes]:
        """The tokens as little-endian 32-bit numbers, chunk by chunk."""
        for part in self.chunks(text):
            found = self._by_word(part) if self.words is not None and self._alike(part) else None
            yield b"".join(self._by_piece(self._matches(part)) if found is None else found)

    def _by_piece(self, pieces: list[str]) -> list[bytes]:
        if len(self.known) > MOST_PIECES:
            self.known = {}
        known, encoded = self.known, self.transducer
        out = list(map(known.get, pieces))
        for k in [k for k, ids in enumerate(out) if ids is None]:
            piece = pieces[k]
            ids = known.get(piece)
            if ids is None:
                ids = struct.pack(f"<{len(tokens := encoded(piece.encode()))}i", *tokens)
                if len(piece) <= SHORT_PIECE:
                    known[piece] = ids
            out[k] = ids
        return out

    def _by_word(self, part: str) -> list[bytes] | None:
        """The tokens of each word with the space before it; None where white space meets a space.

        No match crosses a space that stands behind a word, so what matches from there on depends
        on the word alone. Words met before are remembered.
        """
        first, *words = part.split(" ")
        if first and first[-1].isspace():
            return None
        if len(self.words) > MOST_PIECES:
            self.words = {}
        known = self.words
        found = list(map(known.get, words))
        missing = [k for k, ids in enumerate(found) if ids is None]
        if missing:
            new = list({words[k] for k in missing})
            if any(not word or word[-1].isspace() for word in new):
                return None
            pieces = self.pattern.findall(" " + " ".join(new))
            ids = self._by_piece(pieces)
            begins = [k for k, piece in enumerate(pieces) if piece[0] == " "]
            learned = dict(zip(new, [b"".join(ids[k:end]) for k, end in zip(begins, [*begins[1:], len(ids)])]))
            known.update((word, ids) for word, ids in learned.items() if len(word) <= SHORT_PIECE)
            for k in missing:
                found[k] = learned[words[k]]
        return self._by_piece(self.pattern.findall(first)) + found

    def decoder(self) -> Decoder:
        return Decoder(self.start)


def coder_of_worker(path: str | None = None, pattern: str | None = None) -> Coder:
    """The coder of this worker process, with what its earlier tasks have worked out."""
    store = store_of_worker("bytepairs")
    if (path, pattern) not in store:
        store[path, pattern] = Coder(path, pattern)
    return store[path, pattern]


def _kind_of(docs: DataFrame, name: str) -> str:
    return docs.schema[name].dataType.simpleString()


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids): the tokens of each whole text, one row per row of ``docs``.

    ``path`` names a file of ranks, ``pattern`` what splits a text before the merges. A null or
    empty text has no tokens. Rows stand for themselves, so repeated rows and null ids come back as
    often as they are there. An empty table gives an empty result; other columns are not looked at.
    """

    def run(batches):
        for batch in slices(batches, "text", SLICE, keep="bytepairs"):
            coder = coder_of_worker(path, pattern)
            ids = [np.frombuffer(b"".join(coder.encode(t)), "<i4") for t in batch.column("text").to_pylist()]
            ends = np.append(0, np.cumsum([len(i) for i in ids])).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])

    return docs.select("doc_id", text_column().alias("text")).mapInArrow(run, f"doc_id {_kind_of(docs, 'doc_id')}, ids array<int>")


def decode(rows: DataFrame, path: str | None = None, most: int = 1 << 16) -> DataFrame:
    """(doc_id, text) of (doc_id, ids), ``most`` tokens at a time; null ids give an empty text.

    Bytes that are no UTF-8 give replacement characters. A number that is no token is an error.
    """

    def run(batches):
        coder = coder_of_worker(path)
        for batch in batches:
            texts = []
            for ids in batch.column("ids").to_pylist():
                decoder, ids = coder.decoder(), ids or []
                parts = [decoder(ids[k : k + most]) for k in range(0, len(ids), most)]
                texts.append(b"".join([*parts, decoder([], last=True)]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {_kind_of(rows, 'doc_id')}, text string")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): texts encoded and decoded again, chunk by chunk.

    ``ids_sha256`` is of the decimal tokens joined by commas, ``decoded_sha256`` of the bytes that
    decoding gives. Neither the tokens nor the decoded bytes of a long text are ever held whole.
    Nulls, repeated rows and empty tables as in ``encode``.
    """

    def run(batches):
        for batch in slices(batches, "text", SLICE, keep="bytepairs"):
            coder = coder_of_worker(path, pattern)
            rows = [[], [], []]
            for text in batch.column("text").to_pylist():
                n, listed, plain, decoder = 0, hashlib.sha256(), hashlib.sha256(), coder.decoder()
                for part in coder.encode(text):
                    ids = np.frombuffer(part, "<i4").tolist()
                    listed.update((("," if n else "") + ",".join(map(coder.decimals.__getitem__, ids))).encode() if ids else b"")
                    plain.update(decoder(ids))
                    n += len(ids)
                plain.update(decoder([], last=True))
                for to, value in zip(rows, (n, listed.hexdigest(), plain.hexdigest())):
                    to.append(value)
            kinds = (pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, rows, kinds)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = f"doc_id {_kind_of(docs, 'doc_id')}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", text_column().alias("text")).mapInArrow(run, out)


def query(spark, sf_dir):
    return round_trip(read(spark, sf_dir, "documents"))
