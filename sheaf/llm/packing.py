"""Packing documents into token sequences: shortest pack first over the histogram of lengths."""

from __future__ import annotations

import os
import struct
import zlib
from bisect import insort
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.common import read, slices, store_of_worker, text_column, tidy
from sheaf.session import small_batches, written

SIZE, END = 2048, 1
#: Pieces of one length are ranked in groups of about this many, and in at most so many groups.
RANK_ROWS, MOST_GROUPS = 512, 100_000
#: Words a worker remembers the ids of (some 60 MB, until it does other work): beyond that it drops the half it met
#: longest ago.
REMEMBERED = 300_000
#: Bytes of text whose words are looked up, and new ones encoded, together.
SLICE = 1 << 18
#: ASCII marks that stand together in one stretch, whatever their number (an apostrophe may begin another one).
MARKS = b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'


class _Spelled(dict):
    """Character to how byte-level models spell its UTF-8 bytes, worked out when asked for; a space stays."""

    def __init__(self):
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.bytes = {**{b: chr(b) for b in shown}, **{b: chr(256 + k) for k, b in enumerate(hidden)}}
        super().__init__({" ": " "})

    def __missing__(self, c: str) -> str:
        self[c] = "".join(map(self.bytes.__getitem__, c.encode()))
        return self[c]


class Tokens:
    """Ids of whole texts. No token spans white space, so the ids of a text are those of its words.

    Words are remembered, the ones met last. New ones of letters only are encoded many in one string: each is one
    stretch for the merges, which ends with an end-of-word id. Marks at the end are a stretch of
    their own, unless normalization ends the letters in a combining mark; words with a letter that
    the tokenizer does not keep in a stretch with others are encoded whole. Where a stretch is known to be one,
    the tokenizer's model gets it without being asked to look for stretches again, normalized before.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.letters: dict[str, bool] = {}
        self.kept: set[str] = set()
        self.spelled = _Spelled()
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        # Another file may normalize, split or spell otherwise; then it gets stretches like whole texts.
        probes = "abcdefghijklm nopqrstuvwxyz", "éèçß ñüÀÖ łøжש"
        spelled = [(probe, self._stretches(probe.encode())) for probe in probes]
        if any(self._ids(self.tokenizer, a) != self._ids(self.model, b) for a, b in spelled):
            self.model = None
        self._each([b".", b","])
        self.marks = dict(self.known)

    @staticmethod
    def _ids(tokenizer, text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    def _each(self, words: list[bytes]) -> None:
        for word, got in zip(words, self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)):
            self.known[word] = np.array(got.ids, "<u4").tobytes()

    def _stretches(self, text: bytes) -> str:
        """Words of letters as the model gets them: normalized and spelled by byte."""
        if text.isascii():
            return text.lower().decode()
        normalizer = self.tokenizer.normalizer
        return "".join(map(self.spelled.__getitem__, normalizer.normalize_str(text.decode()) if normalizer else text.decode()))

    def _together(self, words: list[bytes], step: int = 1000) -> None:
        parts = [words[k : k + step] for k in range(0, len(words), step)]
        texts = map(b" ".join, parts)
        if self.model is not None:
            found = self.model.encode_batch_fast([*map(self._stretches, texts)], add_special_tokens=False)
        else:
            found = self.tokenizer.encode_batch_fast([*map(bytes.decode, texts)], add_special_tokens=False)
        for part, got in zip(parts, found):
            data = struct.pack(f"<{len(ids := got.ids)}I", *ids)
            ends = (4 * np.flatnonzero(self.last[np.frombuffer(data, "<u4")]) + 4).tolist()
            if len(ends) != len(part):
                self._each(part)
                continue
            self.known.update(zip(part, map(data.__getitem__, map(slice, [0, *ends], ends))))

    def _letters(self, core: str) -> bool:
        """Whether all are letters to the tokenizer too, after normalization; known by character."""
        if self.kept.issuperset(core):
            return True
        if not core.isalpha():
            return False
        for c in set(core).difference(self.letters):
            ids = self._ids(self.tokenizer, f"a{c}a")
            self.letters[c] = int(self.last[ids].sum()) == 1
            if self.letters[c]:
                self.kept.add(c)
        return all(map(self.letters.__getitem__, core))

    def _unknown(self, words: set[bytes]) -> set[bytes]:
        """Words that are not remembered; those that only the older half of the memory holds come back from there."""
        words = words.difference(self.known)
        back = {word: self.older[word] for word in words if word in self.older}
        self.known.update(back)
        return words.difference(back)

    def _learn(self, words: set[bytes]) -> None:
        plain, others, single, marked = set(), set(), [], []
        for word in words:
            core = word.rstrip(MARKS)
            if core.isalpha():
                plain.add(core)
            elif not core.isascii() and self._letters(core.decode()):
                others.add(core)
            else:
                single.append(word)
                continue
            if len(core) < len(word):
                marked.append((word, core, word[len(core) :]))
        self._together(list(self._unknown(plain)))
        self._together(list(self._unknown(others)))
        self._each([*single, *self._unknown({marks for _, _, marks in marked})])
        known = self.known
        for word, core, marks in marked:
            known[word] = known[core] + known[marks]

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers; new words of all texts are encoded together."""
        # Letters are lower-cased by the tokenizer, but for what may be its special tokens.
        words = [(text if b"<|" in text else text.lower()).split() for text in texts]
        flat = list(chain.from_iterable(words))
        found = list(map(self.known.get, flat))
        missing = [k for k, ids in enumerate(found) if ids is None]
        if missing:
            new = self._unknown({flat[k] for k in missing})
            if new:
                self._learn(new)
            for k in missing:
                found[k] = self.known[flat[k]]
        ends = [0, *accumulate(map(len, words))]
        out = [b"".join(found[start:end]) for start, end in zip(ends, ends[1:])]
        if 2 * len(self.known) > REMEMBERED:
            self.older, self.known = self.known, dict(self.marks)
        return out


def tokens_of_worker(path: str | None) -> Tokens:
    """The tokenizer of this worker process, with the words that its earlier tasks have met."""
    import public_tokenizers

    path = path or public_tokenizers.path("word_bpe_49k.json")
    store = store_of_worker("packing")
    if path not in store:
        store[path] = Tokens(path)
        tidy()  # reading the file takes more than what is kept of it
    return store[path]


def pieces_of(docs: DataFrame, size: int = SIZE, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens), and ids if asked for: documents cut at each ``size`` tokens."""
    kinds = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())]
    kinds = kinds if with_ids else kinds[:-1]

    def cut(batches):
        tokens, end = None, np.array([END], "<u4").tobytes()
        for batch in slices(batches, "text", SLICE, keep="packing"):
            rows, values = [], []
            tokens = tokens or tokens_of_worker(path)
            for k, ids in enumerate(tokens(batch.column("text").cast(pa.binary()).to_pylist())):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, size):
                    part = ids[4 * start : 4 * (start + size)]
                    rows.append(k)
                    values.append((start, len(part) // 4, zlib.crc32(part), total, part))
            columns = [pa.array(column, kind) for column, (_, kind) in zip(zip(*values), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), *columns], ["doc_id", *(n for n, _ in kinds)])

    kind = dict(docs.dtypes)["doc_id"]
    out = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return docs.select("doc_id", text_column().alias("text")).mapInArrow(cut, out)


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (how often, lengths in it) that hold every piece of the histogram once.

    Lengths are placed longest first, each on the shortest packs there are (those with most room);
    if none has room, on new ones. Packs that are alike are one entry with a count, so the work
    depends on the number of different lengths, not of pieces.
    """
    by_room: dict[int, list[list]] = {}
    rooms: list[int] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        placed: list[tuple[int, int, tuple[int, ...]]] = []
        while left and rooms and rooms[-1] >= length:
            room = rooms[-1]
            entries = by_room[room]
            count, lengths = entries.pop()
            used = min(count, left)
            left -= used
            if used < count:
                entries.append([count - used, lengths])
            if not entries:
                del by_room[room]
                rooms.pop()
            placed.append((room - length, used, (*lengths, length)))
        if left:
            placed.append((size - length, left, (length,)))
        for room, count, lengths in placed:
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append([count, lengths])
    return [(count, lengths) for room in rooms for count, lengths in by_room[room]]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, offset) of each place in each pattern."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            rank = taken.get(length, 0)
            out.append((length, rank, rank + count - 1, sequence, offset))
            taken[length] = rank + count
            offset += length
        sequence += count
    return out


def pack(docs: DataFrame, size: int = SIZE, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most ``size`` tokens.

    Returns (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), and ids (bytes) if
    asked for. A document is its text's ids and END; it is cut at each ``size`` tokens, and the
    pieces are packed by ``shortest_pack_first``. A null or empty text is END alone. Rows stand for
    themselves, so repeated rows and null ids are packed as often as they are there. An empty table
    gives an empty result. Other columns are not looked at. ``path`` names a tokenizer file.

    The driver sees the histogram of lengths (at most ``size`` rows) and the patterns. Pieces meet
    their places by length and rank; ranks are counted in small groups by hash, so that a length
    with very many pieces is spread over tasks.
    """
    spark = docs.sparkSession
    with small_batches(spark):  # whole batches of texts are held twice in the executor and twice in the worker
        pieces = written(pieces_of(docs, size, path, with_ids), "pieces")
    histogram = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    places = slots(shortest_pack_first(histogram, size))
    per_group = max(RANK_ROWS, sum(histogram.values()) // MOST_GROUPS)
    places = spark.createDataFrame(places, "length long, first long, last long, sequence long, offset long")
    counts = pieces.groupBy("length").agg(F.ceil(F.count(F.lit(1)) / per_group).alias("groups"))
    grouped = pieces.join(F.broadcast(counts), "length")  # a row per length
    group = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("groups"))
    grouped = grouped.withColumn("group", group).drop("groups").repartition("length", "group")
    sums = grouped.groupBy("length", "group").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("length", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "group").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = grouped.withColumn("in_group", F.row_number().over(inside) - 1).join(bases, ["length", "group"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("in_group"))
    # Bounded: some places per different length, whatever the number of pieces.
    found = ranked.join(F.broadcast(places), "length").where("rank between first and last")
    columns = [c for c in pieces.columns if c != "ids"]
    return found.select(*columns, (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset", *(["ids"] * with_ids))


def query(spark, sf_dir):
    return pack(read(spark, sf_dir, "documents"))
