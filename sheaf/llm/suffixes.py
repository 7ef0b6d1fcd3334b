"""Suffix-array dedup of repeated byte strings.

Any two equal strings of ``LENGTH`` bytes hold the same anchor: the leftmost of the smallest hashes
of their ``GRAM``-byte grams. So the starts of strings are dealt by anchor, those whose anchor is
unique are done, and equal strings meet in one task, where the suffixes of what is dealt there are
sorted by the difference-cover algorithm and neighbours in that order are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import bytes_of, id_back, maybe_in, mixed, read, release, slices, texts_with_keys
from sheaf.session import written

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_POSITION = np.uint64((1 << 22) - 1)
BLOCK = 1 << 20


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def anchors(data: np.ndarray, bounds: np.ndarray):
    """(anchor, context, value, first, last): for each stretch of starts with one anchor its gram's
    hash, the hash of all bytes its strings cover, the value it is in, and the first and last start.

    ``data`` holds the values end to end, ``bounds`` where each begins and the last one ends; starts
    are counted from the value's begin. At most 4 MB at a time.
    """
    n = len(data)
    starts = n - LENGTH + 1
    none = np.zeros(0, np.int64)
    if starts <= 0:
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    with np.errstate(over="ignore"):
        letters = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        sums = np.append(np.uint64(0), np.cumsum(letters[data] * _powers(_BASE, n)))
        back = _powers(_INVERSE, n)
        grams = mixed((sums[GRAM:] - sums[:-GRAM]) * back[: n - GRAM + 1])
        low = grams & ~_POSITION | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while 2 * width <= SPAN:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < SPAN:
            low = np.minimum(low[: -(SPAN - width)], low[SPAN - width :])
        place = (low[:starts] & _POSITION).astype(np.int64)
        value = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:starts]
        inside = np.arange(starts) + LENGTH <= bounds[value + 1]
        new = np.append(True, (place[1:] != place[:-1]) | (value[1:] != value[:-1]))
        first = np.flatnonzero(new)
        # Starts near a value's end reach over it: they end the stretch that begins before them.
        counts = np.add.reduceat(inside.astype(np.int64), first)
        first, counts = first[counts > 0], counts[counts > 0]
        last = first + counts - 1
        context = mixed((sums[last + LENGTH] - sums[first]) * back[first] + (last - first).astype(np.uint64))
    begin = bounds[value[first]]
    return grams[place[first]], context, value[first], first - begin, last - begin


def _packed(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Numbers in the order of the triples (a, b, c), equal where these are."""
    bits = [int(x.max(initial=0)).bit_length() for x in (a, b, c)]
    if sum(bits) < 64:
        return a << bits[1] + bits[2] | b << bits[2] | c
    return _named(a << bits[1] | b)[1] << bits[2] | c


def _order(x: np.ndarray) -> np.ndarray:
    """The places of numbers from 0 in their order, equal ones as they stand."""
    bits = len(x).bit_length()
    if int(x.max(initial=0)).bit_length() + bits < 64:  # sorting numbers is much faster than sorting places
        return np.sort(x << bits | np.arange(len(x))) & ((1 << bits) - 1)
    return np.argsort(x, kind="stable")


def _named(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each different number first stands, in their order, and each number's rank among them."""
    order = _order(x)
    inorder = x[order]
    new = np.append(True, inorder[1:] != inorder[:-1])[: len(x)]
    rank = np.empty(len(x), np.int64)
    rank[order] = np.cumsum(new) - 1
    return order[new], rank


def _triples(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of triples: two sorts of short numbers where one would be of long ones."""
    bits = [int(x.max(initial=0)).bit_length() for x in (a, b, c)]
    if sum(bits) + len(a).bit_length() < 64:
        return _named(_packed(a, b, c))
    return _named(_named(a << bits[1] | b)[1] << bits[2] | c)


def ranks(s: np.ndarray, depth: int) -> np.ndarray:
    """The rank of every suffix of ``s`` (numbers from 1) by at least its first ``depth`` numbers.

    The difference-cover algorithm: suffixes at positions 1 and 2 (mod 3) are ranked by sorting
    their triples and ranking the string of the triples' names, those at 0 (mod 3) by their first
    number and the sampled suffix behind it, and then both orders are merged. Suffixes that agree
    that far may share a rank; the order is that of the numbers.
    """
    n = -(-(len(s) + 3) // 3) * 3
    s = np.append(s, np.zeros(n + 3 - len(s), np.int64))
    if depth <= 3:
        return _triples(s[:n], s[1 : n + 1], s[2 : n + 2])[1] + 1
    first, second = np.arange(1, n, 3), np.arange(2, n, 3)
    sampled = np.concatenate([first, second])
    names, name = _triples(s[sampled], s[sampled + 1], s[sampled + 2])
    name = name + 1
    if len(names) < len(name):
        name = ranks(name, -(-depth // 3))[: len(name)]
    rank = np.zeros(n + 3, np.int64)
    rank[sampled] = name
    # Every sampled rank once, and every different suffix at 0 (mod 3) once, both in order.
    at, to = _named(name)
    q = sampled[at]
    zero = np.arange(0, n, 3)
    one = s[:n] << int(rank.max()).bit_length() | rank[1 : n + 1]  # compares with a sampled suffix one further on
    at, to_zero = _named(one[zero])
    a = zero[at]
    two = _packed(s[:n], s[1 : n + 1], rank[2 : n + 2])  # with one two further on
    by_one = q % 3 == 1
    # Both kinds are in order each for itself, so the smaller ones are counted apart.
    low = np.searchsorted(one[q[by_one]], one[a]) + np.searchsorted(two[q[~by_one]], two[a])
    near = np.minimum(low, len(q) - 1)
    same = (low < len(q)) & np.where(by_one[near], one[q[near]] == one[a], two[q[near]] == two[a])
    between = low[~same]
    merged = np.arange(len(q)) + np.searchsorted(between, np.arange(len(q)), "right")
    merged_zero = merged[near]
    merged_zero[~same] = between + np.arange(len(between))
    out = np.zeros(n, np.int64)
    out[sampled] = merged[to] + 1
    out[zero] = merged_zero[to_zero] + 1
    return out


def _runs(key: np.ndarray, start: np.ndarray) -> pa.Table:
    """(key, first, last) of stretches of consecutive starts."""
    order = np.lexsort((start, key))
    key, start = key[order], start[order]
    new = np.append(True, (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1)) if len(key) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(key))[: len(first)] - 1
    return pa.table({"key": key[first], "first": start[first], "last": start[last]})


def repeats(table):
    """(key, first, last): the starts among these stretches whose string also starts earlier."""
    data, bounds = bytes_of(table.column("piece").combine_chunks())
    lengths = np.diff(bounds)
    doc, key, begin = (table.column(c).to_numpy() for c in ("doc", "key", "first"))
    # A zero stands after each piece; strings lie inside of pieces.
    text = np.zeros(len(data) + len(lengths), np.int64)
    text[np.arange(len(data)) + np.repeat(np.arange(len(lengths)), lengths)] = data.astype(np.int64) + 1
    rank = ranks(text, LENGTH)
    counts = lengths - LENGTH + 1
    piece = np.repeat(np.arange(len(counts)), counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    spot = bounds[piece] + piece + offset
    order = _order(rank[spot])
    spot, piece, offset = spot[order], piece[order], offset[order]
    apart = np.append(True, rank[spot[1:]] != rank[spot[:-1]]) if len(spot) else np.zeros(0, bool)
    # Neighbours of different rank may still agree in the first LENGTH bytes.
    view = np.lib.stride_tricks.sliding_window_view(text.astype(np.int16), LENGTH)
    check = np.flatnonzero(apart)[1:]
    for k in range(0, len(check), 20_000):
        at = check[k : k + 20_000]
        apart[at] = (view[spot[at]] != view[spot[at - 1]]).any(axis=1)
    group = np.cumsum(apart)
    start = begin[piece] + offset
    order = np.lexsort((start, key[piece], doc[piece], group))
    group, key, start = group[order], key[piece][order], start[order]
    lead = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(order) else np.zeros(0, np.int64)
    lead = np.repeat(lead, np.diff(np.append(lead, len(order))))
    # Rows alike in id and text are one document: its strings are there as often.
    later = (key != key[lead]) | (start != start[lead])
    return _runs(key[later], start[later])


def _find_anchors(batches):
    for batch in slices(batches, "text", BLOCK):
        keys, docs = (batch.column(c).to_numpy() for c in ("key", "doc"))
        whole, bounds = bytes_of(batch.column("text").cast(pa.binary()))
        if len(whole) <= 2 * BLOCK:
            parts = [(whole, bounds, 0)]
        else:  # one long text, block by block of starts
            parts = [(whole[s : s + BLOCK + LENGTH - 1], None, s) for s in range(0, len(whole) - LENGTH + 1, BLOCK)]
        for data, cut, shift in parts:
            anchor, context, value, first, last = anchors(data, np.array([0, len(data)]) if cut is None else cut)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor.view(np.int64), context.view(np.int64), docs[value], keys[value], first + shift, last + shift)], ["anchor", "context", "doc", "key", "first", "last"])


_PLACE = "doc long, key long, first long, last long"
#: Stretches of a task's bucket; anchors with more different contexts go another way, and their list
#: is broadcast: at most MOST_HOT of them.
BUCKET, MOST_HOT = 5000, 100_000


def _cut_pieces(batches):
    """The bytes that a text's stretches cover."""
    for batch in slices(batches, "text"):
        rows = [[], [], [], [], []]
        for doc, key, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc", "key", "text", "wanted"))):
            data = text.encode()
            for w in wanted:
                for to, value in zip(rows, (w["anchor"], doc, key, w["first"], data[w["first"] : w["last"] + LENGTH])):
                    to.append(value)
        kinds = [pa.int64()] * 4 + [pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], ["anchor", "doc", "key", "first", "piece"])


def _hashed_strings(batches):
    """Every string of the pieces by its 128-bit hash, for anchors with very many contexts."""
    import xxhash

    for batch in slices(batches, "piece", BLOCK >> 3):
        pieces = batch.column("piece").to_pylist()
        n = [len(p) - LENGTH + 1 for p in pieces]
        row = np.repeat(np.arange(len(n)), n)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        digests = b"".join(xxhash.xxh3_128_digest(p[k : k + LENGTH]) for p, m in zip(pieces, n) for k in range(m))
        pairs = np.frombuffer(digests, "<i8").reshape(-1, 2)
        doc, key, first = (batch.column(c).to_numpy()[row] for c in ("doc", "key", "first"))
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (pairs[:, 0], pairs[:, 1], doc, key, first + offset)], ["h1", "h2", "doc", "key", "start"])


def repeated_stretches(texts: DataFrame) -> DataFrame:
    """(key, first, last): all stretches of starts whose string also starts earlier."""
    spark = texts.sparkSession
    # Found twice rather than written: there are very many, and most are in one place only.
    found = texts.mapInArrow(_find_anchors, "anchor long, context long, " + _PLACE)
    often = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    # Written first, so that both sides of the join are shuffles that can be split by skew.
    found = written(found.join(written(often, "often"), "anchor"), "recurring-anchors")
    release(spark)
    # Stretches with one context hold the same strings: the first of them stands for all.
    place = F.struct("doc", "key", "first", "last")
    contexts = found.groupBy("anchor", "context").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("n"))
    contexts = written(contexts, "contexts")
    release(spark)
    copied = found.join(contexts.where("n > 1").select("anchor", "context", "place"), ["anchor", "context"])
    copied = copied.where(place != F.col("place")).select("key", "first", "last")
    per_anchor = written(contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("contexts")).where("contexts > 1"), "mixed-anchors")
    total = per_anchor.agg(F.coalesce(F.sum("contexts"), F.lit(0))).first()[0]
    hot = per_anchor.where(F.col("contexts") > max(BUCKET, total // MOST_HOT)).select("anchor", F.lit(True).alias("hot"))
    wanted = contexts.join(per_anchor.select("anchor"), "anchor", "left_semi").select("anchor", "place.*")
    wanted = wanted.groupBy("key").agg(F.collect_list(F.struct("anchor", "first", "last")).alias("wanted"))
    wanted = written(wanted, "wanted")
    copied = written(copied, "copied-stretches")
    release(spark)
    cut = maybe_in(texts, wanted.select("key")).join(wanted, "key")
    pieces = cut.select("doc", "key", "text", "wanted").mapInArrow(_cut_pieces, "anchor long, doc long, key long, first long, piece binary")
    pieces = written(pieces.join(F.broadcast(written(hot, "hot-anchors")), "anchor", "left"), "pieces-of-texts")
    release(spark)
    bucket = F.pmod(F.xxhash64("anchor"), F.lit(max(1, int(total // BUCKET)))).alias("bucket")
    sorted_ = pieces.where("hot is null").groupBy(bucket).applyInArrow(repeats, "key long, first long, last long")
    strings = pieces.where("hot").select("doc", "key", "first", "piece").mapInArrow(_hashed_strings, "h1 long, h2 long, doc long, key long, start long")
    strings = written(strings, "hot-strings")
    earliest = strings.groupBy("h1", "h2").agg(F.min(F.struct("doc", "key", "start")).alias("place"), F.count(F.lit(1)).alias("n"))
    later = strings.join(earliest.where("n > 1").drop("n"), ["h1", "h2"]).where(F.struct("doc", "key", "start") != F.col("place"))
    later = later.select("key", F.col("start").alias("first"), F.col("start").alias("last"))
    out = written(copied.unionByName(sorted_).unionByName(later), "repeated-stretches")
    release(spark)
    return out


def _remove(batches):
    names = ["key", "n_removed", "n_spans", "kept"]
    for batch in slices(batches, "text"):
        rows = [[], [], [], []]
        for key, text, gone in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "gone"))):
            data = np.frombuffer(text.encode(), np.uint8)
            first = np.array([g["first"] for g in gone], np.int64)
            end = np.array([g["last"] for g in gone], np.int64) + LENGTH
            depth = np.bincount(first, minlength=len(data) + 1) - np.bincount(end, minlength=len(data) + 1)
            removed = np.cumsum(depth)[:-1] > 0
            spans = int(removed[:1].sum()) + int((removed[1:] & ~removed[:-1]).sum())
            for to, value in zip(rows, (key, int(removed.sum()), spans, data[~removed].tobytes())):
                to.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names)


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """Remove every byte covered by a string of ``LENGTH`` bytes that also starts earlier.

    Returns (key, doc, n_bytes, n_removed, n_spans, kept, sha256), one row per row of ``docs``;
    ``kept`` are the remaining bytes of documents that lose some, null for the others. Earlier means
    in a document with a smaller doc_id, or in the same one at an earlier byte; strings are judged
    on the input. Matches never cross documents.

    A null text is empty. Rows alike in id and text are one document; rows with one id and different
    texts are ordered by a hash. A null id is smaller than all others. An empty table gives an
    empty result. Other columns are not looked at. Texts are treated whole, in blocks where long.
    """
    texts = texts_with_keys(docs)
    gone = repeated_stretches(texts).distinct().groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("gone"))
    gone = written(gone, "gone")
    every = texts.select("key", "doc", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole"))
    every = written(every, "whole-texts")
    some = maybe_in(texts.select("key", "text"), gone.select("key")).join(gone, "key")
    some = some.select("key", "text", "gone").mapInArrow(_remove, "key long, n_removed long, n_spans long, kept binary")
    if every.groupBy("key").count().where("count > 1").take(1):  # rows alike in id and text
        some = some.dropDuplicates(["key"])
    # The digest is taken before the join, so that texts nobody asks for do not take part in it.
    every = every.join(some.withColumn("cut", F.sha2("kept", 256)), "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.select("key", "doc", "n_bytes", zero("n_removed"), zero("n_spans"), "kept", F.coalesce("cut", "whole").alias("sha256"))


def query(spark, sf_dir):
    out = dedup_substrings(read(spark, sf_dir, "documents"))
    return out.select(id_back("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.col("sha256").alias("kept_sha256"))
