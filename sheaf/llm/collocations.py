"""Phrase collocations from a weighted de Bruijn graph of words.

Every word occurrence is one edge: the word and the next two in its piece of text lead from the node
of the first two words to that of the last two. Where a piece ends there is no third or second word;
these edges are the corrections for piece ends. So only longest grams are counted, a node's flow (all
edges out of it, ended ones included) is the count of its two words, and the flow of all nodes that
begin with a word is that word's count. Paths of the frequent part of the graph whose inner nodes
have one way in and one way out are compacted: what lies inside of them never stands alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.common import bytes_of, mixed, read, slices, text_column, word_hashes
from sheaf.operators.skew import lookup_join, measure
from sheaf.session import small_batches, written

#: Words that are numbered: those with more than one part in 2 ** SHARE_BITS of all occurrences.
SHARE_BITS, ID_BITS = 20, 21
#: Counters of occurrences by node, and from which share on the nodes of one are dealt by edge.
HOT_BITS, HOT_SHARE = 16, 1024
#: Bytes of text, and words of a long text, that a task works on at a time.
SLICE, WORDS = 4 << 20, 1 << 20
#: Rows that a task gives out at a time.
GIVEN = 1 << 16
#: Candidates that are sorted in one task at a time.
RANKED = 500_000

_SPLIT = np.isin(np.arange(256), list(b".,;:!?\n\x0b\x0c\r"))
_WORD = ~_SPLIT & ~np.isin(np.arange(256), list(b" \t"))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _parts(batch: pa.RecordBatch):
    """(bytes, bounds, lang keys) of a batch's texts; a long text is cut behind ends of pieces."""
    data, bounds = bytes_of(batch.column("text").cast(pa.binary()))
    keys = batch.column("lang_key").to_numpy()
    if len(data) <= 2 * SLICE or batch.num_rows > 1:
        yield data, bounds, keys
        return
    start = 0
    while start < len(data):
        end = min(start + SLICE, len(data))
        while end < len(data) and not _SPLIT[data[end - 1]]:
            near = np.flatnonzero(_SPLIT[data[end : end + SLICE]])
            end = end + int(near[0]) + 1 if len(near) else min(end + SLICE, len(data))
        yield data[start:end], np.array([0, end - start]), keys
        start = end


def _words(data: np.ndarray, bounds: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word a 63-bit code in its language (negative), how many words its piece has from it on, its text."""
    cuts = np.union1d(bounds, np.flatnonzero(_SPLIT[data]))
    hashes, counts = word_hashes(data, cuts, _WORD)
    row = np.searchsorted(bounds, cuts[:-1], "right") - 1
    row = np.repeat(row, counts)
    of_lang = mixed(keys.view(np.uint64))[row]
    codes = mixed(hashes ^ of_lang) | np.uint64(1 << 63)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(hashes))
    return codes.view(np.int64), left, row


def _node_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(first.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second.view(np.uint64))


def _spelled(data: np.ndarray, bounds: np.ndarray, at: np.ndarray) -> pa.Array:
    """The words number ``at`` of these bytes."""
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    inside = np.append(_WORD[data], False)
    before = np.append(False, inside[:-1])
    begin = np.flatnonzero(inside & (~before | cut))
    end = np.flatnonzero(before & (~inside | cut))
    begin, end = begin[at], end[at]
    ends = np.append(0, np.cumsum(end - begin))
    spot = np.arange(ends[-1]) - np.repeat(ends[:-1] - begin, end - begin)
    return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(_LOWER[data[spot]])])


def _given(batch: pa.RecordBatch):
    """All rows of a batch, a few at a time: the executor holds what it is given as a whole."""
    for start in range(0, batch.num_rows, GIVEN):
        yield batch.slice(start, GIVEN)


def _vocabulary(batches):
    """(code, lang, word, n) of the words of each slice; (counter, n) of the nodes in the whole task."""
    counters = np.zeros(1 << HOT_BITS, np.int64)
    names, kinds = ["code", "lang_key", "word", "counter", "n"], [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64()]
    for batch in slices(batches, "text", SLICE):
        for data, bounds, keys in _parts(batch):
            codes, left, row = _words(data, bounds, keys)
            if not len(codes):
                continue
            second = np.append(codes[1:], 0) * (left > 1)
            counters += np.bincount((_node_hash(codes, second) >> np.uint64(64 - HOT_BITS)).astype(np.int64), minlength=1 << HOT_BITS)
            seen, at, n = np.unique(codes, return_index=True, return_counts=True)
            yield from _given(pa.RecordBatch.from_arrays([pa.array(seen), pa.array(keys[row[at]]), _spelled(data, bounds, at), pa.nulls(len(seen), pa.int32()), pa.array(n)], names))
    there = np.flatnonzero(counters)
    yield from _given(pa.RecordBatch.from_arrays([*(pa.nulls(len(there), k) for k in kinds[:3]), pa.array(there.astype(np.int32)), pa.array(counters[there])], names))


_EDGE = "node long, third long, first long, second long, hot boolean, n long"


def _edges(numbered, hot):
    """(node, third, first, second, n): the edges of each slice.

    A numbered word stands for itself, others are codes (negative), 0 is no word. Two numbered words
    are packed into ``node``; otherwise it is a negative hash of both, which ``first`` and ``second`` hold.
    """

    def edges(batches):
        known, counters = numbered.value, hot.value
        for batch in slices(batches, "text", SLICE):
            for data, bounds, keys in _parts(batch):
                codes, left, _ = _words(data, bounds, keys)
                for start in range(0, len(codes), WORDS):
                    yield from _given(_edge_rows(codes[start : start + WORDS + 2], left[start : start + WORDS], known, counters))

    return edges


def _edge_rows(codes: np.ndarray, left: np.ndarray, known: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
    seen, local = np.unique(codes, return_inverse=True)
    local = np.append(local + 1, [0, 0])  # 0: no word
    m = len(left)
    key = local[:m] << 42 | local[1 : m + 1] * (left > 1) << 21 | local[2 : m + 2] * (left > 2)
    key, n = np.unique(key, return_counts=True)
    seen = np.append(0, seen)
    first, second, third = (seen[key >> shift & 0x1FFFFF] for shift in (42, 21, 0))
    nodes = _node_hash(first, second)
    is_hot = np.isin((nodes >> np.uint64(64 - HOT_BITS)).astype(np.int64), hot)
    at = np.searchsorted(known, seen)
    there = (at < len(known)) & (known[np.minimum(at, max(0, len(known) - 1))] == seen) if len(known) else np.zeros(len(seen), bool)
    short = np.where(there, at + 1, seen)
    first, second, third = (short[key >> shift & 0x1FFFFF] for shift in (42, 21, 0))
    packed = (first >= 0) & (second >= 0)
    node = np.where(packed, first << ID_BITS | second, (nodes | np.uint64(1 << 63)).view(np.int64))
    mask = lambda x: pa.array(x, mask=packed)
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(third), mask(first), mask(second), pa.array(is_hot), pa.array(n)], ["node", "third", "first", "second", "hot", "n"])


class Graph:
    """Nodes with their counts and frequent edges, words, and the numbers of occurrences per lang.

    ``nodes``: (first, second, flow, onward [(third, n)]), ``second`` 0 where pieces end with ``first``;
    ``words``: (code, lang, word, n); ``totals``: (lang, n).
    """

    def __init__(self, nodes: DataFrame, words: DataFrame, totals: DataFrame):
        self.nodes, self.words, self.totals = nodes, words, totals


def graph(docs: DataFrame, least: int = 10) -> Graph:
    """The weighted de Bruijn graph of ``docs``; edges of fewer than ``least`` occurrences only count as flow."""
    spark = docs.sparkSession
    lang = F.coalesce(F.col("lang"), F.lit("und"))
    rows = docs.select(text_column().alias("text"), F.xxhash64(lang).alias("lang_key"))
    seen = rows.mapInArrow(_vocabulary, "code long, lang_key long, word string, counter int, n long")
    with small_batches(spark):  # whole batches of texts are held twice in the executor and twice in the worker
        seen = written(seen.groupBy("code", "lang_key", "word", "counter").agg(F.sum("n").alias("n")), "vocabulary")
    total = seen.where("code is not null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # At most 2 ** SHARE_BITS words and HOT_SHARE counters can have such a share: these lists are bounded.
    often = seen.where(F.col("n").cast("decimal(38,0)") * (1 << SHARE_BITS) > total).where("code is not null").select("code")
    numbered = np.sort(often.toArrow().column(0).to_numpy())
    hot = seen.where("code is null").where(F.col("n") * HOT_SHARE > total).select(F.col("counter").cast("long")).toArrow().column(0).to_numpy()
    found = rows.mapInArrow(_edges(spark.sparkContext.broadcast(numbered), spark.sparkContext.broadcast(hot)), _EDGE)
    nodes = _nodes(found.where("not hot").repartition("node"), least)
    if len(hot):  # the edges of one node are spread, and its flows meet pre-aggregated
        nodes = nodes.unionByName(_nodes(found.where("hot"), least))
    with small_batches(spark):
        nodes = written(nodes, "nodes")
    unpacked = lambda packed, other: F.when(F.col("node") >= 0, packed).otherwise(F.col(other)).alias(other)
    nodes = nodes.select(unpacked(F.shiftright("node", ID_BITS), "first"), unpacked(F.col("node").bitwiseAND((1 << ID_BITS) - 1), "second"), "flow", "onward")
    langs = written(docs.select(lang.alias("lang")).distinct().select("lang", F.xxhash64("lang").alias("lang_key")), "langs")
    numbers = spark.createDataFrame(pa.table({"code": numbered, "number": np.arange(1, len(numbered) + 1)}), "code long, number long")
    words = lookup_join(seen.where("code is not null").drop("counter"), langs, "lang_key", spread_by="code", small=measure(langs)[1])
    words = words.join(numbers, "code", "left").select(F.coalesce("number", "code").alias("code"), "lang", "word", "n")
    words = written(words, "words")
    return Graph(nodes, words, written(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals"))


def _nodes(edges: DataFrame, least: int) -> DataFrame:
    merged = edges.groupBy("node", "first", "second", "third").agg(F.sum("n").alias("n"))
    onward = F.collect_list(F.when((F.col("n") >= least) & (F.col("third") != 0), F.struct("third", "n")))
    return merged.groupBy("node", "first", "second").agg(F.sum("n").alias("flow"), onward.alias("onward"))


def compacted(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The unary paths of the frequent graph: its edges with path and place, and its nodes, inner ones marked.

    ``nodes`` as in Graph, of ``least`` occurrences or more. Returns (id, first, second, third, n,
    flow_from, flow_to, path, to_end): the edges of a path share ``path`` and its weight ``n``, and
    ``to_end`` edges follow; and (first, second, flow, longer, inner): ``longer`` is the heaviest edge
    at the node. A node is inside of a path if all its occurrences come from one edge and go on by one.
    The ends of paths are found by doubling, in log2(longest path) rounds of one join each.
    """
    edges = nodes.select("first", "second", F.col("flow").alias("flow_from"), F.explode("onward").alias("edge"))
    edges = edges.select("first", "second", F.col("edge.third").alias("third"), F.col("edge.n").alias("n"), "flow_from")
    ends = nodes.select(F.col("first").alias("second"), F.col("second").alias("third"), F.col("flow").alias("flow_to"))
    edges = written(edges.join(ends, ["second", "third"]).withColumn("id", F.monotonically_increasing_id()), "frequent-edges")
    comes = edges.select(F.col("second").alias("first"), F.col("third").alias("second"), "n", F.when(F.col("n") == F.col("flow_to"), F.col("id")).alias("one_in"), F.lit(None).cast("long").alias("one_out"))
    goes = edges.select("first", "second", "n", F.lit(None).cast("long").alias("one_in"), F.when(F.col("n") == F.col("flow_from"), F.col("id")).alias("one_out"))
    at = comes.unionByName(goes).groupBy("first", "second").agg(F.max("n").alias("longer"), F.max("one_in").alias("one_in"), F.max("one_out").alias("one_out"))
    at = written(nodes.select("first", "second", "flow").join(at, ["first", "second"], "left"), "frequent-nodes")
    inner = F.col("one_in").isNotNull() & F.col("one_out").isNotNull()
    links = at.where(inner).select(F.col("one_in").alias("id"), F.col("one_out").alias("to"))
    linked = edges.select("id").join(links, "id", "left")
    paths = written(linked.select("id", F.coalesce("to", "id").alias("path"), F.col("to").isNotNull().cast("long").alias("to_end")), "path-ends")
    before = None
    while (now := paths.agg(F.coalesce(F.sum(F.col("to_end").cast("decimal(38,0)")), F.lit(0))).first()[0]) != before:
        further = paths.select(F.col("id").alias("path"), F.col("path").alias("_path"), F.col("to_end").alias("_more"))
        paths = written(paths.join(further, "path").select("id", F.col("_path").alias("path"), (F.col("to_end") + F.col("_more")).alias("to_end")), "path-ends")
        before = now
    return edges.join(paths, "id"), at.select("first", "second", "flow", "longer", F.coalesce(inner, F.lit(False)).alias("inner"))


def candidates(g: Graph, least: int = 10, percent: int = 50) -> DataFrame:
    """(first, second, third, a, l, r, score) of all phrases of two (``third`` 0) or three words that stay.

    A phrase of two words goes if one of three holds it at least ``percent`` in 100 of its times; one
    inside of a path always does. The score is that of the cut with the lowest, of the first in ties.
    """
    frequent = g.nodes.where(F.col("flow") >= least)
    counts = g.nodes.groupBy("first").agg(F.sum("flow").alias("count")).where(F.col("count") >= least)
    counts = written(counts, "word-counts").select(F.col("first").alias("_word"), "count")
    edges, nodes = compacted(written(frequent.where("second <> 0"), "frequent"))
    two = nodes.where("not inner").where(F.coalesce("longer", F.lit(0)) * 100 < F.col("flow") * percent)
    long_ = F.lit(None).cast("long")
    rows = edges.select("first", "second", "third", F.col("n").alias("a"), F.col("flow_from").alias("before"), F.col("flow_to").alias("after"))
    rows = rows.unionByName(two.select("first", "second", F.lit(0).cast("long").alias("third"), F.col("flow").alias("a"), long_.alias("before"), long_.alias("after")))
    rows = written(rows.withColumn("last", F.when(F.col("third") == 0, F.col("second")).otherwise(F.col("third"))), "candidates")
    small = measure(rows)[1]
    for end in ("first", "last"):
        table = counts.select(F.col("_word").alias(end), F.col("count").alias(f"count_{end}"))
        rows = lookup_join(rows, table, end, spread_by="second", small=small)

    def cut(k: int, left: str, right: str) -> F.Column:
        # In decimals: with counts below 10 ** 15 no product has more than 37 digits.
        a, l, r = (f"cast({c} as decimal(15, 0))" for c in ("a", left, right))
        score = F.expr(f"cast((1000000 * ({a} * {a})) div ({l} * {r}) as bigint)")
        return F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))

    of_three = F.least(cut(1, "count_first", "after"), cut(2, "before", "count_last"))
    best = F.when(F.col("third") == 0, cut(1, "count_first", "count_last")).otherwise(of_three)
    return rows.withColumn("best", best).select("first", "second", "third", "a", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, least: int = 10, percent: int = 50, most: int = 2000) -> DataFrame:
    """The ``most`` phrases of two or three words that score highest in each lang.

    Returns (lang, rank, phrase, a, l, r, n, score): ``a`` is how often the phrase occurs within
    pieces, ``l`` and ``r`` its parts at the cut that scores lowest, ``n`` all words of the lang,
    score floor(1000000 a a / (l r)). Phrases of fewer than ``least`` occurrences are none; one of
    two words goes if one of three that holds it occurs at least ``percent`` in 100 times as often.
    Ties go by count and then by the phrase's UTF-8 bytes.

    A-Z are lower-cased; pieces end at ``.,;:!?``, line ends and form feeds, words at space and tab.
    Null and empty texts have no words; a null lang is ``und``. Rows stand for themselves, repeated
    ones count again. An empty table, or one without frequent phrases, gives an empty result. Columns
    beyond text and lang are not looked at. Words are told apart by 63-bit hashes.
    """
    g = graph(docs, least)
    found = written(candidates(g, least, percent), "scored")
    pieces = max(1, found.count() // RANKED)
    spelled = lambda c: g.words.select(F.col("code").alias(c), F.col("word").alias(f"word_{c}"), F.col("lang").alias(f"lang_{c}"))
    # Ranked within pieces of a lang first, so that one task never sorts all of its candidates.
    named = found.join(spelled("first"), "first").withColumn("piece", F.pmod(F.xxhash64("first", "second", "third"), F.lit(pieces)))
    order = [F.desc("score"), F.desc("a")]
    for group in (["lang_first", "piece"], ["lang_first"]):
        # rank(), not row_number(): words that decide ties are looked up for what is left.
        named = named.withColumn("_rank", F.rank().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_rank") <= most)
    named = written(named, "ranked")
    for c in ("second", "third"):
        named = named.join(spelled(c).drop(f"lang_{c}"), c, "left")
    phrase = F.concat_ws(" ", "word_first", "word_second", "word_third")
    last = Window.partitionBy("lang").orderBy(*order, "phrase")
    out = named.select(F.col("lang_first").alias("lang"), phrase.alias("phrase"), "a", "l", "r", "score").join(g.totals, "lang")
    out = out.withColumn("rank", F.row_number().over(last).cast("long")).where(F.col("rank") <= most)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir):
    return collocations(read(spark, sf_dir, "documents"))


_SQL_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH piece AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_SQL_LOWER}, '[.,;:!?\n-\r]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS w FROM piece),
place AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
f AS (
    SELECT lang, phrase, size, count(*)::BIGINT AS f FROM (
        SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
        FROM (SELECT *, unnest(range(1, least(3, len(w) - i + 1) + 1)) AS size FROM place))
    GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
candidate AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
part AS (
    SELECT *, array_to_string(w[:k], ' ') AS before, array_to_string(w[k + 1:], ' ') AS after
    FROM (SELECT *, unnest(range(1, size)) AS k FROM candidate)),
cut AS (
    SELECT c.lang, c.phrase, c.size, c.f AS a, k, x.f AS l, y.f AS r,
        (1000000::HUGEINT * c.f * c.f // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM part c JOIN f x ON x.lang = c.lang AND x.phrase = c.before JOIN f y ON y.lang = c.lang AND y.phrase = c.after),
scored AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (
    SELECT lang, phrase, max(f) AS f FROM (
        SELECT lang, f, unnest([array_to_string(w[:2], ' '), array_to_string(w[2:], ' ')]) AS phrase FROM candidate WHERE size = 3)
    GROUP BY lang, phrase),
kept AS (
    SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
    FROM scored s LEFT JOIN held h ON h.lang = s.lang AND h.phrase = s.phrase AND s.size = 2
    WHERE h.f IS NULL OR 100 * h.f < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang) WHERE rank <= 2000
"""
