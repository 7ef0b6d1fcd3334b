"""N-gram Jaccard join by vertical partitioning of a global order of n-grams.

The global order puts rare n-grams first: by the size class of a counter that the n-gram shares
with others, counted over all documents, then by hash. Documents that can be similar share one of
the first n-grams of both (their prefixes), which names candidates. The order is cut into fragments;
the overlap of a candidate pair is counted in each fragment separately and summed per pair. Sizes
of the documents' parts in many fine fragments bound the overlap from above and drop candidates
before anything is counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.common import bytes_of, components, id_back, id_column, maybe_marked, mixed, read, release, slices, text_column, texts_with_keys, tidy, word_hashes
from sheaf.session import discard, written

#: Counters of the n-grams' frequencies, and the blocks they are summed in: a fixed 16 MB.
COUNTER_BITS, BLOCK_BITS = 22, 16
#: Fine fragments, whose sizes travel with candidates, and fragments that overlaps are counted in.
FINE_BITS, FRAGMENTS = 10, 8
#: Rows of one n-gram that are compared at a time, n-grams that may be split, rows of a task's bucket.
CELL_ROWS, MOST_SPLIT, BUCKET_ROWS, WIDE = 2048, 100_000, 20_000, 64
#: Pairs whose sizes of fragments are compared at a time (some 2 MB for each side).
STEP = 1 << 11
#: Bytes of text that a task works on at a time, and heads that a document is compared with first.
SLICE, HEADS = 1 << 20, 2
#: Orders of n-grams whose minima say in which n-gram a pair of documents is given: n-grams exclusive or these.
SALTS = (0, 0x5DEECE66D1CE4E5B, -0x61C8864680B583EB, -0x2B3D7A9C41F0E586)
#: Rounds of heads at most, and of how many compared pairs one must be a link for another round.
ROUNDS, WORTH = 2, 10
#: Bits that say which documents are in a candidate pair (a fixed 8 MB at most; false ones do no harm).
MEMBER_BITS = 26


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, n-gram) of all distinct n-grams of each text, sorted by both.

    A text with fewer words is one n-gram, the whole sequence; one without words has none.
    """
    data, bounds = bytes_of(texts.cast(pa.binary()))
    hashes, n = word_hashes(data, bounds)
    row = np.repeat(np.arange(len(n)), n)
    ends = np.cumsum(n)
    left = np.repeat(ends, n) - np.arange(len(hashes))  # words from here to the text's end
    short = np.repeat(n, n) < words
    begin = (left >= words) | short & (left == np.repeat(n, n))
    at = np.flatnonzero(begin)
    gram = np.full(len(at), words, np.uint64)
    gram[short[at]] = n[row[at][short[at]]].astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            inside = left[at] > k
            step = mixed(gram[inside] * np.uint64(0x9E3779B97F4A7C15) + hashes[at[inside] + k])
            gram[inside] = step
    row, gram = row[at], gram
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    new = np.append(True, (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])) if len(row) else np.zeros(0, bool)
    return row[new], gram[new]


_SCAN = "block int, counts binary, key long, doc long, n int, f1 long, f2 long, sizes binary"


def _scan(words: int):
    def scan(batches):
        counters = np.zeros(1 << COUNTER_BITS, np.uint32)
        names = [c.split()[0] for c in _SCAN.split(", ")]
        kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        for batch in slices(batches, "text", SLICE):
            row, gram = shingle_sets(batch.column("text"), words)
            np.add.at(counters, gram >> np.uint64(64 - COUNTER_BITS), np.uint32(1))
            n = np.bincount(row, minlength=batch.num_rows)
            begins = np.append(0, np.cumsum(n))
            sums = []
            with np.errstate(over="ignore"):
                for salt in (1, 2):
                    total = np.append(np.uint64(0), np.cumsum(mixed(gram + np.uint64(salt))))
                    sums.append((total[begins[1:]] - total[begins[:-1]]).view(np.int64))
            fine = row << FINE_BITS | (gram >> np.uint64(64 - FINE_BITS)).astype(np.int64)
            # Four bits each; a larger size counts as 15, which only weakens the bound.
            sizes = np.minimum(np.bincount(fine, minlength=batch.num_rows << FINE_BITS), 15).astype(np.uint8).reshape(batch.num_rows, -1)
            sizes = sizes[:, ::2] << 4 | sizes[:, 1::2]
            nothing = [pa.nulls(batch.num_rows, k) for k in kinds[:2]]
            yield pa.RecordBatch.from_arrays([*nothing, batch.column("key"), batch.column("doc"), pa.array(n.astype(np.int32)), *map(pa.array, sums), pa.array([s.tobytes() for s in sizes], pa.binary())], names)
        blocks = counters.reshape(-1, 1 << BLOCK_BITS)
        packed = [(k, zstandard.compress(b.tobytes(), 1)) for k, b in enumerate(blocks) if b.any()]
        if packed:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in packed], pa.int32()), pa.array([p for _, p in packed], pa.binary()), *(pa.nulls(len(packed), k) for k in kinds[2:])], names)

    return scan


def _summed(batches):
    """Sums of the counter blocks, one block at a time in memory per block number seen."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
            part = np.frombuffer(zstandard.decompress(counts), np.uint32)
            sums[block] = sums.get(block, 0) + part.astype(np.uint64)
    for block, total in sums.items():
        size = np.frexp(total.astype(np.float64))[1].astype(np.uint8)  # bits of the count
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([size.tobytes()], pa.binary())], ["block", "classes"])


def _classes(scanned: DataFrame) -> np.ndarray:
    """The size class of each counter: a table of fixed size, whatever the corpus."""
    blocks = scanned.where("block is not null").select("block", "counts").repartition(1 << (COUNTER_BITS - BLOCK_BITS), "block")
    out = np.zeros((1 << (COUNTER_BITS - BLOCK_BITS), 1 << BLOCK_BITS), np.uint8)
    for row in blocks.mapInArrow(_summed, "block int, classes binary").collect():
        out[row.block] = np.frombuffer(row.classes, np.uint8)
    return out.ravel()


def _prefixes(texts: DataFrame, classes, words: int, percent: int) -> DataFrame:
    """(gram, key): the first n-grams of every document, of which similar documents share one."""

    def prefixes(batches):
        for batch in slices(batches, "text", SLICE):
            row, gram = shingle_sets(batch.column("text"), words)
            kind = classes.value[(gram >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
            gram = gram[np.lexsort((gram, kind, row))]
            n = np.bincount(row, minlength=batch.num_rows)
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            first = place < np.repeat(n - -(-percent * n // 100) + 1, n)
            yield pa.RecordBatch.from_arrays([pa.array(gram[first].view(np.int64)), batch.column("key").take(pa.array(row[first]))], ["gram", "key"])

    return texts.select("key", "text").mapInArrow(prefixes, "gram long, key long")


def overlaps(texts: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """(a, b, common): the overlap of each pair, counted in each fragment and summed per pair."""
    spark = texts.sparkSession
    members = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    bit = F.pmod(F.xxhash64("key"), F.lit(1 << MEMBER_BITS)) + 1
    bitmap = members.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    shared = spark.sparkContext.broadcast({r.bucket: bytes(r.bits) for r in bitmap.collect()})
    empty = bytes(4096)

    def segments(batches):
        for batch in batches:
            bits = batch.column("bit").to_numpy() - 1
            there = [shared.value.get(b // 32768 + 1, empty)[b % 32768 // 8] >> (b % 8) & 1 for b in bits.tolist()]
            for part in slices([batch.filter(pa.array(there, pa.int32()).cast(pa.bool_()))], "text", SLICE):
                row, gram = shingle_sets(part.column("text"), words)
                # The n-grams are sorted by hash, so fragments are stretches of each text's.
                piece = row * FRAGMENTS + (gram >> np.uint64(32)).astype(np.int64) * FRAGMENTS // (1 << 32)
                at = np.flatnonzero(np.append(True, piece[1:] != piece[:-1])) if len(piece) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(gram)).astype(np.int32)), pa.array(gram.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(row[at])), pa.array((piece[at] % FRAGMENTS).astype(np.int32)), lists], ["key", "fragment", "grams"])

    found = texts.select("key", bit.alias("bit"), "text").mapInArrow(segments, "key long, fragment int, grams array<long>")
    found = written(found.join(members, "key", "left_semi").dropDuplicates(["key", "fragment"]), "segments")
    release(spark)  # the n-grams' next exchanges need not lie beside that of their writing
    left = found.select(F.col("key").alias("a"), "fragment", F.col("grams").alias("ga"))
    right = found.select(F.col("key").alias("b"), "fragment", F.col("grams").alias("gb"))
    partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", F.size(F.array_intersect("ga", "gb")).alias("common"))
    out = written(partial.groupBy("a", "b").agg(F.sum("common").alias("common")), "overlaps")
    discard(found)
    release(spark)
    return out


def _linked(texts: DataFrame, sets: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs of candidates whose sets are similar enough."""
    size = lambda c: sets.select(F.col("key").alias(c), F.col("n").cast("long").alias(f"n{c}"))
    sized = overlaps(texts, pairs, words).join(size("a"), "a").join(size("b"), "b")
    return sized.where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def _unpacked(sizes: list) -> np.ndarray:
    """The sizes of the fine fragments of each document, a row each."""
    packed = np.frombuffer(b"".join(sizes), np.uint8).reshape(len(sizes), -1)
    return np.concatenate([packed >> 4, packed & 15], axis=1).astype(np.int8)


def _close(n: np.ndarray, sizes: np.ndarray, i, j, percent: int) -> np.ndarray:
    """Whether sizes allow the similarity: in all, and summed over the fine fragments."""
    both = n[i] + n[j]
    fits = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
    at = np.flatnonzero(fits)
    apart = np.abs(sizes[i[at]] - sizes[j[at]]).sum(axis=-1, dtype=np.int64)
    fits[at] = apart * (100 + percent) <= (100 - percent) * both[at]
    return fits


def _possible(percent: int):
    def possible(batches):
        for batch in batches:
            na, nb = (batch.column(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
            sizes = _unpacked([s for c in ("sa", "sb") for s in batch.column(c).to_pylist()])
            k = np.arange(batch.num_rows)
            ok = _close(np.concatenate([na, nb]), sizes, k, k + batch.num_rows, percent)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return possible


def _candidates(percent: int, most: int):
    """(a, b) of documents that share an n-gram, ``most`` behind each in a run; n-grams with more come back as ``more``.

    Documents whose n-grams' minima agree for a salt both have that n-gram: the pair is given there
    only (for the first such salt), not once for every n-gram that they share.
    """

    def candidates(table):
        table = table.sort_by([(c, "ascending") for c in ("gram", "i", "j", "key")])
        gram, i, j, piece, key, part, n = (table.column(c).to_numpy() for c in ("gram", "i", "j", "piece", "key", "component", "n"))
        least = [table.column(f"least_{k}").to_numpy() for k in range(len(SALTS))]
        sizes = _unpacked(table.column("sizes").to_pylist())
        n = n.astype(np.int64)
        new = np.append(True, (gram[1:] != gram[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) if len(gram) else np.zeros(0, bool)
        begins = np.flatnonzero(new)
        run, lengths = np.cumsum(new) - 1, np.diff(np.append(begins, len(gram)))
        out, taken, more = [np.zeros((2, 0), np.int64)], np.zeros(len(gram), np.int64), np.zeros(len(gram), bool)

        def fitting(p, q):
            """Which pairs are apart, belong here, and may be similar."""
            ok = (part[p] != part[q]) & ((i[p] == j[p]) | (piece[p] != piece[q]))
            open_ = np.ones(len(p), bool)
            for salt, low in zip(SALTS, least):
                agree = open_ & (low[p] == low[q])
                ok &= ~agree | (low[p] == gram[p] ^ salt)
                open_ &= ~agree
            p, q = p[ok], q[ok]
            ok = _close(n, sizes, p, q, percent)
            return p[ok], q[ok]

        def give(p, q):
            x, y = key[p], key[q]
            out.append(np.stack([np.minimum(x, y), np.maximum(x, y)]))

        for begin, length in zip(begins[lengths > WIDE].tolist(), lengths[lengths > WIDE].tolist()):
            for row in range(begin, begin + length - 1):
                for start in range(row + 1, begin + length, STEP):
                    q = np.arange(start, min(start + STEP, begin + length))
                    p, q = fitting(np.full(len(q), row), q)
                    room = most - taken[row]
                    more[row] = len(q) > room
                    taken[row] += len(q[:room])
                    give(p[:room], q[:room])
                    if more[row]:
                        break
        narrow = np.repeat(lengths <= WIDE, lengths)
        for step in range(1, int(lengths[lengths <= WIDE].max(initial=0))):
            at = np.flatnonzero((run[step:] == run[:-step]) & narrow[step:] & ~more[:-step])
            for start in range(0, len(at), STEP):
                p = at[start : start + STEP]
                p, q = fitting(p, p + step)
                full = taken[p] >= most
                more[p[full]] = True
                taken[p] += 1
                give(p[~full], q[~full])
        a, b = np.concatenate(out, axis=1)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
        pairs = pa.table({"a": a[new], "b": b[new], "more": pa.nulls(int(new.sum()), pa.int64())})
        left = np.unique(gram[more])
        nothing = pa.nulls(len(left), pa.int64())
        tidy()
        return pa.concat_tables([pairs, pa.table({"a": nothing, "b": nothing, "more": left})])

    return candidates


def _cells(apart: DataFrame, spread: DataFrame, sets: DataFrame, minima: DataFrame) -> tuple[DataFrame, int]:
    """Rows to compare, n-grams with many of them dealt over pairs of pieces, and the number of buckets for them."""
    total = spread.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    split = max(CELL_ROWS, total / MOST_SPLIT)
    # At most MOST_SPLIT n-grams can be that large, so their list may be broadcast.
    large = spread.where(F.col("rows") > split).select("gram", F.ceil(F.col("rows") / CELL_ROWS).cast("int").alias("pieces"))
    apart = apart.join(F.broadcast(large), "gram", "left")
    apart = apart.withColumn("pieces", F.coalesce("pieces", F.lit(1))).withColumn("piece", F.pmod(F.xxhash64("key"), F.col("pieces")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda o: F.struct(F.least(o, F.col("piece")).alias("i"), F.greatest(o, F.col("piece")).alias("j")))
    cells = apart.join(minima, "key").join(sets.select("key", "n", "sizes"), "key").withColumn("cell", F.explode(others))
    least = [f"least_{k}" for k in range(len(SALTS))]
    return cells.select("gram", "cell.i", "cell.j", "piece", "key", "component", "n", "sizes", *least), max(1, int(total // BUCKET_ROWS))


def _recurring(batches):
    """Of rows sorted by ``gram`` those that are not alone in it: only the last row waits for the next batch."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = batch if held is None else pa.concat_batches([held, batch])
        gram = whole.column("gram").to_numpy()
        same = gram[1:] == gram[:-1]
        shared = np.append(same, False) | np.append(False, same)
        # The held row is known to be shared if it was so before, which its mark says.
        if held is not None and held.schema.metadata:
            shared[0] = True
        last = whole.slice(whole.num_rows - 1)
        held = last.replace_schema_metadata({"shared": "1"} if shared[-1] else None)
        yield whole.slice(0, whole.num_rows - 1).filter(pa.array(shared[:-1])).replace_schema_metadata(None)
    if held is not None and held.schema.metadata:
        yield held.replace_schema_metadata(None)


def _stars(named: DataFrame, round_: int) -> DataFrame:
    """(a, b), a < b: each document with those of its n-grams' heads that share most of them.

    An n-gram's head is the document with the smallest hash of this round; rows are (gram, key,
    component), and documents are compared with heads of other components only.
    """
    by_hash = F.min_by(F.struct("key", "component"), F.xxhash64("key", F.lit(round_)))
    heads = named.groupBy("gram").agg(by_hash.alias("head"))
    near = named.join(heads, "gram").where("component <> head.component")
    near = near.groupBy("key", F.col("head.key").alias("other")).agg(F.count(F.lit(1)).alias("shared"))
    best = Window.partitionBy("key").orderBy(F.desc("shared"), "other")
    near = near.withColumn("turn", F.row_number().over(best)).where(F.col("turn") <= HEADS)
    return near.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct()


def similar_groups(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """Groups of documents linked by the Jaccard similarity of their word n-gram sets.

    Returns (key, doc, n, component_id, component), one row per row of ``docs``: ``n`` is the size of
    the set, ``component_id`` the smallest doc_id reachable by links (100 * intersection >=
    ``percent`` * union), ``component`` names the group. ``key`` is that of ``texts_with_keys``.

    Words are runs without ASCII white space, A-Z lower-cased; a text with fewer words than an
    n-gram is one n-gram as a whole; null, empty and blank texts have none and link with nothing.
    Rows alike in id and text are one document; rows with one id and different texts are compared
    each for itself. A null id counts as smaller than all others. An empty table gives an empty
    result. Other columns are not looked at. N-grams are compared by 64-bit hashes.

    Documents with equal sets are compared once. Rounds compare every prefix n-gram's documents with
    one of them, another one each time, so that large groups mostly fall together without pairs, and
    go on while that finds links. Then all that share a prefix n-gram and are still apart are
    candidates. Each document is compared with a few behind it in an n-gram; n-grams where that were
    not all are gone through again with the components found since and eight times as many, until
    nothing is left out. N-grams with many documents are dealt over pairs of pieces.
    """
    spark = docs.sparkSession
    texts = texts_with_keys(docs)
    scanned = written(texts.mapInArrow(_scan(words), _SCAN), "shingle-scan")
    same = scanned.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("key").alias("key"), F.min("doc").alias("least"), F.first("sizes").alias("sizes"))
    sets = written(same, "shingle-sets")
    everything = written(scanned.where("key is not null").select("key", "doc", "n", "f1", "f2"), "documents-seen")
    classes = spark.sparkContext.broadcast(_classes(scanned))
    discard(scanned)
    prefixes = _prefixes(texts, classes, words, percent)
    # One exchange: sorted, those of one document only are dropped as they stream by.
    rows = prefixes.repartition("gram").sortWithinPartitions("gram").mapInArrow(_recurring, "gram long, key long")
    rows = written(rows.join(sets.select("key"), "key", "left_semi").distinct(), "shared-prefixes")
    release(spark)
    size = lambda c: sets.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("sizes").alias(f"s{c}"))
    links, compared, superseded, named = None, None, [], rows.withColumn("component", F.col("key"))
    for round_ in range(ROUNDS):
        stars = _stars(named, round_)
        if compared is not None:
            stars = stars.join(compared, ["a", "b"], "left_anti")
        stars = stars.join(size("a"), "a").join(size("b"), "b").mapInArrow(_possible(percent), "a long, b long")
        stars = written(stars, "stars")
        release(spark)
        found = written(_linked(texts, sets, stars, words, percent), "links")
        compared = stars if compared is None else compared.unionByName(stars)
        links = found if links is None else links.unionByName(found)
        now = components(links).select(F.col("node").alias("key"), "component")
        # What is still apart: n-grams whose documents are of different components.
        named = rows.join(now, "key", "left").withColumn("component", F.coalesce("component", "key"))
        spread = named.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("rows"))
        spread = written(spread.where("low < high").select("gram", "rows"), "apart")
        named = written(named.join(spread.select("gram"), "gram", "left_semi"), "apart-rows")
        for table in superseded:
            discard(table)
        superseded = [spread, named]
        if found.count() * WORTH < stars.count():
            break
    discard(rows)
    release(spark)
    minima = [F.min(F.col("gram").bitwiseXOR(F.lit(salt))).alias(f"least_{k}") for k, salt in enumerate(SALTS)]
    minima = written(named.groupBy("key").agg(*minima), "minima")
    groups, most = None, HEADS
    while True:
        cells, buckets = _cells(named, spread, sets, minima)
        found = cells.groupBy(F.pmod(F.xxhash64("gram", "i", "j"), F.lit(buckets)).alias("bucket")).applyInArrow(_candidates(percent, most), "a long, b long, more long")
        found = written(found, "candidates")
        release(spark)
        pairs = written(found.where("more is null").select("a", "b").distinct().join(compared, ["a", "b"], "left_anti"), "pairs")
        if pairs.take(1):
            links = links.unionByName(written(_linked(texts, sets, pairs, words, percent), "links"))
            compared, groups = compared.unionByName(pairs), None
        if groups is None:
            groups = components(links)
        rest = found.where("more is not null").select(F.col("more").alias("gram")).distinct()
        if not rest.take(1):
            break
        # N-grams whose documents had more candidates than were given, as far as they are still apart.
        now = groups.select(F.col("node").alias("key"), "component")
        named = named.drop("component").join(rest, "gram", "left_semi").join(now, "key", "left").withColumn("component", F.coalesce("component", "key"))
        named = written(named, "apart-rows")
        spread = named.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("rows"))
        spread = written(spread.where("low < high").select("gram", "rows"), "apart")
        named = named.join(spread.select("gram"), "gram", "left_semi")
        most *= 8
    grouped = sets.join(groups, F.col("key") == F.col("node"), "left").withColumn("component", F.coalesce("component", "key"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    by_set = grouped.join(least, "component").select("n", "f1", "f2", "component", "component_id")
    out = everything.join(by_set, ["n", "f1", "f2"], "left")
    return out.select("key", "doc", "n", F.coalesce("component_id", "doc").alias("component_id"), F.coalesce("component", "key").alias("component"))


def query(spark, sf_dir):
    groups = similar_groups(read(spark, sf_dir, "documents"))
    return groups.select(id_back("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), id_back("component_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay when each group of similar documents is left with one.

    That is the document with the smallest doc_id (of rows alike in it, the one with the smallest
    hash, once). Documents without words link with nothing and all stay, as they came.
    """
    groups = similar_groups(docs, words, percent).where("n > 0")
    heads = groups.groupBy("component").agg(F.min(F.struct("doc", "key")).alias("head"), F.count(F.lit(1)).alias("rows"))
    # Rows alike in id and text share their key: they are told apart only where there are several.
    alike = groups.groupBy("key").agg(F.count(F.lit(1)).alias("alike"))
    gone = groups.join(heads, "component").join(alike, "key").where((F.col("key") != F.col("head.key")) | (F.col("alike") > 1))
    gone = written(gone.select("key", (F.col("key") != F.col("head.key")).alias("gone")).distinct(), "not-kept")
    doc, text = id_column(), text_column()
    row = docs.select(F.xxhash64(doc, text).alias("key"), F.struct("*").alias("row"))
    # Most rows are not in question: only those perhaps in the list meet it by a shuffle.
    perhaps = maybe_marked(row, gone.select("key"))
    sure = perhaps.where("not perhaps").select("row.*")
    asked = perhaps.where("perhaps").join(gone, "key", "left").where("gone is null or not gone")
    again = Window.partitionBy("key", "gone").orderBy(F.lit(0))
    single = asked.where("gone is null").select("row.*")
    once = asked.where("not gone").withColumn("turn", F.row_number().over(again)).where("turn = 1").select("row.*")
    return sure.unionByName(single).unionByName(once)
