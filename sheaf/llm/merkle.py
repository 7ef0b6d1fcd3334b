"""A Merkle manifest of documents, kept as a log of nodes in postorder.

Every tree has its leaves in order, and every two neighbours of a level, or the last one alone, have
a parent. Builders own aligned stretches of ``1 << HEIGHT`` nodes of a level and write what they
complete in the order of completion. A node's place in the whole log is known without the log: it is
the number of nodes that are complete before its leaves begin, and the size of its subtree. So a
proof addresses its siblings by place, a builder's stretch holds all of a leaf's lower siblings, and
one path from the stretch's top to the root is enough for all of its leaves.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.common import read
from sheaf.operators.ordering import ordered_table
from sheaf.session import written

#: Levels that one builder completes: its stretch has at most 1 << HEIGHT nodes.
HEIGHT = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def hashed(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def height_of(leaves: int) -> int:
    """The level of the root."""
    return (leaves - 1).bit_length()


def place_of(level: int, index: int, leaves: int) -> int:
    """A node's place in the postorder log of a tree, from 0.

    Before its leaves begin, s leaves have completed 2 s - (ones of s) nodes; the nodes of its own
    subtree follow, itself the last.
    """
    start = index << level
    below = min(1 << level, leaves - start)
    size = (2 << level) - 1 if below == 1 << level else sum(-(-below >> k) for k in range(level + 1))
    return 2 * start - start.bit_count() + size - 1


def siblings_of(index: int, leaves: int) -> list[tuple[int, int] | None]:
    """(level, index) of a leaf's siblings, bottom up; None where a node has no sibling."""
    out: list[tuple[int, int] | None] = []
    for level in range(height_of(leaves)):
        other = (index >> level) ^ 1
        out.append((level, other) if other << level < leaves else None)
    return out


def folded(leaf: str, path: list[str]) -> str:
    """The root that a leaf and its path give: ``L`` or ``R`` and the sibling on that side, or ``U`` for none."""
    for step in path:
        leaf = hashed(step[1:], leaf) if step[0] == "L" else hashed(leaf, step[1:])
    return leaf


def _step(digest: str | None, index: int) -> str:
    return "U" if digest is None else ("L" if index & 1 else "R") + digest


_NODE = "tree string, level int, block long, place long, index long, digest string"
_LOG = pa.schema([("tree", pa.string()), ("level", pa.int32()), ("block", pa.int64()), ("place", pa.int64()), ("index", pa.int64()), ("digest", pa.string())])


def _build(low: int, high: int):
    """One builder's stretch: nodes of level ``low`` come in, those completed up to ``high`` go out in that order."""

    def build(table):
        table = table.sort_by("index")
        rows = []
        tree, leaves = table.column("tree")[0].as_py(), table.column("leaves")[0].as_py()
        top = min(height_of(leaves), high)
        count = -(-leaves >> low)  # nodes of the level in the whole tree
        nodes: dict[tuple[int, int], str] = {}
        for index, digest in zip(table.column("index").to_pylist(), table.column("digest").to_pylist()):
            nodes[low, index] = digest
            if low == 0:
                rows.append((0, index, digest))
            for level in range(low + 1, top + 1):
                at = index >> level - low
                whole = (at + 1 << level - low) - 1 == index
                if not whole and index != count - 1:
                    break
                left = at << 1
                nodes[level, at] = hashed(*(nodes[level - 1, k] for k in (left, left + 1) if (level - 1, k) in nodes))
                rows.append((level, at, nodes[level, at]))
        block = table.column("block")[0].as_py()
        columns = [[tree] * len(rows), [r[0] for r in rows], [block] * len(rows), [place_of(r[0], r[1], leaves) for r in rows], [r[1] for r in rows], [r[2] for r in rows]]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _LOG.types)], schema=_LOG)

    return build


class Log:
    """The nodes of trees: ``rounds`` of builders' stretches, the trees' sizes, their roots."""

    def __init__(self, rounds: list[DataFrame], sizes: DataFrame, roots: DataFrame):
        self.rounds, self.sizes, self.roots = rounds, sizes, roots

    def nodes(self) -> DataFrame:
        """(tree, level, block, place, index, digest) of all nodes."""
        out = self.rounds[0]
        for later in self.rounds[1:]:
            out = out.unionByName(later)
        return out


def numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` with each one's ``index`` in its ``tree`` by ``order``, and the tree's number of ``leaves``.

    Ranges of (tree, order) are sorted; one row per range and tree crosses ranges.
    """
    table = ordered_table(leaves, ["tree", *order])
    parts = table.groupBy("tree", "_range").agg(F.min("_index").alias("_first"), F.count(F.lit(1)).alias("_n"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("tree", "_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(tree).alias("leaves"))
    placed = table.join(parts, ["tree", "_range"]).withColumn("index", F.col("_before") + F.col("_index") - F.col("_first"))
    return written(placed.select(*leaves.columns, "index", "leaves"), "numbered-leaves")


def append_log(leaves: DataFrame) -> Log:
    """The log of trees of ``leaves`` (tree, index, leaves, digest), as ``numbered`` gives them.

    Each round completes HEIGHT levels; a round's tops are the next one's nodes, so the rows fall by
    1 << HEIGHT from round to round and no builder has more than that many.
    """
    sizes = written(leaves.groupBy("tree").agg(F.max("leaves").alias("leaves")), "tree-sizes")
    most = sizes.agg(F.coalesce(F.max("leaves"), F.lit(1))).first()[0]
    rounds = []
    nodes = leaves.select("tree", "index", "leaves", "digest")
    for low in range(0, max(1, height_of(most)), HEIGHT):
        block = F.shiftright("index", HEIGHT).alias("block")
        done = nodes.select("*", block).groupBy("tree", "block").applyInArrow(_build(low, low + HEIGHT), _NODE)
        rounds.append(written(done, "node-log"))
        nodes = rounds[-1].where(F.col("level") == low + HEIGHT).join(sizes, "tree").where(F.col("leaves") > (1 << low + HEIGHT)).select("tree", "index", "leaves", "digest")
    log = Log(rounds, sizes, sizes)
    ends = log.nodes().join(sizes.withColumnRenamed("leaves", "_leaves"), "tree")
    # The root is the last of its tree's log.
    log.roots = written(ends.groupBy("tree").agg(F.max_by("digest", "place").alias("digest")), "roots")
    return log


_PATHS = pa.schema([("tree", pa.string()), ("index", pa.int64()), ("path", pa.string()), ("root", pa.string())])
_PATH = "tree string, index long, path string, root string"


def _paths_in(low: int, high: int):
    """Each node's path in a stretch: its siblings addressed by place, then the path of the stretch's top."""

    def paths(table):
        node = pc.is_null(table.column("path"))
        above = table.filter(pc.invert(node)).to_pylist()
        if not above:  # the root of a tree that ended with the round below
            return _PATHS.empty_table()
        above = above[0]
        table = table.filter(node)
        digests = dict(zip(table.column("place").to_pylist(), table.column("digest").to_pylist()))
        leaves = above["leaves"]
        rows = []
        for index in table.filter(pc.equal(table.column("level"), low)).column("index").to_pylist():
            rows.append((index, _path(digests, index, low, high, leaves, above["path"])))
        columns = [[above["tree"]] * len(rows), [r[0] for r in rows], [r[1] for r in rows], [above["root"]] * len(rows)]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _PATHS.types)], schema=_PATHS)

    return paths


def _path(digests: dict[int, str], index: int, low: int, high: int, leaves: int, above: str) -> str:
    steps = []
    for level in range(low, min(height_of(leaves), high)):
        at = index >> level - low
        other = at ^ 1
        there = other << level < leaves
        steps.append(_step(digests[place_of(level, other, leaves)] if there else None, at))
    return " ".join([*steps, *([above] if above else [])])


def _stretches(log: Log, round_: int, above: DataFrame) -> DataFrame:
    """All rows that the paths of a round's stretches need: its nodes, those it was built from, the path above."""
    columns = ["tree", "block", "level", "place", "index", "digest"]
    rows = log.rounds[round_].select(*columns)
    if round_:
        below = log.rounds[round_ - 1].where(F.col("level") == round_ * HEIGHT)
        rows = rows.unionByName(below.withColumn("block", F.shiftright("index", HEIGHT)).select(*columns))
    return rows.unionByName(above, allowMissingColumns=True)


def _paths_above(log: Log, tops: DataFrame) -> DataFrame:
    """(tree, block, leaves, path, root): the way up from each stretch of the first round.

    ``tops`` (tree, path, root) says what lies above a tree's root.
    """
    tops = tops.join(log.sizes, "tree")
    now = None
    for round_ in range(len(log.rounds) - 1, -1, -1):
        # Trees that end in this round begin here; the others' stretches are nodes of the round above.
        at = tops.where(F.col("leaves") <= 1 << (round_ + 1) * HEIGHT)
        at = at.where(F.col("leaves") > 1 << round_ * HEIGHT) if round_ else at
        at = at.select("tree", F.lit(0).cast("long").alias("block"), "leaves", "path", "root")
        if now is not None:
            at = at.unionByName(now.join(log.sizes, "tree").select("tree", F.col("index").alias("block"), "leaves", "path", "root"))
        if round_:
            found = _stretches(log, round_, at).groupBy("tree", "block").applyInArrow(_paths_in(round_ * HEIGHT, (round_ + 1) * HEIGHT), _PATH)
            now = written(found, "paths")
    return at


def _proofs_of(high: int):
    """Proof, and the root that the leaf or what it was tampered into folds to, for each leaf of a stretch."""

    def proofs_of(left, right):
        above = right.filter(pc.is_valid(right.column("path"))).to_pylist()[0]
        digests = dict(zip(right.column("place").to_pylist(), right.column("digest").to_pylist()))
        rows = []
        for index, leaf, tampered in zip(*(left.column(c).to_pylist() for c in ("index", "digest", "tampered"))):
            path = _path(digests, index, 0, high, above["leaves"], above["path"]).split()
            rows.append((hashed(*(step[1:] for step in path)), folded(leaf if tampered is None else tampered, path)))
        columns = [left.column("doc_id"), left.column("digest"), left.column("tree"), pa.array([above["root"]] * len(rows), pa.string())]
        columns += [pa.array([r[k] for r in rows], pa.string()) for k in range(2)]
        return pa.Table.from_arrays(columns, names=["doc_id", "leaf", "tree", "root", "proof_sha256", "folded_root"])

    return proofs_of


def leaf_digest(n_chars=None) -> F.Column:
    """The hash of a row: of each field ``-`` if null, else its UTF-8 length, a colon and its value."""
    parts = []
    for name in FIELDS:
        value = (n_chars if name == "n_chars" and n_chars is not None else F.col(name)).cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def tampered_rows() -> F.Column:
    """Where 7 divides the checksum of the decimal doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))


class Manifest:
    """Documents' leaves in order, the trees per lang, their roots in order, and the tree over these."""

    def __init__(self, leaves: DataFrame, log: Log, roots: DataFrame, top: Log):
        self.leaves, self.log, self.roots, self.top = leaves, log, roots, top


def manifest(docs: DataFrame) -> Manifest:
    """The leaves of ``docs`` (one per row) and the logs of their trees, as written tables.

    A tree's name is ``0`` for the null lang, else ``1`` and the lang, so names are in order. Leaves
    ascend by doc_id (null first), rows with one id by digest; rows alike are leaves each. An empty
    table gives empty logs. Columns beyond those of FIELDS are not looked at.
    """
    tree = F.when(F.col("lang").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("lang")))
    # In decimals, so that one more than the largest long is a number too.
    more = F.when(tampered_rows(), leaf_digest(F.col("n_chars").cast("decimal(20,0)") + 1))
    leaves = written(docs.select(tree.alias("tree"), F.col("doc_id").cast("long"), leaf_digest().alias("digest"), more.alias("tampered")), "leaves")
    leaves = numbered(leaves, ["doc_id", "digest"])
    log = append_log(leaves)
    roots = numbered(log.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"])
    return Manifest(leaves, log, roots, append_log(roots))


def ways_to_root(m: Manifest) -> DataFrame:
    """(tree, path, root) of every lang's tree: how its root hangs together with the root of all."""
    end = m.top.roots.select("tree", F.lit("").alias("path"), F.col("digest").alias("root"))
    nodes = _stretches(m.top, 0, _paths_above(m.top, end)).groupBy("tree", "block")
    paths = nodes.applyInArrow(_paths_in(0, HEIGHT), _PATH).select("index", "path", "root")
    return written(m.roots.join(paths, "index").select(F.col("name").alias("tree"), "path", "root"), "ways-to-root")


def proofs(log: Log, wanted: DataFrame) -> DataFrame:
    """(tree, index, level, side, digest) of the siblings of ``wanted`` leaves (tree, index), by their places.

    For a few leaves: an equi-join of places with the log, some log2(leaves) rows per leaf.
    """

    def addresses(batches):
        for batch in batches:
            rows = []
            for tree, index, leaves in zip(*(batch.column(c).to_pylist() for c in ("tree", "index", "leaves"))):
                for at in siblings_of(index, leaves):
                    if at is not None:
                        rows.append((tree, index, at[0], "L" if at[1] << at[0] < index else "R", place_of(*at, leaves)))
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["tree", "index", "level", "side", "place"])

    asked = wanted.select("tree", "index").join(log.sizes, "tree")
    asked = asked.mapInArrow(addresses, "tree string, index long, level int, side string, place long")
    return asked.join(log.nodes().select("tree", "place", "digest"), ["tree", "place"]).drop("place")


def verify_all(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` and every row's proof, checked after tampering with some rows.

    Returns (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row per row of
    ``docs``: ``folded_root`` is recomputed with the original siblings from the row as it is, or with
    n_chars one larger where ``tampered_rows`` says so. Nulls and ties as in ``manifest``.
    """
    m = manifest(docs)
    nodes = _stretches(m.log, 0, _paths_above(m.log, ways_to_root(m))).groupBy("tree", "block")
    members = m.leaves.withColumn("block", F.shiftright("index", HEIGHT)).groupBy("tree", "block")
    found = members.cogroup(nodes).applyInArrow(_proofs_of(HEIGHT), "doc_id long, leaf string, tree string, root string, proof_sha256 string, folded_root string")
    subroots = m.log.roots.select("tree", F.col("digest").alias("subroot"))
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
    return found.join(subroots, "tree").select(*columns, (F.col("folded_root") == F.col("root")).alias("verified"))


def query(spark, sf_dir):
    return verify_all(read(spark, sf_dir, "documents"))


def _sql_leaf(n_chars: str) -> str:
    fields = [n_chars if name == "n_chars" else f"{name}::VARCHAR" for name in FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in fields) + ")"


_SQL_LEVELS = """
    SELECT 0 AS level, tree, i, n, h FROM {table}
    UNION ALL
    SELECT level + 1, tree, i // 2, any_value(n), sha256(string_agg(h, '' ORDER BY i)) FROM {name}
    WHERE (1 << level) < n GROUP BY level, tree, i // 2"""
_SQL_STEP = "CASE WHEN o.h IS NULL THEN 'U' WHEN ({i} >> l.level) % 2 = 1 THEN 'L' || o.h ELSE 'R' || o.h END"

#: Level by level; a row's path is a list of steps. Checksums bit by bit, as DuckDB has none.
SQL = f"""
WITH RECURSIVE
hashed AS (
    SELECT coalesce('1' || lang, '0') AS tree, doc_id, {_sql_leaf("n_chars::VARCHAR")} AS h, {_sql_leaf("(n_chars::HUGEINT + 1)::VARCHAR")} AS changed,
        xor(4294967295::UBIGINT, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT),
            lambda crc, c: list_reduce(list_transform(range(8), lambda k: 0::UBIGINT),
                lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END, xor(crc, c)), 4294967295::UBIGINT)) AS crc
    FROM documents),
leaf AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM hashed),
node AS ({_SQL_LEVELS.format(table="leaf", name="node")}),
subroot AS (SELECT tree AS name, '' AS tree, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM node WHERE (1 << level) >= n),
upper_node AS ({_SQL_LEVELS.format(table="subroot", name="upper_node")}),
root AS (SELECT h FROM upper_node WHERE (1 << level) >= n),
step AS (
    SELECT s.tree, s.i, l.level AS k, {_SQL_STEP.format(i="s.i")} AS step
    FROM leaf s JOIN (SELECT DISTINCT tree, level FROM node) l ON l.tree = s.tree AND (1 << l.level) < s.n
    LEFT JOIN node o ON o.tree = s.tree AND o.level = l.level AND o.i = xor(s.i >> l.level, 1)
    UNION ALL
    SELECT s.tree, s.i, 1000 + l.level, {_SQL_STEP.format(i="t.i")}
    FROM leaf s JOIN subroot t ON t.name = s.tree JOIN (SELECT DISTINCT level FROM upper_node) l ON (1 << l.level) < t.n
    LEFT JOIN upper_node o ON o.level = l.level AND o.i = xor(t.i >> l.level, 1)),
path AS (SELECT tree, i, list(step ORDER BY k) AS steps FROM step GROUP BY tree, i),
folded AS (
    SELECT leaf.*, coalesce(steps, []) AS steps,
        list_reduce(coalesce(steps, []), lambda x, s: CASE s[1] WHEN 'L' THEN sha256(s[2:] || x) ELSE sha256(x || s[2:]) END,
            CASE WHEN crc % 7 = 0 THEN changed ELSE h END) AS folded_root
    FROM leaf LEFT JOIN path USING (tree, i))
SELECT doc_id, f.h AS leaf, t.h AS subroot, r.h AS root, sha256(array_to_string(list_transform(steps, lambda s: s[2:]), '')) AS proof_sha256,
    folded_root, folded_root = r.h AS verified
FROM folded f JOIN subroot t ON t.name = f.tree CROSS JOIN root r
"""
