"""Personal data: patterns, and a skip-chain conditional random field that adds to them.

Tokens are the words that hold a digit or an @; all others are known to be outside of entities and
part the chain. Neighbouring tokens share chain potentials; a token also shares skip potentials
with the last one before it in the document that is the same, and with the last that is similar
(same shape and first characters). Loopy belief propagation over both makes labels consistent
within a document. The field learns from the patterns' own matches, by pseudo-likelihood.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import id_column, read, slices, text_column

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # 0: outside
#: The field is fitted on at most so many documents with tokens, those with the smallest hashes.
SAMPLE = 3000
BITS, ROUNDS, SURE = 14, 10, 0.95

# Possessive where the pattern's own greed decides already: long runs cost one pass.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    # A match begins where the run before an @ begins: every start within the run ends alike.
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns' matches, sorted."""
    if not _ANY.search(text):
        return []
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def _shape(word: str) -> str:
    short = re.sub(r"[0-9]", "9", re.sub(r"[^\W\d_]", "a", word[:64]))
    return re.sub(r"a+", "a", short)


def _features(word: str, before: str, after: str) -> list[int]:
    core = word[:64].strip(".,;:!?\"'()[]{}<>")
    digits = _digits(core)
    names = (
        "bias",
        "shape " + _shape(core),
        "coarse " + re.sub(r"9+", "9", _shape(core)),
        f"digits {min(len(digits), 20)}",
        f"first {core[:1] if core[:1] in '+(@' else 'x'} {before[-1:] if before[-1:] in '+:=' else ''}",
        f"at {word.count('@') if len(word) < 64 else 9}",
        f"luhn {14 <= len(digits) <= 19 and len(core) < 24 and luhn(digits)}",
        f"parts {core.count('.')} {all(len(p) < 4 and p.isdigit() and p.isascii() and int(p) < 256 for p in core.split('.'))}",
        "before " + before[-12:].lower() if not _ANY.search(before) else "before " + _shape(before),
        "after " + after[:12].lower() if not _ANY.search(after) else "after " + _shape(after),
    )
    return [zlib.crc32(n.encode("utf-8", "replace")) & ((1 << BITS) - 1) for n in names]


FEATURES = 10


@dataclass
class Graph:
    """Tokens of one or more documents: where they are, their features, and the edges between them."""

    start: np.ndarray
    end: np.ndarray
    features: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def graph_of(text: str) -> Graph | None:
    if not _ANY.search(text):
        return None
    spots, features, chain, skip = [], [], [], []
    last: dict[str, int] = {}
    before, pending = "", None
    active_before = False
    for m in _WORD.finditer(text):
        word = m.group()
        if pending is not None:
            features[pending] = (*features[pending][:2], word)
            pending = None
        active = _ANY.search(word) is not None
        if active:
            k = len(spots)
            spots.append((m.start(), m.end()))
            features.append((word, before, ""))
            pending = k
            if active_before:
                chain.append((k - 1, k))
            for name in ("= " + word.lower(), f"~ {_shape(word)} {word[:4].lower()}"):
                if name in last and last[name] != k - 1:
                    skip.append((last[name], k))
                last[name] = k
        before, active_before = word[-64:], active
    pairs = lambda x: np.array(sorted(set(x)), np.int64).reshape(-1, 2)
    where = np.array(spots, np.int64).reshape(-1, 2)
    rows = np.array([_features(*f) for f in features], np.int64).reshape(-1, FEATURES)
    return Graph(where[:, 0], where[:, 1], rows, pairs(chain), pairs(skip))


def _joined(graphs: list[Graph]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bases = np.cumsum([0] + [len(g.start) for g in graphs])
    features = np.concatenate([g.features for g in graphs])
    edges = [np.concatenate([getattr(g, kind) + b for g, b in zip(graphs, bases)]) for kind in ("chain", "skip")]
    return features, *edges


def silver(graph: Graph, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Each token's label by the pattern match that covers a part of it."""
    out = np.zeros(len(graph.start), np.int64)
    for start, kind, end in reversed(spans):
        a, b = np.searchsorted(graph.end, start, "right"), np.searchsorted(graph.start, end, "left")
        out[a:b] = kind + 1
    return out


def fit(features, chain, skip, labels, rounds: int = 200, ridge: float = 0.05, rate: float = 0.3):
    """Node, chain and skip potentials by pseudo-likelihood: each token given its neighbours' labels."""
    node, links, skips = np.zeros((1 << BITS, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS))
    seen = [np.full_like(x, 1e-8) for x in (node, links, skips)]
    truth = np.eye(LABELS)[labels]
    for _ in range(rounds):
        score = node[features].sum(axis=1)
        for edges, pot in ((chain, links), (skip, skips)):
            np.add.at(score, edges[:, 1], pot[labels[edges[:, 0]]])
            np.add.at(score, edges[:, 0], pot.T[labels[edges[:, 1]]])
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        wrong = p - truth
        slopes = [np.zeros_like(x) for x in (node, links, skips)]
        for column in features.T:
            np.add.at(slopes[0], column, wrong)
        for slope, edges in ((slopes[1], chain), (slopes[2], skip)):
            np.add.at(slope, labels[edges[:, 0]], wrong[edges[:, 1]])
            np.add.at(slope.T, labels[edges[:, 1]], wrong[edges[:, 0]])
        for values, slope, total in zip((node, links, skips), slopes, seen):
            slope = slope + ridge * values
            total += slope**2
            values -= rate * slope / np.sqrt(total)
    return node, links, skips


def marginals(model, features, chain, skip) -> np.ndarray:
    """Label probabilities by loopy belief propagation over chain and skip edges together."""
    node, links, skips = model
    unary = node[features].sum(axis=1)
    ends = np.concatenate([chain, skip])
    pots = np.concatenate([np.broadcast_to(links, (len(chain), LABELS, LABELS)), np.broadcast_to(skips, (len(skip), LABELS, LABELS))])
    source, target = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]])
    pots = np.concatenate([pots, pots.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(ends)) + len(ends), np.arange(len(ends))])
    messages = np.zeros((len(source), LABELS))
    for _ in range(ROUNDS):
        belief = unary.copy()
        np.add.at(belief, target, messages)
        out = np.logaddexp.reduce((belief[source] - messages[back])[:, :, None] + pots, axis=1)
        out -= out.max(axis=1, keepdims=True, initial=-np.inf)
        messages = 0.5 * messages + 0.5 * out
    belief = unary.copy()
    np.add.at(belief, target, messages)
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def added_spans(text: str, graph: Graph, p: np.ndarray, base) -> list[tuple[int, int, int]]:
    """Stretches of neighbouring tokens of one kind that the field is sure of and no match touches."""
    best, sure = p.argmax(axis=1), p.max(axis=1) >= SURE
    chained = set(map(tuple, graph.chain.tolist()))
    out, k = [], 0
    while k < len(best):
        stop = k + 1
        if best[k] and sure[k]:
            while stop < len(best) and best[stop] == best[k] and sure[stop] and (stop - 1, stop) in chained:
                stop += 1
            start, end = int(graph.start[k]), int(graph.end[stop - 1])
            while start < end and text[start] in ".,;:!?\"'()[]{}<>":
                start += 1
            while start < end and text[end - 1] in ".,;:!?\"'()[]{}<>":
                end -= 1
            if start < end and not any(a < end and start < b for a, _, b in base):
                out.append((start, int(best[k]) - 1, end))
        k = stop
    return out


def smallest(rows: DataFrame, most: int) -> DataFrame:
    """The rows with the ``most`` smallest hashes ``h``, rows alike once.

    Counts by the length of the hash (at most 65 rows) bound it first, so that one task orders some
    thousands of hashes, never texts, however many rows there are. An empty table gives none.
    """
    length = F.length(F.bin(F.col("h").bitwiseXOR(F.lit(-(2**63)))))  # rises with the signed hash
    bound, seen = 64, 0
    for r in sorted(rows.groupBy(length.alias("length")).agg(F.approx_count_distinct("h").alias("n")).collect()):
        bound, seen = r.length, seen + r.n
        if seen >= 1.25 * most:  # the counts are within a few per cent
            break
    near = rows.where(length <= bound)
    hashes = near.select("h").distinct().orderBy("h").limit(most)  # at most ``most`` numbers
    return near.join(F.broadcast(hashes), "h", "left_semi").dropDuplicates(["h"])


def train(docs: DataFrame, most: int = SAMPLE):
    """The field's potentials, from at most ``most`` documents that hold tokens; None if there are none."""
    found = docs.select(text_column().alias("text"), id_column().alias("doc")).where(F.col("text").rlike("[0-9@]"))
    chosen = smallest(found.withColumn("h", F.xxhash64("doc", "text")), most).select("text")
    names = ["features", "chain", "skip", "labels"]

    def tokens(batches):
        for batch in slices(batches, "text"):
            for text in batch.column("text").to_pylist():
                graph = graph_of(text)
                parts = (graph.features, graph.chain, graph.skip, silver(graph, base_spans(text)))
                yield pa.RecordBatch.from_arrays([pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in parts], names)

    rows = sorted(chosen.mapInArrow(tokens, "features binary, chain binary, skip binary, labels binary").collect())
    if not rows:
        return None
    shaped = lambda x, width: np.frombuffer(x, "<i4").astype(np.int64).reshape(-1, width)
    nothing = np.zeros(0, np.int64)
    graphs = [Graph(shaped(r.labels, 1)[:, 0], nothing, shaped(r.features, FEATURES), shaped(r.chain, 2), shaped(r.skip, 2)) for r in rows]
    return fit(*_joined(graphs), np.concatenate([g.start for g in graphs]))


def find(docs: DataFrame, model) -> DataFrame:
    """Personal data in every whole text: (row, spans).

    ``row`` is the input row as a struct, so other columns may have any name; ``spans`` are
    (kind, start, end, base) in code points, end exclusive, sorted by start and kind. ``base`` marks
    the patterns' matches, which all stay; the others are the field's. Null and empty texts have no
    spans; rows are treated each for itself; an empty table gives an empty result.
    """
    # Fixed size: node potentials of all features, and the two tables of label pairs.
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def spans(batches):
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            base = [base_spans(t) for t in texts]
            graphs = [graph_of(t) for t in texts]
            known = [g for g in graphs if g is not None]
            if known and shared.value is not None:
                features, chain, skip = _joined(known)
                p = np.split(marginals(shared.value, features, chain, skip), np.cumsum([len(g.start) for g in known])[:-1])
                more = iter(p)
                added = [added_spans(t, g, next(more), b) if g is not None else [] for t, g, b in zip(texts, graphs, base)]
            else:
                added = [[] for _ in texts]
            out = [
                [{"kind": KINDS[k], "start": a, "end": z, "base": own} for a, k, z, own in sorted([(*s, True) for s in b] + [(*s, False) for s in more_])]
                for b, more_ in zip(base, added)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.list_(span))], ["row", "spans"])

    schema = f"row {docs.schema.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"
    return docs.select(F.struct("*").alias("row"), text_column().alias("text")).mapInArrow(spans, schema)


def query(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, train(docs))
    base = F.filter("spans", lambda s: s["base"])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.filter(base, lambda s: s["kind"] == kind)
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("row.doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
