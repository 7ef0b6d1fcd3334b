"""Toxicity grades by cumulative-link (proportional odds) regression on sparse word features.

P(grade <= k) = sigmoid(threshold_k - weights . features): one weight vector for all thresholds,
which are kept in order. The features of a text are log(1 + count) of its words, hashed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import LETTERS, bytes_of, id_column, read, slices, text_column, word_hashes

BITS = 20
#: The classifier is fitted on at most so many labelled documents, those with the smallest id hash.
SAMPLE = 6000
#: A word has a weight if it is in so many documents of the sample, whatever share of a class they
#: are, and tells the classes apart by so many standard errors; words by chance do neither.
LEAST_DOCS, LEAST_Z = 3, 3.5
#: A word marks toxicity if labelled toxic documents hold it so many times as often as the others;
#: a toxic document with so many different such words has grade 2, with fewer grade 1.
LIFT, SEVERE = 8.0, 5


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, count) of each different word of each text."""
    data, bounds = bytes_of(texts.cast(pa.binary()))
    words, n = word_hashes(data, bounds, LETTERS)
    rows = np.repeat(np.arange(len(n), dtype=np.int64), n)
    pairs, counts = np.unique(rows << BITS | (words >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    return pairs >> BITS, pairs & ((1 << BITS) - 1), counts


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray


def grades(weights, thresholds, rows, feature, counts, n) -> np.ndarray:
    """P(grade > k) for each text (row) and threshold (column)."""
    score = np.bincount(rows, weights[feature] * np.log1p(counts), n)
    return np.where(np.isinf(thresholds), 0.0, 1 / (1 + np.exp(np.clip(thresholds - score[:, None], -500, 500))))


def telling(toxic, rows, feature) -> tuple[np.ndarray, np.ndarray]:
    """Which features tell the classes apart, and how many times as frequent toxic texts hold each.

    The standard errors are the root of the likelihood ratio, which also holds for a word that one
    class never has; those of the log ratio ask for about ten documents there.
    """
    size = 1 << BITS
    bad, good = np.bincount(feature, toxic[rows], size), np.bincount(feature, 1 - toxic[rows], size)
    n_bad, n_good = toxic.sum(), len(toxic) - toxic.sum()
    lift = (bad + 0.5) / (n_bad + 1) / ((good + 0.5) / (n_good + 1))
    held = bad + good
    expected = held * n_bad / max(len(toxic), 1)
    cells = ((bad, expected), (good, held - expected), (n_bad - bad, n_bad - expected), (n_good - good, n_good - held + expected))
    ratio = 2 * sum(n * np.log(np.maximum(n, 1) / np.where(n > 0, e, 1)) for n, e in cells)
    return (held >= LEAST_DOCS) & (np.sqrt(np.maximum(ratio, 0)) >= LEAST_Z), lift


def severity_grades(toxic, rows, feature) -> np.ndarray:
    """Grades 0 to 2 from 0/1 labels: how many words that mark toxicity a toxic text holds."""
    told, lift = telling(toxic, rows, feature)
    marks = told & (lift >= LIFT)
    held = np.bincount(rows, marks[feature], len(toxic))
    return np.where(toxic == 0, 0, np.where(held >= SEVERE, 2, 1))


def fit(grade, rows, feature, counts, levels: int = 3, rounds: int = 500, ridge: float = 0.05, rate: float = 0.3) -> Model:
    """Maximum likelihood with a ridge penalty by full-batch Adagrad."""
    n, size = len(grade), 1 << BITS
    keep = telling((grade > 0).astype(np.int64), rows, feature)[0][feature]
    names, column = np.unique(feature[keep], return_inverse=True)
    row, value = rows[keep], np.log1p(counts[keep])
    share = (np.bincount(grade, minlength=levels) + 0.5) / (n + 0.5 * levels)
    below = np.cumsum(share)[:-1]
    base, weights = np.log(below / (1 - below)), np.zeros(len(names))
    # Thresholds are the first one and the logarithms of the steps, so they stay in order.
    free = np.concatenate([base[:1], np.log(np.maximum(np.diff(base), 1e-3))])
    seen = [np.full_like(weights, 1e-8), np.full_like(free, 1e-8)]
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    for _ in range(rounds):
        steps = np.exp(free[1:])
        cuts = np.concatenate([[-np.inf], free[0] + np.concatenate([[0], np.cumsum(steps)]), [np.inf]])
        score = np.bincount(row, weights[column] * value, n)
        upper, lower = sigmoid(cuts[grade + 1] - score), sigmoid(cuts[grade] - score)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        slope = np.bincount(column, ((du - dl)[row]) * value, len(weights)) + ridge * weights
        by_cut = np.bincount(grade, -du, levels)[:-1] + np.bincount(grade, dl, levels)[1:]
        after = np.cumsum(by_cut[::-1])[::-1]
        steep = np.concatenate([after[:1], after[1:] * steps])
        for values, gradient, total in ((weights, slope, seen[0]), (free, steep, seen[1])):
            total += gradient**2
            values -= rate * gradient / np.sqrt(total)
    full = np.zeros(size)
    full[names] = weights
    return Model(full, free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1:]))]))


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE):
    """(toxic, rows, feature, count) of at most ``most`` labelled documents."""
    # A document labelled more than once is toxic if one of its labels says so.
    known = labels.where("doc_id is not null and toxic is not null").groupBy(id_column().alias("doc")).agg(F.max("toxic").alias("toxic"))
    few = known.orderBy(F.xxhash64("doc"), "doc").limit(most)
    chosen = docs.select(id_column().alias("doc"), text_column().alias("text")).join(F.broadcast(few), "doc")

    def counted(batches):
        for batch in slices(batches, "text"):
            rows, feature, counts = features(batch.column("text"))
            at = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            toxic = batch.column("toxic").to_pylist()
            yield pa.RecordBatch.from_pylist(
                [{"doc": d, "toxic": int(t > 0), "feature": feature[a:b].astype("<i4").tobytes(), "n": counts[a:b].astype("<i4").tobytes()}
                 for d, t, a, b in zip(batch.column("doc").to_pylist(), toxic, at, at[1:])],
                pa.schema([("doc", pa.int64()), ("toxic", pa.int32()), ("feature", pa.binary()), ("n", pa.binary())]),
            )

    table = chosen.mapInArrow(counted, "doc long, toxic int, feature binary, n binary")
    # Sorted, so that every run fits the same model; repeated ids may exceed the bound, so cut again.
    got = sorted(table.limit(2 * most).collect(), key=lambda r: (r.doc, r.toxic, r.feature, r.n))[:most]
    rows = np.repeat(np.arange(len(got)), [len(r.feature) // 4 for r in got]) if got else np.zeros(0, np.int64)
    feature = np.frombuffer(b"".join(r.feature for r in got), "<i4")
    counts = np.frombuffer(b"".join(r.n for r in got), "<i4")
    return np.array([r.toxic for r in got], np.int64), rows, feature, counts


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    toxic, rows, feature, counts = sample(docs, labels, most)
    if not toxic.any() or toxic.all():  # nothing to tell apart: no document is rejected
        return Model(np.zeros(1 << BITS), np.full(2, np.inf))
    return fit(severity_grades(toxic, rows, feature), rows, feature, counts)


def rate(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """Severity of every whole text: (row, severity, grade, p_toxic, toxic).

    ``row`` is the input row as a struct, so other columns may have any name. ``severity`` is the
    expected grade, ``grade`` the most probable one, ``toxic`` says that P(grade > 0) reaches
    ``limit``. Null and empty texts have no features and get the base rate; rows are rated each for
    itself, so repeated rows get the same rating; an empty table gives an empty result. With no
    labels, or labels of one class only, severity is 0 and nothing is toxic.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    def rated(batches):
        for batch in slices(batches, "text"):
            above = grades(*shared.value, *features(batch.column("text")), batch.num_rows)
            p = np.concatenate([1 - above[:, :1], above[:, :-1] - above[:, 1:], above[:, -1:]], axis=1)
            grade, first = p.argmax(axis=1), above[:, 0]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(above.sum(axis=1)), pa.array(grade.astype(np.int32)), pa.array(first), pa.array(first >= limit)],
                ["row", "severity", "grade", "p_toxic", "toxic"],
            )

    out = f"row {docs.schema.simpleString()}, severity double, grade int, p_toxic double, toxic boolean"
    return docs.select(F.struct("*").alias("row"), text_column().alias("text")).mapInArrow(rated, out)


def query(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rated = rate(docs, train(docs, read(spark, sf_dir, "labels")))
    return rated.select(F.col("row.doc_id").alias("doc_id"), "severity", "grade", "p_toxic", "toxic")
