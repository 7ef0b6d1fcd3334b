"""URL filter: rules first, then the ratio of two character language models.

The models are interpolated Markov models of orders 0 to 3 (Witten-Bell: the weight of each order
follows how many different symbols its context was followed by), one of URLs that the rules allow
and one of those they block. A URL's score is the difference of its log likelihoods divided by its
length; the limit is calibrated on labelled URLs that the models have not seen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import bytes_of, read, slices

#: (verdict, host, path): fits the host and its subdomains where the path begins with the rule's.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]

SYMBOLS = b"abcdefghijklmnopqrstuvwxyz0123456789/.-_?=&#%:~+"
ORDER, ALPHABET = 3, len(SYMBOLS) + 2  # one for all other bytes, one for what stands before the URL
START = ALPHABET - 1
_SYMBOL = np.full(256, ALPHABET - 2, np.int64)
_SYMBOL[list(SYMBOLS)] = np.arange(len(SYMBOLS))
_SYMBOL[65:91] = np.arange(26)
#: One labelled URL in so many calibrates; scores are counted in BINS bins between -EDGE and EDGE.
HELD_OUT, BINS, EDGE = 5, 4000, 20.0


def url_parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where there is no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(part(1), upper, upper.lower()), part(2)


def longest_rule(rules, host: F.Column, path: F.Column) -> tuple[F.Column, F.Column]:
    """The text of the longest rule that fits, and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, kind).otherwise(verdict)
    return name, verdict


def grams(urls: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of each character with the ORDER characters before it, and the URLs' lengths."""
    data, bounds = bytes_of(urls.cast(pa.binary()))
    lengths = np.diff(bounds)
    symbols = np.full(len(data) + ORDER * len(lengths), START)
    at = np.arange(len(data)) + ORDER * np.repeat(np.arange(1, len(lengths) + 1), lengths)
    symbols[at] = _SYMBOL[data]
    out = np.zeros(len(data), np.int64)
    for back in range(ORDER, -1, -1):
        out = out * ALPHABET + symbols[at - back]
    return out, lengths


def _log_likelihoods(counts: np.ndarray) -> np.ndarray:
    """log P(character | characters before it), from the counts of the longest grams."""
    shape = (ALPHABET,) * (ORDER + 1)
    by_order = [counts.reshape(shape)]
    for _ in range(ORDER):
        by_order.append(by_order[-1].sum(axis=0))
    p = np.full(ALPHABET, np.float32(1 / ALPHABET))
    for c in reversed(by_order):
        total = c.sum(axis=-1, keepdims=True)
        kinds = np.maximum((c > 0).sum(axis=-1, keepdims=True), 1).astype(np.float32)
        p = (c + kinds * p) / (total + kinds)
    return np.log(p).astype(np.float32).ravel()


def ratio_table(counts: DataFrame) -> np.ndarray:
    """Log likelihood ratio of every gram, from (allowed, gram, n).

    The driver holds ALPHABET ** (ORDER + 1) numbers (25 MB), however large the corpus is.
    """
    cells = ALPHABET ** (ORDER + 1)
    out = np.zeros(cells, np.float32)
    for allowed, sign in ((True, 1), (False, -1)):
        got = counts.where(F.col("allowed") == allowed).select("gram", "n").toPandas()
        table = np.zeros(cells, np.float32)
        table[got.gram.to_numpy(np.int64)] = got.n
        out += sign * _log_likelihoods(table)
    return out


def _scored(table: np.ndarray, urls: pa.Array) -> np.ndarray:
    found, lengths = grams(urls)
    sums = np.bincount(np.repeat(np.arange(len(lengths)), lengths), table[found], len(lengths))
    return sums / np.maximum(lengths, 1)


def calibrated(histogram) -> float:
    """The limit with the least mean of both classes' errors on held-out URLs, (allowed, bin, n)."""
    counts = np.zeros((2, BINS))
    for row in histogram:
        counts[int(row.allowed), row.bin] += row.n
    if not counts.sum(axis=1).all():
        return 0.0
    share = counts / counts.sum(axis=1, keepdims=True)
    wrong = np.append(0, np.cumsum(share[1])) + 1 - np.append(0, np.cumsum(share[0]))
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return float(best[len(best) // 2] / BINS * 2 * EDGE - EDGE)


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """Judges every URL: (row, host, path, rule, score, verdict).

    ``row`` is the input row (with column url) as a struct, so other columns may have any name. The
    longest rule that fits decides; URLs without one are allowed if their score reaches the limit.
    Counts are taken over all URLs that a rule fits, but for one in HELD_OUT by hash, which
    calibrate. Null urls count as empty, with score 0; repeated rows count as often as they stand
    there. Without labelled URLs of both kinds there is nothing to compare: all others are allowed.
    An empty table gives an empty result.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col("url"))
    judged = pages.select(F.struct("*").alias("row"), F.coalesce("url", F.lit("")).alias("text"), host.alias("host"), path.alias("path"))
    rule, by_rule = longest_rule(rules, F.col("host"), F.col("path"))
    judged = judged.withColumn("rule", rule).withColumn("by_rule", by_rule)
    labelled = judged.where("by_rule is not null").select((F.col("by_rule") == "allow").alias("allowed"), "text", (F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0).alias("held"))

    def count(batches):
        for batch in slices(batches, "text", 1 << 20):
            found, lengths = grams(batch.column("text"))
            allowed = np.repeat(batch.column("allowed").to_numpy(zero_copy_only=False), lengths)
            for kind in (True, False):
                gram, n = np.unique(found[allowed == kind], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), kind)), pa.array(gram), pa.array(n)], ["allowed", "gram", "n"])

    counts = labelled.where("not held").mapInArrow(count, "allowed boolean, gram long, n long")
    table = spark.sparkContext.broadcast(ratio_table(counts.groupBy("allowed", "gram").agg(F.sum("n").alias("n"))))

    def score(batches):
        for batch in slices(batches, "text", 1 << 20):
            scores = pa.array(_scored(table.value, batch.column("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, "score"])

    held = labelled.where("held").mapInArrow(score, "allowed boolean, text string, held boolean, score double")
    place = F.floor((F.col("score") + EDGE) / (2 * EDGE) * BINS).cast("int")
    place = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), place)).alias("bin")
    both = [r.allowed for r in labelled.groupBy("allowed").count().collect()]
    limit = calibrated(held.groupBy("allowed", place).agg(F.count(F.lit(1)).alias("n")).collect()) if len(both) == 2 else float("-inf")
    schema = f"row {pages.schema.simpleString()}, text string, host string, path string, rule string, by_rule string, score double"
    scored = judged.mapInArrow(score, schema)
    verdict = F.coalesce("by_rule", F.when(F.col("score") >= limit, "allow").otherwise("block"))
    return scored.select("row", "host", "path", "rule", "score", verdict.alias("verdict"))


def query(spark, sf_dir):
    judged = filter_urls(read(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("row.page_id", "host", "path", "rule", "verdict")
