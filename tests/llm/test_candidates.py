"""Candidates of the n-gram Jaccard join are given once and a few at a time."""

import random

from sheaf.llm import jaccard


def test_candidates_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"word{k}" for k in range(200)]
    texts = []
    for k in range(40):
        words = list(base)
        words[rng.randrange(200)] = f"other{k}"
        texts.append(" ".join(words))
    texts.append(" ".join(f"lone{k}" for k in range(50)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = spark.sparkContext.accumulator(0)
    candidates = jaccard._candidates

    def counted(*args):
        inner = candidates(*args)

        def run(table):
            out = inner(table)
            made.add(out.num_rows)
            return out

        return run

    monkeypatch.setattr(jaccard, "_candidates", counted)
    monkeypatch.setattr(jaccard, "BUCKET_ROWS", 1)
    monkeypatch.setattr(jaccard, "_stars", lambda named, round_: named.where("false").selectExpr("key as a", "key as b"))
    for wide in (64, 4):
        monkeypatch.setattr(jaccard, "WIDE", wide)
        made.value = 0
        got = {r.doc: r.component_id for r in jaccard.similar_groups(docs).collect()}
        assert got == {**dict.fromkeys(range(40), 0), 40: 40}
        assert 0 < made.value < 40 * 39 // 2
