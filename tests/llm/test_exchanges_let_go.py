"""The n-grams' first exchange is let go of before they are exchanged again."""

from sheaf.llm import jaccard


def test_segments_exchange_is_let_go_before_the_overlaps(spark, monkeypatch):
    calls = []
    write, free = jaccard.written, jaccard.release
    monkeypatch.setattr(jaccard, "written", lambda df, name: calls.append(name) or write(df, name))
    monkeypatch.setattr(jaccard, "release", lambda s: calls.append("release") or free(s))
    texts = jaccard.texts_with_keys(spark.createDataFrame([(1, "a b c d e"), (2, "a b c d f")], "doc_id long, text string"))
    a, b = sorted(r.key for r in texts.collect())
    got = jaccard.overlaps(texts, spark.createDataFrame([(a, b)], "a long, b long"), 4).collect()
    assert [(r.a, r.b, r.common) for r in got] == [(a, b, 1)]
    assert calls == ["segments", "release", "overlaps", "release"]
