"""The corpus pipeline stage by stage, each against its definition on what the one before kept."""

from collections import Counter
from itertools import combinations

import duckdb

import corpus_pipeline
from sheaf.llm.common import read
from sheaf.session import written

SPACE = " \t\n\x0b\x0c\r"
LOWER = {k: k + 32 for k in range(65, 91)}


def without_repeated_lines(texts):
    """{doc_id: text} without lines that five documents share, but in the one with the largest id."""
    key = lambda line: line.strip(SPACE).translate(LOWER)
    homes = {}
    for doc, text in texts.items():
        for line in set(map(key, text.split("\n"))):
            if len(line) >= 40:
                homes.setdefault(line, []).append(doc)
    gone = {line: max(docs) for line, docs in homes.items() if len(docs) >= 5}
    return {doc: "\n".join(line for line in text.split("\n") if gone.get(key(line), doc) == doc) for doc, text in texts.items()}


def least_of_groups(texts, n=5, percent=80):
    sets = {}
    for doc, text in texts.items():
        for c in SPACE:
            text = text.replace(c, " ")
        words = text.translate(LOWER).split(" ")
        words = [w for w in words if w]
        sets[doc] = {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()
    root = {doc: doc for doc in texts}

    def find(doc):
        while root[doc] != doc:
            doc = root[doc]
        return doc

    for a, b in combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y), 1) and x and y:
            common = len(x & y)
            if 100 * common >= percent * (len(x) + len(y) - common):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {doc for doc in texts if find(doc) == doc}


def test_every_stage_does_its_whole_job(spark, sf_dir):
    now = read(spark, sf_dir, "documents")
    columns, kept = now.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, written(stage(spark, now, sf_dir), "stage")
        kept[name] = now
        if name != "packing":
            assert now.columns == columns
        rows = {r.doc_id: r.text for r in before.select("doc_id", "text").collect()}
        if name == "toxicity":
            clean = {r[0] for r in duckdb.sql(f"SELECT doc_id FROM '{sf_dir}/labels.parquet' WHERE toxic = 0").fetchall()}
            ids = {r.doc_id for r in now.collect()}
            assert ids <= set(rows) and len(ids & clean) >= 0.99 * len(clean)
        if name == "line dedup":
            assert {r.doc_id: r.text for r in now.collect()} == without_repeated_lines(rows)
        if name == "n-gram Jaccard join":
            assert sorted(r.doc_id for r in now.collect()) == sorted(least_of_groups(rows))
        if name.startswith("mixing"):
            copies = Counter(r.doc_id for r in now.collect())
            assert set(copies) <= set(rows) and max(copies.values()) <= 3
            assert all(r.text == rows[r.doc_id] for r in now.collect())
    pieces = now.collect()
    sequences = {}
    for r in pieces:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    mixed = kept["mixing sources to target weights"].collect()
    tokens = {r.doc_id: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in mixed}
    assert sum(r.length for r in pieces) == sum(tokens[r.doc_id] for r in mixed)
    assert all(r.doc_tokens == tokens[r.doc_id] for r in pieces)
