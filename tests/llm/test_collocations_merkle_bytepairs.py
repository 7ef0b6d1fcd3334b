"""Collocations and the manifest against SQL and definitions, byte-level BPE against its library."""

import base64
import codecs
import hashlib
import random

import duckdb
import pandas as pd
import pytest

from sheaf.llm import bytepairs, collocations, merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, first string, tree string, rank int, ids string, index long"
LONG = "ab cd ef. " * 3000 + "x" * 20_000 + " ç日本 " * 500
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "", 0),
    (3, LONG, "en", "s", 9_223_372_036_854_775_807),
    (3, LONG, "en", "s", 9_223_372_036_854_775_807),
    (3, "of the\tof the, of the of the.of the\x0bof the", None, "ü", -1),
    (None, " \t ,;: ", "und", "s", 3),
    (5, "Of THE big big big big big big big big big big big big big big", "de", None, 4),
    (7, "New York City. " * 12 + "new york " * 3, "de", None, 4),
    (8, "One Word", "日本", "s", 1),
    (9, "of the " * 40, "en", "s", 1),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", 2, "z", 3) for r in rows], SCHEMA)


def by_sql(rows, sql):
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"])
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    connection.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [tuple(r) for r in rows] or [(None,) * 5])
    if not rows:
        connection.execute("DELETE FROM documents")
    del frame
    out = connection.execute(sql)
    return [c[0] for c in out.description], sorted(out.fetchall(), key=repr)


def rows_of(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_collocations_of_awkward_rows(spark):
    columns, expected = by_sql(ROWS, collocations.SQL)
    assert len(expected) > 5
    assert rows_of(collocations.collocations(table(spark, ROWS)), columns) == expected
    assert collocations.collocations(table(spark, [])).collect() == []


def test_collocations_with_small_slices_and_hot_nodes(spark, monkeypatch):
    """All constants that only say how work is cut, set so that everything is cut."""
    rng = random.Random(5)
    words = ["a", "b", "c", "dé", "e" * 30]
    rows = [(k, "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ". "]) for _ in range(300)), rng.choice(["x", "y", None]), "s", 1) for k in range(60)]
    rows.append((60, "long one " * 5000 + "a b c" * 9000, "x", "s", 1))
    columns, expected = by_sql(rows, collocations.SQL)
    for name, value in (("SLICE", 3000), ("WORDS", 700), ("SHARE_BITS", 4), ("HOT_SHARE", 1 << 20), ("RANKED", 3)):
        monkeypatch.setattr(collocations, name, value)
    assert rows_of(collocations.collocations(table(spark, rows)), columns) == expected


def test_paths_of_a_passage_are_compacted(spark):
    passage = " ".join(f"w{k}" for k in range(200))
    rows = [(k, f"{passage} end{k}", "en", "s", 1) for k in range(12)]
    g = collocations.graph(table(spark, rows))
    edges, nodes = collocations.compacted(g.nodes.where("flow >= 10 and second <> 0"))
    assert edges.count() == 198
    assert [(r.n, r["count"]) for r in edges.groupBy("path", "n").count().collect()] == [(12, 198)]
    assert sorted(r.to_end for r in edges.collect()) == list(range(198))
    assert nodes.where("inner").count() == 197
    # Each occurrence is one edge out of one node: flows add up to all words.
    assert g.nodes.selectExpr("sum(flow)").first()[0] == 12 * 201


def test_manifest_of_awkward_rows(spark, monkeypatch):
    rows = ROWS + [(100 + k, f"text {k}", "fr", "s", k) for k in range(77)]
    columns, expected = by_sql(rows, merkle.SQL)
    assert 0 < sum(r[columns.index("verified")] for r in expected) < len(expected)
    for height in (12, 2):
        monkeypatch.setattr(merkle, "HEIGHT", height)
        assert rows_of(merkle.verify_all(table(spark, rows)), columns) == expected
    assert merkle.verify_all(table(spark, [])).collect() == []
    columns, expected = by_sql(rows[1:2], merkle.SQL)
    assert rows_of(merkle.verify_all(table(spark, rows[1:2])), columns) == expected


def test_places_are_those_of_a_log_that_is_appended_to():
    """The closed form against builders that write every node when it is complete."""
    for leaves in (1, 2, 3, 5, 8, 13, 64, 100):
        written, height = [], merkle.height_of(leaves)

        def complete(level, index):
            if level:
                for child in (2 * index, 2 * index + 1):
                    if child << (level - 1) < leaves:
                        complete(level - 1, child)
            written.append((level, index))

        complete(height, 0)
        assert [merkle.place_of(*node, leaves) for node in written] == list(range(len(written)))


def test_proofs_by_place_fold_to_the_root(spark, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 3)
    rows = [(k, f"text {k}", "en", "s", k) for k in range(45)]
    m = merkle.manifest(table(spark, rows))
    log = m.log.nodes()
    size = sum(-(-45 >> k) for k in range(merkle.height_of(45) + 1))
    assert sorted(r.place for r in log.collect()) == list(range(size))
    root = m.log.roots.first().digest
    digests = {r["index"]: r.digest for r in m.leaves.collect()}
    found = {}
    for r in merkle.proofs(m.log, m.leaves.where("index in (0, 17, 44)")).collect():
        found.setdefault(r["index"], {})[r.level] = r.side + r.digest
    for index in (0, 17, 44):
        path = [found[index].get(level, "U") for level in range(merkle.height_of(45))]
        assert merkle.folded(digests[index], path) == root
        assert merkle.folded(merkle.hashed("other"), path) != root


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ALPHABETS = ["ab", "aab ", "abcdefghijklmnopqrstuvwxyz", "etaoin '", "é日本語a ", "\U0001f600‍❤️ a", "0123456789", "ꟑ՘\U00016ea0a1 ", " \n\t　a"]


def random_texts(seed=3):
    rng = random.Random(seed)
    for k in range(600):
        letters = rng.choice(ALPHABETS)
        yield "".join(rng.choice(letters) for _ in range(rng.choice([1, 3, 10, 60, 9000 if k % 100 == 0 else 5])))
    for _ in range(100):
        yield "".join(chr(rng.choice([rng.randrange(0x250), rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(60))


def test_tokens_are_those_of_the_library(spark, library, monkeypatch):
    monkeypatch.setattr(bytepairs, "CHUNK", 500)
    monkeypatch.setattr(bytepairs, "MOST_STATES", 2000)
    coder = bytepairs.Coder()
    for text in random_texts():
        ids = [int(k) for part in coder.encode(text) for k in memoryview(part).cast("i")]
        assert ids == library.encode_ordinary(text), text
        decoder = coder.decoder()
        assert b"".join([*(decoder([k]) for k in ids), decoder([], last=True)]) == text.encode()


def test_state_machine_of_utf8_as_in_the_standard_library():
    rng = random.Random(4)
    for _ in range(3000):
        data = bytes(rng.choice([rng.randrange(256), 0xE0, 0x80, 0xF4, 0xED, 0xC3]) for _ in range(rng.randrange(1, 12)))
        pending, out, own = b"", b"", codecs.getincrementaldecoder("utf-8")("replace")
        for k, byte in enumerate(data):
            pending, whole = bytepairs.utf8_step(pending, byte)
            out += whole
            assert out.decode() == bytes(data[: k + 1]).decode("utf-8", "replace")[: len(out.decode())]
        assert (out + (b"\xef\xbf\xbd" if pending else b"")).decode() == own.decode(data, True)


def test_byte_pairs_of_awkward_rows(spark, library):
    docs = table(spark, ROWS)
    expected = []
    for row in ROWS:
        ids = library.encode_ordinary(row[1] or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        expected.append((row[0], len(ids), digest, hashlib.sha256((row[1] or "").encode()).hexdigest()))
    assert rows_of(bytepairs.round_trip(docs), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]) == sorted(expected, key=repr)
    encoded = bytepairs.encode(docs)
    assert rows_of(encoded, ["doc_id", "ids"]) == sorted(((r[0], library.encode_ordinary(r[1] or "")) for r in ROWS), key=repr)
    decoded = bytepairs.decode(encoded, most=7)
    assert rows_of(decoded, ["doc_id", "text"]) == sorted(((r[0], r[1] or "") for r in ROWS), key=repr)
    assert bytepairs.round_trip(table(spark, [])).collect() == []
    broken = spark.createDataFrame([(1, [231]), (2, None)], "doc_id long, ids array<int>")
    assert sorted(tuple(r) for r in bytepairs.decode(broken).collect())[1] == (2, "")


def test_query_on_given_documents(spark, sf_dir, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in bytepairs.query(spark, sf_dir).collect()}
    for doc_id, text in duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall():
        ids = library.encode_ordinary(text or "")
        assert got[doc_id] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
