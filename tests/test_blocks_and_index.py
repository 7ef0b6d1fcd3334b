"""Files in blocks: JSON and content plugins without joining them, and the index of the document."""

import base64
import hashlib
import json
import os
import random

import pytest

from sheaf.operators.json_blocks import json_blocks
from sheaf.plans.assemble import Options, assemble_tree
from sheaf.plans.plugins import ContentPlugin, LineNumbers, run_content_plugins
from sheaf.sources.index import document_index, file_ranges, part_index, read_files, verify_document

BLOCKS = "path string, size long, block_no int, blocks int, status string, code string, input_bytes long, body binary, body_bytes long"


def cut(path, data, borders):
    ends = [0, *sorted(borders), len(data)]
    parts = [data[a:b] for a, b in zip(ends, ends[1:])]
    rows = [(path, len(data), k, len(parts), "ok", None, len(p), p, len(p)) for k, p in enumerate(parts)]
    return rows


def expected_json(path, data):
    try:
        return {"path": path, "size": len(data), "content": data.decode()}
    except UnicodeDecodeError:
        return {"path": path, "size": len(data), "content": base64.b64encode(data).decode(), "encoding": "base64"}


TEXTS = [
    "aé€😀b\"\\\n\t\x01/z".encode(),
    "😀😀😀😀€€€€ééééaaaa".encode() * 3,
    b"",
    b"plain",
    "é".encode()[:1],  # half a character
    "é".encode()[1:] + b"abcdefghijkl",  # begins inside one
    b"abcdefghijkl" + "😀".encode()[:3],
    b"abcdefgh\x80\x80\x80\x80ijklmnop",
    b"\xff\xfe" * 20,
    b"abc\xed\xa0\x80defghijklm",  # a surrogate
    "é€".encode() + b"\xc3" + "😀".encode() * 5,
]


def test_json_of_blocks_cut_at_every_border(spark):
    rows, want = [], {}
    for t, data in enumerate(TEXTS):
        for n in range(len(data) + 1):
            path = f"t{t}/one/{n}"
            rows += cut(path, data, [n])
            want[path] = expected_json(path, data)
        rows += cut(f"t{t}/bytes", data, range(len(data)))
        want[f"t{t}/bytes"] = expected_json(f"t{t}/bytes", data)
    dice = random.Random(3)
    alphabet = ["a", "é", "€", "😀", '"', "\n"]
    for k in range(60):
        data = "".join(dice.choice(alphabet) for _ in range(30)).encode()
        if k % 3 == 0:
            at = dice.randrange(len(data))
            data = data[:at] + bytes([dice.randrange(256)]) + data[at + 1 :]
        # Repeated borders make empty blocks.
        rows += cut(f"r{k}", data, [dice.randrange(len(data)) for _ in range(dice.randrange(12))])
        want[f"r{k}"] = expected_json(f"r{k}", data)
    got = {}
    for r in sorted(json_blocks(spark.createDataFrame(rows, BLOCKS)).collect(), key=lambda r: (r.path, r.block_no)):
        got[r.path] = got.get(r.path, "") + r.json
    assert {p: json.loads(j) for p, j in got.items()} == want


def test_json_of_a_file_without_bytes_read(spark):
    rows = [("lost", 9, 0, 4, "unreadable", "unreadable", 0, None, 0)]
    (row,) = json_blocks(spark.createDataFrame(rows, BLOCKS)).collect()
    assert json.loads(row.json) == {"path": "lost", "size": 9, "content": ""}


def totals():
    class Totals(ContentPlugin):
        """Cuts bytes out, remembers over chunks, and says so at the end."""

        def start(self, path):
            return [path, 0, 0]

        def chunk(self, state, data):
            state[1] += 1
            state[2] += len(data)
            return None if state[1] % 3 else bytes(data).replace(b"\n", b"")

        def end(self, state):
            return f"<{state[0]} {state[1]} {state[2]}>".encode()

    return Totals()


def sequential(path, data, plugins):
    """One file led through the plugins, one after the other, as a whole."""
    step = len(data) if 0 < len(data) < 4096 else 4096 if len(data) < 16384 else 16384
    for plugin in plugins:
        state = plugin.start(path)
        out = b""
        for k in range(0, len(data), step):
            made = plugin.chunk(state, data[k : k + step])
            out += data[k : k + step] if made is None else made
        data = out + (plugin.end(state) or b"")
    return data


@pytest.mark.parametrize("size", [0, 10, 5000, 65536, 1 << 20])
def test_content_plugins_stream_over_blocks(spark, size):
    dice = random.Random(size)
    data = bytes(dice.choice(b"abc \n") for _ in range(size))
    plugins, block = [LineNumbers(), totals(), LineNumbers()], 64 << 10
    rows = cut("big", data, range(block, size, block)) + cut("other", data[:7000], [4096] if size > 4096 else [])
    made = run_content_plugins(spark.createDataFrame(rows, BLOCKS), plugins, block_bytes=block).collect()
    assert all(len(r.body) <= block and r.body_bytes == len(r.body) for r in made)
    for path, whole in (("big", data), ("other", data[:7000])):
        mine = sorted((r for r in made if r.path == path), key=lambda r: r.block_no)
        assert [r.block_no for r in mine] == list(range(len(mine)))
        # Just the last block closes the file.
        assert [r.block_no == r.blocks - 1 for r in mine] == [False] * (len(mine) - 1) + [True]
        assert sum(r.input_bytes for r in mine) == len(whole)
        want = sequential(path, whole, plugins) if len(whole) == rows_size(rows, path) else None
        assert b"".join(r.body for r in mine) == want


def rows_size(rows, path):
    return next(r[1] for r in rows if r[0] == path)


def test_content_plugins_on_whole_rows_keep_all_columns(spark):
    texts = {"a": b"x\ny" * 3000, "b": b"", "c": None}
    rows = [(p, len(t or b""), t, len(t or b""), k) for k, (p, t) in enumerate(texts.items())]
    frame = spark.createDataFrame(rows, "path string, size long, body binary, body_bytes long, part int")
    got = {r.path: r for r in run_content_plugins(frame, [LineNumbers(), totals()]).collect()}
    assert got["c"].body is None and [got[p].part for p in "abc"] == [0, 1, 2]
    for p in "ab":
        assert got[p].body == sequential(p, texts[p], [LineNumbers(), totals()])
        assert got[p].body_bytes == len(got[p].body)
    assert run_content_plugins(frame.limit(0), [LineNumbers()]).collect() == []


def grow(folder):
    dice = random.Random(5)
    (folder / "sub" / "deep").mkdir(parents=True)
    files = {
        "a.txt": b"first\n",
        "sub/large.txt": bytes(dice.choice(b"abcdefgh \n") for _ in range(300_000)),
        "sub/deep/é.txt": "é€😀".encode() * 9000,
        "sub/empty": b"",
        "z.bin": bytes(dice.randrange(1, 256) for _ in range(100_000)),
    }
    for name, data in files.items():
        (folder / name).write_bytes(data)
    return files


def document_at(path):
    return b"".join((path / n).read_bytes() for n in sorted(os.listdir(path)) if n.startswith("part-"))


def test_json_document_of_a_tree_in_blocks(spark, tmp_path):
    tree, out = tmp_path / "tree", tmp_path / "out"
    tree.mkdir()
    files = grow(tree)
    options = Options(format="json", binary="include", block_bytes=64 << 10)
    run = assemble_tree(spark, str(tree), options)
    assert run.fragments.where("section = 3").count() > len(files)  # several blocks a file
    run.write(f"file:{out}")
    got = json.loads(document_at(out))
    assert got == {"files": [expected_json(n, files[n]) for n in sorted(files, key=lambda n: n.split("/"))]}


def test_index_finds_every_file_in_the_written_parts(spark, tmp_path):
    tree, out = tmp_path / "tree", tmp_path / "out"
    tree.mkdir()
    files = grow(tree)
    run = assemble_tree(spark, str(tree), Options(binary="include", block_bytes=64 << 10))
    run.write(f"file:{out}")
    whole = document_at(out)
    index = document_index(run.fragments)
    for r in index.collect():
        assert hashlib.md5(whole[r.offset : r.offset + r.bytes]).hexdigest() == r.md5
    for r in file_ranges(index).collect():
        text = b"// File: " + r.path.encode() + b"\n" + files[r.path] + b"\n\n"
        assert whole[r.offset : r.offset + r.bytes] == text
    parts = part_index(spark, f"file:{out}").collect()
    assert len(parts) > 1 and sum(p.length for p in parts) == len(whole)
    wanted = spark.createDataFrame([("sub/large.txt",), ("not/there",)], "path string")
    rows = sorted(read_files(index, f"file:{out}", wanted).collect(), key=lambda r: r.block_no)
    assert b"".join(r.text for r in rows) == b"// File: sub/large.txt\n" + files["sub/large.txt"] + b"\n\n"
    assert verify_document(index, f"file:{out}").collect() == []


def test_a_damaged_part_is_found(spark, tmp_path):
    tree, out = tmp_path / "tree", tmp_path / "out"
    tree.mkdir()
    grow(tree)
    run = assemble_tree(spark, str(tree), Options(binary="include", block_bytes=64 << 10))
    run.write(f"file:{out}")
    index = document_index(run.fragments)
    name = sorted(n for n in os.listdir(out) if n.startswith("part-"))[-1]
    data = bytearray((out / name).read_bytes())
    data[0] ^= 1
    (out / name).write_bytes(data)
    (bad,) = verify_document(index, f"file:{out}").collect()
    assert (bad.part, bad.code) == (name, "different")
    (out / name).write_bytes(data[:-1])
    codes = [r.code for r in verify_document(index, f"file:{out}").collect()]
    assert codes and set(codes) == {"different"}
