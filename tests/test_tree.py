"""Directory trees: listing, contents, whole documents, sinks."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sheaf.functions.content import ContentRule
from sheaf.functions.paths import MODE_DIRECTORY, MODE_REGULAR, MODE_SYMLINK, mode_bits, mode_is
from sheaf.operators import render, stats
from sheaf.plans.assemble import Options, assemble_tree
from sheaf.plans.plugins import register_filter
from sheaf.sources import document, filetree

HEAD = "Directory Structure:\n==================\n\n"
MIDDLE = "\nFile Contents:\n=============\n\n"


def make(root, files):
    for name, data in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(root)


def text_of(spark, run, path) -> bytes:
    document.write_document(run.fragments, str(path), run.entries)
    parts = sorted(p for p in os.listdir(path) if p.startswith("part-"))
    return b"".join(open(f"{path}/{p}", "rb").read() for p in parts)


def paths(entries):
    return sorted(r.path for r in entries.select("path").collect())


def walk(root):
    """What a sequential walk lists, as an independent check."""
    found = []
    for base, dirs, files in os.walk(root):
        found += [os.path.relpath(os.path.join(base, n), root) for n in dirs + files]
    return sorted(found)


@pytest.mark.parametrize("budget", [1, 3, 20_000])
def test_listing_finds_everything_for_any_task_budget(spark, tmp_path, budget):
    root = make(
        tmp_path / "t",
        {f"d{n % 3}/e{n % 2}/f{n}.txt": "x" * n for n in range(20)}
        | {"_underscore.txt": "u", ".hidden/x.txt": "h", "empty": ""},
    )
    (tmp_path / "t/void").mkdir()
    entries, found = filetree.read_tree(spark, root, task_entries=budget)
    assert paths(entries) == walk(root)
    assert found.count() == 0
    row = entries.where("path = 'd1/e1/f7.txt'").first()
    info = os.lstat(f"{root}/d1/e1/f7.txt")
    assert (row.size, row.level, row.permissions) == (7, 2, info.st_mode)
    assert row.modified_time.timestamp() == int(info.st_mtime)
    assert (row.device, row.inode) == (str(info.st_dev), str(info.st_ino))


def test_attributes(spark, tmp_path):
    root = make(tmp_path / "t", {"a.bin": b"x\0y", "late.bin": b"x" * 9000 + b"\0", "d/t.txt": "ü"})
    os.symlink("a.bin", f"{root}/link")
    entries, _ = filetree.read_tree(spark, root, sniff=True)
    mode = F.col("permissions")
    rows = {
        r.path: r
        for r in entries.select(
            "*",
            mode_is(mode, MODE_DIRECTORY).alias("dir"),
            mode_is(mode, MODE_REGULAR).alias("reg"),
            mode_is(mode, MODE_SYMLINK).alias("lnk"),
            mode_bits(mode).alias("bits"),
        ).collect()
    }
    assert [rows[p].is_binary for p in ("a.bin", "late.bin", "d/t.txt", "link")] == [
        True, False, False, False]
    assert (rows["link"].is_symlink, rows["link"].size, rows["link"].link_target) == (True, 5, "a.bin")
    assert rows["d"].dir and rows["a.bin"].reg and rows["link"].lnk
    assert rows["a.bin"].bits == os.lstat(f"{root}/a.bin").st_mode & 0o7777


def test_golden_document(spark, tmp_path):
    root = make(
        tmp_path / "t",
        {"root.txt": "top\n", "level1/l1.txt": "one", "level1/level2/l2.txt": "two\n", "a-b": ""},
    )
    run = assemble_tree(spark, root, Options(show_size=True))
    expected = (
        HEAD
        + "📄 [0 KB] a-b\n📁 level1/\n  📄 [1 KB] level1/l1.txt\n  📁 level1/level2/\n"
        + "    📄 [1 KB] level1/level2/l2.txt\n📄 [1 KB] root.txt\n"
        + MIDDLE
        + "// File: a-b\n\n\n// File: level1/l1.txt\none\n\n"
        + "// File: level1/level2/l2.txt\ntwo\n\n\n// File: root.txt\ntop\n\n\n"
    )
    assert text_of(spark, run, tmp_path / "out") == expected.encode()
    # Again over the old one: a shorter document leaves nothing of it.
    short = assemble_tree(spark, root, Options(include=["root.txt"], exclude=["level1"]))
    assert text_of(spark, short, tmp_path / "out") == (
        HEAD + "📄 root.txt\n" + MIDDLE + "// File: root.txt\ntop\n\n\n"
    ).encode()


def test_text_sink_writes_the_same_document(spark, tmp_path):
    root = make(tmp_path / "t", {f"d{n}/f.txt": "line\n" * n for n in range(6)} | {"raw": b"\xff\xfe\n"})
    run = assemble_tree(spark, root)
    exact = text_of(spark, run, tmp_path / "out")
    document.write_text(run.fragments, str(tmp_path / "txt"))
    parts = sorted(p for p in os.listdir(tmp_path / "txt") if p.startswith("part-"))
    assert b"".join(open(tmp_path / "txt" / p, "rb").read() for p in parts) == exact


def test_text_sink_refuses_a_cut_fragment(spark, tmp_path):
    root = make(tmp_path / "t", {"cut": b"a" * 16384 + b"\0"})
    run = assemble_tree(spark, root)
    with pytest.raises(Exception, match="no last line feed"):
        document.write_text(run.fragments, str(tmp_path / "txt"))
    assert text_of(spark, run, tmp_path / "out").endswith(b"// File: cut\n" + b"a" * 16384)


def test_missing_root_and_unreadable_entries_are_diagnostics(spark, tmp_path):
    entries, found = filetree.read_tree(spark, str(tmp_path / "none"))
    assert entries.count() == 0
    assert [r.code for r in found.collect()] == ["disappeared"]
    run = assemble_tree(spark, str(tmp_path / "none"))
    assert text_of(spark, run, tmp_path / "out") == (HEAD + MIDDLE).encode()
    root = make(tmp_path / "t", {"good": "g", "gone": "x"})
    entries, _ = filetree.read_tree(spark, root)
    os.remove(f"{root}/gone")
    rows = {r.path: r for r in filetree.read_blocks(entries, root).collect()}
    assert rows["gone"].code == "disappeared" and rows["gone"].content is None
    assert bytes(rows["good"].content) == b"g"


@pytest.mark.parametrize("size", [0, 1, 4095, 4096, 16383, 16384, 16385, 70000])
@pytest.mark.parametrize("block", [16384, 1 << 20])
def test_blocks_hold_the_bytes(spark, tmp_path, size, block):
    data = bytes(n % 251 + 1 for n in range(size))
    root = make(tmp_path / "t", {"f": data})
    entries, _ = filetree.read_tree(spark, root)
    blocks = filetree.read_blocks(entries, root, block_bytes=block)
    rows = sorted(blocks.collect(), key=lambda r: r.block_no)
    assert b"".join(bytes(r.content) for r in rows) == data
    assert all(r.blocks == len(rows) for r in rows)


def cut(data: bytes, size: int | None = None) -> tuple[bytes, bool]:
    """The skip rule done by hand, chunk by chunk."""
    size = len(data) if size is None else size
    step = size if 0 < size < 4096 else 4096 if size < 16384 else 16384
    for start in range(0, len(data), step):
        if b"\0" in data[start : start + step][:1024]:
            return data[:start], True
    return data, False


NULS = {
    "first": b"\0" + b"a" * 5000,
    "late_seen": b"a" * 16384 + b"b" * 1000 + b"\0" + b"c" * 30000,
    "late_unseen": b"a" * 16384 + b"b" * 1024 + b"\0" + b"c" * 30000,
    "third_block": b"a" * 49152 + b"\0" * 3 + b"z" * 20000,
    "medium": b"a" * 4096 + b"\0" + b"b" * 4000,
    "text": b"plain\n",
    "empty": b"",
}


@pytest.mark.parametrize("block", [16384, 1 << 20])
def test_binary_modes_on_blocks(spark, tmp_path, block):
    root = make(tmp_path / "t", NULS)
    body, flags = {}, {}
    for name, data in NULS.items():
        body[name], flags[name] = cut(data)
    order = sorted(NULS)
    shown = {
        "skip": lambda n: body[n] + (b"" if flags[n] else b"\n\n"),
        "include": lambda n: NULS[n] + b"\n\n",
        "placeholder": lambda n: (
            b"// [Binary file content not displayed]\n" if flags[n] else NULS[n]
        ) + b"\n\n",
    }
    for mode, expect in shown.items():
        run = assemble_tree(spark, root, Options(binary=mode, block_bytes=block))
        text = text_of(spark, run, tmp_path / f"out-{mode}")
        contents = b"".join(f"// File: {n}\n".encode() + expect(n) for n in order)
        assert text.split(MIDDLE.encode(), 1)[1] == contents, mode
    row = assemble_tree(spark, root, Options(block_bytes=block)).stats().first()
    assert row.total_files == len(NULS)
    assert row.processed_files == len(NULS) - sum(flags.values())
    assert row.skipped_files == sum(flags.values())
    assert row.processed_bytes == row.filtered_bytes == sum(map(len, body.values()))


def test_placeholder_after_a_content_rule_cut(spark, tmp_path):
    root = make(
        tmp_path / "t",
        {"nul_first": b"\0" + b"a" * 20000 + b"STOP" + b"a" * 20000, "stop_first": b"STOP\0" + b"a" * 40000},
    )
    stop = ContentRule("exclude", lambda chunk: F.contains(chunk, F.lit(b"STOP")))
    options = Options(binary="placeholder", rules=[stop], block_bytes=16384)
    text = text_of(spark, assemble_tree(spark, root, options), tmp_path / "out")
    assert text.split(MIDDLE.encode(), 1)[1] == (
        b"// File: nul_first\n// [Binary file content not displayed]\n// File: stop_first\n"
    )


def test_symlink_modes(spark, tmp_path):
    root = make(tmp_path / "t", {"target.txt": "hello\n", "d/x.txt": "x"})
    os.symlink("target.txt", f"{root}/link.txt")
    os.symlink("nonexistent.txt", f"{root}/bad.txt")
    os.symlink("d", f"{root}/dirlink")
    read = lambda mode: text_of(
        spark, assemble_tree(spark, root, Options(symlinks=mode)), tmp_path / f"o-{mode}"
    ).decode().split(MIDDLE, 1)
    assert "link.txt" not in "".join(read("skip"))
    structure, contents = read("include")
    assert "📄 dirlink\n" in structure
    assert "// File: bad.txt\n// File: d/x.txt\n" in contents
    assert "// File: dirlink\n\n\n" in contents
    assert "// File: link.txt\nhello\n\n\n" in contents
    structure, contents = read("placeholder")
    assert "// File: link.txt\n// [Symbolic link to: target.txt]\n\n\n" in contents
    assert "// File: bad.txt\n// [Symbolic link to: nonexistent.txt]\n\n\n" in contents
    assert "// File: target.txt\nhello\n" in contents
    structure, contents = read("follow")
    assert "📁 dirlink/\n  📄 dirlink/x.txt\n" in structure
    assert "// File: dirlink/x.txt\nx\n\n" in contents
    assert "// File: link.txt\nhello\n\n\n" in contents
    run = assemble_tree(spark, root, Options(symlinks="follow"))
    codes = {(r.path, r.code) for r in run.diagnostics.collect()}
    assert codes == {("bad.txt", "unresolvable_link"), ("bad.txt", "disappeared")}


def test_a_link_is_read_in_chunks_of_its_own_size(spark, tmp_path):
    # The link's size, 10 bytes, sets the chunks: a NUL anywhere is seen.
    data = b"a" * 5000 + b"\0" + b"b" * 5000
    root = make(tmp_path / "t", {"target.bin": data})
    os.symlink("target.bin", f"{root}/link")
    options = Options(symlinks="include", include=["link"], block_bytes=1000)
    text = text_of(spark, assemble_tree(spark, root, options), tmp_path / "out")
    assert cut(data, 10) == (b"a" * 5000, True)
    assert text.endswith(b"// File: link\n" + b"a" * 5000)


@pytest.mark.parametrize("budget", [1, 20_000])
def test_cycles_are_listed_once_and_not_entered(spark, tmp_path, budget):
    root = make(tmp_path / "t", {"a/file.txt": "f", "a/b/x.txt": "x"})
    os.symlink("../../a", f"{root}/a/b/back")
    os.symlink("self", f"{root}/self")
    os.symlink("a", f"{root}/one")
    os.symlink("a", f"{root}/two")
    entries, found = filetree.read_tree(spark, root, follow=True, task_entries=budget)
    below = ["", "/b", "/b/back", "/b/x.txt", "/file.txt"]
    assert paths(entries) == sorted([d + p for d in ("a", "one", "two") for p in below] + ["self"])
    rows = {(r.path, r.code) for r in found.collect()}
    assert rows == {
        ("a/b/back", "cycle"), ("one/b/back", "cycle"), ("two/b/back", "cycle"),
        ("self", "unresolvable_link")}


def test_include_exclude_and_pruning(spark, tmp_path):
    root = make(
        tmp_path / "t",
        {"main.c": "int", "file.md": "m", ".git/config": "git config", "sub/.git/x.c": "no", "src/p.c": "p"},
    )
    run = assemble_tree(spark, root, Options(include=["*.C", "p.c"], exclude=["  .git\t"]))
    assert paths(run.entries) == ["main.c", "src", "src/p.c", "sub"]
    assert b"git config" not in text_of(spark, run, tmp_path / "out")


def test_the_output_stays_out_of_its_input(spark, tmp_path):
    root = make(tmp_path / "t", {"a.txt": "a", "sub/out.txt": "namesake", "out.txt": "old"})
    run = assemble_tree(spark, root, output=f"{root}/out.txt")
    assert paths(run.entries) == ["a.txt", "sub"]


def test_caps(spark, tmp_path):
    deep = "/".join(["d"] * 30)
    root = make(tmp_path / "t", {f"{deep}/deep.txt": "down", "big": "x" * 101, "fit": "x" * 100})
    run = assemble_tree(spark, root, Options(max_file_bytes=100))
    text = text_of(spark, run, tmp_path / "out")
    assert f"// File: {deep}/deep.txt\ndown".encode() in text
    assert b"// File: big\n// File: d/" in text
    assert [(r.path, r.code) for r in run.diagnostics.collect()] == [("big", "too_large")]
    counts = stats.diagnostic_counts(run.diagnostics).collect()
    assert [(r.code, r["count"]) for r in counts] == [("too_large", 1)]
    shallow, found = filetree.read_tree(spark, root, max_depth=2)
    assert paths(shallow) == ["big", "d", "d/d", "fit"]
    assert [(r.path, r.code) for r in found.collect()] == [("d/d/d", "depth_exceeded")]


def test_a_file_with_a_failed_block_is_unreadable_as_a_whole(spark, tmp_path, monkeypatch):
    root = make(tmp_path / "t", {"bad": b"a" * 49152, "good": b"b" * 49152, "gone": b"c"})
    usual = filetree.read_blocks

    def failing(*args, **settings):
        at = (F.col("path") == "bad") & (F.col("block_no") == 1)
        lost = usual(*args, **settings).withColumn("code", F.when(at, "cannot_open").otherwise(F.col("code")))
        return lost.withColumn("content", F.when(F.col("code").isNull(), F.col("content")))

    monkeypatch.setattr(filetree, "read_blocks", failing)
    run = assemble_tree(spark, root, Options(block_bytes=16384))
    os.remove(f"{root}/gone")
    text = text_of(spark, run, tmp_path / "out")
    assert text.endswith(b"// File: bad\n// File: gone\n// File: good\n" + b"b" * 49152 + b"\n\n")
    codes = {(r.path, r.code) for r in run.diagnostics.collect()}
    assert codes == {("bad", "cannot_open"), ("gone", "disappeared")}
    states = {r.path: r.status for r in run.processed.where("block_no = 0").collect()}
    assert states == {"bad": "unreadable", "good": "ok", "gone": "unreadable"}


def test_names_that_are_not_utf8_are_escaped(spark, tmp_path):
    root = make(tmp_path / "t", {"plain": "p", r"lit\xff.txt": "l"})
    raw = os.fsencode(root)
    os.mkdir(raw + b"/d\xfe")
    for name in (b"/bad\xff.txt", b"/d\xfe/in"):
        with open(raw + name, "wb") as file:
            file.write(b"raw")
    os.symlink(b"bad\xff.txt", raw + b"/link")
    run = assemble_tree(spark, root, Options(symlinks="include"))
    text = text_of(spark, run, tmp_path / "out").decode()
    for name, data in ((r"bad\xff.txt", "raw"), (r"d\xfe/in", "raw"), (r"lit\xff.txt", "l"), ("link", "raw")):
        assert f"// File: {name}\n{data}\n" in text
    codes = {(r.path, r.code) for r in run.diagnostics.collect()}
    assert codes == {(r"bad\xff.txt", "name_not_utf8"), (r"d\xfe", "name_not_utf8")}


def test_the_listing_takes_includes_and_opens_nothing(spark, tmp_path):
    root = make(tmp_path / "t", {"a.c": "x", "b.md": "y", "src/d.c": "z", "e/f.md": "w"})
    entries, _ = filetree.read_tree(spark, root, include=["*.C"])
    assert paths(entries) == ["a.c", "e", "src", "src/d.c"]
    assert {r.is_binary for r in entries.collect()} == {None}


def test_content_plugins_on_a_tree(spark, tmp_path):
    from sheaf.plans.plugins import LineNumbers

    root = make(tmp_path / "t", {"a": "x\ny", "empty": ""})
    run = assemble_tree(spark, root, Options(content_plugins=[LineNumbers()]))
    text = text_of(spark, run, tmp_path / "out").split(MIDDLE.encode(), 1)[1]
    assert text == b"// File: a\n1: x\ny\n\n// File: empty\n\n\n"


def test_plugins_on_a_tree(spark, tmp_path):
    root = make(tmp_path / "t", {"keep/a.txt": "abc", "drop/b.txt": "b", "keep/secret.txt": "KEY"})
    plugin = register_filter(
        "p",
        path=lambda e: F.col("path") != "drop",
        content=lambda c: ~F.contains(c, F.lit(b"KEY")),
        transform=lambda c: F.concat(F.lit(b">"), c),
    )
    text = text_of(spark, assemble_tree(spark, root, Options(plugins=[plugin])), tmp_path / "out")
    assert text.split(MIDDLE.encode(), 1)[1] == (
        b"// File: keep/a.txt\n>abc\n\n// File: keep/secret.txt\n"
    )


def test_json_document(spark, tmp_path):
    files = {"b.txt": 'say "hi"\n', "a/x.txt": "ä", "raw": b"\xff\xfe"}
    root = make(tmp_path / "t", files)
    run = assemble_tree(spark, root, Options(format="json"))
    parsed = json.loads(text_of(spark, run, tmp_path / "out"))
    assert parsed == {
        "files": [
            {"path": "a/x.txt", "size": 2, "content": "ä"},
            {"path": "b.txt", "size": 9, "content": 'say "hi"\n'},
            {"path": "raw", "size": 2, "content": "//4=", "encoding": "base64"},
        ]
    }


def test_other_sinks_and_run_report(spark, tmp_path):
    root = make(tmp_path / "t", {"a": "1", "b": "22"})
    run = assemble_tree(spark, root)
    document.write_fragments(run.fragments, str(tmp_path / "frag"))
    assert spark.read.parquet(str(tmp_path / "frag")).count() == run.fragments.count()
    document.write_json(run.processed, str(tmp_path / "json"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "json")).collect()]
    assert sorted(r["path"] for r in lines) == ["a", "b"]
    watched, report = stats.observed(run.processed)
    watched.write.format("noop").mode("overwrite").save()
    assert report.get["processed_files"] == 2 and report.get["processed_bytes"] == 3


@pytest.mark.parametrize("block", [16384, 1 << 20])
def test_the_written_document_comes_with_its_report(spark, tmp_path, block):
    root = make(tmp_path / "t", NULS | {"big": "x" * 200000, "d/e": "y"})
    run = assemble_tree(spark, root, Options(block_bytes=block, max_file_bytes=100000))
    report = run.write(str(tmp_path / "out"))
    assert report.pop("seconds") > 0
    assert report == run.stats().first().asDict()
    flags = [cut(data)[1] for data in NULS.values()]
    assert report["total_files"] == len(NULS) + 2
    assert report["skipped_files"] == sum(flags) + 1
    text = b"".join(open(p, "rb").read() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.count(b"// File: ") == len(NULS) + 2


def test_many_cut_files_are_joined_instead_of_broadcast(spark, tmp_path, monkeypatch):
    from sheaf.operators import skew

    root = make(tmp_path / "t", NULS)
    options = Options(block_bytes=16384)
    usual = text_of(spark, assemble_tree(spark, root, options), tmp_path / "a")
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    assert text_of(spark, assemble_tree(spark, root, options), tmp_path / "b") == usual


def test_unknown_options_raise():
    for wrong in ({"format": "xml"}, {"symlinks": "maybe"}, {"binary": "no"}):
        with pytest.raises(ValueError):
            Options(**wrong)
    with pytest.raises(ValueError):
        render.formatter_named("none")
