"""Operators against brute force, with hot keys and with thresholds that force every path."""

import random

import pytest
from pyspark.sql import functions as F

from sheaf.functions import content as C
from sheaf.functions import paths as P
from sheaf.functions.content import link_placeholder
from sheaf.operators import contents, filters, links, ordering, render, skew, stats
from sheaf.plans import fixtures, plugins
from sheaf.plans.assemble import Options, assemble_corpus, assemble_tables

FILES = "grp string, path string, content binary, size long, is_directory boolean"


def hot_files(count=300):
    """Files of which two thirds are in one group and directory."""
    rng = random.Random(7)
    rows = []
    for n in range(count):
        group = "hot" if n % 3 else f"g{n % 7}"
        data = bytes(rng.choices(b"abc\n", k=rng.randrange(0, 400)))
        rows.append((group, f"{group}/f{rng.randrange(10**9)}-{n}.txt", data, len(data), False))
    return rows


def test_basename_and_mode_cases(spark):
    cases = ["/path/to/file.txt", "file.txt", "/path/to/file", "path/to/file", "/path/to/", "a\\b", "a\\b/c", "a/b\\"]
    rows = spark.createDataFrame([(c,) for c in cases], "p string").select(
        P.basename(F.col("p")), P.parent(F.col("p")), P.level(F.col("p"))
    )
    got = [tuple(r) for r in rows.collect()]
    assert [g[0] for g in got] == ["file.txt", "file.txt", "file", "file", "", "b", "c", ""]
    assert [g[1] for g in got][:5] == ["/path/to", "", "/path/to", "path/to", "/path/to"]
    assert got[1][2] == 0 and got[3][2] == 2


def test_relative_path_edges(spark):
    pairs = [("/a", "/a/b"), ("/a/", "/a/b"), ("/a", "/ab"), ("/a", "/a"), ("/a", "/a/")]
    rows = spark.createDataFrame(pairs, "b string, t string")
    got = [r[0] for r in rows.select(P.relative_path(F.col("b"), F.col("t"))).collect()]
    assert got == ["b", "b", None, None, ""]


def test_size_kb_edges(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 1, 1023, 1024, 1025)], "n long")
    assert [r[0] for r in rows.select(P.size_kb(F.col("n"))).collect()] == [0, 1, 1, 1, 2]


def test_order_key_is_preorder(spark):
    names = ["a", "a/b", "a/b/c", "a-x", "a.txt", "b", "a b", "ab/c", "ab", "é/x", "é"]
    rows = spark.createDataFrame([(n,) for n in names], "p string")
    got = [r.p for r in rows.orderBy(P.order_key(F.col("p"))).collect()]
    assert got == sorted(names, key=lambda n: [part.encode() for part in n.split("/")])


def test_binary_flag_cases(spark):
    cases = [b"text", b"Hello\0World", b"", "漢字 Кирилл 🎉".encode(), b"a" * 8192 + b"\0", b"a" * 8191 + b"\0"]
    rows = spark.createDataFrame([(c,) for c in cases], "c binary")
    got = [r[0] for r in rows.select(C.is_binary(F.col("c"))).collect()]
    assert got == [False, True, False, False, False, True]


def test_link_placeholder_edges(spark):
    lengths = [0, 1, 2023, 2024]
    rows = spark.createDataFrame([("x" * n,) for n in lengths] + [(None,)], "t string")
    got = [r[0] for r in rows.select(link_placeholder(F.col("t"))).collect()]
    unreadable = "// [Symbolic link - target unreadable]\n"
    assert got[0] == got[4] == unreadable
    assert got[1] == "// [Symbolic link to: x]\n"
    assert len(got[2]) == 2047
    assert got[3] == "// [Symbolic link - target too long]\n"


def test_positions_and_offsets_with_a_hot_group(spark):
    rows = hot_files()
    table = spark.createDataFrame(rows, FILES).repartition(5)
    got = ordering.with_position(table.select("path"), ["path"]).collect()
    assert {r.path: r.position for r in got} == {
        path: n + 1 for n, path in enumerate(sorted(r[1] for r in rows))
    }
    ranged = ordering.ordered_table(table.select("grp", "path", "size"), ["grp", "path"])
    totalled = ordering.with_total(ranged, "size")
    sized = ordering.with_offset(ranged, totalled, "grp", "size")
    expected, total, seen = {}, 0, {}
    for group, path, _, size, _ in sorted(rows):
        expected[path] = (total, seen.get(group, 0))
        total += size
        seen[group] = seen.get(group, 0) + size
    assert {r.path: (r.total, r.offset) for r in sized.collect()} == expected


@pytest.mark.parametrize("coarse", [1024, 3])
@pytest.mark.parametrize("starts", [["a"], ["b", "d"], list("bcdefghijklm"), ["", "zz"]])
def test_route_finds_the_part_of_a_key(spark, starts, coarse, monkeypatch):
    monkeypatch.setattr(ordering, "COARSE", coarse)
    keys = [c + x for c in "abcdez" for x in ("", "0", "zz")]
    rows = spark.createDataFrame([(k,) for k in keys], "k string")
    table = spark.createDataFrame(list(enumerate(starts)), "part long, key string")
    routed = ordering.route(rows, F.col("k"), table, len(starts), "part")
    got = routed.withColumn("at", F.spark_partition_id()).collect()
    for row in got:
        expected = max([n for n, s in enumerate(starts) if s <= row.k], default=0)
        assert (row.part, row["at"]) == (expected, expected)
    assert sorted(r.k for r in got) == sorted(keys)


@pytest.mark.parametrize("volume,part", [(1, 1), (500, 700), (3000, 2000), (10**6, 10**6), (10**6, 100)])
def test_bundles_of_a_hot_group(spark, volume, part):
    rows = hot_files()
    files = spark.createDataFrame(rows, FILES).repartition(5)
    processed = contents.process_files(files)
    got = render.bundles(files, processed, "grp", volume_bytes=volume, part_bytes=part).collect()
    expected: dict = {}
    seen: dict = {}
    for group, path, data, size, _ in sorted(rows):
        text = f"// File: {path}\n".encode() + data + b"\n\n"
        key = (group, seen.get(group, 0) // volume)
        count, joined = expected.get(key, (0, b""))
        expected[key] = (count + 1, joined + text)
        seen[group] = seen.get(group, 0) + size
    assert {(r.grp, r.volume): (r.files, bytes(r.text)) for r in got} == expected
    assert len(got) == len(expected)


def test_document_order_by_recorded_sizes(spark):
    rows = hot_files(120)
    files = spark.createDataFrame(rows, FILES).repartition(5)
    entries = files.select("path", "is_directory", "size")
    text = render.document(entries, contents.process_files(files))
    sampled = [bytes(r.text) for r in render.in_order(text).collect()]
    for part in (1, 4000, 10**9):
        placed = render.in_order(text, entries, part_bytes=part)
        assert [bytes(r.text) for r in placed.collect()] == sampled


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join_with_hot_keys(spark, small, how):
    rows = [(f"p{n}", "hot" if n % 3 else f"k{n % 50}") for n in range(400)]
    table = [("hot", 1), ("hot", 2)] + [(f"k{n}", n) for n in range(0, 50, 2)]
    left = spark.createDataFrame(rows, "path string, key string")
    right = spark.createDataFrame(table, "key string, v int")
    got = skew.lookup_join(left, right, "key", how, small=small, threshold=20)
    plain = left.join(right, "key", how)
    pick = lambda df: sorted((r.path, r.key, r.v or 0) for r in df.collect())
    assert pick(got) == pick(plain)
    pieces = {r.key: r["_pieces"] for r in skew.hot_keys(left, "key", 20).collect()}
    assert pieces == {"hot": 14}


def test_pruning_by_row_predicates(spark):
    rows = [(f"a{n % 5}/b{n % 3}/f{n}", False) for n in range(60)]
    directories = {p.rsplit("/", k)[0] for p, _ in rows for k in (1, 2)}
    entries = spark.createDataFrame(rows + [(d, True) for d in directories], "path string, is_directory boolean")
    refused = {"a1", "a2/b0", "a3/b3"}
    keep = lambda e: ~F.col("path").isin(list(refused)) & ~F.col("path").endswith("7")
    got = {r.path for r in filters.keep_by_predicates(entries, [keep]).collect()}
    every = {p for p, _ in rows} | directories
    above = lambda p: {p.rsplit("/", k)[0] for k in range(1, p.count("/") + 1)}
    gone = {p for p in every if p in refused or p.endswith("7")}
    gone |= {p for p in every if above(p) & gone & directories}
    assert got == every - gone


LINKS = "path string, is_directory boolean, is_symlink boolean, size long, link_target string"


def chain(spark, length):
    """A file behind ``length`` links, plus a loop of two, a self link and a lost link."""
    rows = [("file", False, False, 9, None)]
    rows += [(f"l{n}", False, True, 3, "file" if n == 1 else f"l{n - 1}") for n in range(1, length + 1)]
    rows += [("x", False, True, 1, "y"), ("y", False, True, 1, "x"), ("z", False, True, 1, "x")]
    rows += [("self", False, True, 4, "self"), ("lost", False, True, 4, "none"), ("raw", False, True, 4, None)]
    return spark.createDataFrame(rows, LINKS)


@pytest.mark.parametrize("fits", [True, False])
def test_chains_of_links_resolve_up_to_the_limit(spark, monkeypatch, fits):
    if not fits:
        monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    for limit in (None, 40):
        got = {r.path: r for r in links.resolve_links(chain(spark, 43), limit).collect()}
        assert len(got) == 49
        for n in range(1, 44):
            assert got[f"l{n}"].target == ("file" if n <= 40 or limit is None else None), n
        assert got["l40"].target_size == 9
        for name in ("x", "y", "z", "self", "lost", "raw"):
            assert got[name].target is None


@pytest.mark.parametrize("fits", [True, False])
def test_links_through_linked_directories(spark, monkeypatch, fits):
    if not fits:
        monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    rows = [("d", True, False, 0, None), ("d/e", True, False, 0, None), ("d/e/f", False, False, 2, None),
            ("ld", False, True, 1, "d"), ("d/up", False, True, 1, "d"), ("x", False, True, 4, "ld/e/f"),
            ("y", False, True, 4, "ld/up/up/e"), ("z", False, True, 4, "y/f"), ("w", False, True, 4, "z"),
            ("bad", False, True, 4, "ld/none"), ("in", False, True, 4, "in/side"), ("a", False, True, 4, "b/c"),
            ("b", False, True, 4, "a/c")]
    got = {r.path: r.target for r in links.resolve_links(spark.createDataFrame(rows, LINKS)).collect()}
    assert got == {"ld": "d", "d/up": "d", "x": "d/e/f", "y": "d/e", "z": "d/e/f", "w": "d/e/f",
                   "bad": None, "in": None, "a": None, "b": None}
    data = spark.createDataFrame([("d/e/f", bytearray(b"hi"))], "path string, content binary")
    run = assemble_tables(spark.createDataFrame(rows, LINKS), data, Options(symlinks="include"))
    shown = {r.path: (r.status, bytes(r.body or b"")) for r in run.processed.collect()}
    assert shown["x"] == shown["w"] == ("ok", b"hi") and shown["bad"][0] == "unreadable"


def test_following_without_small_sides(spark, sf_dir, monkeypatch):
    tree = fixtures.link_tree(spark, sf_dir)
    usual = sorted(map(str, links.follow_links(tree).collect()))
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    assert sorted(map(str, links.follow_links(tree).collect())) == usual


def test_followed_tables_carry_their_targets_contents(spark):
    rows = [("d", True, False, 0, None), ("d/f", False, False, 2, None), ("l", False, True, 1, "d"),
            ("m", False, True, 3, "d/f"), ("bad", False, True, 1, "no")]
    entries = spark.createDataFrame(rows, LINKS)
    data = spark.createDataFrame([("d/f", bytearray(b"hi"))], "path string, content binary")
    run = assemble_tables(entries, data, Options(symlinks="follow"))
    text = b"".join(bytes(r.text) for r in render.in_order(run.fragments, run.entries).collect())
    assert text.decode().split("File Contents:\n=============\n\n")[1] == (
        "// File: bad\n// File: d/f\nhi\n\n// File: l/f\nhi\n\n// File: m\nhi\n\n"
    )
    codes = {(r.path, r.code) for r in run.diagnostics.collect()}
    assert codes == {("bad", "unresolvable_link"), ("bad", "unreadable")}


@pytest.mark.parametrize("mode", ["skip", "include", "placeholder", "follow"])
@pytest.mark.parametrize("plugged", [False, True])
def test_a_corpus_table_gives_the_document_of_its_tables(spark, mode, plugged):
    rows = [(f"d{n % 3}/e/f{n}.{'c' if n % 2 else 'md'}", bytes([n % 5]) * n, False, n, None) for n in range(25)]
    rows += [("d0/l", b"", True, 7, "d1/e/f1.c"), ("k", b"", True, 4, "none")]
    schema = "path string, content binary, is_symlink boolean, size long, link_target string"
    files = spark.createDataFrame(rows, schema)
    folders = [(d, True, False, 0, None) for n in range(3) for d in (f"d{n}", f"d{n}/e")]
    narrow = spark.createDataFrame([(p, False, s, z, t) for p, _, s, z, t in rows] + folders, LINKS)
    plugin = plugins.register_filter("no_d2", path=lambda e: F.col("path") != "d2")
    options = Options(symlinks=mode, exclude=["*.md"], plugins=[plugin] if plugged else [])
    one = assemble_corpus(files, options)
    two = assemble_tables(narrow, files.select("path", "content"), options)

    def text(run):
        return b"".join(bytes(r.text) for r in render.in_order(run.fragments, run.entries).collect())

    assert text(one) == text(two)
    assert (b"d2/" in text(one)) != plugged
    assert one.stats().collect() == two.stats().collect()
    assert sorted(map(str, one.diagnostics.collect())) == sorted(map(str, two.diagnostics.collect()))


def test_blocks_and_whole_files_agree(spark):
    """The block form of the content pass on blocks cut by hand."""
    rng = random.Random(3)
    rows, pieces = [], []
    for n in range(12):
        data = bytearray(rng.choices(b"abcd", k=rng.randrange(0, 90000)))
        for _ in range(n % 3):
            if data:
                data[rng.randrange(len(data))] = 0
        rows.append((f"f{n}", bytes(data), len(data)))
        blocks = [data[i : i + 32768] for i in range(0, len(data), 32768)] or [b""]
        pieces += [(f"f{n}", len(data), k, len(blocks), bytes(b)) for k, b in enumerate(blocks)]
    whole = spark.createDataFrame(rows, "path string, content binary, size long")
    block = spark.createDataFrame(pieces, "path string, size long, block_no int, blocks int, content binary")
    for mode in contents.BINARY_MODES:
        a = {r.path: (r.status, r.input_bytes, bytes(r.body)) for r in contents.process_files(whole, mode).collect()}
        joined: dict = {}
        for r in sorted(contents.process_blocks(block, mode).collect(), key=lambda r: (r.path, r.block_no)):
            status, size, body = joined.get(r.path, (r.status, 0, b""))
            joined[r.path] = (r.status, size + r.input_bytes, body + bytes(r.body))
        assert joined == a
        progress = {r.path: r.progress_bytes for r in stats.progress_by_file(contents.process_blocks(block, mode)).collect()}
        assert progress == {p: v[1] for p, v in a.items()}


def test_transforms_without_result_keep_the_chunk(spark):
    files = spark.createDataFrame([("f", b"a\xffb" * 3000, 9000), ("e", b"", 0)], "path string, content binary, size long")
    none = lambda chunk: F.lit(None).cast("binary")
    rows = {r.path: bytes(r.body) for r in contents.process_files(files, transforms=[none, none]).collect()}
    assert rows == {"f": b"a\xffb" * 3000, "e": b""}


def test_content_plugin_sees_a_files_chunks_in_order(spark):
    class Tail(plugins.ContentPlugin):
        """Counts bytes over a file's chunks and says so at its end."""

        def start(self, path):
            return [path, 0]

        def chunk(self, state, data):
            state[1] += len(data)
            return None

        def end(self, state):
            return f"|{state[0]}:{state[1]}".encode()

    rows = [(f"f{n}", bytes([97 + n]) * (n * 9000), n * 9000) for n in range(5)]
    files = spark.createDataFrame(rows, "path string, content binary, size long")
    chunks = plugins.apply_content_plugin(contents.explode_chunks(files, empty=True), Tail())
    got = {r.path: bytes(r.body) for r in plugins.chunk_body(chunks).collect()}
    assert got == {p: d + f"|{p}:{s}".encode() for p, d, s in rows}
    table = files.withColumns({"is_symlink": F.lit(False), "link_target": F.lit(None).cast("string")})
    run = assemble_corpus(table, Options(content_plugins=[Tail(), Tail()]))
    twice = {p: d + f"|{p}:{s}".encode() for p, d, s in rows}
    twice = {p: d + f"|{p}:{len(d)}".encode() for p, d in twice.items()}
    assert {r.path: bytes(r.body) for r in run.processed.collect()} == twice


def test_streamed_fragments_equal_the_batch(spark, tmp_path):
    from sheaf.streaming.files import append_fragments, stream_fragments

    rows = [(f"d/f{n}.txt", b"\0" if n % 4 == 0 else b"x" * n, max(n, 1), n % 5 == 0) for n in range(30)]
    files = spark.createDataFrame(rows, "path string, content binary, size long, is_symlink boolean")
    source = str(tmp_path / "in")
    files.repartition(3).write.parquet(source)
    options = Options(exclude=["f7.*"])
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = append_fragments(
        stream_fragments(stream, options), str(tmp_path / "out"), str(tmp_path / "ck")
    ).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = stream_fragments(files, options)
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect()))


def test_streams_obey_options_or_raise(spark):
    from sheaf.streaming.files import document_so_far, stream_fragments

    rows = [("a", b"x", 1, False, None), ("b", b"y", 1, False, None), ("l", b"", 1, True, "a")]
    files = spark.createDataFrame(rows, "path string, content binary, size long, is_symlink boolean, link_target string")
    only_a = plugins.register_filter("only_a", path=lambda e: F.col("path") == "a")
    shown = stream_fragments(files, Options(plugins=[only_a])).collect()
    assert [bytes(r.text) for r in shown] == [b"// File: a\nx\n\n"]
    shown = stream_fragments(files, Options(symlinks="placeholder")).collect()
    assert any(b"Symbolic link to: a" in bytes(r.text) for r in shown)
    for wrong in ({"symlinks": "follow"}, {"symlinks": "include"}, {"format": "json"}, {"content_plugins": [plugins.LineNumbers()]}):
        with pytest.raises(ValueError):
            stream_fragments(files, Options(**wrong))
    assert document_so_far.__doc__


def test_a_streamed_document_has_heads_and_listing(spark, tmp_path):
    from sheaf.streaming.files import document_so_far, stream_fragments

    files = spark.createDataFrame([("a", b"x", 1, False)], "path string, content binary, size long, is_symlink boolean")
    stream_fragments(files).write.parquet(str(tmp_path / "t"))
    entries = files.select("path", "size", F.lit(False).alias("is_directory"))
    document_so_far(spark, str(tmp_path / "t"), str(tmp_path / "out"), entries)
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*"))).decode()
    assert text.startswith("Directory Structure:") and "a\n\nFile Contents:" in text
    assert text.endswith("// File: a\nx\n\n")


def test_bundles_take_null_groups(spark):
    rows = [(None if n % 2 else f"g{n % 3}", f"f{n:03d}", b"x" * n, n) for n in range(60)]
    files = spark.createDataFrame(rows, "grp string, path string, content binary, size long")
    got = render.bundles(files, contents.process_files(files), "grp", volume_bytes=300, part_bytes=200).collect()
    text = {}
    for r in sorted(got, key=lambda r: (r.grp or "", r.volume)):
        text[r.grp] = text.get(r.grp, b"") + bytes(r.text)
    want = {}
    for group, path, data, _ in sorted(rows, key=lambda r: r[1]):
        want[group] = want.get(group, b"") + f"// File: {path}\n".encode() + data + b"\n\n"
    assert text == want


def test_no_limit_applies_by_itself(spark):
    deep, long = "/".join(["d"] * 300) + "/f", "p" * 5000
    rows = [(deep, b"1", False, 1, None), (long, b"2", False, 1, None)]
    files = spark.createDataFrame(rows, "path string, content binary, is_symlink boolean, size long, link_target string")
    run = assemble_corpus(files)
    assert {r.path for r in run.processed.collect()} == {deep, long} and run.diagnostics.count() == 0
    cut = assemble_corpus(files, Options(max_depth=256, max_path_bytes=4096))
    assert cut.processed.count() == 0
    codes = {(r.path, r.code) for r in cut.diagnostics.collect()}
    assert {(deep, "depth_exceeded"), (long, "path_too_long")} <= codes


def test_pruning_hides_what_exclusion_hides(spark):
    rng = random.Random(11)
    names = ["a", "b", "a\\", "ab", "d.c", "[a"]
    paths = {"/".join(rng.choices(names, k=rng.randrange(1, 4))) for _ in range(60)}
    paths |= {p.rsplit("/", k)[0] for p in paths for k in (1, 2) if p.count("/") >= k}
    rows = [(p, any(q.startswith(p + "/") for q in paths)) for p in sorted(paths)]
    entries = spark.createDataFrame(rows, "path string, is_directory boolean")
    long = "a" * 1030
    rows.append((f"{long}/x/y", False))
    patterns = ["a\\", "a", "*b", "[a", "a/*", "b\\", "?", "d.*", long]
    for pattern in patterns:
        own = {r.path for r in filters.keep_entries(entries, exclude=[pattern], prune=False).collect()}
        pruned = {r.path for r in filters.keep_entries(entries, exclude=[pattern]).collect()}
        gone = {p for p, _ in rows if p not in own}
        want = {p for p in own if not any(p.startswith(g + "/") for g in gone)}
        assert pruned == want, pattern


@pytest.mark.parametrize("fits", [True, False])
def test_patterns_as_a_table(spark, monkeypatch, fits):
    if not fits:
        monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    from sheaf.functions.globs import matches_any

    rng = random.Random(5)
    paths = ["".join(rng.choices("aB/.c\u00e9", k=rng.randrange(0, 9))) for _ in range(150)]
    globs = ["", "*", "a*", "*.C", "?b*c", "[ab]*", "a\\*", "*/c", "AB", "*é", "**", "a*b*c", "*" + "c" * 20, "a" * 20 + "*", None]
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    table = spark.createDataFrame(list(enumerate(globs)), "pattern_id int, pattern string")
    got = sorted((r.path, r.pattern_id) for r in filters.match_patterns(frame, table).collect())
    want = []
    for number, glob in enumerate(globs):
        if glob:
            want += [(r.path, number) for r in frame.where(matches_any(F.col("path"), [glob])).collect()]
    assert got == sorted(want)
    assert filters.match_patterns(frame, table.where("pattern_id < 0")).count() == 0


def test_hot_keys_are_few_and_weighed_by_bytes(spark, monkeypatch):
    rows = spark.range(1000).select(F.concat(F.lit("k"), (F.col("id") % 10).cast("string")).alias("key"))
    assert skew.hot_keys(rows, "key", 50).count() == 10
    monkeypatch.setattr(skew, "MOST_HOT", 5)
    assert skew.hot_keys(rows, "key", 50).count() == 0
    monkeypatch.setattr(skew, "MOST_HOT", 10_000)
    sizes = spark.createDataFrame([("k3", skew.PIECE_BYTES)], "key string, bytes long")
    assert {r.key: r["_pieces"] for r in skew.hot_keys(rows, "key", 1000, sizes).collect()} == {"k3": 100}


def test_a_documents_path_is_qualified(spark, tmp_path):
    from types import SimpleNamespace

    from sheaf.sources.document import _DocumentWriter, qualified

    assert qualified(spark, str(tmp_path)).startswith("file:/")
    context = spark.sparkContext
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(_jvm=context._jvm, _jsc=context._jsc, master="yarn"))
    with pytest.raises(ValueError, match="scheme"):
        qualified(cluster, "/out")
    with pytest.raises(ValueError, match="scheme"):
        _DocumentWriter("/out", True)._open()


def test_intermediate_tables_can_be_dropped(spark):
    import os

    from sheaf.session import checkpoint_dir, drop_written, written

    assert written(spark.range(5), "t").count() == 5
    root = f"{checkpoint_dir(spark).removeprefix('file:')}/sheaf/{spark.sparkContext.applicationId}"
    assert os.path.isdir(root)
    drop_written(spark)
    assert not os.path.exists(root)


class FakeContext:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_checkpoint_folder_comes_from_the_session():
    from types import SimpleNamespace

    from sheaf.session import checkpoint_dir

    def session(master, **conf):
        conf = {k.replace("_", "."): v for k, v in conf.items()}
        return SimpleNamespace(
            conf=SimpleNamespace(get=conf.get), sparkContext=FakeContext(master)
        )

    assert checkpoint_dir(session("yarn", spark_checkpoint_dir="hdfs://x/c")) == "hdfs://x/c"
    assert checkpoint_dir(session("local[2]", spark_checkpoint_dir="/shared")) == "/shared"
    local = session("local[2]")
    assert checkpoint_dir(local) == checkpoint_dir(local) == local.sparkContext.folder
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(session("yarn"))
