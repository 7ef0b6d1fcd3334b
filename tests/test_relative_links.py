"""Links with targets as a file system holds them."""

import os
import posixpath

from pyspark.sql import functions as F

from sheaf.functions.paths import normalize_path, target_path
from sheaf.operators import links
from sheaf.plans.assemble import Options, assemble_tables


def test_normal_paths_by_the_standard_library(spark):
    paths = ["", ".", "a", "a/b", "./a//b/.", "a/../b", "a/b/../../c", "..", "a/../..", "a/../../b", "../a", "a/./../b/..", "/", "//a/", "a/.../b", " /a", "a/..b"]
    got = {r.p: r.n for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", normalize_path(F.col("p")).alias("n")).collect()}
    for path in paths:
        want = posixpath.normpath(path.strip("/") or ".")
        assert got[path] == (None if want.startswith("..") and not want.startswith("..b") else "" if want == "." else want), path


def test_targets_are_placed_in_the_table(spark):
    rows = [
        ("a/b/link", "../../c/d", "c/d"),
        ("a/link", "target.txt", "a/target.txt"),
        ("link", "../x", None),
        ("link", "a/..", ""),
        ("a/link", "/mnt/tree/b//c/", "b/c"),
        ("a/link", "/mnt/tree2/b", None),
        ("a/link", "/etc/passwd", None),
        ("a/file", None, None),
    ]
    table = spark.createDataFrame([r[:2] for r in rows], "p string, t string")
    got = table.select("p", "t", target_path(F.col("p"), F.col("t"), "/mnt//tree/").alias("place")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(rows, key=repr)
    absolute = table.where("startswith(t, '/')").select(target_path(F.col("p"), F.col("t")).alias("place"))
    assert {r.place for r in absolute.collect()} == {None}


def _listed(root):
    """(path, is_directory, is_symlink, size, link_target) of a real tree, links not followed."""
    for folder, names, files in os.walk(root):
        for name in names + files:
            full = os.path.join(folder, name)
            link = os.path.islink(full)
            path = os.path.relpath(full, root)
            yield path, os.path.isdir(full) and not link, link, os.lstat(full).st_size, os.readlink(full) if link else None


def _followed(root):
    """What following links gives, one directory after the other."""

    def walk(full, path, above):
        for name in sorted(os.listdir(full)):
            child, down = os.path.join(full, name), f"{path}/{name}" if path else name
            real = os.path.realpath(child)
            yield down
            if os.path.isdir(child) and real not in above:
                yield from walk(child, down, [*above, real])

    yield from walk(root, "", [os.path.realpath(root)])


def test_a_real_tree_followed_by_its_relative_links(spark, tmp_path):
    for folder in ("a/b/c", "d/e"):
        (tmp_path / folder).mkdir(parents=True)
    for path, text in (("a/x.txt", "x"), ("a/b/c/y.txt", "yy"), ("d/e/z.txt", "zzz")):
        (tmp_path / path).write_text(text)
    made = {
        "a/b/up": "../../d",
        "a/b/c/deep": "../../../d//e/.",
        "d/file": "../a/./x.txt",
        "d/e/loop": "../../a",
        "a/near": "x.txt",
        "a/whole": str(tmp_path / "d" / "e"),
        "a/outside": "../../elsewhere",
        "d/gone": "nothing",
        "a/chain": "near",
    }
    for path, target in made.items():
        (tmp_path / path).symlink_to(target)
    root = str(tmp_path)
    schema = "path string, is_directory boolean, is_symlink boolean, size long, link_target string"
    entries = spark.createDataFrame(list(_listed(root)), schema)
    followed = links.follow_links(links.placed_targets(entries, root))
    assert sorted(r.path for r in followed.collect()) == sorted(_followed(root))
    contents = [(p, (tmp_path / p).read_bytes()) for p, is_dir, link, *_ in _listed(root) if not is_dir and not link]
    run = assemble_tables(entries, spark.createDataFrame(contents, "path string, content binary"), Options(symlinks="follow", link_root=root))
    codes = {(r.path, r.code) for r in run.diagnostics.collect()}
    lost = {p for p, c in codes if c == "unresolvable_link"}
    assert {"a/outside", "d/gone"} <= lost and not lost & {"a/b/up", "a/chain", "a/whole", "d/file"}
