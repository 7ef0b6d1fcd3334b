"""Intervals of subtrees against walking through all pairs."""

from sheaf.operators.subtrees import nested_sets, subtree_sizes

DEEP = ["/".join(f"d{k}" for k in range(n + 1)) for n in range(300)]
ENTRIES = (
    [(p, True, 7) for p in ("a", "a/b", "a-x", "a\x01", "a/b/c", "empty", "z")]
    + [(p, False, n) for n, p in enumerate(("a/b/x", "a/b/c/y", "a-x/f", "a\x01/g", "a.txt", "a\x01b", "z/é", "top"))]
    + [(p, True, None) for p in DEEP]
    + [(DEEP[-1] + "/leaf", False, 1000), (DEEP[5] + "/side", False, None), (None, False, 5)]
)
SCHEMA = "path string, is_directory boolean, size long"


def test_sizes_below_every_directory(spark):
    got = {r.path: (r.files, r.bytes) for r in subtree_sizes(spark.createDataFrame(ENTRIES, SCHEMA)).collect()}
    files = [(p, s or 0) for p, d, s in ENTRIES if p is not None and not d]
    want = {p: [s for f, s in files if f.startswith(p + "/")] for p, d, _ in ENTRIES if d}
    want[""] = [s for _, s in files]
    assert got == {p: (len(s), sum(s)) for p, s in want.items()}


def test_intervals_hold_just_the_subtree(spark):
    rows = nested_sets(spark.createDataFrame(ENTRIES, SCHEMA)).collect()
    named = [p for p, _, _ in ENTRIES if p is not None]
    assert sorted(r.path for r in rows) == sorted(named)  # one row per entry, however deep
    assert sorted(r.enter for r in rows) == list(range(1, len(named) + 1))
    for r in rows:
        inside = {o.path for o in rows if r.enter < o.enter < r.leave}
        assert inside == {p for p in named if p.startswith(r.path + "/")}


def test_empty_tree(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert subtree_sizes(empty).collect() == [] and nested_sets(empty).collect() == []
