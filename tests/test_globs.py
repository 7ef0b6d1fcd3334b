"""The glob compiler against the C library's matcher, on fixed and random patterns."""

import ctypes
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheaf.functions.globs import glob_alternation, matches_any
from sheaf.operators.filters import exclude_match, hidden_match, include_match

LIBC = ctypes.CDLL(None)
CASEFOLD = 1 << 4


def libc_match(pattern: str, value: str) -> bool:
    if not pattern:
        return False
    p, v = pattern.encode(), value.encode()
    return LIBC.fnmatch(p, v, 0) == 0 or LIBC.fnmatch(p, v, CASEFOLD) == 0


def compiled_match(pattern: str, value: str) -> bool:
    return re.compile(glob_alternation(pattern)).fullmatch(value) is not None


PATTERNS = ["*.c", "a?c", "[a-c]x", "[!a-c]x", "[^a]x", "[]x]", "[!]]", "[a", "a\\*b", "a\\", "",
            "*", "**/x", "[[:digit:]]*", "[[:upper:]]", "[a-]", "[--0]", "[z-a]", "src/*", ".*",
            "[[:nope:]]", "[Z-a]", "\\[a]", "a[", "[\\]]", "?", "[a-c]*[!0-9]"]
VALUES = ["main.c", "MAIN.C", "abc", "a/c", "bx", "Bx", "dx", "]", "x", "[a", "a*b", "a\\", "",
          "src/a/b.c", ".git", "7up", "A", "-", "/", "_", "b]", "ab1", "abz", "a\nb", "é"]


def test_fixed_patterns_match_like_libc():
    for pattern in PATTERNS:
        for value in VALUES:
            if value.isascii():
                assert compiled_match(pattern, value) == libc_match(pattern, value), (pattern, value)


@settings(max_examples=6000, deadline=None)
@given(st.text("aAbBzZ019*?[]!^-\\/._ :", max_size=8), st.text("aAbBzZ019[]!^-\\/._ :", max_size=6))
def test_random_patterns_match_like_libc(pattern, value):
    if any(mark in pattern for mark in ("[:", "[.", "[=")):
        return  # classes are covered by the fixed patterns
    assert compiled_match(pattern, value) == libc_match(pattern, value)


def test_java_regex_agrees(spark):
    values = spark.createDataFrame([(v,) for v in VALUES], "v string")
    columns = [matches_any(F.col("v"), [p]).alias(str(n)) for n, p in enumerate(PATTERNS)]
    for row in values.select("v", *columns).collect():
        for n, pattern in enumerate(PATTERNS):
            assert row[str(n)] == compiled_match(pattern, row.v), (pattern, row.v)


PATHS = ["main.c", "src/main.c", "src/a/b.h", "a/build/x.c", "build", "build/x", "a/.git/config",
         "x\\y.c", "a/b.log/c", "A/B.LOG", "abuild/x", "a/b/build", "src", "src/src/q", "deep/a/b/c/d.c",
         "a*b/c", "node_modules", "project/node_modules", "project/node_modules/x/y.js"]
RULES = [["*.c"], ["build"], ["a/*"], [".git", "*.log"], ["node_modules"], ["[!a]*"], ["?"], ["*"],
         ["src/q"], ["a\\*b"], ["b*d"], ["*/b*"], ["main.c", "b.?"], ["[a/]b*"], [""]]


def base(path):
    return re.split(r"[/\\]", path)[-1]


def excluded(path, is_dir, rules):
    return any(
        libc_match(p, path) or libc_match(p, base(path)) or (is_dir and libc_match(p + "/*", path))
        for p in rules
    )


def test_path_rules_match_their_definition(spark):
    """The single-regex forms against rule by rule evaluation with the C library."""
    table = spark.createDataFrame(
        [(p, d) for p in PATHS for d in (False, True)], "path string, d boolean"
    )
    path, is_dir = F.col("path"), F.col("d")
    for rules in RULES:
        rows = table.select(
            "path",
            "d",
            include_match(path, is_dir, rules).alias("inc"),
            exclude_match(path, is_dir, rules).alias("exc"),
            hidden_match(path, is_dir, rules).alias("hid"),
        ).collect()
        for r in rows:
            candidates = [r.path, base(r.path)]
            if r.path.startswith("src/"):
                candidates.append(r.path[4:])
            included = r.d or any(libc_match(p, c) for p in rules for c in candidates)
            assert r.inc == included, (rules, r)
            assert r.exc == excluded(r.path, r.d, rules), (rules, r)
            parts = r.path.split("/")
            above = ["/".join(parts[:n]) for n in range(1, len(parts))]
            hidden = excluded(r.path, r.d, rules) or any(excluded(a, True, rules) for a in above)
            assert r.hid == hidden, (rules, r)
