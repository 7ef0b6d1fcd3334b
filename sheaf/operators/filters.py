"""Which entries stay: include and exclude globs, pruned subtrees, caps, user predicates."""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.globs import (
    at_or_above_regex,
    matches_any,
    path_or_name_regex,
    whole_regex,
)
from sheaf.functions.paths import ancestors, level, parent
from sheaf.operators.skew import lookup_join, measure
from sheaf.session import written

# Fixed value: the prefix that include patterns may omit.
OMITTABLE_PREFIX = "src/"


def trimmed(patterns: Sequence[str]) -> list[str]:
    return [p.strip(" \t") for p in patterns]


def include_match(path: Column, is_directory: Column, patterns: Sequence[str]) -> Column:
    """True for a directory, or a file some pattern selects; without patterns, for everything."""
    if not patterns:
        return F.lit(True)
    regex = path_or_name_regex(trimmed(patterns), OMITTABLE_PREFIX)
    return is_directory | F.rlike(path, F.lit(regex))


def exclude_match(path: Column, is_directory: Column, patterns: Sequence[str]) -> Column:
    """True if a pattern hits the path or its last name, or for a directory ``pattern/*`` does."""
    inside = [p + "/*" for p in patterns]
    hit = F.rlike(path, F.lit(path_or_name_regex(patterns)))
    return hit | (is_directory & matches_any(path, inside))


def hidden_match(path: Column, is_directory: Column, patterns: Sequence[str]) -> Column:
    """True if the entry or a directory above it is excluded, by one regex on the path.

    What ``pattern/*`` excludes lies below what ``pattern`` excludes, as paths are relative, so
    that rule needs a test of its own only where a backslash at the pattern's end takes the slash:
    such a pattern matches nothing itself.
    """
    hidden = F.rlike(path, F.lit(at_or_above_regex(patterns)))
    inside = [p + "/*" for p in patterns if p.endswith("\\")]
    if not inside:
        return hidden
    above = F.exists(ancestors(path), lambda a: matches_any(a, inside))
    return hidden | above | (is_directory & matches_any(path, inside))


def self_output_patterns(root: str, output: str | None) -> list[str]:
    """Patterns that keep a document written below its own input out of itself.

    The name alone is one of them, so a file of that name is left out anywhere in the tree.
    Both paths are absolute.
    """
    if not output:
        return []
    base = posixpath.normpath(root).rstrip("/") + "/"
    target = posixpath.normpath(output)
    if not target.startswith(base):
        return []
    return [target, target[len(base) :], posixpath.basename(target)]


def keep_entries(
    entries: DataFrame,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    own_output: Sequence[str] = (),
    prune: bool = True,
) -> DataFrame:
    """Apply the glob rules to ``path`` and ``is_directory``; exclusion wins. No shuffle."""
    kept = entries
    if include:
        kept = kept.where(include_match(F.col("path"), F.col("is_directory"), include))
    hidden = [*own_output, *trimmed(exclude)]
    if hidden:
        path = F.col("path")
        own = exclude_match(path, F.col("is_directory"), hidden)
        pruned = hidden_match(path, F.col("is_directory"), hidden)
        kept = kept.where(~(pruned if prune else own))
    return kept


def directories_of(paths: DataFrame) -> DataFrame:
    """Every directory that a path implies, once, with its own level.

    Parents are made distinct first, so the ancestors of a directory are exploded once rather
    than once per file in it.
    """
    parents = paths.select(parent(F.col("path")).alias("directory")).where("directory != ''")
    found = parents.distinct().select(
        F.explode(F.array_append(ancestors(F.col("directory")), F.col("directory"))).alias("path")
    )
    return found.distinct().select("path", level(F.col("path")).alias("level"))


def prune_dropped(entries: DataFrame, dropped: DataFrame) -> DataFrame:
    """Remove everything below the directories in ``dropped`` (column ``path``, written).

    For predicates on row attributes, which the ancestors' paths alone cannot decide. Only
    directories are exploded, and a file needs one lookup, of its parent.
    """
    homes = directories_of(entries).select("path")
    lines = homes.select(
        F.col("path").alias("home"),
        F.explode(F.array_append(ancestors(F.col("path")), F.col("path"))).alias("path"),
    )
    dead = (
        lookup_join(lines, dropped.select("path").distinct(), "path", spread_by="home")
        .select(F.col("home").alias("_home"), F.lit(True).alias("_dead"))
        .distinct()
    )
    keyed = entries.withColumn("_home", parent(F.col("path")))
    return lookup_join(keyed, dead, "_home", "left").where("_dead is null").drop("_home", "_dead")


def keep_by_predicates(
    entries: DataFrame, predicates: Sequence[Callable[[DataFrame], Column]]
) -> DataFrame:
    """Keep rows that every user predicate accepts; a refused directory hides its subtree."""
    if not predicates:
        return entries
    verdict = reduce(
        Column.__and__, [F.coalesce(p(entries), F.lit(False)) for p in predicates]
    )
    judged = entries.withColumn("_keep", verdict)
    refused = judged.where(F.col("is_directory") & ~F.col("_keep")).select("path")
    dropped = written(refused, "dropped")
    kept = judged.where("_keep").drop("_keep")
    return prune_dropped(kept, dropped)


def within_caps(
    path: Column, max_depth: int | None = None, max_path_bytes: int | None = None
) -> Column:
    """Depth and path length limits of the listing, if there are any."""
    deep = F.lit(True) if max_depth is None else level(path) < max_depth
    long = F.lit(True) if max_path_bytes is None else F.octet_length(path) < max_path_bytes
    return deep & long


def too_large(size: Column, cap: int | None = None) -> Column:
    return F.lit(False) if cap is None else size > cap


def match_patterns(paths: DataFrame, patterns: DataFrame) -> DataFrame:
    """The rows of ``paths`` (path) with each row of ``patterns`` (pattern_id, pattern) that fits.

    Globs match the whole path, A-Z in either case; empty and null patterns match nothing. Each
    pattern is looked up by its literal beginning or end, the longer of both, up to
    ``EDGE`` characters; a path has one key for each kind and length of these that occur, so there
    is one equi-join, and the glob decides what meets there. Patterns are broadcast if they are
    measured to be few.
    """
    keyed = written(patterns.select("pattern_id", "pattern").mapInPandas(_keyed_patterns, _KEYED), "patterns")
    kinds = keyed.select("_kind", "_chars").distinct().collect()  # at most 2 * EDGE + 1
    small = measure(keyed)[1]
    lowered = F.translate("path", _UPPER, _UPPER.lower())

    def key(kind: str, chars: int) -> Column:
        cut = F.substring(lowered, 1, chars) if kind == "head" else F.right(lowered, F.lit(chars))
        return F.struct(F.lit(kind).alias("_kind"), F.lit(chars).alias("_chars"), cut.alias("_edge"))

    if not kinds:
        return paths.withColumn("pattern_id", F.lit(None).cast(dict(patterns.dtypes)["pattern_id"])).where("false")
    edges = F.array(*(key(k._kind, k._chars) for k in sorted(kinds)))
    spread = paths.withColumn("_at", F.explode(edges)).select(*paths.columns, "_at.*")
    found = spread.join(F.broadcast(keyed) if small else keyed, ["_kind", "_chars", "_edge"])
    found = found.where(F.rlike("path", F.col("_regex")))
    kind = dict(patterns.dtypes)["pattern_id"]
    return found.select(*paths.columns, F.col("pattern_id").cast(kind).alias("pattern_id"))


EDGE = 12
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_KEYED = "pattern_id string, _kind string, _chars int, _edge string, _regex string"


def _keyed_patterns(frames):
    """Each pattern's regex, and the literal edge it is looked up by."""
    fold = str.maketrans(_UPPER, _UPPER.lower())
    for frame in frames:
        rows = []
        for number, pattern in zip(frame.pattern_id.astype(str), frame.pattern):
            if not pattern:
                continue
            special = [k for k, c in enumerate(pattern) if c in "*?[\\"]
            head = pattern[: special[0]] if special else pattern
            # Behind a bracket or a backslash the end is not looked into.
            plain = not any(c in pattern for c in "[\\")
            tail = pattern[special[-1] + 1 :] if special and plain else ""
            kind, edge = ("head", head[:EDGE]) if len(head) >= len(tail) else ("tail", tail[-EDGE:])
            edge = edge.translate(fold)
            rows.append((number, kind if edge else "head", len(edge), edge, whole_regex([pattern])))
        yield pd.DataFrame(rows, columns=["pattern_id", "_kind", "_chars", "_edge", "_regex"])
