"""Symbolic links of an entry table: resolve, follow with cycle cut, read through.

An entry table has ``path``, ``is_directory``, ``is_symlink``, ``size`` and ``link_target`` (a path
of the same table). A directory is identified by its own, physical path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.paths import ancestors, target_path
from sheaf.functions.reports import said
from sheaf.operators.filters import within_caps
from sheaf.operators.skew import lookup_join, measure
from sheaf.session import written


def placed_targets(entries: DataFrame, root: str | None = None) -> DataFrame:
    """Entries whose ``link_target`` is what the file system gives, with paths of the table instead.

    Relative targets (``..``, ``.``, empty segments) are taken from the link's directory, absolute
    ones have to lie below ``root``; links that lead outside get NULL and so lead nowhere.
    """
    return entries.withColumn("link_target", target_path(F.col("path"), F.col("link_target"), root))


def skip_links(entries: DataFrame) -> DataFrame:
    return entries.where(~F.col("is_symlink"))


def _chain_ends(jumps: DataFrame) -> DataFrame:
    """``(path, target, hops)`` per link that other links lead to, with its chain shortened.

    Each round doubles the length covered, so the logarithm of the number of links bounds the
    rounds; they end as soon as no such link leads to another. A chain that leads into itself ends
    at one of its links.
    """
    jumps = written(jumps.select("path", "target", F.lit(1).cast("long").alias("hops")), "jumps")
    count, small = measure(jumps)
    for _ in range(count.bit_length() if count else 0):
        onward = jumps.select(
            F.col("path").alias("target"),
            F.col("target").alias("_next"),
            F.col("hops").alias("_more"),
        )
        moving = jumps.where("path <> target").join(onward.select("target"), "target", "left_semi")
        if moving.isEmpty():
            break
        moved = lookup_join(jumps, onward, "target", "left", small=small).select(
            "path",
            F.coalesce("_next", "target").alias("target"),
            F.least(F.lit(1 << 40), F.col("hops") + F.coalesce("_more", F.lit(0))).alias("hops"),
        )
        jumps = written(moved, "jumps")
    return jumps


def _settled(links: DataFrame, entries: DataFrame, max_hops: int | None) -> DataFrame:
    """Where each of ``links`` (path, target) ends: ``(path, target, target_is_directory,
    target_size)``, NULLs if at no entry that is not a link.

    What each distinct target stands for is settled first, so a target of many links is settled
    once; then every link looks its target up.
    """
    _, small = measure(links)
    named = links.where("target is not null")
    targets = named.select("target").distinct()
    # Links that are targets of links; usually none.
    jumps = named.join(targets.select(F.col("target").alias("path")), "path", "left_semi")
    ends = _chain_ends(jumps).select(
        F.col("path").alias("target"), F.col("target").alias("_end"), "hops"
    )
    places = entries.where("not is_symlink").select(
        F.col("path").alias("_end"),
        F.col("is_directory").alias("target_is_directory"),
        F.col("size").alias("target_size"),
    )
    settled = targets.join(ends, "target", "left").withColumn("_end", F.coalesce("_end", "target"))
    if max_hops is not None:
        settled = settled.where(F.col("hops").isNull() | (F.col("hops") < max_hops))
    found = lookup_join(settled, places, "_end", spread_by="target", small=small).drop("hops")
    resolved = lookup_join(named, found, "target", "left", small=small).select(
        "path", F.col("_end").alias("target"), "target_is_directory", "target_size"
    )
    unnamed = links.where("target is null").select("path")
    return resolved.unionByName(unnamed, allowMissingColumns=True)


def resolve_links(entries: DataFrame, max_hops: int | None = None) -> DataFrame:
    """``(path, target, target_is_directory, target_size)`` per link; NULLs if it leads nowhere.

    A target may itself lead through links to directories: such a one is replaced by where that
    link ends, and the links are settled again. Each round takes a part of every such target away,
    so their depth bounds the rounds. With ``max_hops``, longer chains of links lead nowhere.
    """
    links = written(
        entries.where("is_symlink").select("path", F.col("link_target").alias("target")), "links"
    )
    while True:
        resolved = _settled(links, entries, max_hops)
        resolved = written(resolved, "resolved-links")
        lost = resolved.where("target is null").select("path")
        ways = resolved.where("target_is_directory").select(
            F.col("path").alias("_above"), F.col("target").alias("_way")
        )
        rest = F.substring(F.col("target"), F.length("_above") + 1, F.length("target"))
        passed = (
            links.where("target is not null")
            .join(lost, "path", "left_semi")
            .withColumn("_above", F.explode(ancestors(F.col("target"))))
            .join(ways, "_above")
            .groupBy("path")
            .agg(F.max(F.struct(F.length("_above"), F.concat("_way", rest).alias("t"))).alias("m"))
            .select("path", F.col("m.t").alias("_through"))
        )
        passed = written(passed, "through")
        if passed.isEmpty():
            return resolved
        moved = links.join(passed, "path", "left")
        links = written(moved.select("path", F.coalesce("_through", "target").alias("target")), "links")


def follow_links(
    entries: DataFrame,
    max_depth: int | None = None,
    resolved: DataFrame | None = None,
    max_path_bytes: int | None = None,
) -> DataFrame:
    """The listing with links followed: ``path`` (logical), ``physical_path``, ``is_directory``,
    ``is_symlink``, ``size``, ``is_cycle``.

    A link to a directory lists all below its target under its own path. A directory that is
    already among those entered on the way to it is listed once more, marked ``is_cycle``, and
    not entered. Each round takes all links at once and appends whole subtrees with one equi-join
    on the target, so the number of rounds is the nesting of links, not the depth of the tree.
    """
    resolved = resolve_links(entries) if resolved is None else resolved
    plain = entries.where("not is_symlink").select(
        "path",
        "is_directory",
        "is_symlink",
        "size",
        F.lit(None).cast("string").alias("target"),
    )
    linked = (
        entries.where("is_symlink")
        .select("path", "is_symlink", "size")
        .join(resolved, "path")  # unique on both sides
        .select(
            "path",
            F.coalesce("target_is_directory", F.lit(False)).alias("is_directory"),
            "is_symlink",
            F.coalesce("target_size", "size").alias("size"),
            "target",
        )
    )
    root = F.array(F.lit(""))
    start = plain.unionByName(linked).withColumn(
        "entered", F.concat(root, ancestors(F.col("path")))
    )
    listing = written(_with_descent(start.withColumn("physical", F.col("path"))), "listing")
    caps = within_caps(F.col("path"), max_depth, max_path_bytes)
    steps = [listing.where(caps)]
    while True:
        frontier = steps[-1].where("descend").select(
            F.col("path").alias("link"), F.col("here").alias("above"), "entered"
        )
        count, small = measure(frontier)
        if not count:
            break
        steps.append(written(_descend(frontier, small, listing).where(caps), "follow"))
    return reduce(DataFrame.unionByName, steps).select(
        "path",
        F.col("here").alias("physical_path"),
        "is_directory",
        "is_symlink",
        "size",
        "is_cycle",
    )


def _with_descent(rows: DataFrame) -> DataFrame:
    """Decide for each row whether it is a cut cycle or a link to go down."""
    here = F.when(F.col("is_directory") & F.col("is_symlink"), F.col("target")).otherwise(
        F.col("physical")
    )
    cycle = F.col("is_directory") & F.array_contains(F.col("entered"), F.col("here"))
    return (
        rows.withColumn("here", here)
        .withColumn("is_cycle", cycle)
        .withColumn(
            "descend", F.col("is_directory") & F.col("is_symlink") & ~F.col("is_cycle")
        )
        .withColumn("entered", F.when(F.col("descend"), F.array_append("entered", F.col("here"))))
        .drop("physical")
    )


def _descend(frontier: DataFrame, small: bool, listing: DataFrame) -> DataFrame:
    """All below the targets of the links in ``frontier``, each under its link's path."""
    entries = listing.select("path", "is_directory", "is_symlink", "size", "target")
    below = entries.withColumn("above", F.explode(ancestors(F.col("path"))))
    if small:
        joined = below.join(F.broadcast(frontier), "above")
    else:
        # What lies below a target is dealt over pieces before it meets that target's links.
        wanted = frontier.select("above").distinct()
        reduced = written(lookup_join(below, wanted, "above"), "below")
        joined = lookup_join(reduced, frontier, "above")
    rest = F.substring(F.col("path"), F.length("above") + 2, F.length("path"))

    def physical(directory: Column) -> Column:
        return F.concat(F.col("above"), F.lit("/"), directory)

    between = F.transform(ancestors(F.col("rest")), physical)
    rows = (
        joined.withColumn("rest", rest)
        .withColumn("between", between)
        .where(~F.arrays_overlap("entered", "between"))
        .select(
            F.concat(F.col("link"), F.lit("/"), F.col("rest")).alias("path"),
            F.col("path").alias("physical"),
            "is_directory",
            "is_symlink",
            "size",
            "target",
            F.concat("entered", "between").alias("entered"),
        )
    )
    return _with_descent(rows)


def contents_through_links(
    kept: DataFrame, entries: DataFrame, contents: DataFrame, max_hops: int | None = None
) -> DataFrame:
    """The files in ``kept`` with ``content``, a link with its target's; NULL if it leads nowhere.

    Links resolve against all ``entries``. ``size`` stays the entry's own, for a link the length
    of its target's name. Only links are looked up, so regular files meet their own content in one
    join on ``path``, and a target of many links is copied per piece of its links, not gathered.
    """
    files = kept.where("not is_directory")
    columns = [*files.columns, "content"]
    own = files.where("not is_symlink").join(contents, "path", "left")
    resolved = resolve_links(entries, max_hops)
    links = written(files.where("is_symlink").join(resolved, "path"), "links")
    # A link to a directory opens but yields nothing to read.
    empty = links.where("target is null or target_is_directory").withColumn(
        "content", F.when(F.col("target_is_directory"), F.lit(b""))
    )
    sources = contents.select(F.col("path").alias("target"), "content")
    readable = links.where("not target_is_directory")
    _, small = measure(links)
    sizes = readable.groupBy("target").agg(F.max("target_size").alias("bytes"))
    # A target that is listed but has no content row is unreadable, not gone: its content is NULL.
    through = lookup_join(readable, sources, "target", "left", small=small, sizes=sizes)
    return (
        own.select(*columns)
        .unionByName(empty.select(*columns))
        .unionByName(through.select(*columns))
    )


def link_diagnostics(followed: DataFrame, resolved: DataFrame) -> DataFrame:
    """``(path, code, message)`` for cut cycles and links that lead nowhere."""
    cycles = followed.where("is_cycle").select(
        "path", F.lit("cycle").alias("code"), said("cycle", F.col("physical_path"))
    )
    lost = resolved.where("target is null").select(
        "path", F.lit("unresolvable_link").alias("code"), said("unresolvable_link", F.col("path"))
    )
    return cycles.unionByName(lost)
