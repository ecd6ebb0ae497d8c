"""Joins whose condition is not an equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators.ranking import broadcast_if_small
from attesta.session import cut_lineage


def normalized_path(path: Column) -> Column:
    """Forward slashes only, cut at the first line or fragment marker."""
    return F.split(F.replace(path, F.lit("\\"), F.lit("/")), "[:#]", 2)[0]


def _tails(parts: Column) -> Column:
    """The last 1, 2, ... components of a path, without the whole path."""
    n = F.size(parts)
    some = F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.array_join(F.slice(parts, n - k + 1, k), "/"))
    return F.when(n > 1, some).otherwise(F.array().cast("array<string>"))


def suffix_pairs(short: DataFrame, long: DataFrame) -> DataFrame:
    """``short, long``: distinct paths of which the first ends the second.

    A path of several components can only end another one whose last components equal all but its
    first, so those are the join key: one key for a short path, one for each component of a long
    one; the end itself is verified. A bare name ends inside the last component: it meets the
    endings of the distinct names, of those lengths only that a bare name has. An empty path ends nothing.

    Both sides may hold any number of paths, and their sizes are badly estimated below ``explode``,
    so they are merged and never broadcast; only the distinct lengths are.
    """
    s = short.where("short <> ''").withColumn("_parts", F.split("short", "/"))
    l = long.withColumn("_parts", F.split("long", "/"))
    keyed = s.where(F.size("_parts") > 1).select("short", F.array_join(F.slice("_parts", F.lit(2), F.size("_parts") - 1), "/").alias("_key"))
    deep = l.select("long", F.explode(_tails(F.col("_parts"))).alias("_key")).join(keyed.hint("merge"), "_key").where(F.endswith("long", "short")).select("short", "long")
    named = l.select("long", F.element_at("_parts", -1).alias("_name"))
    names = s.where(F.size("_parts") == 1).select("short")
    lengths = names.select(F.char_length("short").alias("_n")).distinct()
    sized = named.select("_name").distinct().where("_name <> ''").select("_name", F.explode(F.sequence(F.lit(1), F.char_length("_name"))).alias("_n"))
    endings = sized.join(F.broadcast(lengths), "_n").select("_name", F.right("_name", F.col("_n")).alias("short"))
    bare = endings.join(names.hint("merge"), "short")
    return deep.unionByName(named.join(bare.hint("merge"), "_name").select("short", "long"))


def frames_to_code(frames: DataFrame, code: DataFrame) -> DataFrame:
    """Stack frames and code whose paths are suffixes of one another, without a cross join.

    ``frames`` has ``path``, ``code`` has ``locator``. Only distinct paths are compared, in both
    directions, and each side's are written once.
    """
    f = frames.withColumn("_fp", F.replace(F.col("path"), F.lit("\\"), F.lit("/")))
    c = code.withColumn("_cp", normalized_path(F.col("locator")))
    fp, cp = cut_lineage(f.select("_fp").distinct()), cut_lineage(c.select("_cp").distinct())
    in_code = suffix_pairs(fp.select(F.col("_fp").alias("short")), cp.select(F.col("_cp").alias("long"))).select(F.col("short").alias("_fp"), F.col("long").alias("_cp"))
    in_frame = suffix_pairs(cp.select(F.col("_cp").alias("short")), fp.select(F.col("_fp").alias("long"))).select(F.col("long").alias("_fp"), F.col("short").alias("_cp"))
    pairs = in_code.unionByName(in_frame).distinct()
    return f.join(pairs.hint("merge"), "_fp").join(c.hint("merge"), "_cp").select(*frames.columns, *code.columns)


def alias_lookup(values: DataFrame, aliases: DataFrame, column: str = "value") -> DataFrame:
    """Resolve names to domains case-insensitively, with ``_`` and ``-`` interchangeable.

    ``aliases`` (``alias, domain_id``) is broadcast when it proves small.
    """
    fold = lambda c: F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit("-"))
    table = aliases.select(fold(F.col("alias")).alias("_key"), "domain_id").groupBy("_key").agg(F.min("domain_id").alias("domain_id"))
    return values.withColumn("_key", fold(F.col(column))).join(broadcast_if_small(table), "_key", "left").drop("_key")
