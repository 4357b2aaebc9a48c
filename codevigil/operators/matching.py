"""Joins on patterns and substrings, as equi-joins on a key both sides must share, then an exact check.

A path pattern is keyed by something every matching path holds: its literal
directory, one of its literal segments, or its file suffix. A needle is keyed by the
rarest of its pieces, of four letters or more. No side is ever paired with all rows of the other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import scope_of
from ..functions.paths import (
    glob_regex_column,
    has_wildcard,
    norm_scope_path,
    path_matches,
    plan_path_matches,
    right_anchor_regex_column,
)
from ..session import materialise

ALL = "all"


def ancestors(path: Column) -> Column:
    """The path itself and every directory above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, F.lit(1), n)))


def _suffix_key(text: Column) -> Column:
    return F.regexp_extract(text, r"(\.[^./]+)$", 1)


def path_keys(path: Column, directories: bool) -> Column:
    """Every key a pattern that matches this path can have."""
    segments = F.transform(F.array_distinct(F.split(path, "/")), lambda s: F.concat(F.lit("s:"), s))
    ends = F.array(F.concat(F.lit("e:"), _suffix_key(path)), F.lit(ALL))
    if not directories:
        return F.concat(segments, ends)
    return F.concat(segments, ends, F.transform(ancestors(path), lambda a: F.concat(F.lit("d:"), a)))


def wildcard_keys(pattern: Column) -> Column:
    """Keys every path matching the pattern holds: its literal segments, else its literal suffix, else all."""
    literal = F.filter(F.split(pattern, "/"), lambda s: (s != "") & ~has_wildcard(s))
    suffix = F.regexp_extract(pattern, r"(\.[^./*?\[\]]+)$", 1)
    return (
        F.when(F.size(literal) > 0, F.transform(literal, lambda s: F.concat(F.lit("s:"), s)))
        .when(suffix != "", F.array(F.concat(F.lit("e:"), suffix)))
        .otherwise(F.array(F.lit(ALL)))
    )


def holds_literals(path: Column, pattern: Column) -> Column:
    """Every run of literal characters of the pattern occurs in the path, as in all paths it matches; true for patterns with classes.

    Asked before the regular expressions, which are compiled anew whenever the pattern changes from row to row.
    """
    runs = F.filter(F.split(pattern, r"[*?]+"), lambda r: r != "")
    return F.contains(pattern, F.lit("[")) | F.forall(runs, lambda r: F.contains(path, r))


def pattern_pairs(paths: DataFrame, patterns: DataFrame, mode: str = "any") -> DataFrame:
    """Matching (path, pattern row) pairs per repo and snapshot.

    ``mode``: ``any`` (directory, glob or right-anchored), ``plan`` (glob only with a
    wildcard, else directory), ``overlay`` (rule_path as directory and rule_glob as
    glob, both optional). Equal patterns are matched once. Of the keys a pattern could
    use, it takes the one fewest paths hold.
    """
    scope = scope_of(paths, patterns)
    ident = ["rule_path", "rule_glob"] if mode == "overlay" else ["pattern"]
    clean = paths.withColumn("_path", norm_scope_path(F.col("path"))).where("_path <> ''")
    left = clean.withColumn("_key", F.explode(path_keys(F.col("_path"), mode != "any")))
    bare = norm_scope_path(F.col(ident[0]))
    directory = F.array(F.concat(F.lit("d:"), bare))
    if mode == "overlay":
        glob = F.coalesce("rule_glob", F.lit(""))
        keys = F.when(bare != "", directory).when(glob != "", wildcard_keys(glob)).otherwise(F.array(F.lit(ALL)))
    else:
        keys = F.when(has_wildcard(bare), wildcard_keys(bare)).otherwise(directory if mode == "plan" else wildcard_keys(bare))
    once = patterns.select(*scope, *ident).distinct().withColumns({"_pattern": bare, "_keys": keys})
    if mode != "overlay":
        once = once.where("_pattern <> ''")
    offered = once.select(*scope, *ident, F.explode("_keys").alias("_key"))
    held = left.groupBy(*scope, "_key").agg(F.count(F.lit(1)).alias("_n"))
    best = offered.join(held, [*scope, "_key"], "left").groupBy(*scope, *ident).agg(
        F.min_by("_key", F.struct(F.coalesce("_n", F.lit(0)), F.col("_key"))).alias("_key")
    )
    pairs = left.join(best.withColumn("_pattern", norm_scope_path(F.col(ident[0]))), [*scope, "_key"])
    path = F.col("_path")
    if mode == "overlay":
        rule_path, rule_glob = F.col("_pattern"), F.coalesce("rule_glob", F.lit(""))
        in_path = (rule_path == "") | (path == rule_path) | path.startswith(F.concat(rule_path, F.lit("/")))
        globbed = F.rlike(path, glob_regex_column(rule_glob)) | F.rlike(path, right_anchor_regex_column(rule_glob))
        check = in_path & ((rule_glob == "") | F.when(holds_literals(path, rule_glob), globbed).otherwise(False))
    elif mode == "plan":
        check = F.when(holds_literals(path, F.col("_pattern")), plan_path_matches(path, F.col("_pattern"))).otherwise(False)
    else:
        check = F.when(holds_literals(path, F.col("_pattern")), path_matches(path, F.col("_pattern"))).otherwise(False)
    matched = pairs.where(check).drop("_key", "_path", "_pattern")
    return matched.join(patterns.drop("path"), [*scope, *ident])


def pieces(text: Column, size: int) -> Column:
    """Distinct runs of ``size`` characters, found in one scan."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


PIECE = 4
#: Lengths of pieces; those above ``PIECE`` are for long pieces only.
SIZES = (*range(1, PIECE + 1), 2 * PIECE, 4 * PIECE)
#: 64-bit words of the filter that says which pieces no needle has.
FILTER_WORDS = 1 << 14


def _places(piece: Column) -> list[tuple[Column, Column]]:
    """(word, bit) of the two filter bits of a piece."""
    h = F.xxhash64(piece)
    return [(F.shiftright(h, shift).bitwiseAND(F.lit(FILTER_WORDS - 1)).cast("int"), F.shiftright(h, shift + 16).bitwiseAND(F.lit(63)).cast("int")) for shift in (0, 32)]


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def offered_pieces(needles: DataFrame, needle_col: str, keys: Sequence[str], long: bool = False) -> DataFrame:
    """(keys, needle, _key): the pieces of each distinct needle; a short needle is its own.

    ``long`` needles have pieces of the largest of ``SIZES`` they hold, at every half of it and at the end, which cover
    the needle.
    """
    once = needles.select(*keys, needle_col).where(F.length(needle_col) > 0).distinct()
    needle, size = F.col(needle_col), F.length(needle_col)
    own = F.when(size < PIECE, F.array(needle))
    if not long:
        return once.select(*keys, needle_col, F.explode(own.otherwise(pieces(needle, PIECE))).alias("_key"))
    own = own.when(size < 2 * PIECE, pieces(needle, PIECE))

    def spread(n: int) -> Column:
        starts = F.concat(F.sequence(F.lit(1), size - n + 1, F.lit(n // 2)), F.array(size - n + 1))
        return F.array_distinct(F.transform(starts, lambda at: F.substr(needle, at, F.lit(n))))

    own = own.when(size < 4 * PIECE, spread(2 * PIECE)).otherwise(spread(4 * PIECE))
    return once.select(*keys, needle_col, F.explode(own).alias("_key"))


def piece_filter(offered: DataFrame) -> DataFrame:
    """One row (_bits, _sizes): a Bloom filter of the offered pieces in ``FILTER_WORDS`` words, whatever their number, and their lengths."""
    spots = F.array(*[F.struct(w.alias("w"), _bit(b).alias("bit")) for w, b in _places(F.col("_key"))])
    words = offered.select(F.inline(spots)).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    every = offered.sparkSession.range(FILTER_WORDS).select(F.col("id").cast("int").alias("w"))
    dense = every.join(words, "w", "left").select(F.struct("w", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("x"))
    bits = dense.agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["bits"]).alias("_bits"))
    sizes = offered.agg(F.collect_set(F.length("_key")).alias("_sizes"))
    return bits.join(F.broadcast(sizes))


def hay_pieces(hay: DataFrame, hay_col: str, keys: Sequence[str], wanted: DataFrame | None = None) -> DataFrame:
    """Narrow rows (keys, _hay, _key): the distinct runs of each text of the lengths in ``SIZES``; its hash names the text.

    Runs that the filter rules out are dropped before they become rows, and lengths that no needle piece has
    are not cut; so the rows follow the needles' hits, not the texts. Without a filter all runs are given.
    """
    none = F.array().cast("array<string>")
    if wanted is None:
        every = F.concat(*[pieces(F.col(hay_col), n) for n in range(1, PIECE + 1)])
        return hay.where(F.col(hay_col).isNotNull()).select(*keys, F.xxhash64(hay_col).alias("_hay"), F.explode(every).alias("_key"))

    def hit(piece: Column) -> Column:
        first, second = [F.get(F.col("_bits"), w).bitwiseAND(_bit(b)) != 0 for w, b in _places(piece)]
        return first & second

    # ``wanted`` is one row of fixed size.
    texts = hay.select(*keys, F.col(hay_col).alias("_text")).join(F.broadcast(wanted), F.col("_text").isNotNull())
    runs = F.concat(*[F.when(F.array_contains("_sizes", n), pieces(F.col("_text"), n)).otherwise(none) for n in SIZES])
    return texts.select(*keys, F.xxhash64("_text").alias("_hay"), F.explode(F.filter(runs, hit)).alias("_key"))


def rarest_pieces(held: DataFrame, offered: DataFrame, needle_col: str, keys: Sequence[str]) -> DataFrame:
    """(keys, needle, _key): of each distinct needle's pieces, offered or still to be cut, the one that fewest texts hold."""
    if "_key" not in offered.columns:
        offered = offered_pieces(offered, needle_col, keys)
    counted = held.join(offered.select(*keys, "_key").distinct(), [*keys, "_key"], "left_semi")
    counted = counted.groupBy(*keys, "_key").agg(F.count(F.lit(1)).alias("_n"))
    rarity = F.struct(F.coalesce("_n", F.lit(0)), F.col("_key"))
    return offered.join(counted, [*keys, "_key"], "left").groupBy(*keys, needle_col).agg(F.min_by("_key", rarity).alias("_key"))


def substring_pairs(
    hay: DataFrame, hay_col: str, needles: DataFrame, needle_col: str, keys: Sequence[str] = (), store: bool = False, long: bool = False
) -> DataFrame:
    """(hay row, needle row) pairs where the needle occurs in the hay text; equal on ``keys``.

    A needle meets the texts that hold its rarest piece; a Bloom filter of all needles' pieces keeps the other
    pieces of the texts from becoming rows. Only hashes of texts travel with
    the pieces; each text is fetched once for the exact check, so equal hashes cannot make
    or lose a pair. Null and empty needles and null texts give no pairs; repeated rows on
    either side each give theirs. With ``store`` the pieces of the texts are stored, instead of being cut
    once to be counted and once to be joined; for many short texts such as paths. With ``long``, needles of eight
    or more characters meet texts by longer pieces: four characters of a path or a number are common to very many
    texts once there are many. The texts are then cut once more per length.
    """
    offered = offered_pieces(needles, needle_col, keys, long)
    held = hay_pieces(hay, hay_col, keys, piece_filter(offered))
    if store:
        held = materialise(held, "pieces")
    best = rarest_pieces(held, offered, needle_col, keys)
    likely = held.join(best, [*keys, "_key"]).select(*keys, "_hay", needle_col).distinct()
    texts = hay.withColumn("_hay", F.xxhash64(hay_col)).join(likely, [*keys, "_hay"])
    found = texts.where(F.contains(F.col(hay_col), F.col(needle_col))).drop("_hay")
    return found.join(needles, [*keys, needle_col])
