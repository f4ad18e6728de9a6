"""URL filters: exact rule membership by a cascade of Bloom filters, without joins.

A rule is a host and a path prefix (``example.net/en/``).  It fits its host, all subdomains and every path that starts with
its path; the longest fitting rule decides.  A url's candidate keys are its host's suffixes combined with its path's
prefixes of those lengths that rules have, so a rule fits exactly if one of the candidate keys is a listed key.

Membership is answered by Bloom filters in alternating levels.  Level 0 holds the listed keys L.  The corpus's complete key
universe U (all candidate keys of all urls) is known, so those of U without L that pass level 0 are level 1's members; the
listed keys that pass level 1 are level 2's, and so on until a level has no false positives.  A key of U is listed if the
first level that it fails is odd, or if it passes all and the last is even.  Level 0 gets a false-positive rate of about
|L|/|U|, so the whole cascade takes O(|L| log(|U|/|L|)) bits; they go into the plan as one literal a level.

A cascade may take ``MAX_BITS`` bits.  A list that would need more isn't sent to executors: then the candidate keys of the corpus's distinct
(host, path) pairs are joined to the list by a shuffle and the longest found is joined back, with the same result.

Defined results: a null url, or one without ``://``, has an empty host and path and fits no rule; a url without a path fits no
rule, as rule paths start with ``/``; repeated rows are judged alike; other columns pass through unless they carry the name
of an output column, which then replaces them; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, column, fresh, literal_array, materialize, others

#: A level of a cascade may take 4 MiB of the plan.
MAX_BITS = 1 << 25
WORD = 62
LATER_HASHES = 2
ADDED = ("host", "path", "rule", "verdict")


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    seed: int
    words: tuple[int, ...]

    def holds(self, key: Column) -> Column:
        """The key's bits are all set."""
        found = F.lit(True)
        stored = literal_array(self.words, "bigint")
        for i in range(self.hashes):
            at = position(key, self.seed, i, self.bits)
            word = F.element_at(stored, (F.floor(at / F.lit(WORD)) + 1).cast("int"))
            found = found & (F.call_function("shiftright", word, (at % WORD).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return found


def position(key: Column, seed: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed * 31 + i), key), F.lit(bits).cast("bigint"))


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, path_lengths: Sequence[int]) -> Column:
    """Host suffixes at label borders x path prefixes of the given lengths, longest first."""
    labels = F.split(host, "\\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.substring(path, 1, n) for n in sorted(set(path_lengths), reverse=True)]), lambda p: F.length(p) > 0)
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    return F.when((host == "") | (path == ""), F.array().cast("array<string>")).otherwise(F.array_distinct(keys))


def bits_for(n: int, hashes: int) -> int:
    return max(64, math.ceil(n * hashes / math.log(2)))


def first_hashes(n_listed: int, universe_size: int) -> int:
    """Hashes of level 0, for a false-positive rate of about the listed share of the universe."""
    return max(1, round(-math.log2(min(0.5, max(1e-9, n_listed / max(1, universe_size))))))


def build_level(members: DataFrame, n: int, hashes: int, seed: int) -> Level:
    """A filter over the column ``key`` of ``members``; what reaches the driver is its bits, ``MAX_BITS`` at most."""
    bits = bits_for(n, hashes)
    at = F.explode(F.array(*[position(F.col("key"), seed, i, bits) for i in range(hashes)])).alias("at")
    words = members.select(at).groupBy((F.floor(F.col("at") / WORD)).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % WORD).cast("int"))).alias("b"))
    stored = [0] * (bits // WORD + 1)
    for row in words.collect():
        stored[row["w"]] = row["b"]
    return Level(bits, hashes, seed, tuple(stored))


def rule_table(spark: SparkSession, listed: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(k,) for k in sorted(set(listed))], "key string")


def build_cascade(universe: DataFrame, listed: Sequence[str], universe_size: int) -> list[Level] | None:
    """``universe``: distinct keys (column ``key``) of the corpus.  Level 0's false positives over it are found in one
    distributed pass and kept in a table; the later levels read only that table and the list.  None if a level would exceed ``MAX_BITS``."""
    if not listed:
        return []
    inside, n = rule_table(universe.sparkSession, listed), len(set(listed))
    hashes = first_hashes(n, universe_size)
    if bits_for(n, hashes) > MAX_BITS:
        return None
    levels = [build_level(inside, n, hashes, 0)]
    outside = universe.where(levels[0].holds(F.col("key"))).join(inside, "key", "left_anti")
    sides = [materialize(outside.select("key"), "bloom-fp"), inside]
    depth = 0
    while True:
        depth += 1
        members = sides[(depth + 1) % 2]
        n = members.count()
        if not n:
            return levels
        if bits_for(n, LATER_HASHES) > MAX_BITS:
            return None
        levels.append(build_level(members, n, LATER_HASHES, depth))
        # those of the other side that pass this level are the next level's members
        sides[depth % 2] = sides[depth % 2].where(levels[-1].holds(F.col("key")))


def is_listed(key: Column, levels: Sequence[Level]) -> Column:
    """Exact for keys of the universe that the cascade was built over."""
    answer = F.lit(len(levels) % 2 == 1)
    for depth in range(len(levels) - 1, -1, -1):
        answer = F.when(~levels[depth].holds(key), F.lit(depth % 2 == 1)).otherwise(answer)
    return answer


def longest_listed(keys: Column, levels: Sequence[Level]) -> Column:
    """The longest of the keys that is listed, the first in order of several."""
    fits = F.filter(keys, lambda k: is_listed(k, levels)) if levels else F.array().cast("array<string>")
    return F.get(F.array_sort(F.transform(fits, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k")))), 0).getField("k")


def longest_joined(parsed: DataFrame, listed: Sequence[str], lengths: Sequence[int]) -> DataFrame:
    """(host, path, found) of the pairs that a listed key fits, by a join of keys; for lists beyond ``MAX_BITS``."""
    keys = parsed.distinct().select("host", "path", F.explode(candidate_keys(F.col("host"), F.col("path"), lengths)).alias("key"))
    hits = keys.join(rule_table(parsed.sparkSession, listed).hint("merge"), "key")
    return hits.groupBy("host", "path").agg(F.min(F.struct((-F.length("key")).alias("n"), "key")).alias("m")).select("host", "path", F.col("m.key").alias("found"))


def filter_urls(pages: DataFrame, block: Sequence[str], allow: Sequence[str], url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict.  ``rule``: the longest fitting rule or null; ``verdict``: that rule's, else
    ``default``.  A rule in both lists allows."""
    if bad := [r for r in [*block, *allow] if "/" not in r]:
        raise ValueError(f"rules need a path: {bad}")
    lengths = [len(r) - r.index("/") for r in [*block, *allow]]
    url = column(url_col)
    parsed = pages.select(host_of(url).alias("host"), path_of(url).alias("path"))
    universe = materialize(parsed.distinct().select(F.explode(candidate_keys(F.col("host"), F.col("path"), lengths)).alias("key")).distinct(), "url-keys")
    size = universe.count()
    names = fresh([*pages.columns, *ADDED], "host_", "path_", "block", "allow")
    at_host, at_path, *sides = names
    judged = pages.select("*", host_of(url).alias(at_host), path_of(url).alias(at_path))
    for name, listed in zip(sides, (block, allow), strict=True):
        levels = build_cascade(universe, listed, size)
        if levels is None:
            found = longest_joined(parsed, listed, lengths).toDF(at_host, at_path, name)
            judged = judged.join(found, [at_host, at_path], "left").select(*[column(c) for c in judged.columns], column(name))
        else:
            judged = judged.withColumn(name, longest_listed(candidate_keys(column(at_host), column(at_path), lengths), levels))
    blocked, allowed = (column(c) for c in sides)
    passes = allowed.isNotNull() & (blocked.isNull() | (F.length(allowed) >= F.length(blocked)))
    return judged.select(
        *others(pages, ADDED), column(at_host).alias("host"), column(at_path).alias("path"), F.when(passes, allowed).otherwise(blocked).alias("rule"),
        F.when(passes, "allow").when(blocked.isNotNull(), "block").otherwise(default).alias("verdict"),
    )
