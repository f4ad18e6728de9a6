"""Spelling variants by pairless wildcard groups.

Words are the runs of letters in the texts, A-Z lower-cased; those of ``min_chars`` code points or more that occur ``min_count`` times or more are the vocabulary.
Two of them are near if one inserted, deleted or replaced code point makes one of the other.  A word's form is its commonest near word (ties: the smallest in
code-point order) if that occurs ``ratio`` times as often or more; the root is what forms lead to.

1. Words are counted with partial aggregation, one row a distinct word and task.
2. Replacements: a word gives a key for each position, the word with a wildcard there.  Words that differ there, and only there, share exactly that key, so a group's size and its
   two commonest words are all that its members need: the count of the others, and the commonest other (the second for the first, else the first).
   Both come from one window over the group; a group never becomes pairs.
3. Indels: a word's distinct deletions meet the vocabulary by a join on the shorter word.  A word has as many deletions as letters at most, so these links are
   no more than the vocabulary's letters; each side gets the count and its commonest partner.
4. Both are combined by word: counts are added, the commonest near word is the smaller of (-count, word).
5. Forms at least double the count when ``ratio`` is 2, so a chain has fewer than 64 steps; roots are found by following whole paths of earlier rounds, six rounds at most.

Results: a row for each word of the vocabulary.  Null and empty texts have no words; texts are read whole; repeated rows count again; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, column, materialize

LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"
WILDCARD = "\x00"


def with_deletions(id_col: str, every: int = 97) -> Column:
    """What a query gives ``vocabulary`` to plant typing errors: the word of ``w``, without one letter in about one of ``every`` cases, chosen by the id and the word."""
    h = F.crc32(F.concat(F.coalesce(column(id_col).cast("string"), F.lit("")), F.lit(":"), F.col("w")).cast("binary"))
    at = (h % F.length("w")).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(F.col("w"), F.lit(1), at), F.substring(F.col("w"), at + 2, F.length("w")))).otherwise(F.col("w"))


def vocabulary(documents: DataFrame, text_col: str = "text", word: Column | None = None, min_chars: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n).  ``word`` makes of each run ``w`` (lower-cased) what is counted."""
    if "w" in (c.lower() for c in documents.columns):
        documents = documents.withColumnsRenamed({c: f"{c}_0" for c in documents.columns if c.lower() == "w" and c != text_col})
    runs = F.regexp_extract_all(column(text_col), F.lit(LETTERS), F.lit(0))
    said = documents.select("*", F.explode(runs).alias("w")).withColumn("w", ascii_lower(F.col("w")))
    counted = said.select((F.col("w") if word is None else word).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.length("word") >= min_chars) & (F.col("n") >= min_count))


def without(word: Column, at: Column, instead: str) -> Column:
    """The word with ``instead`` in place of its letter ``at`` (from 1)."""
    return F.concat(F.substring(word, F.lit(1), at - 1), F.lit(instead), F.substring(word, at + 1, F.length(word)))


def replaced(words: DataFrame) -> DataFrame:
    """(word, k, best): of each wildcard group of two or more, the others' number and the commonest of them as (-n, word)."""
    keys = F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: without(F.col("word"), i, WILDCARD)))
    rows = words.select("word", "n", keys.alias("key"))
    group = Window.partitionBy("key")
    ranked = group.orderBy(F.desc("n"), "word")
    whole = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    entry = F.struct((-F.col("n")).alias("less"), F.col("word").alias("word"))
    found = rows.select(
        "word", F.count("*").over(whole).alias("size"), F.first("word").over(whole).alias("top"), F.first(entry).over(whole).alias("one"), F.nth_value(entry, 2).over(whole).alias("two"),
    ).where("size > 1")
    return found.select("word", (F.col("size") - 1).alias("k"), F.when(F.col("top") == F.col("word"), F.col("two")).otherwise(F.col("one")).alias("best"))


def indels(words: DataFrame) -> DataFrame:
    """(word, k, best), from both sides of each link between a word and a word that is one letter shorter."""
    shorter = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: without(F.col("word"), i, ""))))
    cut = words.select(F.col("word").alias("long"), F.col("n").alias("long_n"), shorter.alias("word"))
    links = cut.join(words, "word")
    sides = F.explode(F.array(
        F.struct(F.col("word").alias("word"), F.struct((-F.col("long_n")).alias("less"), F.col("long").alias("word")).alias("best")),
        F.struct(F.col("long").alias("word"), F.struct((-F.col("n")).alias("less"), F.col("word").alias("word")).alias("best")),
    ))
    return links.select(sides.alias("s")).select("s.word", F.lit(1).cast("bigint").alias("k"), "s.best")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form: each round doubles the path that is followed."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), "roots")
        now = then.drop("went")
        if then.where("went").isEmpty():
            return now


def variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each word of (word, n)."""
    if ratio < 2:
        raise ValueError("forms must occur twice as often, or they could lead in circles")
    words = materialize(words.select("word", "n"), "words")
    near = replaced(words).unionByName(indels(words)).groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))
    found = words.join(near, "word", "left")
    common = -F.col("best.less") >= ratio * F.col("n")
    found = materialize(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(common, F.col("best.word")).alias("form"), F.when(common, -F.col("best.less")).alias("form_n")), "forms")
    out = found.join(roots(found.where("form is not null")), "word", "left")
    return out.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
