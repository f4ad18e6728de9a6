"""License scans: diagonal voting on word k-grams, and named phrases.

All rolling k-gram hashes of a text are joined to the positions of the templates' k-grams.  A match votes for the diagonal
place in the text minus place in the template; votes are gathered by document, template and diagonal, diagonals at most
``SLACK`` apart are merged, and a merged span is verified: the share of the template's k-gram places that it holds must reach
``COVERAGE`` and its length may not exceed the template's by more than the slack allows.  A place of the template counts once, however often a text or
the table repeats it.  Two independent 64-bit hashes stand for a k-gram.

Phrases (``PHRASES``) are found as whole words in a row; they need no vote.

Templates of ``MAX_GRAMS`` words at most go to all executors, so the rolling hashes aren't shuffled; more are joined by a shuffle, with the
same result.  Votes are gathered in each task before they are shuffled, as sets of the template's places.

Defined results: null and empty texts have no words, labels or score above 0; a document is known by its id and its text, so repeated rows and texts
under one id get what each would get alone; added columns replace input columns of the same name, all others stay; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, fresh, let, others, plain_word_array, plain_words

K = 5
SLACK = 4
COVERAGE = 0.6
MAX_GRAMS = 100_000
ADDED = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "license_spans")
#: Phrase -> label.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Passages of well-known public licenses and notices.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
}


def grams(words: Column, k: int = K) -> Column:
    """(h, g) of each run of k words: two hashes."""
    return F.when(F.size(words) < k, F.array().cast("array<struct<h:bigint,g:bigint>>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: let(F.slice(words, i, k), lambda s: F.struct(F.xxhash64(s).alias("h"), F.xxhash64(F.lit(1), s).alias("g"))))
    )


def template_grams(documents: DataFrame, templates: dict[str, str]) -> DataFrame:
    rows = documents.sparkSession.createDataFrame(sorted(templates.items()), "label string, t string")
    words = rows.select("label", let(plain_words(F.col("t")), plain_word_array).alias("w"))
    return words.select("label", (F.size("w") - K + 1).alias("n_grams"), F.posexplode(grams(F.col("w"))).alias("at", "x")).select("label", "n_grams", "at", "x.h", "x.g")


def vote(documents: DataFrame, id_col: str, text_col: str, templates: dict[str, str]) -> DataFrame:
    """(id, th, voted, coverage, license_spans): the templates in each text that has any, with the best coverage and the spans in words."""
    known = template_grams(documents, templates)
    if sum(len(t.split()) for t in templates.values()) <= MAX_GRAMS:
        known = F.broadcast(known)
    text = column(text_col)
    rolled = documents.select(column(id_col).alias("id"), F.xxhash64(text).alias("th"), F.posexplode(let(let(plain_words(text), plain_word_array), lambda w: grams(w))).alias("pos", "x"))
    rolled = rolled.select("id", "th", "pos", F.col("x.h").alias("h"), F.col("x.g").alias("g"))
    hits = rolled.join(known, ["h", "g"]).withColumn("diagonal", F.col("pos") - F.col("at"))
    by = ["id", "th", "label", "n_grams"]
    lines = hits.groupBy(*by, "diagonal").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.collect_set("at").alias("seen"))
    order = Window.partitionBy("id", "th", "label").orderBy("diagonal")
    merged = lines.withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > SLACK).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(order))
    spans = merged.groupBy(*by, "run").agg(F.min("lo").alias("lo"), (F.max("hi") + K).alias("hi"), F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("votes"))
    verified = spans.withColumn("coverage", F.col("votes") / F.col("n_grams")).where((F.col("coverage") >= COVERAGE) & (F.col("hi") - F.col("lo") <= 2 * (F.col("n_grams") + K)))
    return verified.groupBy("id", "th").agg(F.collect_set("label").alias("voted"), F.max("coverage").alias("coverage"), F.sort_array(F.collect_set(F.struct("lo", "hi", "label"))).alias("license_spans"))


def places(framed: Column) -> Column:
    """n_base, first and last word and labels of the phrases in framed words."""
    any_phrase = "|".join(PHRASES)

    def count(phrase: str) -> Column:
        return F.regexp_count(framed, F.lit(f" {phrase}(?= )"))

    def word_at(before: Column) -> Column:
        return (F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit("")))).cast("bigint")

    def located() -> Column:
        head = F.get(F.split(framed, f" (?:{any_phrase})(?= )", 2), 0)
        # the last place: the smallest rest after any phrase's last place
        rests = [F.when(count(p) > 0, F.substring_index(framed, f" {p} ", -1)) for p in PHRASES]
        ends = F.array_compact(F.array(*[F.struct((F.length(r) + len(p) + 2).alias("n"), F.lit(p).alias("p")) for r, p in zip(rests, PHRASES, strict=True)]))
        starts = F.transform(F.filter(ends, lambda e: e["n"].isNotNull()), lambda e: word_at(F.substr(framed, F.lit(1), F.length(framed) - e["n"])))
        labels = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(count(p) > 0, F.lit(x)) for p, x in PHRASES.items()]))))
        return F.struct(sum((count(p) for p in PHRASES), F.lit(0)).cast("bigint").alias("n"), word_at(head).alias("first"), F.array_max(starts).alias("last"), labels.alias("labels"))

    empty = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("first"), F.lit(None).cast("bigint").alias("last"), F.array().cast("array<string>").alias("labels"))
    return F.when(F.rlike(framed, F.lit(f" (?:{any_phrase})(?= )")), located()).otherwise(empty)


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """``documents`` with the counts, labels and score; ``license_spans`` are the templates' spans in words."""
    text = column(text_col)
    n_words = lambda f: F.when(f == " ", F.lit(0)).otherwise(F.length(f) - F.length(F.replace(f, F.lit(" "), F.lit(""))) - 1).cast("bigint")
    base = let(plain_words(text), lambda f: F.struct(n_words(f).alias("n_words"), places(f).alias("p")))
    base_at, id_at, hash_at = fresh([*documents.columns, *ADDED, "id", "th", "voted", "coverage"], "base", "key_id", "key_hash")
    based = documents.select(*others(documents, ADDED), base.alias(base_at), column(id_col).alias(id_at), F.xxhash64(text).alias(hash_at))
    voted = vote(documents, id_col, text_col, templates).alias("v")
    joined = based.alias("b").join(voted, F.col(f"b.{id_at}").eqNullSafe(F.col("v.id")) & (F.col(f"b.{hash_at}") == F.col("v.th")), "left")
    p, none = F.col(f"b.{base_at}.p"), F.array().cast("array<string>")
    return joined.select(
        *[F.col("b.`" + c.replace("`", "``") + "`") for c in based.columns[: len(based.columns) - 3]], F.col(f"b.{base_at}.n_words").alias("n_words"), p["n"].alias("n_base"), p["first"].alias("first_word"), p["last"].alias("last_word"),
        F.array_join(p["labels"], ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(p["labels"], F.coalesce("v.voted", none))), ",").alias("labels"),
        F.greatest(F.coalesce("v.coverage", F.lit(0.0)), F.when(p["n"] > 0, F.lit(0.5)).otherwise(0.0)).alias("score"), F.col("v.license_spans").alias("license_spans"),
    )
