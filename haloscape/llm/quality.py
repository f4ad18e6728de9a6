"""Quality rules: divergence of a document's histograms from language references.

Each document gets two histograms: character classes (lower case, upper case, digits, white space, the symbols
``#*$%&|<>``, other ASCII, other characters) and common words (those of ``COMMON_WORDS``, and one bin for all others).  A
language's reference is the mean of the shares of its documents that pass the base rules and the length guard, over the
whole corpus, fitted twice: the second time without the share ``TRIM`` of documents that are farthest from the first reference in either
histogram (in steps of 1 / ``STEPS``), so that junk doesn't shape what it is held against.  A document is compared to each reference with the Jensen-Shannon
distance (base 2, so 0 to 1) and the nearest reference counts.  It is too far at a character distance over ``MAX_CHAR_DISTANCE``, or at a word distance
over ``WORD_SHARE`` of that which a text without any of the common words has, so such a text is always too far.

Guards: a document under ``MIN_WORDS`` words, whose histograms are mostly noise, is judged by the base rules only, and so is one in a language
that no document makes a reference of.  With no reference at all only the base rules hold.

Base rules: under 50 words fails; over half of the words in three-word windows that occur twice or more fails.

Texts are read once: features go to a narrow table, from which references (a row for each language named in
``COMMON_WORDS``) and verdicts come.  Everything is per row or a sum by language, so no group of copies meets in one task.

Defined results: null and blank texts have no words and fail the base rules; a document without a language is judged by the nearest reference;
repeated rows are judged alike; columns of the input with an added column's name are replaced, all others stay; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, SPACES, UPPER, ascii_lower, column, let, literal_array, materialize, others, white_words

SYMBOLS = "#*$%&|<>"
#: Frequent function words of each language.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "with", "was", "a", "it", "as", "on", "be", "by", "at", "from", "he", "his", "are", "this", "or", "an"),
    "de": ("der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "für", "ist", "im", "dem", "nicht", "ein", "eine", "auf", "als", "auch", "es", "an", "werden", "aus", "er"),
    "fr": ("le", "les", "des", "et", "est", "pour", "dans", "qui", "sur", "au", "de", "la", "un", "une", "du", "en", "que", "par", "il", "ne", "pas", "plus", "ce", "avec"),
    "es": ("el", "los", "las", "y", "por", "con", "una", "su", "como", "más", "de", "la", "que", "en", "un", "se", "del", "para", "al", "lo", "es", "no", "a", "sus"),
}
LISTED = tuple(dict.fromkeys(w for words in COMMON_WORDS.values() for w in words))
MIN_WORDS = 60
TRIM = 0.1
MAX_CHAR_DISTANCE = 0.3
WORD_SHARE = 0.85
STEPS = 1000
#: Window hashes are packed with their place: 44 bits of hash, 20 bits of place.
PLACE_BITS = 20
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "language_seen", "char_distance", "word_distance")


def covered(places: Column) -> Column:
    """Words under the three-word windows that start at ``places``."""
    return F.size(F.array_union(F.array_union(places, F.transform(places, lambda x: x + 1)), F.transform(places, lambda x: x + 2)))


def repeat_words(words: Column) -> Column:
    """Words in three-word windows found twice or more.  Windows are sorted as longs of hash and place; equal hashes next to each
    other are repeats if their words agree.  If words disagree there, or the text has more places than the packing takes, whole
    windows are sorted instead."""
    n = F.size(words) - 2
    low = F.lit((1 << PLACE_BITS) - 1).cast("bigint")

    def same(a: Column, b: Column) -> Column:
        i, j = a.bitwiseAND(low).cast("int"), b.bitwiseAND(low).cast("int")
        return (F.get(words, i) == F.get(words, j)) & (F.get(words, i + 1) == F.get(words, j + 1)) & (F.get(words, i + 2) == F.get(words, j + 2))

    def like(a: Column, b: Column) -> Column:
        return F.shiftright(a, PLACE_BITS) == F.shiftright(b, PLACE_BITS)

    def packed(_: Column) -> Column:
        hashed = F.transform(F.slice(words, 1, n), lambda w, i: F.shiftleft(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)), PLACE_BITS).bitwiseOR(i.cast("bigint")))
        return let(F.sort_array(hashed), by_hash)

    def by_hash(s: Column) -> Column:
        hit = F.filter(s, lambda x, i: ((i > 0) & like(x, F.get(s, i - 1))) | like(x, F.coalesce(F.get(s, i + 1), F.bitwise_not(x))))
        return F.when(F.size(F.array_distinct(F.transform(s, lambda x: F.shiftright(x, PLACE_BITS)))) == F.size(s), F.lit(0)).otherwise(let(hit, confirmed))

    def confirmed(hit: Column) -> Column:
        clash = F.exists(F.sequence(F.lit(1), F.size(hit) - 1), lambda i: like(F.get(hit, i), F.get(hit, i - 1)) & ~same(F.get(hit, i), F.get(hit, i - 1)))
        return F.when((F.size(hit) > 1) & clash, whole(words)).otherwise(covered(F.transform(hit, lambda x: x.bitwiseAND(low))))

    def whole(w: Column) -> Column:
        windows = F.transform(F.slice(w, 1, n), lambda x, i: F.struct(x.alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.cast("bigint").alias("i")))
        return let(F.sort_array(windows), lambda s: covered(F.transform(F.filter(s, lambda x, i: equal(x, F.get(s, i - 1)) | equal(x, F.get(s, i + 1))), lambda x: x["i"])))

    def equal(x: Column, y: Column) -> Column:
        return F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))

    return F.when(n < 2, F.lit(0)).when(n >= (1 << PLACE_BITS), whole(words)).otherwise(packed(words)).cast("bigint")


def duplicate_lines(text: Column) -> Column:
    filled = F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    return let(filled, lambda lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"))


def character_classes(text: Column) -> Column:
    """Lower, upper, digits, white space, symbols, other ASCII, other: counts.  The long lower-case runs go first, so that the rest
    works on what is left."""

    def rest(r: Column) -> Column:
        return F.array(F.length(text) - F.length(r), without(r, UPPER), without(r, "0123456789"), without(r, SPACES), without(r, SYMBOLS), F.octet_length(F.regexp_replace(r, "[^\\x00-\\x7F]+", "")), F.length(r))

    def without(r: Column, chars: str) -> Column:
        return F.length(r) - F.length(F.translate(r, chars, ""))

    def counts(c: Column) -> Column:
        ascii_rest = F.get(c, 5) - F.get(c, 1) - F.get(c, 2) - F.get(c, 3) - F.get(c, 4)
        return F.array(F.get(c, 0), F.get(c, 1), F.get(c, 2), F.get(c, 3), F.get(c, 4), ascii_rest, F.get(c, 6) - F.get(c, 5)).cast("array<bigint>")

    return let(F.regexp_replace(text, f"[{LOWER[0]}-{LOWER[-1]}]+", ""), lambda r: let(rest(r), counts))


def slots() -> tuple[int, dict[str, int]]:
    """A modulus under which the hashes of the listed words differ, and each word's slot."""
    import xxhash

    hashes = {w: xxhash.xxh64_intdigest(w.encode(), 42) for w in LISTED}
    signed = {w: h - (1 << 64) if h >> 63 else h for w, h in hashes.items()}
    size = next(m for m in range(len(LISTED), 1 << 20) if len({h % m for h in signed.values()}) == len(LISTED))
    return size, {w: h % size for w, h in signed.items()}


def common_words(words: Column) -> Column:
    """Counts of each listed word, then of all other words.  A word's hash names the only listed word that it can be."""
    size, slot = slots()
    word_at = {n: w for w, n in slot.items()}
    held = literal_array([word_at.get(n, "") for n in range(size)], "string")
    short = F.filter(words, lambda w: F.length(w) <= max(map(len, LISTED)))

    def number(w: Column) -> Column:
        return let(ascii_lower(w), lambda x: let(F.pmod(F.xxhash64(x), F.lit(size).cast("bigint")).cast("int"), lambda n: F.when(F.get(held, n) == x, n)))

    found = F.filter(F.transform(short, number), lambda n: n.isNotNull())
    return let(found, lambda f: F.array(*[F.size(f) - F.size(F.array_remove(f, F.lit(slot[w]))) for w in LISTED], F.size(words) - F.size(f)).cast("array<bigint>"))


def shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return let(total, lambda t: F.transform(counts, lambda x: x / F.greatest(t, F.lit(1))))


def js_distance(p: Column, q: list[float]) -> Column:
    """Square root of the Jensen-Shannon divergence in bits; ``p``: shares, ``q``: a reference."""

    def part(x: Column, y: Column) -> Column:
        m = (x + y) / 2
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0) + F.when(y > 0, y * F.log2(y / m)).otherwise(0.0)

    terms = F.zip_with(p, literal_array([float(v) for v in q], "double"), part)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))


def features(text: Column) -> Column:
    """One struct with all that is read from a text."""

    def of_words(t: Column, w: Column) -> Column:
        return F.struct(F.size(w).cast("bigint").alias("n_words"), repeat_words(w).alias("n_repeat_words"), character_classes(t).alias("chars"), common_words(w).alias("common"), duplicate_lines(t).alias("n_dup_lines"))

    return let(F.coalesce(text, F.lit("")), lambda t: let(white_words(t), lambda w: of_words(t, w)))


def measure(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", keep_text: bool = True) -> DataFrame:
    """(row, lang, f, n_words, base_failed): nothing of the input can clash with what is added."""
    plain = others(documents, ADDED if keep_text else (*ADDED, text_col))
    f = F.col("f")
    packed = documents.select(F.struct(*plain).alias("row") if plain else F.lit(True).alias("row"), column(lang_col).cast("string").alias("lang"), features(column(text_col).cast("string")).alias("f"))
    return packed.withColumn("n_words", f["n_words"]).withColumn("base_failed", (f["n_words"] < 50) | (100 * f["n_repeat_words"] > 50 * f["n_words"]))


def fitting(measured: DataFrame) -> DataFrame:
    """The documents that references are made of."""
    return measured.where(~F.col("base_failed") & (F.col("n_words") >= MIN_WORDS) & F.col("lang").isin(list(COMMON_WORDS)))


Reference = tuple[list[float], list[float]]


def mean_shares(fit: DataFrame) -> dict[str, Reference]:
    """Language -> mean shares of character classes and of common words; a row for each language of ``COMMON_WORDS``."""
    bins = {"c": 7, "w": len(LISTED) + 1}
    sides = fit.select("lang", shares(F.col("f.chars")).alias("c"), shares(F.col("f.common")).alias("w"))
    rows = sides.groupBy("lang").agg(*[F.avg(F.get(k, i)).alias(f"{k}{i}") for k, m in bins.items() for i in range(m)]).collect()
    return {r["lang"]: ([r[f"c{i}"] for i in range(bins["c"])], [r[f"w{i}"] for i in range(bins["w"])]) for r in sorted(rows, key=lambda r: r["lang"])}


def own_distances(fit: DataFrame, refs: dict[str, Reference]) -> DataFrame:
    """Adds ``c`` and ``w``, the distances of a document to its own language's reference, in steps."""

    def own(counts: str, side: int) -> Column:
        return F.ceil(F.coalesce(*[F.when(F.col("lang") == k, js_distance(shares(F.col(counts)), v[side])) for k, v in refs.items()]) * STEPS)

    return fit.withColumn("c", own("f.chars", 0)).withColumn("w", own("f.common", 1))


def near_steps(rows: DataFrame) -> dict[str, dict[str, int]]:
    """Language -> "c" and "w" -> the step that all but ``TRIM`` of its documents lie under; a row for each language and step comes to the driver."""
    found: dict[str, dict[str, int]] = {}
    for side in ("c", "w"):
        counts: dict[str, dict[int, int]] = {}
        for r in rows.groupBy("lang", F.col(side).alias("step")).agg(F.count(F.lit(1)).alias("n")).collect():
            counts.setdefault(r["lang"], {})[r["step"]] = r["n"]
        for lang, n in counts.items():
            seen, total = 0, sum(n.values())
            for step in sorted(n):
                seen += n[step]
                if seen >= (1 - TRIM) * total:
                    found.setdefault(lang, {})[side] = step
                    break
    return found


def distance_without(q: list[float]) -> float:
    """``js_distance`` to a reference of a text that has none of the common words."""
    rest = q[-1]
    return math.sqrt((math.log2(2 / (1 + rest)) + (rest * math.log2(2 * rest / (1 + rest)) if rest else 0) + 1 - rest) / 2)


def word_limit(q: list[float]) -> float:
    """The word distance that is too far; 1, which nothing exceeds, for a reference that has next to no common words itself."""
    most = distance_without(q)
    return WORD_SHARE * most if most > 0.1 else 1.0


def references(measured: DataFrame) -> dict[str, Reference]:
    """Language -> its reference, without the documents that are farthest from the mean of all."""
    fit = fitting(measured)
    first = mean_shares(fit)
    if not first:
        return {}
    rows = own_distances(fit, first)
    near = F.lit(False)
    for lang, at in near_steps(rows).items():
        near = near | ((F.col("lang") == lang) & (F.col("c") <= at["c"]) & (F.col("w") <= at["w"]))
    return first | mean_shares(rows.where(near).select("lang", "f"))


def judge(measured: DataFrame, refs: dict[str, Reference]) -> DataFrame:
    """The input's columns, the base counts, the nearest reference, its distances and ``kept``."""
    kind = "struct<d:double,lang:string,c:double,w:double,most:double>"
    if refs:
        distances = [(k, js_distance(F.col("pc"), v[0]), js_distance(F.col("pw"), v[1])) for k, v in refs.items()]
        nearest = F.array_min(F.array(*[F.struct((c + w).alias("d"), F.lit(k).alias("lang"), c.alias("c"), w.alias("w"), F.lit(word_limit(refs[k][1])).alias("most")) for k, c, w in distances]))
    else:
        nearest = F.lit(None).cast(kind)
    measured = measured.withColumn("pc", shares(F.col("f.chars"))).withColumn("pw", shares(F.col("f.common"))).withColumn("near", nearest)
    near, f, chars = F.col("near"), F.col("f"), F.col("f.chars")
    judged = (F.col("n_words") >= MIN_WORDS) & (F.col("lang").isNull() | F.col("lang").isin(list(refs)))
    far = F.coalesce(judged & ((near["c"] > MAX_CHAR_DISTANCE) | (near["w"] > near["most"])), F.lit(False))
    has_row = isinstance(measured.schema["row"].dataType, T.StructType)
    return measured.select(
        *([F.col("row.*")] if has_row else []), "n_words", (F.aggregate(chars, F.lit(0).cast("bigint"), lambda a, x: a + x) - F.get(chars, 3)).alias("word_chars"), F.get(chars, 4).alias("n_symbols"),
        f["n_dup_lines"].alias("n_dup_lines"), f["n_repeat_words"].alias("n_repeat_words"), "base_failed", (~F.col("base_failed") & ~far).alias("kept"),
        near["lang"].alias("language_seen"), near["c"].alias("char_distance"), near["w"].alias("word_distance"),
    )


def quality(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", keep_text: bool = True) -> DataFrame:
    """``documents`` with the base counts, the distances and ``kept``.  Without ``keep_text`` the table between the two passes, and
    the result, lack the text."""
    measured = materialize(measure(documents, text_col, lang_col, keep_text), "quality")
    return judge(measured, references(measured))
