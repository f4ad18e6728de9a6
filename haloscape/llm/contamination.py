"""Benchmark decontamination by a distributed positional inverted index.

An item's windows are its runs of ``WINDOW`` words (one run of all words if it has fewer).  The corpus is read once: postings (term, document,
place) of all words that the benchmark has are stored, and one more a document that tells its length.  From them each term's frequency
over the whole corpus is counted, and each window's terms are put in order, the rarest first.

Lists are intersected from the rarest term on.  Its postings, moved back by its offset in the window, are possible starts; a start stays
if one of the next two terms has a posting at most ``SLACK`` words from its offset there (a window of one word needs none).  What stays, few places,
is held against the stored postings of all terms: a window is an exact phrase if each of its terms stands at its offset, and a proximity
match if ``NEAR`` of its distinct terms stand, in any order, within its length and ``SLACK`` words on either side.  So a proximity match holds the rarest of the
window's terms that occur at all and one of the next two; an exact phrase holds all, so none is lost.  Texts aren't compared, moved or read again.

Sizes: postings carry no text.  What is sent to all executors are the benchmark's terms and windows, only while ``MAX_TERMS`` proves them small; else
the joins are shuffled, with the same result.  Postings of the three rarest terms are gathered by document and term, as sets, so a group holds no more than one
document's own places of a term; the cost of a long text grows with its length.

Defined results: a document is known by its id and its text, so repeated rows and texts under one id get what each would get alone; null texts have
no words, items without words have no windows; repeated items count once by id; added columns replace input columns of the same name, all others
stay; an empty table gives an empty table, an empty benchmark no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, fresh, let, materialize, others, plain_word_array, plain_words

WINDOW = 10
NEAR = 0.8
SLACK = 2
MAX_TERMS = 200_000
ADDED = ("n_words", "n_hit", "items", "near_items", "contaminated")
#: The term of the posting that tells a document's length.
LENGTH = -1
DOCUMENT = ["id", "th"]


def words_of(text: Column) -> Column:
    return let(plain_words(text), plain_word_array)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Sent to all executors if its count proves it small."""
    return F.broadcast(df) if rows <= MAX_TERMS else df


def item_words(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return items.select(column(item_col).cast("string").alias("item"), words_of(column(text_col)).alias("words")).where(F.size("words") > 0)


def vocabulary(words: DataFrame) -> DataFrame:
    """(word, term): numbers of the benchmark's words; they stand once they are written."""
    terms = materialize(words.select(F.explode("words").alias("word")).distinct().withColumn("term", F.monotonically_increasing_id()), "terms")
    return terms.union(terms.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(LENGTH).cast("bigint").alias("term")))


def item_windows(words: DataFrame, terms: DataFrame, window: int) -> DataFrame:
    """(w, item, terms): each distinct run of terms, numbered."""
    numbered = words.distinct().select("item", "words", F.posexplode("words").alias("pos", "word")).join(terms, "word")
    rows = numbered.groupBy("item", "words").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("all"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - window + 1))
    runs = rows.select("item", F.explode(F.transform(starts, lambda s: F.slice("all", s, window))).alias("terms")).distinct()
    return runs.withColumn("w", F.monotonically_increasing_id())


def postings(documents: DataFrame, id_col: str, text_col: str, terms: DataFrame, n_terms: int) -> DataFrame:
    """(term, id, th, pos) of the benchmark's words, and each document's length as a posting of ``LENGTH``."""
    text = column(text_col)
    words = F.concat(words_of(text), F.array(F.lit("")))
    placed = documents.select(column(id_col).alias("id"), F.xxhash64(text.cast("string")).alias("th"), F.posexplode(words).alias("pos", "word"))
    return placed.join(small(terms, n_terms), "word").select("term", *DOCUMENT, "pos")


def look_ups(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(w, term, off, next): each window by the rarest of its terms that occur, and the next two (term, off)."""
    at = windows.select("w", F.posexplode("terms").alias("off", "term")).join(counts, "term")
    ranked = at.groupBy("w").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "off", "term"))), 1, 3).alias("r"))
    return ranked.select("w", F.get("r", 0)["term"].alias("term"), F.get("r", 0)["off"].alias("off"), F.transform(F.slice("r", 2, 2), lambda x: F.struct(x["term"].alias("term"), x["off"].alias("off"))).alias("next"))


def starts(index: DataFrame, looked: DataFrame, n_looked: int) -> DataFrame:
    """(id, th, w, start): places where a window's rarest term and one of the next two stand as it asks.  Lists are intersected whole, by hashing, so a document of one term
    repeated costs no more than its length."""
    # a term that some window is looked up by makes starts; the others are only asked about
    terms = F.concat(F.array(F.struct("term", F.lit(True).alias("first"))), F.transform("next", lambda x: F.struct(x["term"].alias("term"), F.lit(False).alias("first"))))
    asked = looked.select(F.explode(terms).alias("t")).groupBy("t.term").agg(F.max("t.first").alias("first"))
    lists = materialize(index.join(small(asked, n_looked), "term").groupBy(*DOCUMENT, "term", "first").agg(F.collect_set("pos").alias("places")), "lists")
    begun = lists.where("first").join(small(looked, n_looked), "term").select(*DOCUMENT, "w", "next", F.transform("places", lambda p: p - F.col("off")).alias("starts"))
    alone = begun.where(F.size("next") == 0).select(*DOCUMENT, "w", "starts")
    questions = begun.select(*DOCUMENT, "w", "starts", F.explode("next").alias("x")).select(*DOCUMENT, "w", "starts", "x.term", "x.off")
    same = F.col("q.id").eqNullSafe(F.col("l.id")) & (F.col("q.th") == F.col("l.th")) & (F.col("q.term") == F.col("l.term"))
    met = questions.alias("q").join(lists.alias("l"), same).select("q.id", "q.th", "w", "starts", "off", "places")
    shifts = F.array(*[F.lit(d) for d in range(-SLACK, SLACK + 1)])
    allowed = F.flatten(F.transform("places", lambda p: F.transform(shifts, lambda d: p - F.col("off") - d)))
    kept = met.select(*DOCUMENT, "w", F.array_intersect("starts", allowed).alias("starts")).unionByName(alone)
    return kept.select(*DOCUMENT, "w", F.explode("starts").alias("start"))


def verified(index: DataFrame, found: DataFrame, windows: DataFrame, n_windows: int) -> DataFrame:
    """(id, th, w, item, start, n, exact, near) of the starts, by the postings of all terms around them."""
    named = found.join(small(windows, n_windows), "w").withColumn("n", F.size("terms"))
    places = named.select(*DOCUMENT, "w", "item", "start", "n", "terms", F.explode(F.sequence(F.greatest(F.lit(0), F.col("start") - SLACK), F.col("start") + F.col("n") - 1 + SLACK)).alias("pos"))
    same = F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.th") == F.col("b.th"))
    # few documents are left: written on their own, their size says whether the postings must be shuffled to meet them
    left = materialize(found.select(*DOCUMENT).distinct(), "documents-left")
    there = index.where(F.col("term") != LENGTH).alias("a").join(left.alias("b"), same, "left_semi").select("a.*").distinct()
    met = places.alias("a").join(there.alias("b"), same & (F.col("a.pos") == F.col("b.pos"))).select("a.*", "b.term")
    stands = F.coalesce(F.get("terms", F.col("pos") - F.col("start")) == F.col("term"), F.lit(False)) & (F.col("pos") >= F.col("start"))
    held = met.groupBy(*DOCUMENT, "w", "item", "start", "n", "terms").agg(F.sum(stands.cast("int")).alias("stand"), F.collect_set("term").alias("around"))
    near = F.size(F.array_intersect("terms", "around")) >= NEAR * F.size(F.array_distinct("terms"))
    return held.select(*DOCUMENT, "w", "item", "start", "n", ((F.col("start") >= 0) & (F.col("stand") == F.col("n"))).alias("exact"), near.alias("near"))


def indexed(documents: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int) -> tuple[DataFrame, DataFrame]:
    """The stored postings, and (id, th, n_hit, items, near_items) of the documents that hold a window or nearly."""
    words = item_words(items, item_col, item_text_col)
    terms = vocabulary(words)
    windows = materialize(item_windows(words, terms, window), "windows")
    n_windows = windows.count()
    index = materialize(postings(documents, id_col, text_col, terms, terms.count()), "postings")
    counts = index.where(F.col("term") != LENGTH).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    looked = materialize(look_ups(windows, counts), "look-ups")
    found = materialize(starts(index, looked, n_windows).distinct(), "starts")
    seen = materialize(verified(index, found, windows, n_windows).where("exact or near"), "matches")
    hit = seen.where("exact").select(*DOCUMENT, F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("pos")).distinct().groupBy(*DOCUMENT).agg(F.count(F.lit(1)).alias("n_hit"))
    named = seen.groupBy(*DOCUMENT).agg(
        F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("item")))).alias("items"), F.sort_array(F.collect_set(F.when(F.col("near"), F.col("item")))).alias("near_items")
    )
    same = F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.th") == F.col("b.th"))
    joined = named.alias("a").join(hit.alias("b"), same, "left").select("a.*", F.coalesce("b.n_hit", F.lit(0)).cast("bigint").alias("n_hit"))
    return index, materialize(joined, "hits")


def matched(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, th, n_hit, items, near_items) of the documents that have any; ``th``: xxhash64 of the text."""
    return indexed(documents, items, id_col, text_col, item_col, item_text_col, window)[1]


def decontaminate(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``documents`` with n_words, n_hit (words inside an exact occurrence), items and near_items (sorted ids) and contaminated."""
    index, hits = indexed(documents, items, id_col, text_col, item_col, item_text_col, window)
    same = F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.th") == F.col("b.th"))
    lengths = index.where(F.col("term") == LENGTH).select(*DOCUMENT, F.col("pos").cast("bigint").alias("n_words")).distinct()
    facts = lengths.alias("a").join(hits.alias("b"), same, "left").select("a.*", "b.n_hit", "b.items", "b.near_items")
    id_at, hash_at = fresh([*documents.columns, *ADDED, *DOCUMENT], "key_id", "key_hash")
    kept = others(documents, ADDED)
    keyed = documents.select(*kept, column(id_col).alias(id_at), F.xxhash64(column(text_col).cast("string")).alias(hash_at))
    names = [c for c in keyed.columns if c not in (id_at, hash_at)]
    joined = keyed.alias("d").join(facts.alias("f"), F.col(f"d.{id_at}").eqNullSafe(F.col("f.id")) & (F.col(f"d.{hash_at}") == F.col("f.th")))
    none, n_hit = F.array().cast("array<string>"), F.coalesce("f.n_hit", F.lit(0)).cast("bigint")
    return joined.select(
        *[F.col("d.`" + c.replace("`", "``") + "`") for c in names], F.col("f.n_words").alias("n_words"), n_hit.alias("n_hit"), F.coalesce("f.items", none).alias("items"),
        F.coalesce("f.near_items", none).alias("near_items"), (n_hit > 0).alias("contaminated"),
    )
