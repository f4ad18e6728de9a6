"""Substring dedup: paragraph MinHash banding.

Two kinds of paragraphs are compared across documents, in the same way.

``paragraph``: a line of a text with ``MIN_WORDS`` words or more.

``passage``: a window of ``WINDOW`` words, for what is copied into longer lines.  Windows start at anchors: the shingle whose hash is
the smallest of ``REACH`` shingles in a row (the last one on ties), for each such row.  So a copy is windowed as its original is, wherever it
stands, and every text of ``WINDOW + REACH - 1`` (35) words or more that two documents share word for word holds a window that both have, and so does nearly every
passage of over 50 words with a word changed: what stands on the longer side of the change is enough.  As windows are many, a first band of ``KEY_LABELS`` full MinHash values, which equal windows always share, says which of them are paragraphs to go on with:
those that share it with a window of another document.  Of these, windows with equal sets form classes (of equal keys and
equal sums of hashes, 128 bits together), and where one band holds several classes their
first windows are compared like any other paragraphs.

A paragraph's set is its distinct 5-word shingles; paragraphs with a Jaccard similarity of 0.8 or more are linked.  Bands are runs of
MinHash labels that don't overlap, tuned for recall: two lines at 0.8 share one of 13 bands of 3 labels with probability 1 - (1 - 0.8^3)^13 > 0.9999; for
windows that went on, 6 bands of 2 give 1 - (1 - 0.8^2)^6 > 0.997.  Equal sets
are one class first; colliding paragraphs are joined in their band's bucket, compared there by labels, and confirmed on exact sets, as
documents are in the near-duplicate forest, so that neither copies nor large buckets give all pairs.  Components of links
are clusters; the first paragraph (smallest document id, then place) stays and the others are removed.  Windows of one verdict that
overlap or touch are reported as one passage; its true ends may lie up to ``REACH`` words further out, or a word, seldom two, further in, as windows
that differ in their first or last word are still alike.

Defined results: a document is known by its id and its text, of any types that can be sorted, so texts under one id are told apart and rows equal in
both are one document; null ids sort first; null and empty texts, short lines and texts of under ``WINDOW`` words have no paragraphs of a kind; a line that
its own document repeats counts like any other copy, a passage only if another document has it; of the input's columns the id is
returned (``without_repeats`` returns all); an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, column, fresh, frugal, materialize
from .near_dup import Forest, digest_of, distinct, label_factors, link, min_labels, ranged, rolling, sign, together

MIN_WORDS = 30
WINDOW = 16
REACH = 20
KEY_LABELS = 2
K = 5
#: Bytes of a text that are hashed at once (and what is left of their last word).
BLOCK = 1 << 14
#: Where a block may end.
BLANK = re.compile(rb"[\x20\x09-\x0d]")
WORD = re.compile(r"[^\x20\x09-\x0d]+")
LINES = Forest(k=K, percent=80, labels=39, trees=13, depth=3, least=0.5)
WINDOWS = Forest(k=K, percent=80, labels=12, trees=6, depth=2, least=0.5)
UNIT = ["doc", "th", "place"]
SPACE = "\\x20\\x09-\\x0D"
LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())


def source_of(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, th, text): rows equal in id and text have equal keys."""
    text = column(text_col).cast("string")
    return documents.select(column(id_col).alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))


def sliding_min(values, width: int):
    """The smallest of each ``width`` values in a row."""
    import numpy as np

    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def anchors(hashes, width: int, reach: int):
    """Starts of windows of ``width`` shingles: of each ``reach`` starts in a row the one whose shingle's hash is smallest, the last one on ties."""
    import numpy as np

    starts = hashes[: max(0, len(hashes) - width + 1)]
    if not len(starts):
        return np.zeros(0, np.int64)
    if len(starts) <= reach:
        return np.array([len(starts) - 1 - int(starts[::-1].argmin())])
    # a start is chosen where some row of ``reach`` starts around it has no smaller one: the largest of these rows' minima is its own hash
    edge = np.zeros(reach - 1, starts.dtype)
    highest = ~sliding_min(~np.concatenate([edge, sliding_min(starts, reach), edge]), reach)
    chosen = (highest == starts).nonzero()[0]
    if not ((starts[chosen[1:]] == starts[chosen[:-1]]) & (np.diff(chosen) < reach)).any():
        return chosen
    rows = np.lib.stride_tricks.sliding_window_view(starts, reach)
    return np.unique(np.arange(len(rows)) + reach - 1 - rows[:, ::-1].argmin(1))


@cache
def byte_numbers():
    """A number for each byte, and which bytes are white space."""
    import numpy as np

    blank = np.zeros(256, bool)
    blank[[0x20, *range(0x09, 0x0E)]] = True
    return np.random.Generator(np.random.PCG64(11)).integers(0, 2**63, 256, np.uint64) | np.uint64(1), blank


@cache
def powers(base: int, count: int):
    import numpy as np

    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


BASE = 0x9E3779B97F4A7C15


def block_words(block: bytes):
    """64-bit hashes of a block's words, sums of its bytes' numbers times powers of an odd base, and the words before each line break."""
    import numpy as np

    numbers, blank = byte_numbers()
    raw = np.frombuffer(block, np.uint8)
    count = 1 << len(raw).bit_length()
    edges = np.diff(np.concatenate([[True], blank[raw], [True]]).view(np.int8))
    starts, ends = (edges == -1).nonzero()[0], (edges == 1).nonzero()[0]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(numbers[raw] * powers(BASE, count)[: len(raw)])])
    hashes = (sums[ends] - sums[starts]) * powers(pow(BASE, -1, 1 << 64), count)[starts]
    hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return hashes ^ (hashes >> np.uint64(29)), np.searchsorted(starts, (raw == 10).nonzero()[0])


def hashed_lines(text: str):
    """64-bit hashes of a text's words, and the word at which each line starts, with the number of all words last."""
    import numpy as np

    raw, at, words, breaks, done = text.encode().translate(LOWERED), 0, [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
    while at < len(raw):
        cut = BLANK.search(raw, min(at + BLOCK, len(raw)))
        end = cut.start() if cut else len(raw)
        hashes, lines = block_words(raw[at:end])
        words.append(hashes)
        breaks.append(lines + done)
        at, done = end, done + len(hashes)
    return np.concatenate(words), np.concatenate([*breaks, [done]])


def units(documents: DataFrame) -> DataFrame:
    """(doc, th, kind, place, start, n_words, n, digest, labels, windows): lines (kind 0) with labels, and a row (kind 1) with all windows of each text: place,
    the key of the first band and a hash of the whole set.  A text is read once.  ``place``: the line's number or the window's first word; ``start``: the first word."""
    held = [documents.schema[c] for c in ("doc", "th")]
    kinds = (("kind", T.ByteType()), ("place", T.IntegerType()), ("start", T.IntegerType()), ("n_words", T.IntegerType()), ("n", T.LongType()), ("digest", T.BinaryType()), ("labels", T.BinaryType()))
    windows = T.ArrayType(T.StructType([T.StructField("place", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("whole", T.LongType())]))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        factors, width = label_factors(LINES.labels), WINDOW - K + 1
        mixers = np.random.Generator(np.random.PCG64(7)).integers(0, 2**63, KEY_LABELS + 1, np.uint64) | np.uint64(1)
        names = ["doc", "th", *(n for n, _ in kinds), "windows"]
        types = (pa.int8(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        packed = pa.struct([("place", pa.int32()), ("key", pa.int64()), ("whole", pa.int64())])

        def mixed(hashes, by):
            out = (hashes ^ (hashes >> np.uint64(31))) * by
            return out ^ (out >> np.uint64(29))

        def rows(part, take, *values):
            """The rows ``take`` with columns of the kinds, and no others."""
            take = pa.array(take, pa.int32())
            return [part.column(1).take(take), part.column(2).take(take), *(pa.array(v, t) for v, t in zip(values, types, strict=False)), *(pa.nulls(len(take), t) for t in types[len(values) :])]

        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                for at, texts in together([t or "" for t in part.column(0).to_pylist()]):
                    # shingles that reach into the next line or text are never taken
                    words, starts = hashed_lines("\n".join(texts))
                    hashes, sizes = rolling(words, K), np.diff(starts)
                    first_line = np.concatenate([[0], np.cumsum([t.count("\n") + 1 for t in texts])])
                    first_word = starts[first_line]
                    line = (sizes >= MIN_WORDS).nonzero()[0]
                    if len(line):
                        of = np.searchsorted(first_line, line, "right") - 1
                        first, count = starts[line], sizes[line] - K + 1
                        sets = [distinct(hashes[a : a + n]) for a, n in zip(first.tolist(), count.tolist(), strict=True)]
                        labels = [row.tobytes() for row in min_labels(hashes, first, count, factors)]
                        values = (np.zeros(len(line), np.int8), line - first_line[of], first - first_word[of], sizes[line], [len(s) for s in sets], [digest_of(s) for s in sets], labels)
                        yield pa.RecordBatch.from_arrays([*rows(part, of + at, *values), pa.nulls(len(line), pa.list_(packed))], names=names)
                    chosen = [anchors(hashes[a : max(a, b - K + 1)], width, REACH) + a for a, b in zip(first_word[:-1].tolist(), first_word[1:].tolist(), strict=True)]
                    n = np.array([len(c) for c in chosen])
                    if n.any():
                        chosen = np.concatenate(chosen)
                        key = np.zeros(len(chosen), np.uint64)
                        for m in mixers[1:]:
                            key = (key ^ sliding_min(mixed(hashes, m), width)[chosen]) * np.uint64(0x9E3779B97F4A7C15)
                            key ^= key >> np.uint64(32)
                        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(hashes, mixers[0]))])
                        place = (chosen - np.repeat(first_word[:-1], n)).astype(np.int32)
                        of = n.nonzero()[0]
                        found = pa.StructArray.from_arrays([pa.array(place), pa.array(key.view(np.int64)), pa.array((sums[chosen + width] - sums[chosen]).view(np.int64))], fields=list(packed))
                        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n[of])]), pa.int32()), found)
                        yield pa.RecordBatch.from_arrays([*rows(part, of + at, np.ones(len(of), np.int8)), lists], names=names)

    return documents.select("text", "doc", "th").mapInArrow(frugal(run), T.StructType([*held, *(T.StructField(n, t) for n, t in kinds), T.StructField("windows", windows)]))


def shared_keys(sorted_rows: DataFrame) -> DataFrame:
    """Of windows that are dealt by ranges of (key, doc, th, place) and sorted, each once, those whose key several documents have.  Where a key's rows reach a
    batch's end it isn't known yet, and they stay."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        last = None  # the last row of the batches so far
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = (rows if last is None else pa.concat_tables([last, rows])).combine_chunks()
            key, th, place, doc = rows["key"].to_numpy(), rows["th"].to_numpy(), rows["place"].to_numpy(), rows["doc"].combine_chunks()
            n, seen = len(key), 0 if last is None else 1
            equal = pc.fill_null(pc.equal(doc.slice(1), doc.slice(0, n - 1)), False).to_numpy(zero_copy_only=False)
            both_null = pc.and_(pc.is_null(doc.slice(1)), pc.is_null(doc.slice(0, n - 1))).to_numpy(zero_copy_only=False)
            same_key = key[1:] == key[:-1]
            same_doc = (equal | both_null) & (th[1:] == th[:-1])
            again = np.concatenate([[bool(seen)], same_key & same_doc & (place[1:] == place[:-1])])
            last = rows.slice(n - 1)
            starts = np.concatenate([[0], (~same_key).nonzero()[0] + 1])
            keep = np.logical_or.reduceat(np.concatenate([[False], same_key & ~same_doc]), starts)
            keep[[0, -1]] = True
            yield from rows.filter(pa.array(np.repeat(keep, np.diff([*starts, n])) & ~again)).to_batches()

    return sorted_rows.mapInArrow(frugal(run), sorted_rows.schema)


def window_texts(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, th, place, text) of wanted windows (doc, th, place)."""
    held = wanted.groupBy(F.col("doc").alias("d"), F.col("th").alias("h")).agg(F.collect_set("place").alias("places"))
    joined = documents.join(held, F.col("doc").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                places, cut = part.column(3).to_pylist(), []
                for text, wanted in zip(part.column(2), places, strict=True):
                    words = WORD.findall(text.as_py())
                    cut += [" ".join(words[p : p + WINDOW]) for p in wanted]
                take = pa.array(np.repeat(np.arange(part.num_rows), [len(p) for p in places]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array([p for wanted in places for p in wanted], pa.int32()), pa.array(cut, pa.string())], names=[*UNIT, "text"])

    held = [documents.schema[c] for c in ("doc", "th")]
    return joined.select("doc", "th", "text", "places").mapInArrow(frugal(run), T.StructType([*held, T.StructField("place", T.IntegerType()), T.StructField("text", T.StringType())]))


def window_classes(documents: DataFrame, windows: DataFrame) -> DataFrame:
    """(key, whole, cluster, head, last, rows) of the windows' classes: those under one key whose sets are alike have one cluster, the first one's ``whole``.
    ``head``: the first window; ``last``: the last document; ``rows``: how many windows."""
    # of a very common window each task's rows become one before they are shuffled
    classes = materialize(windows.groupBy("key", "whole").agg(F.min(F.struct(*UNIT)).alias("head"), F.max(F.struct("doc", "th")).alias("last"), F.count(F.lit(1)).alias("rows")), "window-classes")
    several = classes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    mixed = materialize(classes.join(several, "key").select("key", "whole", "head.*"), "mixed-windows")
    texts = materialize(window_texts(documents, mixed.select(*UNIT)).dropDuplicates(UNIT), "window-texts")
    signed = materialize(sign(texts, UNIT, K, WINDOWS.labels), "signed-windows")
    comps = link(signed, texts, UNIT, WINDOWS).select("digest", F.col("comp").alias("cluster"))
    same = F.col("a.doc").eqNullSafe(F.col("b.doc")) & (F.col("a.th") == F.col("b.th")) & (F.col("a.place") == F.col("b.place"))
    named = mixed.alias("a").join(signed.join(comps, "digest").select(*UNIT, "cluster").dropDuplicates(UNIT).alias("b"), same).select("a.key", "a.whole", "b.cluster")
    # numbers of components are small and from 0 on, hashes anything: a cluster is told by its kind as well
    return classes.join(named, ["key", "whole"], "left").select("key", "whole", F.coalesce(F.concat(F.lit("c"), "cluster"), F.concat_ws(":", F.hex("key"), F.hex("whole"))).alias("cluster"), "head", "last", "rows")


def grouped(documents: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc, th, place, cluster, first, n_copies) of the windows whose cluster several documents have.  What is known of a cluster is gathered by
    classes; each window then meets its class's row, a join whose sides are tables, so a common class is no single task's."""
    classes = materialize(window_classes(documents, windows), "window-clusters")
    several = F.struct(F.col("first.doc").alias("doc"), F.col("first.th").alias("th")) < F.col("last")
    groups = classes.groupBy("cluster").agg(F.min("head").alias("first"), F.sum("rows").alias("n_copies"), F.max("last").alias("last")).where(several).select("cluster", "first", "n_copies")
    wanted = materialize(classes.select("key", "whole", "cluster").join(groups, "cluster"), "window-groups")
    return windows.join(wanted, ["key", "whole"]).select(*UNIT, "cluster", "first", "n_copies")


def clustered(signed: DataFrame, source: DataFrame, forest: Forest) -> DataFrame:
    """(doc, th, place, cluster, first, n_copies) of the lines whose cluster has several, by the components of their classes."""
    classes = link(signed, source, UNIT, forest).select("digest", F.col("comp").alias("cluster"))
    # classes of one paragraph in a component of one class are most: they go before anything is joined
    many = classes.join(signed.groupBy("digest").agg(F.count(F.lit(1)).alias("rows")), "digest")
    repeated = many.groupBy("cluster").agg(F.sum("rows").alias("rows")).where("rows > 1").select("cluster")
    wanted = materialize(classes.join(repeated, "cluster"), "repeated-classes")
    placed = materialize(signed.select(*UNIT, "digest").join(wanted, "digest").select(*UNIT, F.col("cluster").cast("string").alias("cluster")).dropDuplicates(UNIT), "clusters")
    groups = materialize(placed.groupBy("cluster").agg(F.min(F.struct(*UNIT)).alias("first"), F.count(F.lit(1)).alias("n_copies")).where("n_copies > 1"), "groups")
    return placed.join(groups, "cluster").select(*UNIT, "cluster", "first", "n_copies")


def is_first(*fields: str) -> Column:
    same = [F.col(f).eqNullSafe(F.col(f"first.{f}")) for f in fields]
    found = same[0]
    for s in same[1:]:
        found = found & s
    return found


def repeated_lines(documents: DataFrame, read: DataFrame) -> DataFrame:
    """(doc, th, kind, place, start, n_words, cluster, first_doc, n_copies, removed) of the lines that others repeat."""
    lines = read.where("kind = 0")
    text = documents.select("doc", "th", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("place", "text")).where(F.length("text") >= 2 * MIN_WORDS - 1)
    found = clustered(lines.select(*UNIT, "n", "digest", "labels"), text, LINES)
    sizes = lines.select(*UNIT, "start", "n_words").dropDuplicates(UNIT)
    same = F.col("a.doc").eqNullSafe(F.col("b.doc")) & (F.col("a.th") == F.col("b.th")) & (F.col("a.place") == F.col("b.place"))
    joined = found.alias("a").join(sizes.alias("b"), same).select("a.*", "b.start", "b.n_words")
    return joined.select("doc", "th", F.lit("paragraph").alias("kind"), "place", "start", "n_words", "cluster", F.col("first.doc").alias("first_doc"), "n_copies", (~is_first(*UNIT)).alias("removed"))


def repeated_passages(documents: DataFrame, read: DataFrame) -> DataFrame:
    """The same of passages; ``first_doc`` is the smallest of the documents that hold its windows first."""
    order = ["w.key", "w.whole", "doc", "th", "w.place"]
    windows = materialize(shared_keys(ranged(read.where("kind = 1").select("doc", "th", F.explode("windows").alias("w")).select(*order), "key", "doc", "th", "place")), "windows")
    found = grouped(documents, windows).withColumn("removed", ~is_first("doc", "th"))
    order = Window.partitionBy("doc", "th", "removed").orderBy("place")
    begins = F.coalesce(F.col("place") > F.lag("place").over(order) + WINDOW, F.lit(True))
    runs = found.withColumn("run", F.sum(begins.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc", "th", "removed", "run").agg(
        F.min("place").alias("place"), (F.max("place") + WINDOW - F.min("place")).cast("int").alias("n_words"), F.min("cluster").alias("cluster"), F.min("first.doc").alias("first_doc"), F.max("n_copies").alias("n_copies"),
    ).select("doc", "th", F.lit("passage").alias("kind"), "place", F.col("place").alias("start"), "n_words", "cluster", "first_doc", "n_copies", "removed")


def repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All repeated paragraphs and passages: id_col, text_hash, kind, place (line or first word), start (first word), n_words, cluster, first_doc,
    n_copies, removed."""
    source = source_of(documents, id_col, text_col)
    read = materialize(units(source), "units")
    found = repeated_lines(source, read).unionByName(repeated_passages(source, read))
    return found.select(F.col("doc").alias(id_col), F.col("th").alias("text_hash"), "kind", "place", "start", "n_words", "cluster", "first_doc", "n_copies", "removed")


def without_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` with the removed paragraphs and passages cut from their texts, each with the white space that follows it."""
    text = column(text_col)
    at_id, at_hash, spans = fresh(documents.columns, "at_id", "at_hash", "spans")
    gone = repeats(documents, id_col, text_col).where("removed").groupBy(column(id_col).alias(at_id), F.col("text_hash").alias(at_hash)).agg(F.collect_set(F.struct("start", "n_words")).alias(spans))
    joined = documents.join(gone, column(id_col).eqNullSafe(column(at_id)) & (F.xxhash64(text.cast("string")) == column(at_hash)), "left")
    lead = F.regexp_extract(text, f"^[{SPACE}]*", 0)
    words = F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+[{SPACE}]*"), F.lit(0))
    left = F.filter(words, lambda _, i: ~F.exists(column(spans), lambda s: (i >= s["start"]) & (i < s["start"] + s["n_words"])))
    cut = F.when(column(spans).isNull(), text).otherwise(F.concat(lead, F.array_join(left, "")))
    return joined.select(*[(cut.alias(c) if c.lower() == text_col.lower() else column(c)) for c in documents.columns])
