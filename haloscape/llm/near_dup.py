"""MinHash near-duplicates by an LSH forest.

A document's set is its distinct k-word shingles (A-Z lower-cased; words are runs of characters other than white space; fewer words: the whole
sequence).  Documents with 100 * |intersection| >= 80 * |union| are linked, and a component's smallest id stands for it.

1. Each text is read once: ``labels`` MinHash labels of 16 bits, the set's size and a 128-bit digest of the set.  Rows
   with equal digests form a class; from here on a number stands for it, so copies of any number cost nothing further.
2. The forest has ``trees`` orders of the labels, tree t's starting at its own label.  In each tree the rows are sorted; rows
   whose longest common prefix with a neighbour is ``depth`` labels or more go on, all others have no candidates there.
3. Those form regions by their first ``depth`` labels.  A region over ``CROWD`` rows or ``MASS`` shingles is deepened: it is cut where its rows'
   common prefixes are shortest, label by label, until each part fits, and parts side by side are joined again as long as they fit.  So each
   crowded region gets the depth that it needs, place by place, and no task holds more than ``CROWD`` rows of a part.
4. Likely partners agree on ``least`` of all labels.  Full sets confirm them, in two rounds; texts come only for rows that have a likely partner left
   to confirm, and only to the trees in which two such rows meet first:
   a. regions that fit: every likely pair that links don't yet connect; of a crowded region one part a row, with hubs (the ``HUBS`` rows of
      the region's commonest deeper prefixes) added to it;
   b. what parts have cut, exactly: the rows outside a crowded region's largest component against all rows of the region.  Both are dealt to
      blocks of about half of what a part may hold, and each two blocks are a part, so every likely pair of the region that no component connects is confirmed.
   Components follow from the links, which are no more than a spanning set for each part.

So each pair that shares its first ``depth`` labels in a tree and ``least`` of all is confirmed or connected, however crowded its region is; 3 pairs in
100,000 at a similarity of 0.8 share them in no tree.  Round a is linear in the rows.  Round b takes, for a crowded region, a time that grows with the rows outside its largest component
times its rows (comparisons of labels only; of texts only for likely pairs), in tasks that hold two blocks each.

Every table between steps is written to the shared folder.  Edges are proportional to the rows; the driver
holds counts only.

Defined results: ids may be of any type that can be sorted and need not be unique; a row is known by its id and its text.  Null and blank texts
have empty sets, are linked with nothing and stand for themselves.  A component's id is its smallest id that isn't null; ``kept`` says that the
row's id is that id; rows with null ids are kept only if no row of their component has one.  Each row is returned, repeated rows repeated; of
the input's columns only the id is returned; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import LOWER, UPPER, column, discard, frugal, let, materialize, scope

CROWD = 1024
MASS = 1 << 22
HUBS = 16
#: Labels of a tree's order that rows are sorted by.
DEEP = 16
#: The shares that a region's rows are dealt to before the foremost of all are picked.
SALTS = 64
#: Links of which one task of the component loop holds so many; its tables are small beside the documents.
LINKS_A_TASK = 4_096
#: Rows of parts of which one task holds so many, where there are few.
ROWS_A_TASK = 1_024
#: Up to so many holders an element's pairs are counted one by one; above, by products of blocks of so many elements.
FEW = 32
COLUMNS = 1024
#: A part of up to so many rows is compared pair by pair, so many pairs at once, with others beside it, so many rows together.
SMALL = 64
PAIRS = 1 << 15
TOGETHER_ROWS = 2048
SEED = 20240501
#: Characters of texts that are hashed at once, unless one has more.
TOGETHER = 1 << 17

_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_LOW = bytes.maketrans(UPPER.encode(), LOWER.encode())


def word_hashes(text: str | None):
    """64-bit hashes of the words."""
    import numpy as np
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w) for w in _WORD.findall((text or "").encode().translate(_LOW))], np.uint64)


def shingle_hashes(text: str | None, k: int):
    """Sorted distinct 64-bit hashes of the k-word shingles."""
    return shingles(word_hashes(text), k)


def rolling(h, k: int):
    """A 64-bit hash of each k words in a row."""
    import numpy as np

    n = len(h) - k + 1
    out = np.zeros(max(0, n), np.uint64)
    for i in range(k if n > 0 else 0):
        out = (out ^ h[i : n + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def shingles(h, k: int):
    return short_set(h) if len(h) < k else distinct(rolling(h, k))


def short_set(h):
    """The set of a sequence of under k words."""
    import numpy as np
    import xxhash

    return np.array([xxhash.xxh64_intdigest(h.tobytes(), 1)] if len(h) else [], np.uint64)


def shingle_set(text: str | None, k: int) -> frozenset:
    """The same set for comparisons inside one process, by hashes that hold there."""
    words = _WORD.findall((text or "").encode().translate(_LOW))
    if len(words) < k:
        return frozenset([hash(tuple(words))] if words else [])
    return frozenset(map(hash, zip(*[words[i:] for i in range(k)], strict=False)))


def label_factors(labels: int):
    import numpy as np

    return np.random.Generator(np.random.PCG64(SEED)).integers(0, 2**32, labels, np.uint32) | np.uint32(1)


def min_labels(hashes, firsts, counts, factors):
    """16 bits of each minimum, a row for each run of ``counts`` (over 0) hashes from ``firsts`` on; runs are in order and don't overlap."""
    import numpy as np

    low = np.append((hashes ^ (hashes >> np.uint64(32))).astype(np.uint32), np.uint32(0))
    at = np.column_stack([firsts, firsts + counts]).ravel()  # every other of what is reduced lies between runs
    least = np.empty((len(firsts), len(factors)), np.uint32)
    for i, factor in enumerate(factors if len(firsts) else ()):
        least[:, i] = np.minimum.reduceat(low * factor, at)[::2]
    least = (least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (least >> np.uint32(16)).astype(">u2")


def distinct(hashes):
    """Sorted, each once."""
    import numpy as np

    out = np.sort(hashes)
    return np.unique(out) if (out[1:] == out[:-1]).any() else out


def together(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts that are hashed at once, each with its first one's number."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > TOGETHER:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, texts[start:]


def digest_of(hashes) -> bytes:
    """16 bytes that stand for a set of sorted hashes."""
    import xxhash

    return xxhash.xxh3_128_digest(hashes)


def sign(units: DataFrame, keep: Sequence[str], k: int, labels: int) -> DataFrame:
    """The columns ``keep`` and n, digest, labels of each row's ``text``; an empty set's digest and labels are null."""
    kept = [units.schema[c] for c in keep]
    schema = StructType([*kept, StructField("n", LongType()), StructField("digest", BinaryType()), StructField("labels", BinaryType())])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        factors = label_factors(labels)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                n, digests, signed = [], [], []
                for _, texts in together([t or "" for t in part.column(0).to_pylist()]):
                    words = [word_hashes(t) for t in texts]
                    size = np.array([len(w) for w in words])
                    hashes, first = rolling(np.concatenate(words), k), np.cumsum(size) - size
                    sets = [distinct(hashes[a : a + b - k + 1]) if b >= k else short_set(w) for w, a, b in zip(words, first.tolist(), size.tolist(), strict=True)]
                    whole = iter(min_labels(hashes, first[size >= k], size[size >= k] - k + 1, factors))
                    n += [len(s) for s in sets]
                    digests += [digest_of(s) if len(s) else None for s in sets]
                    for s, b in zip(sets, size.tolist(), strict=True):
                        row = next(whole) if b >= k else min_labels(s, np.array([0]), np.array([1]), factors)[0] if b else None
                        signed.append(None if row is None else row.tobytes())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(signed, pa.binary())], names=[*keep, "n", "digest", "labels"])

    return units.select("text", *keep).mapInArrow(frugal(run), schema)


@dataclass(frozen=True)
class Forest:
    """``k``: words of a shingle; ``percent``: the least similarity; ``least``: the share of labels that likely partners agree on."""

    k: int = 4
    percent: int = 80
    labels: int = 160
    trees: int = 20
    depth: int = 4
    least: float = 0.64

    @property
    def starts(self) -> list[int]:
        """The label at which each tree's order starts."""
        return [t * self.labels // self.trees for t in range(self.trees)]


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranged(rows: DataFrame, *order: str) -> DataFrame:
    """Dealt by ranges of the order, so that no value, however common, must fit one task, and sorted there."""
    return rows.repartitionByRange(shuffle_partitions(rows), *order).sortWithinPartitions(*order)


def labels_from(labels: str, start: int, count: int) -> Column:
    """``count`` labels from ``start`` on; after the last comes the first again."""
    return F.expr(f"substring(concat({labels}, {labels}), {2 * start + 1}, {2 * count})")


def colliding(classes: DataFrame, forest: Forest, starts: Sequence[int]) -> DataFrame:
    """(tree, region, rep, n) of the rows that share their first labels in a tree with a neighbour in its order; a range's first and last
    rows go on too, as their neighbours may lie beyond.  ``region``: a hash of the tree and these labels."""
    orders = F.array(*[F.struct(F.lit(t).cast("short").alias("tree"), F.xxhash64(F.lit(t), labels_from("labels", at, forest.depth)).alias("region")) for t, at in enumerate(starts)])
    rows = classes.select("rep", "n", F.explode(orders).alias("s")).select("s.tree", "s.region", "rep", "n")
    # ranges split a common region's rows; in a task one number orders them
    return with_equal_neighbour(rows.repartitionByRange(shuffle_partitions(rows), "region", "rep").sortWithinPartitions("region"), ["region"])


def with_equal_neighbour(sorted_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of a table that is sorted by ``keys`` within its partitions, the rows that equal the row before or after them there, and each
    partition's first and last row."""
    schema = sorted_rows.schema

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        held, held_equal = None, True  # the last row so far, not yet given out, and whether it stays
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([batch])
            whole = whole if held is None else pa.concat_tables([held, whole]).combine_chunks()
            n = whole.num_rows
            same = np.ones(n - 1, bool)
            for key in keys:
                values = whole[key].combine_chunks()
                same &= pc.equal(values.slice(1), values.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            keep = np.concatenate([[held_equal], same]) | np.concatenate([same, [False]])
            held, held_equal = whole.slice(n - 1), bool(keep[-1])
            yield from whole.slice(0, n - 1).filter(pa.array(keep[:-1])).to_batches()
        if held is not None:
            yield from held.to_batches()

    return sorted_rows.mapInArrow(frugal(run), schema)


def cut(common, weight, depth: int, crowd: int, mass: int):
    """The part of each sorted row.  ``common``: labels shared with the row before; rows that share under ``depth`` never share a part.
    An interval that is too large is cut at its shortest common prefixes; neighbours are joined as long as they fit."""
    import numpy as np

    n = len(common)
    before = np.concatenate([[0], np.cumsum(weight)])
    marks = np.zeros(n, np.int64)  # 1 where a part starts
    edges = np.concatenate([[0], (common[1:] < depth).nonzero()[0] + 1, [n]]) if n else np.zeros(1, np.int64)
    todo = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
    fits = lambda lo, hi: hi - lo <= crowd and before[hi] - before[lo] <= mass or hi - lo == 1
    while todo:
        lo, hi = todo.pop()
        marks[lo] = 1
        if fits(lo, hi):
            continue
        inner = common[lo + 1 : hi]
        shortest = inner.min()
        if shortest >= DEEP:  # alike in all labels that the order shows: runs of what fits
            borders = [*range(lo, hi, max(1, crowd)), hi] if before[hi] - before[lo] <= mass else [*range(lo, hi + 1)]
        else:
            borders = [lo, *((inner == shortest).nonzero()[0] + lo + 1).tolist(), hi]
        start = borders[0]
        for a, b in zip(borders, borders[1:], strict=False):
            if not fits(start, b) and a > start:
                if not fits(start, a):
                    todo.append((start, a))
                marks[start] = 1
                start = a
        marks[start] = 1
        if not fits(start, hi) and (start > lo or shortest < DEEP):
            todo.append((start, hi))
    return np.cumsum(marks)


def with_parts(rows: DataFrame, labels: DataFrame, forest: Forest, starts: Sequence[int]) -> DataFrame:
    """Rows of crowded regions with ``deeper``, their tree's order from its first label on, and ``run``, the number (over 0) of their part.  A
    task holds the labels of its range of rows."""
    crowd, mass, depth, deep = CROWD, MASS, forest.depth, min(DEEP, forest.labels)
    deeper = F.get(F.array(*[labels_from("labels", at, deep) for at in starts]), F.col("tree").cast("int"))
    order = ("tree", "region", "deeper", "rep")
    sorted_rows = ranged(rows.join(labels, "rep").select("tree", "region", deeper.alias("deeper"), "rep", "n"), *order)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        labels = np.concatenate([np.frombuffer(b"".join(b.column("deeper").to_pylist()), ">u2").reshape(b.num_rows, -1) for b in held])
        region, weight = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("region", "n"))
        same = np.concatenate([[False], region[1:] == region[:-1]])
        common = np.zeros(len(region), np.int64)
        for i in range(labels.shape[1]):
            same[1:] &= labels[1:, i] == labels[:-1, i]
            common += same
        common[common == labels.shape[1]] = DEEP
        runs, at = cut(common, weight, depth, crowd, mass) + ((TaskContext.get().partitionId() + 1) << 40), 0
        for b in held:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(runs[at : at + b.num_rows], pa.int64())], names=[*b.schema.names, "run"])
            at += b.num_rows

    return sorted_rows.mapInArrow(frugal(run), StructType([*sorted_rows.schema.fields, StructField("run", LongType())]))


REGION = ["tree", "region"]


def foremost(rows: DataFrame, *order: Column) -> DataFrame:
    """The first ``HUBS`` rows of each region.  They are picked among the first ones of each salted share, so no task sorts a region."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)))
    first = salted.withColumn("place", F.row_number().over(Window.partitionBy(*REGION, "salt").orderBy(*order))).where(F.col("place") <= HUBS)
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*REGION).orderBy(*order))).where(F.col("place") <= HUBS).select(*REGION, "rep")


def spots_of(pieces: DataFrame, labels: DataFrame, trees: int) -> DataFrame:
    """(rep, labels, n, places, runs): each row once, with its places (tree, region, run) in the trees' order, and its part in each tree, 0 where it
    has none.  What is known of a row is joined here, once a row; ``by_place`` then deals it to its trees without a join."""
    spots = pieces.groupBy("rep").agg(F.first("n").alias("n"), F.sort_array(F.collect_set(F.struct(*REGION, "run"))).alias("places"))
    at = F.map_from_entries(F.transform("places", lambda p: F.struct(p["tree"], p["run"])))
    runs = let(at, lambda m: F.array(*[F.coalesce(F.try_element_at(m, F.lit(t).cast("short")), F.lit(0).cast("bigint")) for t in range(trees)]))
    return spots.join(labels.hint("merge"), "rep").select("rep", "labels", "n", "places", runs.alias("runs"))


def by_place(spots: DataFrame) -> DataFrame:
    """A row for each place of each row: tree, region and run, and the other columns."""
    kept = [c for c in spots.columns if c != "places"]
    return spots.select(*kept, F.explode("places").alias("p")).select(*kept, "p.*")


PART = [*REGION, "part", "rep", "labels", "runs", "comp", "mark"]


def with_hubs(dealt_rows: DataFrame, hubs: DataFrame) -> DataFrame:
    """Parts (tree, region, part, rep, labels, runs, comp) with their region's hubs (the same without part) added to each, which are marked.  A hub of its
    own part comes twice; ``by_part`` takes it once."""
    met = dealt_rows.select(*REGION, "part").distinct().join(hubs, REGION).withColumn("mark", F.lit(True)).select(*PART)
    return dealt_rows.withColumn("mark", F.lit(False)).select(*PART).union(met)


def known(rows: DataFrame, comps: DataFrame) -> DataFrame:
    return rows.join(comps, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))


def blocks_of(spots: DataFrame) -> DataFrame:
    """Crowded regions' rows in parts that hold two blocks each: each two rows of a region that aren't both in its largest component share one.  ``mark``
    tells a part's blocks apart; a part of one block twice has none.  ``spots``: with components."""
    placed = by_place(spots)
    sizes = placed.groupBy(*REGION, "comp").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("mass"))
    whole = sizes.groupBy(*REGION).agg(F.max(F.struct("rows", "mass", "comp")).alias("top"), F.sum("rows").alias("rows"), F.sum("mass").alias("mass")).where("top.rows < rows")
    blocks = lambda rows, mass: F.greatest(F.ceil(rows / max(1, CROWD // 2)), F.ceil(mass / max(1, MASS // 2)))
    out, inside = blocks(F.col("rows") - F.col("top.rows"), F.col("mass") - F.col("top.mass")), blocks(F.col("top.rows"), F.col("top.mass"))
    rows = placed.join(whole.select(*REGION, F.col("top.comp").alias("top"), out.alias("out"), inside.alias("inside")), REGION)
    outside, every = F.col("comp") != F.col("top"), F.col("out") + F.col("inside")
    block = F.when(outside, F.pmod(F.xxhash64("rep"), F.col("out"))).otherwise(F.col("out") + F.pmod(F.xxhash64("rep"), F.col("inside")))
    met = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(outside, every).otherwise(F.col("out")) - 1)))
    part = 1 + F.least("block", "other") * every + F.greatest("block", "other")
    # whoever shares a region of an earlier tree has met there, whatever its part
    return met.select(*REGION, part.alias("part"), "rep", "labels", F.lit(None).cast("array<bigint>").alias("runs"), "comp", (F.col("block") > F.col("other")).alias("mark"))


def agreement(rows):
    """How many labels each two rows share."""
    import numpy as np

    if len(rows) <= 64:
        return (rows[:, None, :] == rows[None, :, :]).sum(2, dtype=np.int16)
    alike = np.zeros((len(rows), len(rows)), np.int16)
    for c in range(rows.shape[1]):
        alike += rows[:, c, None] == rows[None, :, c]
    return alike


def overlaps(sets, n: int):
    """How many elements each two of ``n`` sorted sets share.  Elements that few sets hold are counted pair by pair, those that many hold by products
    of blocks of their columns, so memory is that of the elements and of one number a pair."""
    import numpy as np

    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    starts = np.concatenate([[0], (values[1:] != values[:-1]).nonzero()[0] + 1])
    holders = np.diff([*starts, len(values)])
    number, held = np.repeat(np.arange(len(starts)), holders), np.repeat(holders, holders)
    few = (held > 1) & (held <= FEW)
    who, what = owner[few], number[few]
    both = np.zeros(n * n, np.int64)
    for apart in range(1, FEW):
        same = (what[apart:] == what[:-apart]).nonzero()[0]
        if not len(same):
            break
        both += np.bincount(who[same] * n + who[same + apart], minlength=n * n)
    both = both.reshape(n, n)
    both += both.T
    many = held > FEW
    who, column_of = owner[many], np.unique(number[many], return_inverse=True)[1]
    for at in range(0, int(column_of.max()) + 1 if len(column_of) else 0, COLUMNS):
        here = (column_of >= at) & (column_of < at + COLUMNS)
        block = np.zeros((n, COLUMNS), np.float32)
        block[who[here], column_of[here] - at] = 1
        both += (block @ block.T).astype(np.int64)
    return both


class Pairs:
    """The pairs of the rows of some parts that share enough labels (``i`` < ``j``, rows by number; ``near``: how many), and which of them are left to
    confirm (``first``): all, or where rows are marked in a part of two blocks (over 0) those of a marked and another row, that meet here first, in no earlier
    tree, and aren't connected yet.  Parts of crowded regions' first round (under 0) don't ask where their rows met before.

    ``parts``: (key, lists of rep, labels, runs, comp and mark) of each.  The pairs of small parts are compared together."""

    def __init__(self, parts: list, forest: Forest):
        import numpy as np

        sizes = np.array([len(data[0]) for _, data in parts])
        self.begin = begin = np.cumsum(sizes) - sizes
        rows = np.frombuffer(b"".join(b"".join(data[1]) for _, data in parts), ">u2").reshape(-1, forest.labels).astype(np.uint16)
        nothing = [0] * forest.trees
        at = np.array([nothing if r is None else r for _, data in parts for r in data[2]], np.int64)
        comp, mark = (np.array([v for _, data in parts for v in data[c]], t) for c, t in ((3, np.int64), (4, bool)))
        tree, part = (np.array([key[c] for key, _ in parts], np.int64) for c in (0, 2))
        self.part_of = part_of = np.repeat(np.arange(len(parts)), sizes)
        least, found = int(forest.least * forest.labels), []
        for n in np.unique(sizes).tolist():
            base = begin[sizes == n]
            if n <= SMALL:
                i, j = np.triu_indices(n, 1)
                step = max(1, PAIRS // len(i))
                for some in range(0, len(base), step):
                    a, b = ((base[some : some + step, None] + v).ravel() for v in (i, j))
                    near = (rows[a] == rows[b]).sum(1, dtype=np.int16)
                    likely = near >= least
                    found.append((a[likely], b[likely], near[likely]))
            else:
                for start in base.tolist():
                    near = np.triu(agreement(rows[start : start + n]), 1)
                    a, b = (near >= max(1, least)).nonzero()
                    found.append((a + start, b + start, near[a, b]))
        i, j, near = (np.concatenate([f[c] for f in found]) for c in range(3))
        order = np.argsort(part_of[i], kind="stable")
        self.i, self.j, self.near = i, j, near = i[order], j[order], near[order]
        of = part_of[i]
        first = (near > 0) & (comp[i] != comp[j])
        two = (part > 0) & np.logical_or.reduceat(mark, begin)
        first &= ~two[of] | (mark[i] != mark[j])
        for t, start in enumerate(forest.starts):
            ask = (first & (part[of] >= 0) & (tree[of] > t)).nonzero()[0]
            if len(ask):
                a, b, columns = i[ask], j[ask], [(start + d) % forest.labels for d in range(forest.depth)]
                met = at[a, t] == at[b, t]
                for c in columns:
                    met &= rows[a, c] == rows[b, c]
                first[ask[met]] = False
        self.first = first
        # the row of each part that agrees most with others
        agreed = np.bincount(i, near, len(rows)) + np.bincount(j, near, len(rows))
        top = (agreed == np.repeat(np.maximum.reduceat(agreed, begin), sizes)).nonzero()[0]
        self.hub = top[np.unique(part_of[top], return_index=True)[1]]


def gathered(parts: Iterator) -> Iterator[list]:
    """Parts of ``by_part``, so many together as have ``TOGETHER_ROWS`` rows, a large one alone."""
    held, rows = [], 0
    for key, data in parts:
        if held and rows + len(data[0]) > TOGETHER_ROWS:
            yield held
            held, rows = [], 0
        held.append((key, data))
        rows += len(data[0])
    if held:
        yield held


def by_part(batches: Iterator, columns: list[str]) -> Iterator:
    """(tree, part, lists of the columns) of each part of sorted batches, each ``rep`` once and marked if any of its rows is."""
    key, held, mark = None, [[] for _ in columns], columns.index("mark")
    for batch in batches:
        data = batch.to_pydict()
        for *at, row in zip(data["tree"], data["region"], data["part"], zip(*(data[c] for c in columns), strict=True), strict=True):
            if key != at:
                if len(held[0]) > 1:
                    yield key, held
                key, held = at, [[] for _ in columns]
            elif held[0][-1] == row[0]:
                held[mark][-1] |= row[mark]
                continue
            for values, value in zip(held, row, strict=True):
                values.append(value)
    if len(held[0]) > 1:
        yield key, held


def dealt(regions: DataFrame, rows: int) -> DataFrame:
    """Each part in one task, sorted; ``rows``: about how many there are."""
    return regions.repartition(shuffle_partitions(regions), *REGION, "part").sortWithinPartitions(*REGION, "part", "rep").coalesce(1 + rows // ROWS_A_TASK)


ROW = ["rep", "labels", "runs", "comp", "mark"]


def partnered(regions: DataFrame, rows: int, forest: Forest) -> DataFrame:
    """(tree, region, part, rep, labels, runs, comp, mark) of the rows that have a likely partner left to confirm, with the hubs of their parts."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        types = (pa.int16(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.bool_())
        for parts in gathered(by_part(batches, ROW)):
            found = Pairs(parts, forest)
            if not found.first.any():
                continue
            keep = np.zeros(len(found.part_of), bool)
            keep[found.i[found.first]] = keep[found.j[found.first]] = True
            keep[found.hub[np.unique(found.part_of[keep])]] = True
            kept = [(p, i) for p, i in zip(found.part_of[keep].tolist(), (keep.nonzero()[0] - found.begin[found.part_of[keep]]).tolist(), strict=True)]
            values = [*([parts[p][0][c] for p, _ in kept] for c in range(3)), *([parts[p][1][c][i] for p, i in kept] for c in range(len(ROW)))]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=[*REGION, "part", *ROW])

    return dealt(regions, rows).select(*REGION, "part", *ROW).mapInArrow(frugal(run), "tree short, region bigint, part bigint, rep bigint, labels binary, runs array<bigint>, comp bigint, mark boolean")


def links_of(regions: DataFrame, count: int, forest: Forest) -> DataFrame:
    """(a, b): confirmed links, of components so far, that connect all rows of a part that links connect.  Full sets are compared: each row's with its
    hub's, then those of the likely partners left, unless links already connect them.  Where many prove unlike, all the others are counted at once."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def linked(reps: list, comps: list, texts: list[str], with_hub: list[tuple[int, int]], i, j) -> list[tuple[int, int]]:
            sets: dict[int, frozenset] = {}
            known: dict[int, int] = {}
            up = [known.setdefault(c, i) for i, c in enumerate(comps)]
            found = []

            def top(i: int) -> int:
                while up[i] != i:
                    up[i] = i = up[up[i]]
                return i

            def members(i: int) -> frozenset:
                if i not in sets:
                    sets[i] = shingle_set(texts[i], forest.k)
                return sets[i]

            def connect(i: int, j: int) -> None:
                x, y = top(i), top(j)
                if x != y:
                    up[x] = y
                    found.append((comps[i], comps[j]))

            def confirm(i: int, j: int) -> bool:
                """Whether the two are connected now."""
                if top(i) == top(j):
                    return True
                a, b = members(i), members(j)
                if 100 * min(len(a), len(b)) >= forest.percent * max(len(a), len(b)):
                    both = len(a & b)
                    if 100 * both >= forest.percent * (len(a) + len(b) - both):
                        connect(i, j)
                        return True
                return False

            for x, y in with_hub:
                confirm(x, y)
            unlike = 0
            while len(i) and unlike <= 2 * len(reps):
                unlike += sum(not confirm(x, y) for x, y in zip(i[:SMALL].tolist(), j[:SMALL].tolist(), strict=True))
                i, j = i[SMALL:], j[SMALL:]
            if len(i):
                sets.clear()
                all_of = [shingle_hashes(t, forest.k) for t in texts]
                size = np.array([len(s) for s in all_of])
                both = overlaps(all_of, len(reps))[i, j]
                alike = 100 * both >= forest.percent * (size[i] + size[j] - both)
                for x, y in zip(i[alike].tolist(), j[alike].tolist(), strict=True):
                    connect(x, y)
            return found

        columns = [*ROW, "text"]
        for parts in gathered(by_part(batches, columns)):
            of = Pairs([(key, data[:-1]) for key, data in parts], forest)
            # numbers within their parts; a part's hub first, then the pairs left, the likeliest first
            at, i, j = of.part_of[of.i], of.i - of.begin[of.part_of[of.i]], of.j - of.begin[of.part_of[of.i]]
            hub = ((of.i == of.hub[at]) | (of.j == of.hub[at])).nonzero()[0]
            left = of.first.nonzero()[0]
            left = left[np.lexsort((-of.near[left], at[left]))]
            edges = [np.searchsorted(at[some], np.arange(len(parts) + 1)).tolist() for some in (hub, left)]
            with_hub, i, j, found = list(zip(i[hub].tolist(), j[hub].tolist(), strict=True)), i[left], j[left], []
            for p, (_, (reps, _, _, comps, _, texts)) in enumerate(parts):
                (a, b), (lo, hi) = (e[p : p + 2] for e in edges)
                if a < b or lo < hi:
                    found += linked(reps, comps, texts, with_hub[a:b], i[lo:hi], j[lo:hi])
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt(regions, count).select(*REGION, "part", *ROW, "text").mapInArrow(frugal(run), "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(rep, comp): the smallest member of each linked row's component, by hooking to the smallest neighbour and jumping along
    labels until nothing changes; the driver sees counts.  The loop's tables have as many partitions as the links need."""
    spark = links.sparkSession
    with scope() as made:
        needed = 1 + links.count() // LINKS_A_TASK
        both = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().coalesce(needed), "links")
        labels = materialize(both.groupBy(F.col("a").alias("rep")).agg(F.least(F.min("b"), F.first("a")).alias("comp")).coalesce(needed), "labels")
        while True:
            near = both.join(labels.select(F.col("rep").alias("b"), F.col("comp").alias("c")), "b").groupBy(F.col("a").alias("rep")).agg(F.min("c").alias("c"))
            hooked = labels.join(near, "rep").select("rep", F.least("comp", "c").alias("comp"), F.col("comp").alias("old"))
            jump = labels.select(F.col("rep").alias("comp"), F.col("comp").alias("up"))
            jumped = materialize(hooked.join(jump, "comp", "left").select("rep", F.least("comp", F.coalesce("up", "comp")).alias("comp"), "old").coalesce(needed), "labels")
            discard(spark, made[1:-1])
            del made[1:-1]
            if not jumped.where("comp < old").limit(1).count():
                discard(spark, made[:1])
                return jumped.select("rep", "comp")
            labels = jumped.select("rep", "comp")


class Round:
    """What each round needs: class labels, and the texts by their rows' keys."""

    def __init__(self, classes: DataFrame, source: DataFrame, keys: Sequence[str], forest: Forest):
        self.labels, self.heads = classes.select("rep", "labels"), classes.select("rep", *[F.col(f"head.{k}").alias(f"head_{i}") for i, k in enumerate(keys)])
        self.source, self.keys, self.forest = source, keys, forest

    def texts(self, reps: DataFrame) -> DataFrame:
        """(rep, text) of the row that heads each class; rows equal in all keys have equal texts."""
        heads = self.heads.join(reps.distinct(), "rep", "left_semi")
        same = [column(k).eqNullSafe(F.col(f"head_{i}")) for i, k in enumerate(self.keys)]
        on = same[0]
        for s in same[1:]:
            on = on & s
        return self.source.join(heads.hint("merge"), on).select("rep", "text").dropDuplicates(["rep"])

    def links(self, regions: DataFrame, rows: int) -> DataFrame:
        """(a, b) confirmed in ``regions``, parts of about so many rows with their labels and components."""
        met = materialize(partnered(regions, rows, self.forest), "partnered")
        found = materialize(self.texts(met.select("rep")), "texts")
        return materialize(links_of(met.join(found, "rep"), met.count(), self.forest), "links")


def crowded_components(rows: DataFrame, crowded: DataFrame, hot: DataFrame, classes: DataFrame, rounds: Round, forest: Forest) -> DataFrame:
    """(rep, comp) after both rounds."""
    spots = materialize(spots_of(hot, rounds.labels, forest.trees), "spots")
    heads = hot.groupBy(*REGION, "deeper").agg(F.count(F.lit(1)).alias("rows"), F.min("rep").alias("rep"))
    hubs = materialize(foremost(heads, F.desc("rows"), F.asc("deeper")).join(spots.select("rep", "labels", "runs"), "rep"), "hubs")
    held = rounds.labels.join(spots.select("rep", "runs"), "rep", "left")
    cool = rows.join(crowded, REGION, "left_anti").join(held.hint("merge"), "rep").select(*REGION, F.lit(0).cast("bigint").alias("part"), "rep", "labels", "runs", F.col("rep").alias("comp"), F.lit(False).alias("mark"))
    first = F.get("places", F.lit(0))
    firsts = spots.withColumn("p", first).select("p.tree", "p.region", (-F.col("p.run")).alias("part"), "rep", "labels", "runs", F.col("rep").alias("comp"))
    comps = components(rounds.links(cool.union(with_hubs(firsts, hubs.withColumn("comp", F.col("rep")))), rows.count()))
    blocks = materialize(blocks_of(known(spots, comps)), "blocks")
    # links of components, which are few
    joined = materialize(components(rounds.links(blocks, blocks.count())), "joined")
    moved = joined.select(F.col("rep").alias("comp"), F.col("comp").alias("to"))
    return comps.join(moved, "comp", "left").select("rep", F.coalesce("to", "comp").alias("comp")).union(joined.join(comps.select("rep"), "rep", "left_anti").select("rep", "comp"))


def link(signed: DataFrame, source: DataFrame, keys: Sequence[str], forest: Forest) -> DataFrame:
    """(digest, rep, comp): each set's class, its number, and its component's smallest number.  ``signed``: what ``sign``
    gives with ``keys``, written; ``source``: ``keys`` and text of all rows."""
    classes = signed.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.first("labels").alias("labels"), F.first("n").alias("n"), F.min(F.struct(*[column(k) for k in keys])).alias("head"))
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")  # numbers stand once they are written
    rounds = Round(classes, source, keys, forest)
    rows = materialize(colliding(classes, forest, forest.starts), "colliding")
    sizes = rows.groupBy(*REGION).agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("mass"))
    crowded = materialize(sizes.where((F.col("rows") > CROWD) | (F.col("mass") > MASS)).select(*REGION), "crowded")
    hot = materialize(with_parts(rows.join(crowded, REGION), rounds.labels, forest, forest.starts), "hot")
    crowds = not hot.isEmpty()
    none = F.lit(None).cast("array<bigint>")
    if not crowds:
        labelled = rows.join(rounds.labels.hint("merge"), "rep")  # the same join at every size
        whole = labelled.select(*REGION, F.lit(0).cast("bigint").alias("part"), "rep", "labels", none.alias("runs"), F.col("rep").alias("comp"), F.lit(False).alias("mark"))
        comps = components(rounds.links(whole, rows.count()))
    else:
        comps = crowded_components(rows, crowded, hot, classes, rounds, forest)
    return classes.select("digest", "rep").join(comps, "rep", "left").select("digest", "rep", F.coalesce("comp", "rep").alias("comp"))


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", forest: Forest = Forest()) -> DataFrame:
    """(id_col, n_shingles, component_id, kept, text_hash, component) for each row; ``text_hash`` tells texts under one id apart, and ``component``,
    a number that holds within this result and is null for empty sets, tells components apart that share their smallest id."""
    text = column(text_col).cast("string")
    source = documents.select(column(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    signed = materialize(sign(source, ["id", "th"], forest.k, forest.labels), "signed")
    classes = link(signed, source, ["id", "th"], forest).select("digest", "comp")
    named = signed.where("digest is not null").groupBy("digest").agg(F.min("id").alias("least")).join(classes, "digest")
    # a component's smallest id, in two steps: by class, then by component
    smallest = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    found = materialize(named.join(smallest, "comp").select("digest", "component_id", F.col("comp").alias("component")), "components")
    out = signed.select("id", "th", "n", "digest").join(found, "digest", "left")
    stands = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), stands.alias("component_id"), F.coalesce(F.col("id") == stands, stands.isNull()).alias("kept"), F.col("th").alias("text_hash"), "component")
