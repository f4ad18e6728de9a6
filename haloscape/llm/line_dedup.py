"""Line dedup by a sharded minimal perfect hash.

A line's key is the line without white space at its ends, A-Z lower-cased.  Keys of ``min_chars`` code points or more that ``min_documents``
documents or more hold lose all their lines, except in the largest id that holds them.

1. Each document gives its distinct keys of ``min_chars`` or more once, as 128 bits of hash; counts and the largest id are combined before the
   shuffle, so a line that every document has costs one row a task.
2. Keys of ``min_documents`` or more are dealt to shards of about ``SHARD_KEYS`` by their hash; each shard becomes a minimal perfect hash (levels of
   bits: a key takes the first level in which no other key has its bit, its number is the count of bits before it) and three arrays in that order:
   64 bits of fingerprint, the count and the largest id.  That is some 20 bytes a key, whatever the line's length.  All other keys need no entry: they
   have no bit, or a fingerprint that differs (each distinct line passes by chance with odds of 2^-64).
3. Documents probe the arrays for the lines that they hold; no line is joined.  Arrays of up to ``MAX_SENT`` bytes, by their measured
   sum, are sent to the executors.  Above that, the keys that ``1 / HOT`` of all key rows or more hold (so ``HOT`` at most) are
   still sent; documents' other keys go to the shards in a shuffle and pass by their shard's arrays, one shard at a time in a task, and
   what they lose comes back by id.  Both ways give the same rows.

Results: every row stays, with ``n_lines``, ``n_dropped``, ``dropped_lines`` (from 0) and ``kept_text`` (the other lines, joined by \\n).  A null or
empty text is one empty line, which is never dropped.  Each row counts as a document; rows with the same id that hold a line as the largest id all
keep it.  A null id is below all others.  Repeated lines of a text count once and are dropped together.  Ids are integers.  Columns whose names clash
with the added ones are replaced.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, ascii_lower, column, fresh, let, materialize, others

ADDED = ("n_lines", "n_dropped", "dropped_lines", "kept_text")
SHARD_KEYS = 1 << 16
MAX_SENT = 64 << 20
HOT = 10_000
GAMMA = 2.0
NO_ID = -(1 << 63)
SECOND = 0x5EED


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit generator: all bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class PerfectHash:
    """Numbers 0 to n - 1 for n distinct keys of two 64-bit halves; other keys get -1 or any number."""

    sizes: np.ndarray  # bits of each level, multiples of 64
    bits: np.ndarray  # uint64, level after level
    before: np.ndarray  # set bits before each word

    @staticmethod
    def places(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mixed(a + np.uint64(2 * level + 1) * mixed(b)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        sizes, words, level = [], [], 0
        while len(a):
            size = -(-int(GAMMA * len(a)) // 64) * 64
            at = cls.places(a, b, level, size)
            alone = np.bincount(at, minlength=size)[at] == 1
            taken = np.zeros(size, np.uint8)
            taken[at[alone]] = 1
            sizes.append(size)
            words.append(np.packbits(taken, bitorder="little").view("<u8"))
            a, b, level = a[~alone], b[~alone], level + 1
        bits = np.concatenate(words) if words else np.zeros(0, np.uint64)
        return cls(np.array(sizes, np.int64), bits, np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])[:-1])

    def numbers(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, left, start = np.full(len(a), -1, np.int64), np.arange(len(a)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = self.places(a[left], b[left], level, size) + start
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[left[hit]] = self.before[at[hit] >> 6] + below
            left, start = left[~hit], start + size
        return out


@dataclass(frozen=True)
class Shard:
    hash: PerfectHash
    fingerprints: np.ndarray
    counts: np.ndarray
    lasts: np.ndarray

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray, counts: np.ndarray, lasts: np.ndarray) -> Shard:
        found = PerfectHash.build(a, b)
        order = np.argsort(found.numbers(a, b))
        return cls(found, a[order], counts[order], lasts[order])

    def pack(self) -> list[bytes]:
        h = self.hash
        return [x.tobytes() for x in (h.sizes, h.bits, h.before, self.fingerprints, self.counts, self.lasts)]

    @classmethod
    def unpack(cls, parts: list[bytes]) -> Shard:
        s, b, r, f, c, x = (np.frombuffer(p, k) for p, k in zip(parts, ("<i8", "<u8", "<i8", "<u8", "<i8", "<i8"), strict=True))
        return cls(PerfectHash(s, b, r), f, c, x)

    def lost(self, a: np.ndarray, b: np.ndarray, ids: np.ndarray, least: int) -> np.ndarray:
        """Whether the document of that id loses its lines of this key."""
        at = self.hash.numbers(a, b)
        out = np.zeros(len(a), bool)
        seen = np.flatnonzero(at >= 0)
        at = at[seen]
        out[seen] = (self.fingerprints[at] == a[seen]) & (self.counts[at] >= least) & (self.lasts[at] != ids[seen])
        return out


PARTS = ("sizes", "bits", "before", "fingerprints", "counts", "lasts")
SHARD_SCHEMA = "shard long, " + ", ".join(f"{p} binary" for p in PARTS)


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keys(text: Column) -> Column:
    """The key of each line, in order."""
    return F.transform(lines(ascii_lower(F.coalesce(text, F.lit("")))), lambda x: F.btrim(x, F.lit(SPACES)))


def halves(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit(SECOND), key)


def key_rows(documents: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, a, b): each document's distinct long keys, hashed."""
    long = F.array_distinct(F.filter(keys(column(text_col)), lambda x: F.length(x) >= min_chars))
    rows = documents.select(F.coalesce(column(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), F.explode(long).alias("key"))
    a, b = halves(F.col("key"))
    return rows.select("id", a.alias("a"), b.alias("b"))


def common_keys(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_documents: int = 5) -> DataFrame:
    """(a, b, n, last): the keys that enough documents hold."""
    rows = key_rows(documents, id_col, text_col, min_chars)
    return rows.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("id").alias("last")).where(F.col("n") >= min_documents)


def build_shards(found: DataFrame, n_shards: int) -> DataFrame:
    """A row of packed arrays for each shard that has keys."""

    def build(table: pa.Table) -> pa.Table:
        a, b = (table.column(c).to_numpy().view(np.uint64) for c in "ab")
        shard = Shard.build(a, b, table.column("n").to_numpy(), table.column("last").to_numpy())
        return pa.table({"shard": table.column("shard").slice(0, 1), **{p: pa.array([x], pa.binary()) for p, x in zip(PARTS, shard.pack(), strict=True)}})

    return found.withColumn("shard", F.pmod("b", F.lit(n_shards))).groupBy("shard").applyInArrow(build, SHARD_SCHEMA)


def shard_bytes() -> Column:
    size = F.lit(0).cast("bigint")
    for p in PARTS:
        size = size + F.octet_length(p)
    return size


def sent(shards: DataFrame) -> Callable[[], dict[int, Shard]]:
    """The arrays on the executors; their size has been checked."""
    packed = shards.sparkSession.sparkContext.broadcast({r["shard"]: [bytes(r[p]) for p in PARTS] for r in shards.toLocalIterator()})
    return lambda: {k: Shard.unpack(v) for k, v in packed.value.items()}


def sent_probe(shards: DataFrame, n_shards: int, least: int) -> Callable[[Column, Column, Column], Column]:
    """(id, a of each line, b of each line; null for short lines) to the positions of the lines that go."""
    held = sent(shards)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def probe(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known = held()
        for ids, a, b in columns:
            lengths = a.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            valid = a.flatten().is_valid().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(ids)), lengths)[valid]
            place = (np.arange(len(valid)) - np.repeat(np.cumsum(lengths) - lengths, lengths))[valid]
            ha, hb = (x.flatten().drop_null().to_numpy(zero_copy_only=False).view(np.uint64) for x in (a, b))
            own, shard = ids.to_numpy(zero_copy_only=False)[of], hb.view(np.int64) % n_shards
            lost, order = np.zeros(len(of), bool), np.argsort(shard, kind="stable")
            ends = np.flatnonzero(np.diff(shard[order], append=-1)) + 1
            for start, end in zip([0, *ends[:-1]], ends, strict=False):
                part = order[start:end]
                if (s := known.get(int(shard[part[0]]))) is not None:
                    lost[part] = s.lost(ha[part], hb[part], own[part], least)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(of[lost], minlength=len(ids)))])
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(place[lost], pa.int32()))

    return probe


def routed(rows: DataFrame, shards: DataFrame, n_shards: int, least: int) -> DataFrame:
    """(id, a, b) of the rows that go: rows meet their shard's arrays in a shuffle."""
    probes = rows.select(F.pmod("b", F.lit(n_shards)).alias("shard"), F.lit(1).alias("kind"), "id", "a", "b", *[F.lit(None).cast("binary").alias(p) for p in PARTS])
    arrays = shards.select("shard", F.lit(0).alias("kind"), *[F.lit(0).cast("bigint").alias(c) for c in ("id", "a", "b")], *PARTS)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            shard, kind = (batch.column(c).to_numpy() for c in ("shard", "kind"))
            cuts = np.flatnonzero((np.diff(shard) != 0) | (kind[1:] == 0)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(shard)], strict=True):
                if start < end and kind[start] == 0:
                    at, held = shard[start], Shard.unpack([batch.column(p)[int(start)].as_py() for p in PARTS])
                    start += 1
                if start < end and at == shard[start]:
                    part = batch.slice(start, end - start)
                    ids, a, b = (part.column(c).to_numpy() for c in ("id", "a", "b"))
                    gone = held.lost(a.view(np.uint64), b.view(np.uint64), ids, least)
                    yield part.filter(pa.array(gone)).select(["id", "a", "b"])

    met = arrays.unionByName(probes).repartition("shard").sortWithinPartitions("shard", "kind")
    return met.mapInArrow(meet, "id long, a long, b long")


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def listed_places(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """(a, b of each line; the pairs that go) to the positions of the lines that go."""
    for a, b, gone in columns:
        out = []
        for ha, hb, pairs in zip(a.to_pylist(), b.to_pylist(), gone.to_pylist(), strict=True):
            known = {(p["a"], p["b"]) for p in pairs or ()}
            out.append([i for i, k in enumerate(zip(ha, hb, strict=True)) if k in known] if known else [])
        yield pa.array(out, pa.list_(pa.int32()))


def drop_common_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_documents: int = 5) -> DataFrame:
    """``documents`` with ``n_lines``, ``n_dropped``, ``dropped_lines`` and ``kept_text``."""
    if {id_col.lower(), text_col.lower()} & set(ADDED):
        raise ValueError(f"the id and the text can't be called {ADDED}")
    found = materialize(common_keys(documents, id_col, text_col, min_chars, min_documents), "keys")
    n, total = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_shards = max(1, -(-n // SHARD_KEYS))
    shards = materialize(build_shards(found, n_shards), "shards")
    size = shards.agg(F.coalesce(F.sum(shard_bytes()), F.lit(0))).first()[0]
    text = column(text_col)
    ha, hb, i, gone = fresh([*documents.columns, *ADDED], "ha", "hb", "i", "gone")
    hashed = lambda k: F.transform(keys(text), lambda x: F.when(F.length(x) >= min_chars, halves(x)[k]))
    plain = documents.select(*others(documents, ADDED)).withColumns({ha: hashed(0), hb: hashed(1), i: F.coalesce(column(id_col).cast("bigint"), F.lit(NO_ID))})
    if size <= MAX_SENT:
        out = plain.withColumn("dropped_lines", sent_probe(shards, n_shards, min_documents)(column(i), column(ha), column(hb)))
    else:
        hot = F.col("n") * HOT > total
        few = materialize(build_shards(found.where(hot), 1), "hot")
        rest = build_shards(found.where(~hot), n_shards)
        lost = routed(key_rows(documents, id_col, text_col, min_chars), rest, n_shards, min_documents)
        lost = lost.groupBy(F.col("id").alias(i)).agg(F.collect_set(F.struct("a", "b")).alias(gone))
        places = F.array_union(sent_probe(few, 1, min_documents)(column(i), column(ha), column(hb)), listed_places(column(ha), column(hb), column(gone)))
        out = plain.join(lost, i, "left").withColumn("dropped_lines", F.array_sort(places))
    kept = let(lines(text), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("dropped_lines")), lambda k: F.get(x, k)), "\n"))
    out = out.withColumns({"n_lines": F.size(lines(text)).cast("bigint"), "n_dropped": F.size("dropped_lines").cast("bigint"), "kept_text": kept})
    return out.select(*[column(c) for c in plain.columns if c not in (ha, hb, i)], *ADDED)
