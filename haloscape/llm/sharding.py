"""Sharding: range partitioning by sampled splitters, with sizes near equal.

Each record has a sort key, the hex of a 64-bit hash of its text followed by one of its id and its place in the table, so equal texts lie
side by side and no two records have the same key.
Splitters are the quantiles of a size-weighted sample of the keys: a record is drawn with a probability in proportion to its
size.  First the splitters cut between texts only (on the text's hash).  The ranges' exact sizes are then counted; those
over ``OVERFULL`` times the mean, their largest record apart, are subdivided by splitters drawn from within them on the whole key, from samples, round by
round until none is left, so a group of copies of any number, equal ids included, is spread over as many ranges as its size asks for.  The
ranges, far more than there are shards, go to the shards largest first, each to the emptiest; shard sizes then differ by no more than a
small range.

Ranges number ``RANGES_PER_SHARD`` a shard, and more where one would hold over ``RANGE_ROWS`` rows, up to ``MAX_RANGES``; the driver holds a few
numbers for each, and ``MAX_SAMPLE`` sampled keys.  Beyond ``MAX_RANGES * RANGE_ROWS`` rows ranges grow, which costs sorting on disk and nothing else.
Texts are read once; what is sorted is the table without them unless ``keep_text``.

Law ``bytes``: sizes near equal.  Defined results: a null text has size 8 and CRC 0; repeated rows take different slots and are spread like any
other copies; an empty table gives an empty table.  Added columns replace input columns of the same name.
"""

from __future__ import annotations

import heapq
import itertools
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, literal_array, materialize, others

ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
RANGES_PER_SHARD = 64
RANGE_ROWS = 1 << 20
MAX_RANGES = 1 << 16
SAMPLES_PER_RANGE = 32
MAX_SAMPLE = 1 << 18
OVERFULL = 2.0


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint")


def hex16(value: Column) -> Column:
    return F.lpad(F.hex(value), 16, "0")


def sort_key(text: Column, ident: Column) -> Column:
    return F.concat(hex16(F.xxhash64(text)), hex16(F.xxhash64(F.lit(7), ident, F.monotonically_increasing_id())))


def range_of(key: Column, splitters: list[str]) -> Column:
    """The number of splitters <= key, by binary search in a literal array."""
    if not splitters:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(splitters).bit_length()))]
    held = literal_array(splitters, "string")

    def step(at: Column, by: Column) -> Column:
        return F.when((at + by <= len(splitters)) & (F.get(held, at + by - 1) <= key), at + by).otherwise(at)

    return F.aggregate(literal_array(steps, "int"), F.lit(0), step)


def draw(keyed: DataFrame, key: Column, per_byte: float, seed: int) -> list[str]:
    """A record is drawn if a hash of its whole key, seen as a fraction, is below its share: the draw repeats itself when a task
    is run again."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("key")), F.lit(1 << 30).cast("bigint")) / F.lit(float(1 << 30))
    return [r["at"] for r in keyed.where(u < F.col("size") * F.lit(per_byte)).select(key.alias("at")).collect()]


def quantiles(sample: list[str], ranges: int) -> list[str]:
    ordered = sorted(sample)
    return sorted({ordered[len(ordered) * i // ranges] for i in range(1, ranges)}) if ordered else []


def measured(keyed: DataFrame, splitters: list[str]) -> dict[int, tuple[int, int, int]]:
    """Range -> its bytes, its rows, its largest record."""
    rows = keyed.groupBy(range_of(F.col("key"), splitters).alias("r")).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"), F.max("size").alias("m")).collect()
    return {r["r"]: (r["b"], r["n"], r["m"]) for r in rows}


def find_splitters(keyed: DataFrame, total: int, ranges: int) -> tuple[list[str], dict[int, tuple[int, int, int]]]:
    """Sorted splitters and, by range, its bytes and rows."""
    per_byte = ranges * min(SAMPLES_PER_RANGE, max(4, MAX_SAMPLE // ranges)) / max(1, total)
    splitters = quantiles(draw(keyed, F.substring("key", 1, 16), per_byte, 1), ranges)
    sizes = measured(keyed, splitters)
    target = max(1.0, total / ranges)
    for n in itertools.count():
        over = {r: b for r, (b, rows, most) in sizes.items() if b - most > OVERFULL * target and rows > 1}
        if not over:
            return splitters, sizes
        inside = keyed.where(range_of(F.col("key"), splitters).isin(sorted(over)))
        drawn: dict[int, list[str]] = {r: [] for r in over}
        order = sorted(over)
        edges = [splitters[r - 1] if r else "" for r in order]
        # an overfull range has some 2 * SAMPLES_PER_RANGE draws at once; the share grows only for the odd one that has none
        for k in draw(inside, F.col("key"), per_byte * 2**n, 2 + n):
            drawn[order[max(0, bisect_right(edges, k) - 1)]].append(k)
        more = set(itertools.chain.from_iterable(quantiles(s, min(len(s), round(over[r] / target) + 1)) for r, s in drawn.items())) - set(splitters)
        if more:
            splitters = sorted({*splitters, *more})
            sizes = measured(keyed, splitters)


def pack(sizes: dict[int, tuple[int, int, int]], shards: int) -> dict[int, tuple[int, int]]:
    """Range -> shard and the first slot there."""
    heap = [(0, s) for s in range(shards)]
    slots, out = [0] * shards, {}
    for r, (b, n, _) in sorted(sizes.items(), key=lambda x: (-x[1][0], x[0])):
        load, s = heapq.heappop(heap)
        out[r] = (s, slots[s])
        slots[s] += n
        heapq.heappush(heap, (load + b, s))
    return out


def shard(documents: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``documents`` with size, text_crc32, law, shard, slot and grown_shard (null under this law); without the text unless ``keep_text``."""
    ident, text = column(id_col), column(text_col)
    gone = ADDED if keep_text else (*ADDED, text_col)
    plain = others(documents, gone)
    # places make keys unique; they hold once the table is written
    kept = documents.select(
        F.struct(*plain).alias("row") if plain else F.lit(True).alias("row"), sort_key(text, ident).alias("key"), record_size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
    )
    kept = materialize(kept, "shard-rows")
    keyed = kept.select("key", "size")
    total, rows = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    ranges = min(MAX_RANGES, max(shards * RANGES_PER_SHARD, -(-rows // RANGE_ROWS)))
    splitters, sizes = find_splitters(keyed, total, ranges)
    packed = pack(sizes, shards)
    places = [packed.get(r, (0, 0)) for r in range(len(splitters) + 1)]
    shard_of, first_slot = literal_array([s for s, _ in places], "int"), literal_array([n for _, n in places], "bigint")
    placed = kept.withColumn("range", range_of(F.col("key"), splitters))
    placed = placed.withColumn("rank", F.row_number().over(Window.partitionBy("range").orderBy("key")))
    return placed.select(
        *([F.col("row.*")] if plain else []), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.get(shard_of, F.col("range")).alias("shard"),
        (F.get(first_slot, F.col("range")) + F.col("rank") - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
