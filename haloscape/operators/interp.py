"""Interpolation as range joins: linear, adaptive radii, monotone cubic, bilinear transects."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .algebra import SMALL_ROWS


def intervals(prof: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """(keys, seg, n_seg, x0, x1, y0, y1): the segments between neighbouring points."""
    order, whole = Window.partitionBy(*keys).orderBy(x), Window.partitionBy(*keys)
    rows = prof.select(*keys, (F.row_number().over(order) - 1).alias("seg"), (F.count(F.lit(1)).over(whole) - 1).alias("n_seg"), F.col(x).alias("x0"), F.lead(x).over(order).alias("x1"), F.col(y).alias("y0"), F.lead(y).over(order).alias("y1"))
    return rows.where(F.col("x1").isNotNull())


def with_segment(queries: DataFrame, segments: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Each query with the segment that holds it, as ``s``; what lies outside goes to the ends'.  A key's segments are one sorted array, in which
    a query looks its own up, so no query meets the others."""
    fields = [c for c in segments.columns if c not in keys]
    held = segments.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("x0", *[c for c in fields if c != "x0"]))).alias("segs"))
    held = held.withColumn("knots", F.transform(F.slice("segs", 2, F.greatest(F.lit(1), F.size("segs") - 1)), lambda s: s["x0"]))
    joined = queries.join(held, list(keys))
    return joined.withColumn("s", F.get("segs", knots_below(F.col("knots"), F.col(at)))).drop("segs", "knots")


def knots_below(knots: Column, value: Column) -> Column:
    """How many of a sorted array's values are ``value`` or less, by halving; as many steps as the array's length has bits."""
    size = F.size(knots)
    steps = F.transform(F.sequence(F.ceil(F.log2(size + 1)).cast("int"), F.lit(0), F.lit(-1)), lambda i: F.call_function("shiftleft", F.lit(1), i))

    def step(n: Column, by: Column) -> Column:
        return F.when((n + by <= size) & (F.get(knots, n + by - 1) <= value), n + by).otherwise(n)

    return F.aggregate(steps, F.lit(0), step)


def linear(prof: DataFrame, queries: DataFrame, keys: Sequence[str], x: str, y: str, at: str, out: str) -> DataFrame:
    """Piecewise linear, clamped at the ends.  A key's profile is one array, so it has few rows next to the queries."""
    found = with_segment(queries, intervals(prof, keys, x, y).select(*keys, "x0", "x1", "y0", "y1"), keys, at)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(at) - F.col("s.x0")) / (F.col("s.x1") - F.col("s.x0"))))
    return found.withColumn(out, F.col("s.y0") + (F.col("s.y1") - F.col("s.y0")) * share).drop("s")


def gradient(r: str, v: str, order: Window) -> Column:
    """Second order inside, first order at the ends, for uneven steps."""
    d1, d2 = F.col(r) - F.lag(r).over(order), F.lead(r).over(order) - F.col(r)
    before, here, after = F.lag(v).over(order), F.col(v), F.lead(v).over(order)
    inner = -d2 / (d1 * (d1 + d2)) * before + (d2 - d1) / (d1 * d2) * here + d1 / (d2 * (d1 + d2)) * after
    return F.coalesce(inner, (after - here) / d2, (here - before) / d1)


def adaptive_radii(prof: DataFrame, keys: Sequence[str], r: str, v: str, n: int) -> DataFrame:
    """(keys, j, radius): n radii, dense where the profile is steep; evenly spaced where it is flat."""
    order, whole = Window.partitionBy(*keys).orderBy(r), Window.partitionBy(*keys)
    dense = prof.withColumn("d", F.abs(gradient(r, v, order)))
    step = F.coalesce((F.lag("d").over(order) + F.col("d")) / 2 * (F.col(r) - F.lag(r).over(order)), F.lit(0.0))
    run = dense.withColumn("s", step).withColumn("c", F.sum("s").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("total", F.sum("s").over(whole))
    flat = (F.col(r) - F.min(r).over(whole)) / (F.max(r).over(whole) - F.min(r).over(whole))
    share = run.withColumn("c", F.when(F.col("total") > 0, F.col("c") / F.col("total")).otherwise(flat)).select(*keys, "c", r)
    # of equal shares the last radius counts
    single = share.groupBy(*keys, "c").agg(F.max(r).alias(r))
    queries = prof.select(*keys).distinct().withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("q", F.col("j") / (n - 1))
    return linear(single, queries.withColumnRenamed("q", "share"), keys, "c", r, "share", "radius").select(*keys, "j", "radius")


def fill_gaps(radii: DataFrame, keys: Sequence[str], r: str, max_gap: float) -> DataFrame:
    """(keys, r): with equidistant points in gaps over ``max_gap``."""
    after = F.lead(r).over(Window.partitionBy(*keys).orderBy(r))
    gap = radii.withColumn("gap", after - F.col(r))
    parts = F.when(F.col("gap") > max_gap, F.ceil(F.col("gap") / max_gap)).otherwise(1).cast("int")
    return gap.withColumn("parts", parts).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*keys, (F.col(r) + F.coalesce(F.col("gap"), F.lit(0.0)) * F.col("k") / F.col("parts")).alias(r))


def end_slope(h0: Column, h1: Column, d0: Column, d1: Column) -> Column:
    m = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
    return F.when(F.signum(m) != F.signum(d0), 0.0).when((F.signum(d0) != F.signum(d1)) & (F.abs(m) > 3 * F.abs(d0)), 3 * d0).otherwise(m)


def pchip_segments(prof: DataFrame, keys: Sequence[str], r: str, v: str) -> DataFrame:
    """Segments with the monotone cubic's slopes m0 and m1 at their ends.  Helper columns end with ``_``, so that keys may be called anything else."""
    order = Window.partitionBy(*keys).orderBy("x0")
    seg = intervals(prof.groupBy(*keys, r).agg(F.first(v).alias(v)), keys, r, v)
    seg = seg.withColumns({"h_": F.col("x1") - F.col("x0")}).withColumn("d_", (F.col("y1") - F.col("y0")) / F.col("h_"))
    seg = seg.withColumns({f"{c}{s}_": f(f"{c}_", k).over(order) for c in ("h", "d") for s, f, k in (("b", F.lag, 1), ("a", F.lead, 1))})

    def inner(hb: Column, h: Column, db: Column, d: Column) -> Column:
        w1, w2 = 2 * h + hb, h + 2 * hb
        return F.when(db * d <= 0, 0.0).otherwise((w1 + w2) / (w1 / db + w2 / d))

    h, d, hb, db, ha, da = (F.col(c) for c in ("h_", "d_", "hb_", "db_", "ha_", "da_"))
    m0 = F.when(hb.isNotNull(), inner(hb, h, db, d)).when(ha.isNotNull(), end_slope(h, ha, d, da)).otherwise(d)
    m1 = F.when(ha.isNotNull(), inner(h, ha, d, da)).when(hb.isNotNull(), end_slope(h, hb, d, db)).otherwise(d)
    return seg.select(*keys, "seg", "n_seg", "x0", "x1", "y0", "y1", "h_", m0.alias("m0"), m1.alias("m1"))


def hermite(q: Column, s: Column) -> Column:
    t = (q - s["x0"]) / s["h_"]
    t2, t3 = t * t, t * t * t
    return (2 * t3 - 3 * t2 + 1) * s["y0"] + (t3 - 2 * t2 + t) * s["h_"] * s["m0"] + (3 * t2 - 2 * t3) * s["y1"] + (t3 - t2) * s["h_"] * s["m1"]


def pchip(prof: DataFrame, queries: DataFrame, keys: Sequence[str], r: str, v: str, at: str, out: str) -> DataFrame:
    """Monotone cubic values; the end pieces go on beyond the ends."""
    found = with_segment(queries, pchip_segments(prof, keys, r, v).drop("seg", "n_seg"), keys, at)
    return found.withColumn(out, hermite(F.col(at), F.col("s"))).drop("s")


def to_field(prof: DataFrame, pixels: DataFrame, keys: Sequence[str], r: str, v: str, out: str) -> DataFrame:
    """A profile spread over a field about the origin of its coordinates, wherever the field lies, as float32 values.  Of equal radii the first counts."""
    placed = pixels.withColumn("at_r", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")))
    found = pchip(prof, placed, keys, r, v, "at_r", out).drop("at_r")
    return found.withColumn(out, F.col(out).cast("float").cast("double"))


def transect(df: DataFrame, keys: Sequence[str], value: str, angle_deg: float, n: int | None = None) -> DataFrame:
    """(keys, j, s, value): bilinear samples on a line through the centre; null where a corner is missing.  Without ``n`` a sample a pixel, three at least."""
    ends = df.groupBy(*keys).agg(*[f(d).alias(f"{n_}_{d}") for d in ("x", "y") for n_, f in (("c", F.avg), ("lo", F.min), ("hi", F.max))], F.max("ix").alias("mx"), F.max("iy").alias("my"))
    r_max = F.least(*[e for d in ("x", "y") for e in (F.col(f"hi_{d}") - F.col(f"c_{d}"), F.col(f"c_{d}") - F.col(f"lo_{d}"))])
    a = math.radians(angle_deg)
    res = (F.col("hi_x") - F.col("lo_x")) / F.col("mx")
    many = F.lit(n) if n else F.greatest(F.lit(3), (F.bround(2 * F.col("r_max") / res) + 1).cast("int"))
    line = ends.withColumn("r_max", r_max).withColumn("many", many).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("many") - 1))).withColumn("s", -F.col("r_max") + 2 * F.col("r_max") * F.col("j") / (F.col("many") - 1))
    place = lambda d, t, m: ((F.col(f"c_{d}") + F.col("s") * t) - F.col(f"lo_{d}")) / ((F.col(f"hi_{d}") - F.col(f"lo_{d}")) / F.col(m))
    line = line.withColumn("px", place("x", math.cos(a), "mx")).withColumn("py", place("y", math.sin(a), "my"))
    cell = lambda p, m: F.greatest(F.lit(0), F.least(F.col(m) - 1, F.floor(F.col(p)).cast("int")))
    line = line.withColumn("kx", cell("px", "mx")).withColumn("ky", cell("py", "my")).withColumn("fx", F.col("px") - F.col("kx")).withColumn("fy", F.col("py") - F.col("ky"))
    corners = F.array(*[F.struct((F.col("ky") + i).alias("iy"), (F.col("kx") + k).alias("ix"), ((F.col("fy") if i else 1 - F.col("fy")) * (F.col("fx") if k else 1 - F.col("fx"))).alias("w")) for i in (0, 1) for k in (0, 1)])
    wanted = line.select(*keys, "j", "s", F.explode(corners).alias("c")).select(*keys, "j", "s", "c.*")
    return wanted.join(df.select(*keys, "iy", "ix", value), [*keys, "iy", "ix"], "left").groupBy(*keys, "j", "s").agg(F.when(F.count(value) == 4, F.sum(F.col(value) * F.col("w"))).alias(value))


def multilinear(queries: DataFrame, lut: DataFrame, dims: Sequence[str], outputs: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``queries`` with ``outputs``: linear in each of ``dims`` (d of them) at once, clamped at the ends, for each of ``keys``.

    ``lut`` has a row for each combination of its labels; they may lie unevenly and a cell with a missing corner gives null, as do null labels.  A row of ``lut`` goes
    to the 2^d cells that it bounds, so that a cell is one row with all of its corners; a query finds its cell's number in each dimension in that dimension's
    sorted labels, meets that one row, and weighs the corners in one expression.  Only the table grows by 2^d, not the queries; they aren't shuffled where the cells are few (counted)."""
    axes = lut.groupBy(*keys).agg(*[F.array_sort(F.collect_set(F.col(d).cast("double"))).alias(f"_axis{i}") for i, d in enumerate(dims)])
    few_axes = axes.count() <= SMALL_ROWS
    axes = F.broadcast(axes) if few_axes else axes
    on = list(keys)
    with_axes = lambda df: df.join(axes, on) if on else df.crossJoin(axes)
    # a label's own number, and of cells: from 0 to the labels' number less 2
    placed = with_axes(lut.where(reduce(lambda a, b: a & b, [F.col(d).isNotNull() for d in dims])))
    corner = F.explode(F.sequence(F.lit(0), F.lit(2 ** len(dims) - 1)))
    bit = lambda i: (F.shiftright(F.col("_corner"), i) % 2).cast("int")
    cells = placed.withColumn("_corner", corner)
    for i, d in enumerate(dims):
        own = knots_below(F.col(f"_axis{i}"), F.col(d).cast("double")) - 1
        cells = cells.withColumn(f"_at{i}", own - bit(i)).where(F.col(f"_at{i}").between(0, F.greatest(F.lit(0), F.size(f"_axis{i}") - 2)))
    numbers = [f"_at{i}" for i in range(len(dims))]
    value = F.struct(F.col("_corner").alias("c"), *[F.col(o).cast("double").alias(o) for o in outputs])
    cells = cells.groupBy(*keys, *numbers).agg(F.map_from_entries(F.collect_list(F.struct(F.col("_corner"), value))).alias("_corners"))
    asked = with_axes(queries)
    for i, d in enumerate(dims):
        axis, at = F.col(f"_axis{i}"), F.col(d).cast("double")
        cell = F.greatest(F.lit(0), F.least(F.size(axis) - 2, knots_below(axis, at) - 1))
        asked = asked.withColumn(f"_at{i}", F.when(at.isNotNull(), cell))
        low, high = F.get(axis, F.col(f"_at{i}")), F.get(axis, F.col(f"_at{i}") + 1)
        share = F.when(high.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (at - low) / (high - low))))
        asked = asked.withColumn(f"_share{i}", F.when(at.isNotNull(), share))
    met = asked.join(F.broadcast(cells) if cells.count() <= SMALL_ROWS else cells, [*keys, *numbers], "left")

    def total(name: str) -> Column:
        """A corner without weight may be missing."""
        terms = []
        for c in range(2 ** len(dims)):
            weight = reduce(lambda a, b: a * b, [F.col(f"_share{i}") if c >> i & 1 else 1 - F.col(f"_share{i}") for i in range(len(dims))])
            terms.append(F.when(weight == 0, F.lit(0.0)).otherwise(weight * F.try_element_at("_corners", F.lit(c))[name]))
        return reduce(lambda a, b: a + b, terms)

    return met.select(*queries.columns, *[total(o).alias(o) for o in outputs])
