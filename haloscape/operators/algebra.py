"""Named-dimension algebra on long tables: joins on shared dimensions, selections, deduplicated computation, sweeps."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is sent to all executors only if it has no more rows.
SMALL_ROWS = 100_000


class MissingVariableError(KeyError):
    """A required variable is not in the table."""


def require(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    if missing := [v for v in variables if v not in df.columns]:
        raise MissingVariableError(", ".join(missing))
    return df


def natural_join(left: DataFrame, right: DataFrame, dims: Sequence[str], how: str = "inner") -> DataFrame:
    """Joins on the dimensions that both have, and crosses the others."""
    shared = [d for d in dims if d in left.columns and d in right.columns]
    if clash := (set(left.columns) & set(right.columns)) - set(dims):
        raise ValueError(f"both sides have {sorted(clash)}")
    return left.join(right, shared, how) if shared else left.crossJoin(right)


def select_label(df: DataFrame, **labels) -> DataFrame:
    """Exact labels, on those dimensions that the table has."""
    held = [F.col(k) == F.lit(v) for k, v in labels.items() if k in df.columns]
    return df.where(reduce(lambda a, b: a & b, held)) if held else df


def select_slice(df: DataFrame, **slices: tuple[int, int]) -> DataFrame:
    """Positions from a to before b."""
    for dim, (a, b) in slices.items():
        df = df.where((F.col(dim) >= a) & (F.col(dim) < b))
    return df


def select_nearest(df: DataFrame, keys: Sequence[str], dim: str, label: float) -> DataFrame:
    """For each key the row with the nearest label, the smaller on ties."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(F.abs(F.col(dim) - label), F.col(dim))).alias("r")).select(*keys, "r.*")


def reindex(full: DataFrame, sampled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key of ``full``; null where nothing was sampled."""
    return full.select(*keys).join(sampled, list(keys), "left")


def window_mask(iy: Column, ix: Column, top: int, left: int, ny: int, nx: int) -> Column:
    return iy.between(top, top + ny - 1) & ix.between(left, left + nx - 1)


#: Rows that are sampled for the bounds of ranges, and the ranges' number.
SPLITTERS, RANGES = 20_000, 200


def ranged(df: DataFrame, dims: Sequence[str], name: str, ranges: int = RANGES, sampled: int = SPLITTERS) -> DataFrame:
    """Adds the number of the range of ``dims`` (taken together, nulls first) that a row falls into.  Bounds are quantiles of about ``sampled`` rows, which only decide how even the ranges
    are.  They are read once (``ranges`` rows at most go back) and stand in the plan, so a task run again deals its rows as before."""
    order = F.struct(*[F.struct(F.col(d).isNotNull().alias("known"), F.col(d).alias("label")).alias(f"d{i}") for i, d in enumerate(dims)])
    total = df.count()
    some = df.sample(min(1.0, sampled / max(1, total)), seed=7).select(order.alias("o")).orderBy("o").collect()
    step = max(1, -(-len(some) // ranges))
    kind = T.StructType([T.StructField("bounds", T.ArrayType(df.select(order.alias("o")).schema["o"].dataType))])
    bounds = df.sparkSession.createDataFrame([([r["o"] for r in some[step::step]],)], kind)
    placed, size = df.crossJoin(F.broadcast(bounds)).withColumn("_order", order).withColumn(name, F.lit(0)), len(some[step::step])
    # halving in compiled steps: a function over arrays is interpreted for each row
    for by in (1 << i for i in reversed(range(size.bit_length()))):
        up = F.col(name) + by
        placed = placed.withColumn(name, F.when((up <= size) & (F.get("bounds", up - 1) <= F.col("_order")), up).otherwise(F.col(name)))
    return placed.drop("bounds", "_order")


def numbered(df: DataFrame, dims: Sequence[str], name: str, ranges: int = RANGES) -> DataFrame:
    """Adds each row's number, from 0, in the order of ``dims`` (nulls first), which must tell rows apart.  Rows are numbered within ranges, after the rows of the ranges before: no task
    holds more than one range, for one dimension as for several."""
    held = ranged(df, dims, "_range", ranges)
    counts = held.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    # a row a range
    before = counts.agg(F.sort_array(F.collect_list(F.struct("_range", "n"))).alias("c")).select(F.explode(F.transform("c", lambda x, i: F.struct(x["_range"].alias("_range"), F.aggregate(F.slice("c", 1, i), F.lit(0).cast("bigint"), lambda a, y: a + y["n"]).alias("_before")))).alias("b")).select("b.*")
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*[F.asc_nulls_first(d) for d in dims])) - 1
    ranked = held.withColumn("_rank", rank)
    return ranked.join(F.broadcast(before), "_range").select(*df.columns, (F.col("_before") + F.col("_rank")).cast("bigint").alias(name))


def distinct_states(df: DataFrame, params: Sequence[str]) -> DataFrame:
    """The distinct parameter rows, numbered in their order, nulls first."""
    return numbered(df.select(*params).distinct(), params, "state")


def dedup_apply(df: DataFrame, params: Sequence[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Computes once for each distinct parameter row and joins the result back."""
    states = compute(df.select(*params).distinct())
    match = reduce(lambda a, b: a & b, [F.col(f"a.{p}").eqNullSafe(F.col(f"b.{p}")) for p in params])
    added = [c for c in states.columns if c not in params]
    return df.alias("a").join(states.alias("b"), match, "left").select("a.*", *[F.col(f"b.{c}") for c in added])


def product(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.crossJoin(b), tables)


def sweep(params: DataFrame, function: Callable[..., Column], name: str) -> DataFrame:
    """Applies a Column function to the columns that its arguments name; the others aren't read."""
    return params.withColumn(name, function(**{a: F.col(a) for a in inspect.signature(function).parameters}))


def concat(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def chunked(params: DataFrame, dim: str, size: int) -> DataFrame:
    """The number of the chunk of ``size`` consecutive values of ``dim`` that a row falls into; rows without a value are left out."""
    labels = numbered(params.select(dim).where(F.col(dim).isNotNull()).distinct(), [dim], "number")
    return params.join(labels.select(dim, F.floor(F.col("number") / size).cast("int").alias("chunk")), dim)


def block_reduce(df: DataFrame, keys: Sequence[str], value: str, factor: int, reducer: Callable[[Column], Column] = F.avg) -> DataFrame:
    """Blocks of factor x factor; what is left at the end is cut off; NaN doesn't count."""
    size = df.groupBy(*keys).agg((F.max("iy") + 1).alias("ny"), (F.max("ix") + 1).alias("nx"))
    inside = df.join(size, list(keys)).where((F.col("iy") < F.col("ny") - F.col("ny") % factor) & (F.col("ix") < F.col("nx") - F.col("nx") % factor))
    return inside.groupBy(*keys, F.floor(F.col("iy") / factor).cast("int").alias("by"), F.floor(F.col("ix") / factor).cast("int").alias("bx")).agg(reducer(F.when(~F.isnan(value), F.col(value))).alias(value))


def downsample_factor(target_res_km: float, data_res_km: float) -> int:
    target, data = round(target_res_km * 1000), round(data_res_km * 1000)
    if target % data:
        raise ValueError(f"{target} m is no multiple of {data} m")
    return target // data


def missing(given: Sequence[str], wanted: Sequence[str]) -> list[str]:
    """The wanted names that aren't given, in order."""
    return sorted(set(wanted) - set(given))


def in_order(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Sorted by its labels, as results are shown."""
    return df.orderBy(*[d for d in dims if d in df.columns])


def batches(df: DataFrame, dim: str, n_batch: int) -> list[DataFrame]:
    """Parts of a table along ``dim`` with ``n_batch`` labels each; without the dimension the whole table."""
    if dim not in df.columns:
        return [df]
    numbered = chunked(df, dim, n_batch)
    last = numbered.agg(F.max("chunk")).first()[0]
    return [numbered.where(F.col("chunk") == i).drop("chunk") for i in range((last if last is not None else -1) + 1)]


def best_step(history: DataFrame, keys: Sequence[str], loss: str, params: Sequence[str]) -> DataFrame:
    """The parameters of the smallest loss."""
    return history.groupBy(*keys).agg(F.min(F.struct(loss, *params)).alias("b")).select(*keys, "b.*")
