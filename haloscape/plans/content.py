"""Keys of tables by what they hold, and marks of what made their columns.

A row's text joins its columns in the order of their names, each value as text with its length before it, a null as ``-``; so no two rows have the same text.  Its MD5
gives two numbers of 60 bits, and a table's key holds its columns' names and types, its count and the sums of both.  Sums don't depend on the order or the
partitioning of rows, count repeated rows, and are made in each task before one small shuffle; every engine that has MD5 can recompute them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "made_by"


def nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ArrayType, T.StructType, T.MapType))


def in_map_order(value: Column, kind: T.DataType) -> Column:
    """Maps as sorted entries, as their order means nothing; structs keep null fields apart from absent ones."""
    if isinstance(kind, T.MapType):
        return F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), in_map_order(e["value"], kind.valueType).alias("value"))))
    if isinstance(kind, T.ArrayType) and nested(kind.elementType):
        return F.transform(value, lambda x: in_map_order(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[in_map_order(value[f.name], f.dataType).alias(f.name) for f in kind]))
    return value


def value_text(df: DataFrame, name: str) -> Column:
    """The value with its length before it; ``-`` for null."""
    kind, value = df.schema[name].dataType, F.col("`" + name.replace("`", "``") + "`")
    if isinstance(kind, T.BinaryType):
        text = F.hex(value)
    elif nested(kind):
        text = F.to_json(F.struct(in_map_order(value, kind).alias("v")), {"ignoreNullFields": "false"})
        text = F.when(value.isNotNull(), text)
    else:
        text = value.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def halves(text: Column) -> list[Column]:
    """Two numbers of 60 bits of a text's MD5."""
    digest = F.md5(text.cast("binary"))
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 16)]


def content_sums(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """(by, n, high, low): count and sums of the rows' numbers over ``columns`` (all unless given), for each of ``by``.  An empty table has one row without ``by``, with nulls as sums."""
    names = sorted(columns if columns is not None else df.columns)
    high, low = halves(F.concat(*[value_text(df, c) for c in names]) if names else F.lit(""))
    return df.select(*by, high.alias("high"), low.alias("low")).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"))


def column_sums(df: DataFrame) -> DataFrame:
    """(column, high, low): the sums of each column by itself, all in one pass."""
    parts = {c: halves(value_text(df, c)) for c in df.columns}
    sums = df.select(*[F.struct(*[h.alias(f"h{k}") for k, h in enumerate(v)]).alias(f"c{i}") for i, v in enumerate(parts.values())])
    one = sums.agg(*[F.struct(F.lit(c).alias("column"), F.sum(f"c{i}.h0").alias("high"), F.sum(f"c{i}.h1").alias("low")).alias(f"c{i}") for i, c in enumerate(parts)])
    return one.select(F.inline(F.array(*[f"c{i}" for i in range(len(parts))])))


def changed_columns(before: DataFrame, after: DataFrame) -> list[str]:
    """Names of columns whose values, taken as a bag, differ, or that only one of the tables has."""
    sums = [{r["column"]: (r["high"], r["low"]) for r in column_sums(df).collect()} for df in (before, after)]  # a row a column
    return sorted(c for c in {*sums[0], *sums[1]} if sums[0].get(c) != sums[1].get(c))


def content_key(df: DataFrame, columns: Sequence[str] | None = None) -> str:
    """The same for equal tables, in whatever order and partitions; another one for a changed value, name or type, or a row more or less."""
    names = sorted(columns if columns is not None else df.columns)
    total = content_sums(df, (), names).first()
    said = [[c, df.schema[c].dataType.simpleString()] for c in names] + [[str(x) for x in total]]
    return hashlib.sha256(json.dumps(said).encode()).hexdigest()


def marked(df: DataFrame, variables: Sequence[str], module: str, key: str) -> DataFrame:
    """Columns with the module and the key that they were made under in their metadata, which Parquet files keep."""
    known = [c for c in df.columns if c in set(variables)]
    return df.withColumns({c: F.col(c).alias(c, metadata={**df.schema[c].metadata, MARK: {"module": module, "key": key}}) for c in known}) if known else df


def marks(df: DataFrame) -> Mapping[str, tuple[str, str]]:
    """Column -> module and key, of the columns that have a mark."""
    return {f.name: (f.metadata[MARK]["module"], f.metadata[MARK]["key"]) for f in df.schema if MARK in f.metadata}


def input_key(df: DataFrame, columns: Sequence[str]) -> str:
    """A key of a module's input.  If one module under one key made all of its columns, the mark says what they hold and nothing is read; else their content does."""
    known = marks(df)
    if columns and all(c in known for c in columns) and len({known[c] for c in columns}) == 1:
        return known[columns[0]][1]
    return content_key(df, columns)
