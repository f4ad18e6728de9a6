"""Writing scenes and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def export_name(var: str, dims: Sequence[str], band: Column) -> Column:
    """``var__dim=value__S2Band.B02.npy``."""
    parts = [F.lit(var), *[F.concat(F.lit(f"{d}="), F.col(d).cast("string")) for d in dims], F.concat(F.lit("S2Band."), band, F.lit(".npy"))]
    return F.concat_ws("__", *parts)


def write_scene(df: DataFrame, path: str, dims: Sequence[str]) -> None:
    df.write.mode("overwrite").partitionBy("band", *dims).parquet(path)


def write_table(df: DataFrame, path: str, skip_existing: bool = True) -> None:
    """A lookup table; one that stands is left alone."""
    df.write.mode("ignore" if skip_existing else "overwrite").parquet(path)


def write_arrays(df: DataFrame, directory: str, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """One .npy file for each key, named by the column ``name``, all of them or none; gives the paths."""
    from .npy import write_rasters

    write_rasters(df, directory, F.col(name), value)
    return df.select(*keys, name).distinct().select(F.concat(F.lit(directory.rstrip("/") + "/"), name).alias("path"))
