"""Spectral bands."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Band -> wavelength in nm, in instrument order.
WAVELENGTHS = {
    "B01": 443.0, "B02": 490.0, "B03": 560.0, "B04": 665.0, "B05": 705.0, "B06": 740.0, "B07": 783.0,
    "B08": 842.0, "B8A": 865.0, "B09": 945.0, "B10": 1375.0, "B11": 1610.0, "B12": 2190.0,
}


def band_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, b, w) for n, (b, w) in enumerate(WAVELENGTHS.items())], "band_order int, band_id string, wl_nm double")


def short_id(band: str) -> str:
    return re.sub(r"^B0+", "B", band)


def nearest(wl: Column) -> Column:
    """Struct of the band nearest to a wavelength, the first in instrument order on ties."""
    rows = [F.struct(F.abs(wl - w).alias("d"), F.lit(n).alias("n"), F.lit(b).alias("band_id"), F.lit(w).alias("wl_nm")) for n, (b, w) in enumerate(WAVELENGTHS.items())]
    return F.array_min(F.array(*rows))
