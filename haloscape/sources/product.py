"""Product folders: names, XML metadata, rasters, and the loader that makes a scene of them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bands as band_names
from ..operators.algebra import block_reduce, downsample_factor
from ..operators.regrid import regrid
from ..plans.configs import ConfigurationError
from ..scene import Meta, Scene
from .tiff import raster_table

#: The aerosol models of the file format, in its order.
SPECIES = ("ammonium", "blackcar", "dust", "nitrate", "organicm", "seasalt", "sulphate", "secondar")
#: Layer, divisor, and pixel size in km of the format's optical thickness and elevation rasters.
AOT_LAYER, AOT_SCALE, H_SCALE, RASTER_KM = 2, 200.0, 1000.0, 0.02


def folder_parts(name: Column) -> dict[str, Column]:
    """Sensor, acquisition date and tile of a product folder's name; an error unless it has six parts."""
    parts = F.split(name, "_", -1)
    checked = F.when(F.size(parts) == 6, parts).otherwise(F.raise_error(F.concat(F.lit("not a product folder: "), name)))
    return {"sensor": F.get(checked, 0), "date": F.substring(F.get(checked, 1), 1, 7), "tile": F.substring(F.get(checked, 3), 2, 100)}


#: Stands between values; no XML text holds it.
BETWEEN = "\x1f"


#: Values of one expression: Java takes no expression of over 100 operators.
AT_ONCE = 8


def fields(xml: Column, asked: Sequence[str]) -> Column:
    """The values of XPath expressions as an array of strings.  A document is parsed once for ``AT_ONCE`` of them."""
    form = f", '{BETWEEN}', "
    whole = [F.lit("concat(" + form.join([*asked[i : i + AT_ONCE], "''"]) + ")") for i in range(0, len(asked), AT_ONCE)]
    return F.flatten(F.array(*[F.slice(F.split(F.xpath_string(xml, w), BETWEEN, -1), 1, len(asked[i * AT_ONCE : (i + 1) * AT_ONCE])) for i, w in enumerate(whole)]))


def asked(band: str) -> list[str]:
    """What ``metadata`` needs of a document: what is there, and its numbers."""
    view = f"//Mean_Viewing_Incidence_Angle[@band_id='{band}']"
    models = [f"//Model[@name='{s}']" for s in SPECIES]
    return [
        "number(//Product_Quality/Relative_Humidity)", "boolean(//Sun_Angles/ZENITH_ANGLE and //Sun_Angles/AZIMUTH_ANGLE)", "number(//Sun_Angles/ZENITH_ANGLE)", "number(//Sun_Angles/AZIMUTH_ANGLE)",
        f"boolean({view})", f"number({view}/ZENITH_ANGLE)", f"number({view}/AZIMUTH_ANGLE)", *(f"boolean({m})" for m in models), *(f"number({m})" for m in models),
    ]


def metadata(found: Column, band: str) -> dict[str, Column]:
    """Humidity (rh), angles (sza, saa, vza, vaa) and species of what ``fields`` gives for ``asked(band)``; take them from a column of its own, so that it is computed once a row.
    Humidity is 50 where it is missing; angles that are missing are an error, except that an empty element of the view counts as 0; species are scaled to one unless they already sum to it within a hundredth."""
    number = lambda i: F.get(found, i).cast("double")
    there = lambda i: F.get(found, i) == "true"
    or_else = lambda i, value: F.coalesce(F.nanvl(number(i), F.lit(value)), F.lit(value))
    given = lambda i, value, error: F.when(there(i), F.bround(value, 2)).otherwise(F.raise_error(F.lit(error)).cast("double"))
    shares = F.array(*[F.when(there(7 + i), F.struct(F.lit(s).alias("k"), number(7 + len(SPECIES) + i).alias("v"))) for i, s in enumerate(SPECIES)])
    return {
        "rh": or_else(0, 50.0), "sza": given(1, number(2), "no sun angles"), "saa": given(1, number(3), "no sun angles"),
        "vza": given(4, or_else(5, 0.0), f"no angles of {band}"), "vaa": given(4, or_else(6, 0.0), f"no angles of {band}"), "species": normalized(F.map_from_entries(F.array_compact(shares))),
    }


def of_one(xml: Column, band: str, *names: str) -> dict[str, Column]:
    """Some of ``metadata`` of an XML column."""
    found = metadata(fields(xml, asked(band)), band)
    return {n: found[n] for n in names}


def humidity(xml: Column) -> Column:
    return of_one(xml, "", "rh")["rh"]


def sun_angles(xml: Column) -> dict[str, Column]:
    """An error where one is missing."""
    return of_one(xml, "", "sza", "saa")


def view_angles(xml: Column, band: str) -> dict[str, Column]:
    """An empty element counts as 0; a missing one is an error."""
    return of_one(xml, band, "vza", "vaa")


def species(xml: Column) -> Column:
    """Shares of the aerosol models that the metadata has, scaled to one unless they already sum to it within a hundredth."""
    return of_one(xml, "", "species")["species"]


def normalized(shares: Column) -> Column:
    """Shares that sum to nothing stay as they are."""
    total = F.aggregate(F.map_values(shares), F.lit(0.0), lambda a, x: a + x)
    return F.transform_values(shares, lambda _, v: F.when((F.abs(total - 1) > 1e-2) & (total != 0), v / F.when(total != 0, total)).otherwise(v))


def raster(df: DataFrame, value: str, scale: float, res: float, factor: int, as_map: bool = True) -> DataFrame:
    """Scaled block means of a raster table (iy, ix, value), or its one mean; NaN doesn't count."""
    scaled = df.withColumn(value, F.col(value) / scale)
    if not as_map:
        return scaled.agg(F.avg(F.when(~F.isnan(value), F.col(value))).alias(value))
    keyed = scaled.select(F.lit(0).alias("all"), "iy", "ix", value)
    out = block_reduce(keyed, ["all"], value, factor)
    return out.select((F.col("by") * res * factor).alias("y"), (F.col("bx") * res * factor).alias("x"), F.col("by").alias("iy"), F.col("bx").alias("ix"), value)


def resolutions(bands: Sequence[str], res: float | Sequence[float]) -> dict[str, float]:
    """Band -> km; one for all or one for each."""
    given = list(res) if isinstance(res, (list, tuple)) else [res]
    given = given * len(bands) if len(given) == 1 else given
    if len(given) != len(bands):
        raise ConfigurationError(f"{len(given)} resolutions for {len(bands)} bands")
    return dict(zip(bands, given, strict=True))


@dataclass(frozen=True)
class Part:
    """What a loader adds besides reflectances."""

    variables: tuple[str, ...]


GEOMETRY, ATMOSPHERE, ELEVATION = Part(("vza", "vaa", "sza", "saa")), Part(("aot", "rh", "href")), Part(("h",))


class ProductLoader:
    """A product folder as a scene: reflectances of each band at a resolution in km, and the variables of ``parts``, as maps of that grid or as one value each.

    Rasters are TIFF files, Parquet tables (iy, ix, value[, layer]) or .npy arrays; metadata the folder's first XML file.  Files are read by the executors, so
    the folder must be one that they share.
    """

    def __init__(self, spark: SparkSession, folder: str, bands: Sequence[str], res: float | Sequence[float], as_map: bool = False, parts: Sequence[Part] = (), elevation_folder: str | None = None, href: float = 2.0):
        from .tiff import listed

        self.spark, self.folder, self.bands, self.as_map, self.parts = spark, folder.rstrip("/"), list(bands), as_map, tuple(parts)
        self.res = resolutions(bands, res)
        self.elevation_folder, self.href = elevation_folder, href
        name = self.folder.rsplit("/", 1)[-1]
        split = name.split("_")
        if len(split) != 6:
            raise ValueError(f"not a product folder: {name}")
        self.files = listed(self.folder)
        xml = sorted(f for f in self.files if f.lower().endswith(".xml"))
        if not xml:
            raise FileNotFoundError(f"no metadata in {self.folder}")
        self.metadata = {"sensor": split[0], "date": split[1][:7], "tile": split[3][1:], "xml": xml[0]}

    @property
    def outputs(self) -> tuple[str, ...]:
        return ("rho_s", *(v for p in self.parts for v in p.variables))

    def xml(self) -> DataFrame:
        return self.spark.read.text(self.metadata["xml"], wholetext=True).select(F.col("value").alias("xml"))

    def _file(self, files: Sequence[str], *endings: str) -> str:
        found = sorted(f for f in files if any(f.rsplit(".", 1)[0].lower().endswith(e.lower()) for e in endings))
        if not found:
            raise FileNotFoundError(f"no file ends with {' or '.join(endings)}")
        return found[0]

    def reflectance(self, band: str, kind: str = "SRE") -> DataFrame:
        """(band, iy, ix, y, x, rho_s), coordinates in km."""
        table = raster_table(self.spark, self._file(self.files, f"_{kind}_{band_names.short_id(band)}"), 1)
        native = table.where("iy <= 1 and ix <= 1").agg(F.max(F.when((F.col("iy") == 0) & (F.col("ix") == 1), F.col("x"))) - F.max(F.when((F.col("iy") == 0) & (F.col("ix") == 0), F.col("x")))).first()[0]
        factor = round(self.res[band] * 1e6) / round(native * 1000)
        corner = table.where("iy = 0 and ix = 0").select(F.col("x").alias("x0"), F.col("y").alias("y0"))
        keyed = table.select(F.lit(band).alias("band"), "iy", "ix", "value")
        if factor == int(factor):
            out = block_reduce(keyed, ["band"], "value", int(factor)).withColumnsRenamed({"by": "iy", "bx": "ix"})
        else:  # cells that pixels overlap in part, also finer ones
            out = regrid(keyed, ["band"], "value", factor)
        out = out.crossJoin(F.broadcast(corner))  # one row
        half = (factor - 1) / 2
        return out.select("band", "iy", "ix", ((F.col("y0") - (F.col("iy") * factor + half) * native) / 1000).alias("y"), ((F.col("x0") + (F.col("ix") * factor + half) * native) / 1000).alias("x"), F.col("value").alias("rho_s"))

    def _map_or_mean(self, file: str, layer: int, scale: float, name: str, band: str) -> DataFrame:
        table = raster_table(self.spark, file, layer).select("iy", "ix", F.col("value").alias(name))
        factor = downsample_factor(self.res[band], RASTER_KM) if self.as_map else 1
        out = raster(table, name, scale, RASTER_KM, factor, self.as_map)
        return out.select(F.lit(band).alias("band"), *(["iy", "ix"] if self.as_map else []), name)

    def scene(self, scene: Scene | None = None) -> Scene:
        from ..scene import source

        out = source(self.bands, scene)
        tables: dict[str, list[DataFrame]] = {}
        metadata = self.xml()

        def add(name: str, table: DataFrame) -> None:
            tables.setdefault(name, []).append(table)

        for band in self.bands:
            add("rho_s", self.reflectance(band))
            if GEOMETRY in self.parts:
                for angles in (sun_angles(F.col("xml")), view_angles(F.col("xml"), band_names.short_id(band))):
                    for name, value in angles.items():
                        add(name, metadata.select(F.lit(band).alias("band"), value.alias(name)))
            if ATMOSPHERE in self.parts:
                add("aot", self._map_or_mean(self._file(self.files, "ATB_R2"), AOT_LAYER, AOT_SCALE, "aot", band))
                add("rh", metadata.select(F.lit(band).alias("band"), humidity(F.col("xml")).alias("rh")))
                add("href", metadata.select(F.lit(band).alias("band"), F.lit(self.href).alias("href")))
            if ELEVATION in self.parts:
                add("h", self._map_or_mean(self._elevation(), 1, H_SCALE, "h", band))
        for name, parts in tables.items():
            whole = parts[0]
            for p in parts[1:]:
                whole = whole.unionByName(p)
            out = out.enrich(name, whole, self.bands, Meta(kind="arbitrary") if name == "rho_s" else None)
        return out.require(self.outputs)

    def _elevation(self) -> str:
        from .tiff import listed

        tile = self.metadata["tile"]
        folders = [f for f in listed(self.elevation_folder or self.folder, folders=True) if f.rsplit("/", 1)[-1].startswith("S2") and tile in f.rsplit("/", 1)[-1] and f.endswith(".DBL.DIR")]
        files = [f for folder in sorted(folders) for f in listed(folder) if tile in f.rsplit("/", 1)[-1]]
        if not files:
            raise FileNotFoundError(f"no elevation for tile {tile}")
        return self._file(files, "ALT_R2")

    def species(self) -> DataFrame:
        return self.xml().select(species(F.col("xml")).alias("species"))
