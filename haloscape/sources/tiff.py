"""Rasters as tables: TIFF files by a data source of strips and tiles, Parquet tables and .npy arrays.

Paths may be of any file system that Arrow opens.  A TIFF's directory is read on the driver; each partition reads the bytes of some of its blocks only, so a
file of any size needs no task to hold it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the TIFF format: field type -> struct code and size; tag numbers; block compressions.
FIELD = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR = 256, 257, 258, 259, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES, SAMPLE_FORMAT, PIXEL_SCALE, TIE_POINT, NO_DATA = 317, 322, 323, 324, 325, 339, 33550, 33922, 42113
RAW, DEFLATE, OLD_DEFLATE = 1, 8, 32946
SCHEMA = "iy int, ix int, y double, x double, value double"
BLOCKS_A_PARTITION = 16


def opened(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return system, inner


def listed(folder: str, folders: bool = False) -> list[str]:
    """Paths of the files (or folders) in a folder."""
    from pyarrow import fs

    system, inner = opened(folder)
    kind = fs.FileType.Directory if folders else fs.FileType.File
    try:
        found = system.get_file_info(fs.FileSelector(inner))
    except (FileNotFoundError, NotADirectoryError) as e:
        raise FileNotFoundError(f"{folder} does not exist") from e
    # a table is a folder of files
    return [f"{folder.rstrip('/')}/{f.base_name}" for f in found if f.type == kind or not folders and f.base_name.endswith(".parquet")]


class Directory:
    """The first directory of a TIFF file."""

    def __init__(self, file):
        head = file.read(8)
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if self.order is None or struct.unpack(self.order + "H", head[2:4])[0] != 42:
            raise ValueError("not a TIFF file")
        file.seek(struct.unpack(self.order + "I", head[4:])[0])
        count = struct.unpack(self.order + "H", file.read(2))[0]
        entries = file.read(12 * count)
        self.tags = {}
        for i in range(count):
            tag, kind, n = struct.unpack(self.order + "HHI", entries[12 * i : 12 * i + 8])
            if kind not in FIELD:
                continue
            code, size = FIELD[kind]
            raw = entries[12 * i + 8 : 12 * i + 12]
            if size * n > 4:
                file.seek(struct.unpack(self.order + "I", raw)[0])
                raw = file.read(size * n)
            self.tags[tag] = raw[:n].rstrip(b"\0").decode("latin-1") if code == "s" else struct.unpack(self.order + code * n, raw[: size * n])

    def one(self, tag: int, default=None):
        found = self.tags.get(tag)
        return default if found is None else found if isinstance(found, str) else found[0]

    @property
    def tiled(self) -> bool:
        return TILE_AT in self.tags

    @property
    def block_shape(self) -> tuple[int, int]:
        if self.tiled:
            return self.one(TILE_HEIGHT), self.one(TILE_WIDTH)
        return min(self.one(STRIP_ROWS, self.one(HEIGHT)), self.one(HEIGHT)), self.one(WIDTH)

    @property
    def grid(self) -> tuple[int, int]:
        """Blocks down and across."""
        (h, w), height, width = self.block_shape, self.one(HEIGHT), self.one(WIDTH)
        return -(-height // h), -(-width // w)


class TiffBlocks(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class TiffReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.layer = options["path"], int(options.get("layer", 1))
        self.size = int(options.get("blocks", BLOCKS_A_PARTITION))

    def directory(self):
        system, inner = opened(self.path)
        file = system.open_input_file(inner)
        return Directory(file), file

    def partitions(self) -> Sequence[InputPartition]:
        directory, file = self.directory()
        file.close()
        down, across = directory.grid
        return [TiffBlocks(a, min(down * across, a + self.size)) for a in range(0, down * across, self.size)]

    def read(self, partition: InputPartition) -> Iterator:
        import numpy as np
        import pyarrow as pa

        directory, file = self.directory()
        samples, bits, kind = directory.one(SAMPLES, 1), directory.one(BITS, 1), directory.one(SAMPLE_FORMAT, 1)
        compression, predictor, planar = directory.one(COMPRESSION, RAW), directory.one(PREDICTOR, 1), directory.one(PLANAR, 1) == 2
        if compression not in (RAW, DEFLATE, OLD_DEFLATE) or predictor not in (1, 2) or bits not in (8, 16, 32, 64) or not 1 <= self.layer <= samples:
            raise ValueError(f"{self.path}: compression {compression}, predictor {predictor}, {bits} bits or layer {self.layer} of {samples} isn't supported")
        dtype = np.dtype({1: "u", 2: "i", 3: "f"}[kind] + str(bits // 8)).newbyteorder(directory.order)
        (h, w), (down, across), height, width = directory.block_shape, directory.grid, directory.one(HEIGHT), directory.one(WIDTH)
        places, sizes = (directory.tags[TILE_AT], directory.tags[TILE_BYTES]) if directory.tiled else (directory.tags[STRIP_AT], directory.tags[STRIP_BYTES])
        scale, tie, nothing = directory.tags.get(PIXEL_SCALE, (1.0, 1.0, 0.0)), directory.tags.get(TIE_POINT, (0.0,) * 6), directory.one(NO_DATA)
        held = 1 if planar else samples
        for b in range(partition.first, partition.last):
            at = b + (self.layer - 1) * down * across if planar else b
            file.seek(places[at])
            raw = file.read(sizes[at])
            raw = raw if compression == RAW else zlib.decompress(raw)
            rows = h if directory.tiled else min(h, height - (b // across) * h)
            block = np.frombuffer(raw, dtype, rows * w * held).reshape(rows, w, held)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=block.dtype.newbyteorder("="))
            y0, x0 = (b // across) * h, (b % across) * w
            block = block[: height - y0, : width - x0, 0 if planar else self.layer - 1].astype(float)
            if nothing not in (None, ""):
                block = np.where(block == float(nothing), np.nan, block)
            iy, ix = (v.ravel() for v in np.mgrid[y0 : y0 + block.shape[0], x0 : x0 + block.shape[1]].astype(np.int32))
            y, x = tie[4] - (iy + 0.5 - tie[1]) * scale[1], tie[3] + (ix + 0.5 - tie[0]) * scale[0]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (iy, ix, y, x, block.ravel())], names=["iy", "ix", "y", "x", "value"])
        file.close()


class TiffSource(DataSource):
    """``spark.read.format("haloscape_tiff").option("path", ...).option("layer", 1).load()``."""

    @classmethod
    def name(cls) -> str:
        return "haloscape_tiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TiffReader(self.options)


def raster_table(spark: SparkSession, path: str, layer: int = 1) -> DataFrame:
    """(iy, ix, y, x, value) of one layer of a raster; without coordinates in the file, pixels are one unit wide."""
    ending = path.rsplit(".", 1)[-1].lower()
    if ending in ("tif", "tiff"):
        spark.dataSource.register(TiffSource)
        return spark.read.format("haloscape_tiff").option("path", path).option("layer", layer).load()
    if ending == "parquet":
        table = spark.read.parquet(path)
        table = table.where(F.col("layer") == layer) if "layer" in table.columns else table
        given = {c: F.col(c) if c in table.columns else at for c, at in (("y", -(F.col("iy") + 0.5)), ("x", F.col("ix") + 0.5))}
        return table.select(F.col("iy").cast("int").alias("iy"), F.col("ix").cast("int").alias("ix"), given["y"].cast("double").alias("y"), given["x"].cast("double").alias("x"), F.col("value").cast("double").alias("value"))
    if ending == "npy":

        def rows(batches: Iterator) -> Iterator:
            import io

            import numpy as np
            import pyarrow as pa

            for batch in batches:
                for content in batch.column("content"):
                    image = np.load(io.BytesIO(content.as_py()))
                    image = image[layer - 1] if image.ndim == 3 else image
                    for y in range(image.shape[0]):
                        n = image.shape[1]
                        ix = np.arange(n, dtype=np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, y, np.int32)), pa.array(ix), pa.array(np.full(n, -(y + 0.5))), pa.array(ix + 0.5), pa.array(image[y].astype(float))], names=["iy", "ix", "y", "x", "value"])

        return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, SCHEMA)
    raise ValueError(f"no reader for {path}")
