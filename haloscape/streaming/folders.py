"""Product folders as a stream: ``spark.readStream.format("haloscape_folders").option("path", root).load()``.

A product is a folder that holds a metadata file (``.xml``).  An offset is the time and the name of the newest product that was read; products are read in that order, so a
stream that starts again goes on after the last one and reads none twice.  A product should come by a rename, with its files in it, as drops do; folders without metadata are left
for a later batch, and those whose time is older than the offset aren't seen, as with any source that goes by time.  Each product is one partition: (product, sensor, date, tile, file, size, xml) a file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from ..sources.tiff import opened

SCHEMA = "product string, sensor string, date string, tile string, file string, size bigint, xml string"


class Product(InputPartition):
    def __init__(self, path: str):
        self.path = path


class FolderStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.most = int(options.get("maxProductsPerBatch", 1000))
        self.at = {"time": -1, "name": ""}

    def products(self) -> list[tuple[int, str]]:
        """(time in ns, name) of the whole products, in order."""
        from pyarrow import fs

        system, inner = opened(self.root)
        found = system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
        whole = {f.path.rsplit("/", 2)[-2] for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".xml") and f.path.rsplit("/", 2)[0] == inner}
        times = {f.base_name: f.mtime_ns or 0 for f in found if f.type == fs.FileType.Directory and f.path.rsplit("/", 1)[0] == inner}
        return sorted((times[n], n) for n in whole & times.keys() if not n.startswith("."))

    def after(self, offset: dict) -> list[tuple[int, str]]:
        return [p for p in self.products() if p > (offset["time"], offset["name"])]

    def initialOffset(self) -> dict:
        return {"time": -1, "name": ""}

    def latestOffset(self) -> dict:
        new = self.after(self.at)[: self.most]
        if new:
            self.at = {"time": new[-1][0], "name": new[-1][1]}
        return self.at

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.at = max(self.at, end, key=lambda o: (o["time"], o["name"]))
        return [Product(f"{self.root}/{name}") for time, name in self.after(start) if (time, name) <= (end["time"], end["name"])]

    def read(self, partition: Product) -> Iterator[tuple]:
        from pyarrow import fs

        system, inner = opened(partition.path)
        files = sorted((f for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.type == fs.FileType.File), key=lambda f: f.path)
        metadata = next(f.path for f in files if f.path.lower().endswith(".xml"))
        with system.open_input_stream(metadata) as f:
            xml = f.read().decode("utf-8")
        name = inner.rsplit("/", 1)[-1]
        parts = name.split("_")
        sensor, date, tile = (parts[0], parts[1][:7], parts[3][1:]) if len(parts) == 6 else (None, None, None)
        for f in files:
            yield name, sensor, date, tile, f.path[len(inner) + 1 :], f.size, xml

    def commit(self, end: dict) -> None:
        """Nothing is kept besides the offset, which the checkpoint holds."""


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "haloscape_folders"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FolderStream(self.options)


def products(spark: SparkSession, root: str, most: int = 1000) -> DataFrame:
    """A stream of the files of the products that come to ``root``, ``most`` products a batch."""
    spark.dataSource.register(FolderSource)
    return spark.readStream.format("haloscape_folders").option("path", root).option("maxProductsPerBatch", most).load()


def process(spark: SparkSession, root: str, operator: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Runs ``operator`` on each batch of products that is there and writes its result, once a batch, in place of what an earlier try wrote."""

    def each(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return products(spark, root).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
