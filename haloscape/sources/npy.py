"""A writer of .npy rasters: ``df.write.format("haloscape_npy").mode("append").save(folder)``.

Rows are (name, iy, ix, value): each name becomes one file.  A task writes its files aside, under names that readers pass over; the job's commit renames them when all tasks are
done, an abort removes them.  So a task that fails, and is run again elsewhere, leaves no file and no half of one.  Paths are of any file system that Arrow opens.  A file's
rows must stand together: ``write_rasters`` deals and sorts them.  A task holds one image.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .tiff import opened

SCHEMA = "name string, iy int, ix int, value double"


@dataclass
class Written(WriterCommitMessage):
    #: (path aside, path)
    files: list = field(default_factory=list)


class NpyWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite = options["path"].rstrip("/"), overwrite
        self.kind = options.get("dtype", "float32")
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        import numpy as np

        done, held, parts = Written(), None, []
        system, inner = opened(self.folder)
        system.create_dir(f"{inner}/.{self.job}", recursive=True)

        def finish() -> None:
            iy, ix, v = (np.concatenate(p) for p in zip(*parts, strict=True))
            image = np.full((int(iy.max()) + 1, int(ix.max()) + 1), np.nan, self.kind)
            image[iy, ix] = v
            aside = f"{inner}/.{self.job}/{uuid.uuid4().hex}"
            with system.open_output_stream(aside) as f:
                np.lib.format.write_array_header_1_0(f, np.lib.format.header_data_from_array_1_0(image))
                f.write(image.tobytes())
            done.files.append((aside, f"{inner}/{held}"))

        for batch in iterator:
            names = batch.column("name").to_pylist()
            cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("iy", "ix", "value")]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if names[a] != held:
                    if held is not None:
                        finish()
                    held, parts = names[a], []
                parts.append([c[a:b] for c in columns])
        if held is not None:
            finish()
        return done

    def commit(self, messages: list) -> None:
        system, inner = opened(self.folder)
        files = [f for m in messages if m is not None for f in m.files]
        if twice := sorted({to for _, to in files if sum(t == to for _, t in files) > 1}) if len({t for _, t in files}) < len(files) else []:
            self.abort(messages)
            raise ValueError(f"several tasks wrote {twice[0]}: rows of a name must stand together")
        for aside, to in files:
            system.move(aside, to)
        self._clear(system, inner)

    def abort(self, messages: list) -> None:
        self._clear(*opened(self.folder))

    def _clear(self, system, inner: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{inner}/.{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{inner}/.{self.job}")


class NpySink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "haloscape_npy"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return NpyWriter(self.options, overwrite)


def write_rasters(df: DataFrame, folder: str, name: Column, value: str, dtype: str = "float32") -> None:
    """One .npy file for each ``name`` of (iy, ix, value); pixels that no row has are NaN, and files that stand are replaced."""
    df.sparkSession.dataSource.register(NpySink)
    rows = df.select(name.alias("name"), F.col("iy").cast("int").alias("iy"), F.col("ix").cast("int").alias("ix"), F.col(value).cast("double").alias("value"))
    dealt = rows.repartition("name").sortWithinPartitions("name")
    dealt.write.format("haloscape_npy").option("path", folder).option("dtype", dtype).mode("append").save()
