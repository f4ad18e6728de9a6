"""Helpers shared by the corpus operators: let-binding, word splitting, names that can't clash, shared scratch tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager, suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def column(name: str) -> Column:
    """A column by its whole name, dots and back-quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(taken: Sequence[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that none of ``taken`` equals, in whatever case."""
    held, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def others(df: DataFrame, replaced: Sequence[str]) -> list[Column]:
    """The columns of ``df`` that no added column replaces."""
    gone = {c.lower() for c in replaced}
    return [column(c) for c in df.columns if c.lower() not in gone]


def literal_array(values: Sequence, kind: str) -> Column:
    """A constant array of numbers, or of strings without commas, as one literal that is split when the query is optimized: a plan
    node for each element would make the driver the slow part."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>") if len(values) else F.array().cast(f"array<{kind}>")


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters stay as they are.  Pure ASCII takes the fast way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def white_words(text: Column) -> Column:
    """The runs of characters other than space and U+0009..U+000D; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return let(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "[\\x20\\x09-\\x0D]+", -1)))


def plain_words(text: Column) -> Column:
    """A-Z lower-cased, then the text's words of letters, digits and non-ASCII characters, joined and framed by
    single spaces (`` w1 w2 ``); one space if there are none."""
    spaced = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " ")
    return let(F.btrim(spaced), lambda t: F.when(t == "", " ").otherwise(F.concat(F.lit(" "), t, F.lit(" "))))


def plain_word_array(framed: Column) -> Column:
    """The words of what ``plain_words`` gives."""
    return F.when(framed == " ", F.array().cast("array<string>")).otherwise(F.split(F.btrim(framed), " ", -1))


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.  Only where it is unset (tests, one machine)
    a local folder is made and set; on a cluster that would be no shared folder, so it is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = tempfile.mkdtemp(prefix="haloscape-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def _file_system(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """An Arrow function whose worker gives its free memory back when a task ends, as idle workers stay beside other stages."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # only where the C library can
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


_marked: set[str] = set()
_scopes: list[list[str]] = []


def scratch_folder(spark: SparkSession) -> str:
    """The application's own folder in the shared one; the file system deletes it when the driver's JVM ends."""
    folder = f"{scratch_root(spark)}/haloscape-{spark.sparkContext.applicationId}"
    if folder not in _marked:
        path, fs = _file_system(spark, folder)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _marked.add(folder)
    return folder


@contextmanager
def scope() -> Iterator[list[str]]:
    """Gathers the paths of the tables that are materialized inside."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.pop()


def discard(spark: SparkSession, paths: Sequence[str]) -> None:
    """Deletes tables that nothing reads any more."""
    for p in paths:
        path, fs = _file_system(spark, p)
        fs.delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: it is computed once, its lineage ends there, and the loss of
    an executor costs no more than the tasks that it ran.  The table stays until ``discard`` or the end of the application."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for made in _scopes:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)
