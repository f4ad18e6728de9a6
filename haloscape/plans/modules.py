"""Modules with declared inputs and outputs, pipelines that check them when built, and a content-addressed cache in Parquet."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ..operators.algebra import MissingVariableError, require
from ..scene import Scene
from .content import content_key, marked


@dataclass(frozen=True)
class Module:
    """``compute``: table -> table, lazy.  ``config`` must hold all that the result depends on besides the input."""

    name: str
    requires: tuple[str, ...]
    produces: tuple[str, ...]
    compute: Callable[[DataFrame], DataFrame]
    config: dict = field(default_factory=dict)

    def key(self, upstream: str) -> str:
        said = json.dumps([self.name, self.config, sorted(self.requires), sorted(self.produces), upstream], sort_keys=True, default=str)
        return hashlib.sha256(said.encode()).hexdigest()

    def __call__(self, df: DataFrame) -> DataFrame:
        out = self.compute(require(df, self.requires))
        return require(out, self.produces)

    def on(self, scene: Scene, cache: Cache | None = None) -> Scene:
        """The scene with what the module makes of its variables, stamped with the module and its key.  The key follows the inputs: a variable that a module made
        counts by its stamp, any other by its content.  A cached result is read instead."""
        given = scene.require(self.requires).table(self.requires)
        inputs = [[v, b, made[1] if (made := scene.about(v, b).made_by) else "content"] for v in sorted(self.requires) for b in sorted(scene.held[v])]
        plain = sorted({v for v, _, key in inputs if key == "content"})
        contents = [content_key(scene[v]) for v in plain]
        key = self.key(hashlib.sha256(json.dumps([inputs, contents]).encode()).hexdigest())
        out = cache.load(self.name, key, self.produces) if cache else None
        if out is None:
            out = marked(self(given), self.produces, self.name, key)
            out = cache.save(self.name, key, out) if cache else out
        dims = [c for c in out.columns if c not in {*self.produces, *self.requires}]
        for v in self.produces:
            scene = scene.enrich(v, out.select(*dims, v), scene.bands)
        return scene.stamp(self.produces, self.name, key)


class Cache:
    """Results under ``root/module/key``.  A result is written aside and renamed when it is whole: readers see all of it or nothing, a writer that fails leaves what stood there, and of
    two writers of a key the later one reads what the first one wrote."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, module: str, key: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{module}" + (f"/{key}" if key else ""))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def load(self, module: str, key: str, columns: Sequence[str]) -> DataFrame | None:
        """None if there is no whole result, or if it lacks a column."""
        path, fs = self._path(module, key)
        if not fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
            return None
        found = self.spark.read.parquet(path.toString())
        return found if set(columns) <= set(found.columns) else None

    def save(self, module: str, key: str, df: DataFrame) -> DataFrame:
        final, fs = self._path(module, key)
        aside, _ = self._path(module, f".{key}-{uuid.uuid4().hex}")
        try:
            df.write.parquet(aside.toString())
            self._commit(aside, final)
        finally:
            fs.delete(aside, True)
        return self.spark.read.parquet(final.toString())

    def _commit(self, aside, final) -> None:
        """Renames without replacing; a result that stands wins."""
        context = self.spark.sparkContext
        options = context._gateway.new_array(getattr(context._jvm.org.apache.hadoop.fs.Options, "Rename"), 0)
        files = context._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), context._jsc.hadoopConfiguration())
        try:
            files.rename(files.makeQualified(aside), files.makeQualified(final), options)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise

    def clear(self, module: str = "") -> None:
        path, fs = self._path(module, "")
        fs.delete(path, True)


class Pipeline:
    """Modules in order.  Missing inputs are found when it is built; what no module makes is an input of the pipeline."""

    def __init__(self, modules: Sequence[Module], given: Sequence[str] | None = None):
        self.modules = list(modules)
        made: set[str] = set()
        needed: list[str] = []
        for m in self.modules:
            needed += [v for v in m.requires if v not in made and v not in needed]
            made |= set(m.produces)
        if given is not None and (missing := sorted(set(needed) - set(given))):
            raise MissingVariableError(", ".join(missing))
        self.requires, self.produces = tuple(needed), tuple(sorted(made))

    def as_module(self, name: str) -> Module:
        return Module(name, self.requires, self.produces, self.__call__, {"modules": [m.key("") for m in self.modules]})

    def __call__(self, df: DataFrame, cache: Cache | None = None, source_key: str = "") -> DataFrame:
        """Each module's columns carry its name and key.  ``source_key`` names the input (its path and version); without it the input's content does, which reads it once
        if there is a cache."""
        key = source_key or (content_key(df) if cache else "")
        for m in self.modules:
            key = m.key(key)
            hit = cache.load(m.name, key, m.produces) if cache else None
            df = hit if hit is not None else marked(m(df), m.produces, m.name, key) if key else m(df)
            if cache and hit is None:
                df = cache.save(m.name, key, df)
        return df
