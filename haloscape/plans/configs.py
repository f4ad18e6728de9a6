"""Parameters of a run: named one-dimensional (or explicitly dimensioned) values with bounds, configurations of them, and sweeps.

Configurations are small and live on the driver; a sweep's table is made by the cluster.
"""

from __future__ import annotations

import inspect
import itertools
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bands import WAVELENGTHS
from ..functions import five_s


class ConfigurationError(ValueError):
    """A configuration that doesn't fit together."""


@dataclass(frozen=True)
class Values:
    """Values over named dimensions: ``data`` is flat, the last dimension varies fastest; ``labels`` by dimension."""

    dims: tuple[str, ...]
    data: tuple[float, ...]
    labels: Mapping[str, tuple[float, ...]]

    @property
    def sizes(self) -> dict[str, int]:
        return {d: len(self.labels[d]) for d in self.dims}

    def cut(self, dim: str, lo: int, hi: int) -> Values:
        if dim not in self.dims:
            return self
        at, shape = self.dims.index(dim), [len(self.labels[d]) for d in self.dims]
        kept = [v for place, v in zip(itertools.product(*map(range, shape)), self.data, strict=True) if lo <= place[at] < hi]
        return Values(self.dims, tuple(kept), {**self.labels, dim: self.labels[dim][lo:hi]})

    def rows(self) -> list[tuple]:
        """(labels ..., value)."""
        return [(*at, v) for at, v in zip(itertools.product(*(self.labels[d] for d in self.dims)), self.data, strict=True)]


def values(name: str, given, least: float | None = None, most: float | None = None) -> Values:
    """A number or a list gets a dimension named like the field; ``(dims, nested lists)`` names its own.  Lists of lists without names, and values out of
    bounds, are errors."""
    if isinstance(given, Values):
        made = given
    elif isinstance(given, tuple) and len(given) == 2 and isinstance(given[0], (list, tuple)) and all(isinstance(d, str) for d in given[0]):
        dims, data = tuple(given[0]), given[1]
        shape, flat = [], data
        for _ in dims:
            shape.append(len(flat))
            flat = flat[0]
        for _ in dims[1:]:
            data = [x for row in data for x in row]
        if len(data) != math.prod(shape):
            raise ValueError(f"{name}: rows of different lengths")
        data = tuple(float(x) for x in data)
        made = Values(dims, data, {d: data if len(dims) == 1 else tuple(map(float, range(n))) for d, n in zip(dims, shape, strict=True)})
    else:
        flat = [given] if isinstance(given, (int, float)) else list(given)
        if any(isinstance(x, (list, tuple)) for x in flat):
            raise ValueError(f"{name}: nested lists need names of their dimensions")
        flat = tuple(float(x) for x in flat)
        made = Values((name,), flat, {name: flat})
    if least is not None and min(made.data) < least:
        raise ValueError(f"{name}: {min(made.data)} is under {least}")
    if most is not None and max(made.data) > most:
        raise ValueError(f"{name}: {max(made.data)} is over {most}")
    return made


class Config:
    """Base of configurations.  Subclasses are frozen dataclasses; ``BOUNDS`` names the fields that hold values."""

    BOUNDS: Mapping[str, tuple[float | None, float | None]] = {}

    def __post_init__(self) -> None:
        for name, (least, most) in self.BOUNDS.items():
            object.__setattr__(self, name, values(name, getattr(self, name), least, most))

    @property
    def arrays(self) -> dict[str, Values]:
        return {k: getattr(self, k) for k in self.BOUNDS}

    @property
    def others(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name not in self.BOUNDS}

    @property
    def stable(self) -> dict:
        """Plain lists and scalars, the same in every environment, for cache keys."""
        return {k: [list(v.dims), list(v.data)] for k, v in self.arrays.items()} | self.others

    @property
    def sizes(self) -> dict[str, int]:
        found: dict[str, int] = {}
        for v in self.arrays.values():
            for d, n in v.sizes.items():
                found.setdefault(d, n)
        return found

    def iter(self, n_batch: int, dim: str) -> Iterator[Config]:
        """Parts along ``dim`` whose number of elements over all dimensions stays within ``n_batch`` (one label at least)."""
        sizes = self.sizes
        if dim not in sizes:
            yield self
            return
        step = max(1, n_batch // max(1, math.prod(n for d, n in sizes.items() if d != dim)))
        for lo in range(0, sizes[dim], step):
            yield type(self)(**{k: v.cut(dim, lo, lo + step) for k, v in self.arrays.items()}, **self.others)

    def table(self, spark: SparkSession) -> DataFrame:
        """All combinations: fields that share a dimension go together, others are crossed."""
        return Sweep(self.arrays).table(spark)

    def run(self, function: Callable[[Config], DataFrame], n_batch: int, dim: str) -> DataFrame:
        """The function's results for all parts, one after the other."""
        parts = [function(c) for c in self.iter(n_batch, dim)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def unique(self, dims: Sequence[str]) -> tuple[list[tuple], list[int]]:
        """Sorted distinct rows of the fields over ``dims``, and each place's number in them."""
        joined = [v for v in self.arrays.values() if set(v.dims) & set(dims)]
        labels = {d: v.labels[d] for v in joined for d in v.dims}
        order = [*dims, *(d for d in labels if d not in dims)]
        rows = []
        for at in itertools.product(*(range(len(labels[d])) for d in order)):
            place = dict(zip(order, at, strict=True))
            row = []
            for v in joined:
                flat = 0
                for d in v.dims:
                    flat = flat * len(v.labels[d]) + place[d]
                row.append(v.data[flat])
            rows.append(tuple(row))
        distinct = sorted(set(rows))
        number = {r: n for n, r in enumerate(distinct)}
        return distinct, [number[r] for r in rows]


@dataclass(frozen=True)
class AtmosphereConfig(Config):
    """``species``: shares that sum to one."""

    aot: Values
    h: Values
    rh: Values
    href: Values
    species: Mapping[str, float] = field(default_factory=lambda: {"sulphate": 1.0})

    BOUNDS = {"aot": (0.0, None), "h": (0.0, 10.0), "rh": (0.0, 100.0), "href": (0.1, None)}

    def __post_init__(self) -> None:
        super().__post_init__()
        if abs((total := sum(self.species.values())) - 1) > 1e-5:
            raise ValueError(f"species sum to {total}, not to 1")


@dataclass(frozen=True)
class GeometryConfig(Config):
    sza: Values
    vza: Values
    saa: Values
    vaa: Values
    sat_height: float = 700.0

    BOUNDS = {"sza": (0.0, 90.0), "vza": (0.0, 90.0), "saa": (0.0, 360.0), "vaa": (0.0, 360.0)}

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.sat_height < 0:
            raise ValueError("the satellite is under the ground")

    @property
    def sun(self) -> dict[str, tuple[float, ...]]:
        return {"th_deg": self.sza.data, "phi_deg": self.saa.data}

    @property
    def satellite(self) -> dict[str, tuple[float, ...]]:
        """Carries the sun's azimuth, like the sun's own direction."""
        return {"th_deg": self.vza.data, "phi_deg": self.saa.data}

    def offsets(self, spark: SparkSession) -> DataFrame:
        """(vza, vaa, dx, dy) of the satellite over the ground."""
        rows = Sweep({"vza": self.vza, "vaa": self.vaa}).table(spark)
        dx, dy = five_s.satellite_offset(F.lit(self.sat_height), F.col("vza"), F.col("vaa"))
        return rows.select("vza", "vaa", dx.alias("dx"), dy.alias("dy"))


@dataclass(frozen=True)
class SpectralConfig(Config):
    wl: Values

    BOUNDS = {"wl": (0.0, None)}

    @classmethod
    def from_bands(cls, bands: Sequence[str]) -> SpectralConfig:
        return cls([WAVELENGTHS[b] for b in bands])

    @property
    def bands(self) -> list[str]:
        """The nearest band of each wavelength, the first in instrument order on ties."""
        return [min(WAVELENGTHS, key=lambda b: abs(WAVELENGTHS[b] - wl)) for wl in self.wl.data]


def aggregate(configs: Sequence[Config], names: Sequence[str]) -> tuple[dict[str, Values], dict]:
    """All values and all other fields by name; the first configuration that has one counts."""
    arrays: dict[str, Values] = {}
    others: dict = {}
    for c in configs:
        arrays = c.arrays | arrays
        others = c.others | others
    if missing := sorted(set(names) - set(arrays)):
        raise ConfigurationError(f"no configuration has {missing}")
    return arrays, others


def one_dimension(params: Mapping[str, Values], mandatory: Sequence[str] = ("aot", "rh", "wl", "href", "h")) -> list[dict[str, float]]:
    """A row for each label of the one dimension that all share."""
    if missing := [m for m in mandatory if m not in params]:
        raise ConfigurationError(f"missing parameters: {missing}")
    first = next(iter(params.values()))
    if len(first.dims) != 1:
        raise ValueError("each parameter has one dimension")
    for name, v in params.items():
        if v.dims != first.dims or len(v.data) != len(first.data):
            raise ValueError(f"{name} isn't over {first.dims[0]} with {len(first.data)} labels")
    return [{name: v.data[i] for name, v in params.items()} for i in range(len(first.data))]


def declared(function: Callable) -> set[str]:
    kinds = (inspect.Parameter.VAR_POSITIONAL, inspect.Parameter.VAR_KEYWORD)
    return {k for k, p in inspect.signature(function).parameters.items() if p.kind not in kinds}


class Sweep:
    """All combinations of ``scalars`` (one-dimensional; those over one dimension go together), each with all ``vectors``, which may be
    handed over in chunks of so many labels of a dimension."""

    def __init__(self, scalars: Mapping[str, Values], vectors: Mapping[str, Values] | None = None, chunks: Mapping[str, int] | None = None):
        for name, v in scalars.items():
            if len(v.dims) > 1:
                raise ValueError(f"{name} has {len(v.dims)} dimensions; reduce it to its distinct rows first")
        for name, v in {**scalars, **(vectors or {})}.items():
            for d in v.dims:
                if len(set(v.labels[d])) < len(v.labels[d]) and d == name:
                    raise ValueError(f"{name} has repeated labels")
        self.scalars, self.vectors, self.chunks = dict(scalars), dict(vectors or {}), dict(chunks or {})

    @classmethod
    def from_configs(cls, configs: Sequence[Config], scalars: Sequence[str], vectors: Sequence[str] = (), chunks: Mapping[str, int] | None = None) -> Sweep:
        found, _ = aggregate(configs, [*scalars, *vectors])
        return cls({k: found[k] for k in scalars}, {k: found[k] for k in vectors}, chunks)

    @property
    def dims(self) -> list[str]:
        return list(dict.fromkeys(d for v in {**self.scalars, **self.vectors}.values() for d in v.dims))

    def table(self, spark: SparkSession) -> DataFrame:
        """A column for each dimension and each field, and ``chunk``, the number of the vectors' chunk that a row falls into."""
        by_dims: dict[tuple[str, ...], dict[str, Values]] = {}
        for name, v in {**self.scalars, **self.vectors}.items():
            by_dims.setdefault(v.dims, {})[name] = v
        out, chunk = None, F.lit(0)
        for dims, named in sorted(by_dims.items(), key=lambda x: len(x[0])):
            first = next(iter(named.values()))
            added = [n for n in named if n not in dims]
            rows = []
            for flat, place in enumerate(itertools.product(*(range(len(first.labels[d])) for d in dims))):
                rows.append((*(float(first.labels[d][i]) for d, i in zip(dims, place, strict=True)), *(float(named[n].data[flat]) for n in added), *place))
            schema = ", ".join([*(f"`{n}` double" for n in (*dims, *added)), *(f"`{d}_place` int" for d in dims)])
            part = spark.createDataFrame(rows, schema)
            if out is None:
                out = part
                continue
            shared = [c for c in part.columns if c in out.columns]
            out = out.join(part, shared) if shared else out.crossJoin(part)
        factor = 1
        for d, size in self.chunks.items():
            if out is not None and f"{d}_place" in out.columns:
                chunk = chunk + F.floor(F.col(f"{d}_place") / size).cast("int") * factor
                factor *= -(-next(len(v.labels[d]) for v in self.vectors.values() if d in v.dims) // size)
        return out.withColumn("chunk", chunk).drop(*[c for c in out.columns if c.endswith("_place")])

    def apply(self, spark: SparkSession, function: Callable, name: str, as_columns: bool = True, **fixed) -> DataFrame:
        """Adds ``name``: what the function gives for the fields that it declares.  A function of Columns becomes an expression; with ``as_columns`` false
        it is called once for each combination of scalars and chunk, with numbers for scalars and arrays for vectors."""
        rows, wanted = self.table(spark), declared(function)
        fixed = {k: v for k, v in fixed.items() if k in wanted}
        asked = [c for c in rows.columns if c in wanted]
        if as_columns:
            return rows.withColumn(name, function(**{c: F.col(c) for c in asked}, **fixed)).drop("chunk")
        by = [*dict.fromkeys(d for v in self.scalars.values() for d in v.dims), "chunk"]
        held = set(self.scalars)

        def call(pdf):
            args = {c: float(pdf[c].iloc[0]) if c in held else pdf[c].to_numpy() for c in asked}
            return pdf.assign(**{name: function(**args, **fixed)}).drop(columns="chunk")

        schema = ", ".join([*(f"`{c}` double" for c in rows.columns if c != "chunk"), f"`{name}` double"])
        return rows.groupBy(*by).applyInPandas(call, schema)
