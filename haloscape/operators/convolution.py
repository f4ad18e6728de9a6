"""2-D convolution of gridded fields.

Small kernels join by offset and sum, in SQL.  Larger ones use an FFT: over whole fields (``fft``), one field a task, with any boundary; over tiles with halos
(``tiled``), for fields that no task should hold; or over tiles and blocks of the kernel (``partitioned``), for kernels that are as large as such fields.  ``whole_or_parts`` takes
the first or the last of these by the grid's size.  ``wrap`` keeps the
boundary that such transforms have when padding is appended on the far side only, ``mirror`` reflects on both sides.  Kernels may differ by any of the
keys: they are joined on those that they have.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import five_s
from .algebra import SMALL_ROWS


def joined_kernel(df: DataFrame, kernel: DataFrame, shared: Sequence[str]) -> DataFrame:
    """Each row of ``df`` with the kernel rows of its keys.  A kernel for all keys is sent to all executors if it is small, which its count says."""
    if shared:
        return df.join(kernel, list(shared))
    return df.crossJoin(F.broadcast(kernel) if kernel.count() <= SMALL_ROWS else kernel)


def small(df: DataFrame, kernel: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Zero outside, same size: (keys, iy, ix, out).  ``kernel``: (dy, dx, w) and any of the keys; sums are made in each task before
    they are shuffled."""
    shared = [k for k in keys if k in kernel.columns]
    pairs = joined_kernel(df.select(*keys, "iy", "ix", value), kernel, shared)
    spread = pairs.select(*keys, (F.col("iy") + F.col("dy")).alias("iy"), (F.col("ix") + F.col("dx")).alias("ix"), (F.col(value) * F.col("w")).alias("t"))
    sums = spread.groupBy(*keys, "iy", "ix").agg(F.sum("t").alias(out))
    return df.select(*keys, "iy", "ix").join(sums, [*keys, "iy", "ix"])


def convolve(image, kernel, padding: str = "reflect", kind: str = "same", constant: float = 0.0, boundary: str = "wrap"):
    """numpy: convolution of two square arrays."""
    import numpy as np

    k = kernel.shape[0]
    padded, lead, size, shape = frame(image, k, padding, kind, constant, boundary)
    product = np.fft.irfft2(np.fft.rfft2(padded, shape) * np.fft.rfft2(kernel, shape), shape)
    return product[lead : lead + size, lead : lead + size]


def frame(image, k: int, padding: str = "reflect", kind: str = "same", constant: float = 0.0, boundary: str = "wrap"):
    """numpy: the image padded for a kernel of side ``k``, where the result begins, its side, and the transform's shape."""
    import numpy as np

    if kind not in ("same", "valid") or padding not in ("reflect", "replicate", "constant"):
        raise ValueError(f"{kind} and {padding} aren't supported")
    n = image.shape[0]
    if kind == "valid":
        return image, k - 1, n - k + 1, [n + k - 1] * 2
    mode = {"reflect": "reflect", "replicate": "edge", "constant": "constant"}[padding]
    more = {"constant_values": constant} if padding == "constant" else {}
    before = k - 1 if boundary == "mirror" else 0
    padded = np.pad(image, ((before, k - 1), (before, k - 1)), mode=mode, **more)
    ext = padded.shape[0]
    return padded, (k - 1) // 2 + before, n, [ext, ext + ext % 2]


def kernel_slope(image, slope, k: int, padding: str = "reflect", boundary: str = "wrap"):
    """numpy: the derivative of a loss by each weight of a kernel of side ``k``, from its derivative by each pixel of the convolved image: their correlation with the image, which is
    the convolution's adjoint."""
    import numpy as np

    padded, lead, size, shape = frame(image, k, padding, boundary=boundary)
    placed = np.zeros(shape)
    placed[lead : lead + size, lead : lead + size] = slope
    return np.fft.irfft2(np.conj(np.fft.rfft2(padded, shape)) * np.fft.rfft2(placed, shape), shape)[:k, :k]


def arrays_of(cells: str, fields: dict[str, str]) -> list[Column]:
    """A list of structs as lists of numbers, which go to Python as they are."""
    return [F.col(f"{cells}.{f}").alias(name) for name, f in fields.items()]


def kernel_arrays(kernel: DataFrame, shared: Sequence[str]) -> DataFrame:
    """One row for each kernel: (shared, kdy, kdx, kw)."""
    held = kernel.groupBy(*shared).agg(F.collect_list(F.struct("dy", "dx", "w")).alias("k"))
    return held.select(*shared, *arrays_of("k", {"kdy": "dy", "kdx": "dx", "kw": "w"}))


def dense(rows, columns, values, shape):
    import numpy as np

    out = np.zeros(shape)
    out[rows, columns] = values
    return out


def numbers(batch, name: str, i: int):
    """A list column's row as an array."""
    import numpy as np

    return np.asarray(batch.column(name)[i].values)


def fft(df: DataFrame, kernel: DataFrame, keys: Sequence[str], value: str, out: str, padding: str = "reflect", boundary: str = "wrap") -> DataFrame:
    """(keys, iy, ix, out), one field a task; missing pixels count as 0.  ``kernel``: (dy, dx, w) and any of the keys."""
    shared = [k for k in keys if k in kernel.columns]
    fields = df.groupBy(*keys).agg(F.collect_list(F.struct("iy", "ix", F.col(value).cast("double").alias("v"))).alias("cells"))
    fields = fields.select(*keys, *arrays_of("cells", {"cy": "iy", "cx": "ix", "cv": "v"}))
    rows = joined_kernel(fields, kernel_arrays(kernel, shared), shared)
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("iy", T.IntegerType()), T.StructField("ix", T.IntegerType()), T.StructField(out, T.DoubleType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                iy, ix, v, dy, dx, w = (numbers(batch, c, i) for c in ("cy", "cx", "cv", "kdy", "kdx", "kw"))
                n, k = int(max(iy.max(), ix.max())) + 1, int(dy.max() - dy.min()) + 1
                done = convolve(dense(iy, ix, v, (n, n)), dense(dy - dy.min(), dx - dx.min(), w, (k, k)), padding, boundary=boundary)
                held = [pa.repeat(batch.column(c)[i], len(iy)) for c in keys]
                yield pa.RecordBatch.from_arrays([*held, pa.array(iy, pa.int32()), pa.array(ix, pa.int32()), pa.array(done[iy, ix])], names=[*keys, "iy", "ix", out])

    return rows.mapInArrow(run, schema)


def tiled(df: DataFrame, kernel: DataFrame, keys: Sequence[str], value: str, out: str, tile: int = 512, boundary: str = "mirror") -> DataFrame:
    """(keys, iy, ix, out) like ``fft`` with ``mirror`` (or ``zero``) boundaries, for fields of any size: a task holds one tile with its halo.  The halo is the kernel's
    greatest reach, which must be under the field's side; pixels go to each tile that their halo reaches, (1 + 2 halo / tile)^2 times on average."""
    if boundary not in ("mirror", "zero"):
        raise ValueError(f"no boundary {boundary}")
    shared = [k for k in keys if k in kernel.columns]
    reach = kernel.agg(F.max(F.greatest(F.abs("dy"), F.abs("dx")))).first()[0] or 0
    sides = df.groupBy(*keys).agg((F.max("iy") + 1).alias("ny"), (F.max("ix") + 1).alias("nx"))
    placed = df.select(*keys, "iy", "ix", F.col(value).cast("double").alias("v")).join(sides, list(keys))

    def copies(at: str, n: str) -> Column:
        """Where a pixel stands, itself and its mirror images in the halo."""
        here = F.col(at)
        if boundary == "zero":
            return F.array(here)
        low = F.when((here > 0) & (here <= reach), -here)
        high = F.when((here < F.col(n) - 1) & (here >= F.col(n) - 1 - reach), 2 * (F.col(n) - 1) - here)
        return F.array_compact(F.array(here, low, high))

    def tiles(at: str, n: str) -> Column:
        first = F.greatest(F.lit(0), F.floor((F.col(at) - reach) / tile))
        last = F.least(F.floor((F.col(n) - 1) / tile), F.floor((F.col(at) + reach) / tile))
        return F.sequence(first.cast("int"), last.cast("int"))

    spread = placed.withColumn("py", F.explode(copies("iy", "ny"))).withColumn("px", F.explode(copies("ix", "nx")))
    spread = spread.withColumn("ty", F.explode(tiles("py", "ny"))).withColumn("tx", F.explode(tiles("px", "nx")))
    cells = spread.groupBy(*keys, "ty", "tx").agg(F.collect_list(F.struct((F.col("py") - F.col("ty") * tile + reach).alias("y"), (F.col("px") - F.col("tx") * tile + reach).alias("x"), "v", ((F.col("py") == F.col("iy")) & (F.col("px") == F.col("ix"))).alias("own"))).alias("cells"))
    cells = cells.select(*keys, "ty", "tx", *arrays_of("cells", {"cy": "y", "cx": "x", "cv": "v"}), F.transform("cells", lambda c: c["own"].cast("int")).alias("own"))
    rows = joined_kernel(cells, kernel_arrays(kernel, shared), shared)
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("iy", T.IntegerType()), T.StructField("ix", T.IntegerType()), T.StructField(out, T.DoubleType())])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        side = tile + 2 * reach
        for batch in batches:
            for i in range(batch.num_rows):
                y, x, v, own, dy, dx, w = (numbers(batch, c, i) for c in ("cy", "cx", "cv", "own", "kdy", "kdx", "kw"))
                weights = dense(dy + reach, dx + reach, w, (2 * reach + 1,) * 2)
                shape = [side + 2 * reach] * 2
                done = np.fft.irfft2(np.fft.rfft2(dense(y, x, v, (side, side)), shape) * np.fft.rfft2(weights, shape), shape)
                inside = (own > 0) & (y >= reach) & (y < reach + tile) & (x >= reach) & (x < reach + tile)
                y, x = y[inside], x[inside]
                ty, tx = batch.column("ty")[i].as_py(), batch.column("tx")[i].as_py()
                held = [pa.repeat(batch.column(c)[i], len(y)) for c in keys]
                places = (pa.array((y - reach + ty * tile).astype(np.int32)), pa.array((x - reach + tx * tile).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*held, *places, pa.array(done[y + reach, x + reach])], names=[*keys, "iy", "ix", out])

    return rows.mapInArrow(run, schema)


#: Side of the greatest field that one task transforms whole.
WHOLE_SIDE = 1024


def standing(at: str, n: str, reach: int, side: int, boundary: str, even: bool) -> Column:
    """Where a pixel of a field of length ``n`` stands between -reach and n - 1 + reach: itself, and its images beyond the ends.  ``side``: the kernel's; ``even``: lengths of transforms along
    this axis are."""
    here, size = F.col(at), F.col(n)
    if boundary == "zero":
        return F.array(here)
    mirrored = 2 * (size - 1) - here
    if boundary == "mirror":
        low = F.when((here > 0) & (here <= reach), -here)
        high = F.when((here < size - 1) & (mirrored <= size - 1 + reach), mirrored)
    else:  # the padding stands after the last pixel, and the transform's period brings its end before the first
        long = size + side - 1
        period = long + long % 2 if even else long
        padded = (here < size - 1) & (mirrored < long)
        high = F.when(padded & (mirrored <= size - 1 + reach), mirrored)
        low = F.when(padded & (mirrored - period >= -reach), mirrored - period)
    return F.array_compact(F.array(here, low, high))


def parts_of(df: DataFrame, keys: Sequence[str], at: tuple[Column, Column], value: str, part: int, names: tuple[str, str], cells: str) -> DataFrame:
    """(keys, names, y, x and v arrays under ``cells``): the rows of a table, cut to squares of side ``part``."""
    cut = df.select(*keys, *[F.floor(a / part).cast("int").alias(n) for a, n in zip(at, names, strict=True)], F.struct(F.pmod(at[0], F.lit(part)).cast("int").alias("y"), F.pmod(at[1], F.lit(part)).cast("int").alias("x"), F.col(value).cast("double").alias("v")).alias("cell"))
    held = cut.groupBy(*keys, *names).agg(F.collect_list("cell").alias("cells"))
    return held.select(*keys, *names, *arrays_of("cells", {f"{cells}y": "y", f"{cells}x": "x", f"{cells}v": "v"}))


def partitioned(df: DataFrame, kernel: DataFrame, keys: Sequence[str], value: str, out: str, block: int = 256, boundary: str = "wrap") -> DataFrame:
    """(keys, iy, ix, out) like ``fft`` with the same boundary (``wrap``, ``mirror`` or ``zero``), for fields and kernels of any size.

    Field and kernel are cut to squares of side ``block``.  Each square of the field goes to the places at which its products with the kernel's squares begin, once for each of these; there
    their transforms are multiplied and summed, one pair at a time, and the sum is transformed back once.  What
    neighbouring places give for a pixel, four at most, is added by a shuffle.  A task holds a few arrays of (2 block)^2 numbers, whatever the kernel's reach, and a pixel
    is copied (kernel's side / block + 1)^2 times at most, beside its images beyond the field's ends."""
    if boundary not in ("wrap", "mirror", "zero"):
        raise ValueError(f"no boundary {boundary}")
    shared = [k for k in keys if k in kernel.columns]
    extent = kernel.agg(F.coalesce(F.max(F.greatest(F.abs("dy"), F.abs("dx"))), F.lit(0)).alias("r")).first()
    reach = int(extent["r"])
    side = 2 * reach + 1
    last = F.max(F.greatest("iy", "ix")) + 1  # fields are square; missing pixels count as 0
    sides = df.groupBy(*keys).agg(last.alias("ny"), last.alias("nx"))
    narrow = F.least("ny", "nx") >= side if boundary == "wrap" else F.least("ny", "nx") > reach
    if boundary != "zero" and sides.where(~narrow).count():
        raise ValueError(f"a kernel of side {side} is too wide to be reflected")
    sides = F.broadcast(sides) if sides.count() <= SMALL_ROWS else sides
    placed = df.select(*keys, "iy", "ix", value).join(sides, list(keys))
    images = placed.withColumn("py", F.explode(standing("iy", "ny", reach, side, boundary, False))).withColumn("px", F.explode(standing("ix", "nx", reach, side, boundary, True)))
    tiles = parts_of(images, keys, (F.col("py"), F.col("px")), value, block, ("ty", "tx"), "f")
    blocks = parts_of(kernel, shared, (F.col("dy"), F.col("dx")), "w", block, ("by", "bx"), "k")
    few = kernel.count() <= SMALL_ROWS
    pairs = tiles.join(F.broadcast(blocks) if few else blocks, shared) if shared else tiles.crossJoin(F.broadcast(blocks) if few else blocks)
    pairs = pairs.withColumns({"oy": F.col("ty") + F.col("by"), "ox": F.col("tx") + F.col("bx")}).drop("ty", "tx", "by", "bx").join(sides, list(keys))
    pairs = pairs.where(F.col("oy").between(-1, (F.col("ny") - 1) / block) & F.col("ox").between(-1, (F.col("nx") - 1) / block))  # the others' products lie beside the field
    names = [f"k{i}" for i in range(len(keys))]
    dealt = pairs.withColumnsRenamed(dict(zip(keys, names, strict=True)))
    dealt = dealt.repartition(*names, "oy", "ox").sortWithinPartitions(*names, "oy", "ox")
    kinds = [T.StructField(n, df.schema[k].dataType) for n, k in zip(names, keys, strict=True)]
    schema = T.StructType([*kinds, T.StructField("iy", T.IntegerType()), T.StructField("ix", T.IntegerType()), T.StructField("part", T.DoubleType())])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        shape, held, total, last = [2 * block] * 2, None, None, None

        def spectrum(batch, i: int, cells: str):
            y, x, v = (numbers(batch, cells + c, i) for c in "yxv")
            return np.fft.rfft2(dense(y, x, v, (block, block)), shape)

        def finished():
            done = np.fft.irfft2(total, shape)[: 2 * block - 1, : 2 * block - 1]
            y, x = (a.ravel() for a in np.mgrid[0 : 2 * block - 1, 0 : 2 * block - 1])
            y, x = y + held[-2] * block, x + held[-1] * block
            inside = (y >= 0) & (x >= 0) & (y < last[-2].as_py()) & (x < last[-1].as_py())
            n = int(inside.sum())
            return pa.RecordBatch.from_arrays([*[pa.repeat(k, n) for k in last[:-2]], pa.array(y[inside].astype(np.int32)), pa.array(x[inside].astype(np.int32)), pa.array(done.ravel()[inside])], names=schema.names)

        for batch in batches:
            for i in range(batch.num_rows):
                here = tuple(batch.column(c)[i].as_py() for c in (*names, "oy", "ox"))
                if here != held:
                    if held is not None:
                        yield finished()
                    held, total, last = here, 0.0, [batch.column(c)[i] for c in (*names, "ny", "nx")]
                total = total + spectrum(batch, i, "f") * spectrum(batch, i, "k")
        if held is not None:
            yield finished()

    sums = dealt.mapInArrow(run, schema).withColumnsRenamed(dict(zip(names, keys, strict=True))).groupBy(*keys, "iy", "ix").agg(F.sum("part").alias(out))
    return df.select(*keys, "iy", "ix").join(sums, [*keys, "iy", "ix"], "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def whole_or_parts(df: DataFrame, kernel: DataFrame, keys: Sequence[str], value: str, out: str, boundary: str = "wrap", most: int = WHOLE_SIDE) -> DataFrame:
    """``fft`` where the greatest field has a side of ``most`` pixels or less, else ``partitioned``: the same rows.  The grid's size is read first."""
    sides = df.agg(F.max(F.greatest("iy", "ix")).alias("last")).first()
    if (sides["last"] or 0) < most:
        return fft(df, kernel, keys, value, out, boundary=boundary)
    return partitioned(df, kernel, keys, value, out, boundary=boundary)


def psf_conv(df: DataFrame, kernel: DataFrame, keys: Sequence[str], conv_input: str, formula: Callable[..., Column], out: str, convolved: Callable[..., DataFrame] = whole_or_parts) -> DataFrame:
    """``df`` with ``out``: a formula of its columns and of ``rho_env``, the field that a point spread function spreads.  The formula names the columns that it takes."""
    from .algebra import sweep

    spread = convolved(df, kernel, keys, conv_input, "rho_env")
    return sweep(df.join(spread, [*keys, "iy", "ix"]), formula, out).drop("rho_env")


def surface_of(rho_unif: Column, rho_env: Column, tdir_up: Column, tdif_up: Column, sph_alb: Column) -> Column:
    return five_s.surface(rho_unif, rho_env, tdir_up, tdif_up, sph_alb)


def unif2surface(df: DataFrame, kernel: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` (keys, iy, ix, rho_unif, tdir_up, tdif_up, sph_alb) with ``rho_s``."""
    return psf_conv(df, kernel, keys, "rho_unif", surface_of, "rho_s")
