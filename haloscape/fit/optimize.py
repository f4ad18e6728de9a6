"""Fitting a point spread function: one independent fit for each state, in parallel.

The fit minimises the residual between the surface recovered from uniform-surface reflectance and its target.  Parameters move within
their bounds, in log space unless ``moves`` names another transform; slopes come from the convolution's adjoint.  Adam comes first, then L-BFGS with a line search for the strong Wolfe conditions.  The best parameters seen win.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.atmosphere import BoundedParameter, Transform
from ..functions.psf import BOUNDS, FWHM, MIXING, WIDTH, kernels
from ..operators.convolution import convolve, kernel_slope


@dataclass(frozen=True)
class Stage:
    least: int
    most: int
    tol: float
    rate: float = 1e-2


ADAM, LBFGS = Stage(5, 20, 1e-4), Stage(5, 30, 1e-6)


def kernel(model: str, params, res: float, n: int):
    """numpy: a kernel that sums to one."""
    import numpy as np

    side = (np.arange(n) - n // 2) * res
    r = np.hypot(side[:, None], side[None, :])
    if model == "gaussian":
        k = np.exp(-(r**2) / (2 * params[0] ** 2))
    elif model == "generalized_gaussian":
        k = np.exp(-((r / params[0]) ** params[1]))
    elif model == "king":
        k = (1 + r**2 / (2 * params[0] ** 2 * params[1])) ** -params[1]
    elif model == "moffat":
        k = (1 + (r / params[0]) ** (2 * params[1])) ** -params[2]
    else:
        g, lo = FWHM * params[0], 2 * params[1]
        y = np.clip(lo / sum(c * g ** (5 - i) * lo**i for i, c in enumerate(WIDTH)) ** 0.2, 0, 1)
        eta = np.clip(sum(c * y ** (i + 1) for i, c in enumerate(MIXING)), 0, 1)
        k = eta / (1 + (r / params[1]) ** 2) + (1 - eta) * np.exp(-(r**2) / (2 * params[0] ** 2))
    return k / k.sum()


def recovered(unif, k, t):
    env = convolve(unif, k)
    return (unif * (t["tdir_up"] + t["tdif_up"]) * (1 - env * t["sph_alb"]) / (1 - unif * t["sph_alb"]) - env * t["tdif_up"]) / t["tdir_up"]


def along(loss, slope, x, q, t, lo, hi):
    """Value and derivative at a step ``t`` down the direction ``q``."""
    import numpy as np

    at = np.clip(x - t * q, lo, hi)
    return loss(at), -(slope(at) @ q)


def wolfe(at, value: float, steep: float, c1: float = 1e-4, c2: float = 0.9, most: int = 20) -> float:
    """A step that meets the strong Wolfe conditions: enough descent, and a derivative that is small enough.  Steps grow until they bracket one, which bisection then
    finds; without one in ``most`` tries the best step with enough descent."""
    if steep >= 0:
        return 0.0
    lo, hi, step, best = 0.0, None, 1.0, 0.0
    low = value
    for _ in range(most):
        f, d = at(step)
        if f > value + c1 * step * steep or f >= low and lo > 0:
            hi = step
        elif abs(d) <= c2 * abs(steep):
            return step
        elif d >= 0:
            best, hi = step, step
        else:
            best, lo, low = step, step, f
        step = 2 * step if hi is None else (lo + hi) / 2
    return best


def differences(loss, lo, hi, h: float = 1e-5):
    """The slope of a function by central differences."""
    import numpy as np

    return lambda at: np.array([(loss(np.clip(at + h * e, lo, hi)) - loss(np.clip(at - h * e, lo, hi))) / (2 * h) for e in np.eye(len(at))])


def loss_and_slope(images, kernel_of, side: int):
    """Two functions of moving parameters: the loss, and its slope.  ``images``: (rho_unif, target, iy, ix, radiatives, weight); ``kernel_of`` gives the kernel of parameters.

    The slope goes backwards through the recovery and the convolution, whose adjoint is one correlation an image, to the kernel's weights; only the kernel itself is differenced
    by the parameters.  So a slope costs two convolutions an image, however many parameters there are."""
    import numpy as np

    def parts(k, unif, target, iy, ix, t):
        env = convolve(unif, k)
        down = (unif * (t["tdir_up"] + t["tdif_up"]) * t["sph_alb"] / (1 - unif * t["sph_alb"]) + t["tdif_up"]) / t["tdir_up"]  # the recovered surface falls by this with env
        got = (unif * (t["tdir_up"] + t["tdif_up"]) / (1 - unif * t["sph_alb"])) / t["tdir_up"] - down * env
        got = got[iy, ix]
        return got, got - target, max(np.abs(got).max(), np.abs(target).max(), 1.2e-7), down

    def loss(x):
        k = kernel_of(x)
        return float(sum(weight * np.mean((diff / scale) ** 2) for unif, target, iy, ix, t, weight in images for _, diff, scale, _ in [parts(k, unif, target, iy, ix, t)]))

    def slope(x):
        k, by_weight, h = kernel_of(x), np.zeros((side, side)), 1e-5
        for unif, target, iy, ix, t, weight in images:
            got, diff, scale, down = parts(k, unif, target, iy, ix, t)
            by_pixel = 2 * weight * diff / (len(diff) * scale**2)
            top = int(np.abs(got).argmax())
            if np.abs(got[top]) == scale:  # the scale moves with that pixel
                by_pixel[top] -= 2 * weight * np.mean(diff**2) / scale**3 * np.sign(got[top])
            by_env = np.zeros(unif.shape)
            by_env[iy, ix] = -by_pixel * down[iy, ix]
            by_weight += kernel_slope(unif, by_env, side)
        return np.array([np.sum(by_weight * (kernel_of(x + h * e) - kernel_of(x - h * e))) / (2 * h) for e in np.eye(len(x))])

    return loss, slope


def minimise(loss, start, lows, highs, stages: Sequence[tuple[str, Stage]], slope=None):
    """(best point, best loss, history of (stage, step, loss)) of a function within bounds.  Without ``slope`` it is differenced."""
    import numpy as np

    lo, hi = np.asarray(lows, float), np.asarray(highs, float)
    x = np.clip(np.asarray(start, float), lo, hi)
    best, history = (loss(x), x.copy()), []
    slope = slope or differences(loss, lo, hi)

    for name, stage in stages:
        m = v = np.zeros_like(x)
        pairs: list[tuple] = []
        before, g = None, slope(x)
        for step in range(1, stage.most + 1):
            value = loss(x)
            history.append((name, step, float(value)))
            if name == "adam":
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                x = np.clip(x - stage.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8), lo, hi)
                g = slope(x)
            else:
                q, marks = g.copy(), []
                for s, y in reversed(pairs):
                    a = s @ q / (s @ y)
                    marks.append(a)
                    q -= a * y
                q *= pairs[-1][0] @ pairs[-1][1] / (pairs[-1][1] @ pairs[-1][1]) if pairs else 0.1 / max(1e-30, np.abs(g).sum())
                for (s, y), a in zip(pairs, reversed(marks), strict=True):
                    q += s * (a - y @ q / (s @ y))
                length = wolfe(lambda t, x=x, q=q: along(loss, slope, x, q, t, lo, hi), value, -(g @ q))
                moved = np.clip(x - length * q, lo, hi)
                after = slope(moved)
                if (moved - x) @ (after - g) > 1e-10 * np.linalg.norm(moved - x) * np.linalg.norm(after - g):
                    pairs = [*pairs, (moved - x, after - g)][-100:]
                x, g = moved, after
            best = min(best, (loss(x), x.copy()), key=lambda b: b[0])
            if before is not None and step >= stage.least and abs(value - before) / max(abs(before), 1e-9) <= stage.tol:
                break
            before = value
    return best[1], float(best[0]), history


def fitted(train: DataFrame, combo: Sequence[str], model: str, start: Sequence[float], res: float, n: int, stages: Sequence[tuple[str, Stage]], schema: str, rows, moves: Mapping[str, Transform] | None = None) -> DataFrame:
    """What ``rows(keys, best, loss, history)`` gives for each state.  ``train``: (combo, iy, ix, rho_unif, rho_s, tdir_up, tdif_up, sph_alb) and, for several images a state, ``image``
    and ``weight``; a state's square fields are what one task holds.  Missing pixels count as 0 and aren't compared."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        images = []
        for _, one in pdf.groupby("image", sort=True) if "image" in pdf else [(0, pdf)]:
            iy, ix = one["iy"].to_numpy(), one["ix"].to_numpy()
            size = int(max(iy.max(), ix.max())) + 1
            unif = np.zeros((size, size))
            unif[iy, ix] = one["rho_unif"]
            t = {c: float(one[c].iloc[0]) for c in ("tdir_up", "tdif_up", "sph_alb")}
            images.append((unif, one["rho_s"].to_numpy(), iy, ix, t, float(one["weight"].iloc[0]) if "weight" in one else 1.0))

        moving = [BoundedParameter(min(hi, max(lo, float(v))), lo, hi, (moves or {}).get(name, Transform("exp"))) for v, (name, (lo, hi)) in zip(start, BOUNDS[model].items(), strict=True)]
        values = lambda x: [p.at(v) for p, v in zip(moving, x, strict=True)]
        loss, slope = loss_and_slope(images, lambda x: kernel(model, values(x), res, n), n)
        best, value, history = minimise(loss, [p.free for p in moving], [p.transform.free(p.lo) for p in moving], [p.transform.free(p.hi) for p in moving], stages, slope)
        best = values(best)
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in combo}, **rows(best, value, history)})

    keys = ", ".join(f"{k} {dict(train.dtypes)[k]}" for k in combo)
    return train.groupBy(*combo).applyInPandas(run, f"{keys}, {schema}")


BOTH = (("adam", ADAM), ("lbfgs", LBFGS))


def fit_psf(train: DataFrame, combo: Sequence[str], model: str, start: Sequence[float], res: float, n: int, stages: Sequence[tuple[str, Stage]] = BOTH, moves: Mapping[str, Transform] | None = None) -> DataFrame:
    """(combo, param, value, loss, steps)."""
    names = list(BOUNDS[model])
    return fitted(train, combo, model, start, res, n, stages, "param string, value double, loss double, steps int", lambda best, value, history: {"param": names, "value": best, "loss": value, "steps": len(history)}, moves)


def fit_history(train: DataFrame, combo: Sequence[str], model: str, start: Sequence[float], res: float, n: int, stages: Sequence[tuple[str, Stage]] = BOTH, moves: Mapping[str, Transform] | None = None) -> DataFrame:
    """(combo, stage, step, loss): the loss before each step."""
    fields = lambda best, value, history: {"stage": [h[0] for h in history], "step": [h[1] for h in history], "loss": [h[2] for h in history]}
    return fitted(train, combo, model, start, res, n, stages, "stage string, step int, loss double", fields, moves)


def fitted_kernels(fits: DataFrame, combo: Sequence[str], model: str, res: float, n: int) -> DataFrame:
    """(combo, dy, dx, w): the kernels of all states' parameters."""
    params = fits.groupBy(*combo).agg(*[F.max(F.when(F.col("param") == p, F.col("value"))).alias(p) for p in BOUNDS[model]])
    return kernels(params, list(combo), model, res, n).select(*combo, "dy", "dx", "w")
