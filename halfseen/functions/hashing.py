"""Seeded, engine-independent randomness: md5 of id and salt.

A split, fold or resample is a pure function of the row's own id, so it never
depends on partitioning, retries or executor loss.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from halfseen.functions.scalar import as_col

SPACE = 1 << 32


def hash32(ident, salt) -> Column:
    """Integer in [0, 2^32) from the first eight hex digits of md5(id|salt)."""
    salt = salt if isinstance(salt, Column) else F.lit(str(salt))
    text = F.concat_ws("|", as_col(ident).cast("string"), salt.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def unit_interval(ident, salt) -> Column:
    return hash32(ident, salt) / F.lit(float(SPACE))


def bucket(ident, salt, n: int) -> Column:
    return F.pmod(hash32(ident, salt), F.lit(n)).cast("int")


def poisson_steps() -> list[float]:
    """Cumulative Poisson(1) probabilities down to the resolution of the hash."""
    total, term, steps = 0.0, 0.36787944117144233, []
    while term > 1.0 / SPACE:
        total += term
        steps.append(total)
        term /= len(steps)
    return steps


def poisson1(ident, salt) -> Column:
    """Poisson(1) weight of a unit in one bootstrap replicate."""
    steps = poisson_steps()
    # the one-element array makes the hash be evaluated once
    once = F.array(unit_interval(ident, salt))
    count = lambda u: sum((F.when(u >= c, 1).otherwise(0) for c in steps), F.lit(0))
    return F.get(F.transform(once, count), F.lit(0)).cast("int")


def mix32(h: np.ndarray, step: np.ndarray | int) -> np.ndarray:
    """Further 32-bit numbers of a hash: one per step, by adding a golden-ratio multiple and mixing twice."""
    x = (h.astype(np.uint64) + np.uint64(0x9E3779B9) * np.asarray(step, np.uint64)) & np.uint64(SPACE - 1)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x = ((x ^ (x >> np.uint64(shift))) * np.uint64(factor)) & np.uint64(SPACE - 1)
    return x ^ (x >> np.uint64(16))


NORMAL_FROM = 400.0

# Coefficients of the published rational approximation of the normal quantile
# (algorithm AS 241), numerator and denominator from the constant term upwards.
CENTRE = ((3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125,
           45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
          (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077,
           21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610))
TAIL = ((1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
         1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 0.000774545014278341407640),
        (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550,
         0.148103976427480074590, 0.0151986665636164571966, 0.000547593808499534494600, 0.00000000105075007164441684324))


def _normal_ppf(u: np.ndarray) -> np.ndarray:
    """Inverse normal distribution for probabilities between 1e-10 and 1 - 1e-10."""
    ratio = lambda c, r: np.polyval(c[0][::-1], r) / np.polyval(c[1][::-1], r)
    q = u - 0.5
    near = q * ratio(CENTRE, np.maximum(0.180625 - q * q, 0.0))
    far = ratio(TAIL, np.sqrt(-np.log(np.minimum(u, 1.0 - u))) - 1.6)
    return np.where(np.abs(q) <= 0.425, near, np.copysign(far, q))


def poisson_quantile(mean: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Sum of ``mean`` Poisson(1) weights, a pure function of a draw in [0, 2^32).

    The draw is the quantile: found by summing probabilities for small means, by the
    normal quantile with its skewness term from NORMAL_FROM on.
    """
    u = (draw.astype(float) + 0.5) / SPACE
    out = np.zeros(len(mean))
    small = mean < NORMAL_FROM
    m, q = mean[small], u[small]
    term = np.exp(-m)
    total, k, drawn = term.copy(), 0, np.zeros(len(m))
    while (open_ := total < q).any() and k < 2_000:
        k += 1
        drawn[open_] = k
        term = term * m / k
        total = total + term
    out[small] = drawn
    z = _normal_ppf(u[~small])
    big = mean[~small]
    out[~small] = np.maximum(np.rint(big + np.sqrt(big) * z + (z * z - 1.0) / 6.0), 0.0)
    return out


@F.pandas_udf(DoubleType())
def poisson_draw(n: pd.Series, seed: pd.Series) -> pd.Series:
    return pd.Series(poisson_quantile(n.to_numpy(float), seed.to_numpy(np.int64)))


def replicate_weights(count: np.ndarray | None, h: np.ndarray, replicates: int) -> np.ndarray:
    """Bootstrap weights, one row per unit and one column per replicate; ``count`` packs equal units."""
    draws = mix32(h[:, None], np.arange(1, replicates + 1)[None, :])
    if count is None:
        return np.searchsorted(np.array(poisson_steps()), draws / SPACE, side="right").astype(float)
    return poisson_quantile(np.repeat(count.astype(float), replicates), draws.ravel()).reshape(draws.shape)
