"""Logistic regressions of many keys at once: one aggregate of gradients and Gram matrices per Newton pass."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAR = 30.0          # a score beyond this is as good as certain; separable keys end there


def design(batch: pa.RecordBatch, features: int) -> np.ndarray:
    """Features behind a column of ones."""
    return np.column_stack([np.ones(batch.num_rows), *[batch.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(features)]])


def fit_keyed(rows: DataFrame, features: Sequence[str], keys: int, *, ridge: float = 1e-8, tol: float = 1e-10, most: int = 60) -> tuple[np.ndarray, list[str | None]]:
    """Coefficients (keys x 1 + features), intercept first, and why a key has none (else null).

    rows: k (0 to keys - 1), the features, y in {0, 1}, w. Every pass sums, per key, the
    gradient and the Gram matrix in the tasks and then over them; keys * d * (d + 3) / 2
    numbers come to the driver, which takes all Newton steps, halved where a step would be
    too far. A key is done when its step is below ``tol``, its gradient before the step was below
    1e-9 of its weight, or its coefficients are beyond FAR; keys that are done leave the
    passes.
    """
    d, n = len(features) + 1, len(features)
    upper = np.triu_indices(d)
    beta, problem, open_ = np.zeros((keys, d)), [None] * keys, np.ones(keys, bool)
    packed = rows.groupBy("k", *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], F.col("y").cast("double").alias("y")).agg(
        F.sum("w").cast("double").alias("w"))
    seen = {r["k"]: (r["a"], r["b"]) for r in packed.groupBy("k").agg(F.sum(F.col("w") * (1 - F.col("y"))).alias("a"), F.sum(F.col("w") * F.col("y")).alias("b")).collect()}
    for k in range(keys):
        if min(seen.get(k, (0, 0))) <= 0:
            problem[k], open_[k] = "one class" if k in seen else "no rows", False

    for _ in range(most):
        if not open_.any():
            break

        def part(batches: Iterator[pa.RecordBatch], beta=beta.copy(), open_=open_.copy()):
            out = np.zeros((keys, d + len(upper[0])))
            for batch in batches:
                key = batch.column("k").to_numpy()
                use = np.flatnonzero(open_[key])
                x, key = design(batch, n)[use], key[use]
                y, w = batch.column("y").to_numpy()[use], batch.column("w").to_numpy()[use]
                p = 1.0 / (1.0 + np.exp(-np.clip((x * beta[key]).sum(axis=1), -2 * FAR, 2 * FAR)))
                np.add.at(out, key, np.hstack([(w * (p - y))[:, None] * x, (w * p * (1 - p))[:, None] * x[:, upper[0]] * x[:, upper[1]]]))
            at = np.flatnonzero(out.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(at, out.shape[1]).astype(np.int32)), pa.array(np.tile(np.arange(out.shape[1], dtype=np.int32), len(at))),
                                              pa.array(out[at].ravel())], ["k", "pos", "v"])
        sums = np.zeros((keys, d + len(upper[0])))
        for r in packed.mapInArrow(part, "k int, pos int, v double").groupBy("k", "pos").agg(F.sum("v").alias("v")).collect():
            sums[r["k"], r["pos"]] = r["v"]
        for k in np.flatnonzero(open_):
            gram = np.zeros((d, d))
            gram[upper] = sums[k, d:]
            gram += np.triu(gram, 1).T
            slope = sums[k, :d] + ridge * beta[k]
            step = np.linalg.solve(gram + ridge * np.eye(d), slope)
            step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-300))
            beta[k] -= step
            open_[k] = np.abs(step).max() > tol and np.abs(slope).max() > 1e-9 * sum(seen[k]) and np.abs(beta[k]).max() < FAR
    for k in np.flatnonzero(open_):
        problem[k] = f"no convergence in {most} passes"
    return beta, problem


def scores(beta: np.ndarray, features: Sequence[str]) -> Column:
    """An array column: the probability under every key's coefficients."""
    held = beta.copy()

    @F.pandas_udf("array<double>")
    def score(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([np.ones(len(columns[0])), *[c.to_numpy(float) for c in columns]])
        return pd.Series(list(1.0 / (1.0 + np.exp(-np.clip(x @ held.T, -2 * FAR, 2 * FAR)))))
    return score(*[F.col(f).cast("double") for f in features])
