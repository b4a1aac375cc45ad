"""Keyed simulation: AR(1) nulls and parametric bootstraps, one task a chunk, the seed in the chunk's key."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def seed(*key) -> int:
    return int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:8], 16)


def ar1(rng: np.random.Generator, rows: int, n: int, rho: float, sd: float = 1.0) -> np.ndarray:
    """rows x n stationary series of marginal deviation sd."""
    out = np.empty((rows, n))
    out[:, 0] = rng.normal(0, sd, rows)
    noise = rng.normal(0, sd * np.sqrt(1 - rho * rho), (rows, n - 1))
    for k in range(1, n):
        out[:, k] = rho * out[:, k - 1] + noise[:, k - 1]
    return out


def supf(y: np.ndarray, margin: int) -> tuple[np.ndarray, np.ndarray]:
    """(largest F of the hinge candidates, its place) of each row."""
    n = y.shape[1]
    t = np.arange(n, dtype=float)
    q, _ = np.linalg.qr(np.stack([np.ones(n), t], axis=1))
    rest = y - (y @ q) @ q.T
    sse0 = (rest**2).sum(axis=1)
    taus = np.arange(margin - 1, n - margin)
    h = np.maximum(0.0, t[None, :] - taus[:, None])
    h = h - (h @ q) @ q.T
    drop = (rest @ h.T) ** 2 / (h**2).sum(axis=1)
    best = drop.argmax(axis=1)
    top = drop[np.arange(len(y)), best]
    return (n - 3) * top / np.maximum(sse0 - top, 1e-300), taus[best]


def supf_null(spark: SparkSession, draws: int, n: int, margin: int, rho: float, master: int = 1, chunk: int = 500) -> DataFrame:
    """draw, stat: the null distribution, the same for any number of tasks."""
    chunks = -(-draws // chunk)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in b["id"]:
                rows = min(chunk, draws - k * chunk)
                f, _ = supf(ar1(np.random.default_rng(seed(master, "null", k)), rows, n, rho), margin)
                yield pd.DataFrame({"draw": np.arange(k * chunk, k * chunk + rows), "stat": f})

    return spark.range(chunks).repartition(max(1, min(chunks, 64))).mapInPandas(run, "draw long, stat double")


def pixel_bootstrap(packed: DataFrame, reps: int, margin: int, rho: float, cutoff: float, master: int = 1) -> DataFrame:
    """cell, detected, tau_low, tau_mid, tau_high from AR(1) resamples around each cell's own fit. packed: cell, s."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for cell, s in zip(b["cell"], b["s"], strict=True):
                v = np.array([p["v"] for p in s])
                if len(v) < 2 * margin + 1:
                    continue
                t = np.arange(len(v), dtype=float)
                _, tau = supf(v[None, :], margin)
                x = np.stack([np.ones(len(v)), t, np.maximum(0, t - tau[0])], axis=1)
                fit = x @ np.linalg.lstsq(x, v, rcond=None)[0]
                sd = max(float(np.std(v - fit)), 1e-12)
                f, taus = supf(fit + ar1(np.random.default_rng(seed(master, "pixel", cell)), reps, len(v), rho, sd), margin)
                lo, mid, hi = np.quantile(taus, [0.025, 0.5, 0.975], method="inverted_cdf")
                out.append((cell, float((f >= cutoff).mean()), int(lo), int(mid), int(hi)))
            yield pd.DataFrame(out, columns=["cell", "detected", "tau_low", "tau_mid", "tau_high"])

    return packed.select("cell", "s").mapInPandas(run, "cell int, detected double, tau_low int, tau_mid int, tau_high int")


def poisson(key: np.ndarray, rep: int, master: int) -> np.ndarray:
    """Poisson(1) weights that depend on (master, rep, key) alone."""
    z = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed(master, "obs", rep) * 0xD1342543DE82EF95 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    u = (z ^ (z >> np.uint64(31))) / 2.0**64
    return np.searchsorted(np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 20)])), u, side="right").astype(float)


def observation_bootstrap(rows: DataFrame, key: str, y: str, predictions: list[str], reps: int = 2000, master: int = 1) -> DataFrame:
    """rep and the weighted sums n, sy, syy, e_<prediction> (squared errors) over all rows; rep 0 has every row once.

    Rows with a null or a value that is not finite are left out. Sums alone cross the shuffle; they are taken
    around the mean of y, so that they stay exact.
    """
    good = [F.col(c).cast("double").alias(c) for c in (y, *predictions)]
    held = rows.select(F.col(key).cast("long").alias("key"), *good).dropna()
    for c in (y, *predictions):
        held = held.filter(~F.isnan(c) & (F.abs(c) < float("inf")))
    centre = held.agg(F.avg(y)).first()[0] or 0.0
    names = ["n", "sy", "syy", *[f"e_{p}" for p in predictions]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((reps + 1, len(names)))
        for b in batches:
            v = b[y].to_numpy() - centre
            x = np.stack([np.ones(len(b)), v, v * v, *[(b[y] - b[p]).to_numpy() ** 2 for p in predictions]], axis=1)
            keys = b["key"].to_numpy()
            total[0] += x.sum(axis=0)
            for rep in range(1, reps + 1):
                total[rep] += poisson(keys, rep, master) @ x
        yield pd.DataFrame(total, columns=names).assign(rep=np.arange(reps + 1))[["rep", *names]]

    parts = held.mapInPandas(run, "rep long, " + ", ".join(f"{n} double" for n in names))
    return parts.groupBy("rep").agg(*[F.sum(n).alias(n) for n in names])
