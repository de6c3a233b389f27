"""Simulated stacks: coherence models and samples drawn from them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def coherence_model(days: Column, gamma0: float = 0.99, gamma_inf: float = 0.3, tau: float = 72.0, seasonal: float = 0.0) -> Column:
    """Exponential decay with the days apart toward gamma_inf, optionally with a yearly cycle."""
    decay = F.lit(gamma0 - gamma_inf) * F.exp(-F.abs(days) / tau) + F.lit(gamma_inf)
    return decay * (1 - F.lit(seasonal) * (1 - F.cos(F.lit(2 * np.pi) * days / 365.25)) / 2) if seasonal else decay


def coherence_matrix(n: int, step: float = 12.0, gamma0: float = 0.99, gamma_inf: float = 0.3, tau: float = 72.0, phases: np.ndarray | None = None) -> np.ndarray:
    apart = step * np.abs(np.subtract.outer(np.arange(n), np.arange(n)))
    c = (gamma0 - gamma_inf) * np.exp(-apart / tau) + gamma_inf
    np.fill_diagonal(c, 1)
    turn = np.exp(1j * (np.zeros(n) if phases is None else phases))
    return c * np.outer(turn, turn.conj())


def samples(c: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """dates x n circular Gaussian samples with covariance c."""
    values, vectors = np.linalg.eigh(c)
    root = vectors * np.sqrt(np.maximum(values, 0))
    draw = np.random.default_rng(seed)
    return root @ ((draw.standard_normal((len(c), n)) + 1j * draw.standard_normal((len(c), n))) / np.sqrt(2))


def stack(spark: SparkSession, shape: tuple[int, int], c: np.ndarray, scenes: int = 1, seed: int = 0) -> DataFrame:
    """scene, t, row, col, re, im of correlated samples; a row of a scene is a task's unit, seeded by its place."""
    rows, cols = shape

    def run(frames):
        import pandas as pd

        for frame in frames:
            for k in frame["id"]:
                z = samples(c, cols, seed + int(k))
                t, col = np.indices(z.shape, dtype=np.int32)
                yield pd.DataFrame({"scene": np.int32(k // rows), "t": t.ravel(), "row": np.int32(k % rows), "col": col.ravel(), "re": z.real.ravel(), "im": z.imag.ravel()})

    return spark.range(scenes * rows).mapInPandas(run, "scene int, t int, row int, col int, re double, im double")


def gaussian_deformation(rows: int, cols: int, peak: float, sigma: float, t: Column) -> Column:
    """A bowl of deformation in the middle of the grid that deepens with t."""
    d2 = (F.col("row") - rows / 2) ** 2 + (F.col("col") - cols / 2) ** 2
    return F.lit(peak) * t * F.exp(-d2 / (2 * sigma * sigma))
