"""Shared pieces for embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMS = 64


def usable(column: str, dims: int = DIMS) -> Column:
    """dims numbers, none null or NaN or infinite, not all zero."""
    c = F.col(column)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(c) == dims) & ~bad & F.exists(c, lambda x: x != 0), F.lit(False))


def matrix(series: pd.Series) -> np.ndarray:
    """A series of equal-length arrays as one matrix."""
    return np.stack(series.to_numpy()) if len(series) else np.zeros((0, DIMS))


def unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)  # so that tiny or huge numbers do not under- or overflow
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        pairs = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


def pseudo_rotation(x: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of random signs and a Hadamard transform; pads to a power of two."""
    width = 1 << max(0, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], size=(3, width))
    for s in signs:
        x = hadamard(x * s)
    return x
