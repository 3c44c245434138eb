"""Nyström features of an rbf kernel: projections on landmark rows, with the error they leave measured.

Landmarks are distinct rows drawn by a seeded hash of their values, a bounded number; the kernel among them is
decomposed on the driver (landmarks x landmarks) and each row's kernel values against them are projected as one
matrix product a batch.  Inner products of the features equal the kernel exactly between landmarks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .table import matrix

LANDMARKS = 128
#: Eigenvalues below this share of the greatest are left out.
LEAST_EIGENVALUE = 1e-10


def drawn(df: DataFrame, features: str, m: int, seed: int = 0) -> np.ndarray:
    """At most ``m`` distinct feature rows, those of least seeded hash: the same rows on any partitioning.

    Only rows below a hash bound are grouped; the bound grows until enough distinct rows lie below it.
    """
    x = df.select(vector_to_array(features).alias("x")).withColumn("h", F.xxhash64("x", F.lit(seed)))
    n = df.count()
    share = min(1.0, 8 * m / max(n, 1))
    while True:
        some = x if share >= 1 else x.where(F.col("h") < F.lit(int((2 * share - 1) * (1 << 63))))
        rows = some.groupBy("h").agg(F.any_value("x").alias("x")).orderBy("h").limit(m).collect()
        if len(rows) == m or share >= 1:
            return np.array([r["x"] for r in rows], float).reshape(len(rows), -1)
        share = min(1.0, share * 8)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between rows of a and b."""
    out = a @ (-2 * b.T)
    out += (a * a).sum(axis=1)[:, None]
    out += (b * b).sum(axis=1)
    return np.maximum(out, 0, out=out)


def rbf(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    out = distances(a, b)
    out *= -gamma
    return np.exp(out, out=out)


@dataclass
class Nystrom:
    landmarks: np.ndarray
    weights: np.ndarray
    gamma: float

    def values(self, x: np.ndarray) -> np.ndarray:
        """Kernel values of the rows of x against the landmarks."""
        return rbf(x, self.landmarks, self.gamma)

    def of(self, x: np.ndarray) -> np.ndarray:
        """Features of the rows of x."""
        return self.values(x) @ self.weights

    def transform(self, df: DataFrame, features: str, out: str) -> DataFrame:
        own = self

        @F.arrow_udf("array<double>")
        def project(x: pa.Array) -> pa.Array:
            z = own.of(matrix(x, np.float64)) if len(x) else np.zeros((0, 1))
            return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * z.shape[1], pa.int32()), pa.array(z.ravel()))

        return df.withColumn(out, array_to_vector(project(vector_to_array(features))))

    def error(self, x: np.ndarray) -> tuple[float, float]:
        """Mean and greatest difference between the features' inner products and the kernel, over pairs of rows of x."""
        z = self.of(x)
        gap = np.abs(z @ z.T - rbf(x, x, self.gamma))
        return (float(gap.mean()), float(gap.max())) if gap.size else (0.0, 0.0)


class Kernels(Transformer):
    """Pipeline stage: the features of each kernel as a column ``kernel_<name>``, made where a scan needs them."""

    def __init__(self, kernels: dict[str, Nystrom], features: str):
        super().__init__()
        self.kernels, self.features = kernels, features

    def _transform(self, df: DataFrame) -> DataFrame:
        for name, kernel in self.kernels.items():
            df = kernel.transform(df, self.features, f"kernel_{name}")
        return df


def fit(df: DataFrame, features: str, gamma: float, m: int = LANDMARKS, seed: int = 0) -> Nystrom:
    return of_landmarks(drawn(df, features, m, seed), gamma)


def of_landmarks(x: np.ndarray, gamma: float) -> Nystrom:
    if not len(x):
        return Nystrom(np.zeros((1, 0)), np.ones((1, 1)), gamma)
    value, vector = np.linalg.eigh(rbf(x, x, gamma))
    keep = value > LEAST_EIGENVALUE * value[-1]
    return Nystrom(x, vector[:, keep] / np.sqrt(value[keep]), gamma)
