"""Encoders: their names, sizes and fingerprints, and embedding as an Arrow batch function."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vision transformers by short name, with the length of their vectors.
VARIANTS = {"vits14": 384, "vitb14": 768, "vitl14": 1024}


def fingerprint(name: str, dim: int, probe: np.ndarray | None = None) -> str:
    """16 hex digits that change with an encoder's name, size or behaviour on a fixed probe."""
    body = {"name": name, "dim": dim, "probe": None if probe is None else np.round(np.asarray(probe, float), 4).tolist()}
    return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()[:16]


def embed(rows: DataFrame, encode: Callable[[list], np.ndarray], column: str = "content") -> DataFrame:
    """Rows with an embedding of a column; ``encode`` takes a list of values and returns a matrix, and loads its model once a task."""

    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(encode(values.tolist()), float))) if len(values) else pd.Series([], dtype=object)

    return rows.withColumn("embedding", run(column))


def backend_mixed(samples: DataFrame) -> bool:
    """Whether samples carry vectors of more than one encoder fingerprint."""
    return samples.where("encoder is not null").select("encoder").distinct().limit(2).count() > 1
