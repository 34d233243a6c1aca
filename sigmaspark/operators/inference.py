"""Batch inference: the model is the caller's, loaded once per worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .routing import normalize_query
from .vectors import l2_normalize

Model = Callable[[np.ndarray], np.ndarray]


def encode(rows: DataFrame, load: Callable[[], Model], key: str, values: str, dimension: int) -> DataFrame:
    """key and unit-length embedding of every row's numbers; another size than ``dimension`` is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            if len(batch):
                out = np.asarray(model(np.stack(batch[values].to_list()).astype(np.float32)), np.float64)
                if out.shape[1] != dimension:
                    raise ValueError(f"embeddings of {out.shape[1]} numbers, not {dimension}")
                yield pd.DataFrame({key: batch[key], "embedding": list(out)})

    kind = dict(rows.dtypes)[key]
    return rows.select(key, values).mapInPandas(run, f"{key} {kind}, embedding array<double>").withColumn("embedding", l2_normalize(F.col("embedding")))


def encode_texts(rows: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], text: str, dimension: int) -> DataFrame:
    """Rows with the unit-length embedding of their text; texts that are equal once normalised are encoded once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            if len(batch):
                out = np.asarray(model(batch["normal"].to_list()), np.float64)
                if out.shape[1] != dimension:
                    raise ValueError(f"embeddings of {out.shape[1]} numbers, not {dimension}")
                yield pd.DataFrame({"normal": batch["normal"], "embedding": list(out)})

    keyed = rows.withColumn("normal", normalize_query(F.col(text)))
    known = keyed.select("normal").distinct().mapInPandas(run, "normal string, embedding array<double>")
    return keyed.join(known.withColumn("embedding", l2_normalize(F.col("embedding"))), "normal").drop("normal")


def score_windows(rows: DataFrame, load: Callable[[], Model], key: str, values: str) -> DataFrame:
    """key and class scores between 0 and 1 of every window."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            if len(batch):
                logits = np.asarray(model(np.stack(batch[values].to_list()).astype(np.float32)), np.float64)
                yield pd.DataFrame({key: batch[key], "scores": list(1 / (1 + np.exp(-logits)))})

    return rows.select(key, values).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, scores array<double>")
