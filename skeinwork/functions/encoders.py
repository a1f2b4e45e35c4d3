"""Encoders of texts to vectors: the place where a model plugs in.

``factory`` builds the encoder once per Python worker; it gets a list of texts and returns a matrix.
The default hashes character trigrams: deterministic, without files, for tests and baselines.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(width: int = 64) -> Callable[[], Encoder]:
    def factory() -> Encoder:
        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), width))
            for row, text in zip(out, texts):
                padded = f" {text.lower()} "
                for i in range(len(padded) - 2):
                    h = zlib.crc32(padded[i : i + 3].encode("utf-8", "replace"))
                    row[h % width] += 1 if h & 0x80000000 else -1
            length = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(length == 0, 1, length)

        return encode

    return factory


def encode_texts(df: DataFrame, key: str, text: str, factory: Callable[[], Encoder] | None = None, batch: int = 16) -> DataFrame:
    """``key, vector``: one row a row; null texts count as empty.  The model is loaded once a task."""
    make = factory or hashing_encoder()
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make()
        for frame in frames:
            texts = ["" if t is None else t for t in frame["t"]]
            parts = [encoder(texts[i : i + batch]) for i in range(0, len(texts), batch)]
            yield pd.DataFrame({key: frame["k"], "vector": list(np.concatenate(parts)) if parts else []})

    return df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInPandas(run, f"{key} {kind}, vector array<double>")
