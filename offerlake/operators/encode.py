"""Text -> vector on the executors (``mapInPandas``), with a pluggable encoder.

The encoder is built once per Python worker and applied to Arrow batches, so encoding scales with the
cluster instead of running on the driver. The default ``HashEncoder`` is a deterministic signed-hash
bag of words (L2-normalised), stated by digits of the word's md5 so that SQL can state it too; a
sentence-embedding model can be plugged in through ``encoder_factory`` when one is installed (none is
in this environment, so relevance quality is not claimed).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake.session import ship_by_value

# The functions of this module that run in Python workers travel with the task (no install on executors).
ship_by_value(__name__)

_ENCODERS: dict = {}


class HashEncoder:
    """Signed feature hashing of lower-cased words into ``dim`` buckets, then L2 normalisation.

    The first eight hexadecimal digits of a word's md5, modulo ``dim``, name its bucket; the ninth gives its
    sign (8 and above: minus). Sums are whole numbers, so neither order nor batching changes a vector."""

    def __init__(self, dim: int = 384):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        words = [re.findall(r"\w+", (t or "").lower()) for t in texts]
        rows = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        of_word, distinct = pd.factorize(np.array([w for ws in words for w in ws], dtype=object))
        digits = [hashlib.md5(w.encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()[:9] for w in distinct]
        bucket = np.array([int(d[:8], 16) % self.dim for d in digits], dtype=np.int64)
        sign = np.array([-1.0 if d[8] >= "8" else 1.0 for d in digits])
        cells = np.bincount(rows * self.dim + bucket[of_word], weights=sign[of_word], minlength=len(texts) * self.dim) \
            if len(of_word) else np.zeros(len(texts) * self.dim)
        out = cells.reshape(len(texts), self.dim)
        norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return (out / np.where(norms == 0, 1.0, norms)).astype(np.float32)


def _encoder(factory: Callable[[], object], key: str):
    enc = _ENCODERS.get(key)
    if enc is None:
        enc = factory()
        _ENCODERS[key] = enc
    return enc


def encode(df: DataFrame, key: str, text_col: str, dim: int = 384,
           encoder_factory: Callable[[], object] | None = None, batch_size: int = 256,
           vector_col: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(key, embedding array<float>)`` and the columns ``keep`` for every row of ``df``, from its whole text (null: empty)."""
    factory = encoder_factory or (lambda: HashEncoder(dim))
    cache_key = f"{id(factory)}:{dim}"
    key_type = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, key_type), T.StructField(vector_col, T.ArrayType(T.FloatType())), *[df.schema[c] for c in keep]])
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = df.select(F.col(key), *keep, text.alias("_text"))

    def run(batches):
        enc = _encoder(factory, cache_key)
        for pdf in batches:
            for s in range(0, len(pdf), batch_size):
                part = pdf.iloc[s:s + batch_size]
                vecs = enc.encode(part["_text"].tolist())
                yield pd.DataFrame({key: part[key].to_numpy(), vector_col: list(vecs.astype(np.float32)), **{c: part[c].to_numpy() for c in keep}})

    return src.mapInPandas(run, schema)
