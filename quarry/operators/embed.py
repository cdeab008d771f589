"""The embedder slot: what turns texts into vectors, and the embedder that is always there.

An embedder has a name and a width, to which an index is bound (:mod:`quarry.operators.vectors`). ``HashedTerms`` hashes terms into signed places of a vector of
fixed width: a term of count n adds one plus the logarithm of n, and the sum is scaled to length one. It knows no vocabulary, is the same in every run and
works on Arrow batches. A hosted model fills the slot by another class with ``name``, ``width`` and ``of``.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import terms


class Embedder(Protocol):
    name: str
    width: int

    def embedded(self, rows: DataFrame, text: str = "text", out: str = "embedding") -> DataFrame:
        """``rows`` with the vector of each text, ``array<float>``; of a text without one it is null, and the row is no row of a vector index."""


class _Places(dict):
    """Place and sign of a term: by the first eight and the ninth digit of its MD5."""

    def __init__(self, width: int, most: int = 500_000) -> None:
        self.width, self.most = width, most

    def __missing__(self, term: str) -> tuple[int, float]:
        digits = hashlib.md5(term.encode(), usedforsecurity=False).hexdigest()
        if len(self) >= self.most:
            self.clear()
        self[term] = found = int(digits[:8], 16) % self.width, 1.0 - 2.0 * (int(digits[8], 16) % 2)
        return found


@dataclass(frozen=True)
class HashedTerms:
    width: int = 256

    @property
    def name(self) -> str:
        return f"hashed-terms-{self.width}"

    def embedded(self, rows: DataFrame, text: str = "text", out: str = "embedding") -> DataFrame:
        width = self.width

        def run(batches):
            places = _Places(width)
            for b in batches:
                vectors = []
                for cut in b.column(b.num_columns - 1):
                    v = np.zeros(width)
                    for term, n in Counter(cut.as_py()).items():
                        at, sign = places[term]
                        v[at] += sign * (1.0 + math.log(n))
                    size = math.sqrt(float(v @ v))
                    vectors.append((v / size).astype(np.float32) if size > 0 else None)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(vectors, pa.list_(pa.float32()))], names)

        kept = rows.drop(out)
        names = [*kept.columns, out]
        kinds = T.StructType([*kept.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])
        return kept.select("*", terms(F.col(text)).alias("_cut")).mapInArrow(run, kinds)
