"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import SparkSession

from lineora.functions.tables import cut, fresh_path, shared_dir

__all__ = ["WORD", "WordHash", "cut", "fresh_path", "mixed", "shared_dir", "small_batches", "word_hashes"]

#: Rows of a batch that goes to Python: texts are long.
BATCH_ROWS = 1000

#: ASCII white space and nothing else: space, \t, \n, \v, \f, \r.
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession) -> None:
    """Batches of texts that fit a worker's memory several times over, unless the session asks for smaller ones."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


class WordHash(dict):
    """bytes -> 64-bit xxh3 value, remembered up to a bound."""

    BOUND = 1 << 17

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_hashes(words: list[bytes], known: WordHash) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser for 64-bit values, so that every bit of a polynomial hash is usable."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))
