"""A Bloom filter of bounded size over 64-bit hashes, merged on the executors: what of an unbounded set a scan may know."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of the filter's bits at least and at most (8 KB to 32 MB), bits for each key up to there, and probes. Beyond some 27
#: million keys more and more hashes pass by chance, which costs rows in the exact join behind it and never results.
LEAST, MOST, PER_KEY, PROBES = 16, 28, 10, 4


def _probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    x = h.view(np.uint64)
    return [(((x >> np.uint64(9 * i)) ^ (x >> np.uint64(36))) & np.uint64(bits - 1)).astype(np.int64) for i in range(PROBES)]


def build(hashes: DataFrame, column: str = "hash") -> np.ndarray:
    """The filter of a long column, as long as its keys ask for; false positives are possible, false negatives aren't."""
    bits = 1 << min(MOST, max(LEAST, (PER_KEY * hashes.count()).bit_length()))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.unique(np.concatenate(_probes(b[column].to_numpy(), bits)))
            yield pa.RecordBatch.from_arrays([pa.array(p >> 6), pa.array(np.left_shift(np.int64(1), p & 63))], names=["word", "bit"])

    out = np.zeros(bits >> 6, np.int64)
    got = hashes.select(column).mapInArrow(placed, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out


def within(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    ok = np.ones(len(h), bool)
    for p in _probes(h, len(bloom) << 6):
        ok &= (bloom[p >> 6] >> (p & 63)) & 1 == 1
    return ok
