"""Approximate nearest neighbours by cross-polytope hashing.

A table's hash is a pseudo-rotation (three rounds of random signs and a Hadamard transform) and the signed axis nearest to
the rotated unit vector. A query looks into the ``probes`` buckets of its nearest axes in each of ``tables`` tables, and
what it finds there is ranked by the exact distance of the original vectors in double precision.

Vectors and queries meet by bucket, in one shuffle of the vectors for each table. Buckets are cut into blocks of at most
about BLOCK vectors and QUERIES queries by their counts, so a dense region is many tasks; a block gives each of its
queries its nearest ``k`` there, which loses nothing of the k nearest found. Of equal vectors only the k + 1 with the
smallest ids can be in a result, so only those are indexed: an exact reduction, made before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import keep

TABLES, PROBES, BLOCK, QUERIES = 8, 16, 2048, 1024


def _signs(dimension: int, table: int) -> np.ndarray:
    return np.random.default_rng([dimension, table]).choice([-1.0, 1.0], (3, dimension))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the row length is a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        y = x.reshape(len(x), n // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        step *= 2
    return x / np.sqrt(n)


def buckets(x: np.ndarray, table: int, probes: int) -> np.ndarray:
    """Of each unit row, the ``probes`` nearest signed axes after the table's rotation, nearest first."""
    size = 1 << max(0, x.shape[1] - 1).bit_length()
    z = np.zeros((len(x), size))
    z[:, : x.shape[1]] = x
    for s in _signs(size, table):
        z = hadamard(z * s)
    both = np.stack([z, -z], 2).reshape(len(x), 2 * size)
    if probes == 1:
        return both.argmax(1)[:, None]
    probes = min(probes, 2 * size)
    near = np.argpartition(-both, probes - 1, 1)[:, :probes]
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(both, near, 1), 1, kind="stable"), 1)


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _hashed(vectors: DataFrame, tables: int, probes: int) -> DataFrame:
    """(id, vector, dimension, place), a row for each table and probe."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b["dimension"].to_numpy()
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                for low in range(0, len(at), 1000):
                    part = b.take(pa.array(at[low : low + 1000]))
                    x = _matrix(part["vector"])
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    for t in range(tables):
                        got = buckets(x, t, probes)
                        rows = np.repeat(np.arange(len(x)), got.shape[1])
                        p = part.take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays([p["id"], p["vector"], p["dimension"], pa.array(got.ravel() * tables + t, pa.int64())], names=["id", "vector", "dimension", "place"])

    return vectors.mapInArrow(hashed, f"id long, vector {vectors.schema['vector'].dataType.simpleString()}, dimension int, place long")


def _ranked(k: int):
    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block, queries first. Each batch's vectors of a block give every query its k nearest of them."""
        key, ids, queries = None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            marks = np.stack([b[c].to_numpy() for c in ("dimension", "place", "salt", "query_salt")], 1).astype(np.int64)
            asks = b["asks"].to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.append(True, (marks[1:] != marks[:-1]).any(1) | (asks[1:] != asks[:-1])))
            out: list[tuple] = []
            for low, high in zip(edge, np.append(edge[1:], len(marks)), strict=True):
                now = tuple(marks[low])
                if asks[low]:
                    new_ids, new = b["id"].slice(low, high - low).to_numpy(), _matrix(b["vector"].slice(low, high - low))
                    ids, queries = (np.append(ids, new_ids), np.concatenate([queries, new])) if key == now else (new_ids, new)
                    key = now
                    continue
                if key != now:
                    continue
                other, x = b["id"].slice(low, high - low).to_numpy(), _matrix(b["vector"].slice(low, high - low))
                about = (queries**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * queries @ x.T
                about[ids[:, None] == other[None]] = np.inf
                most = min(k, len(other)) - 1
                line = np.partition(about, most, 1)[:, most]
                # all that rounding could bring among the k nearest, then exactly
                i, j = np.nonzero((about <= line[:, None] + 1e-9 * (1 + np.abs(line[:, None]))) & np.isfinite(about))
                exact = np.sqrt(((queries[i] - x[j]) ** 2).sum(1))
                order = np.lexsort((other[j], exact, i))
                i, j, exact = i[order], j[order], exact[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                m = place < k
                out.append((ids[i[m]], other[j[m]], exact[m]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out])) for c in range(3)], names=["query_id", "vec_id", "score"])

    return ranked


def _found(vectors: DataFrame, queries: DataFrame, k: int, tables: int, probes: int) -> DataFrame:
    """(query_id, vec_id, score) of what the queries meet in their buckets, the nearest ``k`` of each block."""
    first = Window.partitionBy("vector").orderBy("id")
    indexed = keep(_hashed(vectors.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).drop("r"), tables, 1))
    asked = keep(_hashed(queries, tables, probes))
    sizes = indexed.groupBy("dimension", "place").agg(F.ceil(F.count("*") / BLOCK).alias("salts")).join(asked.groupBy("dimension", "place").agg(F.ceil(F.count("*") / QUERIES).alias("query_salts")), ["dimension", "place"])
    zero = F.lit(0).cast("long")
    left = indexed.join(sizes, ["dimension", "place"]).select("id", "vector", "dimension", "place", F.pmod(F.xxhash64("id"), F.col("salts")).alias("salt"), F.explode(F.sequence(zero, F.col("query_salts") - 1)).alias("query_salt"), F.lit(False).alias("asks"))
    right = asked.join(sizes, ["dimension", "place"]).select("id", "vector", "dimension", "place", F.explode(F.sequence(zero, F.col("salts") - 1)).alias("salt"), F.pmod(F.xxhash64("id"), F.col("query_salts")).alias("query_salt"), F.lit(True).alias("asks"))
    blocks = left.unionByName(right).repartition("dimension", "place", "salt", "query_salt").sortWithinPartitions("dimension", "place", "salt", "query_salt", F.desc("asks"))
    return blocks.mapInArrow(_ranked(k), "query_id long, vec_id long, score double")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found, by Euclidean distance and then the smaller vec_id.

    vectors, queries: (vec_id, embedding), of any numeric type; distances are those of the values in double precision. A query
    isn't its own neighbour. Vectors that are null, empty, zero or hold a null or non-finite component take no part; of two
    dimensions, neither finds the other. A query that finds fewer than k in its buckets is asked again in all of them, so
    it gets k, or all candidates. vec_id is taken to be a key; extra columns are ignored; no queries or no vectors give
    no rows.
    """
    single = all(df.schema["embedding"].dataType.simpleString() == "array<float>" for df in (vectors, queries))

    def clean(df: DataFrame) -> DataFrame:
        v = df.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("vector"))
        ok = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
        return v.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).where(ok).withColumn("dimension", F.size("vector"))

    index, asked = clean(vectors), clean(queries)
    found = keep(_found(index, asked, k, tables, probes).groupBy("query_id", "vec_id").agg(F.min("score").alias("score")))
    enough = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    short = keep(asked.join(enough, F.col("id") == F.col("query_id"), "left_anti"))
    if not short.isEmpty():
        found = found.unionByName(_found(index, short, k, 1, 1 << 30)).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
