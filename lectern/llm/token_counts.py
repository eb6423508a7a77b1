"""Token counts of flat, unindexed token files by a separator scan.

A token file is ids of fixed width and nothing else; a document ends with the end-of-document id. Files are cut into
blocks anywhere. Each block is searched for the id by one vectorised comparison; what spans blocks is stitched by a
prefix scan over (tokens, separators, last separator) of the blocks before, which are three numbers a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import keep, small_batches
from .tokenizer import encode, public

BLOCK_TOKENS = 1 << 16


def blocks(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, data) of the token files at ``path``, which may be anywhere Spark reads. A file is one row of the
    binary source first, so files should be some 100 MB each; bytes past the last whole id are left out."""
    step = block_tokens * width
    whole = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content", (F.col("length") - F.col("length") % width).alias("size")).where("size > 0")
    return whole.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / step)))).select(
        "file", "block", F.expr(f"substring(content, cast(block * {step} + 1 as int), cast(least({step}, size - block * {step}) as int))").alias("data")
    )


def flat(docs: DataFrame, ranks: str | None = None, vocabulary: str | None = None, end_id: int = 50256, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, data, doc_ids): the documents of each partition as one token file of 16-bit ids, in blocks. doc_ids are those whose end is in the block."""
    ranks, vocabulary = ranks or public("byte_bpe_50k.tiktoken"), vocabulary or public("byte_bpe_50k.json")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        file, number, held, size, ended = context.partitionId() if context else 0, 0, [], 0, []

        def batch(data: np.ndarray, ids: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([number], pa.int64()), pa.array([data.astype("<u2").tobytes()], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], names=["file", "block", "data", "doc_ids"])

        for b in batches:
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                held.append(np.append(encode(ranks, vocabulary, text.as_py() or ""), np.uint32(end_id)))
                size += len(held[-1])
                ended.append((size, doc.as_py()))
                if size >= block_tokens:
                    stream = np.concatenate(held)
                    low = 0
                    while size - low >= block_tokens:
                        high = low + block_tokens
                        yield batch(stream[low:high], [d for e, d in ended if low < e <= high])
                        number, low = number + 1, high
                    held, ended = [stream[low:]], [(e - low, d) for e, d in ended if e > low]
                    size -= low
        if size:
            yield batch(np.concatenate(held), [d for _, d in ended])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(written, "file long, block long, data binary, doc_ids array<long>")


def counts(parts: DataFrame, end_id: int = 50256, width: int = 2) -> DataFrame:
    """One row per document of token files: file, ordinal (in the file, from 0), start (its first id's place), n_tokens
    (without the end), ended; further columns of ``parts`` that are arrays with an item for each end, as doc_ids, give that item.

    parts: (file, block, data). Ids after a file's last end are one more document, with ended false. Empty files give
    none; null data counts as an empty block. (file, block) is taken to be a key.
    """
    items = [c for c in parts.columns if c not in ("file", "block", "data")]
    kind = {2: "<u2", 4: "<u4"}[width]
    found = parts.select("file", "block", *items, "data")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, ends = [], []
            for x in b["data"]:
                ids = np.frombuffer(x.as_buffer() if x.is_valid else b"", kind)
                size.append(len(ids))
                ends.append(np.flatnonzero(ids == end_id))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("file", "block", *items)), pa.array(size, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], names=["file", "block", *items, "size", "ends"])

    types = dict(found.dtypes)
    # ids are read once; what is kept of them is a number for each end
    scanned = keep(found.mapInArrow(searched, ", ".join(f"{c} {types[c]}" for c in ("file", "block", *items)) + ", size long, ends array<long>"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    numbers = scanned.select("file", "block", "size", F.size("ends").alias("n"), F.expr("try_element_at(ends, -1)").alias("end"))
    placed = numbers.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("last", F.col("base") + F.col("end"))
    placed = placed.withColumn("open", F.coalesce(F.max("last").over(before), F.lit(-1)) + 1).withColumn("seen", F.coalesce(F.sum("n").over(before), F.lit(0)))
    each = scanned.where(F.size("ends") > 0).join(placed.where("n > 0").select("file", "block", "base", "open", "seen"), ["file", "block"])
    each = each.select("file", "base", "open", "seen", "ends", *items, F.posexplode("ends").alias("at", "end"))
    begin = F.when(F.col("at") == 0, F.col("open")).otherwise(F.col("base") + F.expr("element_at(ends, at)") + 1)
    done = each.withColumn("start", begin).select("file", (F.col("seen") + F.col("at")).alias("ordinal"), "start", (F.col("base") + F.col("end") - F.col("start")).alias("n_tokens"), F.lit(True).alias("ended"), *(F.expr(f"get({c}, at)").alias(c) for c in items))
    tail = placed.groupBy("file").agg(F.sum("size").alias("size"), F.max("last").alias("last"), F.sum("n").alias("ordinal")).withColumn("start", F.coalesce(F.col("last") + 1, F.lit(0))).where("size > start")
    return done.unionByName(tail.select("file", "ordinal", "start", (F.col("size") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended")), allowMissingColumns=True)


def document_counts(docs: DataFrame) -> DataFrame:
    """doc_id, file, ordinal, start, n_tokens, of the documents written as flat token files, one row per row of ``docs``.

    Null and empty texts have no tokens; rows with null or repeated doc_ids are documents of their own; extra columns are
    ignored; no rows give no rows."""
    return counts(flat(docs)).select(F.col("doc_ids").alias("doc_id"), "file", "ordinal", "start", "n_tokens")
