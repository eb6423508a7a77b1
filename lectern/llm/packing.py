"""Order-preserving sequence packing by dynamic programming with a monotone queue.

The documents of a partition, in their order, are one stream of ids. A plan cuts the stream into windows of at most
``size`` ids. Cuts may fall at the end of a document (free), at the end of a sentence (``sentence_cost``) or, inside a
long sentence, at every ``grid`` ids (``inner_cost``). The plan has the least padding plus truncation costs:

    best(j) = cost(j) + min over i with j - i <= size of best(i) + size - (j - i)

whose minimum slides monotonically, so each candidate enters and leaves one queue once. Streams are planned in blocks of
``block`` ids; the last windows of a block are planned again with the next one, so a task's memory is bounded by a block
or one document, and a task leaves one short window at most.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches
from .tokenizer import encode, public, sentence_ends

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def candidates(ends: np.ndarray, documents: np.ndarray, grid: int, sentence_cost: float, inner_cost: float) -> tuple[np.ndarray, np.ndarray]:
    """(position, cost) of the places to cut, ascending, from 0 to the stream's end.

    ends: for each id, whether a sentence ends with it. documents: positions after the documents' last ids.
    """
    n = len(ends)
    cost = np.full(n + 1, np.inf)
    cost[1:][ends] = sentence_cost
    cost[documents] = 0
    cost[0] = cost[n] = 0
    at = np.flatnonzero(np.isfinite(cost))
    gap = np.diff(at)
    wide = np.flatnonzero(gap > grid)
    if len(wide):
        count = (gap[wide] - 1) // grid
        first = np.repeat(at[wide], count)
        step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + 1
        inner = first + step * grid
        cost[inner] = inner_cost
        at = np.flatnonzero(np.isfinite(cost))
    return at, cost[at]


def plan(at: np.ndarray, cost: np.ndarray, size: int) -> list[int]:
    """The chosen cuts, ascending, without 0 and with the last position. at ascends from 0 by steps of ``size`` at most."""
    where, price, n = at.tolist(), cost.tolist(), len(at)
    queue, keys, head = [0], [0.0], 0  # candidates i with rising best(i) + position(i)
    back = [0] * n
    for j in range(1, n):
        x = where[j]
        low = x - size
        while where[queue[head]] < low:
            head += 1
        back[j] = queue[head]
        key = keys[head] + size + price[j]  # best(j) + x: x cancels
        while len(keys) > head and keys[-1] >= key:
            keys.pop()
            queue.pop()
        keys.append(key)
        queue.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(where[j])
        j = back[j]
    return cuts[::-1]


class _Stream:
    """Ids of consecutive documents, cut into windows as they come."""

    def __init__(self, first_sequence: int, size: int, block: int, ends: np.ndarray, costs: tuple[int, float, float]):
        self.sequence, self.size, self.block, self.ends, self.costs = first_sequence, size, block, ends, costs
        self.docs: list[list] = []  # [doc_id, ids, first id that isn't placed yet]
        self.held = 0

    def add(self, doc_id: int, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append([doc_id, ids, 0])
        self.held += len(ids)
        if self.held >= self.block:
            yield from self.flush(False)

    def flush(self, final: bool) -> Iterator[tuple]:
        if not self.docs:
            return
        left = [ids[a:] for _, ids, a in self.docs]
        stream, past = np.concatenate(left), np.cumsum([len(x) for x in left])
        ends = self.ends[stream]
        grid, sentence, inner = self.costs
        cuts = plan(*candidates(ends, past, grid, sentence, inner), self.size)
        if not final:
            cuts = cuts[: max(1, len(cuts) - 8)]
        k, low = 0, 0
        for high in cuts:
            at = low
            while at < high:
                doc, ids, a = self.docs[k]
                take = min(high - at, len(ids) - a)
                yield doc, a, take, zlib.crc32(np.ascontiguousarray(ids[a : a + take], "<u4")), len(ids), self.sequence, at - low
                at += take
                self.docs[k][2] = a + take
                if a + take == len(ids):
                    k += 1
            self.sequence += 1
            low = high
        self.docs, self.held = self.docs[k:], self.held - low


def pack(docs: DataFrame, size: int = 1024, ranks: str | None = None, vocabulary: str | None = None, end_id: int = 0, grid: int = 16, sentence_cost: float = 1.0, inner_cost: float = 3.0, block: int = 1 << 20) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ranks, vocabulary: one byte-level BPE in its two public file forms. A document's ids are those of its text (null:
    empty) and then ``end_id``, so every document has a piece. Order is that of the rows in each input partition; no
    shuffle is made, and a sequence never spans partitions. sequence_id: partition * 2**40 + number, so it is stable when
    a lost task runs again. Rows with null or repeated doc_ids are documents of their own; extra columns are ignored; no
    rows give no rows.
    """
    ranks, vocabulary = ranks or public("byte_bpe_50k.tiktoken"), vocabulary or public("byte_bpe_50k.json")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        stream = _Stream((context.partitionId() if context else 0) << 40, size, block, sentence_ends(ranks), (grid, sentence_cost, inner_cost))
        tail = np.array([end_id], np.uint32)
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 7
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for b in batches:
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                out.extend(stream.add(doc.as_py(), np.concatenate([encode(ranks, vocabulary, text.as_py() or ""), tail])))
                if len(out) >= 20_000:
                    yield batch()
        out.extend(stream.flush(True))
        yield batch()

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(packed, SCHEMA)
