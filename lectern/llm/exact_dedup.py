"""Exact dedup by composable polynomial fingerprints.

A text's fingerprint is a polynomial over its normalised bytes, modulo two primes below 2**31, and its length. Hashes of
chunks combine by length-shifted arithmetic, ``h(a + b) = h(a) * B**len(b) + h(b)``, so the chunks of one huge document
can be hashed anywhere and in any order (``combine_chunks``). Texts with equal fingerprints are compared chunk by chunk
with one text of their group; a text that differs (a collision) falls to the group of its own SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import give_back
from .shared import id_and_text, keep, one_of_each, passing, scope

#: The polynomial's two moduli and bases, and bytes to a chunk.
PRIMES = (2147483629, 2147483587)
BASES = (1103515245, 214013631)
CHUNK = 1 << 16
#: Members of a group compared in one salt of it.
SALT_ROWS = 512
SPACES = b" \t\n\x0b\x0c\r"


def _power_table(base: int, prime: int) -> np.ndarray:
    out = np.empty(CHUNK, np.uint64)
    out[0] = 1
    n = 1
    step = base % prime
    while n < CHUNK:  # doubling: out[n:2n] = out[:n] * base**n
        m = min(n, CHUNK - n)
        out[n : n + m] = out[:m] * np.uint64(step) % np.uint64(prime)
        n, step = n + m, step * step % prime
    return out


_TABLES = [_power_table(b, p) for b, p in zip(BASES, PRIMES, strict=True)]


def chunk_hash(data: bytes) -> tuple[int, int]:
    """The hashes of at most CHUNK bytes: sum of (byte + 1) * B**(bytes after it)."""
    x = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    n = len(x)
    return tuple(int(np.dot(x, t[:n][::-1])) % p for t, p in zip(_TABLES, PRIMES, strict=True))


def combine(left: tuple[int, int], right: tuple[int, int], right_bytes: int) -> tuple[int, int]:
    """The hashes of a + b from those of a and b."""
    return tuple((x * pow(b, right_bytes, p) + y) % p for x, y, b, p in zip(left, right, BASES, PRIMES, strict=True))


def fingerprint(data: bytes) -> tuple[int, int]:
    h = (0, 0)
    for i in range(0, len(data), CHUNK):
        part = data[i : i + CHUNK]
        h = combine(h, chunk_hash(part), len(part))
    return h


def combine_chunks(chunks: DataFrame) -> DataFrame:
    """(doc_id, fp, bytes) of documents that lie in rows (doc_id, chunk_no, data), hashed chunk by chunk in parallel.

    The per-document reduction is a commutative sum of each chunk's hash shifted by the bytes after it, so it combines
    map-side. A null chunk counts as empty.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(fingerprint(x or b""), len(x or b"")) for x in b["data"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "chunk_no": b["chunk_no"], "h0": pa.array([r[0][0] for r in rows], pa.int64()), "h1": pa.array([r[0][1] for r in rows], pa.int64()), "size": pa.array([r[1] for r in rows], pa.int64())})

    h = chunks.select(F.col("doc_id").cast("long"), F.col("chunk_no").cast("long"), "data").mapInArrow(hashed, "doc_id long, chunk_no long, h0 long, h1 long, size long")
    after = h.withColumn("after", F.coalesce(F.sum("size").over(Window.partitionBy("doc_id").orderBy(F.desc("chunk_no")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b["after"].to_pylist()
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "size": b["size"]} | {f"h{i}": pa.array([x * pow(BASES[i], k, PRIMES[i]) % PRIMES[i] for x, k in zip(b[f"h{i}"].to_pylist(), n, strict=True)], pa.int64()) for i in (0, 1)})

    s = after.mapInArrow(shifted, "doc_id long, size long, h0 long, h1 long").groupBy("doc_id").agg(*(F.pmod(F.sum(f"h{i}"), F.lit(PRIMES[i])).alias(f"h{i}") for i in (0, 1)), F.sum("size").alias("bytes"))
    return s.select("doc_id", (F.col("h0") * F.lit(2**31) + F.col("h1")).alias("fp"), "bytes")


_DIGEST = "doc_id long, row long, fp long, bytes long, points long, sha binary"


def _fingerprint(flat: bytes) -> int:
    a, b = fingerprint(flat)
    return a * 2**31 + b


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list] = [[], [], [], []]
        for x in b["text"].cast(pa.binary()):
            raw = x.as_py() or b""
            flat = raw.translate(None, SPACES)
            out[0].append(_fingerprint(flat))
            out[1].append(len(flat))
            out[2].append(len(raw) - int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) == 0x80)))
            out[3].append(hashlib.sha256(flat).digest())
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["row"], *(pa.array(v, pa.int64()) for v in out[:3]), pa.array(out[3], pa.binary())], names=["doc_id", "row", "fp", "bytes", "points", "sha"])
        give_back()


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come as groups: one text of a salt of a group first (head), then the others. Says which equal it, chunk by chunk.

    A text that hasn't its row's fingerprint belongs to another row of the same key, and is passed over.
    """
    key, head = None, b""
    for b in batches:
        out: list[tuple] = []
        for k0, k1, salt, first, row, raw in zip(b["fp"].to_pylist(), b["bytes"].to_pylist(), b["salt"].to_pylist(), b["head"].to_pylist(), b["row"].to_pylist(), b["text"].cast(pa.binary()).to_pylist(), strict=True):
            flat = memoryview((raw or b"").translate(None, SPACES))
            if len(flat) != k1 or _fingerprint(flat) != k0:
                continue
            if first and key != (k0, k1, salt):
                key, head = (k0, k1, salt), flat
            else:
                out.append((row, k0, k1, all(flat[i : i + CHUNK] == head[i : i + CHUNK] for i in range(0, len(flat), CHUNK))))
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.bool_())], names=["row", "fp", "bytes", "same"])


def _groups(docs: DataFrame) -> DataFrame:
    """(doc_id, row, keep_id, keep_row, group_size, sha), one row per row of ``docs``."""
    docs = id_and_text(docs)
    digests = keep(docs.mapInArrow(_digests, _DIGEST))
    groups = digests.groupBy("fp", "bytes").agg(F.min("row").alias("first"), F.max("row").alias("last"), F.approx_count_distinct("row").alias("size")).where("first < last").drop("last")
    salts = F.ceil(F.col("size") / SALT_ROWS)
    members = digests.select("row", "fp", "bytes").distinct().join(groups, ["fp", "bytes"])
    need = keep(
        members.where("row <> first").select("row", "fp", "bytes", F.pmod(F.xxhash64("row"), salts).alias("salt"), F.lit(False).alias("head")).unionByName(
            groups.select(F.col("first").alias("row"), "fp", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), F.lit(True).alias("head"))
        )
    )
    # one text of each different row of the groups, dealt by group and salt; the head of a salt sorts first
    texts = docs.where(passing(need, "row", F.col("row"))).groupBy("row").agg(F.first("text").alias("text")).join(need, "row")
    dealt = texts.repartition("fp", "bytes", "salt").sortWithinPartitions("fp", "bytes", "salt", F.desc("head"))
    same = dealt.select("fp", "bytes", "salt", "head", "row", "text").mapInArrow(_compared, "row long, fp long, bytes long, same boolean")
    off = same.where("not same").select("row", "fp", "bytes").distinct().withColumn("off", F.lit(True))
    keyed = digests.join(off, ["row", "fp", "bytes"], "left").withColumn("part", F.when(F.col("off"), F.col("sha")))
    best = F.max(F.struct("points", (-F.col("doc_id")).alias("id"), "row"))
    chosen = keyed.groupBy("fp", "bytes", "part").agg(F.count("*").alias("group_size"), best.alias("best")).select(F.col("fp").alias("f"), F.col("bytes").alias("b"), F.col("part").alias("p"), "group_size", (-F.col("best.id")).alias("keep_id"), F.col("best.row").alias("keep_row"))
    return keyed.join(chosen, (F.col("fp") == F.col("f")) & (F.col("bytes") == F.col("b")) & F.col("part").eqNullSafe(F.col("p"))).select("doc_id", "row", "keep_id", "keep_row", "group_size", "sha")


def _stays():
    return (F.col("row") == F.col("keep_row")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))


def duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space ([\\x20\\x09-\\x0D]); a null text is empty, and empty texts are
    equal. The row with the most code points, then the smallest doc_id stays; a null doc_id stays only where no other of
    its group as long can. Rows with the same doc_id and text share their fate. Other columns are ignored. No rows give no
    rows.

    The text itself is read twice and never sorted as a whole: the first pass leaves some 80 bytes a row; only one text of
    each different row in groups is shuffled for the comparison (a filter of bounded size finds them in the scan), salted so
    that no task gets more than about SALT_ROWS of a group's texts with one copy of its head.
    """
    return _groups(docs).select("doc_id", "keep_id", "group_size", _stays().alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def kept(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that another one stands for; all columns, unchanged, whatever their names. One row of each
    group of equal texts stays, also where rows repeat a doc_id, have none, or are the same in every column."""
    with scope():
        groups = _groups(docs).where("group_size > 1")
        return one_of_each(docs, groups.select("row", "doc_id", _stays().alias("stays")))
