"""Toxicity by a counterfactually regularised classifier over hashed words.

Labelled texts that name a group of people are paired with a copy in which the name is swapped for another of its kind.
The logistic loss carries a penalty on the square of the score's change between the two, so a neutral mention of a group
doesn't raise a score. Inputs are only the words of the text and their first letters.

Names come from a list (IDENTITIES) and from the labelled texts themselves: their most frequent words whose share of toxic
texts is that of all (``neutral``) say nothing about toxicity, so a word and the next in frequency stand in for one another
as two names of one kind do. That carries the penalty to corpora and languages that the list doesn't know.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import BYTE_VALUES, LOWER, mix, slices, words
from .pii import _WORD, PARTS, _lower
from .shared import keep, small_batches

#: Labelled documents to train on at most, log2 of the hashed dimensions, features kept, and the least score of a toxic text.
SAMPLE, DIMENSIONS, KEPT, THRESHOLD = 8000, 18, 1500, 0.3
#: Kinds of names that stand in for one another.
IDENTITIES = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino"),
    ("immigrant", "foreigner", "native", "citizen"),
    ("immigrants", "foreigners", "natives", "citizens"),
)
_PREFIXES = (4, 5)
#: Neutral words at most, the least share of texts that hold one, and the largest deviation of its toxic share, in standard errors.
NEUTRAL, SPREAD, DEVIATION = 64, 0.02, 1.0


def _hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dimensions, rows, word hashes): of each word itself and its first bytes; the last part for words alone."""
    h, start, end, row = words(raw, at, space=PARTS)
    parts, rows = [h], [row]
    low = LOWER[raw]
    place = mix(np.arange(1, 9, dtype=np.uint64))
    for n in _PREFIXES:
        m = np.flatnonzero(end - start >= n)
        p = np.full(len(m), n, np.uint64)
        for j in range(n):
            p += BYTE_VALUES[low[start[m] + j]] * place[j]
        parts.append(mix(p))
        rows.append(row[m])
    return (np.concatenate(parts) >> np.uint64(64 - DIMENSIONS)).astype(np.int64), np.concatenate(rows), h


def _distinct(dim: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(row * np.int64(1 << DIMENSIONS) + dim)
    return both & ((1 << DIMENSIONS) - 1), both >> DIMENSIONS


def dimensions(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return np.unique(_hashes(raw, np.array([0, len(raw)]))[0]) if len(raw) else np.zeros(0, np.int64)


def swapped(text: str, names: tuple[tuple[str, ...], ...] = IDENTITIES) -> str | None:
    """``text`` with each name replaced by the next of its kind; None if it has none."""
    following = {a: b for kind in names for a, b in zip(kind, kind[1:] + kind[:1], strict=True)}
    new, n = _WORD.subn(lambda m: following.get(_lower(m[0]), m[0]), text)
    return new if n and new != text else None


def neutral(texts: DataFrame, most: int = NEUTRAL) -> tuple[tuple[str, ...], ...]:
    """Pairs of words of (text, _toxic), at most ``most`` words: the most frequent ones that both kinds of text hold alike."""
    words_of = F.array_distinct(F.split(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-/:-@\[-`{-\x7f]+"))
    total = texts.agg(F.count("*").alias("n"), F.sum("_toxic").alias("t")).first()
    rate = (total["t"] or 0.0) / max(1, total["n"])
    if not 0 < rate < 1:
        return ()
    count = texts.select("_toxic", F.explode(words_of).alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("_toxic").alias("t"))
    alike = F.abs(F.col("t") - F.col("n") * rate) <= DEVIATION * F.sqrt(F.col("n") * rate * (1 - rate))
    found = [r["word"] for r in count.where(alike & (F.length("word") > 1) & (F.col("n") >= SPREAD * total["n"])).orderBy(F.desc("n"), "word").limit(most).collect()]
    return tuple(zip(found[::2], found[1::2], strict=False))


def train(texts: list[np.ndarray], others: list[np.ndarray | None], toxic: np.ndarray, pull: float = 1.0, ridge: float = 2e-4, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights of all hashed dimensions and a bias.

    texts: each one's distinct dimensions. others: those of its counterfactual, or None. The KEPT dimensions with the
    largest chi-square enter; those of swapped names always do.
    """
    size = 1 << DIMENSIONS
    weights, n, ones = np.zeros(size, np.float32), len(texts), float(toxic.sum())
    if not n or ones in (0.0, float(n)):
        return weights, 6.0 if n and ones == n else -6.0
    flat, row = np.concatenate(texts), np.repeat(np.arange(n), [len(x) for x in texts])
    a = np.bincount(flat, weights=toxic[row], minlength=size)
    total = np.bincount(flat, minlength=size)
    b = total - a
    chi = n * (a * (n - ones - b) - b * (ones - a)) ** 2 / np.maximum(1, total * (n - total) * ones * (n - ones))
    chi[total < 3] = 0
    swaps = np.unique(np.concatenate([np.setxor1d(x, y) for x, y in zip(texts, others, strict=True) if y is not None] or [np.zeros(0, np.int64)]))
    best = np.argsort(-chi, kind="stable")[:KEPT]
    use = np.union1d(best[chi[best] > 0], swaps)
    column = np.full(size, -1)
    column[use] = np.arange(len(use))

    def dense(rows: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(rows), len(use)))
        for i, r in enumerate(rows):
            c = column[r]
            x[i, c[c >= 0]] = 1
        return x

    x = dense(texts)
    pairs = [i for i, o in enumerate(others) if o is not None]
    change = dense([texts[i] for i in pairs]) - dense([others[i] for i in pairs]) if pairs else np.zeros((0, len(use)))
    w, bias = np.zeros(len(use)), float(np.log(ones / (n - ones)))
    vw, vb = w.copy(), bias
    rate = 1.0 / (0.25 * max(1.0, (x * x).sum(1).mean()) + pull * (change * change).sum(1).max(initial=0.0) + ridge)
    for t in range(rounds):
        m = t / (t + 3)
        aw, ab = w + m * (w - vw), bias + m * (bias - vb)
        e = 1 / (1 + np.exp(-np.clip(x @ aw + ab, -40, 40))) - toxic
        g = x.T @ e / n + ridge * aw
        if pairs:
            g += pull * (change.T @ (change @ aw)) / len(pairs)
        vw, vb = w, bias
        w, bias = aw - rate * g, ab - rate * e.mean()
    weights[use] = w
    return weights, float(bias)


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, pull: float = 1.0) -> tuple[np.ndarray, float]:
    """Trains on at most ``sample`` labelled rows (by the hash of doc_id) that aren't held out. The sample's ids, which
    are bounded, are broadcast; each sampled text comes to the driver as its distinct hashed words. Of a repeated doc_id the
    smallest text counts, and it is toxic if any of its labels says so."""
    usable = labels.where("toxic is not null and doc_id is not null and pmod(crc32(cast(cast(doc_id as string) as binary)), 4) <> 2").select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("double").alias("_toxic")).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    chosen = usable.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = keep(small_batches(docs).select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min("text").alias("text"), F.first("_toxic").alias("_toxic")))
    names = IDENTITIES + neutral(texts)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, others = [], []
            for t in b["text"].to_pylist():
                other = swapped(t or "", names)
                rows.append(dimensions(t or "").astype(np.int32).tobytes())
                others.append(None if other is None else dimensions(other).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(others, pa.binary()), b["_toxic"]], names=["x", "other", "toxic"])

    got = texts.select("text", "_toxic").mapInArrow(hashed, "x binary, other binary, toxic double").toArrow()
    texts.unpersist()
    decode = lambda v: None if v is None else np.frombuffer(v, np.int32).astype(np.int64)
    rows = sorted(zip(got["x"].to_pylist(), got["other"].to_pylist(), got["toxic"].to_pylist(), strict=True), key=lambda r: (r[0], r[2]))
    return train([decode(r[0]) for r in rows], [decode(r[1]) for r in rows], np.array([r[2] for r in rows]), pull)


def scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    A text's score is the logistic of the weights of its distinct words and word beginnings; a null, empty or blank text
    has the score of no words. Rows with null labels are no labels; extra columns are ignored; no rows give no rows;
    without labels of both kinds every score is the same. Rows with null or repeated doc_ids are rows of their own.
    """
    weights, bias = fit(docs, labels, sample)
    model = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b0 = model.value
        for b in batches:
            out = []
            for low, high, raw, at in slices(b["text"]):
                dim, row, _ = _hashes(raw, at)
                on = w[dim] != 0
                dim, row = _distinct(dim[on], row[on])
                out.append(np.bincount(row, weights=w[dim], minlength=high - low))
            s = 1 / (1 + np.exp(-np.clip(np.concatenate(out) + b0, -40, 40))) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([held_out(i) for i in b["doc_id"].to_pylist()], pa.bool_()), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")
