"""Quality by weak labels: heuristic labellers, expectation-maximisation over their votes, and a hashed linear scorer.

1. Each labeller votes bad or good on every document from shares of words and bytes (or abstains). Votes are counted by
   pattern, so what EM sees is at most 3**len(LABELLERS) counts over the whole corpus.
2. EM estimates, without labels, each labeller's rates of voting on good and on bad texts, and so the posterior of each
   pattern.
3. The posteriors label a bounded sample of documents (SAMPLE, by the hash of doc_id and text), from which a logistic scorer over
   hashed word shapes is trained. It scores every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import BYTE_VALUES, IS_SPACE, mix, slices, words
from .shared import small_batches

#: Documents to train on at most, dimensions of the hashed shapes, and the least score of a good text.
SAMPLE, DIMENSIONS, LEAST = 4096, 1024, 0.3
#: (name, at least: bad, at most: good) on the features of the same name.
LABELLERS = (("upper", 0.40, 0.15), ("symbols", 0.12, 0.05), ("separators", 0.08, 0.02), ("repeats", 0.30, 0.10), ("doubled", 0.20, 0.03), ("digits", 0.30, 0.10), ("sameness", 0.65, 0.45))
_UPPER, _ALPHA, _DIGIT, _SYMBOL = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:] = True
_DIGIT[48:58] = True
_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"?-()"]] = True
#: Classes of bytes in a word's shape: letters by case, digits; other ASCII stands for itself.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:], _SHAPE[48:58] = 65, 97, 97, 48
#: Rows of one dense block; words below which sameness says nothing.
_ROWS, FEW = 2000, 30


def features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(labeller features, hashed shape shares), a row each for the rows of one slice.

    A shape is a word with runs of one byte class drawn together, marked if the word is long or repeats the one before.
    """
    rows = len(at) - 1
    h, start, end, row = words(raw, at, lower=False)
    n = np.maximum(1, np.bincount(row, minlength=rows))
    size = np.maximum(1, np.diff(at))
    sums = lambda mask: np.diff(np.searchsorted(np.flatnonzero(mask), at))
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    byte = raw[end - 1] if len(h) else np.zeros(0, np.uint8)
    doubled = np.zeros(len(h), bool)
    two = np.flatnonzero(end - start > 2)
    doubled[two] = _SYMBOL[byte[two]] & (raw[end[two] - 2] == byte[two])
    separator = (end - start == 1) & _SYMBOL[byte]
    per = lambda mask: np.bincount(row[mask], minlength=rows) / n
    same = np.full(rows, np.nan)
    judged = np.stack([sums(_UPPER[raw]) / np.maximum(1, sums(_ALPHA[raw])), sums(_SYMBOL[raw]) / size, per(separator), per(again), per(doubled), sums(_DIGIT[raw]) / size, same], 1)
    judged[size < 2] = np.nan
    x = np.zeros((rows, DIMENSIONS), np.float32)
    if len(h):
        kind = _SHAPE[raw]
        turn = np.append(True, kind[1:] != kind[:-1])
        turn[start] = True
        inside = np.flatnonzero(turn & ~IS_SPACE[raw])
        first = np.searchsorted(inside, start)
        place = np.arange(len(inside)) - np.repeat(first, np.diff(np.append(first, len(inside))))
        shape = mix(np.add.reduceat(BYTE_VALUES[kind[inside]] * mix(np.minimum(place, 12).astype(np.uint64) + np.uint64(1)), first) + again * np.uint64(7919) + (end - start > 20) * np.uint64(104729))
        bucket = (shape % np.uint64(DIMENSIONS)).astype(np.int64)
        for low in range(0, rows, _ROWS):
            high = min(rows, low + _ROWS)
            i, j = np.searchsorted(row, [low, high])
            taken = np.bincount((row[i:j] - low) * DIMENSIONS + (h[i:j] % np.uint64(DIMENSIONS)).astype(np.int64), minlength=(high - low) * DIMENSIONS).reshape(-1, DIMENSIONS)
            judged[low:high, -1] = 1 - (taken > 0).sum(1) / (DIMENSIONS * -np.expm1(-n[low:high] / DIMENSIONS))
            x[low:high] = np.bincount((row[i:j] - low) * DIMENSIONS + bucket[i:j], minlength=(high - low) * DIMENSIONS).reshape(-1, DIMENSIONS)
        x = np.sqrt(x / n[:, None].astype(np.float32))
        judged[n < FEW, -1] = np.nan
    return judged, x


def votes(judged: np.ndarray) -> np.ndarray:
    """Per row, a number whose digits to base 3 are the votes: 0 good, 1 bad, 2 abstains."""
    bad, good = (np.array([x[i] for x in LABELLERS]) for i in (1, 2))
    v = np.where(judged >= bad, 1, np.where(judged <= good, 0, 2))
    return v @ (3 ** np.arange(len(LABELLERS)))


def estimate(patterns: dict[int, int], rounds: int = 100) -> dict[int, float]:
    """Posterior of good by pattern. Labellers vote independently given the quality; the start is the vote that any bad
    vote makes bad likelier."""
    keys = np.array(sorted(patterns), np.int64)
    count = np.array([patterns[k] for k in keys], float)
    v = keys[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    good = np.where((v == 1).any(1), 0.1, 0.9)
    for _ in range(rounds):
        prior = (count @ good + 1) / (count.sum() + 2)
        score = np.log(prior) - np.log1p(-prior)
        logit = np.full(len(keys), score)
        for j in range(len(LABELLERS)):
            for vote in range(3):
                on = v[:, j] == vote
                p = ((count * good)[on].sum() + 1) / ((count * good).sum() + 3)
                q = ((count * (1 - good))[on].sum() + 1) / ((count * (1 - good)).sum() + 3)
                logit[on] += np.log(p) - np.log(q)
        new = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        if np.abs(new - good).max(initial=0) < 1e-9:
            break
        good = new
    return dict(zip(keys.tolist(), good.tolist(), strict=True))


def _train(x: np.ndarray, y: np.ndarray, rounds: int = 1000, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by accelerated gradient steps."""
    x = x.astype(float)
    w, b = np.zeros(x.shape[1]), 0.0
    vw, vb = w.copy(), b
    rate = 4.0 / max(1e-9, (x**2).sum(1).max(initial=1.0) + 1)
    for t in range(rounds):
        m = t / (t + 3)
        aw, ab = w + m * vw, b + m * vb
        e = 1 / (1 + np.exp(-np.clip(x @ aw + ab, -40, 40))) - y
        nw, nb = aw - rate * (x.T @ e / len(y) + ridge * aw), ab - rate * e.mean()
        vw, vb, w, b = nw - w, nb - b, nw, nb
    return w, b


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The scorer's weights and bias. Patterns are counted over all documents; of the sampled ones, features come along."""
    total = docs.count()
    if not total:
        return np.zeros(DIMENSIONS), 0.0
    part = min(1.0, 0.9 * sample / total)
    # by id and text, so that rows without an id are sampled like others; equal texts give one row below
    marked = docs.select("text", (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(part * (1 << 30)) + 1).alias("in"))

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chosen = b["in"].to_numpy(zero_copy_only=False)
            for low, high, raw, at in slices(b["text"]):
                judged, x = features(raw, at)
                p = votes(judged)
                key, n = np.unique(p, return_counts=True)
                at_rows = np.flatnonzero(chosen[low:high])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(key, p[at_rows])), pa.array(np.append(n, np.zeros(len(at_rows), np.int64))), pa.array([None] * len(key) + [x[i].tobytes() for i in at_rows], pa.binary())], names=["pattern", "n", "x"]
                )

    counted = marked.mapInArrow(voted, "pattern long, n long, x binary").groupBy("pattern", "x").agg(F.sum("n").alias("n")).collect()
    posterior = estimate({k: sum(r["n"] for r in counted if r["x"] is None and r["pattern"] == k) for k in {r["pattern"] for r in counted}})
    chosen = sorted((r for r in counted if r["x"] is not None), key=lambda r: (r["x"], r["pattern"]))[:sample]
    if not chosen:
        return np.zeros(DIMENSIONS), 0.0
    return _train(np.stack([np.frombuffer(r["x"], np.float32) for r in chosen]), np.array([posterior[r["pattern"]] for r in chosen]))


def _scorer(docs: DataFrame, weights: np.ndarray, bias: float):
    model = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))

    def score(column: pa.Array) -> np.ndarray:
        w, b = model.value
        out = [1 / (1 + np.exp(-np.clip(features(raw, at)[1] @ w + b, -40, 40))) for _, _, raw, at in slices(column)]
        s = np.concatenate(out) if out else np.zeros(0)
        blank = np.concatenate([np.diff(np.append(0, np.cumsum(~IS_SPACE[raw]))[at]) == 0 for _, _, raw, at in slices(column)]) if out else np.zeros(0, bool)
        return np.where(blank, 0.0, s)

    return score


def scores(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, score (0 to 1, of good), keep (score >= LEAST). Null, empty and blank texts score 0; rows with null or
    repeated doc_ids are rows of their own, and equal texts score the same; extra columns are ignored; no rows give no rows."""
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    score = _scorer(docs, *fit(docs, sample))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(score(b["text"]), pa.float64())], names=["doc_id", "score"])

    return docs.mapInArrow(scored, "doc_id long, score double").withColumn("keep", F.col("score") >= LEAST)


def accepted(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows whose text the scorer rejects; all columns, unchanged, without a shuffle.

    Null, empty and blank texts are rejected. Rows with null or repeated doc_ids are rows of their own; columns may have
    any names; no rows give no rows."""
    score = _scorer(docs, *fit(small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), sample))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(score(b["text"]) >= LEAST))

    return docs.mapInArrow(chosen, docs.schema)
