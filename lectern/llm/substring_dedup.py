"""Passages that repeat across documents: paragraph MinHash banding with exact verification.

A paragraph here is a sentence or line (longer ones are parted at words picked by content), so a passage put into the
middle of other text still shares whole paragraphs with its other places. Equal paragraphs are found by a map-side
combined group-by of their hash. Different ones collide in BANDS bands of ROWS MinHash values over their 5-word shingles:
at a similarity of exactly 0.8 a pair shares no bucket with probability (1 - 0.8**2)**8 = 0.03 %; what shares one is
compared. Links to one pivot of a bucket are
candidates first; then the members of a bucket that these leave in different components are compared with each other, in
bounded tiles, until nothing is left out. Each link is verified by the exact Jaccard similarity of the texts. Components of
verified links are classes, and a class's first place stays.

A passage that starts or ends inside a sentence may hold few whole paragraphs. So the runs of SPAN words, wherever they
start, are units as well: of each WINDOW neighbouring ones that with the smallest hash. A verbatim passage of
SPAN + WINDOW - 1 = 50 words holds all of a window, so all its places share at least one run. Neighbouring repeated
paragraphs and runs of a document join to one span.

The repeated paragraphs' hashes go to the scan that looks for their places as a Bloom filter of fixed size; false
positives fall to an exact join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bloom, ngram_join
from .kernel import _BASE, _PLACE, _powers, mix, signed, slices, words
from .shared import cut, keep, small_batches

K, P, Q = 5, 80, 100
BANDS, ROWS = 8, 2
#: Words of a paragraph at least; words over which one is parted; words of a reported span at least, and of a gap inside one at most.
LEAST, LONG, SPAN, GAP = 5, 64, 20, 12
#: Runs of SPAN words of which the one with the smallest hash is a unit.
WINDOW = 31
SEEN = 1 << 20
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True


def paragraphs(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash of 63 bits, row, first word in the row, words, first byte, past the last byte, first word in the slice) of each
    paragraph of LEAST words or more, and all word hashes."""
    h, start, end, row = words(raw, at)
    e = np.zeros(0, np.int64)
    if not len(h):
        return np.zeros(0, np.uint64), e, e, e, e, e, e, h
    lines = np.cumsum(raw == 10)
    last = np.ones(len(h), bool)
    last[:-1] = (row[1:] != row[:-1]) | _STOP[raw[end[:-1] - 1]] | (lines[start[1:]] != lines[end[:-1] - 1])
    first = np.append(0, np.flatnonzero(last)[:-1] + 1)
    size = np.diff(np.append(first, len(h)))
    long = np.repeat(size > LONG, size)
    last |= long & (h & np.uint64(15) == 0)
    first = np.append(0, np.flatnonzero(last)[:-1] + 1)
    size = np.diff(np.append(first, len(h)))
    place = np.arange(len(h)) - np.repeat(first, size)
    u = mix(np.add.reduceat(h * _powers(int(size.max()))[place], first) + size.astype(np.uint64) * _PLACE[3]) >> np.uint64(1)
    m = size >= LEAST
    u, first, size = u[m], first[m], size[m]
    base = np.searchsorted(row, row[first])
    return u, row[first], first - base, size, start[first], end[first + size - 1], first, h


_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _sliding(x: np.ndarray, size: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` of each ``size`` neighbours."""
    have = 1
    while have < size:
        step = min(have, size - have)
        x = pick(x[:-step], x[step:])
        have += step
    return x


def runs(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, row, first word in the row, words, first byte, past the last byte) of the smallest run of SPAN words of each
    WINDOW neighbouring ones of a row; of equal ones directly after each other the first."""
    h, start, end, row = words(raw, at)
    n = len(h) - SPAN + 1
    if n < WINDOW:
        e = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), e, e, e, e, e
    power = np.full(len(h) + 1, _UNBASE, np.uint64)
    power[0] = 1
    total = np.append(np.uint64(0), np.cumsum(h * _powers(len(h)), dtype=np.uint64))
    s = mix((total[SPAN:] - total[:n]) * np.cumprod(power[:n], dtype=np.uint64) + _PLACE[4])
    whole = row[: n - WINDOW + 1] == row[SPAN + WINDOW - 2 :]
    # the largest of the minima of the windows around a run; a window over two rows counts as none
    none = np.zeros(WINDOW - 1, np.uint64)
    low = np.concatenate([none, np.where(whole, _sliding(s, WINDOW, np.minimum), np.uint64(0)), none])
    m = _sliding(low, WINDOW, np.maximum) == s
    m[1:] &= (s[1:] != s[:-1]) | (row[1:n] != row[: n - 1])
    first = np.flatnonzero(m)
    return s[first] >> np.uint64(1), row[first], first - np.searchsorted(row, row[first]), np.full(len(first), SPAN), start[first], end[first + SPAN - 1]


def _shingles(h: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first of each paragraph) of the K-word shingles inside paragraphs, one after the other."""
    count = size - K + 1
    begin = np.cumsum(count) - count
    where = np.repeat(first - begin, count) + np.arange(int(count.sum()))
    s = np.zeros(len(where), np.uint64)
    for j in range(K):
        s += h[where + j] * _PLACE[8 + j]
    return mix(s), begin


def _seen(docs: DataFrame) -> DataFrame:
    """(u, doc_id) of each paragraph and run."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, high, raw, at in slices(b["text"]):
                for u, row, *_ in (paragraphs(raw, at), runs(raw, at)):
                    yield pa.RecordBatch.from_arrays([pa.array(signed(u)), b["doc_id"].slice(low, high - low).take(pa.array(row))], names=["u", "doc_id"])

    return docs.mapInArrow(scanned, "u long, doc_id long")


def _banded(docs: DataFrame) -> DataFrame:
    """(sig, member): the buckets of each different paragraph that another than its equal could be similar to, s / (s + 1) >= P / Q.
    member is u less 2**63, which marks it as one that can be a pivot."""
    least = K - 1 + P // (Q - P)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for _, _, raw, at in slices(b["text"]):
                u, _, _, size, _, _, first, h = paragraphs(raw, at)
                m = size >= least
                u, pick = np.unique(u[m], return_index=True)
                if not len(u):
                    continue
                new = np.array([x not in seen for x in u.tolist()], bool)
                if len(seen) >= SEEN:
                    seen.clear()
                seen.update(u[new].tolist())
                u, first, size = u[new], first[m][pick][new], size[m][pick][new]
                if not len(u):
                    continue
                s, begin = _shingles(h, first, size)
                for band in range(BANDS):
                    key = np.full(len(u), band + 1, np.uint64)
                    for r in range(ROWS):
                        key = mix(key * _PLACE[5] + np.minimum.reduceat(mix(s ^ _PLACE[20 + band * ROWS + r]), begin))
                    yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(signed(u) + np.int64(-(2**63)))], names=["sig", "member"])

    return docs.select("text").mapInArrow(scanned, "sig long, member long")


def _places(docs: DataFrame, repeated: np.ndarray, near: np.ndarray) -> DataFrame:
    """(u, doc_id, word, words, start, end, text) of the paragraphs and runs that a filter lets pass, in code points; text (bytes) of the paragraphs in ``near``."""
    send = docs.sparkSession.sparkContext.broadcast((repeated, near))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = send.value
        for b in batches:
            for low, high, raw, at in slices(b["text"]):
                parts = paragraphs(raw, at)[:6], runs(raw, at)
                u, row, word, size, start, end = (np.concatenate(c) for c in zip(*parts, strict=True))
                x = signed(u)
                similar = bloom.within(two, x) & (np.arange(len(x)) < len(parts[0][0]))
                m = np.flatnonzero(similar | bloom.within(one, x))
                points = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
                base = points[at[row]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[m]), b["doc_id"].slice(low, high - low).take(pa.array(row[m])), pa.array(word[m], pa.int64()), pa.array(size[m], pa.int64()), pa.array((points[start] - base)[m]), pa.array((points[end] - base)[m]), pa.array([raw[start[i] : end[i]].tobytes() if similar[i] else None for i in m], pa.binary())],
                    names=["u", "doc_id", "word", "words", "start", "end", "text"],
                )

    return docs.mapInArrow(scanned, "u long, doc_id long, word long, words long, start long, end long, text binary")


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v): the pairs (a, b) whose texts have an exact Jaccard similarity of P / Q or more."""
    both = pairs.join(texts.select(F.col("u").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("u").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")

    def sets(column: pa.Array) -> list[np.ndarray]:
        out = []
        for low, high, raw, at in slices(column):
            h, _, _, row = words(raw, at)
            edge = np.searchsorted(row, np.arange(high - low + 1))
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                out.append(np.unique(_shingles(h[i:j], np.array([0]), np.array([j - i]))[0]) if j - i >= K else np.zeros(0, np.uint64))
        return out

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for s, t in zip(sets(b["x"]), sets(b["y"]), strict=True):
                n = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(Q * n >= P * (len(s) + len(t) - n) and n > 0)
            m = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b["a"].filter(m), b["b"].filter(m)], names=["u", "v"])

    return both.mapInArrow(checked, "u long, v long")


def _linked(stars: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, component) of the paragraphs that are linked: those of ``stars`` (sig, a, b) first, then what these leave apart in
    one bucket. Sketches go before texts, and no pair is compared twice."""
    sketches = keep(ngram_join._sketches(texts.withColumnRenamed("u", "class"), K))
    pairs = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    told = cut(ngram_join._plausible(pairs, sketches, P, Q))
    links = cut(_similar(told, texts))
    belongs = ngram_join.settled(cut(ngram_join._buckets(stars)), told, links, sketches, P, Q, lambda rest: _similar(rest, texts))
    sketches.unpersist()
    return belongs


def repeats(docs: DataFrame) -> DataFrame:
    """One row per repeated passage of a document: doc_id, start, end (code points), n_words, first_doc_id, removed.

    A verbatim passage of 50 words or more has a row in each of its documents, wherever in a sentence it starts or ends;
    a shorter one of SPAN words or more has if it holds that many words of whole paragraphs. start and end are those of
    the outermost units of a passage, which may lie inside it. Documents without one have no row. first_doc_id is the smallest document with a paragraph of the passage; removed
    says whether some of its paragraphs have their first place elsewhere. Only repetition across documents counts. Null,
    empty and short texts have no rows. Rows that repeat a doc_id are one document, whose texts don't repeat one another; rows
    without a doc_id can't be told apart and take no part. Extra columns are ignored; no rows give no rows.
    """
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    equal = cut(_seen(docs).groupBy("u").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("u"))
    stars = cut(_banded(docs).repartition("sig").sortWithinPartitions("sig", "member").mapInArrow(ngram_join._stars, "sig long, a long, b long").distinct())
    near = stars.select(F.explode(F.array("a", "b")).alias("u")).distinct()
    places = keep(_places(docs, bloom.build(equal, "u"), bloom.build(near, "u")))
    texts = keep(places.where("text is not null").join(near, "u").groupBy("u").agg(F.min("text").alias("text")))
    belongs = _linked(stars, texts).withColumnRenamed("node", "u")
    known = places.drop("text").join(equal.withColumn("equal", F.lit(True)), "u", "left").join(belongs, "u", "left").where("equal or component is not null").withColumn("class", F.coalesce("component", "u"))
    # cut, so that the join below has an exchange of its own on both sides and a class of very many places can be split
    first = cut(known.groupBy("class").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last")).where("first_doc_id < last").drop("last"))
    found = known.join(first, "class")
    order = Window.partitionBy("doc_id").orderBy("word")
    new = F.coalesce((F.col("word") - F.max(F.col("word") + F.col("words")).over(order.rowsBetween(Window.unboundedPreceding, -1)) > GAP).cast("int"), F.lit(1))
    spans = found.withColumn("new", new).withColumn("span", F.sum("new").over(order)).groupBy("doc_id", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max(F.col("word") + F.col("words")) - F.min("word")).alias("n_words"), F.min("first_doc_id").alias("first_doc_id"), F.max(F.col("first_doc_id") < F.col("doc_id")).alias("removed"))
    return spans.where(F.col("n_words") >= SPAN).drop("span")
