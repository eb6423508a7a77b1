"""SentencePiece encoding and decoding over a relational lattice.

The lattice of a unit (a word with its leading word marks) has an edge for each of its substrings of bounded length that
is a piece: units are exploded to substrings, joined to the piece table, grouped again, and folded by one Spark
higher-order ``aggregate`` per unit.

The fold follows the model's kind. A unigram model's fold is Viterbi (``viterbi``). A BPE model's scores are merge ranks,
and Viterbi over them doesn't give the library's ids, so its fold merges: the state is the cuts of the unit, and each step
takes out the cut between the two neighbours whose joint edge has the best score, leftmost first (``merges``).

Units repeat, so the relational part runs once on the FREQUENT most common units of the corpus, whose results are a
broadcast dictionary of bounded size. Texts are then encoded by looking units up; one that isn't there is folded on the
spot over the same piece table, so nothing depends on the bound but speed.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import keep, small_batches
from .tokenizer import public

MARK = "▁"
#: Units in the broadcast dictionary; units over this length are folded on the spot; units a task remembers beside the dictionary.
FREQUENT, UNIT, REMEMBERED = 50_000, 24, 400_000
#: No piece has a mark after another character, so no merge crosses these units; a line feed is no piece.
_UNITS = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
_NATIVE_UNITS = f"\\n|{MARK}+[^{MARK}\\n]*|[^{MARK}\\n]+"


@cache
def model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@cache
def pieces(path: str) -> dict[str, tuple[int, float]]:
    """Piece -> (id, score) of the pieces that texts can hold."""
    m = model(path)
    return {m.id_to_piece(i): (i, m.get_score(i)) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}


@cache
def _bytes(path: str) -> tuple[int, ...]:
    m = model(path)
    return tuple(m.piece_to_id(f"<0x{i:02X}>") for i in range(256))


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(piece, score), a row for each piece: the size of the vocabulary, which is what bounds its broadcast."""
    return spark.createDataFrame([(p, s) for p, (_, s) in pieces(path).items()], T.StructType([T.StructField("piece", T.StringType()), T.StructField("score", T.DoubleType())]))


def edges(units: DataFrame, table: DataFrame, longest: int) -> DataFrame:
    """(unit, edges): edges are (begin, end, score) of the substrings that are pieces; ``units`` has different strings."""
    size = F.length("unit")
    spot = units.select("unit", F.explode(F.sequence(F.lit(0), size - 1)).alias("begin")).select("unit", "begin", F.explode(F.sequence(F.col("begin") + 1, F.least(F.length("unit"), F.col("begin") + longest))).alias("end"))
    cut = spot.withColumn("piece", F.expr("substring(unit, begin + 1, end - begin)"))
    found = cut.join(F.broadcast(table), "piece").groupBy("unit").agg(F.collect_list(F.struct("begin", "end", "score")).alias("edges"))
    return units.select("unit").join(found, "unit", "left").select("unit", F.coalesce("edges", F.array().cast("array<struct<begin:int,end:int,score:double>>")).alias("edges"))


def merges(lattice: DataFrame) -> DataFrame:
    """(unit, cuts): the places between the pieces of a BPE model, from 0 to the unit's length."""
    table = F.map_from_entries(F.transform("edges", lambda e: F.struct(e["begin"] * 4096 + e["end"], e["score"])))
    ready = lattice.select("unit", table.alias("score"), F.sequence(F.lit(0), F.length("unit")).alias("all"))

    def step(cuts, _):
        inner = F.slice(cuts, 2, F.greatest(F.size(cuts) - 2, F.lit(0)))
        options = F.transform(inner, lambda c, i: F.struct(F.try_element_at("score", F.get(cuts, i) * 4096 + F.get(cuts, i + 2)).alias("s"), (-c).alias("c")))
        best = F.array_max(F.filter(options, lambda o: o["s"].isNotNull()))
        return F.when(best.isNull(), cuts).otherwise(F.filter(cuts, lambda c: c != -best["c"]))

    return ready.select("unit", F.aggregate("all", F.col("all"), step).alias("cuts"))


def viterbi(lattice: DataFrame, unknown: float = -100.0) -> DataFrame:
    """(unit, cuts): the cuts of the best-scoring path of a unigram model; a character that is no piece scores ``unknown``."""
    size = F.length("unit")
    chars = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(i.alias("begin"), (i + 1).alias("end"), F.lit(unknown).alias("score")))
    every = F.array_sort(F.transform(F.concat("edges", chars), lambda e: F.struct(e["end"].alias("end"), e["begin"].alias("begin"), e["score"].alias("score"))))
    start = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(F.when(i == 0, F.lit(0.0)).otherwise(F.lit(float("-inf"))).alias("score"), F.lit(0).alias("from")))

    def step(best, e):
        score = F.get(best, e["begin"])["score"] + e["score"]
        return F.transform(best, lambda b, i: F.when((i == e["end"]) & (score > b["score"]), F.struct(score.alias("score"), e["begin"].alias("from"))).otherwise(b))

    best = lattice.select("unit", F.aggregate(every, start, step).alias("best"))
    back = F.aggregate(F.sequence(F.lit(1), F.length("unit")), F.array(F.length("unit")), lambda cuts, _: F.when(F.get(cuts, F.lit(0)) == 0, cuts).otherwise(F.concat(F.array(F.get("best", F.get(cuts, F.lit(0)))["from"]), cuts)))
    return best.select("unit", back.alias("cuts"))


def fold(unit: str, table: dict[str, tuple[int, float]]) -> list[int]:
    """The cuts of ``merges``, for one unit; near-linear in its length by a heap over linked neighbours."""
    import heapq

    n = len(unit)
    before, after = list(range(-1, n)), list(range(1, n + 2))  # of each cut; cuts 0 and n stay
    alive = [True] * (n + 1)
    heap: list[tuple] = []

    def offer(c: int) -> None:
        if 0 < c < n and (got := table.get(unit[before[c] : after[c]])):
            heapq.heappush(heap, (-got[1], before[c], c, after[c]))

    for c in range(1, n):
        offer(c)
    while heap:
        _, b, c, a = heapq.heappop(heap)
        if alive[c] and before[c] == b and after[c] == a:
            alive[c] = False
            after[b], before[a] = a, b
            offer(b)
            offer(a)
    return [i for i in range(n + 1) if alive[i]]


def _ids(unit: str, cuts: list[int], path: str) -> bytes:
    table, raw = pieces(path), _bytes(path)
    out: list[int] = []
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        got = table.get(unit[i:j])
        out.extend([got[0]] if got else [raw[x] for x in unit[i:j].encode("utf-8", "replace")])
    return np.array(out, np.int32).tobytes()


class _Spelling(dict):
    """Piece -> bytes of its ids; a string that is no piece, which is one character, is spelt in bytes."""

    def __init__(self, path: str):
        super().__init__({p: np.int32(i).tobytes() for p, (i, _) in pieces(path).items()})
        self.raw = _bytes(path)

    def __missing__(self, piece: str) -> bytes:
        return np.array([self.raw[x] for x in piece.encode("utf-8", "replace")], np.int32).tobytes()


class _Known(dict):
    """Unit -> bytes of its int32 ids; units beyond the dictionary are folded when first met and remembered for a while."""

    def __init__(self, items: dict[str, bytes], path: str):
        super().__init__(items)
        self.items_, self.path, self.most = items, path, len(items) + REMEMBERED
        self.spelling = _Spelling(path)
        self.cost = {p: -score for p, (_, score) in pieces(path).items()}

    def __missing__(self, unit: str) -> bytes:
        if len(unit) > 4 * UNIT:
            return _ids(unit, fold(unit, pieces(self.path)), self.path)
        if len(self) >= self.most:
            self.clear()
            self.update(self.items_)
        ids = self[unit] = b"".join(map(self.spelling.__getitem__, self.joined(unit)))
        return ids

    def joined(self, unit: str) -> list[str]:
        """The pieces of ``fold``, for a short unit: the costs of joining neighbours are a list, of which the least goes first."""
        parts, get, never = list(unit), self.cost.get, float("inf")
        costs = [get(a + b, never) for a, b in zip(parts, parts[1:], strict=False)]
        while costs:
            least = min(costs)
            if least == never:
                break
            i = costs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i:
                costs[i - 1] = get(parts[i - 1] + parts[i], never)
            if i < len(costs):
                costs[i] = get(parts[i] + parts[i + 1], never)
        return parts


_known: dict = {}


def _worker(send, path: str) -> _Known:
    """The dictionary of this Python worker, kept over the tasks it is given."""
    key = (id(send.value), path)  # a worker holds a broadcast value once, and _Known keeps it alive
    if key not in _known:
        _known.clear()
        _known[key] = _Known(send.value, path)
    return _known[key]


def normal(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def frequent(docs: DataFrame, count: int = FREQUENT) -> DataFrame:
    """(unit): the most frequent units of all texts, at most ``count``."""
    text = F.concat(F.lit(MARK), F.translate("text", " ", MARK))
    units = docs.where("text <> ''").select(F.explode(F.regexp_extract_all(text, F.lit(_NATIVE_UNITS), F.lit(0))).alias("unit"))
    return units.where(F.length("unit") <= UNIT).groupBy("unit").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "unit").limit(count).select("unit")


def dictionary(docs: DataFrame, path: str, count: int = FREQUENT) -> dict[str, bytes]:
    units = keep(frequent(docs, count))
    cuts = merges(edges(units, piece_table(docs.sparkSession, path), max(map(len, pieces(path))))).collect()
    units.unpersist()
    return {r["unit"]: _ids(r["unit"], r["cuts"], path) for r in cuts}


def encode(docs: DataFrame, path: str | None = None, count: int = FREQUENT) -> DataFrame:
    """doc_id, n_tokens, ids, ids_crc32 (little-endian unsigned 32-bit ids) and decodes (whether decoding the ids gives the
    text), one row per document, as the library encodes the whole text. Null and empty texts have no ids; rows with null
    or repeated doc_ids are documents of their own; extra columns are ignored; no rows give no rows."""
    path = path or public("piece_bpe_32k.model")
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    send = docs.sparkSession.sparkContext.broadcast(dictionary(docs, path, count))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _worker(send, path).__getitem__
        for big in batches:
            for low in range(0, big.num_rows, 500):
                b = big.slice(low, 500)
                raw = [b"".join(map(get, _UNITS.findall(normal(t or "")))) for t in b["text"].to_pylist()]
                ids = np.frombuffer(b"".join(raw), np.int32)
                at = np.append(0, np.cumsum([len(r) // 4 for r in raw])).astype(np.int32)
                back = decoded(ids, at, path)
                same = [x == (t or "") for x, t in zip(back, b["text"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"], pa.array(np.diff(at), pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(ids)), pa.array([zlib.crc32(r) for r in raw], pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids", "ids_crc32", "decodes"]
                )

    return docs.mapInArrow(encoded, "doc_id long, n_tokens long, ids array<int>, ids_crc32 long, decodes boolean")


@cache
def _spelled(path: str) -> tuple[bytes, ...]:
    m = model(path)
    byte = {x: bytes([i]) for i, x in enumerate(_bytes(path))}
    return tuple(byte.get(i) or (b"" if m.is_control(i) else b" \xe2\x81\x87 " if m.is_unknown(i) else m.id_to_piece(i).replace(MARK, " ").encode()) for i in range(m.get_piece_size()))


def decoded(ids: np.ndarray, at: np.ndarray, path: str) -> list[str]:
    """The texts of consecutive runs of ids; the space that encoding puts before a text is taken off."""
    spell = _spelled(path)
    return [b"".join(map(spell.__getitem__, ids[i:j].tolist())).decode("utf-8", "replace").removeprefix(" ") for i, j in zip(at[:-1], at[1:], strict=True)]


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of rows (doc_id, ids); null or empty ids give an empty text."""
    path = path or public("piece_bpe_32k.model")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = [np.array(x or [], np.int32) for x in b["ids"].to_pylist()]
            at = np.append(0, np.cumsum([len(r) for r in runs])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(decoded(np.concatenate(runs or [np.zeros(0, np.int32)]), at, path), pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(texts, "doc_id long, text string")
