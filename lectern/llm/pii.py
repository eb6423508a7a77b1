"""Personal data: patterns with validity tests, and terms that disclose a protected entity.

A value that the patterns find (an address, a number) is a protected entity. A word near its occurrences discloses it to
the degree that corpus co-occurrence tells: with n(t), n(e) and n(t, e) the documents with the word, with the entity and
with both in one neighbourhood, the disclosure is the pointwise mutual information log2(n(t, e) * N / (n(t) * n(e))) and the
share n(t, e) / n(t). Words over both thresholds, seen in enough different neighbourhoods (copies of one text are one),
become spans wherever they occur.

Counts cover all documents. What a scan of the texts needs to know of the words is a Bloom filter of fixed size; its
false positives cost some rows and fall to an exact join. No word, entity or document list comes to the driver.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom as filters
from .kernel import LOWER, give_back, signed, slices, words
from .shared import cut, id_and_text, keep, passing, row_key, scope

KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x00-/:-@\[-`{-\x7f]+")
#: Bytes that part words here: ASCII without letters and digits.
PARTS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the valid base spans, sorted; kinds are places in KINDS. Linear in the text's length."""
    out = []
    if "@" in text:
        # the local part can't hold an @, so it is the run of its characters before one, not before the last match
        low = 0
        for m in _DOMAIN.finditer(text):
            at = m.start()
            head = text[max(low, text.rfind("@", low, at) + 1) : at]
            size = len(head) - len(head.rstrip(LOCAL))
            if size:
                out.append((at - size, 0, m.end()))
                low = m.end()
    for m in _IP.finditer(text):
        if all(len(d := p.lstrip("0")) <= 3 and int(d or "0") <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _hash64(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _term_hashes(terms: list[str]) -> np.ndarray:
    raw = [t.encode("utf-8", "surrogatepass") for t in terms]
    at = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    return signed(words(np.frombuffer(b"".join(raw), np.uint8), at, space=PARTS)[0])


def _lower(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


_SPAN = "array<struct<start:int,kind:int,end:int>>"
_NEAR = "array<struct<entity:long,context:long,term:string,hash:long,pair:long,one:long>>"
_FOUND = f"doc_id long, row long, spans {_SPAN}, near {_NEAR}"


def _scan(docs: DataFrame, near: int, least: int) -> DataFrame:
    """(doc_id, row, spans, near): near has the words within ``near`` words of each span, of at least ``least`` characters; pair
    is 1 at one place of each (term, entity) of a document, one at one place of each entity."""
    reach = 40 * near

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        near_type = pa.list_(pa.struct([("entity", pa.int64()), ("context", pa.int64()), ("term", pa.string()), ("hash", pa.int64()), ("pair", pa.int64()), ("one", pa.int64())]))
        for b in batches:
            spans, nears = [], []
            for x in b["text"]:
                text = x.as_py() or ""
                got = find(text)
                spans.append([{"start": s, "kind": k, "end": e} for s, k, e in got])
                seen = {}
                for s, k, e in got:
                    value = text[s:e]
                    value = value.lower() if k < 2 else re.sub("[^0-9]", "", value)
                    left, right = text[max(0, s - reach) : s], text[e : e + reach]
                    w = [m.group() for m in _WORD.finditer(left)][-near:] + [m.group() for m in _WORD.finditer(right)][:near]
                    w = [_lower(t) for t in w]
                    context = _hash64(" ".join(w))
                    for t in set(w):
                        if len(t) >= least and not t.isdigit():
                            seen[k, value, context, t] = None
                if seen:
                    hashes = _term_hashes([t for *_, t in seen]).tolist()
                    pairs, ones, told = set(), set(), []
                    for (k, v, c, t), h in zip(seen, hashes, strict=True):
                        told.append({"entity": _hash64(f"{k}:{v}"), "context": c, "term": t, "hash": h, "pair": int((k, v, t) not in pairs), "one": int((k, v) not in ones)})
                        pairs.add((k, v, t))
                        ones.add((k, v))
                    nears.append(told)
                else:
                    nears.append([])
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["row"], pa.array(spans, span_type), pa.array(nears, near_type)], names=["doc_id", "row", "spans", "near"])
            give_back()

    return docs.select("doc_id", "row", "text").mapInArrow(scanned, _FOUND)


def _occurrences(docs: DataFrame, bloom: np.ndarray, count: bool) -> DataFrame:
    """Of the words that the filter lets pass: (hash, n) with n documents of a batch if ``count``, else (row, hash,
    term, start, end) of each, in code points."""
    send = docs.sparkSession.sparkContext.broadcast(bloom if bloom.any() else None)
    names = ["hash", "n"] if count else ["row", "hash", "term", "start", "end"]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = send.value
        for b in batches:
            if bits is None:
                continue
            for low, high, raw, at in slices(b["text"]):
                h, start, end, row = words(raw, at, space=PARTS)
                h = signed(h)
                m = filters.within(bits, h)
                h, start, end, row = h[m], start[m], end[m], row[m]
                if count:
                    pair = np.unique(np.rec.fromarrays([h, row])) if len(h) else np.rec.fromarrays([h, row])
                    key, n = np.unique(pair.f0, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n, pa.int64())], names=names)
                elif len(h):
                    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    first = points[at[row]]
                    yield pa.RecordBatch.from_arrays(
                        [b["row"].slice(low, high - low).take(pa.array(row)), pa.array(h), pa.array([LOWER[raw[i:j]].tobytes().decode("utf-8", "replace") for i, j in zip(start, end, strict=True)]), pa.array(points[start] - first, pa.int32()), pa.array(points[end] - first, pa.int32())],
                        names=names,
                    )

    return docs.select("row", "text").mapInArrow(scanned, "hash long, n long" if count else "row long, hash long, term string, start int, end int")


def disclosing(docs: DataFrame, found: DataFrame, bits: float = 4.0, share: float = 0.8, contexts: int = 3) -> DataFrame:
    """(term, hash): words whose disclosure of some entity is at least ``bits`` and ``share``, from ``contexts`` different neighbourhoods or more."""
    near = found.select(F.explode("near").alias("x")).select("x.*")
    each = near.groupBy("term", "hash", "entity", "context").agg(F.sum("pair").alias("n"))
    both = keep(each.groupBy("term", "hash", "entity").agg(F.count("*").alias("contexts"), F.sum("n").alias("n_both")).where(F.col("contexts") >= contexts).drop("contexts"))
    n_entity = near.groupBy("entity").agg(F.sum("one").alias("n_entity")).join(both.select("entity").distinct(), "entity", "left_semi")
    n_term = _occurrences(docs, filters.build(both.select("hash").distinct()), True).groupBy("hash").agg(F.sum("n").alias("n_term"))
    total = docs.count()
    told = F.log2(F.col("n_both") * F.lit(float(total)) / (F.col("n_term") * F.col("n_entity")))
    return keep(both.join(n_entity, "entity").join(n_term, "hash").where((told >= bits) & (F.col("n_both") >= share * F.col("n_term"))).select("term", "hash").distinct())


def spans(docs: DataFrame, near: int = 5, least: int = 4, bits: float = 4.0, share: float = 0.8, contexts: int = 3) -> DataFrame:
    """(doc_id, row, base, spans), one row per row of (doc_id, row, text): arrays of (start, kind, end) in code points,
    sorted; ``spans`` adds the disclosing terms. Null and empty texts have none. A row is known by its doc_id and text
    together, so null and repeated doc_ids make no difference; no rows give no rows."""
    found = keep(_scan(docs, near, least))
    terms = disclosing(docs, found, bits, share, contexts)
    more = _occurrences(docs, filters.build(terms), False).join(terms, ["term", "hash"]).groupBy("row").agg(F.collect_set(F.struct("start", F.lit(KINDS.index("term")).alias("kind"), "end")).alias("terms"))
    every = F.array_sort(F.concat("spans", F.coalesce("terms", F.array().cast(_SPAN))))
    return found.join(more, "row", "left").select("doc_id", "row", F.col("spans").alias("base"), every.alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (as ``kind:start:end``, comma-joined), n_term.

    One row per row of ``docs``. Null and empty texts have no spans; extra columns are ignored; no rows give no rows."""
    s = spans(id_and_text(docs))
    names = F.array(*map(F.lit, KINDS))

    def joined(c: str):
        return F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(k: int):
        return F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    return s.select("doc_id", *(count(k) for k in range(4)), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"), count(4))


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of text replaced by its kind, as [EMAIL]; overlapping spans by the first one's. n_chars,
    if there is one, is counted anew where the text has changed; other columns, and texts without spans, are unchanged.
    Rows that repeat a doc_id or have none are rows of their own. Columns may have any names; no rows give no rows. Only
    rows with spans (and what a filter takes for one) are shuffled."""
    with scope():
        found = cut(spans(id_and_text(docs)).where(F.size("spans") > 0).groupBy(F.col("row").alias("key")).agg(F.first("spans").alias("spans")))

    @F.pandas_udf("string")
    def masked(text, spans):
        import pandas as pd

        out = []
        for t, x in zip(text, spans, strict=True):
            if t is None or x is None or not len(x):
                out.append(t)
                continue
            parts, low = [], 0
            for y in x:
                if y["start"] >= low:
                    parts += [t[low : y["start"]], f"[{KINDS[y['kind']].upper()}]"]
                low = max(low, y["end"])
            out.append("".join(parts) + t[low:])
        return pd.Series(out, dtype=object)

    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), row_key().alias("row"))
    may = passing(found, "key", F.col("row"))
    hit = whole.where(may).join(found, F.col("row") == F.col("key"), "left").withColumn("new", masked("whole.text", "spans"))
    told = F.col("key").isNotNull()
    values = {c: F.col(f"whole.`{c}`") for c in docs.columns}
    if "text" in values:
        values["text"] = F.when(told, F.col("new")).otherwise(values["text"])
    if "n_chars" in values:
        values["n_chars"] = F.when(told, F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(values["n_chars"])
    return whole.where(~may).select("whole.*").unionByName(hit.select(*(v.alias(c) for c, v in values.items())))
