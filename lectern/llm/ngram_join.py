"""Exact Jaccard self-join of word n-gram sets by universe partition and the pigeonhole principle.

Two sets of sizes a and b with 100 * I >= P * U differ in at most H = (Q - P) * (a + b) / (Q + P) tokens. The hash space of
the tokens is cut into m segments, m fixed by the size band, and a set is seen as its m segment subsets. If every segment
has v = 1, some of m > H segments must be equal; if v = 2, a segment subset is also indexed under its one-deletion
neighbours, and m > H / 2 segments do. ``allocation`` picks v and m of each band by their cost: the number of signatures,
under the condition that few sets (RARE) have segments too small to tell anything, of which ``slack`` are allowed for. A set
with more is indexed in a second partition of the hash space as well, and so on: a pair is only lost to a partition if both
its sets have too many, and in the last of LEVELS partitions such sets index their empty segments too, so nothing is lost.

Texts with equal sets are one class from the start. Signatures are 8 bytes beside 8 bytes of class. In each bucket only
links to one pivot become candidates, so the count is linear; what a pivot can't tell, members of one bucket that the
verified links leave in different components, is compared in tiles of bounded size. All candidates pass parity sketches
first, four bits or more for each token, whose distance is a lower bound: what is left is nearly all links, so few texts
move. Every link is verified on the whole texts, and no pair twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import ceil, comb, exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import mix, shingle_sets, signed
from .shared import components, cut, id_and_text, keep, one_of_each, passing, scope

_U = np.uint64
#: The share of a band's sets that may have more small segments than allowed for.
RARE = 1e-4
#: Partitions of the hash space for sets with many small segments.
LEVELS = 8
#: Pairs checked against one copy of a pivot's text; members of one tile; bits of a parity sketch at least.
SALT_ROWS, TILE, SKETCH_BITS = 256, 1024, 256
#: Nearest members by sketch that are compared in each round; None leaves out nothing, however full a tile is.
NEAREST = (2, 32, None)
#: Classes that a task remembers to have indexed, and rows to an output batch.
SEEN, BATCH = 1 << 20, 1 << 17


@cache
def bands(p: int, q: int) -> list[int]:
    """Lower bounds of the size bands: a ratio of (q/p)**2, and single sizes as long as those are less than one apart."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * q * q // (p * p)))
    return out


@cache
def allocation(band: int, p: int, q: int) -> tuple[int, int, int]:
    """(m, v, slack) of the pairs whose smaller set is in the band; the cheaper of plain and one-deletion indexing."""
    low, high = bands(p, q)[band], bands(p, q)[band + 1] - 1
    most = (q - p) * (high + high * q // p) // (q + p)
    options, next_best = [], []
    for v in (1, 2):
        need = ceil((most + 1) / v)
        for slack in range(0, 4 + need):
            m = need + slack
            rate = low / m
            small = float(low < v) if m == 1 else exp(-rate) * (1 + rate * (v - 1))
            few = sum(comb(m, i) * small**i * (1 - small) ** (m - i) for i in range(slack + 1)) if m < 400 else _normal_tail(m, small, slack)
            next_best.append((-few, m, v, slack))
            if few >= 1 - RARE:
                options.append((m if v == 1 else m + low, m, v, slack))
                break
    return min(options or next_best)[1:]


def _normal_tail(m: int, small: float, slack: int) -> float:
    mean = m * small
    return 1.0 if slack >= mean + 4 * (mean + 1) ** 0.5 else 0.0


def groups_of(n: int, p: int, q: int) -> list[int]:
    """The bands of the smaller set of any pair that a set of n tokens can be in."""
    b = bands(p, q)
    k = int(np.searchsorted(b, n, "right")) - 1
    out = [k]
    while k > 0 and (b[k] - 1) * q >= p * n:
        k -= 1
        out.append(k)
    return out


def signatures(s: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, whether a segment subset itself and not a one-deletion neighbour) of a sorted set of hashes."""
    sigs, plain = [], []
    for k in groups_of(len(s), p, q):
        m, v, slack = allocation(k, p, q)
        tokens = s
        for level in range(LEVELS):
            if level:
                tokens = np.sort(mix(tokens ^ _U(0xD1342543DE82EF95)))
            value = mix(tokens ^ _U(0xD6E8FEB86659FD93))
            seg = ((tokens >> _U(32)) * _U(m)) >> _U(32)
            first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            at, size = seg[first], np.diff(np.append(first, len(s)))
            total = np.add.reduceat(value, first)
            salt = _U(((k * LEVELS + level + 1) * 0x9FB21C651E98DF25) & (2**64 - 1))
            rare = m - len(at) + (int((size == 1).sum()) if v == 2 else 0) > slack
            last = rare and level == LEVELS - 1
            sigs.append(mix(total + mix(at * _U(2) + _U(1) + salt) + size.astype(np.uint64)))
            plain.append(np.ones(len(at), bool))
            if v == 2:
                own = np.repeat(np.arange(len(at)), size)
                d = np.ones(len(s), bool) if last else size[own] > 1
                own = own[d]
                sigs.append(mix(total[own] - value[d] + mix(at[own] * _U(2) + _U(1) + salt) + (size[own] - 1).astype(np.uint64)))
                plain.append(np.zeros(len(own), bool))
            if last:
                empty = np.setdiff1d(np.arange(m, dtype=np.uint64), at)
                sigs.append(mix(mix(empty * _U(2) + _U(1) + salt)))
                plain.append(np.ones(len(empty), bool))
            if not rare:
                break
    return np.concatenate(sigs), np.concatenate(plain)


def _class(s: np.ndarray) -> int:
    """63 bits that stand for a set."""
    total = int(mix(s ^ _U(0xA0761D6478BD642F)).sum(dtype=np.uint64)) + len(s) * 0xE7037ED1A0B428DB
    return int(mix(np.array([total & (2**64 - 1)], np.uint64))[0]) >> 1


def _rows(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names=names)


def sketch(s: np.ndarray) -> bytes:
    """Bit i is the parity of the tokens that hash to i; two sketches differ in no more bits than the sets in tokens. The
    number of bits is a power of two, of four times the set's size at least; one with more folds to one with fewer."""
    bits = max(SKETCH_BITS, 1 << (4 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def _folded(sketches: list[bytes], size: int) -> np.ndarray:
    """A row of 64-bit words for each sketch, folded to ``size`` bytes."""
    out = np.empty((len(sketches), size // 8), np.uint64)
    length = np.array([len(x) for x in sketches])
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        words = np.frombuffer(b"".join(sketches[i] for i in at), np.uint64).reshape(len(at), n // size, size // 8)
        out[at] = np.bitwise_xor.reduce(words, 1)
    return out


def sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, row, class, n, sketch): equal sets have equal classes; a text without words has n = 0 and class 0. docs: (doc_id, row, text)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [(_class(s), len(s), sketch(s)) if len(s) else (0, 0, None) for _, s in shingle_sets(b["text"], k)]
            c, n, bits = zip(*x, strict=True) if x else ((), (), ())
            yield _rows(["doc_id", "row", "class", "n", "sketch"], b["doc_id"], b["row"], c, n, pa.array(bits, pa.binary()))

    return docs.select("doc_id", "row", "text").mapInArrow(hashed, "doc_id long, row long, class long, n long, sketch binary")


def _index(docs: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """(sig, member): member is the class, less 2**63 where the signature is a segment subset itself."""

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        out: list[tuple] = []
        held = 0
        for b in batches:
            for _, s in shingle_sets(b["text"], k):
                if not len(s) or (c := _class(s)) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(c)
                sig, plain = signatures(s, p, q)
                out.append((signed(sig), np.where(plain, c - 2**63, c)))
                held += len(sig)
                if held >= BATCH:
                    yield _rows(["sig", "member"], np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out]))
                    out, held = [], 0
        if out:
            yield _rows(["sig", "member"], np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out]))

    return docs.select("text").mapInArrow(indexed, "sig long, member long")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (sig, member), (sig, a, b): each other class b of a bucket beside its pivot a; the signature is
    null in buckets of two, of which no more can be learnt. A bucket is never held: what is open passes to the next batch
    as at most its first rows."""
    open_sig, pivot, last, count = None, 0, None, 0
    wait: tuple | None = None  # the one link of a bucket that may still be of two
    for b in batches:
        if not b.num_rows:
            continue
        sig, member = b["sig"].to_numpy(), b["member"].to_numpy()
        cls = np.where(member < 0, member + np.int64(-(2**63)), member)
        new = np.append(sig[0] != open_sig, sig[1:] != sig[:-1])
        same = np.append(not new[0] and cls[0] == last, cls[1:] == cls[:-1]) & ~new
        starts = np.flatnonzero(new)
        run = np.cumsum(new) - 1  # -1: of the open bucket
        heads = np.where(member[starts] < 0, cls[starts], np.int64(-1)) if len(starts) else np.zeros(0, np.int64)
        base = np.append(heads, pivot)[run]  # [-1] is the open one
        link = ~new & ~same & (base >= 0) & (cls != base)
        at = np.flatnonzero(link)
        r = run[at]
        of = np.bincount(r + 1, minlength=len(starts) + 1)
        of[0] += count
        alone = of[r + 1] == 1
        tail = len(starts)  # the bucket that stays open, counted from 1
        out = [(sig[at], base[at], cls[at], alone)]
        hold = alone & (r + 1 == tail)
        if wait is not None:
            if of[0] > 1 or tail:
                out.insert(0, (*(np.array([x], np.int64) for x in wait), np.array([of[0] == 1])))
                wait = None
        keep = [(s[m], x[m], y[m], z[m]) for s, x, y, z in out for m in [np.ones(len(s), bool)]]
        if hold.any():
            i = int(np.flatnonzero(hold)[0])
            s, x, y, z = keep[-1]
            m = np.arange(len(s)) != i
            wait = (s[i], x[i], y[i])
            keep[-1] = (s[m], x[m], y[m], z[m])
        open_sig, last = sig[-1], cls[-1]
        pivot = base[-1]
        count = int(of[tail])
        s, x, y, z = (np.concatenate([v[j] for v in keep]) for j in range(4))
        yield _rows(["sig", "a", "b"], pa.array(s, pa.int64(), mask=z.astype(bool)), x, y)
    if wait is not None:
        yield _rows(["sig", "a", "b"], pa.array([None], pa.int64()), [wait[1]], [wait[2]])


def _texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(row, text) of the rows in ``rows`` (row), one of each. A filter of bounded size leaves most others out of the shuffle;
    what passes by chance falls to the join."""
    return docs.where(passing(rows, "row", docs["row"])).groupBy("row").agg(F.first("text").alias("text"))


def verify(pairs: DataFrame, heads: DataFrame, docs: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """(u, v): the pairs (a, b) of classes whose sets have q * I >= p * U, by the texts of their rows in ``heads`` (class, row).

    Texts are dealt by pivot and salt; a pivot's text goes once to each of its salts.
    """
    count = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_ROWS).alias("salts"))
    dealt = pairs.join(count, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"))
    need = dealt.select("a", "salt", F.col("b").alias("class"), F.lit(False).alias("head")).unionByName(count.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.col("a").alias("class"), F.lit(True).alias("head")))
    need = keep(need.join(heads.select("class", "row"), "class"))
    rows = need.join(_texts(docs, need.select("row").distinct()), "row").repartition("a", "salt").sortWithinPartitions("a", "salt", F.desc("head"))

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for b in batches:
            u, v = [], []
            for (i, s), first, a, c in zip(shingle_sets(b["text"], k), b["head"].to_pylist(), b["a"].to_pylist(), b["class"].to_pylist(), strict=True):
                if first:
                    head = s
                else:
                    both = len(np.intersect1d(head, s, assume_unique=True))
                    if q * both >= p * (len(head) + len(s) - both):
                        u.append(a)
                        v.append(c)
            yield _rows(["u", "v"], u, v)

    return rows.select("a", "head", "class", "text").mapInArrow(checked, "u long, v long")


def _sketches(texts: DataFrame, k: int) -> DataFrame:
    """(class, n, sketch) of (class, text)."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [s for _, s in shingle_sets(b["text"], k)]
            yield _rows(["class", "n", "sketch"], b["class"], [len(s) for s in own], pa.array([sketch(s) for s in own], pa.binary()))

    return texts.mapInArrow(sketched, "class long, n long, sketch binary")


def _buckets(stars: DataFrame) -> DataFrame:
    """(sig, class): the buckets of three classes or more, one of those that have the same members."""
    deep = stars.where("sig is not null")
    members = deep.select("sig", F.col("b").alias("class")).unionByName(deep.select("sig", F.col("a").alias("class"))).repartition("sig").distinct()
    hashed = F.xxhash64("class")
    same = members.groupBy("sig").agg(F.count("*").alias("n"), F.sum(F.shiftright(hashed, 8)).alias("h"), F.bit_xor(hashed).alias("x")).groupBy("n", "h", "x").agg(F.min("sig").alias("sig"))
    return members.join(same.select("sig"), "sig")


def _rest(buckets: DataFrame, belongs: DataFrame, sketches: DataFrame, p: int, q: int, most: int | None) -> DataFrame:
    """(a, b): pairs of one bucket in different components that sizes and sketches leave possible; of each member at most
    the ``most`` nearest by sketch in each tile. ``most`` = None leaves out nothing; a row of -1 says that something was.
    """
    named = buckets.join(belongs.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    mixed = named.groupBy("sig").agg(F.ceil(F.count("*") / TILE).alias("tiles"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("sig", "tiles")
    tiled = named.join(mixed, "sig").join(sketches.select("class", "n", "sketch"), "class").withColumn("tile", F.pmod(F.xxhash64("class"), F.col("tiles")))
    both = tiled.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).select(
        "sig", F.least("tile", "other").alias("t0"), F.greatest("tile", "other").alias("t1"), (F.col("tile") <= F.col("other")).alias("left"), (F.col("tile") == F.col("other")).alias("own"), "class", "component", "n", "sketch"
    )

    def compared(group: pa.Table) -> pa.Table:
        left = np.array(group["left"].to_pylist(), bool)
        own = bool(group["own"][0].as_py())
        cls, comp, n = (group[c].to_numpy() for c in ("class", "component", "n"))
        bits = group["sketch"].to_pylist()
        size = np.array([len(x) for x in bits])
        # by size of the smaller sketch: the members with one of that size or more, and each member's place among them
        levels = {int(x): (_folded([bits[i] for i in at], int(x)), np.searchsorted(at, np.arange(len(cls)))) for x in np.unique(size) for at in [np.flatnonzero(size >= x)]}
        i, j = (np.arange(len(cls)),) * 2 if own else (np.flatnonzero(left), np.flatnonzero(~left))
        a, b, short = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], False
        names, sizes = np.unique(comp, return_counts=True)
        main = names[np.argmax(sizes)]
        # what is outside the largest component against all; within it nothing is left to learn
        for r, c in ((i[comp[i] != main], j), (j[comp[j] != main], i[comp[i] == main])) if not own else ((i[comp[i] != main], j),):
            for x in r:
                o = c[(comp[c] != comp[x]) & (np.minimum(n[c], n[x]) * q >= p * np.maximum(n[c], n[x]))]
                far = np.zeros(len(o), np.int64)
                for level, (words, place) in levels.items():
                    if level <= size[x] and (m := np.minimum(size[o], size[x]) == level).any():
                        far[m] = np.bitwise_count(words[place[o[m]]] ^ words[place[x]]).sum(1, dtype=np.int64)
                ok = far * (p + q) <= (q - p) * (n[o] + n[x])
                o, far = o[ok], far[ok]
                if most is not None and len(o) > most:
                    o = o[np.argsort(far, kind="stable")[:most]]
                    short = True
                a.append(np.minimum(cls[o], cls[x]))
                b.append(np.maximum(cls[o], cls[x]))
        a, b = ([*x, np.full(1, -1)] if short else x for x in (a, b))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return both.groupBy("sig", "t0", "t1").applyInArrow(compared, "a long, b long").distinct()


def _plausible(pairs: DataFrame, sketches: DataFrame, p: int, q: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches leave possible."""
    left = pairs.join(sketches.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
    both = left.join(sketches.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b").where((F.least("na", "nb") * q) >= (F.greatest("na", "nb") * p)).select("a", "b", "na", "nb", "sa", "sb")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b["sa"].to_pylist(), b["sb"].to_pylist()
            size = np.array([min(len(i), len(j)) for i, j in zip(x, y, strict=True)], np.int64)
            far = np.zeros(b.num_rows, np.int64)
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                far[at] = np.bitwise_count(_folded([x[i] for i in at], int(n)) ^ _folded([y[i] for i in at], int(n))).sum(1, dtype=np.int64)
            ok = pa.array(far * (p + q) <= (q - p) * (b["na"].to_numpy() + b["nb"].to_numpy()))
            yield _rows(["a", "b"], b["a"].filter(ok), b["b"].filter(ok))

    return both.mapInArrow(kept, "a long, b long")


def settled(buckets: DataFrame, told: DataFrame, links: DataFrame, sketches: DataFrame, p: int, q: int, check) -> DataFrame:
    """(node, component) once no pair of a bucket is open. told: the pairs (a, b) that were checked, of which ``links`` (u, v)
    held; ``check`` gives the links among further pairs.

    The nearest go first, as what they link needs no further comparison; it ends with a round that left out nothing.
    """
    belongs = components(links)
    for most in NEAREST:
        found = cut(_rest(buckets, belongs, sketches, p, q, most).join(told.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))
        rest, whole = found.where("a >= 0"), found.where("a < 0").isEmpty()
        if not rest.isEmpty():
            told = told.unionByName(rest)
            links = cut(links.unionByName(check(rest)))
            belongs = components(links)
        if whole:
            break
    return belongs


def _components(docs: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """(doc_id, row, n, component): of each row of (doc_id, row, text), its set's size and the class that names its component."""
    own = keep(sets(docs, k))
    stars = cut(_index(docs, k, p, q).repartition("sig").sortWithinPartitions("sig", "member").mapInArrow(_stars, "sig long, a long, b long").distinct())
    # each pair once, a pivot first
    once = stars.groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.max(F.col("a") < F.col("b")).alias("ahead"))
    pairs = once.select(F.when(F.col("ahead"), F.col("low")).otherwise(F.col("high")).alias("a"), F.when(F.col("ahead"), F.col("high")).otherwise(F.col("low")).alias("b"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    heads = keep(own.where("n > 0").groupBy("class").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("sketch").alias("sketch")).join(wanted, "class"))
    told = cut(_plausible(pairs, heads, p, q))
    links = cut(verify(told, heads, docs, k, p, q))
    belongs = settled(cut(_buckets(stars)), told, links, heads, p, q, lambda rest: verify(rest, heads, docs, k, p, q))
    heads.unpersist()
    named = own.where("n > 0").join(belongs.withColumnRenamed("node", "class"), "class", "left")
    return named.select("doc_id", "row", "n", F.coalesce("component", "class").alias("component")).unionByName(own.where("n = 0").select("doc_id", "row", "n", F.lit(None).cast("long").alias("component")))


def join(docs: DataFrame, k: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    A document's set: the distinct k-word shingles of its text, lower-cased A-Z, words being runs without
    [\\x20\\x09-\\x0D]; with fewer words the whole sequence as one. Documents link when q * I >= p * U; component_id is
    the smallest doc_id reachable by links. Null, empty and blank texts have no shingles and link with nothing. Rows that
    repeat a doc_id are documents of their own; a null doc_id is never the smallest, and the component_id of rows that
    reach no other is null. Extra columns are ignored; no rows give no rows.
    """
    named = _components(id_and_text(docs), k, p, q)
    linked = named.where("component is not null")
    first = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return linked.join(first, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(named.where("component is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def representatives(docs: DataFrame, k: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """``docs`` with one row of each component, one with the smallest doc_id; all columns, unchanged.

    Rows without words stay. A null doc_id stays only where its component has no other; of rows with the same doc_id the
    one with the larger hash of its text stays, and of equal rows one. Columns may have any names; no rows give no rows.
    """
    with scope():
        named = keep(_components(id_and_text(docs), k, p, q).where("component is not null"))
        first = named.groupBy("component").agg(F.count("*").alias("size"), F.max(F.struct((-F.col("doc_id")).alias("id"), "row")).alias("best")).where("size > 1")
        members = named.join(first, "component").select("row", "doc_id", (F.col("doc_id").eqNullSafe(-F.col("best.id")) & (F.col("row") == F.col("best.row"))).alias("stays"))
        return one_of_each(docs, members)
