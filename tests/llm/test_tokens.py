import random
import zlib

import numpy as np
import pytest

from lectern.llm import lattice, packing, token_counts
from lectern.llm.tokenizer import encode, public

RANKS, VOCABULARY, PIECES = public("byte_bpe_50k.tiktoken"), public("byte_bpe_50k.json"), public("piece_bpe_32k.model")
TEXTS = [None, "", " ", "\n\n\n", "Hello, world! A second sentence.\nA line.", "é ü 中文 😀 <|endoftext|>", "a" * 3000, " " * 5000 + "x", "1234567890 " * 400, "one two three. " * 3000, "naïve\x00\x07\t tabs"]


def docs(spark, texts=None):
    return spark.createDataFrame([(i, t, i, 0, "x") for i, t in enumerate(TEXTS if texts is None else texts)], "doc_id int, text string, start int, file int, ids string")


def library(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [t or "" for t in TEXTS])
def test_ids_are_the_library_s(text):
    assert encode(RANKS, VOCABULARY, text).tolist() == library(text)


def test_packing(spark):
    rows = packing.pack(docs(spark)).collect()
    ids = {i: library(t or "") + [0] for i, t in enumerate(TEXTS)}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.length > 0 and r.ids_crc32 == zlib.crc32(piece.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    assert set(by_doc) == set(ids)
    for d, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == len(ids[d])
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
    assert packing.pack(docs(spark).limit(0)).count() == 0


def test_plan_is_least():
    rnd = random.Random(6)
    for _ in range(200):
        n, size = rnd.randint(1, 40), rnd.randint(3, 12)
        ends = np.array([rnd.random() < 0.3 for _ in range(n)])
        at, cost = packing.candidates(ends, np.array([n]), rnd.randint(1, 3), 1.0, 3.0)
        best = {0: 0.0}
        price = dict(zip(at.tolist(), cost.tolist(), strict=True))
        for j in at[1:].tolist():
            best[j] = min(best[i] + size - (j - i) for i in best if j - i <= size) + price[j]
        cuts = packing.plan(at, cost, size)
        told = sum(size - (b - a) + price[b] for a, b in zip([0, *cuts], cuts, strict=False))
        assert cuts[-1] == n and abs(told - best[n]) < 1e-9


def test_little_padding(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").coalesce(1)
    r = packing.pack(d).groupBy("sequence_id").sum("length").collect()
    assert sum(x[1] for x in r) > 0.98 * 1024 * (len(r) - 1)


def test_blocks_change_nothing_but_cuts(spark):
    small = packing.pack(docs(spark), block=4096).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in small} == {i: len(library(t or "")) + 1 for i, t in enumerate(TEXTS)}


def test_counts(spark, tmp_path):
    got = {r.doc_id: r.n_tokens for r in token_counts.document_counts(docs(spark)).collect()}
    assert got == {i: len(library(t or "")) for i, t in enumerate(TEXTS)}
    assert token_counts.document_counts(docs(spark).limit(0)).count() == 0


@pytest.mark.parametrize("width,kind", [(2, "<u2"), (4, "<u4")])
def test_flat_files(spark, tmp_path, width, kind):
    rng = np.random.default_rng(0)
    want = {}
    for f in range(3):
        sizes = [int(v) for v in rng.integers(0, 700, 40)]
        tail = rng.integers(1, 5000, 13 * (f != 1))
        np.concatenate([np.append(rng.integers(0, 50000, n), 50256) for n in sizes] + [tail]).astype(kind).tofile(tmp_path / f"{f}.bin")
        want[f] = sizes + [13] * (f != 1)
    (tmp_path / "empty.bin").touch()
    (tmp_path / "odd.bin").write_bytes(b"\x01")
    r = token_counts.counts(token_counts.blocks(spark, str(tmp_path / "*.bin"), width, 256), width=width).orderBy("file", "ordinal").toPandas()
    assert {int(f.rsplit("/", 1)[1][0]): list(g.n_tokens) for f, g in r.groupby("file")} == want
    assert [int(x) for x in r.groupby("file").start.min()] == [0, 0, 0] and int((~r.ended).sum()) == 2


def test_lattice(spark):
    m = lattice.model(PIECES)
    got = {r.doc_id: r for r in lattice.encode(docs(spark), count=200).collect()}
    for i, t in enumerate(TEXTS):
        assert list(got[i].ids) == m.encode(t or "") and got[i].decodes and got[i].n_tokens == len(got[i].ids)
    back = lattice.decode(lattice.encode(docs(spark), count=200)).collect()
    assert {r.doc_id: r.text for r in back} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert lattice.encode(docs(spark).limit(0)).count() == 0


def test_folds_agree(spark):
    rnd = random.Random(8)
    units = list({"▁" + "".join(rnd.choice(["th", "er", "on", "ñ", "tion", "Ж", "x", "1"]) for _ in range(rnd.randint(1, 5))) for _ in range(150)} | {"▁▁▁", "▁", "a"})
    table = lattice.pieces(PIECES)
    known = lattice._Known({}, PIECES)
    df = spark.createDataFrame([(u,) for u in units], "unit string")
    for r in lattice.merges(lattice.edges(df, lattice.piece_table(spark, PIECES), 16)).collect():
        assert r.cuts == lattice.fold(r.unit, table)
        cuts = [0]
        for p in known.joined(r.unit):
            cuts.append(cuts[-1] + len(p))
        assert cuts == r.cuts


def test_viterbi(spark):
    toy = {"a": -1.0, "b": -1.5, "ab": -2.2, "abc": -3.0, "c": -1.2, "bc": -1.0, "ca": -1.1}
    units = ["abc", "abcab", "cxab", "a", "cabc"]
    got = lattice.viterbi(lattice.edges(spark.createDataFrame([(u,) for u in units], "unit string"), spark.createDataFrame(list(toy.items()), "piece string, score double"), 3)).collect()

    def score(u, cuts):
        return sum(toy.get(u[i:j], -100.0) for i, j in zip(cuts, cuts[1:], strict=False))

    def best(u):
        return max(([0, *(i for i in range(1, len(u)) if m >> i & 1), len(u)] for m in range(0, 1 << len(u), 2)), key=lambda c: score(u, c) if all(u[i:j] in toy or j - i == 1 for i, j in zip(c, c[1:], strict=False)) else -1e9)

    for r in got:
        assert abs(score(r.unit, r.cuts) - score(r.unit, best(r.unit))) < 1e-9
