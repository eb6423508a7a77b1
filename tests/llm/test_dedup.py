import random
import re

from pyspark.sql import functions as F

from lectern.llm import exact_dedup, ngram_join, substring_dedup
from lectern.llm.shared import components

AWKWARD = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "a  b"), (6, "ab"), (7, "a b "), (8, "x" * 300_000), (9, "x" * 300_000), (10, "é ü"), (11, "a b")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "z", 1, True, 0) for i, t in rows], "doc_id int, text string, lang string, size int, head boolean, fp int")


def test_fingerprints_compose():
    rnd = random.Random(1)
    data = bytes(rnd.randrange(256) for _ in range(200_000))
    for cut in (0, 1, 65_535, 65_536, 65_537, 199_999, 200_000):
        assert exact_dedup.combine(exact_dedup.fingerprint(data[:cut]), exact_dedup.fingerprint(data[cut:]), len(data) - cut) == exact_dedup.fingerprint(data)
    want = 0
    for b in data[:1000]:
        want = (want * exact_dedup.BASES[0] + b + 1) % exact_dedup.PRIMES[0]
    assert exact_dedup.fingerprint(data[:1000])[0] == want


def test_chunks_combine(spark):
    data = {1: b"ab" * 70_000, 2: b"", 3: b"q"}
    rows = [(d, i // 50_000, bytearray(x[i : i + 50_000])) for d, x in data.items() for i in range(0, max(1, len(x)), 50_000)]
    df = spark.createDataFrame(rows, "doc_id int, chunk_no int, data binary").repartition(3)
    for r in exact_dedup.combine_chunks(df).collect():
        a, b = exact_dedup.fingerprint(data[r.doc_id])
        assert (r.fp, r.bytes) == (a * 2**31 + b, len(data[r.doc_id]))


def test_exact(spark):
    got = {r.doc_id: r for r in exact_dedup.duplicates(frame(spark, AWKWARD)).collect()}
    assert len(got) == len(AWKWARD)
    groups = {}
    for i, t in AWKWARD:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    for members in groups.values():
        for _, i in members:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (min(members)[1], len(members), i == min(members)[1])
    assert exact_dedup.kept(frame(spark, AWKWARD)).columns == frame(spark, AWKWARD).columns
    assert exact_dedup.kept(frame(spark, AWKWARD)).count() == len(groups)
    assert exact_dedup.duplicates(frame(spark, []).limit(0)).count() == 0
    odd = frame(spark, [(None, "a"), (None, "b"), (5, "a"), (5, "c"), (6, "c"), (6, "c")])
    assert sorted((str(r.doc_id), r.group_size, r.kept) for r in exact_dedup.duplicates(odd).collect()) == [("5", 2, True), ("5", 3, True), ("6", 3, False), ("6", 3, False), ("None", 1, True), ("None", 2, False)]


def test_collision_falls_apart(spark, monkeypatch):
    # with fingerprints that say nothing, equal lengths collide and the comparison decides
    monkeypatch.setattr(exact_dedup, "fingerprint", lambda data: (1, 1))
    import pyarrow as pa

    (b,) = exact_dedup._digests(iter([pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2]), "row": pa.array([1, 2]), "text": pa.array(["aa", "bb"])})]))
    assert b["fp"][0].as_py() == b["fp"][1].as_py() and b["sha"][0] != b["sha"][1]
    rows = pa.RecordBatch.from_pydict({"fp": pa.array([2**31 + 1] * 3), "bytes": pa.array([2, 2, 2]), "salt": pa.array([0, 0, 0]), "head": pa.array([True, False, False]), "row": pa.array([1, 2, 3]), "text": pa.array(["aa", "bb", "a a"])})
    (out,) = exact_dedup._compared(iter([rows]))
    assert out.select(["row", "same"]).to_pydict() == {"row": [2, 3], "same": [False, True]}


CLASHES = "row whole i m may hash class n sketch component stays keep_id _dropped _id _row fp bytes".split()


def clashing(spark, rows):
    """Rows of (doc_id, text) with a column of every name that the operators use inside."""
    return spark.createDataFrame([(i, t, *[f"{c}!" for c in CLASHES]) for i, t in rows], "doc_id int, text string, " + ", ".join(f"{c} string" for c in CLASHES))


def test_stages_lose_no_text(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (5, a), (5, b), (None, b + " "), (None, "only " + a[:40]), (7, b), (None, "z y"), (None, "z y"), (8, ""), (8, "")]
    for f, blanks in ((exact_dedup.kept, 1), (ngram_join.representatives, 2)):
        got = f(clashing(spark, rows))
        assert got.columns == clashing(spark, rows).columns
        got = got.collect()
        assert sorted((str(r.doc_id), r.text) for r in got if r.text) == sorted([("1", a), ("None" if f is exact_dedup.kept else "5", b + " " * (f is exact_dedup.kept)), ("None", "only " + a[:40]), ("None", "z y")])
        assert sum(r.text == "" for r in got) == blanks and all(r[c] == f"{c}!" for r in got for c in CLASHES)
        maps = clashing(spark, rows).withColumn("x", F.create_map(F.lit("k"), F.lit(1)))
        assert f(maps).count() == len(got) and f(clashing(spark, []).limit(0)).count() == 0


def test_filter_holds_all_its_keys(spark):
    from lectern.llm import bloom

    for n in (0, 1, 1000, 50_000):
        bits = bloom.build(spark.range(n).select(F.xxhash64("id").alias("hash")))
        h = spark.range(2 * n).select(F.xxhash64("id").alias("hash")).toArrow()["hash"].to_numpy()
        ok = bloom.within(bits, h)
        assert ok[:n].all() and ok[n:].sum() <= 0.05 * n


def test_components(spark):
    rnd = random.Random(2)
    for _ in range(3):
        edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(20)] + [(200, i) for i in range(201, 240)]
        parent = {x: x for e in edges for x in e}

        def find(a, parent=parent):
            while parent[a] != a:
                a = parent[a]
            return a

        for a, b in edges:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
        assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def shingles(text, k):
    w = [re.sub("[A-Z]+", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, p, q):
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            n = len(sets[a] & sets[b])
            if a < b and n and q * n >= p * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_join(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = list(AWKWARD[:7])
    for size in (3, 4, 8, 12, 20, 40, 120):
        base = [rnd.choice(words) for _ in range(size)]
        for _ in range(12):
            t = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, max(1, size // 40)])):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            if rnd.random() < 0.4:
                t.append(rnd.choice(words))
            rows.append((len(rows) + 20, " ".join(t).upper() if rnd.random() < 0.3 else "  ".join(t)))
    for k, p in ((4, 85), (5, 80), (2, 85)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(frame(spark, rows), k, p, 100).collect()}
        assert got == brute(rows, k, p, 100)
    few = ngram_join.representatives(frame(spark, rows), 4, 85, 100)
    assert few.columns == frame(spark, rows).columns and few.count() == len({c for _, c in brute(rows, 4, 85, 100).values()})
    assert ngram_join.join(frame(spark, rows).limit(0)).count() == 0


def test_join_chain(spark):
    # a chain: each text is like the next, the ends aren't alike; and tiles of two force the nearest-first rounds
    base = [f"t{i}" for i in range(200)]
    rows = [(i, " ".join([f"n{j}" for j in range(4 * i)] + base[4 * i :])) for i in range(12)]
    got = {r.doc_id: r.component_id for r in ngram_join.join(frame(spark, rows), 1, 85, 100).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 1, 85, 100).items()} and set(got.values()) == {0}


def test_every_similar_pair_shares_a_signature():
    import numpy as np

    rng = np.random.default_rng(1)
    seen = 0
    for _ in range(1500):
        n = max(1, int(rng.choice([1, 2, 6, 7, 8, 10, 12, 15, 20, 30, 50, 150, 900]) * rng.uniform(0.8, 1.25)))
        s = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        d = int(rng.integers(0, int(n * 0.18) + 2))
        a = int(rng.integers(0, d + 1))
        r = np.unique(np.concatenate([np.delete(s, rng.choice(len(s), min(a, len(s) - 1), replace=False)), rng.integers(0, 2**64, d - a, dtype=np.uint64)]))
        both = len(np.intersect1d(s, r))
        if 100 * both < 85 * (len(s) + len(r) - both):
            continue
        seen += 1
        (x, px), (y, py) = ngram_join.signatures(s, 85, 100), ngram_join.signatures(r, 85, 100)
        assert set(x[px]) & set(y) or set(y[py]) & set(x)
    assert seen > 500


def test_unlike_sets_share_no_signature():
    # also very short sets, whose segments are often empty: buckets must not grow with the corpus
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (1, 3, 6, 7, 8, 10, 13, 20, 40):
        count = {}
        for _ in range(1500):
            for x in set(ngram_join.signatures(np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)), 80, 100)[0].tolist()):
                count[x] = count.get(x, 0) + 1
        assert max(count.values()) == 1


def test_sketch_distance_is_a_lower_bound():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 5, 200, 300, 5000):
        s = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        for far in (0, 1, n // 5):
            t = np.unique(np.concatenate([s[far:], rng.integers(0, 2**64, far + n // 20, dtype=np.uint64)]))
            x, y = ngram_join.sketch(s), ngram_join.sketch(t)
            size = min(len(x), len(y))
            got = np.bitwise_count(ngram_join._folded([x], size) ^ ngram_join._folded([y], size)).sum()
            true = len(np.setxor1d(s, t))
            assert got <= true and (true > n // 4 or got >= 0.6 * true)


def test_last_round_leaves_out_nothing(spark, monkeypatch):
    # a tile of more than 1,024 classes whose sketches tell nothing
    monkeypatch.setattr(ngram_join, "TILE", 2048)
    n = 1200
    of = spark.range(n).select(F.col("id").alias("class"))
    none = spark.createDataFrame([], "node long, component long")
    sketches = of.select("class", F.lit(2500).cast("long").alias("n"), F.lit(bytearray(ngram_join.SKETCH_BITS // 8)).alias("sketch"))
    rest = ngram_join._rest(of.select(F.lit(1).cast("long").alias("sig"), "class"), none, sketches, 85, 100, ngram_join.NEAREST[-1])
    assert rest.count() == n * (n - 1) // 2


def test_passages(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(5000)]
    sentence = lambda n: " ".join(rnd.choice(words) for _ in range(n)) + "."
    passage = " ".join(sentence(rnd.randint(6, 14)) for _ in range(6))
    edited = passage.split(" ")
    edited[-1] = "other."
    licence = sentence(10)
    rows = [(0, sentence(30) + " " + passage + " " + sentence(9)), (1, sentence(12) + " " + sentence(5)[:-1] + " " + passage + " " + sentence(9)), (2, " ".join(sentence(11) for _ in range(9))), (3, None), (4, ""), (5, " ".join(edited)), (6, licence + " " + sentence(12)), (7, licence + "\n" + sentence(12)), (8, sentence(20) * 2)]
    got = sorted(substring_dedup.repeats(frame(spark, rows)).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.first_doc_id, r.removed) for r in got] == [(0, 0, False), (1, 0, True), (5, 0, True)]
    for r in got:
        assert r.n_words >= 35 and rows[r.doc_id][1][r.start : r.end].split()[-2] in passage
    assert substring_dedup.repeats(frame(spark, rows).limit(0)).count() == 0


def test_near_paragraph(spark):
    base = [f"word{i}" for i in range(60)]
    near = list(base)
    near[0] = "changed"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(f"other{i}" for i in range(60)))]
    assert sorted((r.doc_id, r.first_doc_id) for r in substring_dedup.repeats(frame(spark, rows)).collect()) == [(1, 1), (2, 1)]


def test_passages_inside_sentences(spark):
    # verbatim passages of 50 words or more, put into the middle of sentences of two texts each, with and without sentence marks
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(7))
    rows, want, inside = [], [], {}
    for n in range(120):
        passage = [word() + ("." if n % 2 and rnd.random() < 0.08 else "") for _ in range(50 + n % 3)]
        for _ in range(2):
            host = [word() + ("." if rnd.random() < 0.08 else "") for _ in range(rnd.randint(40, 150))]
            at = rnd.randrange(1, len(host))
            want.append((len(rows), len(rows) // 2 * 2, bool(len(rows) % 2)))
            inside[len(rows)] = set(passage)
            rows.append((len(rows), " ".join([*host[:at], *passage, *host[at:]])))
    rows += [(len(rows) + i, " ".join(word() for _ in range(300))) for i in range(20)]
    rows += [(len(rows), "é " * 5000), (len(rows) + 1, " ".join(f"v{i}" for i in range(49))), (len(rows) + 2, " ".join(f"v{i}" for i in range(49)) + ".")]
    got = sorted(substring_dedup.repeats(frame(spark, rows)).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.first_doc_id, r.removed) for r in got if r.doc_id < 240] == want
    assert not [r for r in got if 240 <= r.doc_id < 261]
    for r in got[:240]:
        assert r.n_words >= 20 and len(set(rows[r.doc_id][1][r.start : r.end].split()) & inside[r.doc_id]) >= 20


def test_near_paragraphs_by_brute_force(spark):
    # families of paragraphs with changed words: nearly every document that has a similar paragraph elsewhere is found
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefghijkl") for _ in range(6))
    rows = []
    for _ in range(60):
        base = [word() for _ in range(rnd.randint(25, 60))]
        for _ in range(rnd.randint(2, 6)):
            t = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2])):
                t[rnd.randrange(len(t))] = word()
            rows.append((len(rows), " ".join(t)))
    rows += [(len(rows) + i, " ".join(word() for _ in range(40))) for i in range(60)]
    sets = {i: shingles(t, 5) for i, t in rows}
    near = {i for i in sets for j in sets if i != j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    got = {r.doc_id for r in substring_dedup.repeats(frame(spark, rows)).collect()}
    print("found", len(near & got), "of", len(near), "with a near paragraph; others found", len(got - near))
    assert len(near & got) >= 0.99 * len(near)
    assert not [i for i in got - near if not any(len(sets[i] & sets[j]) >= 10 for j in sets if i != j)]


def test_passages_of_odd_rows(spark):
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(1, passage), (1, passage), (1, "x " + passage), (None, passage), (2, "other words only " * 3), (3, None)]
    assert substring_dedup.repeats(frame(spark, rows)).count() == 0
    long = " ".join(f"l{i}" for i in range(60_000)) + " " + passage
    got = sorted((r.doc_id, r.first_doc_id) for r in substring_dedup.repeats(frame(spark, [*rows, (9, long), (9, long)])).collect())
    assert set(got) == {(1, 1), (9, 1)}


def _paragraph(text):
    import numpy as np

    raw = text.encode()
    return int(substring_dedup.signed(substring_dedup.paragraphs(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0])[0])


def test_near_paragraphs_behind_unlike_pivots(spark):
    # in every bucket that two similar paragraphs share, the smallest member is a paragraph unlike both
    families, text = [], {}
    for n in range(30):
        x = [f"p{n}w{i}" for i in range(40)]
        y = [*x[:-1], f"p{n}last"]
        x, y, fill = " ".join(x), " ".join(y), iter(range(10**6))
        w = x.split(" ")
        unlike = [" ".join(w[i : i + 5] + [f"p{n}f{next(fill)}"] + w[j : j + 5] + [f"p{n}f{next(fill)}"]) for i in range(0, 31) for j in range(i + 5, 36) for _ in range(6)]
        text |= {_paragraph(t): t for t in [x, y, *unlike]}
        families.append((x, y))
    buckets = {}
    for r in substring_dedup._banded(frame(spark, list(enumerate(text.values())))).collect():
        buckets.setdefault(r.sig, set()).add(r.member + 2**63)
    of = {}
    for b in buckets.values():
        for u in b:
            of.setdefault(u, []).append(b)
    for x, y in families:
        pair = {_paragraph(x), _paragraph(y)}
        shared = [b for b in of[_paragraph(x)] if pair <= b]
        if shared and all(min(b) not in pair for b in shared):
            break
    else:
        raise AssertionError("no such pair")
    rows = [(i, t) for i, t in enumerate([x, y, *(text[u] for u in {min(b) for b in shared})])]
    assert sorted((r.doc_id, r.first_doc_id) for r in substring_dedup.repeats(frame(spark, rows)).collect()) == [(0, 0), (1, 0)]


def test_oracle(spark):
    from lectern.llm.queries import ORACLES, QUERIES
    from tests.oracle import check

    for name, sql in ORACLES.items():
        assert check(QUERIES[name](spark, "/root/testdata/sf0.001"), sql, "/root/testdata/sf0.001") == 200


def test_ids_stay_longs(spark):
    assert dict(exact_dedup.duplicates(frame(spark, AWKWARD)).dtypes)["doc_id"] == "bigint"
    assert F is not None
