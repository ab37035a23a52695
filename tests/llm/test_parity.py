import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lotusgrid.llm import content, parity


@settings(max_examples=60)
@given(st.sets(st.integers(0, 2**32 - 1), max_size=80), st.sets(st.integers(0, 2**32 - 1), max_size=80), st.sets(st.integers(0, 2**32 - 1), max_size=80))
def test_hamming_distance_never_exceeds_the_difference(common, a, b):
    x, y = (np.array(sorted(common | s), dtype=np.uint32) for s in (a, b))
    p, q = (np.frombuffer(parity.bit_sketch(s, 256), np.uint8) for s in (x, y))
    assert int(np.bitwise_count(p ^ q).sum()) <= len(set(x.tolist()) ^ set(y.tolist()))


def test_equal_sets_have_equal_parts():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 2**32, 300, dtype=np.uint32))
    b = np.unique(np.concatenate([a[5:], rng.integers(0, 2**32, 5, dtype=np.uint32)]))
    who, keys = parity.part_sketches([a, b, a, a[:0]], 0.5)
    of = [set(keys[who == k].tolist()) for k in range(4)]
    assert of[0] == of[2] and len(of[0] & of[1]) > 300 and not of[3] and len(of[0]) == parity.n_groups(0.5) * parity.SHARED
    parts = [parity.part_sketches([a, b], 0.5, k, parity.ROUNDS) for k in range(parity.ROUNDS)]
    assert len({x for w, k in parts for x in k[w == 1].tolist()}) == len(of[1])


def brute(rows, least=0.5):
    m = content.Model.load()
    got = content.content_of([r[1] for r in rows], [r[2] for r in rows], m)
    sets = {}
    for r, g in zip(rows, got):
        w = parity.WORD.findall("\n".join(s for _, s in g).lower())
        if r[0] is not None and len(w) >= 3:
            sets.setdefault(r[0], set()).update({tuple(w[i : i + 3]) for i in range(len(w) - 2)})
    ks = sorted(sets)
    return {(a, b) for i, a in enumerate(ks) for b in ks[i + 1 :] if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def article(rng, n=12):
    words = [f"từ{k}" for k in range(400)]
    return ["Xe tải đâm vào xe máy ở " + " ".join(rng.choice(words, 20)) + "." for _ in range(n)]


def test_copies_edits_and_dirty_rows(spark):
    rng = np.random.default_rng(4)
    base = [article(rng) for _ in range(25)]
    rows = [(k, "https://a.example/", "\n".join(b)) for k, b in enumerate(base)]
    rows += [(100 + k, "https://b.example/", "\n".join(b[1:])) for k, b in enumerate(base)]  # one paragraph less
    rows += [(200 + k, "https://c.example/", "\n".join(base[0])) for k in range(40)]  # many copies
    rows += [(300, "u", None), (301, "u", ""), (302, "u", "một"), (None, "u", "\n".join(base[0])), (0, "https://a.example/", "\n".join(base[0]))]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "record_id long, url string, body string, rec int, cls string").repartition(6)
    got = [tuple(r) for r in parity.near_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    classes = {r.record_id: (r.class_id, r.n_links) for r in parity.near_classes(df).collect()}
    assert classes[239] == classes[0] == (0, 1) and classes[101] == (101, 1) and len(classes) == 90
    assert parity.near_pairs(df.limit(0)).count() == 0


def test_found_query_against_brute_force(spark, sf):
    import __spark_entry__ as entry

    at = sf.replace("0.001", "0.01")
    rows = [tuple(r) for r in spark.read.parquet(f"{at}/manifest.parquet").select("record_id", "url", "body").collect()]
    want = brute(rows)
    got = {tuple(r) for r in entry.queries()["p2_found"](spark, at).collect()}
    assert got <= want and len(got) >= 0.99 * len(want) > 50


def test_record_ids_with_different_bodies(spark):
    rng = np.random.default_rng(5)
    x, y = article(rng), article(rng)
    rows = [(1, "u", "\n".join(x)), (1, "u", "\n".join(x[1:])), (2, "u", "\n".join(x)), (1, "u", "\n".join(y)), (3, "u", "\n".join(y)), (1, "u", "\n".join(x))]
    df = spark.createDataFrame(rows, "record_id long, url string, body string").repartition(4)
    assert sorted(tuple(r) for r in parity.near_pairs(df).collect()) == [(1, 2), (1, 3)]
    named = df.selectExpr("'r' || record_id as record_id", "url", "body")
    assert sorted(tuple(r) for r in parity.near_pairs(named).collect()) == [("r1", "r2"), ("r1", "r3")]
    assert sorted((r.class_id, r.n_links) for r in parity.near_classes(df).collect()) == [(1, 0), (1, 0), (1, 1), (1, 1), (1, 1)]


def test_links_of_edited_sets_of_every_size_are_whole(spark):
    rng = np.random.default_rng(9)
    sets = []
    for n in (1, 2, 3, 5, 9, 24, 33, 67, 135, 270, 1000):
        for k in range(30):
            pool = rng.choice(2**32, 2 * n, replace=False).astype(np.uint32)
            common = round(n * (2 / 3, 0.71, 0.79)[k % 3]) or 1  # similarity 0.5, 0.55 and 0.65
            sets += [np.unique(pool[:n]), np.unique(np.concatenate([pool[:common], pool[n : 2 * n - common]]))]
    sets += [np.unique(np.concatenate([sets[0], rng.choice(2**32, 40).astype(np.uint32), sets[-1][:k]])) for k in (0, 200)]
    links = lambda a, b: len(np.intersect1d(a, b)) >= 0.5 * len(np.union1d(a, b))
    want = {(i, j) for i, a in enumerate(sets) for j in range(i + 1, len(sets)) if links(a, (b := sets[j])) and len(a) and len(b)}
    rows = [(i, 7, len(x), x.tobytes()) for i, x in enumerate(sets)]
    df = spark.createDataFrame(rows, "c1 long, c2 long, n int, runs binary").repartition(3)
    for how in ("parts", "prefix"):
        got = [(r.c1_a, r.c1_b) for r in parity.class_links(df, candidates=how).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 200
        assert parity.class_links(df.limit(0), candidates=how).count() == 0


def test_chance_pairs_of_one_domain_are_not_written(spark, monkeypatch):
    rng = np.random.default_rng(7)
    stock, sets = rng.choice(2**32, 150, replace=False).astype(np.uint32), []
    for _ in range(1000):  # two of these share a tenth of their runs
        sets.append(np.unique(np.concatenate([rng.choice(stock, 40, replace=False), rng.integers(0, 2**32, 20, dtype=np.uint32)])))
    near = [(k, 1000 + k) for k in range(40)]
    sets += [np.unique(np.concatenate([sets[k][6:], rng.integers(0, 2**32, 6, dtype=np.uint32)])) for k, _ in near]
    written, cut = {}, parity.cut

    def counted(df, name):
        out = cut(df, name)
        written[name] = written.get(name, 0) + out.select("a", "b").distinct().count() if name in ("parity-met", "parity-near") else 0
        return out

    monkeypatch.setattr(parity, "cut", counted)
    df = spark.createDataFrame([(i, 7, len(x), x.tobytes()) for i, x in enumerate(sets)], "c1 long, c2 long, n int, runs binary").repartition(3)
    for hot in (parity.HOT, 1):  # keys of more than ``hot`` sets meet in a join
        monkeypatch.setattr(parity.meet, "__defaults__", (hot, *parity.meet.__defaults__[1:]))
        written.clear()
        got = sorted((r.c1_a, r.c1_b) for r in parity.class_links(df).collect())
        assert got == near and written["parity-near"] <= 2 * len(near)
        assert hot == 1 or written["parity-met"] <= parity.ROUNDS * 2 * len(near)


def test_marks_part_no_more_pairs_than_counted():
    rng = np.random.default_rng(8)
    places = parity.n_groups(0.5) // parity.ROUNDS * parity.PART
    limit, stray = parity.mark_limit(0.5, places)
    assert 0.02 < stray <= parity.STRAY and parity.mark_limit(1.0, places) == (0, 0.0)
    sets = []
    for k in range(400):
        pool = rng.choice(2**32, 160, replace=False).astype(np.uint32)
        sets += [np.unique(pool[:120]), np.unique(pool[40:])]  # similarity 0.5
    who, _, marks = parity.marked_parts(sets, 0.5, 1, parity.ROUNDS)
    of = np.array([marks[np.flatnonzero(who == i)[0]] for i in range(len(sets))])
    differ = np.bitwise_count(of[::2] ^ of[1::2]).sum(axis=1)
    unlike = np.bitwise_count(of[:-2:2] ^ of[2::2]).sum(axis=1)
    assert abs((differ > limit).mean() - stray) < 0.04 and (unlike > limit).all()


def test_share_of_pairs_that_parts_lose():
    groups = parity.n_groups(0.5)
    assert parity.lost(0.5, groups) <= parity.MISS == 1e-6 < parity.lost(0.5, groups - parity.ROUNDS)
    assert parity.n_groups(1.0) == parity.ROUNDS
    rng = np.random.default_rng(5)
    for n in (3, 24, 135):
        agree = []
        for _ in range(100):
            pool = rng.choice(2**32, 4 * n // 3, replace=False).astype(np.uint32)  # similarity 0.5
            got = 0
            for turn in range(parity.ROUNDS):
                who, keys = parity.part_sketches([np.unique(pool[:n]), np.unique(pool[n // 3 :])], 0.5, turn, parity.ROUNDS)
                got += len(np.intersect1d(keys[who == 0], keys[who == 1]))
            agree.append(got)
        assert min(agree) > 0 and abs(np.mean(agree) / (groups * parity.SHARED) - 0.5**parity.PART) < 0.01


def test_sets_of_a_key_meet_in_pieces_and_hot_keys_go_on():
    rng = np.random.default_rng(3)
    sizes = [1, 2, 5, 1, 40, 3, 100, 1, 60, 2]
    key = np.repeat(np.arange(len(sizes)), sizes).astype(np.uint64)
    c = rng.permutation(len(key)).astype(np.int64)
    c[1] = c[2]  # a set that has a key twice
    order = rng.permutation(len(key))
    want = {(min(x, y), max(x, y)) for k, n in enumerate(sizes) if n <= 50 for x in c[key == k].tolist() for y in c[key == k].tolist() if x != y}
    for pieces, step, room in ((1, 7, 30), (3, 30, 60), (4, 1000, 10**6), (100_000, 50, 40)):
        rows = [r for k in range(0, len(key), step) for r in parity.packed(key[order[k : k + step]], c[order[k : k + step]], pieces).to_pylist()]
        table = pa.Table.from_pylist(sorted(rows, key=lambda r: r["piece"]), pa.schema([("piece", pa.int32()), ("keys", pa.binary()), ("sets", pa.binary())]))
        rows = [r for b in parity.meet(iter(table.to_batches(3)), 50, 20, room) for r in b.to_pylist()]
        pairs, hot = {(r["a"], r["b"]) for r in rows if r["b"] is not None}, sorted((r["key"], r["a"]) for r in rows if r["b"] is None)
        assert pairs == want and hot == sorted((int(k), int(x)) for k, x in zip(key, c) if sizes[int(k)] > 50)
    assert list(parity.meet(iter([]))) == [] and parity.packed(key[:0], c[:0], 3).num_rows == 0


def test_word_hashes_follow_the_words(monkeypatch):
    texts = ["", "Một hai, ba! một_hai", "x", " ", "…", "a1 b2\u0301c 𝒳y ½ z", "hai ba một", "ba " * 50 + "hai"]
    words = parity.Words()
    want = [parity.WORD.findall(t) for t in texts]
    for cells in (1 << 17, 20):
        monkeypatch.setattr(parity, "_CELLS", cells)
        h, n = words.of(texts)
        assert n.tolist() == [len(w) for w in want]
        of = {}
        for w, x in zip([x for w in want for x in w], h.tolist()):
            assert of.setdefault(w, x) == x
        assert len(set(of.values())) == len(of) > 8
