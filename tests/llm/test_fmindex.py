import unicodedata

import numpy as np
import pytest

from lotusgrid.llm import fmindex


def test_index_counts_and_locates():
    rng = np.random.default_rng(1)
    for n, sigma in ((200, 2), (500, 4), (300, 60)):
        seq = rng.integers(0, sigma + 1, n).astype(np.int32)
        seq[0] = seq[-1] = 0
        index = fmindex.FMIndex(seq, sigma)
        pats = np.array([rng.integers(1, sigma + 1, 3) for _ in range(60)])
        lo, hi = index.search(pats)
        for p, a, e in zip(pats, lo, hi):
            want = [i for i in range(n - 2) if (seq[i : i + 3] == p).all()]
            assert sorted(index.locate(np.arange(a, e)).tolist()) == want


def brute(docs, items, k=12):
    out = set()
    for i, t in items:
        w = fmindex.words(t)
        grams = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
        for d, x in docs:
            v = fmindex.words(x)
            if d is not None and any(tuple(v[j : j + k]) in grams for j in range(len(v) - k + 1)):
                out.add((d, i))
    return out


def test_dirty_rows(spark):
    item = "Nếu mỗi chuyến phà qua Chuông Hiên 677, và không ai nhớ rõ Biển Báo nằm bên nào thì sao"
    w = item.split()
    docs = [(1, "mở đầu " + unicodedata.normalize("NFD", item).upper() + " hết"), (2, " ".join(w[:12])), (3, " ".join(w[:11])), (4, " ".join(w[:11]) + " khác " + " ".join(w[11:])), (5, None), (6, ""), (7, "x " * 50_000 + "\n".join(w[3:16]) + " y" * 50_000), (7, "x"), (None, item), (8, item + " . " + item)]
    items = [(10, item), (11, "ngắn quá"), (12, None), (13, " ".join(w[2:])), (None, item)]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    got = {tuple(r) for r in fmindex.leaks(d, i).collect()}
    assert got == brute(docs, [r for r in items if r[0] is not None and r[1]]) and (3, 10) not in got and (7, 10) in got
    assert {tuple(r) for r in fmindex.leaks(d, i, shard_words=1).collect()} == got
    spans = {(r.doc_id, r.item_id): (r.first_word, r.end_word) for r in fmindex.leak_spans(d.where("doc_id = 1"), i).collect()}
    assert spans[(1, 10)] == (2, 2 + len(fmindex.words(item)))
    whole = sorted(tuple(r) for r in fmindex.leak_spans(d, i).collect())
    for n in (3, 13, 20):
        assert sorted(tuple(r) for r in fmindex.leak_spans(d, i, shard_words=n).collect()) == whole
    named = {tuple(r) for r in fmindex.leaks(d.selectExpr("'d' || doc_id as doc_id", "text"), i.selectExpr("'i' || item_id as item_id", "text")).collect()}
    assert named == {(f"d{a}", f"i{b}") for a, b in got}
    with pytest.raises(ValueError, match="blocks"):
        fmindex.leaks(d, i, max_item_bytes=10)
    with pytest.raises(ValueError, match="blocks"):
        fmindex.leaks(d, i, max_item_rows=1)
    assert fmindex.leaks(d.limit(0), i).count() == 0 and fmindex.leaks(d, i.limit(0)).count() == 0


def test_found_query_against_brute_force(spark, sf):
    import __spark_entry__ as entry

    at = sf.replace("0.001", "0.01")
    docs = [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{at}/eval_items.parquet").select("item_id", "text").collect()]
    want = brute(docs, items)
    assert want and {tuple(r) for r in entry.queries()["p7_found"](spark, at).collect()} == want
