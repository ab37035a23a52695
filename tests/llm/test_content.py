import itertools

import numpy as np

from lotusgrid.llm import content, content_train


def test_sum_product_equals_enumeration():
    rng = np.random.default_rng(3)
    m = content.Model(np.zeros((1, 4)), rng.normal(size=(4, 4)), rng.normal(size=4), rng.normal(size=4))
    lengths = [1, 3, 5, 0, 2]
    node = rng.normal(size=(sum(lengths), 4))
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    got = content.marginals(node, start, np.array(lengths), m)
    for a, n in zip(start, lengths):
        if not n:
            continue
        p = np.zeros((n, 4))
        for s in itertools.product(range(4), repeat=n):
            w = np.exp(m.root[s[0]] + m.leaf[s[-1]] + sum(node[a + t, s[t]] for t in range(n)) + sum(m.edge[x, y] for x, y in zip(s, s[1:])))
            for t in range(n):
                p[t, s[t]] += w
        assert np.allclose(got[a : a + n], p / p.sum(1, keepdims=True), atol=1e-9)


def test_held_out_accuracy(spark, sf):
    rows = spark.read.parquet(sf.replace("0.001", "0.01") + "/manifest.parquet").select("url", "body").where("body is not null").collect()
    pages = [([s for _, s in content.clean_lines(r.body)], content.site_label(r.url)) for r in rows]
    precision, recall = content_train.score([p for p in pages if p[0]], content.Model.load())
    assert precision > 0.999 and recall > 0.999


def test_dirty_rows(spark):
    para = "Xe tải màu đen chạy hướng vào trung tâm thì đâm vào xe máy ở khúc cua chữ S, một người bị thương nhẹ và được đưa đi cấp cứu ngay."
    rows = [(1, "https://www.site.example/a", f"Trang nhất\nGiao thông\n\n {para}\nQuảng cáo\n{para}\nTin liên quan\n- Xe khách đâm vào xe tải ở đường Hoa, phường Lá\n© Site. Ghi rõ nguồn", "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "\n \n", "x"), (None, "u", para, "x"), (5, "bad url", para + "\n" + " ".join([para] * 2000), "x")]
    df = spark.createDataFrame(rows, "record_id long, url string, body string, line_no string")
    got = {tuple(r) for r in content.content_lines(df).collect()}
    assert got == {(1, 4), (1, 6), (5, 1), (5, 2)}
    assert content.content_lines(df.limit(0)).count() == 0


def test_site_label():
    assert content.site_label("HTTPS://www.ABC24.example:443/x") == "abc24" and content.site_label("https://m.b.example") == "b" and content.site_label(None) == "\0"
