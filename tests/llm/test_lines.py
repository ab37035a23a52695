import collections

import numpy as np
import pytest

from lotusgrid.llm import content, lines


def test_containers():
    rng = np.random.default_rng(1)
    for n in (0, 1, 4095, 4096, 30_000, 65_536):
        a = np.sort(rng.choice(65536, n, replace=False)).astype(np.uint16)
        b = np.sort(rng.choice(65536, min(65536, n + 5), replace=False)).astype(np.uint16)
        assert np.array_equal(lines.unpack(lines.pack(a)), a)
        assert np.array_equal(lines.unpack(lines.unite([lines.pack(a), lines.pack(b)])), np.union1d(a, b))


def brute(rows, least=4, share=0.05):
    docs, seen, occ = collections.defaultdict(set), collections.defaultdict(set), collections.defaultdict(list)
    for r, u, b in rows:
        if r is None or u is None:
            continue
        host = u.lower().split("://")[1].split("/")[0].split(":")[0]
        site = host.removeprefix("www.") if host.startswith("www.") else host.removeprefix("m.")
        docs[site].add(r)
        for i, s in content.clean_lines(b):
            seen[site, s].add(r)
            occ[site, s].append((r, i))
    return sorted(o for k, v in occ.items() if len(seen[k]) >= least and len(seen[k]) >= share * len(docs[k[0]]) for o in v)


def test_matches_brute_force(spark):
    rows = [(k, f"https://{'www.' if k % 2 else 'M.'}a.example:443/{k}" if k % 5 else f"https://b.example/{k}", "chung\nＣhung  \nriêng %d\n\nchung" % k if k % 3 else "Chung\nnửa") for k in range(1, 60)]
    rows += [(70_000 + k, "http://a.example/x", "chung\nchung") for k in range(40)] + rows[:5] + [(900, "https://a.example/", None), (901, "https://a.example/", ""), (None, "https://a.example", "chung"), (902, None, "chung"), (903, "https://c.example", "chung")]
    df = spark.createDataFrame([(*r, "x", b"y") for r in rows], "record_id long, url string, body string, site string, line binary").repartition(5)
    assert sorted(tuple(r) for r in lines.repeated_lines(df).collect()) == brute(rows)
    assert lines.repeated_lines(df.limit(0)).count() == 0


def test_found_query_against_brute_force(spark, sf):
    import __spark_entry__ as entry

    at = sf.replace("0.001", "0.01")
    pdf = spark.read.parquet(f"{at}/manifest.parquet").toPandas()
    want = brute(list(zip(pdf.record_id.tolist(), pdf.url, pdf.body)))
    assert want and sorted(tuple(r) for r in entry.queries()["p4_found"](spark, at).collect()) == want


def test_ids_must_be_numbers(spark):
    df = spark.createDataFrame([("a", "https://a.example/", "x")], "record_id string, url string, body string")
    with pytest.raises(ValueError, match="whole numbers"):
        lines.repeated_lines(df)


def test_without_repeated(spark):
    rows = [(k, f"https://a.example/{k}", f"chung\nriêng {k}\n\nＣhung\nchung") for k in range(6)] + [(10, "https://a.example/", None), (11, "https://a.example/", ""), (12, None, "chung"), (13, "https://b.example/", "chung\n")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "record_id long, url string, body string, line_no int")
    got = {r.record_id: r.body for r in lines.without_repeated(df).collect()}
    assert got == {**{k: f"riêng {k}\n" for k in range(6)}, 10: None, 11: "", 12: "chung", 13: "chung\n"}
    assert lines.without_repeated(df).columns == df.columns and lines.without_repeated(df.limit(0)).count() == 0
