import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lotusgrid.llm import canon as c


@pytest.mark.parametrize(
    "a,b",
    [
        ("ｎｈà ｖăn，ｈóa", "nhà văn,hóa"), ("nhà", unicodedata.normalize("NFD", "nhà")), ("n​h⁠à﻿", "nhà"), ("a\xa0b c　d", "a b c d"),
        ("Сао Вằng", "Cao Bằng"), ("Ðường", "Đường"), ("Τrang", "Trang"), ("ầ", "ầ"), ("ầ", "ầ"), ("о̂", "ô"), ("a‍́", "á"), ("ở", "ở"), ("ồ", "ồ"), ("­", ""),
    ],
)
def test_same(a, b):
    assert c.canon(a) == c.canon(b)


@pytest.mark.parametrize("a,b", [("a b", "a  b"), ("a b", "ab"), ("A", "a"), ("à", "á"), ("a.", "a,"), ("a\tb", "a b"), ("a\nb", "a b"), ("đ", "d")])
def test_different(a, b):
    assert c.canon(a) != c.canon(b)


@given(st.text(alphabet=st.one_of(st.characters(), st.sampled_from("aăâđơự̛̀́̂̆​\xa0ｈсοÐ\n ")), max_size=60))
def test_transducer_equals_definition_and_is_idempotent(t):
    try:
        t.encode()
    except UnicodeEncodeError:
        return
    out = c.canon(t)
    assert c.canon(out) == out
    assert out == c.cluster(t) or unicodedata.normalize("NFC", out) == unicodedata.normalize("NFC", c.cluster(t))


def test_tables_are_free_of_conflicts():
    single, *_ = c.compile_tables()
    assert all(c.cluster(v) == v for v in single.values()) and len(single) > 1000


def test_same_look(spark):
    rows = [(1, "nhà", None, "x"), (2, "nhà", "", "x"), (3, "nh​à", "B", "x"), (4, "ｎhà", "В", "x"), (4, "ｎhà", "В", "x"), (5, None, "b", "x"), (6, "nha", "x" * 100_000, "x"), (7, "khác", "x" * 100_000, "x"), (None, "nh⁠à", "B", "x")]
    df = spark.createDataFrame(rows, "record_id long, title string, body string, rec string")
    got = [tuple(r) for r in c.same_look(df, "record_id", ["title", "body"]).collect()]
    assert sorted(got) == [("body", 3, 4), ("title", 1, 3), ("title", 1, 4), ("title", 2, 3), ("title", 2, 4), ("title", 3, 4)]
    assert c.same_look(df.limit(0), "record_id", ["title", "body"]).count() == 0


def test_found_query_against_brute_force(spark, sf):
    import __spark_entry__ as entry

    got = {tuple(r) for r in entry.queries()["p6_found"](spark, sf).collect()}
    want = set()
    pdf = spark.read.parquet(f"{sf}/manifest.parquet").toPandas()
    for f in ("title", "body"):
        rows = [(r, t, c.cluster(t)) for r, t in zip(pdf.record_id, pdf[f]) if t]
        want |= {(f, min(a[0], b[0]), max(a[0], b[0])) for i, a in enumerate(rows) for b in rows[i + 1 :] if a[2] == b[2] and a[1] != b[1]}
    assert got == want


def test_planted_conflicts_are_found():
    with pytest.raises(ValueError, match="FF21"):
        c.compile_tables(0xFFFF, {**c.LOOKALIKES, "Ａ": "B"})
    with pytest.raises(ValueError, match="00A0"):
        c.compile_tables(0xFFFF, {**c.LOOKALIKES, "\xa0": "x"})
    with pytest.raises(ValueError):
        c.compile_tables(0xFFFF, {**c.LOOKALIKES, "q": "х", "ԛ": "q"})  # no fixed point


def test_all_of_unicode_and_other_scripts():
    assert c.canon("\U0002f800") == unicodedata.normalize("NFC", "\U0002f800") != "\U0002f800"
    assert c.canon("օ") == "o" and c.canon("Ꮇ") == "M" and c.canon("ꓟ") == "M" and c.canon("а́") == "á"
