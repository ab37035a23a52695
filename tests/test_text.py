import unicodedata

import pytest
from pyspark.sql import functions as F

from lotusgrid.functions import lexicon as L
from lotusgrid.functions import text

H = "https://tin.example/"
#: Own cases, made from the rules: token lists, gates, excluded parts, numbers, hosts.
SLUGS = [
    (H + "lat-xe-tren-cao-toc-khuya-nay-9981.html", True),  # a phrase that needs no vehicle
    (H + "tin/mat-lai-o-khuc-cua.htm?from=tong-ket", True),  # the query does not count
    (H + "can-qua-chan-nguoi-ban-rau.html", False),  # a gated phrase without a vehicle
    (H + "xe-ben-can-qua-chan-nguoi-ban-rau.html", True),
    (H + "oto-77-lao-88-xuong-kenh.html", True),  # numbers go before phrases are looked for
    (H + "o-to-roi-xuong-deo.antd", True),  # two tokens that make a vehicle
    (H + "to-roi-xuong-deo.antd", False),
    (H + "xe-buyt-va-cham-tau-hoa-trong-buoi-dien-tap.html", False),  # an excluded part
    (H + "bong-da/xe-khach-dam-vao-cot-dien.html", False),  # anywhere in the path
    (H + "xe-dua-huong-dam-dao-tinh-que.html", False),
    ("https://the-thao.example/lat-xe.html", False),  # the host counts too
    (H + "taxe-dam-vaoo.html", False),  # parts of words are no words
    (H + "TAI-NAN-GIAO-THONG-O-CAU-MOI.HTML/", True),
    (H + "123-456.html", False),
    (None, False),
    ("", False),
]


def test_slug_filter(spark):
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(SLUGS)], "i int, url string")
    got = {r.i: r.p for r in df.select("i", text.slug_passes(F.col("url")).alias("p")).collect()}
    assert [u for i, (u, w) in enumerate(SLUGS) if got[i] != w] == []


CITY_REPORT = ("Xe bồn lật nghiêng ở Long Biên", "Lúc 22 giờ 15 ngày 3/11/2023, gần nút giao với phố Sài Đồng, xe bồn mất lái rồi tông vào xe đạp. 3 người bị thương. Trời mưa.")
ARTICLES = [
    (*CITY_REPORT, True, ""),
    ("Va chạm trên đèo", "Xe khách va chạm xe tải ở Sơn La. Hai người được đưa về Bệnh viện Việt Đức.", False, L.AREA + "other_province"),
    ("Va chạm trong đêm", "Xe khách va chạm xe tải.", False, L.AREA + "unknown"),
    ("Số liệu", "So với cùng kỳ, số vụ tai nạn giảm ở Long Biên; xe máy va chạm là chính.", False, L.IS_AGGREGATE),
    ("Lễ hội", "Người dân Long Biên dự hội làng.", False, f"{L.NO_VERB};{L.NO_VEHICLE}"),
    (None, None, False, f"{L.NO_VERB};{L.NO_VEHICLE}"),
]


def _analysed(spark, rows):
    df = spark.createDataFrame([(i, *r[:2], "x", "y") for i, r in enumerate(rows)], "i int, title string, body string, sources string, score string")
    df = df.select("i", text.nfc(F.col("title")).alias("title"), text.nfc(F.col("body")).alias("body"), "sources", "score")
    both = text.analysed(df), text.classified(df)
    assert both[0].columns == [*df.columns, *text.FLAGS]
    a, b = ({r.i: r for r in d.collect()} for d in both)
    return [(a[i], b[i]) for i in range(len(rows))]


def test_articles(spark):
    form = lambda n, x: x if x is None else unicodedata.normalize(n, x)
    rows = [(form(n, a), form(n, b), k, r) for a, b, k, r in ARTICLES for n in ("NFC", "NFD")]
    got = _analysed(spark, rows)
    assert [(f.filter_keep, f.filter_reject_reasons) for f, _ in got] == [r[2:] for r in rows]
    f = got[1][0]
    assert (f.has_exact_time, f.has_date, f.location_level, f.vehicles, f.n_vehicle_types) == (True, True, "precise", "truck;bicycle", 2)
    assert (f.has_casualty, f.casualty_numeric, f.has_weather, f.hanoi_districts, f.filter_needs_review) == (True, True, True, "Long Biên", False)
    assert got[4][0].filter_needs_review and got[2][1].transfer_context and not got[0][1].transfer_context
    assert got[0][1].keep and got[0][1].reject_reasons == [] and got[2][1].reject_reasons == [L.AREA + "other_province"]
    assert text.analysed(spark.createDataFrame([], "title string, body string")).count() == 0


@pytest.mark.parametrize(
    "title,body,verdict,confidence,here",
    [
        ("", "ở Điện Biên", "other_province", "high", 0),
        ("", "ở Sóc Sơn", "hanoi", "high", 3),
        ("", "tại hà nội", "hanoi", "low", 1),
        ("Mễ Trì", "Ba Vì và Kon Tum", "hanoi", "medium", 6),
        ("", "Ba Vì, Kon Tum, Yên Bái", "other_province", "medium", 3),
        ("", "Ba Vì và Kon Tum", "unknown", "low", 3),
        ("", "một nơi", "unknown", "low", 0),
        ("", "y" * 450 + " được chuyển lên Hà Nội", "other_province", "medium", 0),
        ("", "Ba Vì. " + "y" * 450 + " được chuyển lên Hà Nội", "hanoi", "high", 3),
        ("", "Giải Phóng", "hanoi", "high", 6),  # listed twice
        ("", "cầu Long Biên", "hanoi", "high", 6),  # district and landmark
        ("", "Vành đai 2,5", "hanoi", "high", 6),  # one name inside another
        ("", "y" * 400 + " Ba Vì", "unknown", "low", 0),  # behind the head
        ("", "y" * 394 + " Ba Vì", "hanoi", "high", 3),  # just inside
    ],
)
def test_location_table(spark, title, body, verdict, confidence, here):
    loc = _analysed(spark, [(title, body)])[0][1]
    assert (loc.location_verdict, loc.location_confidence, loc.score_here) == (verdict, confidence, here)


def test_patterns_see_unicode(spark):
    rows = [("", "xe\xa0tải ĐÂM VÀO xe máy"), ("", "đâm_vào"), ("", "đường ảnh"), ("", "phường x"), ("", "quận Đống"), ("", "xe ô tô tải")]
    got = _analysed(spark, rows)
    assert got[0][1].has_crash_verb and not got[1][1].has_crash_verb
    assert got[2][0].location_level == "street" and got[3][0].location_level == "coarse"
    assert "car" not in got[5][0].vehicles


def test_pct_and_html(spark):
    df = spark.createDataFrame([(1, 8), (3, 8), (0, 0), (5, 40)], "n int, t int")
    assert [r.p for r in df.select(text.pct(F.col("n"), F.col("t")).alias("p")).collect()] == ["12%", "38%", "n/a", "12%"]
    html = "<html><script>var a;</script><!-- c --><p>Một&nbsp;hai</p><style>p{}</style><div>ba &lt;4&gt;<br>năm</div></html>"
    got = spark.createDataFrame([(html,), ("",), (None,)], "h string").select(text.html_text(F.col("h")).alias("t")).collect()
    assert [r.t for r in got] == ["Một hai\nba <4>\nnăm", "", None]


def test_page_text_and_meta(spark):
    pages = [
        ('<title> Đầu\nđề </title><meta content="Đề chia sẻ" property="og:title"><META NAME="date" CONTENT="2024-01-02"><nav>menu</nav><p>thân</p><aside>lề</aside><table><tr><td>1</td></tr></table><footer>cuối</footer>', "Đề chia sẻ", "2024-01-02", "Đầu\nđề\nthân"),
        ('<title>T</title><time datetime="2023-05-06T07:08">x</time>', "T", "2023-05-06T07:08", "T\nx"),
        ("<p>không có", "", "", "không có"),
        ("", "", "", ""),
        (None, "", "", None),
    ]
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(pages)], "i int, h string")
    got = {r.i: (r.m.title, r.m.date, r.t) for r in df.select("i", text.page_meta(F.col("h")).alias("m"), text.html_text(F.col("h")).alias("t")).collect()}
    assert [got[i] for i in range(len(pages))] == [p[1:] for p in pages]


def test_seeded_sample_is_stable(spark):
    df = spark.createDataFrame([(f"u{i}",) for i in range(100)], "url string")
    a = [r.url for r in text.seeded_sample(df, "url", 10, "7").collect()]
    assert a == [r.url for r in text.seeded_sample(df.repartition(7), "url", 10, "7").collect()] and len(set(a)) == 10
