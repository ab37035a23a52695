import numpy as np
import pytest

from lotusgrid.operators import evaluate


def test_curve_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(float(np.round(rng.normal(), 2)), bool(rng.random() < 0.3)) for _ in range(2000)] + [(None, True), (0.5, None)]
    df = spark.createDataFrame(rows, "s double, y boolean")
    got = {r.score: (r.tp, r.fp, r.precision, r.recall) for r in evaluate.pr_curve(df, "s", "y").collect()}
    ok = [r for r in rows if None not in r]
    total = sum(y for _, y in ok)
    ap = last = 0.0
    for s in sorted({s for s, _ in ok}, reverse=True):
        tp, n = sum(y for v, y in ok if v >= s), sum(v >= s for v, _ in ok)
        assert got[s] == (tp, n - tp, pytest.approx(tp / n), pytest.approx(tp / total))
        ap += (tp / total - last) * tp / n
        last = tp / total
    assert evaluate.average_precision(df, "s", "y").first()[0] == pytest.approx(ap)
    assert evaluate.pr_curve(df.limit(0), "s", "y").count() == 0 and evaluate.average_precision(df.limit(0), "s", "y").first()[0] is None


def test_confusion(spark):
    df = spark.createDataFrame([(True, True)] * 4 + [(True, False)] * 1 + [(False, True)] * 2 + [(False, False)] * 3 + [(None, True)], "p boolean, a boolean")
    r = evaluate.confusion(df, "p", "a").first()
    assert (r.tp, r.fp, r.fn, r.tn) == (4, 1, 2, 3) and r.kappa == pytest.approx((0.7 - 0.5) / 0.5) and r.f1 == pytest.approx(8 / 11)
    e = evaluate.confusion(df.limit(0), "p", "a").first()
    assert e.tp == 0 and e.precision is None and e.kappa is None


def test_cuts_are_dropped(spark):
    from lotusgrid import session

    d = session.cut(spark.range(5).toDF("a"), "t")
    assert d.count() == 5
    session.drop_cuts(spark)
    with pytest.raises(Exception):
        spark.read.parquet(d.inputFiles()[0]).count()
