import collections
import os

import pytest

from lotusgrid.llm import mix
from lotusgrid.llm.queries import TOKENIZER

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer files")


def test_flow_prefers_unused_text():
    patterns = [(("a",), 100, 3), (("a", "b"), 100, 2), (("b",), 10, 1)]
    f = mix.min_cost_flow(patterns, {"a": 150, "b": 60}, {"a": 3, "b": 1})
    by = collections.Counter()
    for (i, s), v in f.items():
        by[s] += v
        assert s in patterns[i][0] and v <= patterns[i][1] * patterns[i][2]
    assert by == {"a": 150, "b": 60}
    used = collections.Counter()
    for (i, _), v in f.items():
        used[i] += v
    assert all(used[i] <= patterns[i][1] for i in used)  # 210 tokens of unused text suffice


def tables(spark, rows, targets):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, n int, pattern string")
    return df, spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_quotas_repeats_and_dirty_rows(spark):
    long = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    rows = [(k, long(k, 20 + k % 7), "big") for k in range(300)] + [(1000 + k, long(k, 20), "small") for k in range(10)] + [(2000 + k, long(k, 20 + k % 7), "over") for k in range(40)]
    rows += [(3000, None, "big"), (3001, "", "small"), (3002, "  ", None), (None, "x y", "big"), (3003, long(9999, 3000), "unlisted")]
    df, targets = tables(spark, rows, [("big", 0.6, 1), ("small", 0.2, 3), ("over", 0.2, 2), ("gone", 0.0, 1)])
    m, report = mix.mixed(df, targets, TOKENIZER, budget_share=0.4)
    got = m.collect()
    limit = {"big": 1, "small": 3, "over": 2}
    text = {r[0]: r[1] for r in rows}
    holders = collections.defaultdict(set)
    for _, t, s in rows:
        if t:
            holders[t].add(s)
    uses = collections.Counter()
    for r in got:
        assert r.uses > 0 and r.source in holders[text[r.doc_id]]
        uses[r.doc_id] += r.uses
        assert r.uses <= limit[r.source]
    own = {r[0]: r[2] for r in rows}
    assert all(n <= limit[own[d]] for d, n in uses.items())
    rep = {r.source: r for r in report.collect()}
    assert not rep["big"].short and rep["big"].share == pytest.approx(0.6, abs=0.02)
    only = {r[0] for r in rows if r[2] == "small" and r[1] and holders[r[1]] == {"small"}}
    assert rep["small"].short and len(only) == 8 and only <= {d for d, n in uses.items() if n == 3} and rep["gone"].tokens == 0
    assert all(rep[s].tokens == sum(r.n_tokens * r.uses for r in got if r.source == s) for s in rep)
    again = mix.mixed(df.repartition(7), targets, TOKENIZER, budget_share=0.4)[0]
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in got}
    other = mix.mixed(df, targets, TOKENIZER, budget_share=0.2, seed=5)[0]
    assert {r.doc_id for r in other.collect()} != {r.doc_id for r in mix.mixed(df, targets, TOKENIZER, budget_share=0.2)[0].collect()}


def test_empty(spark):
    df, targets = tables(spark, [(1, "x", "a")], [("a", 1.0, 1)])
    m, report = mix.mixed(df.limit(0), targets, TOKENIZER)
    assert m.count() == 0 and report.first().tokens == 0


def test_too_many_sources_or_patterns_are_an_error(spark):
    df, targets = tables(spark, [(1, "x", "a"), (2, "y", "b")], [("a", 0.5, 1), ("b", 0.5, 1)])
    with pytest.raises(ValueError, match="patterns"):
        mix.mixed(df, targets, TOKENIZER, max_patterns=1)
    _, many = tables(spark, [], [(f"s{k}", 0.01, 1) for k in range(mix.MAX_SOURCES + 1)])
    with pytest.raises(ValueError, match="sources"):
        mix.mixed(df, many, TOKENIZER)
