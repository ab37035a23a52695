"""A mix of sources to target weights (problem 8).

Sizes are tokens of a public tokenizer. Sources overlap where they hold the same
text, so documents are aggregated by membership pattern: the set of wanted sources
that hold their text. A min-cost flow routes each pattern's tokens to the sources'
quotas (share x budget). A pattern's capacity is its size once for every allowed
repetition, the r-th at cost r - 1 (convex), so nothing is repeated while unused text
would do. The network has patterns and sources for nodes, not documents, and is
solved on the driver; sources and patterns are limited, and more of them an error.

Documents are then selected by seed: each pattern is laid out in seeded order as a
line of tokens, once per repetition; each source takes a stretch of the line as long
as its flow. A stretch of at most m lengths meets a document at most m times, so no
document is used more than its source's ``max_repeats``, nor more for another source
than that one's. The running sums are taken by buckets of the seeded order.

Defined results: null, empty and zero-token texts are not used; sources not listed
take no part; copies are documents of their own; sources too small for their quota
are reported short; an empty corpus gives an empty mix and zero shares.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import contracts
from ..session import cut, spread
from .batches import slices

#: How byte-level vocabularies of the public tokenizers split text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_SOURCES = 64
BUCKET_ROWS = 20_000


def sized(df: DataFrame, doc_id: str, text: str, source: str, tokenizer: str, pattern: str = PATTERN) -> DataFrame:
    """(doc, src, h, n): each document's source, text hash and number of tokens; ``tokenizer`` is the path of a vocabulary of ranks."""
    contracts.require_whole_numbers(df, doc_id)
    vocabulary = open(tokenizer, "rb").read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in slices(batches, 1000):
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64())], names=["doc", "src", "h", "n"])

    rows = df.select(F.col(doc_id).cast("long").alias("doc"), F.col(source).alias("src"), F.unhex(F.md5(text)).alias("h"), F.col(text).alias("text"))
    return spread(rows, "doc").mapInArrow(run, "doc long, src string, h binary, n long")


def min_cost_flow(patterns: list[tuple[tuple[str, ...], int, int]], quotas: dict[str, int], limits: dict[str, int]) -> dict[tuple[int, str], int]:
    """Flow from each pattern (sources, size, repetitions) to each source (quota, repetitions), of greatest amount at least cost."""
    names = list(quotas)
    place = {s: i for i, s in enumerate(names)}
    source, sink, first = 0, 1, 2
    at_source = first + len(patterns)
    graph: list[list[int]] = [[] for _ in range(at_source + len(names))]
    to, cap, cost = [], [], []

    def arc(a: int, b: int, c: int, w: int) -> int:
        graph[a].append(len(to))
        to.append(b), cap.append(c), cost.append(w)
        graph[b].append(len(to))
        to.append(a), cap.append(0), cost.append(-w)
        return len(to) - 2

    routes = {}
    for i, (members, size, repeats) in enumerate(patterns):
        for r in range(repeats):
            arc(source, first + i, size, r)
        for s in members:
            routes[(i, s)] = arc(first + i, at_source + place[s], size * min(repeats, limits[s]), 0)
    for s, q in quotas.items():
        arc(at_source + place[s], sink, q, 0)
    while True:
        dist, via, queued = {source: 0}, {}, {source}
        queue = deque([source])
        while queue:
            x = queue.popleft()
            queued.discard(x)
            for e in graph[x]:
                if cap[e] > 0 and (d := dist[x] + cost[e]) < dist.get(to[e], 1 << 60):
                    dist[to[e]], via[to[e]] = d, e
                    if to[e] not in queued:
                        queued.add(to[e])
                        queue.append(to[e])
        if sink not in dist:
            break
        x, push = sink, 1 << 62
        while x != source:
            push = min(push, cap[via[x]])
            x = to[via[x] ^ 1]
        x = sink
        while x != source:
            cap[via[x]] -= push
            cap[via[x] ^ 1] += push
            x = to[via[x] ^ 1]
    return {k: cap[e ^ 1] for k, e in routes.items() if cap[e ^ 1]}


def mixed(df: DataFrame, targets: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", source: str = "source", budget_share: float = 0.5, seed: int = 1, pattern: str = PATTERN, max_patterns: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """The mix (doc_id, source, n_tokens, uses) and the report (source, target_share, max_repeats, quota_tokens, tokens, share, short).

    ``source`` of the mix is the source whose share the uses count for. ``share`` is of the
    tokens wanted in all (the budget). More than ``MAX_SOURCES`` sources or more than
    ``max_patterns`` different sets of sources that hold a text are an error.
    """
    spark = df.sparkSession
    wanted = targets.select(F.col("source").alias("src"), "target_share", "max_repeats").where("source is not null").limit(MAX_SOURCES + 1).collect()
    if len(wanted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    repeats = {r["src"]: max(0, int(r["max_repeats"] or 0)) for r in wanted}
    docs = cut(sized(df, doc_id, text, source, tokenizer, pattern), "mix-sizes")
    budget = int((docs.agg(F.sum("n")).first()[0] or 0) * budget_share)
    quotas = {r["src"]: int(round(float(r["target_share"] or 0) * budget)) for r in wanted}
    listed = docs.where(F.col("src").isin(list(repeats)) & (F.col("n") > 0))
    of_text = listed.groupBy("h").agg(F.array_sort(F.collect_set("src")).alias("pattern"))
    listed = listed.join(of_text, "h").select("doc", "n", F.struct(F.col("src").alias("own"), "pattern").alias("pattern"))
    order = F.xxhash64("doc", F.lit(seed))
    listed = cut(listed.withColumn("u", order), "mix-listed")
    sizes = listed.groupBy("pattern").agg(F.sum("n").alias("size"), F.count("*").alias("rows")).limit(max_patterns + 1).collect()
    if len(sizes) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    sizes.sort(key=lambda r: (r["pattern"]["own"], r["pattern"]["pattern"]))
    patterns = [(tuple(r["pattern"]["pattern"]), r["size"], repeats[r["pattern"]["own"]]) for r in sizes]
    flow = min_cost_flow(patterns, quotas, repeats)
    # Each source's stretch of each pattern's line.
    stretches = []
    for i, (members, size, _) in enumerate(patterns):
        at = 0
        for s in members:
            if f := flow.get((i, s), 0):
                stretches.append(((sizes[i]["pattern"]["own"], list(members)), s, size, at, at + f))
                at += f
    lines = spark.createDataFrame(stretches, "pattern struct<own: string, pattern: array<string>>, source string, size long, a long, e long")
    buckets = max(1, sum(r["rows"] for r in sizes) // BUCKET_ROWS)
    listed = listed.withColumn("bucket", F.floor((F.shiftright("u", 11).cast("double") / F.lit(float(1 << 53)) + 0.5) * buckets))
    sums = listed.groupBy("pattern", "bucket").agg(F.sum("n").alias("in_bucket"))
    before = F.sum("in_bucket").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("in_bucket")
    sums = sums.select("pattern", "bucket", before.alias("base"))
    inside = F.sum("n").over(Window.partitionBy("pattern", "bucket").orderBy("u", "doc").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    placed = listed.withColumn("inside", inside).join(sums, ["pattern", "bucket"]).select("doc", "n", "pattern", (F.col("base") + F.col("inside")).alias("at"))
    # Repetition r of a document starts at r * size + at; those in [a, e) are its uses for the stretch's source.
    count = lambda x: F.greatest(F.lit(0), F.ceil((F.col(x) - F.col("at")) / F.col("size")))
    uses = (count("e") - count("a")).cast("long")
    mix = placed.join(lines, "pattern").withColumn("uses", uses).where("uses > 0")
    mix = mix.select(F.col("doc").alias(doc_id), "source", F.col("n").alias("n_tokens"), "uses")
    goal = spark.createDataFrame([(r["src"], float(r["target_share"] or 0), int(r["max_repeats"] or 0), quotas[r["src"]]) for r in wanted], "source string, target_share double, max_repeats int, quota_tokens long")
    got = mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"))
    report = goal.join(got, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    report = report.withColumn("share", F.col("tokens") / F.lit(float(max(1, budget)))).withColumn("short", F.col("tokens") < F.col("quota_tokens") * 0.99)
    return mix, report
