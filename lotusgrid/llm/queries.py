"""Queries of the text operators over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table
from . import canon, content, fmindex, lines, mix, parity, pii


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity.near_pairs(table(spark, sf_dir, "manifest"))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity.near_classes(table(spark, sf_dir, "manifest"))


def p2_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over whole texts, with runs of five words and similarity 0.8: each document's class and the class's links."""
    return parity.near_classes(table(spark, sf_dir, "documents"), "doc_id", None, "text", 0.8, 5)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeated_lines(table(spark, sf_dir, "manifest"))


def p4_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records with their over-repeated lines taken out, each body told by its hash."""
    m = lines.without_repeated(table(spark, sf_dir, "manifest").select("record_id", "url", "body"))
    return m.select("record_id", F.md5("body").alias("body_md5"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.content_lines(table(spark, sf_dir, "manifest"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon.same_look(table(spark, sf_dir, "manifest"), "record_id", ["title", "body"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.leak_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


#: A vocabulary of the public tokenizers on this machine.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), TOKENIZER)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), TOKENIZER)[1]


def p8_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every mix must keep, by source: no document used too often, all of them known and once in the mix, tokens as reported and within the quota but for one document."""
    docs, targets = table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")
    chosen, report = mix.mixed(docs, targets, TOKENIZER)
    chosen = cut(chosen, "mix-chosen")
    own = chosen.groupBy("doc_id").agg(F.sum("uses").alias("uses")).join(docs.select("doc_id", "source"), "doc_id", "left").join(targets, "source", "left")
    own = own.groupBy("source").agg(F.count_if((F.col("uses") > F.col("max_repeats")) | F.col("max_repeats").isNull()).alias("n_wrong"))
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("sum"), F.max("n_tokens").alias("most"), (F.count("*") - F.count_distinct("doc_id")).alias("n_twice"))
    out = report.join(got, "source", "left").join(own, "source", "left")
    same = F.coalesce("sum", F.lit(0)) == F.col("tokens")
    within = F.coalesce(F.col("sum") <= F.col("quota_tokens") + F.col("most"), F.lit(True))
    return out.select("source", "target_share", "max_repeats", F.coalesce("n_wrong", F.lit(0)).alias("n_wrong"), F.coalesce("n_twice", F.lit(0)).alias("n_twice"), same.alias("as_reported"), within.alias("within_quota"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(table(spark, sf_dir, "documents"))


def p9_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.masked_documents(table(spark, sf_dir, "documents"), key="test key")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_classes, p2_texts, p4_found, p4_cleaned, p5_found, p6_found, p7_found, p7_spans, p8_mix, p8_shares, p8_laws, p9_found, p9_masked)}


# Fixed values, written apart from the operator's own tables: look-alike letters, spaces and invisible signs that the test tables may hold.
SQL_LOOKS = "АВЕЅІЈКМНОРСТУХаеорсухѕіјһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲÐƉɑɡ"
SQL_LATIN = "ABESIJKMHOPCTYXaeopcyxsijhdqwABEZHIKMNOPTYXovcĐĐag"
SQL_SPACES = [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
SQL_HIDDEN = [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF, 0x3164, 0xFFA0, 0x2800]


def form_sql(t: str) -> str:
    """The one form of a text in SQL, for the characters that single rules change: invisible ones, widths, spaces, look-alikes."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    narrow = "".join(map(chr, range(0x21, 0x7F)))
    a = SQL_LOOKS + wide + "".join(map(chr, SQL_SPACES)) + "".join(map(chr, SQL_HIDDEN))
    b = (SQL_LATIN + narrow + " " * len(SQL_SPACES)).replace("'", "''")
    return f"nfc_normalize(translate({t}, '{a}', '{b}'))"


SITE_SQL = "regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)', 1), '^(?:www|m)\\.', '')"


def oracle_sql() -> dict[str, str]:
    over = f"""
    WITH m AS (SELECT record_id, {SITE_SQL} AS site, string_split({form_sql("body")}, chr(10)) AS ls FROM manifest),
     n AS (SELECT site, count(DISTINCT record_id) AS n_docs FROM m GROUP BY 1),
     l AS (SELECT record_id, site, unnest(range(1, len(ls) + 1)) AS line_no, trim(regexp_replace(unnest(ls), '[\\s\\x0b]+', ' ', 'g')) AS line FROM m),
     o AS (SELECT site, line FROM l JOIN n USING (site) WHERE line <> '' GROUP BY site, line, n_docs HAVING count(DISTINCT record_id) >= greatest(4, 0.05 * n_docs)),
     f AS (SELECT record_id, line_no FROM l JOIN o USING (site, line))"""
    p4 = f"{over} SELECT record_id, line_no FROM f"
    cleaned = f"""{over}, r AS (SELECT record_id, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS line_no, unnest(string_split(body, chr(10))) AS raw FROM manifest),
     k AS (SELECT record_id, coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (f.line_no IS NULL), '') AS body FROM r LEFT JOIN f USING (record_id, line_no) GROUP BY 1)
    SELECT m.record_id, md5(CASE WHEN m.body IS NOT NULL THEN coalesce(k.body, m.body) END) AS body_md5 FROM manifest m LEFT JOIN k USING (record_id)"""
    p8 = "SELECT source, target_share, max_repeats, 0 AS n_wrong, 0 AS n_twice, true AS as_reported, true AS within_quota FROM mix_targets"
    p6 = " UNION ALL ".join(
        f"""SELECT '{f}' AS field, a.record_id AS record_a, b.record_id AS record_b
        FROM (SELECT record_id, {f} AS t, {form_sql(f)} AS c FROM manifest WHERE {f} <> '') a JOIN (SELECT record_id, {f} AS t, {form_sql(f)} AS c FROM manifest WHERE {f} <> '') b
         ON a.c = b.c AND a.t <> b.t AND a.record_id < b.record_id"""
        for f in ("title", "body")
    )
    p2 = f"""
    WITH w AS (SELECT doc_id, regexp_extract_all(lower({form_sql("text")}), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
     s AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS g FROM w WHERE len(w) >= 5),
     c AS (SELECT md5(array_to_string(g, '|')) AS h, min(doc_id) AS class_id, any_value(g) AS g FROM s GROUP BY 1),
     e AS (SELECT h, len(g) AS n, unnest(g) AS x FROM c),
     j AS (SELECT a.h AS a, b.h AS b FROM e a JOIN e b ON a.x = b.x AND a.h < b.h GROUP BY 1, 2 HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*))),
     l AS (SELECT h, count(*) AS n FROM (SELECT a AS h FROM j UNION ALL SELECT b FROM j) GROUP BY 1)
    SELECT doc_id, class_id, coalesce(l.n, 0) AS n_links FROM s JOIN c ON c.h = md5(array_to_string(s.g, '|')) LEFT JOIN l ON l.h = c.h"""
    words = "regexp_extract_all(lower(nfc_normalize(text)), '[\\p{L}\\p{N}]+')"
    grams = "unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' ')))"
    p7 = f"""
    WITH d AS (SELECT DISTINCT doc_id, {grams} AS g FROM (SELECT doc_id, {words} AS w FROM documents)),
     i AS (SELECT DISTINCT item_id, {grams} AS g FROM (SELECT item_id, {words} AS w FROM eval_items))
    SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (g)"""
    at = "range(1, len(w) - 10)"
    spans = f"""
    WITH d AS (SELECT doc_id, unnest({at}) - 1 AS pos, {grams} AS g FROM (SELECT doc_id, {words} AS w FROM documents)),
     i AS (SELECT DISTINCT item_id, {grams} AS g FROM (SELECT item_id, {words} AS w FROM eval_items)),
     h AS (SELECT DISTINCT doc_id, item_id, pos FROM d JOIN i USING (g)),
     n AS (SELECT *, CASE WHEN pos - lag(pos) OVER w <= 12 THEN 0 ELSE 1 END AS new FROM h WINDOW w AS (PARTITION BY doc_id, item_id ORDER BY pos)),
     s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, item_id ORDER BY pos) AS span FROM n)
    SELECT doc_id, item_id, min(pos) AS first_word, max(pos) + 12 AS end_word FROM s GROUP BY doc_id, item_id, span"""
    return {"p7_spans": spans, "p2_texts": p2, "p4_found": p4, "p4_cleaned": cleaned, "p8_laws": p8, "p6_found": p6, "p7_found": p7}
