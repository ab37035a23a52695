"""One form for text that looks the same (problem 6).

A transducer is compiled once from five rule families: invisible characters are
deleted, wide and narrow forms take their ordinary width, space characters become
U+0020, look-alike letters of other scripts become Latin, and canonical forms are
composed. Its input unit is the grapheme cluster (a base and every mark or invisible
character behind it); the longest cluster is matched and rewritten, all in one pass.
``compile_tables`` collects, over all of Unicode, what each family makes of each
character, and of look-alike letters with each Vietnamese mark, follows it to its fixed
point, and rejects an input for which two families end differently or an output that
is no fixed point. Clusters beyond the compiled ones (several marks, rare signs) are
worked out by the same rules when first met, and remembered.

Kept apart on purpose: letter case, tone marks, punctuation, tabs and line ends,
and the number and place of spaces.

Defined results: null stays null, "" stays "", text that is only invisible
characters becomes "".
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread
from .batches import slices

# Letters of other scripts drawn like Latin ones.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "Ϲ": "C", "ϳ": "j",
    "Ð": "Đ", "Ɖ": "Đ", "ɑ": "a", "ɡ": "g", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ᴜ": "u",
    "α": "a", "ι": "i", "ρ": "p", "υ": "u", "γ": "y",
    "Օ": "O", "Տ": "S", "Ս": "U", "Լ": "L", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "զ": "q", "ց": "g", "յ": "j",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z",
    "Ꮤ": "W", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N",
    "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    "Ⲃ": "B", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X",
}
# Marks that Vietnamese letters carry.
MARKS = "\u0300\u0301\u0302\u0303\u0306\u0309\u031b\u0323"
# Signs without a look of their own that are not of category Cf.
BLANKS = "͏ᅟᅠㅤﾠ឴឵⠀"
#: Marks that belong to a letter's shape sort before tone marks.
SHAPE_MARKS = "̛̂̆"


def _invisible(ch: str) -> bool:
    return unicodedata.category(ch) == "Cf" or ch in BLANKS or "︀" <= ch <= "️" or "\U000e0100" <= ch <= "\U000e01ef"


def _width(ch: str) -> str:
    d = unicodedata.decomposition(ch)
    return "".join(chr(int(x, 16)) for x in d.split()[1:]) if d.startswith(("<wide>", "<narrow>")) else ch


def _char(ch: str, look: dict[str, str] = LOOKALIKES) -> str:
    """What one character becomes, apart from composition."""
    if _invisible(ch):
        return ""
    ch = _width(ch)
    if unicodedata.category(ch) == "Zs":
        return " "
    return look.get(ch, ch)


def _order(marks: str) -> str:
    return "".join(sorted(marks, key=lambda m: (m not in SHAPE_MARKS, unicodedata.combining(m))))


def cluster(text: str, look: dict[str, str] = LOOKALIKES) -> str:
    """The one form of a grapheme cluster, by definition (the slow way)."""
    out: list[str] = []
    for ch in unicodedata.normalize("NFD", "".join(_char(c, look) for c in text)):
        out.append(_char(ch, look))
    flat, base, marks, done = unicodedata.normalize("NFD", "".join(out)), "", "", []
    for ch in flat:
        if unicodedata.combining(ch):
            marks += ch
        else:
            done.append(base + _order(marks))
            base, marks = ch, ""
    done.append(base + _order(marks))
    return unicodedata.normalize("NFC", "".join(done))


def rules(ch: str, look: dict[str, str] = LOOKALIKES) -> dict[str, str]:
    """What each family that has a rule for a character makes of it, on its own."""
    out = {}
    if _invisible(ch):
        out["invisible"] = ""
    if (w := _width(ch)) != ch:
        out["width"] = w
    if unicodedata.category(ch) == "Zs":
        out["space"] = " "
    if look.get(ch, ch) != ch:
        out["look-alike"] = look[ch]
    if (d := unicodedata.normalize("NFD", ch)) != ch:
        out["canonical"] = d
    return out


def compile_tables(last: int = 0x2FFFF, look: dict[str, str] = LOOKALIKES) -> tuple[dict[str, str], str, str]:
    """The map of characters and marked look-alikes, and the character classes of changed characters and of followers."""
    single: dict[str, str] = {}
    follow: set[int] = set()
    for i in [*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, last + 1), *range(0xE0001, 0xE01F0)]:
        ch = chr(i)
        if unicodedata.category(ch) == "Cn":
            continue
        told = rules(ch, look)
        if unicodedata.combining(ch) or "invisible" in told:
            follow.add(i)
        if not told and not unicodedata.combining(ch):
            continue
        ends = {f: cluster(out, look) for f, out in told.items()}
        one = cluster(ch, look)
        if any(e != one for e in ends.values()) or cluster(one, look) != one:
            raise ValueError(f"conflicting rules for U+{i:04X}: {ends | {'all': one}}")
        if one != ch:
            single[ch] = one
    for ch in look:
        for m in MARKS:
            one = cluster(ch + m, look)
            if one != cluster(single[ch] + m, look) or cluster(one, look) != one:
                raise ValueError(f"conflicting rules for U+{ord(ch):04X} with U+{ord(m):04X}")
            single[ch + m] = one
    return single, _ranges([ord(c) for c in single if len(c) == 1 and ord(c) not in follow]), _ranges(sorted(follow))


def _ranges(points: list[int]) -> str:
    out, points = [], sorted(points)
    start = prev = None
    for p in [*points, None]:
        if prev is not None and p == prev + 1:
            prev = p
            continue
        if start is not None:
            out.append(f"\\U{start:08x}" + (f"-\\U{prev:08x}" if prev > start else ""))
        start = prev = p
    return "".join(out)


#: Characters that every rule leaves alone and that texts mostly consist of; few ranges, so that the scan is quick.
PLAIN = "\t\n -~\xa1-\xac\xae-\xcf\xd1-\u0188\u018a-\u01ff\u1ea0-\u1ef9\u2010-\u2027"


def _compile() -> tuple[re.Pattern, re.Pattern, dict[str, str]]:
    single, changed, follow = compile_tables()
    plain = re.compile(f"[{PLAIN}]")
    if bad := [hex(ord(c)) for c in single if len(c) == 1 and plain.match(c)]:
        raise ValueError(f"not left alone: {bad}")
    return re.compile(f"[^{PLAIN}]+"), re.compile(f"[^{follow}]?[{follow}]+|[{changed}]", re.S), single


NEEDS, UNIT, MEMO = _compile()


def _put(m: re.Match) -> str:
    s = m.group()
    out = MEMO.get(s)
    if out is None:
        out = cluster(s)
        if len(MEMO) < 200_000:
            MEMO[s] = out
    return out


def canon(text: str | None) -> str | None:
    """The one form of a text.

    One pass: runs of characters outside ``PLAIN`` are found, each with the base
    character before it, and only these go through the transducer.
    """
    if not text:
        return text
    out, at = [], 0
    for m in NEEDS.finditer(text):
        start, end = m.span()
        start = max(start - 1, at)
        out.append(text[at:start])
        out.append(UNIT.sub(_put, text[start:end]))
        at = end
    if not at:
        return text
    out.append(text[at:])
    return "".join(out)


def one_form(text: Column) -> Column:
    """The one form of a text column."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(canon, na_action="ignore")

    return run(text)


def _hash(t: str) -> bytes:
    return xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass"))


def looks(df: DataFrame, record: str, fields: list[str]) -> DataFrame:
    """(field, rec, raw, look): 128-bit hashes of the stored and of the one form of each field that is neither null nor empty; one pass over all fields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rec, place, name, raw, look = b.column(0).to_pylist(), [], [], [], []
            for f, field in enumerate(fields, 1):
                for k, t in enumerate(b.column(f).to_pylist()):
                    if not t or rec[k] is None:
                        continue
                    h, c = _hash(t), canon(t)
                    place.append(k)
                    name.append(field)
                    raw.append(h)
                    look.append(h if c == t else _hash(c))
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), b.column(0).take(pa.array(place, pa.int64())), pa.array(raw, pa.binary()), pa.array(look, pa.binary())], names=["field", "rec", "raw", "look"])

    rows = df.select(F.col(record).alias("rec"), *[F.col(f).alias(f"f{k}") for k, f in enumerate(fields)])
    return spread(rows, "rec").mapInArrow(run, f"field string, rec {dict(rows.dtypes)['rec']}, raw binary, look binary")


def same_look(df: DataFrame, record: str, fields: list[str]) -> DataFrame:
    """Pairs of records whose field looks the same but is stored otherwise.

    Texts are read once and reduced to two hashes (stored form, one form), which are
    written; variants of one look are paired first and only then joined to their
    records, so copies of one stored form never meet each other and the work is that of
    the result. Null and empty fields never match; a record id met twice counts once per
    stored form.
    """
    rows = cut(looks(df, record, fields), "looks")
    variants = rows.select("field", "look", "raw").distinct()
    many = variants.groupBy("field", "look").agg(F.count("*").alias("n")).where("n > 1").select("field", "look")
    rows = rows.join(many, ["field", "look"], "left_semi").distinct()
    a = rows.select("field", "look", F.col("raw").alias("ra"), F.col("rec").alias("record_a"))
    b = rows.select("field", "look", F.col("raw").alias("rb"), F.col("rec").alias("record_b"))
    return a.join(b, ["field", "look"]).where("ra <> rb and record_a < record_b").select("field", "record_a", "record_b").distinct()
