"""Personal information in free text (problem 9).

``find`` gives the spans of e-mail addresses, phone numbers, identity numbers,
street addresses and names of persons, on request also dates; ``mask`` replaces each by
a placeholder of its kind. Names are found by a form of address or another word that
introduces a person, and without one by a trained model (``pii_names``). Numbers are
validated (number of digits, prefix, grouping) and then pseudonymised by a
format-preserving Feistel network: their digits are permuted, under a key, among the
numbers of the same format and kind (mobile, landline; identity numbers that begin with
a given province), so that equal values - however they are grouped - get equal
pseudonyms in all documents and stay linked, while separators and prefixes keep their
form. Dates are permuted among the days of a range (``feistel_date``). Values without a
number format (mail, address, name) get a keyed tag.

Matching is done on the composed form; spans are given back in the stored text.

Defined results: null and empty text holds nothing and stays as it is; a value met
twice in a document counts once in ``found``; of overlapping spans the one that
starts first, then the longer one, wins; text outside spans is untouched.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import spread
from .batches import slices
from .pii_names import names as model_names

_UP = "A-ZÀ-ÖØ-ÝĂĐĨŨƠƯẠẢẤẦẨẪẬẮẰẲẴẶẸẺẼẾỀỂỄỆỈỊỌỎỐỒỔỖỘỚỜỞỠỢỤỦỨỪỬỮỰỲỴỶỸ"
_LOW = "a-zà-öø-ÿăđĩũơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ"
_S = r"[^\S\n]{1,3}"
_TITLE = f"[{_UP}][{_LOW}]*"
_CAPS = f"[{_UP}]{{1,9}}"
_END = f"(?![{_UP}{_LOW}])"
#: Two to five words, all in title case or all in capitals.
_PERSON = f"(?:{_CAPS}(?:{_S}{_CAPS}){{1,4}}{_END}|{_TITLE}(?:{_S}{_TITLE}){{1,4}}{_END})"
_PERSON_EN = f"(?:[A-Z][a-z]+(?:{_S}[A-Z]\\.)?(?:{_S}[A-Z][a-z]+){{1,2}}|[A-Z]{{2,}}(?:{_S}[A-Z]\\.)?(?:{_S}[A-Z]{{2,}}){{1,2}}){_END}"
# Words that introduce a person.
_FORMS = "ông|bà|anh|chị|cô|chú|bác|dì|cậu|mợ|thím|em gái|em trai|anh trai|chị gái|tài xế|lái xe|nạn nhân|bị cáo|bị hại|nhân chứng|ông ấy tên|tên là|họ tên|họ và tên|tôi là|mình là|em là|xác định là|danh tính là|thân của|ký tên|người ký|chủ xe là"
_FORMS_RX = "|".join(f"[{f[0].upper()}{f[0]}]{f[1:]}" if f[0].upper() != f[0] else f for f in _FORMS.split("|")).replace(" ", _S)
_LEADS = f"(?:[Tt]heo{_S}biên{_S}bản|[Tt]rả{_S}lời{_S}[{_LOW} ]{{2,40}})"
NAME_VI = re.compile(f"(?:(?<![{_UP}{_LOW}\\d])(?:{_FORMS_RX}):?{_S}|{_LEADS},{_S})({_PERSON})(?:{_S}(?:cùng|và){_S}({_PERSON}))?")
_FORMS_EN = "ask for|asked for|signed by|sign(?:s|ed) as|reach|contact|named|my name is|I am|Mr\\.?|Mrs\\.?|Ms\\.?|Dr\\.?|driver|witness|victim"
NAME_EN = re.compile(f"(?:\\b(?:{_FORMS_EN}){_S}({_PERSON_EN}))|(?:({_PERSON_EN})(?=(?:,{_S}\\d{{2}},|,{_S}aged{_S}\\d|{_S}(?:lives?|lived|resides){_S}at\\b|,{_S}passport\\b)))")
FORM_EN = re.compile(f"(?:(?:Driver|Witness|Victim|Passenger|Rider|Officer|Mr\\.?|Mrs\\.?|Ms\\.?|Dr\\.?|Uncle|Aunt){_S})+")
EMAIL = re.compile(
    r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]*(?:@| @ | ?\[at\] ?| ?\(at\) ?| a còng | at (?=[A-Za-z0-9-]+ (?:dot|chấm) ))"
    r"[A-Za-z0-9-]+(?:(?:\.| ?\[dot\] ?| ?\(dot\) ?| dot | chấm )[A-Za-z0-9-]*[A-Za-z0-9])+".replace(" ", "[^\\S\\n]"),
    re.I,
)
_SEP = r"[ .\-\xa0]"
PHONE = re.compile(
    r"(?<![\w.+/-])(?<!\d )(?:"
    rf"(?:\(\+84\)|\+84|\(0084\)|0084){_SEP}?(?:\(0\))?\d{{2,3}}{_SEP}?\d{{3}}{_SEP}?\d{{3,4}}"
    rf"|\(0\d{{2,3}}\){_SEP}?\d{{3,4}}{_SEP}?\d{{4}}"
    rf"|02\d{{1,2}}{_SEP}\d{{3,4}}{_SEP}\d{{4}}"
    rf"|02\d{{9}}"
    rf"|0\d{{9}}"
    rf"|0\d{{3}}{_SEP}\d{{3}}{_SEP}\d{{3}}"
    rf"|0\d{{2}}{_SEP}\d{{3}}{_SEP}\d{{4}}"
    rf"|0\d{{2}}{_SEP}\d{{2}}{_SEP}\d{{2}}{_SEP}\d{{3}}"
    r")(?![\w/])(?![.\-]\d)(?!\s(?:đồng|triệu)\b)"
)
_ID_WORDS = "căn cước|CMND|CMT|CCCD|chứng minh|hộ chiếu|giấy tờ|passport|identity|ID card|ID number|card numbered"
#: Parts of these words; a text with none of them has no identity number.
_ID_SIGNS = ("cước", "cmnd", "cmt", "cccd", "minh", "chiếu", "giấy", "passport", "identity", "card", "number")
ID = re.compile(
    r"(?<![\w.+/\-])(?:[A-Z]\d{7}|\d{12}|\d{9}|\d{3}(?:[ \xa0]\d{3}){2,3}|\d{3}(?:\.\d{3}){2,3}|\d{4}(?:[. \-]\d{4}){2})(?!\w)(?![ .\-]\d)"
)
#: What stands before an identity number.
ID_BEFORE = re.compile(
    f"(?:{_ID_WORDS})".replace(" ", _S) + r"(?:[^\S\n]+(?!vụ\b)[^\W\d_]+){0,5}?[:\s(]{1,3}(?:(?:số|no\.?|number|numbered):?[^\S\n]{1,3})?$",
    re.I,
)
_PLACE = f"[{_UP}][{_UP}{_LOW}]*(?:{_S}[{_UP}][{_UP}{_LOW}]*)*"
_UNIT = "phường|xã|thị trấn|thị xã|quận|huyện|thành phố|tỉnh|khu phố|thôn|tổ|P\\.|Q\\.|X\\.|H\\.|TP\\.?|TX\\.|TT\\.|T\\."
_TAIL = f"(?:,{_S}(?:(?:{_UNIT})[^\\S\\n]{{0,3}})?{_PLACE})*"
_NO = r"\d+[A-Za-z]?(?:/\d+[A-Za-z]?)*"
#: An address from its number on.
ADDRESS = re.compile(
    f"(?<![\\w/.-])(?<![\\d],){_NO}(?:"
    f"(?:,?{_S}(?:nhà|tòa|toà|lô|block){_S}[A-Z]{{1,2}}\\d*)?(?:,?{_S}(?:ngõ|ngách|hẻm|kiệt|tổ){_S}{_NO})*,?{_S}"
    f"(?:đường|phố|Đ\\.|đ\\.|Ph\\.|khu(?:{_S}tập{_S}thể|{_S}đô{_S}thị)?|ngõ|hẻm|thôn|xóm|ấp)[^\\S\\n]{{0,3}}{_PLACE}{_TAIL}"
    f"|{_S}{_PLACE}{_S}(?:Street|Lane|Road|Avenue|Alley)(?:,{_S}{_PLACE})*)"
)
#: The words that introduce the number.
ADDRESS_BEFORE = re.compile(f"(?:[Ss]ố{_S}nhà|[Nn]hà{_S}số|[Ss]ố|[Cc]ăn{_S}hộ|[Pp]hòng(?:{_S}số)?|[Nn]hà|No\\.|Number|Room|Flat|Apartment){_S}$")
_DATE_WORDS = f"(?P<d>\\d{{1,2}}){_S}tháng{_S}(?P<m>\\d{{1,2}}){_S}năm{_S}(?P<y>(?:19|20)\\d{{2}})(?!\\d)"
DATES = [
    re.compile(r"(?<![\w/.-])(?P<d>\d{1,2})(?P<s>[/.-])(?P<m>\d{1,2})(?P=s)(?P<y>(?:19|20)\d{2})(?![\w/-])(?!\.\d)"),
    re.compile(r"(?<![\w/.-])(?P<y>(?:19|20)\d{2})-(?P<m>\d{2})-(?P<d>\d{2})(?![\w/-])(?!\.\d)"),
    re.compile(f"(?<!\\d){_DATE_WORDS}"),
]
_CLUSTER = re.compile("[^\\u0300-\\u036f][\\u0300-\\u036f]+")


def _composed(text: str) -> tuple[str, list[int] | None]:
    """The composed form, and for each of its places (and its end) the place in the text; None: the same."""
    if not _CLUSTER.search(text):
        return text, None
    out, places, at = [], [], 0
    for m in _CLUSTER.finditer(text):
        a, e = m.span()
        out.append(text[at:a])
        places.extend(range(at, a))
        c = unicodedata.normalize("NFC", m.group())
        out.append(c)
        places.extend([a] * len(c))
        at = e
    out.append(text[at:])
    places.extend(range(at, len(text) + 1))
    return "".join(out), places


def dates(text: str) -> Iterator[tuple[int, int, re.Match]]:
    """(start, end, match) of the dates of a text that are days of the calendar."""
    for rx in DATES:
        for m in rx.finditer(text):
            try:
                datetime.date(int(m["y"]), int(m["m"]), int(m["d"]))
            except ValueError:
                continue
            yield m.start(), m.end(), m


def find(text: str | None, model: bool = True, with_dates: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the personal information in a text, in order, without overlaps.

    ``model`` takes names without a form of address too; ``with_dates`` adds the kind ``date``.
    """
    if not text:
        return []
    t, places = _composed(text)
    spans: list[tuple[int, int, str]] = []
    if "@" in t or "at" in t or "AT" in t or "còng" in t:
        spans += [(*m.span(), "email") for m in EMAIL.finditer(t)]
    low = t.lower()
    if any(w in low for w in _ID_SIGNS):
        spans += [(*m.span(), "id_number") for m in ID.finditer(t) if ID_BEFORE.search(t, max(0, m.start() - 60), m.start())]
    spans += [(*m.span(), "phone") for m in PHONE.finditer(t)]
    for m in ADDRESS.finditer(t):
        before = ADDRESS_BEFORE.search(t, max(0, m.start() - 14), m.start())
        spans.append((before.start() if before else m.start(), m.end(), "address"))
    for rx in (NAME_VI, NAME_EN):
        for m in rx.finditer(t):
            for k in (1, 2):
                if m.group(k):
                    a, e = m.span(k)
                    form = FORM_EN.match(t, a, e) if rx is NAME_EN else None
                    if form is None or " " in t[form.end() : e].strip():
                        spans.append((form.end() if form else a, e, "name"))
    if model:
        told = [(a, e) for a, e, kind in spans if kind in ("name", "address")]
        spans += [(a, e, "name") for a, e in model_names(t) if not any(a < y and x < e for x, y in told)]
    if with_dates:
        spans += [(a, e, "date") for a, e, _ in dates(t)]
    spans.sort(key=lambda s: (s[0], -s[1]))
    out: list[tuple[int, int, str]] = []
    for a, e, kind in spans:
        if not out or a >= out[-1][1]:
            out.append((a, e, kind))
    if places is not None:
        out = [(places[a], places[e], kind) for a, e, kind in out]
    return out


def feistel(digits: str, key: bytes, tweak: str = "", rounds: int = 10) -> str:
    """A keyed permutation of the decimal strings of one length (alternating Feistel network)."""
    n = len(digits)
    if n < 2:
        return str((int(digits) + hmac.digest(key, f"{tweak}|1".encode(), "sha256")[0]) % 10) if n else digits
    u = n // 2
    a, b = int(digits[:u]), int(digits[u:])
    for r in range(rounds):
        size = u if r % 2 == 0 else n - u
        f = int.from_bytes(hmac.digest(key, f"{tweak}|{n}|{r}|{b}".encode(), "sha256")[:16], "big")
        a, b = b, (a + f) % 10**size
    return str(a).zfill(u if rounds % 2 == 0 else n - u) + str(b).zfill(n - u if rounds % 2 == 0 else u)


def unfeistel(digits: str, key: bytes, tweak: str = "", rounds: int = 10) -> str:
    """The inverse of ``feistel``."""
    n = len(digits)
    if n < 2:
        return str((int(digits) - hmac.digest(key, f"{tweak}|1".encode(), "sha256")[0]) % 10) if n else digits
    u = n // 2
    first = u if rounds % 2 == 0 else n - u
    a, b = int(digits[:first]), int(digits[first:])
    for r in range(rounds - 1, -1, -1):
        size = u if r % 2 == 0 else n - u
        f = int.from_bytes(hmac.digest(key, f"{tweak}|{n}|{r}|{a}".encode(), "sha256")[:16], "big")
        a, b = (b - f) % 10**size, a
    return str(a).zfill(u) + str(b).zfill(n - u)


def feistel_date(day: datetime.date, key: bytes, first: datetime.date = datetime.date(1900, 1, 1), last: datetime.date = datetime.date(2099, 12, 31)) -> datetime.date:
    """A keyed permutation of the days of a range; days outside stay. Cycle walking keeps it inside the range."""
    n = (last - first).days + 1
    k = (day - first).days
    if not 0 <= k < n:
        return day
    width = max(2, len(str(n - 1)))
    while True:
        k = int(feistel(str(k).zfill(width), key, "date"))
        if k < n:
            return first + datetime.timedelta(days=k)


def _phone_kind(rest: str) -> str:
    """Mobile, landline or other, by the digits behind the country or trunk prefix."""
    return "mobile" if len(rest) == 9 and rest[0] in "35789" else "landline" if len(rest) == 10 and rest[0] == "2" else "other"


def _id_kind(digits: str) -> str:
    """Whether twelve digits begin with a province code and a century sign that are given out."""
    return "given" if len(digits) == 12 and 1 <= int(digits[:3]) <= 96 and digits[3] in "0123" else "other"


def _walk(digits: str, key: bytes, tweak: str, kind: Callable[[str], str]) -> str:
    """The permutation within the numbers of one kind, by walking the cycle until the kind comes again."""
    wanted, new = kind(digits), feistel(digits, key, tweak)
    while kind(new) != wanted:
        new = feistel(new, key, tweak)
    return new


def pseudonym(value: str, kind: str, key: bytes) -> str:
    """A value of the same format and kind for numbers and dates, a keyed tag for the rest."""
    value = unicodedata.normalize("NFC", value)
    if kind == "date" and (got := next(dates(value), None)):
        m = got[2]
        day = feistel_date(datetime.date(int(m["y"]), int(m["m"]), int(m["d"])), key)
        put = {"y": f"{day.year}", "m": f"{day.month:0{len(m['m'])}d}", "d": f"{day.day:0{len(m['d'])}d}"}
        out = value
        for g in sorted(put, key=lambda g: -m.start(g)):
            out = out[: m.start(g)] + put[g] + out[m.end(g) :]
        return out
    if kind in ("phone", "id_number"):
        digits = re.sub(r"\D", "", value)
        keep = 0
        if kind == "phone":
            if digits.startswith(("84", "0084")) and ("+" in value or digits.startswith("0084")):
                keep = 2 if digits.startswith("84") else 4
                keep += digits[keep : keep + 1] == "0"
            else:
                keep = 1
        # The country form and the trunk form of one number share the permuted part.
        new = digits[:keep] + _walk(digits[keep:], key, kind, _phone_kind if kind == "phone" else _id_kind)
        it = iter(new)
        return "".join(next(it) if c.isdigit() else c for c in value)
    flat = " ".join(value.lower().split())
    return hmac.digest(key, f"{kind}|{flat}".encode(), "sha256").hex()[:10]


def mask(text: str | None, key: bytes, with_dates: bool = False) -> str | None:
    """The text with typed placeholders."""
    spans = find(text, with_dates=with_dates)
    if not spans:
        return text
    out, at = [], 0
    for a, e, kind in spans:
        out += [text[at:a], f"[{kind.upper()}:{pseudonym(text[a:e], kind, key)}]"]
        at = e
    return "".join([*out, text[at:]])


def masked(text: Column, key: bytes | str, with_dates: bool = False) -> Column:
    """A text column with typed placeholders."""
    k = key.encode() if isinstance(key, str) else key

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: mask(t, k, with_dates), na_action="ignore")

    return run(text)


def found(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kind, found), each once; found stands as in the text. One map step, repeated ids are met in a distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1000):
            rows = []
            for r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if r is not None and t:
                    rows += [(r, kind, x) for kind, x in dict.fromkeys((k, t[a:e]) for a, e, k in find(t))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], kind_of), pa.array([x[1] for x in rows], pa.string()), pa.array([x[2] for x in rows], pa.string())], names=[doc_id, "kind", "found"])

    docs = df.select(doc_id, text)
    kind_of = to_arrow_type(docs.schema[0].dataType)
    return spread(docs, doc_id).mapInArrow(run, f"`{doc_id}` {docs.dtypes[0][1]}, kind string, found string").distinct()


def masked_documents(df: DataFrame, key: bytes | str, doc_id: str = "doc_id", text: str = "text", with_dates: bool = False) -> DataFrame:
    """(doc_id, text) of all documents with placeholders; ``with_dates`` permutes dates too."""
    return spread(df.select(doc_id, text), doc_id).select(doc_id, masked(F.col(text), key, with_dates).alias(text))


def fingerprint(key: bytes) -> str:
    """A short name of a key, to be kept with masked data."""
    return hashlib.sha256(b"key|" + key).hexdigest()[:8]
