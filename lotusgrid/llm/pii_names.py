"""Names of persons without a form of address: a log-linear model over a name and its surroundings.

A candidate is a run of two to four capitalised words that begins with a known family
name (Vietnamese) or given name (English). Its score is a sum of weights of features:
what the name is made of, the word before it, the words behind it. The weights were
trained by ``pii_train`` and are stored beside this module. Known places are never names.
"""

from __future__ import annotations

import json
import os
import re

from ..functions import lexicon

# Common Vietnamese family names.
FAMILY = "Nguyễn Trần Lê Phạm Hoàng Huỳnh Phan Vũ Võ Đặng Bùi Đỗ Hồ Ngô Dương Lý Đinh Trịnh Đoàn Lương Mai Tô Trương Lâm Hà Đào Tạ Cao Chu Châu Quách Thái La Phùng Vương Từ Kiều Doãn Nghiêm Khổng".split()
# Frequent middle names.
MIDDLE = "Văn Thị Đức Quang Thanh Minh Ngọc Hữu Xuân Thu Đình Công Quốc Duy Bá Trọng Mạnh Tuấn Hồng Kim Thế Viết Như Bảo Gia Anh Tiến Hải Việt Khắc".split()
# Frequent Vietnamese given names.
LAST = (
    "An Anh Bình Bảo Châu Chi Chiến Cường Cúc Dũng Dung Duy Duyên Đạt Đông Đức Giang Hà Hải Hạnh Hằng Hân Hậu Hiền Hiệp Hiếu Hoa Hòa Hoàn Hoàng Hùng Huệ Hưng Hương Hường Huy Huyền Khanh Khánh Khoa Kiên Lan Lâm Linh Loan Lộc Lợi Long Ly Mai Minh My Nam "
    "Nga Ngân Nghĩa Ngọc Nguyên Nhi Nhung Oanh Phong Phú Phúc Phương Phượng Quân Quang Quý Quyên Quỳnh Sơn Tài Tâm Tân Thái Thanh Thành Thảo Thắng Thịnh Thu Thủy Thúy Thư Tiến Toàn Trang Trâm Trí Trinh Trung Tú Tuấn Tùng Tuyết Uyên Vân Việt Vinh Vũ Vy Yến"
).split()
# Frequent English given names.
GIVEN = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Mark Donald Steven Paul Andrew Joshua Kenneth Kevin Brian George Edward Ronald Timothy Jason Jeffrey Ryan Jacob Gary "
    "Nicholas Eric Jonathan Stephen Larry Justin Scott Brandon Benjamin Samuel Frank Gregory Raymond Alexander Patrick Jack Dennis Peter Henry Carlos Juan Jose Luis Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica "
    "Sarah Karen Nancy Lisa Betty Margaret Sandra Ashley Kimberly Emily Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Laura Helen Sharon Cynthia Kathleen Amy Shirley Angela Anna Ruth Maria Alice Julia Rachel Emma Olivia"
).split()
# Words before a name, by kind.
BEFORE = {
    "form": "ông bà anh chị cô chú bác dì cậu em cụ cháu bé sĩ sư viên úy tá tướng trưởng phó xế nhân cáo can giáo mr mrs ms miss dr officer driver witness victim passenger sir judge".split(),
    "object": "của là gặp bắt giữ với cùng và do bởi tên thương hại tìm cứu by named arrested charged killed injured told met hit struck called of with and identified contact".split(),
    "place": "đường phố ngõ hẻm ngách kiệt cầu hầm phường xã quận huyện tỉnh thôn xóm ấp làng khu chợ trường viện ty hãng quán tiệm ga bến tượng đài lộ tại ở qua vườn tuyến vào trục an tiểu thpt thcs at near in on street road company school hospital bridge from to".split(),
}
# Words behind a name, by kind.
BEHIND = {
    "deed": "cho kể nói khai bị đã đang điều lái trình là thừa sinh được có không nhớ chia từng về trú ngụ tử was were is said says told has had died suffered drove lives lived resides who and aged".split(),
    "place": "street road avenue lane alley ward district company bridge hospital school group park giao kẹt nối đoạn hướng thông".split(),
}
_KIND = [{w: k for k, ws in kinds.items() for w in ws} for kinds in (BEFORE, BEHIND)]
_FAMILY, _MIDDLE, _LAST_NAMES, _GIVEN = set(FAMILY), set(MIDDLE), set(LAST), set(GIVEN)
_PLACES = {p.lower() for p in [*lexicon.DISTRICTS, *lexicon.LANDMARKS, *lexicon.PROVINCES]} | {"hà nội", "thái lan", "cao tốc"}
_WORD = r"[A-ZÀ-ÖØ-ÝĂĐĨŨƠƯẠ-Ỹ][^\W\d_]*"
_RUN = re.compile(rf"(?<!\w){_WORD}(?:[^\S\n]{{1,3}}(?:[A-Z]\.|{_WORD}))+(?!\w)")
_LETTERS = re.compile(r"[^\W\d_]+")
_LAST = re.compile(r"([^\W\d_]+|[^\w\s])[^\S\n]*$")
_NEXT = re.compile(r"[^\S\n]*([^\W\d_]+|[^\w\s]|\d+)")
_AGE = re.compile(r"[^\S\n]?[,(][^\S\n]?(?:\d{1,2}(?:[^\S\n]tuổi)?\b|sn\b|sinh năm|aged\b)", re.I)


def _starts() -> re.Pattern:
    """A known name, in title case or capitals, with a capitalised word behind it; grouped by first letter, so that the scan is quick."""
    by: dict[str, list[str]] = {}
    for w in sorted({x for w in (*FAMILY, *GIVEN) for x in (w, w.upper())}, key=lambda w: (-len(w), w)):
        by.setdefault(w[0], []).append(w[1:])
    upper = _WORD[: _WORD.index("]") + 1]
    return re.compile("(?:" + "|".join(f"{c}(?:{'|'.join(ends)})" for c, ends in sorted(by.items())) + rf")(?=[^\S\n]{{1,3}}{upper})")


_START = _starts()


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of runs from their first known name on."""
    out, done = [], 0
    for m in _START.finditer(text):
        a = m.start()
        if a < done or (a and (text[a - 1].isalnum() or text[a - 1] == "_")):
            continue
        run = _RUN.match(text, a)
        if not run:
            continue
        done = run.end()
        words = [w.span() for w in _LETTERS.finditer(run.group())]
        e = a + words[min(3 if m.group().capitalize() in _FAMILY else 2, len(words) - 1)][1]
        if text[a:e].lower() not in _PLACES:
            out.append((a, e))
    return out


def features(text: str, a: int, e: int) -> list[str]:
    """Features of a candidate."""
    words = text[a:e].split()
    first, second = words[0].capitalize(), words[1].capitalize()
    before = _LAST.search(text, max(0, a - 24), a)
    behind = _NEXT.match(text, e, e + 24)
    b, n = before.group(1).lower() if before else "", behind.group(1).lower() if behind else ""
    f = ["vi" if first in _FAMILY else "en", f"n{len(words)}", "b:" + (_KIND[0].get(b) or ("start" if b in ("", ".", "!", "?", ":", "\"", "-") else "comma" if b in (",", ";") else "other"))]
    f.append("a:" + ("age" if _AGE.match(text, e) else _KIND[1].get(n) or ("end" if n in ("", ".", "!", "?", ";", ":", ")", "\"", "…") else "comma" if n == "," else "number" if n.isdigit() else "other")))
    if second in _MIDDLE and len(words) > 2:
        f.append("middle")
    if first in _FAMILY:
        if len(words) == 2:
            f.append("short")
        f.append("given" if words[-1].capitalize() in _LAST_NAMES else "rare")
    return f


def _told(text: str, a: int, e: int, f: list[str]) -> bool:
    """Whether there is evidence at all: a middle or given name or a form of address, and capitals that set the name apart."""
    if text[a:e].isupper() and any(w and len(w.group(1)) > 1 and w.group(1).isupper() for w in (_LAST.search(text, max(0, a - 24), a), _NEXT.match(text, e, e + 24))):
        return False
    return "en" in f or "b:form" in f or ("middle" in f and "given" in f)


def _weights() -> dict[str, float]:
    with open(os.path.join(os.path.dirname(__file__), "pii_weights.json")) as f:
        return json.load(f)


WEIGHTS = _weights()


def names(text: str, least: float = 0.0) -> list[tuple[int, int]]:
    """(start, end) of the candidates whose score is above ``least``."""
    get = WEIGHTS.get
    scored = ((a, e, features(text, a, e)) for a, e in candidates(text))
    return [(a, e) for a, e, f in scored if get("bias", 0.0) + sum(get(x, 0.0) for x in f) > least and _told(text, a, e, f)]
