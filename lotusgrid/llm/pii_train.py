"""Training of the name model: logistic regression on labelled candidates.

Labels come from two places. Sentences are made from the fixed lists of names and of
surroundings, names beside roads, firms and wards that are called after persons. In
at most ``max_documents`` documents (a parameter; a bounded sample of labelled rows)
every candidate is labelled by whether a form of address makes it a name.

Run ``python -m lotusgrid.llm.pii_train DOCUMENTS.parquet``.
"""

from __future__ import annotations

import json
import os
import random
import sys

import numpy as np

from . import pii, pii_names

# Sentences around a person (P) and around what is called after one (N).
PERSONS = [
    "{} cho biết xe tải lao tới rất nhanh.", "Theo lời kể của {}, trời lúc đó mưa to.", "Bác sĩ {} trực cấp cứu đêm qua.", "Luật sư {} nhận hồ sơ.", "Trung tá {} chỉ huy.", "Sáng nay {} bị thương ở chân.", "Nạn nhân là {}, trú tại Gia Lâm.",
    "Công an bắt {} vì bỏ chạy.", "Xe do {} điều khiển lật nghiêng.", "{} (34 tuổi) đã tử vong.", "Gia đình gặp {} hôm qua.", "{} kể lại vụ việc.", "Vợ chồng {} và con nhỏ.", "{} đã khai nhận.", "Tài xế {} không có bằng lái.", "Tối qua, {} lái xe về nhà.",
    "{} was injured in the crash.", "Police arrested {} on Sunday.", "The driver, {}, was taken away.", "{} said the road was wet.", "The car was driven by {}.", "{}, 45, died at the scene.", "Officer {} wrote the report.", "Witnesses told {} to stop.", "{} has lived here for years.", "A rider named {} fell.",
]
OTHERS = [
    "Xe chạy trên đường {} lúc nửa đêm.", "Phố {} ngập sâu.", "Cầu {} đang sửa.", "Phường {} có chốt mới.", "Công ty {} chở hàng.", "Trường {} tan học.", "Bệnh viện {} tiếp nhận.", "Ùn tắc tại {} kéo dài.", "Đoạn qua {} hẹp.", "Đường {} giao với phố {}.", "Xe từ {} tới {}.", "Khu {} mất điện.",
    "A truck on {} Street stopped.", "Near {} Bridge traffic is slow.", "The {} Company owns the bus.", "They drove to {} Park.", "Patients went to {} Hospital.", "Turn left at {} Road.", "Chợ {} họp sớm.", "Ngõ {} hẹp.", "Tiệm {} mở cửa.", "Công an {} vào cuộc.", "Nút giao {} thông xe.", "Quận {} có ba vụ.",
]
_EN_LAST = "Smith Lopez Brown Miller Wilson Moore Taylor Clark Lewis Walker Young King Wright Hill Green Baker Nelson Carter Evans Turner".split()


def person(rng: random.Random, english: bool) -> str:
    if english:
        return f"{rng.choice(pii_names.GIVEN)} {rng.choice(_EN_LAST)}"
    middle = [rng.choice(pii_names.MIDDLE)] if rng.random() < 0.8 else []
    return " ".join([rng.choice(pii_names.FAMILY), *middle, rng.choice(pii_names.LAST)])


def samples(documents: list[str], n: int = 6000, seed: int = 7) -> tuple[list[list[str]], list[int]]:
    """(features, label) of candidates."""
    rng, xs, ys = random.Random(seed), [], []
    for _ in range(n):
        label = rng.random() < 0.5
        s = rng.choice(PERSONS if label else OTHERS)
        english = s.isascii()
        text = s.replace("{}", "\0").replace("\0", person(rng, english), 1)
        text = text.replace("\0", person(rng, english))
        if rng.random() < 0.1:
            text = text.upper()
        for a, e in pii_names.candidates(text):
            xs.append(pii_names.features(text, a, e))
            ys.append(int(label))
    for t in documents:
        told = {(a, e) for a, e, k in pii.find(t, model=False) if k == "name"}
        for a, e in pii_names.candidates(t):
            xs.append(pii_names.features(t, a, e))
            ys.append(int((a, e) in told))
    return xs, ys


def train(xs: list[list[str]], ys: list[int], rounds: int = 400, rate: float = 0.5, decay: float = 1e-4) -> dict[str, float]:
    place = {f: k for k, f in enumerate(["bias", *sorted({f for x in xs for f in x})])}
    m = np.zeros((len(xs), len(place)))
    m[:, 0] = 1
    for k, x in enumerate(xs):
        m[k, [place[f] for f in x]] = 1
    y, w = np.array(ys, dtype=float), np.zeros(len(place))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-m @ w))
        w -= rate * (m.T @ (p - y) / len(y) * 4 + decay * w)
    return {f: round(float(w[k]), 3) for f, k in place.items()}


def main(path: str, max_documents: int = 5000) -> None:
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(path, columns=["text"]).column(0).to_pylist() if t][:max_documents]
    xs, ys = samples(texts)
    cut = len(xs) // 5
    order = list(range(len(xs)))
    random.Random(3).shuffle(order)
    held, rest = order[:cut], order[cut:]
    w = train([xs[k] for k in rest], [ys[k] for k in rest])
    said = [(w["bias"] + sum(w.get(f, 0) for f in xs[k]) > 0, ys[k]) for k in held]
    hit = sum(a and b for a, b in said)
    print(f"held out {len(held)}: precision {hit / max(1, sum(a for a, _ in said)):.4f}, recall {hit / max(1, sum(b for _, b in said)):.4f}")
    with open(os.path.join(os.path.dirname(__file__), "pii_weights.json"), "w") as f:
        json.dump(w, f, indent=0, sort_keys=True)
        f.write("\n")


if __name__ == "__main__":
    main(sys.argv[1])
