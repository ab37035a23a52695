"""Training of the page content model from labelled pages.

    python -m lotusgrid.llm.content_train MANIFEST.parquet [PAGES]

Pages are labelled by ``label_page``: phrases of page furniture read off pages by
hand, with the order furniture - article - furniture. At most ``PAGES`` pages
(default 4,000, chosen by hash of the record id) are used; a fifth is held out.
Node weights are a multinomial logistic regression (AdaGrad, L2, dropout); edge, root and leaf tables are smoothed counts.
"""

from __future__ import annotations

import re
import sys
import zlib

import numpy as np

from .content import CONTENT, DIM, STATES, Model, _h, clean_lines, features, marginals, site_label, split_features

# Lines of page furniture.
FURNITURE = {
    "Trang nhất", "English | Tiếng Việt", "Chuyên mục", "Xe và đời sống", "Đường sắt", "Danh mục ☰", "Tra cứu điểm ùn tắc",
    "Chia sẻ bài viết này", "Bạn đọc viết", "Giao thông", "Về đầu trang", "Quảng cáo", "Quảng cáo - nội dung tiếp tục bên dưới",
    "An toàn trường học", "Bài và ảnh: Tổ Cầu Đường", "Hàng không", "Hạ tầng", "Readers write", "Sign in / Register", "Menu ☰", "Air",
    "Front page", "Listen to this story", "Sections", "Share this story", "Back to top", "Cars and living", "Rail", "Đăng nhập / Đăng ký",
    "Advertisement - story continues below", "Advertisement", "Nghe đọc bài (giọng nữ miền Bắc)",
    "Bấm vào đây để xem bản đồ ùn tắc trực tiếp", "Bạn đang xem phiên bản rút gọn. Chuyển sang bản đầy đủ?",
    "Cỡ chữ: A- A A+", "Text size: A- A A+", "Đã lên xe thì cất điện thoại, ai cũng có người chờ.",
    "Đi chậm một phút, về nhà trọn vẹn cả đời.", "Nhường một bước trên đường là giữ một bữa cơm sum vầy.",
}
# Headers of lists of other articles.
RELATED = {
    "Tin liên quan", "Cùng chuyên mục", "Có thể bạn quan tâm", "Bài cùng tác giả", "Đọc nhiều nhất", "More from this section",
    "Related stories", "You may also like", "Most read",
}
MARKS = re.compile(r"^(?:[•+–»-]\s|>>|Xem thêm:|See also:|Bạn đọc \S+:|Reader \S+:|Từ khóa:|Tags:|Lượt xem:|Views:)|[|·☰©]| > ")


def label_page(lines: list[str], label: str) -> list[int] | None:
    """States of a page's lines; None when no article is seen."""
    raw, below = [], False
    for s in lines:
        if s in RELATED:
            below = True
        raw.append(not (below or s in FURNITURE or MARKS.search(s) or label in s.lower()))
    own = [i for i, x in enumerate(raw) if x]
    if not own:
        return None
    return [CONTENT if x else 0 if i < own[0] else 3 if i > own[-1] else 2 for i, x in enumerate(raw)]


def train(pages: list[tuple[list[str], str]], epochs: int = 10, rate: float = 0.3, decay: float = 1e-6, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    xs, ys, edge, root, leaf = [], [], np.ones((STATES, STATES)), np.ones(STATES), np.ones(STATES)
    for lines, label in pages:
        states = label_page(lines, label)
        if not states:
            continue
        root[states[0]] += 1
        leaf[states[-1]] += 1
        for a, b in zip(states, states[1:]):
            edge[a, b] += 1
        for s, y in zip(lines, states):
            shape, lexical = split_features(s, label)
            xs.append((np.array([_h(x) for x in shape]), np.array([_h(x) for x in lexical])))
            ys.append(y)
    ys = np.array(ys)
    w, g = np.zeros((DIM, STATES)), np.full((DIM, STATES), 1e-3)
    for _ in range(epochs):
        order = rng.permutation(len(xs))
        for lo in range(0, len(order), 256):
            idx = order[lo : lo + 256]
            # Words are dropped at random, all of a line's words at times: layout and neighbours must do for unseen lines.
            rows = [np.concatenate([xs[i][0], xs[i][1][rng.random(len(xs[i][1])) > (1.0 if rng.random() < 0.12 else 0.2)]]) for i in idx]
            flat = np.concatenate(rows)
            owner = np.repeat(np.arange(len(idx)), [len(r) for r in rows])
            z = np.zeros((len(idx), STATES))
            np.add.at(z, owner, w[flat])
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(idx)), ys[idx]] -= 1
            grad = np.zeros_like(w)
            np.add.at(grad, flat, p[owner])
            grad = grad / 16 + decay * w
            g += grad * grad
            w -= rate * grad / np.sqrt(g)
    prior = np.bincount(ys, minlength=STATES) + 1.0
    prior = np.log(prior / prior.sum())
    # Half the log prior is taken off; it goes through the edge table, which every node but the first meets once.
    e = np.log(edge / edge.sum(1, keepdims=True)) - 0.5 * prior[None, :]
    return Model(w, e, np.log(root / root.sum()), np.log(leaf / leaf.sum()))


def score(pages: list[tuple[list[str], str]], m: Model) -> tuple[float, float]:
    """Precision and recall of content lines."""
    tp = fp = fn = 0
    for lines, label in pages:
        y = np.array([s == CONTENT for s in label_page(lines, label) or [0] * len(lines)])
        node = np.array([m.node[features(s, label)].sum(0) for s in lines])
        p = marginals(node, np.array([0]), np.array([len(lines)]), m)[:, CONTENT] >= 0.5
        tp, fp, fn = tp + (p & y).sum(), fp + (p & ~y).sum(), fn + (~p & y).sum()
    return tp / max(1, tp + fp), tp / max(1, tp + fn)


def main() -> None:
    import pandas as pd

    df = pd.read_parquet(sys.argv[1], columns=["record_id", "url", "body"]).dropna().drop_duplicates("body")
    df = df.assign(k=df.record_id.map(lambda i: zlib.crc32(str(i).encode()))).sort_values("k").head(int(sys.argv[2]) if len(sys.argv) > 2 else 4000)
    pages = [([s for _, s in clean_lines(b)], site_label(u)) for u, b in zip(df.url, df.body)]
    pages = [p for p in pages if p[0]]
    cut = len(pages) * 4 // 5
    m = train(pages[:cut])
    print("held out: precision %.5f recall %.5f" % score(pages[cut:], m))
    m.save(__file__.replace("content_train.py", "content_weights.npz"))


if __name__ == "__main__":
    main()
