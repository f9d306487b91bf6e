"""Operator 3: personal data by candidate generation, gradient-boosted trees and calibrated thresholds.

Base detectors find e-mail addresses, IPv4 addresses, payment cards and phone numbers by fixed patterns and checks;
their spans always stay. High-recall generators then propose further, overlapping spans (``GENERATORS``): spelled-out
addresses, and digit groups with other separators or without a plus sign. Boosted regression trees
score each proposal from format features (length, digit and separator counts, Luhn, entropy) and context features
(words before it); scores are calibrated on held-out proposals, and the threshold per kind is the smallest at
which the calibrated precision reaches ``precision``. Proposals that pass and overlap no better span are added.

Training needs labels, which a corpus lacks: the trees learn from proposals whose label is certain by construction (``examples``): rendered
from formats (positive) and near misses of the same shapes (negative), each set in words of the corpus's own sampled
rows: up to 100 words of each of at most ``sample_rows`` rows, picked by a hash of their id.

Defined cases: null and empty texts have no spans; a null doc_id stays null; repeated rows give the same row each; very long texts are searched whole; an empty table gives an empty one;
offsets are code points, ends exclusive; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, arrow_map, hash_sample

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base detectors, by start, then kind as listed. Each pattern takes time linear in the text."""
    out = []
    if "@" in text:
        done = 0
        for m in _DOMAIN.finditer(text):
            at = m.start()
            low = max(done, text.rfind("@", done, at) + 1)
            run = text[low:at]
            n = len(run) - len(run.rstrip(_LOCAL))
            if n:
                out.append((0, at - n, m.end()))
                done = m.end()
    if _DIGITS.search(text):
        out += [(1, m.start(), m.end()) for m in _ip_matches(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() <= 40:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m.group())) <= 15]
    return [(KINDS[k], a, b) for a, k, b in sorted((a, k, b) for k, a, b in out)]


def _ip_matches(text: str):
    """Leftmost matches of four dotted digit runs; after one, the search goes on behind it even inside a run."""
    at = 0
    first = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
    while True:
        m = first.match(text, at) or _IP.search(text, at)
        if not m:
            return
        yield m
        at = m.end()


#: High-recall generators of further spans: kind, what a text must hold to be searched, pattern.
GENERATORS: tuple[tuple[str, re.Pattern, re.Pattern], ...] = (
    (
        "email",
        re.compile(r"[\[({<] ?(?:at|AT) ?[\])}>]| at "),
        re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: ?[\[({<] ?(?:at|AT) ?[\])}>] ?| at )[A-Za-z0-9-]{1,63}(?:(?: ?[\[({<] ?(?:dot|DOT) ?[\])}>] ?| dot |\.)[A-Za-z0-9-]{1,63}){1,4}"),
    ),
    ("ip", re.compile(r"[0-9A-Fa-f]:[0-9A-Fa-f]"), re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    ("ip", re.compile(r"[0-9](?:\[\.\]|\(\.\)| \. )[0-9]"), re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)| \. )[0-9]{1,3}){3}(?![0-9])")),
    ("card", _DIGITS, re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20./_-]{1,2}[0-9]{3,6}){2,4}(?![0-9])")),
    ("phone", _DIGITS, re.compile(r"(?<![0-9+.])(?:00[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}[0-9]{2,5}){1,4}(?![0-9])")),
)
_CUES = {
    "email": ("mail", "contact", "write", "reach", "send"),
    "ip": ("ip", "host", "server", "address", "ping"),
    "card": ("card", "visa", "credit", "pay", "number"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
}


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Spans of all generators; they may overlap each other and base spans."""
    found = {(kind, m.start(), m.end()) for kind, needed, pattern in GENERATORS if needed.search(text) for m in pattern.finditer(text)}
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def describe(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context features of a proposal."""
    s = text[start:end]
    before = re.findall(r"\w+", text[max(0, start - 48) : start].lower())[-4:]
    digits = [c for c in s if c.isdigit()]
    counts = Counter(s)
    groups = re.findall(r"\d+", s)
    return [
        float(KINDS.index(kind)),
        float(len(s)),
        float(len(digits)),
        len(digits) / len(s),
        float(len(groups)),
        float(max(map(len, groups), default=0)),
        float(min(map(len, groups), default=0)),
        float(sum(not c.isalnum() for c in s)),
        float(s.count(" ")),
        float(s.count(".")),
        float(s.count("-")),
        float("(" in s or "[" in s),
        float(luhn("".join(digits)) if digits and all("0" <= d <= "9" for d in digits) else 0),
        float(all(int(g) <= 255 for g in groups if g.isascii()) if groups else 0),
        -sum(n / len(s) * math.log2(n / len(s)) for n in counts.values()),
        float(sum(any(w.startswith(c) for c in _CUES[kind]) for w in before)),
        float(any(w.isdigit() for w in before)),
        float(start == 0 or text[start - 1].isspace()),
        float(end == len(text) or not text[end].isalnum()),
        float(bool(re.search(r"(?:\bat\b|@)", s, re.I))),
        float(bool(re.search(r"\b(?:com|org|net|edu|de|fr|es|io)$", s, re.I))),
    ]


class Boosted:
    """Gradient boosting of depth-limited regression trees on the logistic loss, with quantile-binned features."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: int = 8):
        self.rounds, self.depth, self.rate, self.least = rounds, depth, rate, least
        self.trees: list[list] = []
        self.prior = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.prior = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.prior)
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 25))) for j in range(x.shape[1])]
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-f))
            tree = self._grow(x, y - q, q * (1 - q), np.arange(len(y)), cuts, self.depth)
            self.trees.append(tree)
            f += self.rate * self._apply(tree, x)
        return self

    def _grow(self, x, g, h, rows, cuts, depth):
        leaf = ["leaf", float(g[rows].sum() / (h[rows].sum() + 1.0))]
        if not depth or len(rows) < 2 * self.least:
            return leaf
        total_g, total_h, best = g[rows].sum(), h[rows].sum(), (1e-6, None, None)
        for j, at in enumerate(cuts):
            left = x[rows, j][:, None] <= at[None, :]
            gl, hl, n = g[rows] @ left, h[rows] @ left, left.sum(axis=0)
            gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
            gain[(n < self.least) | (len(rows) - n < self.least)] = -1
            k = int(gain.argmax()) if len(gain) else 0
            if len(gain) and gain[k] > best[0]:
                best = (float(gain[k]), j, float(at[k]))
        if best[1] is None:
            return leaf
        on = x[rows, best[1]] <= best[2]
        return ["split", best[1], best[2], self._grow(x, g, h, rows[on], cuts, depth - 1), self._grow(x, g, h, rows[~on], cuts, depth - 1)]

    def _apply(self, tree, x):
        if tree[0] == "leaf":
            return np.full(len(x), tree[1])
        on = x[:, tree[1]] <= tree[2]
        out = np.empty(len(x))
        out[on], out[~on] = self._apply(tree[3], x[on]), self._apply(tree[4], x[~on])
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.prior)
        for tree in self.trees:
            f += self.rate * self._apply(tree, x)
        return f


def examples(words: list[str], n: int = 6000, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of proposals in made-up sentences: formats of personal data, and near misses of the same shapes."""
    rng = np.random.default_rng(seed)
    digit = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    words = [w for w in words if w.isalpha()] or ["word"]
    plain = [w for w in words if w.isascii()] or ["word"]  # what the generators take for a name
    name = lambda: pick(plain).lower()[:10]
    ends = ("com", "org", "net", "edu", "de", "fr", "es", "io")

    def card() -> str:
        body = pick("3456") + digit(14)
        return body + str(next(c for c in range(10) if luhn(body + str(c))))

    positive = (
        ("email", lambda: f"{name()}{pick((' at ', ' [at] ', '(at)', ' (AT) ', ' (at) ', '[at]'))}{name()}{pick((' dot ', ' [dot] ', '(dot)', ' (dot) '))}{pick(ends)}"),
        ("email", lambda: f"{name()}{pick((' at ', ' [at] ', '(at)', ' (at) '))}{name()}.{pick(ends)}"),
        ("ip", lambda: pick(("[.]", "(.)")).join(str(rng.integers(1, 255)) for _ in range(4))),
        ("ip", lambda: ":".join(f"{rng.integers(0, 65536):x}" for _ in range(8))),
        ("card", lambda: pick((".", "/", "  ", "_")).join(re.findall("....", card()))),
        ("phone", lambda: f"{pick(('', '0049 ', '0033 '))}({digit(3)}) {digit(3)}-{digit(4)}"),
        ("phone", lambda: f"{digit(3)}-{digit(3)}-{digit(4)}"),
        ("phone", lambda: f"{digit(3)}.{digit(3)}.{digit(4)}"),
    )
    negative = (
        lambda: f"{name()} at {name()} dot {name()}",
        lambda: f"{name()} at {name()}.{name()}",
        lambda: f"{digit(2)}:{digit(2)}:{digit(2)}:{digit(2)}",
        lambda: ".".join(str(rng.integers(256, 999)) for _ in range(4)),
        lambda: pick(("/", "-", ".")).join((digit(4), digit(2), digit(2))),
        lambda: f"{rng.integers(1900, 2030)}-{rng.integers(1900, 2030)}",
        lambda: f"{digit(2)}.{digit(2)}.{digit(4)}",
        lambda: f"{digit(3)} {digit(3)} {digit(3)}",
        lambda: "-".join((digit(4), digit(4), digit(4), digit(3))),
        lambda: f"{digit(2)} {digit(2)}",
        lambda: f"{digit(3)}-{digit(2)}-{digit(5)}-{digit(2)}",
    )
    x, y = [], []
    while len(y) < n:
        good = rng.random() < 0.5
        of, make = pick(positive) if good else ("", pick(negative))
        made = make()
        around = [pick(words) for _ in range(8)]
        if good and rng.random() < 0.3:
            around[3] = pick(pick(tuple(_CUES.values())))
        head = " ".join(around[:4]) + " "
        text = head + made + " " + " ".join(around[4:])
        for kind, a, b in proposals(text):
            inside = a >= len(head) and b <= len(head) + len(made)
            whole = a == len(head) and b == len(head) + len(made)
            if whole or (inside and not good):  # a part of true data is neither right nor a near miss
                x.append(describe(text, kind, a, b))
                y.append(float(kind == of))
    return np.array(x), np.array(y)


def fit(docs: DataFrame, sample_rows: int = 500, precision: float = 0.98) -> tuple[Boosted, dict[str, float]]:
    """The trees and, per kind, the raw score from which calibrated precision is at least ``precision``."""
    taken = hash_sample(docs.select("doc_id", F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.lit(100)).alias("words")), "doc_id", sample_rows, "pii")
    words = sorted({w for r in taken.collect() for w in r.words or ()})
    x, y = examples(words)
    cut = len(y) * 2 // 3
    model = Boosted().fit(x[:cut], y[:cut])
    raw, truth = model.raw(x[cut:]), y[cut:]
    thresholds = {}
    for k, kind in enumerate(KINDS):
        own = x[cut:, 0] == k
        thresholds[kind] = calibrated_threshold(raw[own], truth[own], precision)
    return model, thresholds


def calibrated_threshold(raw: np.ndarray, truth: np.ndarray, precision: float) -> float:
    """Isotonic calibration (pool adjacent violators); the smallest score whose calibrated precision is enough, else infinity."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []
    for score, label in zip(raw[order], truth[order], strict=True):
        blocks.append([label, 1.0, score])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            label_, n, _ = blocks.pop()
            blocks[-1][0] += label_
            blocks[-1][1] += n
    return next((float(s) for total, n, s in blocks if total / n >= precision), math.inf)


def find(text: str, model: Boosted, thresholds: dict[str, float]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans: base ones and the proposals that the model accepts, the best of overlapping ones."""
    base = base_spans(text)
    offered = proposals(text)
    if not offered:
        return base, base
    taken = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in taken], np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []

    def free(a: int, b: int) -> bool:
        i = bisect.bisect_left(starts, b)
        return not i or reach[i - 1] <= a

    offered = [s for s in offered if free(s[1], s[2])]
    if not offered:
        return base, base
    raw = model.raw(np.array([describe(text, *s) for s in offered]))
    added: list[tuple[int, int, str]] = []
    for score, (kind, a, b) in sorted(zip(raw.tolist(), offered, strict=True), key=lambda r: (-r[0], r[1][1], r[1][2])):
        if score < thresholds[kind]:
            continue
        i = bisect.bisect_left(added, (a, b, kind))
        if (i and added[i - 1][1] > a) or (i < len(added) and added[i][0] < b):
            continue
        added.insert(i, (a, b, kind))
    every = [*base, *((k, a, b) for a, b, k in added)]
    return base, sorted(every, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all, as kind:start:end)."""
    model, thresholds = fit(docs, **options)

    def run(batch):
        out = {n: [] for n in ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")}
        for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
            base, every = find(text or "", model, thresholds)
            counts = Counter(k for k, _, _ in base)
            out["doc_id"].append(doc)
            for k in KINDS:
                out[f"n_{k}"].append(counts[k])
            out["base_sha256"].append(sha256(_joined(base).encode()).hexdigest())
            out["spans"].append(_joined(every))
        return out

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), schema, run)


def redact(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, text): every span replaced by its kind in brackets."""
    model, thresholds = fit(docs, **options)

    def run(batch):
        texts = []
        for text in batch["text"]:
            if text is None:
                texts.append(None)
                continue
            parts, at = [], 0
            for kind, a, b in find(text, model, thresholds)[1]:
                if b > at:
                    parts += [text[at : max(a, at)], f"[{kind}]" if a >= at else ""]
                    at = b
            texts.append("".join([*parts, text[at:]]))
        return {"doc_id": batch["doc_id"], "text": texts}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, text string", run)
